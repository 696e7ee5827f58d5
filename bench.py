"""Times the headline queries and prints one line of JSON.

Tables derived once in a deployment (heads, tree, postings, rollups) are written
before the clock starts where a query would read them as tables; ``heads`` and
``rollup_build`` time the derivation itself. Each query runs cold once and then
``BENCH_RUNS`` times; the least time counts.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from quillspan import fixtures, queries  # noqa: E402
from quillspan.operators import heads, rollups, search, threads, tree  # noqa: E402
from quillspan.plans import filters, runs  # noqa: E402


def main() -> None:
    sf_dir, cpus, again = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "2"))
    work = tempfile.mkdtemp(prefix="quillspan-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def held(df, name, *order):
        (df.repartitionByRange(int(cpus), *order).sortWithinPartitions(*order) if order else df).write.parquet(f"{work}/{name}")
        return spark.read.parquet(f"{work}/{name}")

    metric = held(queries.metric_heads(spark, sf_dir), "metric", "project_name", "start_time_unix_nano")
    plain = heads.latest(fixtures.tree_events(spark, sf_dir))
    nodes = held(tree.nodes(plain), "nodes", "trace_id")
    trees = held(heads.with_tree(plain, nodes), "trees", "trace_id")
    docs = held(queries.doc_heads(spark, sf_dir), "docs")
    leaves = held(search.leaves(docs), "leaves")
    posts = held(search.postings(leaves), "postings", "token", "path")
    hourly = held(rollups.runs(metric), "hourly", "project_name", "bucket_start_unix_nano")
    thread_traces = held(threads.traces(heads.latest(fixtures.chat_events(spark, sf_dir))), "thread_traces", "thread_id")
    feedback = fixtures.feedback_rows(spark, sf_dir)
    flags = ["flag-A", "flag-N", "flag-R"]
    select = lambda f: runs.select_runs(metric, runs.RunQuery(flags, filter=f))
    names = {
        "heads": lambda: queries.metric_heads(spark, sf_dir),
        "single_run_load": lambda: metric.where((F.col("trace_id") == "o7") & (F.col("span_id") == "l1")),
        "trace_tree_load": lambda: tree.load(trees, nodes, "orders", "o7"),
        "project_run_filtering": lambda: runs.list_runs(metric, runs.RunQuery(["flag-A"], limit=100)),
        "selective_scalar_filter": lambda: select('and(gt(total_cost, 90000), eq(run_type, "tool"))'),
        "nonselective_scalar_filter": lambda: select("gt(total_cost, 10)"),
        "feedback_filter": lambda: filters.apply(docs, 'and(eq(feedback_key, "quality"), gte(feedback_score, 1))', filters.Context(feedback)),
        "root_tree_predicate": lambda: filters.tree_filter(trees, nodes, 'root(eq(name, "order-F"))'),
        "child_tree_predicate": lambda: filters.tree_filter(trees, nodes, 'child(eq(name, "line-R"))'),
        "thread_trace_listing": lambda: runs.trace_page(thread_traces.where("thread_id = 'thread-7'")),
        "aggregate_rollup": lambda: runs.aggregate_runs(metric, runs.RunQuery(flags, group_by=("project", "time_bucket", "run_type")), rollup=hourly)[0],
        "aggregate_model": lambda: runs.aggregate_runs(metric, runs.RunQuery(flags, group_by=("model",)))[0],
        "rollup_build": lambda: rollups.runs(metric),
        "full_text_search": lambda: filters.apply(docs, 'search("idiot")', filters.Context(leaves=leaves, postings=posts)),
        "flagship": lambda: queries.flagship(spark, sf_dir),
    }
    try:
        from quillspan.llm import queries as llm

        names |= {n: (lambda f=f: f(spark, sf_dir)) for n, f in llm.QUERIES.items()}
    except ImportError:
        pass
    took, rows = {}, {}
    for name, make in names.items():
        best = None
        for _ in range(1 + (again if not name.startswith("op") else 0)):
            began = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.perf_counter() - began)
        took[name] = round(best, 3)
    rows["metric_heads"] = metric.count()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf_dir).name.removeprefix("sf"), "rows": rows}))
    spark.stop()
    shutil.rmtree(work, ignore_errors=True)


if __name__ == "__main__":
    main()
