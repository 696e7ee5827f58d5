"""Event segments as Parquet, partitioned by project and hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import scalars
from quillspan.schemas import EVENT

#: Rows of a file at most; a segment of traces is then of some hundred megabytes.
SEGMENT_ROWS = 1_000_000


def write_events(events: DataFrame, path: str, mode: str = "append", segment_rows: int = SEGMENT_ROWS) -> None:
    """Rows of a partition are brought together first, so that a task doesn't leave a file in every partition; a large hour is cut among tasks by size, small ones share one."""
    hour = scalars.bucket(F.col("start_time_unix_nano"))
    ready = events.withColumn("time_bucket", hour).hint("rebalance", "project_name", "time_bucket").sortWithinPartitions("project_name", "time_bucket", "start_time_unix_nano", "span_id")
    ready.write.mode(mode).option("maxRecordsPerFile", segment_rows).option("partitionOverwriteMode", "dynamic").partitionBy("project_name", "time_bucket").parquet(path)


def read_events(spark: SparkSession, path: str, extra: str = "") -> DataFrame:
    """Events with the partition columns; conditions on project and hour prune files."""
    return spark.read.schema(f"{EVENT}, time_bucket long{extra}").parquet(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """``project_name, time_bucket, path, rows`` of each file."""
    rows = read_events(spark, path).select("project_name", "time_bucket", F.input_file_name().alias("path"))
    return rows.groupBy("project_name", "time_bucket", "path").agg(F.count(F.lit(1)).alias("rows"))


def synthetic(spark: SparkSession, traces: int, runs: int = 8, fanout: int = 2, errors: int = 100, project: str = "synthetic") -> DataFrame:
    """Deterministic events: trees of ``runs`` spans, errors by a fixed rule in a thousand."""
    i, n = F.col("id"), F.pmod(F.col("id"), F.lit(runs))
    t = F.call_function("div", F.col("id"), F.lit(runs).cast("long"))
    start = F.lit(1_700_000_000_000_000_000) + t * 1_000_000_000 + n * 10_000_000
    made = {
        "project_name": F.lit(project), "trace_id": F.lpad(F.hex(t), 32, "0"), "span_id": F.lpad(F.hex(n), 16, "0"), "run_id": F.lit(""), "parent_run_id": F.lit(None).cast("string"),
        "parent_span_id": F.when(n > 0, F.lpad(F.hex(F.call_function("div", n - 1, F.lit(fanout).cast("long"))), 16, "0")), "name": F.concat(F.lit("run-"), n.cast("string")), "run_type": F.element_at(F.array(*[F.lit(x) for x in ("chain", "llm", "tool", "retriever")]), (F.pmod(i, F.lit(4)) + 1).cast("int")),
        "event_type": F.lit("end"), "start_time_unix_nano": start, "end_time_unix_nano": start + 5_000_000, "status_code": F.when(F.pmod(i * 37 + 11, F.lit(1000)) < errors, 2).otherwise(1),
        "attributes_json": F.concat(F.lit('{"metadata":{"thread_id":"thread-'), F.pmod(t, F.lit(4)).cast("string"), F.lit('"},"metrics":{"prompt_tokens":'), n.cast("string"), F.lit(',"completion_tokens":2}}')), "row_index": i, "idempotency_key": F.lit(None).cast("string"),
    }
    return spark.range(traces * runs).select(*[c.alias(k) for k, c in made.items()])
