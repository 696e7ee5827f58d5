"""Registered queries over whole tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan import fixtures
from quillspan.functions import scalars, text
from quillspan.operators import aggregates, feedback, heads, lifecycle, rollups, search, threads, tree
from quillspan.plans import filters, runs
from quillspan.schemas import HOUR
from quillspan.sources import scratch, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# Views of the tables in SQL, as in fixtures.py.
_EV = """ev AS (SELECT 'proj-' || (user_id % 3) AS project_name, 't' || user_id AS trace_id, 's' || (event_id % 8) AS span_id,
  CASE WHEN event_id % 8 <> 0 THEN 's' || ((event_id % 8 - 1) // 2) END AS parent_span_id, event_type AS name,
  (['chain','llm','tool','retriever'])[event_id % 4 + 1] AS run_type, epoch_us(ts) * 1000 AS start,
  CASE WHEN event_type = 'view' THEN 0 ELSE epoch_us(ts) * 1000 + CAST(round(value * 1e6) AS BIGINT) END AS stop,
  CASE event_type WHEN 'error' THEN 2 WHEN 'view' THEN 0 ELSE 1 END AS status_code, event_id AS row_index FROM events)"""
_MT = """mt AS (SELECT 'flag-' || l_returnflag AS project_name, 'o' || l_orderkey AS trace_id, 'l' || l_linenumber AS span_id,
  CAST(NULL AS VARCHAR) AS parent_span_id, 'item-' || l_linenumber AS name, CASE WHEN l_linestatus = 'O' THEN 'llm' ELSE 'tool' END AS run_type,
  epoch_us(l_shipdate) * 1000 AS start, epoch_us(l_shipdate) * 1000 + CAST(l_quantity * 1e6 AS BIGINT) AS stop,
  CASE WHEN l_discount > 0.09 THEN 2 ELSE 1 END AS status_code, CAST(l_quantity AS BIGINT) AS prompt_tokens, l_extendedprice AS total_cost,
  'model-' || (l_partkey % 3) AS model_name, l_partkey * 1000 + l_suppkey AS row_index FROM lineitem)"""
_TR = """tr AS (SELECT 'o' || o_orderkey AS trace_id, 'l0' AS span_id, CAST(NULL AS VARCHAR) AS parent_span_id, 'order-' || o_orderstatus AS name, epoch_us(o_orderdate) * 1000 AS start FROM orders
  UNION ALL SELECT 'o' || l_orderkey, 'l' || l_linenumber, 'l' || ((l_linenumber - 1) // 2), 'line-' || min(l_returnflag), min(epoch_us(l_shipdate)) * 1000 FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
_CH = """ch AS (SELECT 'c' || conv_id || '-' || (turn // 2) AS trace_id, 'm' || turn AS span_id, 'thread-' || conv_id AS thread_id, role,
  conv_id * 3600000000000 + turn * 1000000000 AS start, conv_id * 3600000000000 + turn * 1000000000 + 500000000 AS stop,
  CASE WHEN role <> 'assistant' THEN text END AS inp, CASE WHEN role = 'assistant' THEN text END AS outp FROM conversations)"""


def _heads(source: str) -> str:
    at = "CASE WHEN stop > 0 THEN stop ELSE start END"
    return f"""hd AS (SELECT *, {at} AS event_time, CASE WHEN status_code = 2 THEN 'error' WHEN stop = 0 THEN 'pending' ELSE 'success' END AS status, greatest(stop - start, 0) AS latency
  FROM {source} QUALIFY row_number() OVER (PARTITION BY project_name, trace_id, span_id ORDER BY {at} DESC, stop DESC, start DESC, row_index DESC) = 1)"""


_EH, _MH = f"{_EV}, {_heads('ev')}", f"{_MT}, {_heads('mt')}"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def event_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heads.latest(fixtures.run_events(spark, sf_dir))


def metric_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heads.latest(fixtures.metric_events(spark, sf_dir))


def doc_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heads.latest(fixtures.doc_events(spark, sf_dir))


KEY = ["project_name", "trace_id", "span_id"]
_HEAD = [*KEY, "run_type", "status", "event_time_unix_nano AS event_time", "latency_nanos AS latency"]
_FEW = [*KEY, "name"]
_PROJECTS = ["proj-0", "proj-1", "proj-2"]
_FLAGS = ["flag-A", "flag-N", "flag-R"]


# Heads and run lists --------------------------------------------------------


@query(f"WITH {_EH} SELECT project_name, trace_id, span_id, run_type, status, event_time, latency FROM hd")
def run_heads_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_heads(spark, sf_dir).selectExpr(*_HEAD)


@query(f"WITH {_EH} SELECT project_name, trace_id, span_id, status, start AS start_time FROM hd WHERE project_name IN ('proj-0', 'proj-1') ORDER BY start, span_id LIMIT 50 OFFSET 20")
def runs_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = runs.RunQuery(["proj-0", "proj-1"], limit=50, cursor="20")
    return runs.list_runs(event_heads(spark, sf_dir), q).select(*KEY, "status", F.col("start_time_unix_nano").alias("start_time"))


@query(f"WITH {_EH} SELECT project_name, trace_id, span_id, status, start AS start_time FROM hd WHERE run_type = 'llm' AND status <> 'error' ORDER BY start DESC, span_id LIMIT 50")
def runs_list_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = runs.RunQuery(_PROJECTS, run_type="llm", error=False, descending=True, limit=50)
    return runs.list_runs(event_heads(spark, sf_dir), q).select(*KEY, "status", F.col("start_time_unix_nano").alias("start_time"))


@query(f"WITH {_EH} SELECT project_name, trace_id, span_id, CASE WHEN (SELECT count(*) FROM hd WHERE run_type = 'llm') > 60 THEN '60' END AS next_cursor FROM hd WHERE run_type = 'llm' ORDER BY start, span_id, trace_id, project_name LIMIT 40 OFFSET 20")
def runs_page_with_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page, and where the next one begins: a row more than the page is looked at."""
    q = runs.RunQuery(_PROJECTS, run_type="llm", limit=40, cursor="20")
    return runs.list_runs_page(event_heads(spark, sf_dir), q).select(*KEY, "next_cursor")


def _filtered(name: str, source, where: str, view: str = "mt"):
    """A filter over all metric heads and the condition that says the same in SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return runs.select_runs(metric_heads(spark, sf_dir), runs.RunQuery(_FLAGS, filter=source)).select(*_FEW)

    QUERIES[name] = run
    ORACLE_SQL[name] = f"WITH {_MH} SELECT project_name, trace_id, span_id, name FROM hd WHERE {where}"


_filtered("runs_filter_scalar", 'and(gte(latency, "0.02s"), lt(total_cost, 30000), eq(model, "model-1"))', "latency >= 20000000 AND total_cost < 30000 AND model_name = 'model-1'")
_filtered("runs_filter_negated", 'and(neq(run_type, "llm"), or(eq(error, true), gt(prompt_tokens, 40)))', "run_type <> 'llm' AND (status = 'error' OR prompt_tokens > 40)")
_filtered("runs_filter_contains", 'and(contains(name, "ITEM-3"), does_not_contain(model_name, "2"))', "lower(name) LIKE '%item-3%' AND NOT lower(model_name) LIKE '%2%'")
_filtered("runs_filter_in", 'or(in(model, ["model-0", "model-2"]), in(name, ["item-7"]))', "model_name IN ('model-0', 'model-2') OR name IN ('item-7')")
_filtered("runs_filter_structured", {"and": [{"field": "run_type", "operator": "is one of", "value": ["tool"]}, {"or": [{"field": "prompt_tokens", "operator": ">=", "value": 45}, {"field": "status", "operator": "=", "value": "error"}]}]}, "run_type IN ('tool') AND (prompt_tokens >= 45 OR status = 'error')")
_filtered("runs_filter_time", 'and(gte(start_time, "1995-01-01T00:00:00Z"), lt(start_time, "1996-01-01T00:00:00Z"))', "start >= 788918400000000000 AND start < 820454400000000000")


def _docs_filtered(name: str, source, where: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ctx = filters.Context(feedback=fixtures.feedback_rows(spark, sf_dir))
        return filters.apply(doc_heads(spark, sf_dir), source, ctx).select("project_name", "run_id")

    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT source AS project_name, 'doc-' || d.doc_id AS run_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE {where}"


_docs_filtered("runs_filter_metadata_pair", 'and(eq(metadata_key, "lang"), eq(metadata_value, "de"))', "lang = 'de'")
_docs_filtered("runs_filter_anchored_neq", 'and(eq(metadata_key, "lang"), neq(metadata_value, "de"))', "lang <> 'de'")
_docs_filtered("runs_filter_unanchored_neq", 'and(neq(metadata_value, "de"), neq(metadata_key, "nothing"))', "lang <> 'de'")
_docs_filtered("runs_filter_tags", 'and(has(tags, "lang:fr"), neq(tags, "lang:en"))', "lang = 'fr'")
_docs_filtered("runs_filter_feedback", 'and(eq(feedback_key, "quality"), gte(feedback_score, 1))', "l.quality >= 1")
_docs_filtered("runs_filter_feedback_absent", 'neq(feedback_key, "toxic")', "l.toxic IS NULL")
_docs_filtered("runs_filter_id", 'eq(id, "doc-5")', "doc_id = 5")
_docs_filtered("runs_filter_id_neq", 'neq(id, "doc-5")', "doc_id <> 5")
_docs_filtered("runs_filter_has_metadata_key", 'has(metadata_key, "lang")', "lang IS NOT NULL")
_docs_filtered("runs_filter_id_in", 'in(id, ["doc-1", "doc-5", "doc-99"])', "doc_id IN (1, 5, 99)")


# Trees ------------------------------------------------------------------------

_PARENTS = f"""{_TR}, nd AS (SELECT a.*, CASE WHEN b.span_id IS NOT NULL THEN a.parent_span_id END AS parent FROM tr a LEFT JOIN tr b ON a.trace_id = b.trace_id AND a.parent_span_id = b.span_id)"""
_CLOSURE = f"""{_TR}, nd AS (SELECT a.*, CASE WHEN b.span_id IS NOT NULL THEN a.parent_span_id END AS parent FROM tr a LEFT JOIN tr b ON a.trace_id = b.trace_id AND a.parent_span_id = b.span_id),
  down AS (SELECT trace_id, span_id AS root, span_id, 0 AS depth FROM nd WHERE parent IS NULL UNION ALL SELECT d.trace_id, d.root, n.span_id, d.depth + 1 FROM down d JOIN nd n ON n.trace_id = d.trace_id AND n.parent = d.span_id),
  clo AS (SELECT trace_id, span_id AS anc, span_id, 0 AS up FROM nd UNION ALL SELECT c.trace_id, c.anc, n.span_id, c.up + 1 FROM clo c JOIN nd n ON n.trace_id = c.trace_id AND n.parent = c.span_id)"""


def tree_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heads.latest(fixtures.tree_events(spark, sf_dir))


@query(f"""WITH RECURSIVE {_CLOSURE} SELECT d.trace_id, d.span_id, d.root AS root_span_id, d.depth, (SELECT count(*) FROM clo c WHERE c.trace_id = d.trace_id AND c.anc = d.span_id AND c.up > 0) AS descendant_count,
  n.parent_span_id IS NOT NULL AND n.parent IS NULL AS unresolved_parent FROM down d JOIN nd n USING (trace_id, span_id)""")
def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.nodes(tree_heads(spark, sf_dir)).select("trace_id", "span_id", "root_span_id", "depth", "descendant_count", "unresolved_parent")


_PLACES = f"""{_EH}, np AS (SELECT a.*, lpad(CAST(a.start AS VARCHAR), 20, '0') || '.' || a.span_id AS place, CASE WHEN b.span_id IS NOT NULL THEN a.parent_span_id END AS parent FROM hd a LEFT JOIN hd b ON a.project_name = b.project_name AND a.trace_id = b.trace_id AND a.parent_span_id = b.span_id),
  wk AS (SELECT project_name, trace_id, span_id, span_id AS root, 0 AS depth, [place] AS path FROM np WHERE parent IS NULL UNION ALL SELECT n.project_name, n.trace_id, n.span_id, w.root, w.depth + 1, list_append(w.path, n.place) FROM wk w JOIN np n ON n.project_name = w.project_name AND n.trace_id = w.trace_id AND n.parent = w.span_id),
  pl AS (SELECT w.*, n.parent, n.parent_span_id IS NOT NULL AND n.parent IS NULL AS orphan, row_number() OVER (PARTITION BY w.project_name, w.trace_id ORDER BY w.path) - 1 AS i, row_number() OVER (PARTITION BY w.project_name, w.trace_id, n.parent ORDER BY n.place) - 1 AS k,
    (SELECT count(*) FROM wk c WHERE c.project_name = w.project_name AND c.trace_id = w.trace_id AND len(c.path) > len(w.path) AND c.path[1:len(w.path)] = w.path) AS below FROM wk w JOIN np n USING (project_name, trace_id, span_id))"""


@query(f"""WITH RECURSIVE {_PLACES} SELECT project_name, trace_id, span_id, parent AS parent_span_id, root AS root_span_id, CAST(depth AS BIGINT) AS depth, k AS sibling_order, 2 * i - depth AS subtree_start, 2 * i - depth + 2 * below + 1 AS subtree_end, below AS descendant_count, orphan AS unresolved_parent, FALSE AS cycle_detected FROM pl""")
def tree_nested_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-order intervals: a node at place i and depth d has entered i nodes and left i - d before it."""
    return tree.nodes(event_heads(spark, sf_dir)).drop("run_id", "root_run_id")


@query(f"WITH RECURSIVE {_PLACES} SELECT project_name, trace_id, parent AS parent_span_id, span_id AS child_span_id, k AS sibling_order, CAST(depth AS BIGINT) AS depth FROM pl WHERE parent IS NOT NULL")
def tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.edges(tree.nodes(event_heads(spark, sf_dir)))


@query(f"WITH RECURSIVE {_PLACES} SELECT p.span_id, CAST(p.depth AS BIGINT) AS depth, p.k AS sibling_order, h.run_type, h.status, row_number() OVER (ORDER BY p.path) AS place FROM pl p JOIN hd h USING (project_name, trace_id, span_id) WHERE p.project_name = 'proj-1' AND p.trace_id = 't1'")
def trace_tree_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trace in tree order."""
    h = event_heads(spark, sf_dir)
    rows = tree.load(h, tree.nodes(h), "proj-1", "t1")
    return rows.select("span_id", "depth", "sibling_order", "run_type", "status", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("subtree_start")).cast("long").alias("place"))


@query(f"WITH RECURSIVE {_CLOSURE} SELECT trace_id, span_id FROM tr WHERE trace_id IN (SELECT d.trace_id FROM down d JOIN nd n USING (trace_id, span_id) WHERE d.depth = 0 AND n.name = 'order-F')")
def runs_trace_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.trace_keys(tree_heads(spark, sf_dir), 'eq(name, "order-F")').select("trace_id", "span_id")


_HIT = "(SELECT trace_id, span_id FROM nd WHERE name = 'line-R')"
_TREE_SQL = {
    "runs_tree_filter_trace": ('eq(name, "line-R")', f"SELECT trace_id, span_id FROM nd WHERE trace_id IN (SELECT trace_id FROM {_HIT})"),
    "runs_tree_filter_root": ('root(eq(name, "line-R"))', "SELECT trace_id, span_id FROM nd WHERE trace_id IN (SELECT trace_id FROM down JOIN nd USING (trace_id, span_id) WHERE depth = 0 AND name = 'line-R')"),
    "runs_tree_filter_child": ('child(eq(name, "line-R"))', "SELECT DISTINCT trace_id, parent AS span_id FROM nd WHERE name = 'line-R' AND parent IS NOT NULL"),
    "runs_tree_filter_descendant": ('descendant(eq(name, "line-R"))', f"SELECT DISTINCT c.trace_id, c.anc AS span_id FROM clo c JOIN {_HIT} h USING (trace_id, span_id) WHERE c.up > 0"),
    "runs_tree_filter_filtered_only": ('filtered_only(eq(name, "line-R"))', "SELECT trace_id, span_id FROM tr WHERE name = 'line-R'"),
    "runs_tree_filter_filtered_only_root": ('filtered_only(root(eq(name, "line-R")))', "SELECT trace_id, span_id FROM nd WHERE name = 'line-R' AND parent IS NULL"),
    "runs_tree_filter_filtered_only_child": ('filtered_only(child(eq(name, "line-R")))', "SELECT trace_id, span_id FROM nd WHERE name = 'line-R' AND parent = span_id"),
    "runs_tree_filter_filtered_only_descendant": ('filtered_only(descendant(eq(name, "line-R")))', "SELECT trace_id, span_id FROM nd WHERE name = 'line-R' AND parent = span_id"),
    "runs_tree_filter_most_relevant_root": ('most_relevant(root(eq(name, "order-F")))', "SELECT trace_id, span_id FROM nd WHERE name = 'order-F' AND parent IS NULL"),
    "runs_tree_filter_most_relevant_child": ('most_relevant(child(eq(name, "line-R")))', "SELECT DISTINCT trace_id, parent AS span_id FROM nd WHERE name = 'line-R' AND parent IS NOT NULL"),
    "runs_tree_filter_most_relevant_descendant": ('most_relevant(descendant(eq(name, "line-R")))', f"SELECT DISTINCT c.trace_id, c.anc AS span_id FROM clo c JOIN {_HIT} h USING (trace_id, span_id) WHERE c.up > 0"),
    "runs_tree_filter_most_relevant": ('most_relevant(eq(name, "line-R"))', f"SELECT DISTINCT c.trace_id, c.anc AS span_id FROM clo c JOIN {_HIT} h USING (trace_id, span_id)"),
}


def _tree_filtered(name: str, source: str, sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return filters.tree_keys(tree_heads(spark, sf_dir), source).select("trace_id", "span_id")

    QUERIES[name] = run
    # Only what the mode needs of the closure.
    ORACLE_SQL[name] = f"WITH RECURSIVE {_CLOSURE if 'clo ' in sql or 'down ' in sql else _PARENTS if 'nd ' in sql else _TR} {sql}"


for _name, (_source, _sql) in _TREE_SQL.items():
    _tree_filtered(_name, _source, _sql)


# Aggregates ---------------------------------------------------------------------


def _rank(x: str, p: int) -> str:
    return f"list_sort(list({x}) FILTER ({x} IS NOT NULL))[((count({x}) - 1) * {p} + 99) // 100 + 1]"


_STATS = f"count(*) AS count, count(*) FILTER (status = 'error') AS error_count, CAST(avg(latency) AS DOUBLE) AS latency_nanos_avg, CAST({_rank('latency', 50)} AS DOUBLE) AS latency_nanos_p50, CAST({_rank('latency', 95)} AS DOUBLE) AS latency_nanos_p95, CAST({_rank('latency', 99)} AS DOUBLE) AS latency_nanos_p99"
_SHOWN = ["count", "error_count", "round(latency_nanos_avg, 3) AS latency_nanos_avg", "latency_nanos_p50", "latency_nanos_p95", "latency_nanos_p99"]
_STATS = _STATS.replace("CAST(avg(latency) AS DOUBLE)", "round(CAST(avg(latency) AS DOUBLE), 3)")


def _aggregated(name: str, groups: tuple[str, ...], keys: str, names: list[str], metric: bool = True):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = runs.RunQuery(_FLAGS if metric else _PROJECTS, group_by=groups)
        rows, _ = runs.aggregate_runs((metric_heads if metric else event_heads)(spark, sf_dir), q)
        more = ["round(total_cost_sum, 2) AS total_cost_sum", "prompt_tokens_max"] if metric else []
        return rows.selectExpr(*names, *_SHOWN, *more)

    QUERIES[name] = run
    more = ", round(sum(total_cost), 2) AS total_cost_sum, CAST(max(prompt_tokens) AS DOUBLE) AS prompt_tokens_max" if metric else ""
    ORACLE_SQL[name] = f"WITH {_MH if metric else _EH} SELECT {keys}{', ' if keys else ''}{_STATS}{more} FROM hd {'GROUP BY ALL' if keys else ''}"


_BUCKET = f"CAST(start - ((start % {HOUR}) + {HOUR}) % {HOUR} AS VARCHAR) AS time_bucket_start_unix_nano"
_aggregated("agg_global", (), "", [])
_aggregated("agg_by_run_type", ("run_type",), "run_type", ["run_type"])
_aggregated("agg_by_model", ("project", "model"), "project_name, model_name", ["project_name", "model_name"])
_aggregated("agg_by_error", ("error",), "CAST(status = 'error' AS VARCHAR) AS error", ["error"])
_aggregated("agg_by_project_hour", ("project", "time_bucket"), f"project_name, {_BUCKET}", ["project_name", "time_bucket_start_unix_nano"], metric=False)


@query("SELECT 'lang:' || lang AS tag, count(*) AS count, CAST(max(n_chars) AS DOUBLE) AS latency_nanos_max FROM documents GROUP BY ALL")
def agg_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.aggregate(doc_heads(spark, sf_dir), ("tag",)).select("tag", "count", "latency_nanos_max")


@query("""WITH f AS (SELECT lang, 'quality' AS feedback_key, quality AS s FROM labels JOIN documents USING (doc_id) UNION ALL SELECT lang, 'toxic', toxic FROM labels JOIN documents USING (doc_id))
  SELECT 'lang:' || lang AS tag, feedback_key, count(*) AS count, round(avg(s), 6) AS score_avg, count(*) FILTER (s < 0) AS score_lt_0, count(*) FILTER (s >= 0 AND s < 0.25) AS score_0_to_0_25, count(*) FILTER (s >= 0.25 AND s < 0.5) AS score_0_25_to_0_5, count(*) FILTER (s >= 0.5 AND s < 0.75) AS score_0_5_to_0_75, count(*) FILTER (s >= 0.75 AND s <= 1) AS score_0_75_to_1, count(*) FILTER (s > 1) AS score_gt_1,
  CAST(min(s) AS DOUBLE) AS score_min, CAST(max(s) AS DOUBLE) AS score_max FROM f GROUP BY ALL""")
def agg_feedback_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = aggregates.aggregate(doc_heads(spark, sf_dir), ("tag", "feedback_key"), feedback=fixtures.feedback_rows(spark, sf_dir))
    return rows.select("tag", "feedback_key", "count", F.round("feedback_score_avg", 6).alias("score_avg"), *[f"score_{b}" for b in aggregates.BINS], F.col("feedback_score_min").alias("score_min"), F.col("feedback_score_max").alias("score_max"))


@query(f"""WITH {_MH}, k AS (SELECT *, unnest([{{'kind': 'project', 'value': ''}}, {{'kind': 'run_type', 'value': run_type}}, {{'kind': 'model', 'value': model_name}}, {{'kind': 'error', 'value': CAST(status = 'error' AS VARCHAR)}}]) AS r FROM hd)
  SELECT project_name, start - start % {HOUR} AS bucket_start_unix_nano, r.kind AS rollup_kind, r.value AS group_value, count(*) AS count, count(*) FILTER (status = 'error') AS error_count, min(latency) AS latency_min, max(latency) AS latency_max,
  {_rank("latency", 50)} AS latency_p50, {_rank("latency", 99)} AS latency_p99, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens_sum, round(sum(total_cost), 2) AS total_cost_sum FROM k GROUP BY ALL""")
def rollup_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rollups.runs(metric_heads(spark, sf_dir))
    return rows.select("project_name", "bucket_start_unix_nano", "rollup_kind", "group_value", "count", "error_count", "latency_min", "latency_max", "latency_p50", "latency_p99", "prompt_tokens_sum", F.round("total_cost_sum", 2).alias("total_cost_sum"))


@query(f"WITH {_MH} SELECT project_name, start - start % {HOUR} AS bucket_start_unix_nano, run_type AS group_value, count(*) AS count, round(avg(CAST(status = 'error' AS INT)), 9) AS error_rate FROM hd WHERE run_type = 'tool' GROUP BY ALL")
def rollup_answers_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = metric_heads(spark, sf_dir)
    q = runs.RunQuery(_FLAGS, run_type="tool", group_by=("project", "time_bucket", "run_type"))
    rows, source = runs.aggregate_runs(h, q, rollup=rollups.runs(h))
    assert source == "rollup"
    return rows.select("project_name", "bucket_start_unix_nano", "group_value", "count", F.round("error_rate", 9).alias("error_rate"))


@query(f"""WITH f AS (SELECT d.source AS project_name, d.doc_id, 'quality' AS key, quality AS s FROM labels JOIN documents d USING (doc_id) UNION ALL SELECT d.source, d.doc_id, 'toxic', toxic FROM labels JOIN documents d USING (doc_id))
  SELECT project_name, doc_id * 1000000000 - (doc_id * 1000000000) % {HOUR} AS bucket_start_unix_nano, key, count(*) AS feedback_count, count(s) AS score_count, round(avg(s), 6) AS score_avg, CAST({_rank("s", 95)} AS DOUBLE) AS score_p95 FROM f GROUP BY ALL""")
def rollup_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.feedback(fixtures.feedback_rows(spark, sf_dir)).select("project_name", "bucket_start_unix_nano", "key", "feedback_count", "score_count", F.round("score_avg", 6).alias("score_avg"), "score_p95")


@query(f"WITH {_MH} SELECT project_name, 'run_type' AS field, count(DISTINCT run_type) AS distinct_values FROM hd GROUP BY 1 UNION ALL SELECT project_name, 'model_name', count(DISTINCT model_name) FROM hd GROUP BY 1")
def filter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.filter_stats(metric_heads(spark, sf_dir))


@query("""SELECT source AS project_name, 'run_type' AS field, 1 AS distinct_values FROM documents GROUP BY 1 UNION ALL SELECT source, 'tag', count(DISTINCT lang) FROM documents GROUP BY 1 HAVING count(lang) > 0
  UNION ALL SELECT source, 'metadata_key', 2 FROM documents GROUP BY 1""")
def filter_stats_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.filter_stats(doc_heads(spark, sf_dir))


@query(f"WITH {_EH} SELECT project_name, CAST(start - start % {HOUR} AS VARCHAR) AS time_bucket_start_unix_nano, count(*) AS count, count(*) FILTER (status = 'error') AS error_count FROM hd WHERE parent_span_id = 's1' GROUP BY ALL")
def agg_parent_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A condition that the rollup at hand doesn't hold: the scan answers."""
    h = event_heads(spark, sf_dir)
    rows, source = runs.aggregate_runs(h, runs.RunQuery(_PROJECTS, parent_span_id="s1", group_by=("project", "time_bucket")), rollup=rollups.runs(h))
    assert source == "scan"
    return rows.select("project_name", "time_bucket_start_unix_nano", "count", "error_count")


@query(f"WITH {_MH} SELECT run_type, model_name, count(*) AS count, " + ", ".join(f"count({c}) AS {n}_count, round(CAST(sum({c}) AS DOUBLE), 2) AS {n}_sum, round(CAST(avg({c}) AS DOUBLE), 6) AS {n}_avg, CAST(min({c}) AS DOUBLE) AS {n}_min, CAST(max({c}) AS DOUBLE) AS {n}_max" for c, n in (("prompt_tokens", "prompt_tokens"), ("total_cost", "total_cost"), ("latency", "latency_nanos"))) + ", CAST(count(*) FILTER (status = 'error') AS DOUBLE) / count(*) AS error_rate FROM hd GROUP BY run_type, model_name")
def agg_numeric_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = aggregates.aggregate(metric_heads(spark, sf_dir), ("run_type", "model"))
    each = [e for n in ("prompt_tokens", "total_cost", "latency_nanos") for e in (f"{n}_count", f"round({n}_sum, 2) AS {n}_sum", f"round({n}_avg, 6) AS {n}_avg", f"{n}_min", f"{n}_max")]
    return rows.selectExpr("run_type", "model_name", "count", *each, "error_rate")


# Threads ------------------------------------------------------------------------

_TT = f"""{_CH}, tt AS (SELECT thread_id, trace_id, min(start) AS start, max(stop) AS stop, max(stop) - min(start) AS latency, arg_min(inp, start) FILTER (inp IS NOT NULL) AS inputs_preview, arg_max(outp, start) FILTER (outp IS NOT NULL) AS outputs_preview FROM ch GROUP BY ALL)"""


def _chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heads.latest(fixtures.chat_events(spark, sf_dir))


@query(f"WITH {_TT} SELECT thread_id, trace_id, start AS start_time_unix_nano, stop AS end_time_unix_nano, latency AS latency_nanos, inputs_preview, outputs_preview FROM tt")
def thread_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.traces(_chat(spark, sf_dir)).select("thread_id", "trace_id", "start_time_unix_nano", "end_time_unix_nano", "latency_nanos", "inputs_preview", "outputs_preview")


@query(f"""WITH {_TT} SELECT thread_id, count(*) AS count, arg_min(trace_id, start) AS first_trace_id, arg_max(trace_id, start) AS last_trace_id, min(start) AS min_start_time_unix_nano, max(start) AS max_start_time_unix_nano,
  arg_min(inputs_preview, start) FILTER (inputs_preview IS NOT NULL) AS first_inputs, arg_max(outputs_preview, start) FILTER (outputs_preview IS NOT NULL) AS last_outputs, {_rank("latency", 50)} / 1e9 AS latency_p50, {_rank("latency", 99)} / 1e9 AS latency_p99 FROM tt GROUP BY ALL""")
def threads_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = threads.summaries(threads.traces(_chat(spark, sf_dir)))
    return rows.select("thread_id", "count", "first_trace_id", "last_trace_id", "min_start_time_unix_nano", "max_start_time_unix_nano", "first_inputs", "last_outputs", "latency_p50", "latency_p99")


@query(f"WITH {_TT} SELECT thread_id, max(start) AS max_start_time_unix_nano FROM tt GROUP BY 1 HAVING max(start) < 144000000000000 ORDER BY 2 DESC, 1 LIMIT 20")
def threads_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs.thread_page(threads.summaries(threads.traces(_chat(spark, sf_dir))), cursor="thread:144000000000000:~")
    return rows.select("thread_id", "max_start_time_unix_nano")


@query(f"WITH {_CH} SELECT thread_id, trace_id, span_id, CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END AS role, coalesce(inp, outp) AS preview, start AS turn_order FROM ch WHERE coalesce(inp, outp) IS NOT NULL")
def thread_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.messages(_chat(spark, sf_dir)).select("thread_id", "trace_id", "span_id", "role", "preview", "turn_order")


@query(f"WITH {_TT} SELECT thread_id, trace_id, CAST(NULL AS VARCHAR) AS next_cursor FROM tt WHERE thread_id = 'thread-7' ORDER BY start, trace_id LIMIT 100")
def thread_traces_last_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = threads.traces(_chat(spark, sf_dir)).where("thread_id = 'thread-7'")
    return runs.trace_page(rows, limit=100).select("thread_id", "trace_id", "next_cursor")


@query(f"WITH {_TT}, t AS (SELECT thread_id, max(start) AS s FROM tt GROUP BY 1), p AS (SELECT * FROM t ORDER BY s DESC, thread_id LIMIT 15) SELECT thread_id, (SELECT 'thread:' || s || ':' || thread_id FROM p ORDER BY s, thread_id DESC LIMIT 1) AS next_cursor FROM p")
def threads_page_with_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.thread_page(threads.summaries(threads.traces(_chat(spark, sf_dir))), limit=15).select("thread_id", "next_cursor")


@query(f"WITH {_CH}, r AS (SELECT *, row_number() OVER (PARTITION BY thread_id, trace_id ORDER BY start, span_id) AS n FROM ch) SELECT thread_id, trace_id FROM r WHERE n = 1 AND role = 'assistant'")
def thread_traces_by_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _chat(spark, sf_dir)
    return runs.by_root(threads.traces(h), h, 'eq(name, "assistant")').select("thread_id", "trace_id")


@query(f"WITH {_CH}, r AS (SELECT *, row_number() OVER (PARTITION BY thread_id, trace_id ORDER BY start, span_id) AS n FROM ch) SELECT DISTINCT thread_id FROM r WHERE n = 1 AND role = 'user' AND start >= 36000000000000")
def threads_by_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _chat(spark, sf_dir)
    traces = threads.traces(h)
    return runs.threads_by_root(threads.summaries(traces), traces, h, 'and(eq(name, "user"), gte(start_time, 36000000000000))').select("thread_id")


# Search ---------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
#: The first 4,096 bytes of a text, without half a character at the end.
_CUT = "CASE WHEN strlen(text) <= 4096 THEN text WHEN hex(encode(text))[8193] IN ('8', '9', 'A', 'B') THEN decode(unhex(regexp_replace(hex(encode(text))[1:8192], '^((?:..)*)[C-F].(?:[89AB].)*$', '\\1'))) ELSE decode(unhex(hex(encode(text))[1:8192])) END"
_TOKENS = f"dt AS (SELECT doc_id, source, list_filter(list_transform(regexp_extract_all({_CUT}, '[A-Za-z0-9]+'), lambda t: lower(left(t, 64))), lambda t: length(t) >= 2 AND t NOT IN ({_STOP})) AS tokens FROM documents WHERE text IS NOT NULL)"


def _search(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, filters.Context]:
    h = doc_heads(spark, sf_dir)
    leaves = search.leaves(h)
    return h, filters.Context(leaves=leaves, postings=search.postings(leaves))


def _searched(name: str, source: str, sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        h, ctx = _search(spark, sf_dir)
        return filters.apply(h, source, ctx).select("project_name", "run_id")

    QUERIES[name] = run
    ORACLE_SQL[name] = sql


_SEL = "SELECT source AS project_name, 'doc-' || doc_id AS run_id"
_searched("search_terms", 'search(inputs, "idiot the")', f"WITH {_TOKENS} {_SEL} FROM dt WHERE list_contains(tokens, 'idiot')")
_searched("search_phrase", 'search("\\"and attion the thanedble\\"")', f"WITH {_TOKENS} {_SEL} FROM dt WHERE list_contains(list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1]), 'attion thanedble')")
_searched("search_not", 'and(does_not_contain(inputs, "idiot"), eq(metadata_value, "en"))', f"WITH {_TOKENS} {_SEL} FROM documents d WHERE lang = 'en' AND NOT EXISTS (SELECT 1 FROM dt WHERE dt.doc_id = d.doc_id AND list_contains(tokens, 'idiot'))")
_searched("search_exact_value", 'eq(attributes_json, "fr")', f"{_SEL} FROM documents WHERE lang = 'fr'")
_searched("json_key", 'json_key("metadata.lan*")', f"{_SEL} FROM documents WHERE lang IS NOT NULL")
_searched("json_key_search", 'json_key_search("metadata.source", "src3")', f"{_SEL} FROM documents WHERE source = 'src3'")


_searched("runs_filter_scalar_and_search", 'and(eq(metadata_value, "en"), search(inputs, "idiot"))', f"WITH {_TOKENS} SELECT source AS project_name, 'doc-' || doc_id AS run_id FROM documents d WHERE lang = 'en' AND EXISTS (SELECT 1 FROM dt WHERE dt.doc_id = d.doc_id AND list_contains(tokens, 'idiot'))")


@query(f"WITH {_TOKENS} {_SEL} FROM dt WHERE list_contains(tokens, 'idiot') AND list_contains(tokens, 'moron')")
def search_stored_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings written in order of token and path, and read back by token."""
    h = doc_heads(spark, sf_dir)
    where = scratch.folder(spark, "postings")
    search.write_postings(search.postings(search.leaves(h)), where)
    found = search.matching_text(search.read_postings(spark, where), "idiot moron", ["inputs"])
    return h.join(found, KEY, "left_semi").select("project_name", "run_id")


@query(f"WITH {_TOKENS} SELECT t AS token, count(DISTINCT doc_id) AS runs, count(*) AS occurrences FROM (SELECT doc_id, unnest(tokens) AS t FROM dt) GROUP BY 1")
def search_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = search.postings(search.leaves(doc_heads(spark, sf_dir))).where(F.col("path") == "inputs.prompt")
    return posts.groupBy("token").agg(F.count(F.lit(1)).alias("runs"), F.sum(F.size("positions")).cast("long").alias("occurrences"))


# Feedback, lifecycle, lineage --------------------------------------------------------


@query("SELECT 'fb-quality-' || doc_id AS id, 'quality' AS key, CAST(quality AS DOUBLE) AS score_number FROM labels JOIN documents USING (doc_id) WHERE source IN ('src1', 'src2') AND quality >= 1 ORDER BY doc_id LIMIT 100")
def feedback_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.listing(fixtures.feedback_rows(spark, sf_dir), projects=["src1", "src2"], keys=["quality"], score_min=1.0).select("id", "key", "score_number")


@query(f"WITH {_EH} SELECT project_name, trace_id, span_id, status FROM hd WHERE run_type <> 'tool'")
def runs_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fixtures.run_events(spark, sf_dir)
    gone = lifecycle.deleted(heads.latest(events), F.col("run_type") == "tool", 1)
    return heads.latest(events, gone).select(*KEY, "status")


@query(f"WITH {_EH} SELECT project_name, trace_id, span_id FROM hd WHERE NOT (project_name = 'proj-1' AND start < 1720000000000000000)")
def runs_after_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fixtures.run_events(spark, sf_dir)
    policies = spark.sql("SELECT 'proj-1' AS project_name, 5000000000000000L AS ttl_nanos")
    gone = lifecycle.expired(heads.latest(events), policies, 1_725_000_000_000_000_000)
    return heads.latest(events, gone).select(*KEY)


@query(f"WITH {_EH} SELECT project_name, trace_id, span_id, run_type, status, event_time, latency FROM hd")
def compaction_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heads.latest(lifecycle.compacted(heads.typed(fixtures.run_events(spark, sf_dir)))).selectExpr(*_HEAD)


@query(f"WITH {_EV} SELECT project_name, trace_id, span_id, row_index, CASE WHEN stop > 0 THEN stop ELSE start END AS event_time, row_number() OVER (PARTITION BY project_name, trace_id, span_id ORDER BY CASE WHEN stop > 0 THEN stop ELSE start END, row_index) - 1 AS sequence FROM ev")
def run_events_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heads.lineage(fixtures.run_events(spark, sf_dir)).select(*KEY, "row_index", F.col("event_time_unix_nano").alias("event_time"), F.col("sequence").cast("long").alias("sequence"))


@query(f"WITH {_EH} SELECT project_name, trace_id, span_id, status FROM hd WHERE span_id <> 's3'")
def run_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = heads.typed(fixtures.run_events(spark, sf_dir))
    stones = lifecycle.tombstones(lifecycle.deleted(heads.latest(events), F.col("span_id") == "s3", 9_000_000_000_000_000_000))
    return heads.replay(events.select(*[c for c in stones.columns if c in events.columns]).unionByName(stones.select(*[c for c in stones.columns if c in events.columns]))).select(*KEY, "status")


@query(f"WITH {_EH} SELECT project_name, trace_id, span_id, run_type, status, event_time, latency FROM hd")
def stream_heads_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table read as a stream into the log, and heads from the log."""
    from quillspan.streaming import ingest

    root = scratch.folder(spark, "stream")
    batch = heads.typed(fixtures.run_events(spark, sf_dir)).withColumn("idempotency_key", F.concat(F.lit("event-"), F.col("row_index")))
    cols = [c for c in ingest.EVENT_COLUMNS]
    batch.select(*cols).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{root}/in").schema).option("maxFilesPerTrigger", 4).parquet(f"{root}/in")
    ingest.start(stream, root, f"{root}/checkpoint").awaitTermination()
    return heads.latest(spark.read.parquet(f"{root}/log")).selectExpr(*_HEAD)


@query(f"WITH {_EV} SELECT project_name, start - start % {HOUR} AS time_bucket, count(*) AS rows FROM ev GROUP BY ALL")
def segment_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as segments, and the rows of each segment's files."""
    where = scratch.folder(spark, "segments")
    store.write_events(heads.typed(fixtures.run_events(spark, sf_dir)), where)
    return store.segments(spark, where).groupBy("project_name", "time_bucket").agg(F.sum("rows").alias("rows"))


@query(f"WITH {_EH} SELECT project_name, trace_id, span_id, run_type, status, event_time, latency FROM hd WHERE project_name = 'proj-2'")
def segment_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of one project from written segments: other projects' folders aren't read."""
    where = scratch.folder(spark, "segments")
    store.write_events(heads.typed(fixtures.run_events(spark, sf_dir)), where)
    return heads.latest(store.read_events(spark, where).where("project_name = 'proj-2'")).selectExpr(*_HEAD)


@query("SELECT event_id AS row_index, 'lang=' || event_type || ',thread_id=t' || (user_id % 10) AS pairs, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 11 / 10.0 END AS evaluator_score, CASE WHEN event_id % 2 = 0 THEN event_id % 1000 END AS first_token_latency_nanos FROM events")
def events_extracted_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata pairs, evaluator scores and first-token latencies out of payloads."""
    from quillspan.functions import extract

    body = """concat('{"metadata":{"lang":"', event_type, '","thread_id":"t', user_id % 10, '"},"metrics":{', CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('"evaluator_score":', cast(event_id % 11 / 10.0D AS string), ',') END,
      CASE WHEN event_id % 2 = 0 THEN concat('"first_token_latency_nanos":', event_id % 1000, ',') ELSE '' END, '"n":1}}') AS attributes_json"""
    events = fixtures.run_events(spark, sf_dir).select("row_index", "start_time_unix_nano")
    got = extract.extracted(events.join(fixtures.table(spark, sf_dir, "events").selectExpr("event_id AS row_index", body), "row_index"))
    return got.select("row_index", F.array_join(F.array_sort(F.transform("metadata", lambda m: F.concat(m["key"], F.lit("="), m["value"]))), ",").alias("pairs"), "evaluator_score", "first_token_latency_nanos")


# Sources, extraction, lookups ---------------------------------------------------------


@query("""SELECT printf('%032x', user_id + 1) AS trace_id, printf('%016x', event_id + 1) AS span_id, CASE WHEN event_type = 'error' OR event_type <> 'view' THEN 'end' ELSE 'start' END AS event_type,
  CASE event_id % 3 WHEN 0 THEN 'llm' WHEN 1 THEN 'tool' ELSE 'span' END AS run_type, CASE event_type WHEN 'error' THEN 2 ELSE 0 END AS status_code, user_id % 5 AS tenant, value AS score, event_id = 0 AS rejected FROM events""")
def otlp_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events dressed as exports, and flattened again."""
    from quillspan.sources import otlp

    text_value = "cast(named_struct('stringValue', {s}, 'boolValue', NULL, 'intValue', {i}, 'doubleValue', {d}, 'bytesValue', NULL, 'arrayValue', NULL, 'kvlistValue', NULL) AS {t})"
    value = lambda s="NULL", i="NULL", d="NULL": text_value.format(s=s, i=i, d=d, t=otlp._VALUE)
    kind = "CASE event_id % 3 WHEN 0 THEN 'chat' WHEN 1 THEN 'execute_tool' ELSE 'other' END"
    spans = f"""array(named_struct('traceId', unhex(lpad(hex(user_id + 1), 32, '0')), 'spanId', CASE WHEN event_id = 0 THEN unhex('00') ELSE unhex(lpad(hex(event_id + 1), 16, '0')) END, 'parentSpanId', cast(NULL AS binary), 'name', 'step',
      'startTimeUnixNano', event_id, 'endTimeUnixNano', CASE WHEN event_type = 'view' OR event_type = 'error' THEN 0L ELSE event_id + 5 END,
      'attributes', array(named_struct('key', 'gen_ai.operation.name', 'value', {value(s=kind)}), named_struct('key', 'score', 'value', {value(d="value")})), 'status', named_struct('code', CASE WHEN event_type = 'error' THEN 2 ELSE 0 END)))"""
    resource = f"named_struct('attributes', array(named_struct('key', 'tenant', 'value', {value(i='user_id % 5')})))"
    exports = fixtures.table(spark, sf_dir, "events").selectExpr("'p' AS project_name", "event_id", f"array(named_struct('resource', {resource}, 'scopeSpans', array(named_struct('spans', {spans})))) AS resourceSpans")
    flat = otlp.flatten(exports.drop("event_id"))
    return flat.select("trace_id", F.when(F.col("rejected"), F.lpad(F.lit("1"), 16, "0")).otherwise(F.col("span_id")).alias("span_id"), "event_type", "run_type", "status_code", F.get_json_object("attributes_json", "$['resource.tenant']").cast("long").alias("tenant"), F.get_json_object("attributes_json", "$.score").cast("double").alias("score"), "rejected")


@query("""SELECT 'c' || conv_id AS trace_id, turn AS row_index, CASE WHEN role = 'assistant' THEN 'end' WHEN row_number() OVER w > 1 THEN 'update' ELSE 'start' END AS event_type,
  CASE WHEN bool_or(role = 'assistant') OVER w THEN 1 ELSE 0 END AS status_code, coalesce(max(CASE WHEN role = 'assistant' THEN turn END) OVER w, 0) AS end_time FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def patches_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspan.sources import writes

    empty = ", ".join(f"cast(NULL AS string) AS {c}" for c in ("parent_run_id", "parent_span_id", "extra", "events", "tags", "error"))
    patches = fixtures.table(spark, sf_dir, "conversations").selectExpr(
        "'chat' AS project_name", "concat('c', conv_id) AS trace_id", "'s' AS span_id", "'' AS run_id", "'conversation' AS name", "'chain' AS run_type", "conv_id AS start_time_unix_nano",
        "CASE WHEN role = 'assistant' THEN turn END AS end_time_unix_nano", "CASE WHEN role = 'user' THEN to_json(named_struct('q', text)) END AS inputs", "CASE WHEN role = 'assistant' THEN to_json(named_struct('a', text)) END AS outputs", "turn AS sequence", *empty.split(", "),
    )
    return writes.fold(patches).select("trace_id", "row_index", "event_type", "status_code", F.col("end_time_unix_nano").alias("end_time"))


@query("""SELECT event_id, event_id % 50 AS prompt_tokens, event_id % 7 AS completion_tokens, event_id % 50 + event_id % 7 AS total_tokens, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 9 / 4.0 END AS total_cost,
  'gpt-' || (user_id % 3) AS model_name, 'openai' AS provider_name, array_to_string(list_sort(list_distinct([event_type, 'x'])), ',') AS tags, 't' || (user_id % 10) AS thread_id, 'ask ' || event_id AS inputs_preview FROM events""")
def events_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads made from the event table, and every measure read back from them."""
    from quillspan.functions import extract

    body = """concat('{"usage":{"input_tokens":', event_id % 50, ',"output_tokens":"', event_id % 7, '"},"total_cost":', CASE WHEN event_id % 4 = 0 THEN '-1' ELSE cast(event_id % 9 / 4.0D AS string) END, ',"model":" GPT-', user_id % 3,
      ' ","gen_ai.system":"Open-AI","tags":["x","', event_type, '"],"metadata":{"thread_id":"t', user_id % 10, '"},"langsmith.inputs":{"prompt":"ask ', event_id, '"}}') AS attributes_json"""
    events = fixtures.run_events(spark, sf_dir).select("row_index", "start_time_unix_nano")
    payload = fixtures.table(spark, sf_dir, "events").selectExpr("event_id AS row_index", body)
    got = extract.extracted(events.join(payload, "row_index"))
    return got.select(F.col("row_index").alias("event_id"), "prompt_tokens", "completion_tokens", "total_tokens", "total_cost", "model_name", "provider_name", F.array_join("tags", ",").alias("tags"), "thread_id", "inputs_preview")


@query(f"""WITH {_EH}, h AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('quillspan:run:' || project_name || ':' || trace_id || ':' || span_id)) AS h FROM hd)
  SELECT trace_id, span_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || (['8','9','a','b'])[CAST('0x' || h[17] AS INT) % 4 + 1] || h[18:20] || '-' || h[21:32] AS generated_run_id FROM h""")
def run_ids_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_heads(spark, sf_dir).select("trace_id", "span_id", "generated_run_id")


_HASH = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('quillspan:run:' || $.project_name || ':' || $.trace_id || ':' || $.span_id))"
_ID = f"{_HASH}[1:8] || '-' || {_HASH}[9:12] || '-5' || {_HASH}[14:16] || '-' || (['8','9','a','b'])[CAST('0x' || {_HASH}[17] AS INT) % 4 + 1] || {_HASH}[18:20] || '-' || {_HASH}[21:32]"


@query("SELECT DISTINCT source AS project_name FROM documents ORDER BY 1 LIMIT 100")
def project_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_heads(spark, sf_dir).select("project_name").distinct().orderBy("project_name").limit(100)


@query("SELECT 'doc-' || doc_id AS run_id, CASE doc_id WHEN 9 THEN 0 WHEN 3 THEN 1 ELSE 2 END AS asked FROM documents WHERE doc_id IN (9, 3, 7)")
def runs_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.load_runs(doc_heads(spark, sf_dir), ["doc-9", "doc-3", "doc-7"]).select("run_id", "asked")


@query(f"WITH {_EH} SELECT h.trace_id, h.span_id, coalesce((SELECT string_agg({_ID.replace("$", "c")}, ',' ORDER BY c.start, c.span_id) FROM hd c WHERE c.project_name = h.project_name AND c.trace_id = h.trace_id AND c.parent_span_id = h.span_id), '') AS children FROM hd h")
def run_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.children(event_heads(spark, sf_dir)).select("trace_id", "span_id", F.array_join("child_run_ids", ",").alias("children"))


@query(f"WITH {_EH} SELECT trace_id, span_id, status, lpad(CAST(start AS VARCHAR), 20, '0') || '.' || span_id AS dotted_order, strftime(make_timestamp(start // 1000), '%Y-%m-%dT%H:%M:%S.%f') || lpad(CAST(start % 1000 AS VARCHAR), 3, '0') || 'Z' AS start_time, stop = 0 AS running FROM hd")
def runs_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.response(event_heads(spark, sf_dir)).select("trace_id", "span_id", "status", "dotted_order", "start_time", F.col("end_time").isNull().alias("running"))


@query("""WITH f AS (SELECT lang, quality AS s FROM documents LEFT JOIN labels USING (doc_id)) SELECT 'lang:' || lang AS tag, count(*) AS count, count(s) AS scores, round(avg(s), 6) AS score_avg FROM f GROUP BY ALL""")
def agg_feedback_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores beside the runs' own metrics; runs aren't counted again."""
    rows = aggregates.aggregate(doc_heads(spark, sf_dir), ("tag",), feedback=fixtures.feedback_rows(spark, sf_dir), feedback_keys=["quality"])
    return rows.select("tag", "count", F.coalesce(F.col("feedback")["quality"]["feedback_score_count"], F.lit(0)).alias("scores"), F.round(F.col("feedback")["quality"]["feedback_score_avg"], 6).alias("score_avg"))


@query("SELECT 0 AS differences")
def rollup_equals_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in which a rollup and a scan of the heads disagree on the fields that both have."""
    h = metric_heads(spark, sf_dir)
    q = runs.RunQuery(_FLAGS, group_by=("project", "time_bucket", "model"))
    shared = ["project_name", "bucket", "model_name", "count", "error_count", "latency_p99"]
    rolled = runs.aggregate_runs(h, q, rollup=rollups.runs(h))[0].selectExpr("project_name", "cast(bucket_start_unix_nano AS string) AS bucket", "group_value AS model_name", "count", "error_count", "cast(latency_p99 AS double) AS latency_p99")
    scanned = runs.aggregate_runs(h, q)[0].selectExpr("project_name", "time_bucket_start_unix_nano AS bucket", "model_name", "count", "error_count", "latency_nanos_p99 AS latency_p99")
    both = rolled.select(*shared, F.lit(1).alias("side")).unionByName(scanned.select(*shared, F.lit(-1).alias("side")))
    return both.groupBy(*shared).agg(F.sum("side").alias("side")).where("side <> 0").agg(F.count(F.lit(1)).cast("int").alias("differences"))


@query("SELECT 'inputs.prompt' AS path, count(text) AS runs FROM documents UNION ALL SELECT 'metadata.lang', count(lang) FROM documents UNION ALL SELECT 'metadata.source', count(source) FROM documents UNION ALL SELECT unnest(['run.name', 'run.run_type', 'run.status']), count(*) FROM documents")
def json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.leaves(doc_heads(spark, sf_dir)).groupBy("path").agg(F.count("value").alias("runs"))


@query(f"WITH {_TT} SELECT thread_id, trace_id FROM tt WHERE thread_id = 'thread-7' AND (start, trace_id) > (25202000000000, 'c7-0') ORDER BY start, trace_id LIMIT 20")
def thread_traces_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = threads.traces(_chat(spark, sf_dir)).where("thread_id = 'thread-7'")
    return runs.selected(runs.trace_page(rows, cursor="trace:25202000000000:c7-0"), ["THREAD_ID", "trace_id"])


@query(f"WITH {_CH} SELECT trace_id, span_id, CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END AS role FROM ch WHERE thread_id = 'thread-3' AND coalesce(inp, outp) IS NOT NULL ORDER BY start, trace_id, span_id LIMIT 100")
def messages_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.message_page(threads.messages(_chat(spark, sf_dir)).where("thread_id = 'thread-3'")).select("trace_id", "span_id", "role")


@query("SELECT 'fb-' || doc_id AS id, CAST(toxic AS DOUBLE) AS score_number, doc_id AS created_at_unix_nano FROM labels")
def feedback_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label written as a score, then replaced by another: the last version, created when the first was."""
    labels = fixtures.table(spark, sf_dir, "labels")
    version = lambda score, created, modified: labels.selectExpr("concat('fb-', doc_id) AS id", f"cast({score} AS string) AS score", "cast(NULL AS string) AS value", f"{created} AS created_at_unix_nano", f"{modified} AS modified_at_unix_nano")
    log = version("quality", "doc_id", "doc_id").unionByName(version("concat(chr(34), toxic, chr(34))", "doc_id + 10", "doc_id + 10"))
    return feedback.scored(feedback.current(log)).select("id", "score_number", "created_at_unix_nano")


@query(f"WITH {_EV}, s AS (SELECT project_name, start - start % {HOUR} AS time_bucket, 'f' || (row_index % 5) AS path FROM ev) SELECT project_name, time_bucket, count(DISTINCT path) AS files FROM s GROUP BY ALL HAVING count(DISTINCT path) > 1")
def compactable_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fixtures.run_events(spark, sf_dir)
    return lifecycle.compactable(e.select("project_name", scalars.bucket(F.col("start_time_unix_nano")).alias("time_bucket"), F.concat(F.lit("f"), F.pmod("row_index", F.lit(5))).alias("path")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest heads, filtered by an expression, by project, hour and run type with exact percentiles."""
    q = runs.RunQuery(_PROJECTS, filter='or(eq(run_type, "llm"), gt(latency, 0))', group_by=("project", "time_bucket", "run_type"))
    rows, _ = runs.aggregate_runs(event_heads(spark, sf_dir), q)
    return rows.selectExpr("project_name", "time_bucket_start_unix_nano", "run_type", *_SHOWN)


QUERIES["flagship"] = flagship
ORACLE_SQL["flagship"] = f"WITH {_EH} SELECT project_name, {_BUCKET}, run_type, {_STATS} FROM hd WHERE run_type = 'llm' OR latency > 0 GROUP BY ALL"
