"""Trace-shaped views of the star-schema test tables, for queries and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _micros(c: str) -> str:
    return f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c})"


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans by user and eight slots; several events a span, so that versions matter."""
    return table(spark, sf_dir, "events").selectExpr(
        "concat('proj-', user_id % 3) AS project_name",
        "concat('t', user_id) AS trace_id",
        "concat('s', event_id % 8) AS span_id",
        "'' AS run_id",
        "CASE WHEN event_id % 8 <> 0 THEN concat('s', (event_id % 8 - 1) div 2) END AS parent_span_id",
        "event_type AS name",
        "element_at(array('chain', 'llm', 'tool', 'retriever'), cast(event_id % 4 + 1 AS int)) AS run_type",
        f"{_micros('ts')} * 1000 AS start_time_unix_nano",
        f"CASE WHEN event_type = 'view' THEN 0L ELSE {_micros('ts')} * 1000 + cast(round(value * 1e6) AS bigint) END AS end_time_unix_nano",
        "CASE event_type WHEN 'error' THEN 2 WHEN 'view' THEN 0 ELSE 1 END AS status_code",
        "event_id AS row_index",
    )


def metric_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as runs with tokens, costs and models."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('flag-', l_returnflag) AS project_name",
        "concat('o', l_orderkey) AS trace_id",
        "concat('l', l_linenumber) AS span_id",
        "'' AS run_id",
        "cast(NULL AS string) AS parent_span_id",
        "concat('item-', l_linenumber) AS name",
        "CASE WHEN l_linestatus = 'O' THEN 'llm' ELSE 'tool' END AS run_type",
        f"{_micros('l_shipdate')} * 1000 AS start_time_unix_nano",
        f"{_micros('l_shipdate')} * 1000 + cast(l_quantity * 1e6 AS bigint) AS end_time_unix_nano",
        "CASE WHEN l_discount > 0.09 THEN 2 ELSE 1 END AS status_code",
        "cast(l_quantity AS bigint) AS prompt_tokens",
        "l_extendedprice AS total_cost",
        "concat('model-', l_partkey % 3) AS model_name",
        "l_partkey * 1000 + l_suppkey AS row_index",
    )


def tree_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a root, its lines a binary tree below it; missing lines leave orphans. Traces are brought together once, for all that comes after."""
    orders = table(spark, sf_dir, "orders").selectExpr(
        "concat('o', o_orderkey) AS trace_id", "'l0' AS span_id", "cast(NULL AS string) AS parent_span_id", "'chain' AS run_type", "concat('order-', o_orderstatus) AS name", f"{_micros('o_orderdate')} * 1000 AS ordered", "cast(NULL AS string) AS flag", "cast(NULL AS bigint) AS shipped"
    )
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "concat('o', l_orderkey) AS trace_id", "concat('l', l_linenumber) AS span_id", "concat('l', (l_linenumber - 1) div 2) AS parent_span_id", "'tool' AS run_type", "cast(NULL AS string) AS name", "cast(NULL AS bigint) AS ordered", "l_returnflag AS flag", f"{_micros('l_shipdate')} * 1000 AS shipped"
    )
    # Lines are grouped by order and number; orders, which have no flag and no shipping, by all that they have, so that each stays as it is.
    runs = orders.unionByName(lines).repartition("trace_id").groupBy("trace_id", "span_id", "parent_span_id", "run_type", "name", "ordered").agg(F.min("flag").alias("flag"), F.min("shipped").alias("shipped"))
    runs = runs.selectExpr("trace_id", "span_id", "parent_span_id", "coalesce(name, concat('line-', flag)) AS name", "run_type", "coalesce(ordered, shipped) AS start_time_unix_nano", "1 AS status_code", "0L AS row_index")
    return runs.withColumns({"project_name": F.lit("orders"), "run_id": F.lit(""), "end_time_unix_nano": F.col("start_time_unix_nano") + 1})


def chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations: each pair of turns a trace, each conversation a thread."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "'chat' AS project_name",
        "concat('c', conv_id, '-', turn div 2) AS trace_id",
        "concat('m', turn) AS span_id",
        "'' AS run_id",
        "cast(NULL AS string) AS parent_span_id",
        "role AS name",
        "'llm' AS run_type",
        "conv_id * 3600000000000 + turn * 1000000000 AS start_time_unix_nano",
        "conv_id * 3600000000000 + turn * 1000000000 + 500000000 AS end_time_unix_nano",
        "1 AS status_code",
        "turn AS row_index",
        "concat('thread-', conv_id) AS thread_id",
        "CASE WHEN role <> 'assistant' THEN text END AS inputs_preview",
        "CASE WHEN role = 'assistant' THEN text END AS outputs_preview",
    )


def doc_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as runs with their text in the payload, for search."""
    payload = F.to_json(F.struct(F.struct(F.col("text").alias("prompt")).alias("inputs"), F.struct("lang", "source").alias("metadata")))
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("project_name"), F.concat(F.lit("d"), "doc_id").alias("trace_id"), F.lit("s").alias("span_id"), F.concat(F.lit("doc-"), "doc_id").alias("run_id"), F.lit(None).cast("string").alias("parent_span_id"), F.concat(F.lit("doc "), "lang").alias("name"), F.lit("prompt").alias("run_type"),
        (F.col("doc_id") * 1_000_000_000).alias("start_time_unix_nano"), (F.col("doc_id") * 1_000_000_000 + F.col("n_chars")).alias("end_time_unix_nano"), F.lit(1).alias("status_code"), F.col("doc_id").alias("row_index"), payload.alias("attributes_json"),
        F.array(F.concat(F.lit("lang:"), "lang")).alias("tags"), F.array(F.struct(F.lit("lang").alias("key"), F.col("lang").alias("value")), F.struct(F.lit("source").alias("key"), F.col("source").alias("value"))).alias("metadata"),
    )


def feedback_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as two feedback rows each."""
    labels = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    both = F.explode(F.array(F.struct(F.lit("quality").alias("key"), F.col("quality").alias("score")), F.struct(F.lit("toxic").alias("key"), F.col("toxic").alias("score")))).alias("f")
    return labels.select("doc_id", "source", both).selectExpr("concat('fb-', f.key, '-', doc_id) AS id", "concat('doc-', doc_id) AS run_id", "concat('d', doc_id) AS trace_id", "source AS project_name", "f.key AS key", "cast(f.score AS double) AS score_number", "cast(NULL AS string) AS value_text", "doc_id * 1000000000 AS created_at_unix_nano")
