"""Conversation threads: traces, summaries and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions import scalars

SUMS = ("prompt_tokens", "completion_tokens", "total_tokens", "prompt_cost", "completion_cost", "total_cost")


def _first(value: str, *order: str) -> Column:
    """Value of the first row that has one."""
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.struct(*order)))


def _last(value: str, *order: str) -> Column:
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order)))


def traces(heads: DataFrame) -> DataFrame:
    """One row for each thread and trace; runs without a thread are left out."""
    at = ("start_time_unix_nano", "span_id")
    runs = heads.where(F.col("thread_id").isNotNull())
    root = F.min_by(F.struct(F.coalesce("run_id", "generated_run_id").alias("id"), "span_id", "name"), F.struct(~F.col("is_root"), *at))
    out = runs.groupBy("project_name", "thread_id", "trace_id").agg(
        root.alias("root"),
        F.min("start_time_unix_nano").alias("start_time_unix_nano"),
        F.max("end_time_unix_nano").alias("end_time_unix_nano"),
        F.min("first_token_time_unix_nano").alias("first_token_time_unix_nano"),
        _first("inputs_preview", *at).alias("inputs_preview"),
        _last("outputs_preview", *at).alias("outputs_preview"),
        _last("error_preview", *at).alias("error_preview"),
        *[F.sum(c).alias(c) for c in SUMS],
    )
    latency = scalars.latency(F.col("start_time_unix_nano"), F.col("end_time_unix_nano")).alias("latency_nanos")
    return out.select("project_name", "thread_id", "trace_id", F.col("root.id").alias("root_run_id"), F.col("root.span_id").alias("root_span_id"), F.col("root.name").alias("name"), "start_time_unix_nano", "end_time_unix_nano", latency, "first_token_time_unix_nano", "inputs_preview", "outputs_preview", "error_preview", *SUMS)


def summaries(thread_traces: DataFrame) -> DataFrame:
    """One row for each thread. A turn counts as failed if it has an error preview."""
    at = ("start_time_unix_nano", "trace_id")
    latency = F.array_sort(F.collect_list(F.greatest("latency_nanos", F.lit(0))))
    return (
        thread_traces.groupBy("project_name", "thread_id")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.min_by("trace_id", F.struct(*at)).alias("first_trace_id"),
            F.max_by("trace_id", F.struct(*at)).alias("last_trace_id"),
            F.min("start_time_unix_nano").alias("min_start_time_unix_nano"),
            F.max("start_time_unix_nano").alias("max_start_time_unix_nano"),
            _first("inputs_preview", *at).alias("first_inputs"),
            _last("outputs_preview", *at).alias("last_outputs"),
            _last("error_preview", *at).alias("last_error"),
            *[F.sum(c).alias(c) for c in SUMS],
            latency.alias("_latency"),
            F.count("error_preview").alias("num_errored_turns"),
        )
        .withColumns({f"latency_p{p}": scalars.nearest_rank(F.col("_latency"), p) / F.lit(1e9) for p in (50, 99)})
        .drop("_latency")
    )


def messages(heads: DataFrame) -> DataFrame:
    """A user row for each input preview and an assistant row for each output preview."""
    each = F.explode(F.array(F.struct(F.lit("user").alias("role"), F.col("inputs_preview").alias("preview")), F.struct(F.lit("assistant").alias("role"), F.col("outputs_preview").alias("preview")))).alias("m")
    rows = heads.where(F.col("thread_id").isNotNull()).select("project_name", "thread_id", "trace_id", "span_id", F.coalesce("run_id", "generated_run_id").alias("run_id"), "start_time_unix_nano", each)
    return rows.where("m.preview IS NOT NULL").select("project_name", "thread_id", "trace_id", "span_id", "run_id", F.col("m.role").alias("role"), F.col("m.preview").alias("preview"), F.col("start_time_unix_nano").alias("turn_order"), "start_time_unix_nano")


def message_page(rows: DataFrame, limit: int = 100) -> DataFrame:
    return rows.orderBy("turn_order", "trace_id", "span_id", F.when(F.col("role") == "user", 0).otherwise(1), "role").limit(max(0, min(limit, 1000)))
