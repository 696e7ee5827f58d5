"""Hourly rollups, and answering aggregates from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions import scalars
from quillspan.operators import aggregates
from quillspan.schemas import HOUR

_SETS = {frozenset({"project", "time_bucket"}): "project", frozenset({"project", "time_bucket", "run_type"}): "run_type", frozenset({"project", "time_bucket", "model"}): "model", frozenset({"project", "time_bucket", "error"}): "error", frozenset({"project", "time_bucket", "feedback_key"}): "feedback"}


def runs(heads: DataFrame, width: int = HOUR) -> DataFrame:
    """One row for each project, hour, kind and value, all kinds in a single pass: the heads are read and shuffled once."""
    values = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), value.alias("value"))
            for kind, value in (("project", F.lit("")), ("run_type", F.col("run_type")), ("model", F.coalesce("model_name", F.lit("unknown"))), ("error", (F.col("status") == "error").cast("string")))
        ]
    )
    each = heads.withColumn("_k", F.explode(values)).withColumns({"rollup_kind": F.col("_k.kind"), "group_value": F.col("_k.value"), "bucket_start_unix_nano": scalars.bucket(F.col("start_time_unix_nano"), width)})
    ranked = F.array_sort(F.collect_list("latency_nanos"))
    return each.groupBy("project_name", "bucket_start_unix_nano", "rollup_kind", "group_value").agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(F.col("status") == "error").alias("error_count"),
        F.min("latency_nanos").alias("latency_min"),
        F.max("latency_nanos").alias("latency_max"),
        F.avg("latency_nanos").alias("latency_avg"),
        *[scalars.nearest_rank(ranked, p).alias(f"latency_p{p}") for p in (50, 95, 99)],
        *[f(c).alias(f"{c}_{n}") for c in aggregates.VALUES[:6] for f, n in ((F.sum, "sum"), (F.avg, "avg"))],
        F.avg("evaluator_score").alias("evaluator_score_avg"),
    )


def feedback(rows: DataFrame, width: int = HOUR) -> DataFrame:
    """Feedback by hour of its own creation and key; rows without a numeric score count as missing."""
    s = F.col("score_number")
    ranked = F.array_sort(F.collect_list(s))
    return rows.groupBy("project_name", scalars.bucket(F.col("created_at_unix_nano"), width).alias("bucket_start_unix_nano"), "key").agg(
        F.count(F.lit(1)).alias("feedback_count"),
        F.count(s).alias("score_count"),
        F.min(s).alias("score_min"),
        F.max(s).alias("score_max"),
        F.avg(s).alias("score_avg"),
        *[scalars.nearest_rank(ranked, p).alias(f"score_p{p}") for p in (50, 95, 99)],
        *aggregates.bin_counts(s),
        F.count_if(s.isNull()).alias("score_missing"),
    )


def eligible(groups: Sequence[str], bucket: int | None, run_type: str | None = None, error: bool | None = None, start_min: int | None = None, start_max: int | None = None, filtered: bool = False, include_deleted: bool = False) -> str | None:
    """The kind of rollup that answers a query exactly, if one does: whole hours, and no filter that the rollup's key doesn't hold."""
    kind = _SETS.get(frozenset(groups))
    if kind is None or filtered or include_deleted or bucket != HOUR:
        return None
    if (run_type is not None and kind != "run_type") or (error is not None and kind != "error"):
        return None
    whole = (start_min is None or start_min % HOUR == 0) and (start_max is None or (start_max + 1) % HOUR == 0)
    return kind if whole else None


def answer(rollup: DataFrame, kind: str, projects: Sequence[str], run_type: str | None = None, error: bool | None = None, start_min: int | None = None, start_max: int | None = None) -> DataFrame:
    """Rows of the rollup for an eligible query."""
    out = rollup.where(F.col("project_name").isin(*projects))
    if kind != "feedback":
        out = out.where(F.col("rollup_kind") == kind)
    if run_type is not None:
        out = out.where(F.col("group_value") == run_type)
    if error is not None:
        out = out.where(F.col("group_value") == str(error).lower())
    if start_min is not None:
        out = out.where(F.col("bucket_start_unix_nano") >= start_min)
    if start_max is not None:
        out = out.where(F.col("bucket_start_unix_nano") <= start_max)
    if kind == "feedback":
        return out.orderBy("project_name", "bucket_start_unix_nano", "key")
    return out.withColumn("error_rate", F.col("error_count") / F.col("count")).orderBy("project_name", "bucket_start_unix_nano", "group_value")
