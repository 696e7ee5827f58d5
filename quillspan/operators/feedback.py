"""Feedback: a mutable table kept as a log."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.scalars import PREFIX


def feedback_id(run_id: str, key: str, created: int) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"{PREFIX}:feedback:{run_id}:{key}:{created}"))


def scored(rows: DataFrame) -> DataFrame:
    """With ``score_number`` (a number or numeric text) and ``value_text`` (scalars only), from JSON."""

    def plain(c):
        text = F.get_json_object(F.concat(F.lit('{"x":'), F.col(c), F.lit("}")), "$.x")
        return F.when(~F.trim(F.col(c)).rlike(r"^[\[{]"), text)

    number = plain("score").try_cast("double")
    return rows.withColumns({"score_number": F.when(~F.isnan(number) & (F.abs(number) < float("inf")) & ~plain("score").isin("true", "false"), number), "value_text": plain("value")})


def current(log: DataFrame) -> DataFrame:
    """The last version of each id; it keeps the first version's creation time. Of versions of one time the larger ``row_index``, score and value count."""
    by_id = Window.partitionBy("id")
    out = log.withColumn("created_at_unix_nano", F.min("created_at_unix_nano").over(by_id))
    last = Window.partitionBy("id").orderBy(F.desc("modified_at_unix_nano"), *[F.desc_nulls_last(c) for c in ("row_index", "score", "value", "comment") if c in log.columns])
    return out.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def listing(
    rows: DataFrame, run_ids: Sequence[str] | None = None, trace_ids: Sequence[str] | None = None, projects: Sequence[str] | None = None, keys: Sequence[str] | None = None, values: Sequence[str] | None = None,
    score: float | None = None, score_min: float | None = None, score_max: float | None = None, created_min: int | None = None, created_max: int | None = None, limit: int = 100, offset: int = 0,
) -> DataFrame:
    """Feedback by lists and ranges, in order of creation."""
    out = rows
    for column, wanted in (("run_id", run_ids), ("trace_id", trace_ids), ("project_name", projects), ("key", keys), ("value_text", values)):
        if wanted is not None:
            out = out.where(F.col(column).isin(*wanted))
    for test in ((F.col("score_number") == score) if score is not None else None, (F.col("score_number") >= score_min) if score_min is not None else None, (F.col("score_number") <= score_max) if score_max is not None else None, (F.col("created_at_unix_nano") >= created_min) if created_min is not None else None, (F.col("created_at_unix_nano") <= created_max) if created_max is not None else None):
        if test is not None:
            out = out.where(test)
    return out.orderBy("created_at_unix_nano", "id").offset(max(0, offset)).limit(max(0, min(limit, 1000)))
