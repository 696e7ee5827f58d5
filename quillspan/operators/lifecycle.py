"""Deletes, retention, compaction and cleanup. State is tables; a mutation appends to one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators import heads as heads_
from quillspan.schemas import EVENT_COLUMNS, RUN_KEY


def deleted(heads: DataFrame, which, at: int, reason: str = "user_request") -> DataFrame:
    """Deletions for the runs that satisfy ``which``: rows to append to the deletions table."""
    return heads.where(which).select(*RUN_KEY, F.lit(at).cast("long").alias("deleted_at_unix_nano"), F.lit(reason).alias("reason"))


def tombstones(deletions: DataFrame) -> DataFrame:
    """Events for the log that say what the deletions say."""
    made = {"event_type": F.lit("tombstone"), "start_time_unix_nano": F.col("deleted_at_unix_nano"), "end_time_unix_nano": F.col("deleted_at_unix_nano"), "status_code": F.lit(0), "attributes_json": F.lit("{}"), "name": F.lit(""), "run_type": F.lit(""), "run_id": F.lit(""), "row_index": F.lit(0).cast("long")}
    rest = {c: F.lit(None).cast("string") for c in ("parent_run_id", "parent_span_id", "idempotency_key")}
    return deletions.withColumns(made | rest).select(*EVENT_COLUMNS)


def expired(heads: DataFrame, policies: DataFrame, now: int) -> DataFrame:
    """Deletions that the projects' times to live call for."""
    old = heads.join(policies, "project_name").where(F.col("start_time_unix_nano") < F.lit(now) - F.col("ttl_nanos"))
    return deleted(old, F.lit(True), now, "retention_expired")


def within_retention(heads: DataFrame, cutoff: int | None) -> DataFrame:
    return heads if cutoff is None else heads.where(F.col("start_time_unix_nano") >= cutoff)


def compacted(events: DataFrame, deletions: DataFrame | None = None) -> DataFrame:
    """One ``compact`` event for each live run, with everything its last event had; deleted runs are gone for good."""
    last = heads_.versioned(heads_.typed(events)).where(F.col("event_type") != "tombstone")
    if deletions is not None:
        last = last.join(deletions.select(*RUN_KEY).distinct(), RUN_KEY, "left_anti")
    return last.withColumn("event_type", F.lit("compact")).select(*events.columns)


def compactable(segments: DataFrame, least: int = 2) -> DataFrame:
    """Projects and hours with several files, from ``project_name, time_bucket, path``."""
    return segments.groupBy("project_name", "time_bucket").agg(F.count_distinct("path").alias("files")).where(F.col("files") >= least)


def orphans(stored: DataFrame, referenced: DataFrame) -> DataFrame:
    """Stored paths that no manifest refers to."""
    return stored.join(referenced.select("path"), "path", "left_anti")


def removable(segments: DataFrame, now: int, grace: int, referenced: DataFrame | None = None) -> DataFrame:
    """Compacted segments (``path, compacted_at_unix_nano``) past their grace period, less those still referred to. Dry by nature: what is removed is the caller's act."""
    old = segments.where(F.col("compacted_at_unix_nano").isNotNull() & (F.col("compacted_at_unix_nano") <= now - grace))
    return old if referenced is None else orphans(old, referenced)
