"""From the event log to the latest version of each run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import scalars
from quillspan.schemas import METRICS, RUN_KEY


def typed(events: DataFrame) -> DataFrame:
    """Events with every column that heads need: those of the payload are null where nobody extracted them."""
    missing = {c: F.lit(None).cast(t) for c, t in METRICS.items() if c not in events.columns}
    lists = {"tags": "array<string>", "metadata": "array<struct<key:string,value:string>>"}
    missing |= {c: F.array().cast(t) for c, t in lists.items() if c not in events.columns}
    missing |= {c: F.lit(None).cast("string") for c in ("thread_id", "inputs_preview", "outputs_preview", "error_preview", "parent_run_id", "attributes_json") if c not in events.columns}
    if "run_id" not in events.columns:
        missing["run_id"] = F.lit("")
    if "event_type" not in events.columns:
        missing["event_type"] = F.lit("end")
    return events.withColumns(missing)


def versioned(events: DataFrame, tie: str = "row_index") -> DataFrame:
    """The last event of each run: latest event time, then end, start and ``tie``. Catalyst keeps one row a run and task before the shuffle,
    and shuffles nothing if traces are together already. Traces come first in the order: sorting compares few projects' names in vain."""
    at = scalars.event_time(F.col("start_time_unix_nano"), F.col("end_time_unix_nano"))
    order = Window.partitionBy("trace_id", "project_name", "span_id").orderBy(at.desc(), F.desc("end_time_unix_nano"), F.desc("start_time_unix_nano"), F.desc(tie))
    return events.withColumn("_version", F.row_number().over(order)).where("_version = 1").drop("_version")


def described(runs: DataFrame) -> DataFrame:
    """Status, latency, event time and ids of each run."""
    start, end = F.col("start_time_unix_nano"), F.col("end_time_unix_nano")
    return runs.withColumns(
        {
            "run_id": F.nullif(F.col("run_id"), F.lit("")),
            "generated_run_id": scalars.generated_run_id(F.col("project_name"), F.col("trace_id"), F.col("span_id")),
            "status": scalars.status(F.col("status_code"), end),
            "event_time_unix_nano": scalars.event_time(start, end),
            "latency_nanos": scalars.latency(start, end),
            "is_root": F.col("parent_span_id").isNull(),
        }
    )


def latest(events: DataFrame, deletions: DataFrame | None = None, include_deleted: bool = False) -> DataFrame:
    """Run heads. Deleted runs are left out, or kept with ``deleted_at_unix_nano``; a deletion holds whatever events come later."""
    heads = described(versioned(typed(events).where(F.col("event_type") != "tombstone")))
    if deletions is None:
        return heads.withColumn("deleted_at_unix_nano", F.lit(None).cast("long"))
    if not include_deleted:
        return heads.join(deletions.select(*RUN_KEY).distinct(), RUN_KEY, "left_anti").withColumn("deleted_at_unix_nano", F.lit(None).cast("long"))
    gone = deletions.groupBy(*RUN_KEY).agg(F.max("deleted_at_unix_nano").alias("deleted_at_unix_nano"))
    return heads.join(gone, RUN_KEY, "left")


def replay(events: DataFrame) -> DataFrame:
    """What the log says in the end: the last event by time and order, unless that is a tombstone."""
    return described(versioned(typed(events)).where(F.col("event_type") != "tombstone"))


def lineage(events: DataFrame) -> DataFrame:
    """All events of each run in order, numbered from 0."""
    at = scalars.event_time(F.col("start_time_unix_nano"), F.col("end_time_unix_nano"))
    order = Window.partitionBy(*RUN_KEY).orderBy("event_time_unix_nano", "row_index")
    return events.withColumn("event_time_unix_nano", at).withColumn("sequence", F.row_number().over(order) - 1)


def with_tree(heads: DataFrame, nodes: DataFrame) -> DataFrame:
    """Heads with roots from the tree: an orphan counts as a root."""
    return heads.drop("is_root").join(nodes.select(*RUN_KEY, "root_run_id", "root_span_id", (F.col("depth") == 0).alias("is_root")), RUN_KEY, "left")
