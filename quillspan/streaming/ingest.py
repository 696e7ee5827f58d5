"""Streaming ingest: dedup, lineage, and heads kept up to date.

Each micro-batch is appended to the log once and only the traces it touches are
recomputed. Time bounds nothing: an event may be as late as it likes and still
takes its place in the lineage, and never replaces a newer head.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspan.functions import scalars
from quillspan.operators import heads as heads_
from quillspan.operators import tree as tree_
from quillspan.schemas import EVENT_COLUMNS


def keyed(events: DataFrame) -> DataFrame:
    return events.withColumn("idempotency_key", F.coalesce("idempotency_key", scalars.default_idempotency_key()))


def bounded_dedup(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Dedup with state bounded by a watermark, for senders whose retries come within ``late``."""
    timed = keyed(stream).withColumn("_at", F.timestamp_micros(F.call_function("div", F.col("start_time_unix_nano"), F.lit(1000).cast("long"))))
    return timed.withWatermark("_at", late).dropDuplicatesWithinWatermark(["project_name", "idempotency_key"]).drop("_at")


def hourly(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts and errors of events by project and hour, as a windowed streaming aggregate."""
    timed = stream.withColumn("_at", F.timestamp_micros(F.call_function("div", F.col("start_time_unix_nano"), F.lit(1000).cast("long")))).withWatermark("_at", late)
    return timed.groupBy("project_name", F.window("_at", "1 hour").alias("hour")).agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("status_code") == 2).alias("errors"))


def start(stream: DataFrame, root: str, checkpoint: str, trigger: dict | None = None, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Ingest ``stream`` into ``root/log``; ``then`` gets each batch's refreshed heads.

    The batch number is part of the log's partitioning and batches overwrite
    their own partition, so a batch that runs again after a failure leaves the
    log as if it had run once. Exact dedup is an anti-join with the projects
    that the batch has in the log.
    """
    log = f"{root}/log"

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = keyed(batch).dropDuplicates(["project_name", "idempotency_key"])
        old = _read(spark, log)
        if old is not None:
            old = old.where(F.col("batch") < number)
            fresh = fresh.join(old.select("project_name", "idempotency_key"), ["project_name", "idempotency_key"], "left_anti")
        fresh.select(*EVENT_COLUMNS, F.lit(number).alias("batch")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(log)
        if then is not None:
            whole = _read(spark, log)
            touched = whole.where(F.col("batch") == number).select("project_name", "trace_id").distinct()
            events = whole.join(touched, ["project_name", "trace_id"], "left_semi")
            then(refreshed(events), number)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def refreshed(events: DataFrame) -> DataFrame:
    """Heads of whole traces with their tree: a late parent moves everything below it."""
    runs = heads_.latest(events)
    return heads_.with_tree(runs, tree_.nodes(runs))


def _read(spark, path: str) -> DataFrame | None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at) or not any(not f.getPath().getName().startswith(("_", ".")) for f in files.listStatus(at)):
        return None  # nothing written yet; whatever else is wrong is an error
    return spark.read.parquet(path)
