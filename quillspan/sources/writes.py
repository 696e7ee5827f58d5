"""Partial run writes (create and patch) folded into run events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.schemas import EVENT_COLUMNS, RUN_KEY

#: A patch has what changed; ``sequence`` orders the patches of a run. Payload parts are JSON text.
PATCH = "project_name string, trace_id string, span_id string, run_id string, parent_run_id string, parent_span_id string, name string, run_type string, start_time_unix_nano long, end_time_unix_nano long, inputs string, outputs string, extra string, events string, tags string, error string, sequence long"
_PARTS = ("inputs", "outputs", "extra", "events", "tags", "error")


def fold(patches: DataFrame) -> DataFrame:
    """An event for each patch with everything said so far: the last value given for each field wins.

    The event is an end if its patch gives an end time or an error, an update if
    the run was there, otherwise a start. A run with an error has status 2, one
    without an end 0, others 1.
    """
    w = Window.partitionBy(*RUN_KEY).orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    kept = ["run_id", "parent_run_id", "parent_span_id", "name", "run_type", "start_time_unix_nano", "end_time_unix_nano", *_PARTS]
    out = patches.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in kept} | {"_n": F.row_number().over(Window.partitionBy(*RUN_KEY).orderBy("sequence")), "_ends": F.col("end_time_unix_nano").isNotNull() | F.col("error").isNotNull()})
    parts = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f'"langsmith.{c}":'), F.col(c))) for c in _PARTS]))
    end = F.coalesce("end_time_unix_nano", F.lit(0))
    made = {
        "run_id": F.coalesce("run_id", F.lit("")), "name": F.coalesce("name", F.lit("")), "run_type": F.coalesce("run_type", F.lit("chain")), "end_time_unix_nano": end,
        "event_type": F.when(F.col("_ends"), "end").when(F.col("_n") > 1, "update").otherwise("start"), "status_code": F.when(F.col("error").isNotNull(), 2).when(end == 0, 0).otherwise(1),
        "attributes_json": F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")), "row_index": F.col("sequence"), "idempotency_key": F.lit(None).cast("string"),
    }
    return out.withColumns(made).select(*EVENT_COLUMNS)
