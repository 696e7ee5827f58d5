"""Schemas of the tables: explicit, never inferred."""

from __future__ import annotations

#: A run event as it arrives. Times are nanoseconds since 1970; end 0 means still running; status 0 unset, 1 ok, 2 error.
EVENT = (
    "project_name string, trace_id string, span_id string, run_id string, parent_run_id string, parent_span_id string, name string, run_type string, "
    "event_type string, start_time_unix_nano long, end_time_unix_nano long, status_code int, attributes_json string, row_index long, idempotency_key string"
)
EVENT_COLUMNS = [c.strip().split()[0] for c in EVENT.split(",")]
EVENT_KINDS = ("start", "update", "end", "compact", "tombstone")
#: A run is known by these.
RUN_KEY = ["project_name", "trace_id", "span_id"]

#: Measures drawn from the payload when an event is ingested.
METRICS = {
    "prompt_tokens": "long", "completion_tokens": "long", "total_tokens": "long", "prompt_cost": "double", "completion_cost": "double", "total_cost": "double",
    "first_token_latency_nanos": "long", "first_token_time_unix_nano": "long", "evaluator_score": "double", "model_name": "string", "provider_name": "string",
}

FEEDBACK = (
    "id string, run_id string, trace_id string, project_name string, key string, score string, value string, correction string, comment string, "
    "feedback_source string, extra string, created_at_unix_nano long, modified_at_unix_nano long"
)
DELETION = "project_name string, trace_id string, span_id string, deleted_at_unix_nano long, reason string"
POLICY = "project_name string, ttl_nanos long"
HOUR = 3_600_000_000_000
