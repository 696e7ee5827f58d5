"""Scalar column functions with no Python in the hot path."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan.schemas import HOUR

PREFIX = "quillspan"
_NAMESPACE = uuid.NAMESPACE_URL.hex


def uuid5(name: Column) -> Column:
    """Name-based UUID in the URL namespace: a SHA-1 with version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(_NAMESPACE)), name.cast("binary")))
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), (F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def generated_run_id(project: Column, trace: Column, span: Column) -> Column:
    return uuid5(F.concat(F.lit(f"{PREFIX}:run:"), project, F.lit(":"), trace, F.lit(":"), span))


def project_id(name: str) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"{PREFIX}:project:{name}"))


def project_id_column(name: Column) -> Column:
    return uuid5(F.concat(F.lit(f"{PREFIX}:project:"), name))


def run_id_of(project: str, trace: str, span: str) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"{PREFIX}:run:{project}:{trace}:{span}"))


def span_id_from_run(run_id: str) -> str:
    return run_id.replace("-", "")[:16]


def trace_id_from_run(run_id: str) -> str:
    return run_id.replace("-", "")


def bucket(time: Column, width: int = HOUR) -> Column:
    """Start of the time's bucket: rounds down, before 1970 too. Long arithmetic only."""
    return time - F.pmod(time, F.lit(width))


def event_time(start: Column, end: Column) -> Column:
    return F.when(end > 0, end).otherwise(start)


def status(code: Column, end: Column) -> Column:
    """Error beats pending."""
    return F.when(code == 2, "error").when(end == 0, "pending").otherwise("success")


def latency(start: Column, end: Column) -> Column:
    return F.greatest(end - start, F.lit(0).cast("long"))


def seconds(nanos: Column) -> Column:
    return F.greatest(nanos, F.lit(0)) / F.lit(1e9)


def dotted_order(start: Column, span: Column) -> Column:
    return F.concat(F.lpad(start.cast("string"), 20, "0"), F.lit("."), span)


def default_idempotency_key() -> Column:
    """What makes a retry recognisable when the sender gives no key."""
    parts = ["run_id", "trace_id", "span_id", "event_type", "start_time_unix_nano", "end_time_unix_nano", "status_code", "name"]
    return F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts], F.xxhash64("attributes_json").cast("string"))


def nearest_rank(values: Column, percent: int) -> Column:
    """Percentile of a sorted array by ceiling rank: element ceil((n - 1) p / 100), counted from 0; null if empty."""
    n = F.size(values)
    return F.when(n > 0, F.get(values, F.floor(((n - 1) * percent + 99) / 100).cast("int")))


def parse_rfc3339(text: Column) -> Column:
    """Nanoseconds since 1970; null if the text is no time. The fraction is added as a number, as timestamps keep microseconds."""
    whole = F.try_to_timestamp(F.regexp_replace(text, r"\.\d+", ""))
    fraction = F.rpad(F.substring(F.regexp_extract(text, r"\.(\d+)", 1), 1, 9), 9, "0")
    return F.unix_micros(whole) * 1000 + F.coalesce(fraction.try_cast("long"), F.lit(0))


def format_rfc3339(nanos: Column) -> Column:
    second = F.call_function("div", nanos - F.pmod(nanos, F.lit(1_000_000_000)), F.lit(1_000_000_000).cast("long"))
    return F.concat(F.date_format(F.timestamp_seconds(second), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad(F.pmod(nanos, F.lit(1_000_000_000)).cast("string"), 9, "0"), F.lit("Z"))
