"""OTLP-shaped trace exports (decoded, as JSON or Parquet) to run events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.schemas import EVENT_COLUMNS

_VALUE = "struct<stringValue:string,boolValue:boolean,intValue:long,doubleValue:double,bytesValue:binary,arrayValue:string,kvlistValue:string>"
_ATTRIBUTES = f"array<struct<key:string,value:{_VALUE}>>"
#: Arrays and key-value lists come as JSON text.
SPAN = f"struct<traceId:binary,spanId:binary,parentSpanId:binary,name:string,startTimeUnixNano:long,endTimeUnixNano:long,attributes:{_ATTRIBUTES},status:struct<code:int>>"
EXPORT = f"project_name string, resourceSpans array<struct<resource:struct<attributes:{_ATTRIBUTES}>,scopeSpans:array<struct<spans:array<{SPAN}>>>>>"
RUN_TYPES = ("llm", "tool", "retriever", "chain", "prompt", "parser", "embedding", "agent")
_TYPE_KEYS = ("langsmith.span.kind", "run_type", "openinference.span.kind")
_OPERATIONS = {"chat": "llm", "text_completion": "llm", "generate_content": "llm", "completion": "llm", "embeddings": "embedding", "execute_tool": "tool", "invoke_agent": "agent"}


def any_value(v: Column) -> Column:
    """The JSON text of a typed value; bytes as hexadecimal text."""
    quote = lambda s: F.regexp_extract(F.to_json(F.struct(s.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    return F.coalesce(
        F.when(v["stringValue"].isNotNull(), quote(v["stringValue"])), v["boolValue"].cast("string"), v["intValue"].cast("string"), F.when(v["doubleValue"].isNotNull(), quote(v["doubleValue"])),
        F.when(v["bytesValue"].isNotNull(), quote(F.lower(F.hex(v["bytesValue"])))), v["arrayValue"], v["kvlistValue"], F.lit("null"),
    )


def valid_id(x: Column, size: int) -> Column:
    return x.isNotNull() & (F.octet_length(x) == size) & (F.hex(x) != "0" * (2 * size))


def run_type(attributes: Column, name: Column) -> Column:
    """Said outright, else by the operation, else by the name, else ``span``."""

    def attribute(key):
        return F.lower(F.get(F.filter(attributes, lambda a: a["key"] == key), 0)["value"]["stringValue"])

    operation = F.create_map(*[F.lit(x) for kv in _OPERATIONS.items() for x in kv])[attribute("gen_ai.operation.name")]
    by_name = F.coalesce(*[F.when(F.contains(F.lower(name), F.lit(t)), t) for t in RUN_TYPES])
    return F.coalesce(*[attribute(k) for k in _TYPE_KEYS], operation, by_name, F.lit("span"))


def flatten(exports: DataFrame) -> DataFrame:
    """One event a span; resource attributes are prefixed and give way to the span's own. Bad ids go to ``rejected``."""
    at = exports.select("project_name", F.explode("resourceSpans").alias("r")).select("project_name", F.col("r.resource.attributes").alias("above"), F.explode("r.scopeSpans").alias("s")).select("project_name", "above", F.explode("s.spans").alias("x"))
    s = F.col("x")
    own = F.coalesce(s["attributes"], F.array().cast(_ATTRIBUTES))
    above = F.transform(F.coalesce("above", F.array().cast(_ATTRIBUTES)), lambda a: F.struct(F.concat(F.lit("resource."), a["key"]).alias("key"), a["value"].alias("value")))
    kept = F.filter(above, lambda a: ~F.exists(own, lambda o: o["key"] == a["key"]))
    key = lambda k: F.regexp_extract(F.to_json(F.struct(k.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    body = F.array_join(F.transform(F.concat(kept, own), lambda a: F.concat(key(a["key"]), F.lit(":"), any_value(a["value"]))), ",")
    end, code = F.coalesce(s["endTimeUnixNano"], F.lit(0)), F.coalesce(s["status"]["code"], F.lit(0))
    ok = valid_id(s["traceId"], 16) & valid_id(s["spanId"], 8) & (s["parentSpanId"].isNull() | (F.octet_length(s["parentSpanId"]) == 0) | valid_id(s["parentSpanId"], 8))
    made = {
        "trace_id": F.lower(F.hex(s["traceId"])), "span_id": F.lower(F.hex(s["spanId"])), "run_id": F.lit(""), "parent_run_id": F.lit(None).cast("string"),
        "parent_span_id": F.when(F.octet_length(s["parentSpanId"]) > 0, F.lower(F.hex(s["parentSpanId"]))), "name": F.coalesce(s["name"], F.lit("")), "run_type": run_type(own, s["name"]),
        "event_type": F.when((end > 0) | (code == 2), "end").otherwise("start"), "start_time_unix_nano": F.coalesce(s["startTimeUnixNano"], F.lit(0)), "end_time_unix_nano": end, "status_code": code,
        "attributes_json": F.concat(F.lit("{"), body, F.lit("}")), "row_index": F.monotonically_increasing_id(), "idempotency_key": F.lit(None).cast("string"),
    }
    return at.withColumns(made | {"rejected": ~ok}).select(*EVENT_COLUMNS, "rejected")
