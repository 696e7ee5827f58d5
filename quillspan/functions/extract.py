"""Measures, tags, metadata, threads and previews from a payload's JSON.

The JSON is parsed once a row with a schema that has every path (keys may hold
dots), all leaves as text; casts are tried, never forced. Malformed JSON gives
nulls. Done when events are ingested, so that queries read typed columns.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

_EXTRA = ("langsmith.extra", "metadata")
_OUT = ("langsmith.outputs", "llm_output", "token_usage")


def _token_paths(kinds: tuple[str, ...], usage: str) -> list[tuple[str, ...]]:
    first = kinds[0]
    return [(k,) for k in kinds] + [(at, k) for at in ("metrics", "usage") for k in kinds] + [("token_usage", first), ("llm_output", "token_usage", first), (usage,), (*_OUT, first), (*_EXTRA, first)]


def _cost_paths(kinds: tuple[str, ...]) -> list[tuple[str, ...]]:
    return [(k,) for k in kinds] + [(at, k) for at in ("metrics", "usage") for k in kinds] + [(*_EXTRA, kinds[0])]


PATHS: dict[str, list[tuple[str, ...]]] = {
    "prompt_tokens": _token_paths(("prompt_tokens", "input_tokens"), "gen_ai.usage.input_tokens"),
    "completion_tokens": _token_paths(("completion_tokens", "output_tokens"), "gen_ai.usage.output_tokens"),
    "total_tokens": _token_paths(("total_tokens",), "gen_ai.usage.total_tokens"),
    "prompt_cost": _cost_paths(("prompt_cost", "input_cost")),
    "completion_cost": _cost_paths(("completion_cost", "output_cost")),
    "total_cost": _cost_paths(("total_cost", "cost")),
    "latency_nanos": [(*at, "first_token_latency_nanos") for at in ((), ("metrics",), _EXTRA)],
    "latency_seconds": [(*at, "first_token_latency") for at in ((), ("metrics",), _EXTRA)],
    "first_time": [(*at, k) for at in ((), ("metrics",), _EXTRA) for k in ("first_token_time_unix_nano", "first_token_time")],
    "evaluator": [("evaluator_score",), ("score",), ("metrics", "evaluator_score"), ("metrics", "score"), ("feedback", "score"), (*_EXTRA, "evaluator_score")],
    "model": [("gen_ai.request.model",), ("gen_ai.response.model",), ("model",), ("model_name",), *[("metadata", k) for k in ("model", "model_name", "ls_model_name")], ("invocation_params", "model"), ("invocation_params", "model_name"), (*_EXTRA, "model"), (*_EXTRA, "ls_model_name"), ("langsmith.extra", "invocation_params", "model"), ("langsmith.outputs", "llm_output", "model_name")],
    "provider": [("gen_ai.system",), ("provider",), ("provider_name",), *[("metadata", k) for k in ("provider", "provider_name", "ls_provider")], (*_EXTRA, "provider"), (*_EXTRA, "ls_provider")],
}
_TAGS = [("tags",), ("langsmith.tags",), ("langsmith.extra", "tags"), ("metadata", "tags")]
_ALIASES = {"open_ai": "openai", "open-ai": "openai", "azure_openai": "azure", "google_genai": "google"}
MAX_TAGS, MAX_TAG, MAX_PAIRS, MAX_KEY, MAX_VALUE, MAX_NAME, MAX_THREAD, MAX_PREVIEW = 32, 128, 32, 128, 256, 256, 256, 512


def _schema(paths: list[tuple[str, ...]], lists: list[tuple[str, ...]]) -> StructType:
    tree: dict = {}
    for path in [*paths, *lists]:
        node = tree
        for key in path[:-1]:
            node = node.setdefault(key, {})
        node.setdefault(path[-1], ArrayType(StringType()) if path in lists else StringType())

    def build(node):
        return StructType([StructField(k, build(v) if isinstance(v, dict) else v) for k, v in node.items()]) if isinstance(node, dict) else node

    return build(tree)


SCHEMA = _schema([p for ps in PATHS.values() for p in ps], _TAGS)


def _at(root: Column, path: tuple[str, ...]) -> Column:
    for key in path:
        root = root.getField(key)
    return root


def _first(root: Column, name: str, read) -> Column:
    return F.coalesce(*[read(_at(root, p)) for p in PATHS[name]])


def _count(x: Column) -> Column:
    v = x.try_cast("long")
    return F.when(v >= 0, v)


def _amount(x: Column) -> Column:
    v = x.try_cast("double")
    return F.when((v >= 0) & ~F.isnan(v) & (v < float("inf")), v)


def _text(x: Column) -> Column:
    v = F.lower(F.trim(x))
    return F.when((F.octet_length(x) <= MAX_NAME) & (v != ""), v)


def measures(parsed: Column, start: Column) -> dict[str, Column]:
    """Typed measures of a parsed payload. Unusable values are skipped for the next path; the time of the first token is the first path's, usable or not."""
    out = {k: _first(parsed, k, _count) for k in ("prompt_tokens", "completion_tokens")} | {k: _first(parsed, k, _amount) for k in ("prompt_cost", "completion_cost")}
    out["total_tokens"] = F.coalesce(_first(parsed, "total_tokens", _count), F.try_add(out["prompt_tokens"], out["completion_tokens"]))
    out["total_cost"] = F.coalesce(_first(parsed, "total_cost", _amount), out["prompt_cost"] + out["completion_cost"])
    time = _count(F.coalesce(*[_at(parsed, p) for p in PATHS["first_time"]]))
    out["first_token_time_unix_nano"] = time
    out["first_token_latency_nanos"] = F.coalesce(_first(parsed, "latency_nanos", _count), F.round(_first(parsed, "latency_seconds", _amount) * 1e9).try_cast("long"), F.when(time >= start, time - start))
    out["evaluator_score"] = _first(parsed, "evaluator", _amount)
    out["model_name"] = _first(parsed, "model", _text)
    provider = _first(parsed, "provider", _text)
    alias = F.create_map(*[F.lit(x) for kv in _ALIASES.items() for x in kv])
    out["provider_name"] = F.coalesce(alias[provider], provider)
    return out


def tags(parsed: Column) -> Column:
    """Sorted distinct scalar tags of at most 128 bytes, 32 at most."""
    every = F.concat(*[F.coalesce(_at(parsed, p), F.array().cast("array<string>")) for p in _TAGS])
    usable = F.filter(every, lambda t: t.isNotNull() & (t != "") & (F.octet_length(t) <= MAX_TAG) & ~t.startswith("{") & ~t.startswith("["))
    return F.slice(F.array_sort(F.array_distinct(usable)), 1, MAX_TAGS)


def metadata(attributes: Column) -> Column:
    """Sorted distinct pairs of scalar metadata, 32 at most, as an array of (key, value): one key may have several values."""
    pair = "map<string,string>"
    schema = f"metadata {pair}, `langsmith.extra` struct<metadata: {pair}>, extra struct<metadata: {pair}>"
    root = F.from_json(attributes, schema)
    every = F.concat(*[F.coalesce(F.map_entries(m), F.array().cast("array<struct<key:string,value:string>>")) for m in (root["metadata"], root["langsmith.extra"]["metadata"], root["extra"]["metadata"])])
    usable = F.filter(every, lambda e: e["value"].isNotNull() & (e["key"] != "") & (e["value"] != "") & (F.octet_length(e["key"]) <= MAX_KEY) & (F.octet_length(e["value"]) <= MAX_VALUE) & ~e["value"].startswith("{") & ~e["value"].startswith("["))
    return F.slice(F.array_sort(F.array_distinct(usable)), 1, MAX_PAIRS)


def thread_id(pairs: Column, tag_list: Column) -> Column:
    """From metadata, else from tags; trimmed, at most 256 bytes."""

    def meta(key):
        return F.get(F.filter(pairs, lambda e: e["key"] == key), 0)["value"]

    def tag(prefixes):
        found = F.filter(tag_list, lambda t: F.regexp_like(t, F.lit("^(" + "|".join(prefixes) + ")[:=]")))
        return F.regexp_replace(F.get(found, 0), "^(" + "|".join(prefixes) + ")[:=]", "")

    # The first source that has a value decides, usable or not.
    found = F.trim(F.coalesce(meta("thread_id"), meta("session_id"), tag(["thread_id", "thread"]), tag(["session_id"])))
    return F.when((found != "") & (F.octet_length(found) <= MAX_THREAD), found)


def _bounded(value) -> str | None:
    text = value.strip()
    return text.encode()[:MAX_PREVIEW].decode("utf-8", "ignore") if text else None


def _compact(value) -> str | None:
    if value is None:
        return None
    return _bounded(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":")))


def _content(value) -> str | None:
    if isinstance(value, str):
        return _bounded(value)
    if isinstance(value, list):
        for part in value:
            text = part if isinstance(part, str) else part.get("text") if isinstance(part, dict) else None
            if isinstance(text, str) and (got := _bounded(text)):
                return got
    return None


def _message(value) -> str | None:
    if isinstance(value, str):
        return _bounded(value)
    return _content(value.get("content")) if isinstance(value, dict) else None


def _messages(value) -> str | None:
    if isinstance(value, list):
        return next((m for m in map(_message, reversed(value)) if m), None)
    if isinstance(value, dict):
        inner = value.get("messages", value.get("message"))
        return (_messages(inner) if inner is not None else None) or _message(value)
    return _compact(value)


def _fields(value, names) -> str | None:
    if not isinstance(value, dict):
        return None
    return next((p for p in (_compact(value.get(n)) for n in names) if p), None) or _compact(value)


def _choice(value) -> str | None:
    choices = value.get("choices") if isinstance(value, dict) else None
    if isinstance(choices, list) and choices and isinstance(choices[0], dict):
        inner = choices[0].get("message", choices[0].get("delta"))
        return _message(inner) if inner is not None else None
    return None


def preview(attributes: str | None) -> tuple[str | None, str | None, str | None]:
    """Input, output and error preview; the first key that is there counts, even when null."""
    try:
        root = json.loads(attributes or "")
    except ValueError:
        return None, None, None
    if not isinstance(root, dict):
        return None, None, None

    def first(*keys):
        return next((root[k] for k in keys if k in root), None)

    given, result, error = first("langsmith.inputs", "inputs", "input", "messages"), first("langsmith.outputs", "outputs", "output", "result"), first("langsmith.error", "error")
    return (
        _messages(given) or _fields(given, ("question", "prompt", "input", "content", "text")),
        _choice(result) or _messages(result) or _fields(result, ("content", "text", "output", "result")),
        _bounded(error) if isinstance(error, str) else _fields(error, ("message", "error")),
    )


@F.pandas_udf(StructType([StructField(c, StringType()) for c in ("inputs_preview", "outputs_preview", "error_preview")]))
def previews(attributes: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([preview(a) for a in attributes], columns=["inputs_preview", "outputs_preview", "error_preview"])


def extracted(events: DataFrame, with_previews: bool = True) -> DataFrame:
    """Events with measures, ``tags``, ``metadata`` (array of pairs), ``thread_id`` and previews beside the payload."""
    out = events.withColumn("_parsed", F.from_json("attributes_json", SCHEMA))
    out = out.withColumns(measures(F.col("_parsed"), F.col("start_time_unix_nano")) | {"tags": tags(F.col("_parsed")), "metadata": metadata(F.col("attributes_json"))}).drop("_parsed")
    out = out.withColumn("thread_id", thread_id(F.col("metadata"), F.col("tags")))
    if with_previews:
        out = out.withColumn("_preview", previews("attributes_json"))
        out = out.withColumns({c: F.col("_preview")[c] for c in ("inputs_preview", "outputs_preview", "error_preview")}).drop("_preview")
    return out
