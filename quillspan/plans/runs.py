"""Requests for runs, threads and aggregates, compiled to plans."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators import aggregates, lifecycle, rollups
from quillspan.plans import filters
from quillspan.schemas import HOUR, RUN_KEY

DEFAULT_PAGE, MAX_PAGE, MAX_DIRECT = 20, 100, 128
SUMMARY = ["project_name", "trace_id", "span_id", "run_id", "generated_run_id", "parent_run_id", "parent_span_id", "name", "run_type", "status", "start_time_unix_nano", "end_time_unix_nano", "is_root", "latency_nanos"]


def page_size(limit: int | None) -> int:
    return DEFAULT_PAGE if limit is None else max(1, min(limit, MAX_PAGE))


@dataclass
class RunQuery:
    """All conditions hold together. ``limit=0`` is an empty page; None is no limit."""

    projects: Sequence[str]
    filter: str | dict | list | None = None
    trace_filter: str | None = None
    tree_filter: str | None = None
    trace_id: str | None = None
    parent_run_id: str | None = None
    parent_span_id: str | None = None
    run_type: str | None = None
    is_root: bool | None = None
    error: bool | None = None
    start_min: int | None = None
    start_max: int | None = None
    retention_cutoff: int | None = None
    include_deleted: bool = False
    descending: bool = False
    limit: int | None = None
    offset: int = 0
    cursor: str | None = None
    payload: bool = False
    group_by: Sequence[str] = field(default_factory=tuple)
    time_bucket: int | None = HOUR
    feedback_keys: Sequence[str] = field(default_factory=tuple)


def typed_conditions(q: RunQuery) -> list[Column]:
    """Conditions on plain columns: they reach the scan of a heads table."""
    c = F.col
    out = [c("project_name").isin(*q.projects) if q.projects else F.lit(False)]
    for name in ("trace_id", "parent_run_id", "parent_span_id", "run_type"):
        if (v := getattr(q, name)) is not None:
            out.append(c(name) == v)
    if q.is_root is not None:
        out.append(c("is_root") == q.is_root)
    if q.error is not None:
        out.append(c("status") == "error" if q.error else c("status") != "error")
    if q.start_min is not None:
        out.append(c("start_time_unix_nano") >= q.start_min)
    if q.start_max is not None:
        out.append(c("start_time_unix_nano") <= q.start_max)
    return out


def select_runs(heads: DataFrame, q: RunQuery, ctx: filters.Context | None = None, tree: DataFrame | None = None) -> DataFrame:
    """Runs that meet the query, in no order."""
    ctx = ctx or filters.Context()
    ctx.projects = tuple(q.projects)
    out = heads
    for condition in typed_conditions(q):
        out = out.where(condition)
    out = lifecycle.within_retention(out, q.retention_cutoff)
    if q.filter is not None:
        out = filters.apply(out, q.filter, ctx)
    if q.trace_filter or q.tree_filter:
        related = heads.where(F.col("project_name").isin(*q.projects))
        if q.trace_filter:
            out = out.join(filters.trace_filter(related, q.trace_filter, ctx).select(*RUN_KEY), RUN_KEY, "left_semi")
        if q.tree_filter:
            if tree is None:
                raise filters.unsupported("a tree filter needs the tree table")
            out = out.join(filters.tree_filter(related, tree, q.tree_filter, ctx).select(*RUN_KEY), RUN_KEY, "left_semi")
    return out


def offset_of(q: RunQuery) -> int:
    """The cursor of a run list is an offset as text; what can't be read is ignored."""
    return int(q.cursor) if q.cursor and q.cursor.isdigit() else max(0, q.offset)


def page(runs: DataFrame, q: RunQuery) -> DataFrame:
    """One page by start and span; the span goes up whichever way the start goes. Only the page's rows are gathered."""
    start = F.desc("start_time_unix_nano") if q.descending else F.asc("start_time_unix_nano")
    out = runs.orderBy(start, F.asc("span_id"))
    if offset_of(q):
        out = out.offset(offset_of(q))
    return out if q.limit is None else out.limit(max(0, q.limit))


def with_next(rows: DataFrame, order: Sequence[Column], size: int, cursor: Column) -> DataFrame:
    """The first ``size`` rows in order with ``next_cursor``: that of the last row if a probe row follows, else null. Only a page and one row are gathered."""
    probe = rows.orderBy(*order).limit(size + 1)
    whole = Window.partitionBy(F.lit(0))  # a page, never a table
    numbered = probe.withColumn("_n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))).withColumn("_c", cursor)
    more = numbered.withColumn("next_cursor", F.when(F.count(F.lit(1)).over(whole) > size, F.max(F.when(F.col("_n") == size, F.col("_c"))).over(whole)))
    return more.where(F.col("_n") <= size).orderBy("_n").drop("_n", "_c")


def list_runs_page(heads: DataFrame, q: RunQuery, ctx: filters.Context | None = None, tree: DataFrame | None = None) -> DataFrame:
    """As ``list_runs``, a page of ``limit`` rows (clamped) with ``next_cursor``, the offset of what follows."""
    start = F.desc("start_time_unix_nano") if q.descending else F.asc("start_time_unix_nano")
    at, size = offset_of(q), page_size(q.limit)
    order = [start, F.asc("span_id"), F.asc("trace_id"), F.asc("project_name")]
    rows = select_runs(heads, q, ctx, tree)
    rows = rows.orderBy(*order).offset(at) if at else rows
    page_ = with_next(rows, order, size, F.lit(str(at + size)))
    return page_.select(*SUMMARY, (F.col("attributes_json") if q.payload else F.lit("{}")).alias("attributes_json"), "next_cursor")


def list_runs(heads: DataFrame, q: RunQuery, ctx: filters.Context | None = None, tree: DataFrame | None = None) -> DataFrame:
    """The page's run summaries; payloads are ``{}`` unless asked for, so that their column isn't read."""
    rows = page(select_runs(heads, q, ctx, tree), q)
    return rows.select(*SUMMARY, (F.col("attributes_json") if q.payload else F.lit("{}")).alias("attributes_json"))


def aggregate_runs(heads: DataFrame, q: RunQuery, ctx: filters.Context | None = None, tree: DataFrame | None = None, rollup: DataFrame | None = None, feedback_rollup: DataFrame | None = None) -> tuple[DataFrame, str]:
    """Grouped metrics and where they came from: ``rollup`` if one answers the query exactly, else ``scan``."""
    kind = rollups.eligible(q.group_by, q.time_bucket, q.run_type, q.error, q.start_min, q.start_max, beyond_rollups(q), q.include_deleted)
    table = feedback_rollup if kind == "feedback" else rollup
    if kind and table is not None:
        return rollups.answer(table, kind, q.projects, q.run_type, q.error, q.start_min, q.start_max), "feedback_rollup" if kind == "feedback" else "rollup"
    runs = select_runs(heads, q, ctx, tree)
    feedback = ctx.feedback if ctx else None
    return aggregates.aggregate(runs, q.group_by, q.time_bucket, feedback, q.feedback_keys or None), "scan"


#: What a rollup's key holds, and what concerns pages only; any other condition needs a scan.
_ROLLED = frozenset({"projects", "run_type", "error", "start_min", "start_max", "include_deleted", "group_by", "time_bucket", "descending", "limit", "offset", "cursor", "payload"})


def beyond_rollups(q: RunQuery) -> bool:
    """Whether the query has a condition that rollups can't answer."""
    return any(getattr(q, f.name) not in (None, (), [], "") for f in fields(q) if f.name not in _ROLLED)


def load_runs(heads: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Runs by explicit or generated id, in the order asked."""
    if len(ids) > MAX_DIRECT:
        raise ValueError(f"at most {MAX_DIRECT} ids")
    if not ids:
        return heads.limit(0).withColumn("asked", F.lit(0))
    place = F.create_map(*[F.lit(x) for i, v in enumerate(ids) for x in (v, i)])
    found = heads.where(F.col("run_id").isin(*ids) | F.col("generated_run_id").isin(*ids))
    return found.withColumn("asked", F.coalesce(place[F.col("run_id")], place[F.col("generated_run_id")])).orderBy("asked", F.desc("start_time_unix_nano"))


def children(rows: DataFrame) -> DataFrame:
    """Rows of a page with ``child_run_ids``: the page's runs whose parent they are, in page order."""
    own = F.coalesce("run_id", "generated_run_id")
    below = rows.where(F.col("parent_span_id").isNotNull()).groupBy("project_name", "trace_id", F.col("parent_span_id").alias("span_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("start_time_unix_nano", F.col("span_id").alias("child"), own.alias("id")))), lambda x: x["id"]).alias("child_run_ids"))
    return rows.join(below, RUN_KEY, "left").withColumn("child_run_ids", F.coalesce("child_run_ids", F.array().cast("array<string>")))


def trace_page(thread_traces: DataFrame, limit: int | None = None, cursor: str | None = None) -> DataFrame:
    """Traces of a thread after a ``trace:start:id`` cursor: rows that come in before it don't move the page."""
    out = thread_traces
    if cursor:
        _, start, trace = cursor.split(":", 2)
        s = F.col("start_time_unix_nano")
        out = out.where((s > int(start)) | (s == int(start)) & (F.col("trace_id") > trace))
    return with_next(out, [F.asc("start_time_unix_nano"), F.asc("trace_id")], page_size(limit), F.concat(F.lit("trace:"), F.col("start_time_unix_nano").cast("string"), F.lit(":"), "trace_id"))


def selected(rows: DataFrame, selects: Sequence[str] = ()) -> DataFrame:
    """The fields asked for, in any case; none asked for is all. A field that isn't there is refused."""
    known = {c.lower(): c for c in rows.columns}
    if bad := [s for s in selects if s.lower() not in known]:
        raise ValueError(f"unknown field: {', '.join(bad)}")
    return rows.select(*dict.fromkeys(known[s.lower()] for s in selects)) if selects else rows


def thread_page(threads: DataFrame, limit: int | None = None, cursor: str | None = None, start_min: int | None = None, start_max: int | None = None) -> DataFrame:
    """Threads, those last active first, after a ``thread:start:id`` cursor; the window has to overlap the thread."""
    out = threads
    if start_min is not None:
        out = out.where(F.col("max_start_time_unix_nano") >= start_min)
    if start_max is not None:
        out = out.where(F.col("min_start_time_unix_nano") <= start_max)
    if cursor:
        _, start, thread = cursor.split(":", 2)
        s = F.col("max_start_time_unix_nano")
        out = out.where((s < int(start)) | (s == int(start)) & (F.col("thread_id") > thread))
    return with_next(out, [F.col("max_start_time_unix_nano").desc_nulls_last(), F.asc("thread_id")], page_size(limit), F.concat(F.lit("thread:"), F.col("max_start_time_unix_nano").cast("string"), F.lit(":"), "thread_id"))


def by_root(thread_traces: DataFrame, heads: DataFrame, filter: str | dict | list, ctx: filters.Context | None = None) -> DataFrame:
    """Traces of threads whose root run meets the filter, by one equality join."""
    roots = filters.apply(heads, filter, ctx or filters.Context()).select("project_name", "trace_id", F.col("span_id").alias("root_span_id"))
    return thread_traces.join(roots, ["project_name", "trace_id", "root_span_id"], "left_semi")


def threads_by_root(threads: DataFrame, thread_traces: DataFrame, heads: DataFrame, filter: str | dict | list, ctx: filters.Context | None = None) -> DataFrame:
    """Threads with a trace whose root run meets the filter; their summaries are of all their traces."""
    return threads.join(by_root(thread_traces, heads, filter, ctx).select("project_name", "thread_id"), ["project_name", "thread_id"], "left_semi")


def response(rows: DataFrame) -> DataFrame:
    """The shape that a client of the run API sees."""
    from quillspan.functions import scalars

    def part(*keys):
        return F.coalesce(*[F.get_json_object("attributes_json", f"$['{k}']") for k in keys])

    end = F.col("end_time_unix_nano")
    tags = F.coalesce("tags", F.array().cast("array<string>")) if "tags" in rows.columns else F.coalesce(F.from_json(F.get_json_object("attributes_json", "$.tags"), "array<string>"), F.array().cast("array<string>"))
    return rows.select(
        F.coalesce("run_id", "generated_run_id").alias("id"), "project_name", "trace_id", "span_id", "name", "run_type", "status",
        F.coalesce("parent_run_id", F.when(F.col("parent_span_id").isNotNull(), scalars.generated_run_id(F.col("project_name"), F.col("trace_id"), F.col("parent_span_id")))).alias("parent_run_id"),
        scalars.format_rfc3339(F.col("start_time_unix_nano")).alias("start_time"), F.when(end != 0, scalars.format_rfc3339(end)).alias("end_time"),
        scalars.dotted_order(F.col("start_time_unix_nano"), F.col("span_id")).alias("dotted_order"),
        part("langsmith.inputs", "inputs").alias("inputs"), part("langsmith.outputs", "outputs").alias("outputs"), part("langsmith.extra", "extra").alias("extra"), part("langsmith.events", "events").alias("events"), part("langsmith.error", "error").alias("error"), tags.alias("tags"),
    )
