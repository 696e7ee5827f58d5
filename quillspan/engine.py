"""The whole as one object: tables in, DataFrames out."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import extract, scalars
from quillspan.operators import aggregates, feedback, heads, lifecycle, rollups, search, threads, tree
from quillspan.plans import filters, limits, runs
from quillspan.schemas import DELETION, FEEDBACK


_UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\Z", re.I)


class Engine:
    """Queries over an event log, with optional feedback and deletions.

    Everything is a lazy DataFrame; derived tables are built when first asked for
    and can be persisted by the caller where several queries share them.
    """

    def __init__(self, spark: SparkSession, events: DataFrame, feedback_log: DataFrame | None = None, deletions: DataFrame | None = None, limit: limits.Limits | None = None, extracted: bool = False):
        self.spark, self.limits, self.counters = spark, limit, limits.Counters()
        self.events = events if extracted else extract.extracted(events)
        self.feedback = feedback.scored(feedback.current(feedback_log if feedback_log is not None else spark.createDataFrame([], FEEDBACK)))
        self.deletions = deletions if deletions is not None else spark.createDataFrame([], DELETION)

    @cached_property
    def tree(self) -> DataFrame:
        return tree.nodes(heads.latest(self.events, self.deletions))

    @cached_property
    def heads(self) -> DataFrame:
        return heads.with_tree(heads.latest(self.events, self.deletions), self.tree)

    @cached_property
    def all_heads(self) -> DataFrame:
        """Deleted runs too."""
        return heads.with_tree(heads.latest(self.events, self.deletions, include_deleted=True), self.tree)

    @cached_property
    def leaves(self) -> DataFrame:
        return search.leaves(self.heads)

    @cached_property
    def postings(self) -> DataFrame:
        return search.postings(self.leaves)

    @cached_property
    def rollup(self) -> DataFrame:
        return rollups.runs(self.heads)

    @cached_property
    def feedback_rollup(self) -> DataFrame:
        return rollups.feedback(self.feedback)

    @cached_property
    def thread_traces(self) -> DataFrame:
        return threads.traces(self.heads)

    @cached_property
    def threads(self) -> DataFrame:
        return threads.summaries(self.thread_traces)

    @cached_property
    def messages(self) -> DataFrame:
        return threads.messages(self.heads)

    def context(self) -> filters.Context:
        return filters.Context(self.feedback, self.leaves, self.postings)

    def _checked(self, df: DataFrame) -> DataFrame:
        if self.limits is not None:
            limits.enforce(df, self.limits)
        return df

    def execute(self, df: DataFrame, name: str = "query", source: str = "scan") -> tuple[list, limits.Diagnostics]:
        """Rows of a result within the limits (files, requests, bytes, rows and wall time), with diagnostics; the engine's counters are kept."""
        return limits.run(df, name, self.limits, self.counters, source)

    def projects(self, limit: int = 100) -> DataFrame:
        return self.events.select("project_name").distinct().orderBy("project_name").limit(max(0, min(limit, 1000)))

    def resolve(self, wanted: Sequence[str]) -> list[str]:
        """Project names from names and ids, in order, once each. Ids are looked up among all projects; only those asked for are collected."""
        ids = [w for w in wanted if _UUID.match(w)]
        by_id: dict[str, str] = {}
        if ids:
            named = self.events.select("project_name").distinct().withColumn("id", scalars.project_id_column(F.col("project_name")))
            by_id = {r["id"]: r["project_name"] for r in named.where(F.col("id").isin(*ids)).collect()}
        return list(dict.fromkeys(by_id.get(w, w) for w in wanted))

    def list_runs(self, query: runs.RunQuery) -> DataFrame:
        source = self.all_heads if query.include_deleted else self.heads
        return self._checked(runs.list_runs(source, query, self.context(), self.tree))

    def list_runs_page(self, query: runs.RunQuery) -> DataFrame:
        """A page with ``next_cursor``."""
        source = self.all_heads if query.include_deleted else self.heads
        return self._checked(runs.list_runs_page(source, query, self.context(), self.tree))

    def aggregate_runs(self, query: runs.RunQuery, use_rollups: bool = True) -> tuple[DataFrame, str]:
        source = self.all_heads if query.include_deleted else self.heads
        rows, kind = runs.aggregate_runs(source, query, self.context(), self.tree, self.rollup if use_rollups else None, self.feedback_rollup if use_rollups else None)
        return self._checked(rows), kind

    def run(self, run_id: str, projection: str = "summary") -> DataFrame:
        """One run: ``summary``, ``full`` (with payload) or ``events`` (its lineage)."""
        one = self.heads.where((F.col("run_id") == run_id) | (F.col("generated_run_id") == run_id))
        if projection == "events":
            return heads.lineage(heads.typed(self.events)).join(one.select("project_name", "trace_id", "span_id"), ["project_name", "trace_id", "span_id"], "left_semi").orderBy("sequence")
        one = one.orderBy(F.desc("start_time_unix_nano")).limit(1)
        return one if projection == "full" else one.select(*runs.SUMMARY)

    def runs_by_id(self, ids: Sequence[str]) -> DataFrame:
        return runs.load_runs(self.heads, ids)

    def trace(self, project: str, trace_id: str) -> DataFrame:
        return self.heads.where((F.col("project_name") == project) & (F.col("trace_id") == trace_id)).orderBy("start_time_unix_nano", "span_id")

    def trace_tree(self, project: str, trace_id: str) -> list[dict]:
        """The trace as nested nodes; a trace fits the driver."""
        return tree.nested([r.asDict() for r in tree.load(self.heads, self.tree, project, trace_id).toLocalIterator()])

    def replay(self) -> DataFrame:
        return heads.replay(self.events)

    def stats(self) -> DataFrame:
        return aggregates.filter_stats(self.heads)

    def list_threads(self, filter: str | dict | list | None = None, **page) -> DataFrame:
        """Threads; with a filter those with a trace whose root run meets it."""
        found = self.threads if filter is None else runs.threads_by_root(self.threads, self.thread_traces, self.heads, filter, self.context())
        return self._checked(runs.thread_page(found, **page))

    def list_thread_traces(self, project: str, thread_id: str, filter: str | dict | list | None = None, **page) -> DataFrame:
        found = self.thread_traces.where((F.col("project_name") == project) & (F.col("thread_id") == thread_id))
        found = found if filter is None else runs.by_root(found, self.heads, filter, self.context())
        return self._checked(runs.trace_page(found, **page))

    def list_messages(self, project: str, thread_id: str, limit: int = 100) -> DataFrame:
        return threads.message_page(self.messages.where((F.col("project_name") == project) & (F.col("thread_id") == thread_id)), limit)

    def list_feedback(self, **conditions) -> DataFrame:
        return feedback.listing(self.feedback, **conditions)

    def _changed(self, **tables) -> Engine:
        out = Engine.__new__(Engine)
        out.__dict__ = {k: v for k, v in self.__dict__.items() if k in ("spark", "limits", "counters", "events", "feedback", "deletions")} | tables
        return out

    def delete(self, which, at: int, reason: str = "user_request") -> Engine:
        """This engine without the runs that satisfy ``which``."""
        return self._changed(deletions=self.deletions.unionByName(lifecycle.deleted(self.heads, which, at, reason)))

    def enforce_retention(self, policies: DataFrame, now: int) -> Engine:
        return self._changed(deletions=self.deletions.unionByName(lifecycle.expired(self.heads, policies, now)))

    def compact(self) -> Engine:
        """This engine over compacted events: deleted runs can't be had back."""
        return self._changed(events=lifecycle.compacted(self.events, self.deletions))
