"""Guards before and around a query: what it may read and how long it may take."""

from __future__ import annotations

import threading
import time
import uuid
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import TypeVar
from urllib.parse import quote

from pyspark.sql import DataFrame, Row

T = TypeVar("T")
REQUESTS_A_FILE = 48


class QueryRejected(RuntimeError):
    """The query would go over a limit."""


@dataclass(frozen=True)
class Limits:
    files: int | None = 128
    requests: int | None = 6656
    bytes: int | None = 128 << 20
    seconds: float | None = 30.0
    runs: int | None = None


@dataclass
class Diagnostics:
    files: int = 0
    estimated_requests: int = 0
    bytes: int = 0
    rows: int = 0
    seconds: float = 0.0
    source: str = "scan"
    rejected: str | None = None


@dataclass
class Counters:
    """Counts of a process: queries, rejections, slow ones."""

    slow_seconds: float = 1.0
    queries: int = 0
    rejected: int = 0
    slow: int = 0
    log: list[tuple[str, float]] = field(default_factory=list)

    def note(self, name: str, seconds: float) -> None:
        self.queries += 1
        if seconds >= self.slow_seconds:
            self.slow += 1
            self.log = [*self.log[-99:], (name, seconds)]


def estimate(df: DataFrame) -> Diagnostics:
    """Files behind a plan and their size, from their folders' listings on whatever file system; nothing is read."""
    context = df.sparkSession.sparkContext
    folders: dict[str, set[str]] = defaultdict(set)
    for f in df.inputFiles():
        folder, _, name = f.rpartition("/")
        folders[folder].add(name)
    size = 0
    for folder, names in folders.items():
        at = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI(folder))
        for status in at.getFileSystem(context._jsc.hadoopConfiguration()).listStatus(at):
            if quote(status.getPath().getName()) in names or status.getPath().getName() in names:
                size += status.getLen()
    files = sum(map(len, folders.values()))
    return Diagnostics(files=files, estimated_requests=REQUESTS_A_FILE * files, bytes=size)


def enforce(df: DataFrame, limits: Limits) -> Diagnostics:
    """Refuse a plan over its limits before it runs; the rows are counted as they come (``run``)."""
    found = estimate(df)
    for what, now, most in (("files", found.files, limits.files), ("requests", found.estimated_requests, limits.requests), ("bytes", found.bytes, limits.bytes)):
        if most is not None and now > most:
            found.rejected = f"{what}: {now} exceeds {most}"
            raise QueryRejected(found.rejected)
    return found


def run(df: DataFrame, name: str, limits: Limits | None, counters: Counters, source: str = "scan") -> tuple[list[Row], Diagnostics]:
    """The rows of a query within its limits, what it took, and a note in the counters. The query runs once."""
    limits = limits or Limits(None, None, None, None, None)
    began = time.monotonic()
    try:
        found = enforce(df, limits)
        bounded = df if limits.runs is None else df.limit(limits.runs + 1)
        rows = timed(bounded, limits.seconds, lambda x: x.collect())
        if limits.runs is not None and len(rows) > limits.runs:
            raise QueryRejected(f"runs: more than {limits.runs}")
    except QueryRejected:
        counters.rejected += 1
        raise
    finally:
        counters.note(name, time.monotonic() - began)
    found.rows, found.seconds, found.source = len(rows), time.monotonic() - began, source
    return rows, found


def timed(df: DataFrame, seconds: float | None, act: Callable[[DataFrame], T]) -> T:
    """``act`` on ``df``; its jobs are cancelled by tag when the time is up."""
    context, tag = df.sparkSession.sparkContext, f"query-{uuid.uuid4().hex}"
    over, done = threading.Event(), threading.Event()

    def stop() -> None:
        over.set()
        while not done.wait(0.5):  # a query may still be planning: jobs that start late are cancelled too
            context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop) if seconds is not None else None
    if timer:
        timer.daemon = True
    context.addJobTag(tag)
    began = time.monotonic()
    if timer:
        timer.start()
    try:
        return act(df)
    except Exception as e:
        if over.is_set():
            raise QueryRejected(f"wall time: over {seconds} s after {time.monotonic() - began:.1f} s") from e
        raise
    finally:
        done.set()
        if timer:
            timer.cancel()
        context.removeJobTag(tag)
