"""Trace trees as nested sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.schemas import RUN_KEY

NODE = (
    "project_name string, trace_id string, span_id string, run_id string, parent_span_id string, root_span_id string, root_run_id string, depth long, sibling_order long, "
    "subtree_start long, subtree_end long, descendant_count long, unresolved_parent boolean, cycle_detected boolean"
)
_COLUMNS = [c.strip().split()[0] for c in NODE.split(",")]


def _on_cycles(parent: dict[str, str | None]) -> set[str]:
    """Spans that are their own ancestors; every span is walked over once."""
    done: set[str] = set()
    out: set[str] = set()
    for span in parent:
        walk: dict[str, int] = {}
        now: str | None = span
        while now is not None and now in parent and now not in done and now not in walk:
            walk[now] = len(walk)
            now = parent[now]
        if now in walk:
            out.update(list(walk)[walk[now] :])
        done.update(walk)
    return out


def build(runs: list[tuple[str, str | None, str, int]]) -> list[tuple]:
    """Nodes of one trace from (span, parent, run id, start): depth first by (start, span), one counter for both bounds."""
    runs = sorted(runs, key=lambda r: (r[3], r[0]))
    parent = {r[0]: r[1] for r in runs}
    run_id = {r[0]: r[2] for r in runs}
    children: dict[str | None, list[str]] = {}
    flags, cycles = {}, _on_cycles(parent)
    for span, above, _, _ in runs:
        known = above in parent if above is not None else False
        cycle = span in cycles
        flags[span] = (above is not None and not known, cycle)
        children.setdefault(above if known and not cycle else None, []).append(span)
    out: dict[str, list] = {}
    counter = 0
    for order, root in enumerate(children.get(None, [])):
        stack = [(root, None, 0, order, False)]
        while stack:  # no recursion: traces may be deep
            span, above, depth, place, done = stack.pop()
            if done:
                node = out[span]
                node[8] = counter
                counter += 1
                if above is not None:
                    out[above][9] += 1 + node[9]
                continue
            out[span] = [span, run_id[span], above, root, run_id[root], depth, place, counter, 0, 0, *flags[span]]
            counter += 1
            stack.append((span, above, depth, place, True))
            below = children.get(span, [])
            stack += [(c, span, depth + 1, i, False) for i, c in reversed(list(enumerate(below)))]
    return [tuple(v) for v in out.values()]


def _starts(batch: pa.RecordBatch, before: tuple | None) -> np.ndarray:
    """Rows at which a trace begins; ``before`` is the project and trace of the row ahead of the batch."""
    new = np.ones(batch.num_rows, bool)
    new[1:] = False
    new[0] = before != (batch.column(0)[0].as_py(), batch.column(1)[0].as_py())
    for c in (batch.column(0), batch.column(1)):
        here, ahead = c.slice(1), c.slice(0, len(c) - 1)
        new[1:] |= pc.fill_null(pc.not_equal(here, ahead), False).to_numpy(zero_copy_only=False) | (here.is_null().to_numpy(zero_copy_only=False) != ahead.is_null().to_numpy(zero_copy_only=False))
    return np.flatnonzero(new)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches, sorted by trace and project, cut anew so that none ends within a trace."""
    held: list[pa.RecordBatch] = []
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = _starts(batch, before)
        before = (batch.column(0)[-1].as_py(), batch.column(1)[-1].as_py())
        if len(starts):
            yield from _joined([*held, batch.slice(0, starts[-1])])
            held = []
        held.append(batch.slice(starts[-1] if len(starts) else 0))
    yield from _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    parts = [p for p in parts if p.num_rows]
    return parts if len(parts) < 2 else pa.Table.from_batches(parts).combine_chunks().to_batches()


class Forest:
    """Traces that are whole within a batch: columns project, trace, span and parent, sorted by trace and project.

    ``trace`` numbers the traces, ``up`` is the row of the parent (-1: a root), ``known`` whether the parent is there, ``cycle`` whether a run is its
    own ancestor (these are roots). Nothing here loops over rows; only ``levels`` are looped over.
    """

    def __init__(self, batch: pa.RecordBatch):
        n = batch.num_rows
        rows = np.arange(n)
        first = np.zeros(n, np.int64)
        first[_starts(batch, None)] = 1
        self.trace = np.cumsum(first) - 1
        coded = pa.chunked_array([batch.column(2), batch.column(3)]).dictionary_encode().combine_chunks()
        codes = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        key = self.trace * (len(coded.dictionary) + 1)
        span, above = key + codes[:n], key + codes[n:]
        order = np.argsort(span, kind="stable")
        at = np.searchsorted(span[order], above, "right") - 1
        self.given = codes[n:] > 0
        self.known = self.given & (at >= 0) & (span[order[at]] == above)
        up = np.where(self.known, order[at], rows)
        # Pointers are doubled until all are at a root. After as many steps as there are rows, those that aren't are on cycles, and all of these are reached.
        far, steps = up, 1
        while (up[far] != far).any() and steps < 2 * n:
            far, steps = far[far], 2 * steps
        self.cycle = up == np.where(self.known, rows, -1)
        self.cycle[far[up[far] != far]] = True
        up = np.where(self.cycle, rows, up)
        far, depth = up, (up != rows).astype(np.int64)
        while (up[far] != far).any():
            depth, far = depth + depth[far], far[far]
        self.root, self.depth = far, depth
        self.up = np.where(up == rows, -1, up)

    def levels(self) -> list[np.ndarray]:
        """Rows of each depth, without the roots."""
        order = np.argsort(self.depth, kind="stable")
        return np.split(order, np.flatnonzero(np.diff(self.depth[order])) + 1)[1:]

    def descendants(self) -> np.ndarray:
        below = np.zeros(len(self.up), np.int64)
        for rows in reversed(self.levels()):
            np.add.at(below, self.up[rows], 1 + below[rows])
        return below

    def under(self, hit: np.ndarray) -> np.ndarray:
        """Whether a descendant is hit."""
        out = np.zeros(len(hit), bool)
        for rows in reversed(self.levels()):
            out[self.up[rows[hit[rows] | out[rows]]]] = True
        return out

    def over(self, hit: np.ndarray) -> np.ndarray:
        """Whether a child is hit."""
        out = np.zeros(len(hit), bool)
        out[self.up[hit & (self.up >= 0)]] = True
        return out

    def places(self, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each run among its siblings, and of all runs of its trace depth first; siblings stand in order of rows."""
        group = np.where(self.up >= 0, self.up, len(self.up) + self.trace)
        order = np.argsort(group, kind="stable")
        begins = np.flatnonzero(np.diff(group[order], prepend=-1))
        length = np.diff(begins, append=len(order))
        sibling, ahead = np.empty_like(order), np.empty_like(order)
        sibling[order] = np.arange(len(order)) - np.repeat(begins, length)
        sizes = np.cumsum(1 + below[order]) - (1 + below[order])
        ahead[order] = sizes - np.repeat(sizes[begins], length)
        place = ahead
        for rows in self.levels():
            place[rows] += 1 + place[self.up[rows]]
        return sibling, place


def _by_trace(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("project_name", "trace_id").sortWithinPartitions("trace_id", "project_name", *order)


def nodes(heads: DataFrame) -> DataFrame:
    """A node for each run, as ``build`` makes them. Traces are whole within a task; many go through one Python call."""
    run = F.coalesce("run_id", "generated_run_id").alias("run")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole(batches):
            project, trace, span, _, run_id, _ = batch.columns
            f = Forest(batch)
            below = f.descendants()
            sibling, place = f.places(below)
            start = 2 * place - f.depth
            up = pa.array(f.up, mask=f.up < 0)
            columns = [project, trace, span, run_id, span.take(up), span.take(pa.array(f.root)), run_id.take(pa.array(f.root)), f.depth, sibling, start, start + 2 * below + 1, below, f.given & ~f.known, f.cycle]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], _COLUMNS)

    ready = heads.select("project_name", "trace_id", "span_id", "parent_span_id", run, "start_time_unix_nano")
    return _by_trace(ready, "start_time_unix_nano", "span_id").mapInArrow(make, NODE)


#: Runs to return by where the hits stand; of a run itself and of those above it, a hit is no child nor descendant of itself, as cycles are cut.
RELATIONS = {
    "root": lambda f, hit: np.isin(f.trace, f.trace[hit & (f.up < 0)]),
    "child": lambda f, hit: f.over(hit),
    "descendant": lambda f, hit: f.under(hit),
    "own_root": lambda f, hit: hit & (f.up < 0),
    "own_child": lambda f, hit: hit & (f.up == np.arange(len(hit))),
    "self_or_descendant": lambda f, hit: hit | f.under(hit),
}
#: What a hit must be besides for anything of its trace to be returned.
_NEEDED = {"child": "parent_span_id IS NOT NULL", "descendant": "parent_span_id IS NOT NULL", "own_child": "parent_span_id = span_id"}


def related(runs: DataFrame, relation: str) -> DataFrame:
    """Keys of the runs related to a hit; ``runs`` are whole traces, with parents and ``hit``. No pairs of runs.

    The window brings traces together, sorted, unless they are so already (a repartition would shuffle again), and leaves out those where no hit can count.
    """
    test = RELATIONS[relation]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole(batches):
            kept = test(Forest(batch), batch.column(4).to_numpy(zero_copy_only=False).astype(bool))
            yield batch.select([0, 1, 2]).filter(pa.array(kept))

    ready = runs.select(*RUN_KEY, "parent_span_id", F.coalesce("hit", F.lit(False)).alias("hit"))
    counts = F.col("hit") & F.coalesce(F.expr(_NEEDED.get(relation, "true")), F.lit(False))
    linked = ready.withColumn("_linked", F.max(counts).over(Window.partitionBy("trace_id", "project_name"))).where("_linked").drop("_linked")
    return linked.sortWithinPartitions("trace_id", "project_name").mapInArrow(make, "project_name string, trace_id string, span_id string")


def edges(tree: DataFrame) -> DataFrame:
    return tree.where(F.col("parent_span_id").isNotNull()).select("project_name", "trace_id", "parent_span_id", F.col("span_id").alias("child_span_id"), "sibling_order", "depth")


def load(heads: DataFrame, tree: DataFrame, project: str, trace: str) -> DataFrame:
    """One trace's runs with their place in the tree, in tree order."""
    one = (F.col("project_name") == project) & (F.col("trace_id") == trace)
    return tree.where(one).join(heads.where(one).drop("run_id", "parent_span_id", "root_run_id", "root_span_id"), RUN_KEY).orderBy("subtree_start", "start_time_unix_nano", "span_id")


def nested(rows: list[dict]) -> list[dict]:
    """Rows of one page as nested nodes with ``children``: runs whose parent isn't there are roots, as are those that a cycle leaves over."""
    made = {r["span_id"]: r | {"children": []} for r in rows}
    parent = {k: v.get("parent_span_id") for k, v in made.items()}
    roots, cycles = [], _on_cycles(parent)
    for span, node in made.items():
        above = parent[span]
        (made[above]["children"] if above in made and span not in cycles else roots).append(node)
    return roots
