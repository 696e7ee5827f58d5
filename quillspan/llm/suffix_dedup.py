"""Long passages that repeat across documents, by a logarithmic family of suffix arrays.

A suffix begins at each word and is ordered by its words (their 32-bit hashes), one by
one. Two suffixes that agree in ``long`` words are a long match. A new batch of suffixes
gets its array, sorted by pairs of words, deeper where they tie, with the number of
words that neighbours share (LCP). It is merge-scanned against every level of the
index: a binary search that keeps the shared words of both bounds finds each suffix's
place, and how many words it shares with its neighbours there; whoever shares
``long`` with it stands beside it. Then it goes in as a level of its own, and levels
of about equal size merge, in linear time as places and shared words are known. So
there are at most logarithmically many levels and each suffix moves logarithmically
often.

Families work apart, by anchor: that of a suffix is the least hash of the ``GRAM``-word
runs within its first ``long`` words, which equal suffixes share. Successive suffixes
mostly have one anchor and travel as one window of words, of ``long`` suffixes at most:
orders and shared words go as deep as the windows, under twice ``long``.

``repeated_passages`` answers for one table. A first pass counts anchors; only suffixes
whose anchor occurs in two documents or more, which every long match's are, are sent.
Anchors of over ``HOT`` runs would make one large family; their suffixes are grouped by
a 128-bit name of their first ``long`` words instead, aggregated before they are
shuffled, which finds the same. ``PassageIndex`` keeps the levels in storage: batches
are added one at a time and matched with all before.

Defined results: a passage counts if it stands in at least two rows of different
``doc_id`` (rows, where ids are null or repeat); null texts, empty ones and those
under ``long`` words have no spans; copies of a whole text are one span each; a
passage that repeats only within one document has none; overlapping and adjacent
matches are one span; of several partners the smallest id is given; an empty table
gives an empty result; further columns are ignored. Words are runs of
characters between white space, compared byte by byte through their hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.llm import shared, textbuf

LONG, GRAM = 50, 10
#: Suffixes of a batch that enters a family.
BATCH = 1 << 18
#: Words that a task holds before it sends them.
HELD = 1 << 21
#: Runs of one anchor beyond which its suffixes are grouped by name.
HOT = 200_000
NOBODY = np.iinfo(np.int64).max
_INVERSE = np.uint64(pow(int(textbuf._P), -1, 1 << 64))


def prefix_sums(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of hash times power, and inverse powers: any run of words has its name from two of the sums."""
    n = len(h)
    inverse = np.full(n + 1, _INVERSE, np.uint64)
    inverse[0] = 1
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * textbuf.powers(n)[:n], dtype=np.uint64)]), np.multiply.accumulate(inverse)


def names(sums: np.ndarray, inverse: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Names of the runs of ``n`` words at ``at``."""
    return textbuf.mix((sums[at + n] - sums[at]) * inverse[at])


def anchors(words: textbuf.Words, long: int = LONG, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of at most ``long`` successive suffixes of one row with one anchor: anchor, row, first word within the row, suffixes."""
    gram = min(gram, long)
    n = len(words.hash)
    none = np.zeros(0, np.int64)
    if n < long:
        return none.astype(np.uint64), none, none, none
    sums, inverse = prefix_sums(words.hash)
    least = names(sums, inverse, np.arange(n - gram + 1), gram)
    want, have = long - gram + 1, 1  # least hash of the runs that begin within ``want`` words, by doubling
    while have * 2 <= want:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < want:
        least = np.minimum(least[: len(least) - (want - have)], least[want - have :])
    row = words.row()[: len(least)]
    valid = np.flatnonzero(np.arange(len(least)) + long <= words.first[1:][row])
    if not len(valid):
        return none.astype(np.uint64), none, none, none
    a, r = least[valid], row[valid]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (r[1:] != r[:-1])]))
    n = np.diff(np.append(new, len(valid)))
    pieces = -(-n // long)  # text that repeats itself has one anchor all along
    k = np.arange(pieces.sum()) - np.repeat(np.concatenate([[0], np.cumsum(pieces)])[:-1], pieces)
    new, n = np.repeat(new, pieces) + k * long, np.minimum(np.repeat(n, pieces) - k * long, long)
    return a[new], r[new], valid[new] - words.first[r[new]], n


def _spread(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n, one after another."""
    return np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)])[:-1], n)


def least_others(group: np.ndarray, doc: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and the next document of each group."""
    first, second = np.full(groups, NOBODY), np.full(groups, NOBODY)
    np.minimum.at(first, group, doc)
    more = doc != first[group]
    np.minimum.at(second, group[more], doc[more])
    return first, second


@dataclass
class Level:
    """A suffix array. ``text``: windows of words one after another, 0 behind each; ``at`` and ``end``: first word and window end of each
    suffix, in order; ``doc`` and ``word``: where it stands; ``lcp``: words shared with the one before; ``other``: the smallest other
    document that shares ``long`` words with it."""

    text: np.ndarray
    at: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    word: np.ndarray
    lcp: np.ndarray
    other: np.ndarray

    @classmethod
    def of(cls, doc: np.ndarray, word: np.ndarray, n: np.ndarray, words: np.ndarray, long: int = LONG) -> Level:
        """From windows: document, first word, suffixes, and the ``n + long - 1`` words of each."""
        size = n + long - 1
        begin = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        text = np.zeros(int((size + 1).sum()) + 8, np.uint32)
        text[np.repeat(begin, size) + _spread(size)] = words
        each = _spread(n)
        at, end = np.repeat(begin, n) + each, np.repeat(begin + size, n)
        order, lcp = suffix_order(text, at)
        level = cls(text, at[order], end[order], np.repeat(doc, n)[order], (np.repeat(word, n) + each).astype(np.int32)[order], lcp, np.full(len(at), NOBODY))
        group, groups = level.groups(long)
        first, second = least_others(group, level.doc, groups)
        level.other = np.where(level.doc == first[group], second[group], first[group])
        return level

    def __len__(self) -> int:
        return len(self.at)

    def groups(self, long: int) -> tuple[np.ndarray, int]:
        """A number for the suffixes that share ``long`` words, and how many there are."""
        group = np.cumsum(self.lcp < long) - 1 if len(self) else np.zeros(0, np.int64)
        return group, int(group[-1]) + 1 if len(self) else 0

    def locate(self, other: Level) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of each suffix of ``other`` in this array (behind equal ones) and the words it shares with its neighbours there."""
        n = len(other)
        lo, hi = np.full(n, -1), np.full(n, len(self))
        left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        live = np.arange(n) if len(self) else np.zeros(0, np.int64)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less, k = _compare(other.text, other.at[live], self.text, self.at[mid], np.minimum(left[live], right[live]))
            hi[live[less]], right[live[less]] = mid[less], k[less]
            lo[live[~less]], left[live[~less]] = mid[~less], k[~less]
            live = live[hi[live] - lo[live] > 1]
        return hi, left, right

    def scan(self, batch: Level, long: int = LONG) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Note the long matches between this level and a batch on both; places and shared words, for a merge."""
        place, left, right = self.locate(batch)
        met = np.flatnonzero((left >= long) | (right >= long))
        if len(met):
            group, groups = self.groups(long)
            mine = group[np.where(left[met] >= long, place[met] - 1, np.minimum(place[met], len(self) - 1))]
            for own, of_own, theirs, of_theirs in ((batch, met, self, None), (self, None, batch, met)):
                if own is batch:
                    first, second = least_others(group, theirs.doc, groups)
                    at, g = of_own, mine
                else:
                    first, second = least_others(mine, theirs.doc[of_theirs], groups)
                    at, g = np.arange(len(self)), group
                own.other[at] = np.minimum(own.other[at], np.where(own.doc[at] == first[g], second[g], first[g]))
        return place, left, right

    def merge(self, other: Level, found: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> Level:
        """Both in one array, in linear time once the places are known."""
        place, left, right = self.locate(other) if found is None else found
        n, m = len(self), len(other)
        there = place + np.arange(m)
        mine = np.ones(n + m, bool)
        mine[there] = False
        here = np.flatnonzero(mine)
        out = {}
        for f in ("end", "at", "doc", "word", "other"):
            a, b = getattr(self, f), getattr(other, f)
            shift = len(self.text) if f in ("end", "at") else 0
            out[f] = np.empty(n + m, a.dtype)
            out[f][here], out[f][there] = a, b + shift if shift else b
        lcp = np.empty(n + m, self.lcp.dtype)
        lcp[here] = self.lcp
        # The first of those that go to one place follows the neighbour on the left, the others follow each other; the neighbour on the right follows the last.
        same = np.concatenate([[False], place[1:] == place[:-1]]) if m else np.zeros(0, bool)
        lcp[there] = np.where(same, other.lcp, left)
        last = np.flatnonzero(~np.concatenate([same[1:], [False]])) if m else np.zeros(0, np.int64)
        last = last[place[last] < n]
        lcp[there[last] + 1] = right[last]
        return Level(np.concatenate([self.text, other.text]), lcp=lcp, **out)


def _pairs(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The two words at each place in one number; 0 stands behind a window's end."""
    one = text[at].astype(np.uint64)
    return (one << np.uint64(32)) | np.where(one > 0, text[at + 1], 0).astype(np.uint64)


def suffix_order(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``at`` by their words up to their windows' ends, and the words each shares with the one before."""
    n = len(at)
    order, lcp = np.arange(n), np.zeros(n, np.int32)
    group = np.zeros(n, np.int64)  # first place of those that tie so far
    live, depth = np.arange(n), 0
    while len(live) > 1:
        held = order[live]
        key = _pairs(text, at[held] + depth)
        by = np.lexsort((key, group[live]))
        order[live], key = held[by], key[by]
        g = group[live]
        inside = g[1:] == g[:-1]
        parts = inside & (key[1:] != key[:-1])
        cut = live[1:][parts]
        lcp[cut] = depth + (key[1:][parts] >> np.uint64(32) == key[:-1][parts] >> np.uint64(32))
        over = (key & np.uint64(0xFFFFFFFF)) == 0  # ended: ties are equal suffixes
        equal = inside & ~parts & over[1:]
        lcp[live[1:][equal]] = depth + (key[1:][equal] > 0)
        start = np.flatnonzero(np.concatenate([[True], ~inside | parts]))
        many = np.diff(np.append(start, len(live)))
        group[live] = np.repeat(live[start], many)
        live = live[(np.repeat(many, many) > 1) & ~over]
        depth += 2
    return order, lcp


def _compare(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the suffix of ``x`` at ``a`` comes before that of ``y`` at ``b``, and the words they share, ``known`` at least."""
    less, shared_words = np.zeros(len(a), bool), known.copy()
    live, step = np.arange(len(a)), np.arange(8)
    while len(live):
        k = shared_words[live]
        p, q = x[(a[live] + k)[:, None] + step], y[(b[live] + k)[:, None] + step]
        stop = (p != q) | (p == 0)
        at = np.where(stop.any(axis=1), stop.argmax(axis=1), 8)
        shared_words[live] = k + at
        done = np.flatnonzero(at < 8)
        less[live[done]] = p[done, at[done]] < q[done, at[done]]
        live = live[at == 8]
    return less, shared_words


class Family:
    """Levels from large to small; a level is always over twice as large as the next."""

    def __init__(self, levels: list[Level] | None = None, long: int = LONG) -> None:
        self.levels: list[Level] = levels or []
        self.long = long

    def add(self, batch: Level) -> None:
        found = None
        for level in self.levels:
            found = level.scan(batch, self.long)
        self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            last = self.levels.pop()
            self.levels[-1] = self.levels[-1].merge(last, found)
            found = None  # places hold for the batch and the level before it

    def matches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Stretches of suffixes with a long match in another document: document, first word, end word, smallest partner."""
        none = np.zeros(0, np.int64)
        if not self.levels:
            return none, none, none, none
        doc, word, partner = (np.concatenate([getattr(v, f)[v.other != NOBODY] for v in self.levels]) for f in ("doc", "word", "other"))
        order = np.lexsort((word, doc))
        doc, word, partner = doc[order], word[order].astype(np.int64), partner[order]
        if not len(doc):
            return none, none, none, none
        edge = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (word[1:] > word[:-1] + 1)]))
        last = np.append(edge[1:], len(doc)) - 1
        return doc[edge], word[edge], word[last] + self.long, np.minimum.reduceat(partner, edge)


def _anchor_runs(docs: DataFrame, long: int) -> DataFrame:
    """``id, anchor, start, n`` of every run of suffixes."""

    def run(batches):
        for batch in batches:
            offsets, data = textbuf.raw(batch.column(1))
            for lo, hi, off, part in textbuf.chunks(offsets, data):
                a, row, start, n = anchors(textbuf.Words(off, part), long)
                if len(a):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(row)), pa.array(a.view(np.int64)), pa.array(start, pa.int32()), pa.array(n, pa.int32())], ["id", "anchor", "start", "n"])

    return docs.mapInArrow(run, "id long, anchor long, start int, n int")


def _words32(h: np.ndarray) -> np.ndarray:
    """Hashes of words, never 0."""
    return np.maximum((h >> np.uint64(32)).astype(np.uint32), np.uint32(1))


_BLOBS = "shard int, doc binary, word binary, n binary, words binary"


def _cut(batch, k: int = 2):
    """Each chunk of a batch of ``id, text, runs (start, n, shard)``: ids, words, and row, start, n, shard and first word of every run."""
    offsets, data = textbuf.raw(batch.column(1))
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    lists = batch.column(k)
    runs = lists.flatten()
    bound = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    start, n, shard = (runs.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
    for lo, hi, off, part in textbuf.chunks(offsets, data):
        words = textbuf.Words(off, part)
        s = slice(bound[lo], bound[hi])
        row = np.repeat(np.arange(hi - lo), np.diff(bound[lo : hi + 1]))
        yield ids[lo:hi], words, row, start[s], n[s], shard[s], words.first[row] + start[s]


def _suffixes(chosen: DataFrame, long: int) -> DataFrame:
    """From ``id, text, runs (start, n, shard)``: windows of suffixes for each shard."""
    names_ = ["shard", "doc", "word", "n", "words"]

    def blobs(held) -> Iterator[pa.RecordBatch]:
        shard, doc, start, n, words = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(shard, kind="stable")
        size = n + long - 1
        at = np.concatenate([[0], np.cumsum(size)])
        words = words[np.repeat(at[:-1][order], size[order]) + _spread(size[order])]
        shard, doc, start, n = shard[order], doc[order], start[order], n[order]
        cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
        at = np.concatenate([[0], np.cumsum(size[order])])
        rows = [(int(shard[i]), doc[i:j].tobytes(), start[i:j].astype(np.int32).tobytes(), n[i:j].astype(np.int32).tobytes(), words[at[i] : at[j]].tobytes()) for i, j in zip(cut, [*cut[1:], len(shard)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 5))], names_)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for ids, words, row, start, n, shard, first in _cut(batch):
                wide = n + long - 1
                held.append((shard.astype(np.int32), ids[row], start, n, _words32(words.hash)[np.repeat(first, wide) + _spread(wide)]))
                size += int(wide.sum())
                if size >= HELD:
                    yield from blobs(held)
                    held, size = [], 0
        if size:
            yield from blobs(held)

    return chosen.mapInArrow(run, _BLOBS)


def _level(rows: list[tuple], long: int) -> Level:
    doc, word, n, words = (np.concatenate([np.frombuffer(r[k], t) for r in rows]) for k, t in enumerate((np.int64, np.int32, np.int32, np.uint32)))
    return Level.of(doc, word, n.astype(np.int64), words, long)


def _batches(rows) -> Iterator[list[tuple]]:
    """Blobs (doc, word, n, words) by about ``BATCH`` suffixes."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += int(np.frombuffer(r[2], np.int32).sum())
        if size >= BATCH:
            yield held
            held, size = [], 0
    if held:
        yield held


def _families(sent: DataFrame, long: int) -> DataFrame:
    """``id, lo, hi, other`` of matched stretches; a task's blobs enter its family batch by batch."""

    def run(batches):
        family = Family(long=long)
        for held in _batches(r for batch in batches for r in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True)):
            family.add(_level(held, long))
        doc, lo, hi, other = family.matches()
        for k in range(0, len(doc), 100_000):
            s = slice(k, k + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(doc[s], pa.int64()), pa.array(lo[s].astype(np.int32)), pa.array(hi[s].astype(np.int32)), pa.array(other[s], pa.int64())], ["id", "lo", "hi", "other"])

    return sent.mapInArrow(run, "id long, lo int, hi int, other long")


def _named(chosen: DataFrame, long: int) -> DataFrame:
    """``id, lo, name, check`` of every suffix of the runs: two names of its first ``long`` words, 128 bits."""

    def run(batches):
        for batch in batches:
            for ids, words, row, _, n, _, first in _cut(batch):
                sums, inverse = prefix_sums(words.hash)
                at = np.repeat(first, n) + _spread(n)
                each = np.repeat(row, n)
                name, check = names(sums, inverse, at, long), textbuf.mix(names(sums, inverse, at, max(1, long // 2)) * np.uint64(0x9E3779B97F4A7C15) + names(sums, inverse, at + long // 2, long - long // 2))
                for k in range(0, len(at), 100_000):
                    s = slice(k, k + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[each[s]], pa.int64()), pa.array((at[s] - words.first[each[s]]).astype(np.int32)), pa.array(name[s].view(np.int64)), pa.array(check[s].view(np.int64))], ["id", "lo", "name", "check"])

    return chosen.mapInArrow(run, "id long, lo int, name long, check long")


def _by_name(chosen: DataFrame, long: int) -> DataFrame:
    """``id, lo, hi, other`` of the suffixes whose first ``long`` words another document has, by aggregation (no group is gathered)."""
    named = shared.table(_named(chosen, long), "named")
    key = ["name", "check"]
    first = shared.small(shared.table(named.groupBy(*key).agg(F.min("id").alias("first"), F.max("id").alias("most")).where("first <> most").select(*key, "first"), "first"))
    met = named.join(first, key)
    second = shared.small(shared.table(met.where("id <> first").groupBy(*key).agg(F.min("id").alias("second")), "second"))
    return met.join(second, key).select("id", "lo", (F.col("lo") + long).alias("hi"), F.when(F.col("id") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("other"))


def _islands(found: DataFrame) -> DataFrame:
    """Overlapping and adjacent stretches of a document as one: ``id, span_start, span_end, words, other``."""
    order = Window.partitionBy("id").orderBy("lo", "hi")
    islands = found.withColumn("new", F.col("lo") > F.coalesce(F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).withColumn("island", F.sum(F.col("new").cast("int")).over(order))
    spans = islands.groupBy("id", "island").agg(F.min("lo").alias("span_start"), F.max("hi").alias("span_end"), F.min("other").alias("other"))
    return spans.select("id", "span_start", "span_end", (F.col("span_end") - F.col("span_start")).alias("words"), "other")


_INTEGERS = ("bigint", "int", "smallint", "tinyint")


def repeated_passages(docs: DataFrame, long: int = LONG) -> DataFrame:
    """``doc_id, span_start, span_end, words, other_doc_id``: words (from, to before) of every stretch of long matches."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    if dict(docs.dtypes)["doc_id"] in _INTEGERS:
        docs, key = shared.identified(docs)
    else:
        key = "row_number"
        docs = shared.table(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    texts = docs.select(F.col(key).cast("long").alias("id"), "text")
    runs = shared.table(_anchor_runs(texts, long), "runs")
    repeated = shared.table(runs.groupBy("anchor").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("runs")).where("least <> most").select("anchor", (F.col("runs") > HOT).alias("hot")), "anchors")
    hot = bool(repeated.where("hot").limit(1).count())
    shard = F.pmod(F.xxhash64("anchor"), F.lit(4 * shared.partitions(spark))).cast("int")

    def chosen(wanted: DataFrame) -> DataFrame:
        each = runs.join(wanted.select("anchor").hint("shuffle_hash"), "anchor", "left_semi").groupBy("id").agg(F.collect_list(F.struct("start", "n", shard.alias("shard"))).alias("runs"))
        return texts.join(each.hint("shuffle_hash"), "id")

    found = _families(_suffixes(chosen(repeated.where("NOT hot") if hot else repeated), long).repartition(shared.partitions(spark), "shard"), long)
    if hot:
        found = found.unionByName(_by_name(chosen(repeated.where("hot")), long))
    spans = _islands(found)
    if key == "doc_id":
        return spans.select(F.col("id").cast(dict(docs.dtypes)["doc_id"]).alias("doc_id"), "span_start", "span_end", "words", F.col("other").cast(dict(docs.dtypes)["doc_id"]).alias("other_doc_id"))
    ids = docs.select(F.col(key).alias("id"), "doc_id")
    return spans.join(ids, "id").join(ids.select(F.col("id").alias("other"), F.col("doc_id").alias("other_doc_id")), "other").select("doc_id", "span_start", "span_end", "words", "other_doc_id")


class PassageIndex:
    """Families of suffix arrays in storage, to which batches of documents are added.

    A generation is a folder of level rows and one of match rows, written by one job each: the levels that a batch made,
    with the ids of those they replace, and the stretches of long matches that it brought, in its own documents and in
    earlier ones. Levels that others replace are no longer read; a generation counts once its matches are complete, and one that was cut
    off is overwritten. Rows with a null ``doc_id`` or text aren't indexed; ``doc_id`` is an integer and not used twice.
    """

    _FIELDS = [f.name for f in fields(Level)]
    _TYPES = {"text": np.uint32, "at": np.int64, "end": np.int64, "doc": np.int64, "word": np.int32, "lcp": np.int32, "other": np.int64}

    def __init__(self, spark: SparkSession, path: str, shards: int = 64, long: int = LONG):
        self.spark, self.path, self.shards, self.long = spark, path.rstrip("/"), shards, long

    def _there(self, name: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def generations(self) -> int:
        k = 0
        while self._there(f"matches/{k:06d}/_SUCCESS"):
            k += 1
        return k

    def levels(self) -> DataFrame:
        """Level rows that count: ``shard, level, size`` and the arrays as bytes."""
        schema = "shard int, level string, size long, replaces array<string>, " + ", ".join(f"{f} binary" for f in self._FIELDS)
        folders = [f"{self.path}/levels/{k:06d}" for k in range(self.generations())]
        rows = self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        gone = rows.select(F.explode("replaces").alias("level"))
        return rows.join(F.broadcast(gone), "level", "left_anti").select("shard", "level", "size", *self._FIELDS)

    def add(self, docs: DataFrame) -> DataFrame:
        """Index a batch; the spans that its matches make, in its documents and in earlier ones."""
        generation, long, types = self.generations(), self.long, self._TYPES
        names_ = self._FIELDS
        texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), "text")
        shard = F.pmod(F.xxhash64("anchor"), F.lit(self.shards)).cast("int")
        runs = _anchor_runs(texts, long).groupBy("id").agg(F.collect_list(F.struct("start", "n", shard.alias("shard"))).alias("runs"))
        sent = _suffixes(texts.join(runs, "id"), long)

        def grow(left: pa.Table, right: pa.Table) -> pa.Table:
            old = sorted(zip(*(right[c].to_pylist() for c in ("level", *names_)), strict=True), key=lambda r: -len(r[2]))
            known = [(r[0], Level(**{f: np.frombuffer(x, types[f]).copy() for f, x in zip(names_, r[1:], strict=True)})) for r in old]
            for _, level in known:
                level.other[:] = NOBODY  # what earlier batches matched is written already
            family = Family([level for _, level in known], long)
            k = None
            for held in _batches(zip(*(left[c].to_pylist() for c in ("doc", "word", "n", "words")), strict=True)):
                family.add(_level(held, long))
            k = (left["shard"] if len(left) else right["shard"])[0].as_py()
            matches = family.matches()
            kept = {id(level) for level in family.levels}
            replaced = [name for name, level in known if id(level) not in kept]
            before = {id(level) for _, level in known}
            new = [level for level in family.levels if id(level) not in before]
            rows = [(k, f"{generation}-{k}-{i}", len(v), replaced if not i else [], *(getattr(v, f).tobytes() for f in names_), b"", b"", b"", b"") for i, v in enumerate(new)]
            rows.append((k, None, 0, [], *(b"" for _ in names_), *(x.astype(np.int64).tobytes() for x in matches)))
            columns = ["shard", "level", "size", "replaces", *names_, "m_doc", "m_lo", "m_hi", "m_other"]
            return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(zip(columns, [pa.int32(), pa.string(), pa.int64(), pa.list_(pa.string()), *[pa.binary()] * (len(names_) + 4)], strict=True))})

        schema = "shard int, level string, size long, replaces array<string>, " + ", ".join(f"{f} binary" for f in [*names_, "m_doc", "m_lo", "m_hi", "m_other"])
        grown = shared.table(sent.groupBy("shard").cogroup(self.levels().groupBy("shard")).applyInArrow(grow, schema), "grown")
        grown.where("level IS NOT NULL").drop("m_doc", "m_lo", "m_hi", "m_other").write.mode("overwrite").parquet(f"{self.path}/levels/{generation:06d}")

        def stretches(batches):
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in row], ["id", "lo", "hi", "other"])

        found = grown.where("level IS NULL").select("m_doc", "m_lo", "m_hi", "m_other").mapInArrow(stretches, "id long, lo long, hi long, other long")
        found.write.mode("overwrite").parquet(f"{self.path}/matches/{generation:06d}")
        shared.discard(grown)
        return self._spans([generation])

    def _spans(self, generations: list[int]) -> DataFrame:
        schema = "id long, lo long, hi long, other long"
        folders = [f"{self.path}/matches/{k:06d}" for k in generations]
        found = self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        return _islands(found).select(F.col("id").alias("doc_id"), "span_start", "span_end", "words", F.col("other").alias("other_doc_id"))

    def spans(self) -> DataFrame:
        """All spans so far."""
        return self._spans(list(range(self.generations())))
