"""Best-fit packing with large-item matching.

Only the lengths matter for a packing, and there are at most ``capacity`` of
them, so the packing is made on their histogram: a plan whose size depends on
the capacity, never on the number of documents. Items above a third of the
capacity are paired greedily, at most two a bin: the longest left with the
longest that still fits beside it. Shorter ones then go, longest first, into the
bin with the smallest gap that takes them, and into new bins when none does. The
documents of a length are then dealt to its places by rank.

Defined results: a null or empty text has length 0 and comes back with a null
bin; a text longer than the capacity is cut into full pieces, a bin each, and a
rest that is packed; equal lengths are dealt by ``doc_id`` (nulls first) and
piece; repeated rows are packed as often as they occur; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm import shared

CAPACITY = 2048
#: Items ranked by one task within a length.
RANKED = 4_000_000


def estimated_tokens(text: Column) -> Column:
    """Four bytes a token, rounded up: a length that needs no tokenizer. Callers with token counts pass those."""
    return F.ceil(F.octet_length(text) / F.lit(4)).cast("long")


def plan(histogram: Mapping[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Places (length, first rank, end rank, first bin, items a bin, offset): item ``r`` of a length is in bin first + (r - first rank) // items a bin."""
    left = {k: n for k, n in histogram.items() if n > 0}
    if any(not 0 < k <= capacity for k in left):
        raise ValueError("lengths must be from 1 to the capacity")
    dealt: dict[int, int] = defaultdict(int)
    places: list[tuple[int, int, int, int, int, int]] = []
    open_bins: dict[int, list[tuple[int, int]]] = defaultdict(list)
    gaps: list[int] = []
    bins = 0

    def place(length: int, n: int, first: int, each: int, offset: int) -> None:
        places.append((length, dealt[length], dealt[length] + n, first, each, offset))
        dealt[length] += n
        left[length] -= n

    def reopen(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in open_bins:
                insort(gaps, gap)
            open_bins[gap].append((first, n))

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        k = bisect_left(large, capacity - a + 1) - 1
        while k >= 0 and not left[large[k]]:
            k -= 1
        if k < 0:
            n = left[a]
            place(a, n, bins, 1, 0)
            reopen(capacity - a, bins, n)
        elif (b := large[k]) == a:
            n = left[a] // 2
            if n:
                place(a, 2 * n, bins, 2, 0)
                reopen(capacity - 2 * a, bins, n)
            else:  # the last one of its length: next shorter partner, or alone
                del large[k]
                k -= 1
                while k >= 0 and not left[large[k]]:
                    k -= 1
                n = 1
                place(a, 1, bins, 1, 0)
                if k >= 0:
                    place(large[k], 1, bins, 1, a)
                reopen(capacity - a - (large[k] if k >= 0 else 0), bins, 1)
        else:
            n = min(left[a], left[b])
            place(a, n, bins, 1, 0)
            place(b, n, bins, 1, a)
            reopen(capacity - a - b, bins, n)
        bins += n
    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[length]:
            k = bisect_left(gaps, length)
            if k == len(gaps):
                each = capacity // length
                full, rest = divmod(left[length], each)
                if full:
                    place(length, full * each, bins, each, 0)
                    reopen(capacity - each * length, bins, full)
                if rest:
                    place(length, rest, bins + full, each, 0)
                    reopen(capacity - rest * length, bins + full, 1)
                bins += full + bool(rest)
                continue
            gap = gaps[k]
            first, n = open_bins[gap].pop()
            each = gap // length
            full = min(n, left[length] // each)
            rest = min(left[length] - full * each, each - 1) if full < n else 0
            if full:
                place(length, full * each, first, each, capacity - gap)
            if rest:
                place(length, rest, first + full, each, capacity - gap)
            used = full + bool(rest)
            if n > used:
                open_bins[gap].append((first + used, n - used))
            elif not open_bins[gap]:
                del open_bins[gap], gaps[k]
            reopen(gap - each * length, first, full)
            if rest:
                reopen(gap - rest * length, first + full, 1)
    return places


def pack(docs: DataFrame, capacity: int = CAPACITY, length: Column | None = None) -> DataFrame:
    """``doc_id, piece, n_tokens, bin_id, bin_offset``: where each document, or each piece of a long one, goes."""
    spark = docs.sparkSession
    size = estimated_tokens(F.col("text")) if length is None else length.cast("long")
    sized = docs.select("doc_id", F.coalesce(size, F.lit(0)).alias("size"))
    last = F.greatest(F.ceil(F.col("size") / F.lit(capacity)).cast("long"), F.lit(1)) - 1
    items = shared.table(sized.select("doc_id", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece")).select("doc_id", F.col("piece").cast("int").alias("piece"), F.least(F.lit(capacity), F.col("size") - F.col("piece") * capacity).cast("int").alias("n_tokens")), "items")
    histogram = {r["n_tokens"]: r["count"] for r in items.where("n_tokens > 0").groupBy("n_tokens").count().collect()}  # at most capacity rows
    places = spark.createDataFrame(plan(histogram, capacity), "n_tokens int, lo long, hi long, first long, each long, at long")
    buckets = -(-sum(histogram.values()) // RANKED) or 1
    keyed = items.where("n_tokens > 0").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("n_tokens", "bucket").count().select("n_tokens", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    ranked = keyed.withColumn("rank", F.row_number().over(Window.partitionBy("n_tokens", "bucket").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(offsets, ["n_tokens", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    # The plan's size depends on the capacity alone: it may be broadcast whatever the number of documents.
    placed = ranked.join(F.broadcast(places), ["n_tokens"]).where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    k = F.col("rank") - F.col("lo")
    placed = placed.select("doc_id", "piece", "n_tokens", (F.col("first") + F.floor(k / F.col("each"))).cast("long").alias("bin_id"), (F.col("at") + F.pmod(k, F.col("each")) * F.col("n_tokens")).cast("int").alias("bin_offset"))
    none = items.where("n_tokens = 0").select("doc_id", "piece", "n_tokens", F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("int").alias("bin_offset"))
    return placed.unionByName(none)
