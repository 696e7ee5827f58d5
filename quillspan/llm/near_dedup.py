"""Near duplicates by ProbMinHash, banding and verification.

A text is a weighted set: its word shingles with their number of occurrences.
Each shingle of weight w sends points to the components of the signature at the
times of a process of rate w, earliest first, and stops once it comes later than
every component's present minimum (early termination). Two signatures agree in a
component with the probability Jaccard similarity of the two weighted sets,

    J_P(x, y) = sum over shared i of 1 / sum_j max(x_j / x_i, y_j / y_i).

Texts that agree in a whole band become candidates; candidates are verified with
the exact J_P of their shingles. First every text of a bucket is compared with
the bucket's leader, the text with most candidates, and those unlike it once more
with a leader of their own. Verified pairs make components; then all other
candidate pairs are verified but those within one component, where another edge
would change nothing. No pair of different components is left out, so the groups
are those of all candidate pairs. Verified pairs are joined to groups.

Texts with the same shingles and counts are one node, known by a 64-bit hash.

Defined results: null and empty texts (no words) are never near duplicates; a
text shorter than a shingle has one shingle of all its words; repeated rows and
equal texts are in one group; of a group the row with the smallest ``doc_id``
stays (ties and null ids: any one of them); an empty table gives an empty result;
other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm import shared, textbuf

SHINGLE = 3
COMPONENTS, ROWS = 128, 4
THRESHOLD = 0.5
#: Texts of a bucket that meet in one task; larger buckets are cut, none is capped.
PART = 512


def profiles(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row, sorted, with counts: bounds (rows + 1), hashes, counts."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))) if len(h) else np.zeros(0, np.int64)
    return np.searchsorted(row[new], np.arange(rows + 1)), h[new], np.diff(np.append(new, len(h)))


def signatures(bounds: np.ndarray, h: np.ndarray, weight: np.ndarray, m: int = COMPONENTS) -> np.ndarray:
    """Shape (rows, m): the shingle that reached each component first; 0 for a row without shingles.

    A shingle reaches its components at the order statistics of m exponential
    times of rate ``weight``, in the order of an affine permutation (m a power of
    two): each component by itself sees an exponential arrival of that rate.
    """
    rows = len(bounds) - 1
    row = np.repeat(np.arange(rows), np.diff(bounds))
    least = np.full(rows * m, np.inf)
    out = np.zeros(rows * m, np.uint64)
    base = textbuf.mix(h + np.uint64(0x51_7C_C1_B7))
    step, start = (base | np.uint64(1)) & np.uint64(m - 1), (base >> np.uint64(32)) & np.uint64(m - 1)
    time, live, rate = np.zeros(len(h)), np.arange(len(h)), weight.astype(np.float64)
    for i in range(m):
        if not len(live):
            break
        bits = textbuf.mix(base[live] + np.uint64((0x9E3779B97F4A7C15 * (i + 1)) & (2**64 - 1)))
        t = time[live] - np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (rate[live] * (m - i))
        time[live] = t
        at = row[live] * m + ((start[live] + step[live] * np.uint64(i)) & np.uint64(m - 1)).astype(np.int64)
        np.minimum.at(least, at, t)
        won = t == least[at]
        out[at[won]] = h[live[won]]
        worst = least.reshape(rows, m).max(axis=1)
        live = live[t < worst[row[live]]]
    return out.reshape(rows, m)


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One key for each band of ``rows`` components."""
    n, m = signature.shape
    parts = signature.reshape(n, m // rows, rows)
    key = np.zeros((n, m // rows), np.uint64)
    for i in range(rows):
        key = textbuf.mix(key * np.uint64(31) + parts[:, :, i])
    return textbuf.mix(key + np.arange(m // rows, dtype=np.uint64))


def probability_jaccard(xh: np.ndarray, xw: np.ndarray, yh: np.ndarray, yw: np.ndarray) -> float:
    """Exact J_P of two weighted sets given as sorted distinct hashes and weights, in n log n."""
    if not len(xh) or not len(yh):
        return 0.0
    every = np.union1d(xh, yh)
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, xh)] = xw
    y[np.searchsorted(every, yh)] = yw
    with np.errstate(divide="ignore"):
        ratio = np.where(y > 0, x / np.where(y > 0, y, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    above = np.cumsum(x[::-1])[::-1]  # of the elements from here on
    below = np.concatenate([[0], np.cumsum(y)])[:-1]
    first = np.searchsorted(ratio, ratio, "left")  # equal ratios belong above
    both = (x > 0) & (y > 0)
    at = first[both]
    return float((1 / (above[at] / x[both] + below[at] / y[both])).sum())


def _sign(docs: DataFrame, key: str) -> DataFrame:
    """``id, node, bands`` of every row; node and bands are null where there are no words."""
    names = ["id", "node", "bands"]

    def run(batches):
        for batch in batches:
            offsets, data = textbuf.raw(batch.column(1))
            for lo, hi, off, part in textbuf.chunks(offsets, data):
                words = textbuf.Words(off, part)
                bounds, h, n = profiles(*textbuf.shingles(words, SHINGLE), hi - lo)
                some = np.diff(bounds) > 0
                each = bands(signatures(bounds, h, n))
                whole = np.zeros(hi - lo, np.uint64)
                if len(h):
                    whole[some] = np.add.reduceat(textbuf.mix(h + n.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), bounds[:-1][some])
                node = pa.array(textbuf.mix(whole).view(np.int64), pa.int64(), mask=~some)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, each.size + 1, each.shape[1], dtype=np.int32)), pa.array(each.view(np.int64).ravel()))
                flat = pa.array([None] * 0, flat.type) if not len(flat) else flat
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), node, flat], names)

    return docs.select(F.col(key).alias("id"), "text").mapInArrow(run, f"id {dict(docs.dtypes)[key]}, node long, bands array<long>")


def _blobs(texts: DataFrame) -> DataFrame:
    """``node, blob`` from ``node, text``: the sorted shingles and their counts as bytes."""

    def run(batches):
        for batch in batches:
            offsets, data = textbuf.raw(batch.column(1))
            for lo, hi, off, part in textbuf.chunks(offsets, data):
                bounds, h, n = profiles(*textbuf.shingles(textbuf.Words(off, part), SHINGLE), hi - lo)
                blobs = [h[a:b].tobytes() + n[a:b].astype(np.uint32).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(blobs, pa.binary())], ["node", "blob"])

    return texts.select("node", "text").mapInArrow(run, "node long, blob binary")


def _verify(pairs: DataFrame, blobs: DataFrame) -> DataFrame:
    """``a, b, similarity`` of each pair."""

    def split(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
        n = len(blob) // 12
        return np.frombuffer(blob, np.uint64, n), np.frombuffer(blob, np.uint32, n, 8 * n)

    def run(batches):
        for batch in batches:
            similar = [probability_jaccard(*split(x), *split(y)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(similar, pa.float64())], ["a", "b", "similarity"])

    left = pairs.join(blobs.select(F.col("node").alias("b"), F.col("blob").alias("blob_b")), "b")
    return left.join(blobs.select(F.col("node").alias("a"), F.col("blob").alias("blob_a")), "a").select("a", "b", "blob_a", "blob_b").mapInArrow(run, "a long, b long, similarity double")


def _across(rows: DataFrame) -> DataFrame:
    """Distinct pairs ``a, b`` (``a < b``) of nodes that share a bucket but no component, from ``key, node, label``.

    Buckets are cut into parts that meet pairwise, so that no task has the whole square of a large one."""
    bucket = Window.partitionBy("key")
    rows = rows.withColumn("n", F.count(F.lit(1)).over(bucket)).withColumn("lo", F.min("label").over(bucket)).withColumn("hi", F.max("label").over(bucket)).where("lo < hi")
    rows = rows.withColumn("parts", F.ceil(F.col("n") / PART).cast("int")).select("key", "node", "label", "parts", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"))
    left = rows.select("key", F.col("node").alias("x"), F.col("label").alias("x_label"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = rows.select("key", "part", F.col("node").alias("y"), F.col("label").alias("y_label"))
    return left.join(right, ["key", "part"]).where("x < y AND x_label <> y_label").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def _edges(docs: DataFrame, key: str, signed: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``a, b`` of nodes that join the same groups as all verified candidate pairs."""
    nodes = signed.where("node IS NOT NULL").groupBy("node").agg(F.first("bands").alias("bands"))
    bucket = Window.partitionBy("key")

    def shared_buckets(rows: DataFrame) -> DataFrame:
        return rows.withColumn("n", F.count(F.lit(1)).over(bucket)).where("n > 1")

    def led(rows: DataFrame) -> DataFrame:
        """Each bucket's leader has most candidates over all buckets: an original rather than one of its copies."""
        degree = rows.groupBy("node").agg(F.sum("n").alias("degree"))
        best = F.max(F.struct("degree", "node")).over(bucket)["node"]
        return shared.table(rows.join(degree, "node").withColumn("leader", best).where("node <> leader").select("key", "node", "leader"), "buckets")

    buckets = shared.table(shared_buckets(nodes.select("node", F.explode("bands").alias("key"))), "buckets")
    needed = buckets.select("node").distinct()
    ids = signed.groupBy("node").agg(F.min("id").alias("id")).join(shared.small(needed), "node")
    chosen = shared.small(shared.table(ids, "chosen"))
    blobs = shared.table(_blobs(docs.select(F.col(key).alias("id"), "text").join(chosen, "id")), "blobs")
    rows, checked = buckets, None
    for k in range(2):
        rest = led(rows)
        pairs = rest.select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()
        if k:
            pairs = pairs.join(checked, ["a", "b"], "left_anti")
        now = shared.table(_verify(pairs, blobs), "pairs")
        checked = now if checked is None else checked.unionByName(now)
        if k == 0:
            bad = checked.where(F.col("similarity") < threshold).select("a", "b")
            rest = rest.withColumns({"a": F.least("leader", "node"), "b": F.greatest("leader", "node")})
            rows = shared_buckets(rest.join(shared.small(bad), ["a", "b"]).select("key", "node"))
    labels = shared.table(shared.components(checked.where(F.col("similarity") >= threshold).select("a", "b")), "labels")
    labelled = buckets.select("key", "node").join(shared.small(labels), "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    left = _across(labelled).join(checked.select("a", "b"), ["a", "b"], "left_anti")
    late = shared.table(_verify(left, blobs), "pairs").where(F.col("similarity") >= threshold).select("a", "b")
    return late.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))


def near_duplicate_groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, group_id, group_size`` of every row in a group of two or more; group_id is the smallest doc_id."""
    docs, key = shared.identified(docs)
    grouped = _grouped(docs, key, threshold)
    if key != "doc_id":
        names = docs.select(F.col(key).alias("id"), "doc_id")
        grouped = grouped.join(names, "id")
        grouped = grouped.withColumn("group_id", F.min("doc_id").over(Window.partitionBy("group")))
    else:
        grouped = grouped.withColumn("doc_id", F.col("id")).withColumn("group_id", F.col("first"))
    return grouped.select("doc_id", "group_id", "group_size")


def _grouped(docs: DataFrame, key: str, threshold: float) -> DataFrame:
    signed = shared.table(_sign(docs, key), "signed")
    labels = shared.components(_edges(docs, key, signed, threshold))
    rows = signed.where("node IS NOT NULL").select("id", "node").join(labels, "node", "left").select("id", F.coalesce("label", "node").alias("group"))
    w = Window.partitionBy("group")
    return rows.withColumn("group_size", F.count(F.lit(1)).over(w)).withColumn("first", F.min("id").over(w)).where("group_size > 1")


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each group, all columns kept."""
    columns = docs.columns
    docs, key = shared.identified(docs)
    grouped = _grouped(docs, key, threshold)
    if key != "doc_id":  # the smallest doc_id stays, which isn't the smallest row number
        grouped = grouped.join(docs.select(F.col(key).alias("id"), "doc_id"), "id").withColumn("first", F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "id")).over(Window.partitionBy("group"))["id"])
    gone = shared.small(shared.table(grouped.where("id <> first").select(F.col("id").alias(shared.spare(docs.columns, "gone"))), "gone"))
    return docs.join(gone, docs[key] == gone[gone.columns[0]], "left_anti").select(*columns)
