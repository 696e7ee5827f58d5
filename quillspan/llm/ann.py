"""Nearest neighbours of every vector by additive quantisation.

A vector is approximated by the sum of one codeword from each of ``BOOKS``
codebooks, all of full dimension. Codebooks are trained on residuals and refined
by least squares on the codes; encoding is a beam search over the books. With the
codes goes the squared norm of the approximation, so that a query needs one
lookup a book and no cross terms:

    |q - x|^2 = |q|^2 - 2 sum_m <q, c_m> + |x|^2.

In front stands a coarse partition: k-means on the training sample gives about one cell
for ``CELL_ROWS`` rows, ``CELLS`` at most, each row is in the cell of the nearest centre, and a
query goes to the cells with the nearest centres. How many is measured: the fewest
with which the training sample, searched for ``TRIED`` of its own vectors, has a recall of
``RECALL`` against brute force; the whole table is denser, so its neighbours are nearer.
Clustered vectors need few cells; vectors spread evenly need most of them.

Queries and rows of a cell meet in blocks, by an equality join on cell and blocks; a large cell
is many blocks. In each block the best ``RERANK`` by lookup are ranked by exact
distance. A vector's distance from its approximation is kept with its codes: the lookup
distance less this error is the least that its true distance can be, and whatever isn't
beyond the k-th exact distance by it is ranked as well. So within the cells searched the
neighbours are exact, copies and ties included; codes that tell a group apart badly cost
time, not neighbours. A query whose cells have too few rows tries more. Of equal vectors only the ``k + 1`` smallest rows are indexed, as no
query can have more of them as neighbours, and equal queries are answered once.

Codebooks and cells are trained on at most ``TRAIN`` vectors, chosen by hash.

Defined results: rows whose vector is null, empty, of another dimension than most,
or has a null or non-finite element are neither queries nor answers; a row isn't
its own neighbour but equal vectors of other rows are, at distance 0; ties go to
the smaller row; ids may be null or repeat, as rows are told apart by themselves;
with fewer than ``NEIGHBOURS`` others all of them come; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm import shared

BOOKS, WORDS, BEAM = 16, 256, 4
TRAIN, SWEEPS, REFINE = 8192, 6, 1
NEIGHBOURS, RERANK = 10, 256
BASE_ROWS, QUERY_ROWS = 16_384, 2_048
CELL_ROWS, CELLS, TRIED, RECALL = 4_096, 1_024, 256, 0.97


@dataclass
class Quantiser:
    """``books``: (books, words, dimension)."""

    books: np.ndarray

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes (rows, books) by beam search: after each book the best partial sums live on."""
        n, books = len(x), len(self.books)
        out = np.empty((n, books), np.uint8)
        for lo in range(0, n, 1024):
            part = x[lo : lo + 1024]
            left = part[:, None, :]  # residuals of the beam
            codes = np.zeros((len(part), 1, 0), np.uint8)
            for book in self.books:
                cost = (left**2).sum(2)[:, :, None] - 2 * left @ book.T + (book**2).sum(1)
                flat = cost.reshape(len(part), -1)
                keep = min(beam, flat.shape[1])
                best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
                at, word = best // len(book), best % len(book)
                rows = np.arange(len(part))[:, None]
                left = left[rows, at] - book[word]
                codes = np.concatenate([codes[rows, at], word[:, :, None].astype(np.uint8)], axis=2)
            first = (left**2).sum(2).argmin(axis=1)
            out[lo : lo + 1024] = codes[np.arange(len(part)), first]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), self.books.shape[2]), np.float32)
        for m, book in enumerate(self.books):
            out += book[codes[:, m]]
        return out


def train(x: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 3) -> Quantiser:
    """Residual k-means book by book, then least squares on the codes of a beam search."""
    rng = np.random.default_rng(seed)
    words = max(1, min(words, len(x)))
    left, made = x.copy(), []
    for _ in range(books):
        book = left[rng.choice(len(left), words, replace=False)].copy()
        for _ in range(SWEEPS):
            near = ((book**2).sum(1) - 2 * left @ book.T).argmin(axis=1)
            count = np.bincount(near, minlength=words)
            total = np.zeros_like(book)
            np.add.at(total, near, left)
            some = count > 0
            book[some] = total[some] / count[some, None]
            book[~some] = left[rng.choice(len(left), int((~some).sum()))]
        near = ((book**2).sum(1) - 2 * left @ book.T).argmin(axis=1)
        left = left - book[near]
        made.append(book)
    found = Quantiser(np.stack(made).astype(np.float32))
    for _ in range(REFINE):
        codes = found.encode(x).astype(np.int64) + np.arange(books) * words
        gram = np.zeros((books * words, books * words), np.float32)
        for a in range(books):
            for b in range(books):
                np.add.at(gram, (codes[:, a], codes[:, b]), 1)
        side = np.zeros((books * words, x.shape[1]), np.float32)
        for a in range(books):
            np.add.at(side, codes[:, a], x)
        old = found.books.reshape(-1, x.shape[1])
        # Regularised towards the present books: rare codewords stay where they are.
        gram[np.diag_indices_from(gram)] += 1
        found = Quantiser(np.linalg.solve(gram, side + old).reshape(books, words, -1).astype(np.float32))
    return found


def search(quantiser: Quantiser, query: np.ndarray, query_row: np.ndarray, base: np.ndarray, base_row: np.ndarray, codes: np.ndarray, norms: np.ndarray, errors: np.ndarray, k: int = NEIGHBOURS, rerank: int = RERANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query number, base row and exact squared distance of each query's best ``k`` in a block."""
    rows, found, far = [], [], []
    books = quantiser.books
    take = min(rerank + 1, len(base))
    wide = base.astype(np.float64)
    squares = (wide**2).sum(axis=1)
    reach = np.sqrt((books.astype(np.float64) ** 2).sum(axis=2).max(axis=1)).sum()
    for lo in range(0, len(query), 64):
        q, own = query[lo : lo + 64], query_row[lo : lo + 64]
        score = np.repeat(norms[:, None], len(q), axis=1)
        for m in range(len(books)):
            score += (-2 * books[m] @ q.T)[codes[:, m]]  # the table's rows, one for each code
        score = score.T.copy()
        near = np.argpartition(score, take - 1, axis=1)[:, :take]
        exact = ((wide[near] - q[:, None, :]) ** 2).sum(axis=2)
        exact[base_row[near] == own[:, None]] = np.inf
        limit = np.partition(exact, k - 1, axis=1)[:, k - 1] if take >= k else np.full(len(q), np.inf)
        # What may be as near as the k-th of these; slack for the rounding of the lookups.
        size = (q.astype(np.float64) ** 2).sum(axis=1)
        slack = 1e-5 * (np.sqrt(size) + reach) ** 2
        least = np.sqrt(np.maximum(score + (size - slack)[:, None], 0)) - errors * 1.00001
        may = least <= np.sqrt(limit)[:, None]
        some = np.flatnonzero(may.any(axis=0))
        product = squares[some] + size[:, None] - 2 * q.astype(np.float64) @ wide[some].T
        may = may[:, some] & (product <= (limit + 1e-9 * (size + squares.max()))[:, None])
        for i in range(len(q)):
            at = some[may[i]]
            at = at[base_row[at] != own[i]]
            true = ((wide[at] - q[i]) ** 2).sum(axis=1)
            order = np.lexsort((base_row[at], true))[:k]
            far.append(true[order])
            found.append(base_row[at[order]])
            rows.append(np.full(len(order), lo + i))
    r, f, d = (np.concatenate([x.ravel() for x in z]) for z in (rows, found, far))
    return r, f, d


def _nearest_centres(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centres of each vector, nearest first (rows, n)."""
    far = (centres**2).sum(1) - 2 * x @ centres.T
    near = np.argpartition(far, n - 1, axis=1)[:, :n] if n < len(centres) else np.tile(np.arange(len(centres)), (len(x), 1))
    return np.take_along_axis(near, np.take_along_axis(far, near, 1).argsort(axis=1, kind="stable"), 1)


def partition(x: np.ndarray, cells: int, k: int = NEIGHBOURS, seed: int = 5) -> tuple[np.ndarray, int]:
    """Centres of the cells, by k-means on the sample, and how many of them a query has to try."""
    rng = np.random.default_rng(seed)
    cells = max(1, min(cells, len(x) // 8))
    centres = x[rng.choice(len(x), cells, replace=False)].copy()
    for _ in range(10 if cells > 1 else 0):
        cell = _nearest_centres(x, centres, 1)[:, 0]
        count = np.bincount(cell, minlength=cells)
        total = np.zeros_like(centres)
        np.add.at(total, cell, x)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
        centres[count == 0] = x[rng.choice(len(x), int((count == 0).sum()))]
    if cells == 1 or len(x) <= k:
        return centres, cells
    cell = _nearest_centres(x, centres, 1)[:, 0]
    tried = rng.choice(len(x), min(TRIED, len(x)), replace=False)
    far = ((x[tried] ** 2).sum(1)[:, None] + (x**2).sum(1) - 2 * x[tried] @ x.T)
    far[np.arange(len(tried)), tried] = np.inf
    true = np.argpartition(far, k - 1, axis=1)[:, :k]
    order = _nearest_centres(x[tried], centres, cells)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(cells)[None].repeat(len(tried), 0), 1)
    needed = np.take_along_axis(place, cell[true], 1).ravel()  # how many cells find each true neighbour, less one
    return centres, int(np.quantile(needed, RECALL, method="higher")) + 1


def _block_columns(quantiser: Quantiser | None, x: np.ndarray) -> list[bytes]:
    if quantiser is None:
        return []
    codes = quantiser.encode(x)
    near = quantiser.decode(codes)
    return [codes.tobytes(), (near**2).sum(1).astype(np.float32).tobytes(), np.sqrt(((x - near).astype(np.float64) ** 2).sum(1)).tobytes()]


def _blocks(rows: DataFrame, count: DataFrame, size: int, part: str, quantiser: Quantiser | None = None) -> DataFrame:
    """One row for each block of about ``size`` rows of a cell: ``cell, <part>, ids, vectors`` and, with a quantiser, ``codes, norms, errors``, as bytes."""
    sent = rows.sparkSession.sparkContext.broadcast(quantiser)
    names = ["ids", "vectors", *(["codes", "norms", "errors"] if quantiser else [])]

    def block(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        x = group["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(group), -1)
        values = [group["row"].to_numpy().tobytes(), x.tobytes(), *_block_columns(sent.value, x)]
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int32()), part: pa.array([key[1].as_py()], pa.int32())} | {n: pa.array([v], pa.binary()) for n, v in zip(names, values, strict=True)})

    schema = f"cell int, {part} int, " + ", ".join(f"{n} binary" for n in names)
    cut = rows.join(F.broadcast(count), "cell").withColumn(part, F.pmod(F.xxhash64("row", F.lit(9)), F.ceil(F.col("n") / size)).cast("int"))
    return cut.select("cell", part, "row", "vector").groupBy("cell", part).applyInArrow(block, schema)


def nearest(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = NEIGHBOURS, rerank: int = RERANK, queries: Column | None = None) -> DataFrame:
    """``vec_id, rank, neighbour_id, distance`` of the ``k`` nearest others of every row, or of those where ``queries`` holds."""
    spark = table.sparkSession
    kind = dict(table.dtypes)[id_column]
    v = F.col(vector_column)
    asked = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    whole = table.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("vec_id"), v.cast("array<float>").alias("vector"), asked.alias("asked"))
    fit = whole.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    fit = shared.table(fit, "vectors")
    sizes = fit.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").head()
    if sizes is None:
        return spark.createDataFrame([], f"vec_id {kind}, rank int, neighbour_id {kind}, distance double")
    dimension, count = sizes["n"], sizes["count"]
    fit = fit.where(F.size("vector") == dimension)
    luck = F.pmod(F.xxhash64("row", F.lit(5)), F.lit(1_000_003)) / F.lit(1_000_003)
    sample = fit.where(luck <= min(1.0, 1.2 * TRAIN / count)).orderBy(F.xxhash64("vector"), "row").limit(TRAIN).select("vector").toArrow()["vector"].combine_chunks()
    sample = sample.flatten().to_numpy().astype(np.float32).reshape(-1, dimension)
    quantiser = train(sample)
    centres, probes = partition(sample, min(CELLS, max(1, count // CELL_ROWS)), k)
    sent = spark.sparkContext.broadcast(quantiser.books)
    sent_centres = spark.sparkContext.broadcast(centres)

    def cells(sizes: np.ndarray | None):
        """The cell of each vector, or, with the cells' sizes, the cells to try: ``probes`` of them, or more until they have enough rows."""

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(batch.num_rows, -1)
                    near = _nearest_centres(x, sent_centres.value, 1 if sizes is None else len(sizes)).astype(np.int32)
                    n = np.ones(len(x), np.int64) if sizes is None else np.clip((np.cumsum(sizes[near], axis=1) <= k).sum(axis=1) + 1, min(probes, len(sizes)), len(sizes))
                    each = np.repeat(np.arange(batch.num_rows), n)
                    place = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                    yield pa.RecordBatch.from_arrays([pa.array(near[each, place]), batch.column(0).take(pa.array(each)), batch.column(1).take(pa.array(each))], ["cell", "row", "vector"])

        return run

    alike = ["hash", "vector"]
    hashed = fit.withColumn("hash", F.xxhash64("vector"))
    # Of equal vectors the smallest rows; they are picked within tasks before anything is shuffled.
    few = hashed.withColumn("n", F.row_number().over(Window.partitionBy(*alike).orderBy("row"))).where(F.col("n") <= k + 1).select("row", "vector")
    held = shared.table(few.mapInArrow(cells(None), "cell int, row long, vector array<float>"), "cells")
    asking = hashed.where("asked").select(*alike, "row", "vec_id")
    distinct = shared.table(asking.groupBy(*alike).agg(F.min("row").alias("row")), "queries")
    of_base = held.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    sizes_ = np.zeros(len(centres), np.int64)
    for r in of_base.collect():
        sizes_[r["cell"]] = r["n"]
    sent_out = shared.table(distinct.select("row", "vector").mapInArrow(cells(sizes_), "cell int, row long, vector array<float>"), "probes")
    of_queries = sent_out.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))  # at most ``CELLS`` rows each
    base = shared.table(_blocks(held, of_base, BASE_ROWS, "part", quantiser), "base")
    ask = shared.table(_blocks(sent_out, of_queries, QUERY_ROWS, "turn"), "asked").select("cell", "turn", F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors"))

    def run(batches):
        q = Quantiser(sent.value)
        for batch in batches:
            for ids, vectors, codes, norms, errors, query_ids, query_vectors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = np.frombuffer(query_ids, np.int64)
                code = np.frombuffer(codes, np.uint8).reshape(-1, len(q.books))
                n, found, far = search(q, np.frombuffer(query_vectors, np.float32).reshape(-1, dimension), np.full(len(rows), -1), np.frombuffer(vectors, np.float32).reshape(-1, dimension), np.frombuffer(ids, np.int64), code, np.frombuffer(norms, np.float32), np.frombuffer(errors, np.float64), k + 1, rerank)
                yield pa.RecordBatch.from_arrays([pa.array(rows[n]), pa.array(found), pa.array(far)], ["row", "other", "far"])

    # Every pair of blocks of a cell has a key of its own, so that a large cell is as many pieces of work as it has pairs.
    turns = of_queries.select("cell", F.sequence(F.lit(0), F.ceil(F.col("n") / QUERY_ROWS).cast("int") - 1).alias("turns"))
    parts = of_base.select("cell", F.sequence(F.lit(0), F.ceil(F.col("n") / BASE_ROWS).cast("int") - 1).alias("parts"))
    left = base.join(F.broadcast(turns), "cell").withColumn("turn", F.explode("turns")).drop("turns")
    right = ask.join(F.broadcast(parts), "cell").withColumn("part", F.explode("parts")).drop("parts")
    pairs = left.join(right.hint("merge"), ["cell", "part", "turn"]).select("ids", "vectors", "codes", "norms", "errors", "query_ids", "query_vectors")
    found = shared.table(pairs.mapInArrow(run, "row long, other long, far double"), "found")
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("row").orderBy("far", "other"))).where(F.col("n") <= k + 1).select(F.col("row").alias("first"), "other", "far")
    # Back to all rows that asked: each leaves itself out.
    members = asking.join(distinct.select(*alike, F.col("row").alias("first")), alike).select("row", "vec_id", "first")
    mine = members.join(best, "first").where("row <> other")
    ranked = mine.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy("far", "other"))).where(F.col("rank") <= k)
    others = fit.select(F.col("row").alias("other"), F.col("vec_id").alias("neighbour_id"))
    return ranked.join(others, "other").select("vec_id", "rank", "neighbour_id", F.sqrt("far").alias("distance"))
