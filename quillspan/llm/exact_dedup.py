"""Exact duplicates by counting quotient filters and byte verification.

Each partition puts the 64-bit fingerprints of its texts into a counting
quotient filter: the quotient (high bits) says where a remainder (low bits)
stands, remainders are sorted within a quotient, and each has a count. As
quotient and remainder together are the whole fingerprint, filters merge
losslessly by merging their sorted remainders and adding counts. The filters are
cut at quotient bounds so that many tasks merge, each its own range. Only texts
whose fingerprint has a count above one go on to the comparison of bytes.

Defined results: a null text equals no other and is never a duplicate; empty
texts equal each other; of equal texts the smallest ``doc_id`` stays (null ids
last); repeated rows are duplicates of each other; an empty table gives an empty
result; columns beside ``doc_id`` and ``text`` are kept as they are, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm import shared

QUOTIENT_BITS = 20
_LOW = np.uint64(64 - QUOTIENT_BITS)


class CountingQuotientFilter:
    """Sorted quotients (those occupied), run length of each, remainders and counts."""

    def __init__(self, quotients: np.ndarray, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.quotients, self.runs, self.remainders, self.counts = quotients, runs, remainders, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        """From fingerprints in any order; equal ones add up. A stable sort merges sorted stretches in linear time."""
        order = np.argsort(fingerprints, kind="stable")
        fp = fingerprints[order]
        n = np.ones(len(fp), np.int64) if counts is None else counts[order]
        new = np.flatnonzero(np.append(True, fp[1:] != fp[:-1])) if len(fp) else np.zeros(0, np.int64)
        total = np.add.reduceat(n, new) if len(new) else n
        fp = fp[new]
        quotients, first = np.unique(fp >> _LOW, return_index=True)
        return cls(quotients.astype(np.uint32), np.diff(np.append(first, len(fp))).astype(np.uint32), fp & ((np.uint64(1) << _LOW) - np.uint64(1)), total)

    def fingerprints(self) -> np.ndarray:
        """The sorted fingerprints: nothing was lost."""
        return (np.repeat(self.quotients.astype(np.uint64), self.runs) << _LOW) | self.remainders

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        return cls.of(np.concatenate([f.fingerprints() for f in filters]), np.concatenate([f.counts for f in filters]))

    def count(self, fingerprint: int) -> int:
        high, low = fingerprint >> int(_LOW), fingerprint & ((1 << int(_LOW)) - 1)
        k = int(np.searchsorted(self.quotients, high))
        if k == len(self.quotients) or self.quotients[k] != high:
            return 0
        lo = int(self.runs[:k].sum())
        run = self.remainders[lo : lo + int(self.runs[k])]
        j = int(np.searchsorted(run, np.uint64(low)))
        return int(self.counts[lo + j]) if j < len(run) and run[j] == low else 0

    def ranges(self, bits: int):
        """(range, filter) for each range of the quotients' leading bits that holds anything."""
        where = self.quotients >> np.uint32(QUOTIENT_BITS - bits)
        starts = np.flatnonzero(np.append(True, where[1:] != where[:-1])) if len(where) else []
        at = np.concatenate([[0], np.cumsum(self.runs)]).astype(np.int64)
        for lo, hi in zip(starts, [*starts[1:], len(where)], strict=True):
            yield int(where[lo]), CountingQuotientFilter(self.quotients[lo:hi], self.runs[lo:hi], self.remainders[at[lo] : at[hi]], self.counts[at[lo] : at[hi]])

    def row(self) -> tuple[bytes, bytes, bytes, bytes]:
        """Four byte strings; a count takes one byte unless some count needs eight."""
        narrow = self.counts.astype(np.uint8) if len(self.counts) and self.counts.max() < 256 else self.counts
        return self.quotients.tobytes(), self.runs.tobytes(), self.remainders.tobytes(), narrow.tobytes()

    @classmethod
    def from_row(cls, quotients: bytes, runs: bytes, remainders: bytes, counts: bytes) -> CountingQuotientFilter:
        left = np.frombuffer(remainders, np.uint64)
        return cls(np.frombuffer(quotients, np.uint32), np.frombuffer(runs, np.uint32), left, np.frombuffer(counts, np.uint8 if len(counts) == len(left) else np.int64).astype(np.int64))


def repeated_fingerprints(fingerprints: DataFrame) -> DataFrame:
    """Column ``fp`` (long): fingerprints that occur more than once, by merging one filter a partition."""
    spark = fingerprints.sparkSession
    bits = min(QUOTIENT_BITS, max(0, (shared.partitions(spark) - 1).bit_length()))
    fields = ["quotients", "runs", "remainders", "counts"]

    def build(batches):
        got = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]
        if not got:
            return
        parts = list(CountingQuotientFilter.of(np.concatenate(got).view(np.uint64)).ranges(bits))
        rows = [f.row() for _, f in parts]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), *(pa.array(list(c), pa.binary()) for c in zip(*rows, strict=True))], ["part", *fields])

    def merge(group: pa.Table) -> pa.Table:
        whole = CountingQuotientFilter.merge([CountingQuotientFilter.from_row(*r) for r in zip(*(group.column(c).to_pylist() for c in fields), strict=True)])
        return pa.table({"fp": whole.fingerprints()[whole.counts > 1].view(np.int64)})

    filters = fingerprints.select(F.col(fingerprints.columns[0]).cast("long")).mapInArrow(build, "part int, quotients binary, runs binary, remainders binary, counts binary")
    return filters.groupBy("part").applyInArrow(merge, "fp long")


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    fp = shared.spare(docs.columns, "fp")
    return docs.withColumn(fp, F.when(F.col("text").isNotNull(), F.xxhash64("text"))), fp


def _repeated(docs: DataFrame) -> DataFrame:
    hashed = docs.where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("fp"))
    return shared.table(repeated_fingerprints(hashed), "repeated")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, copies`` for every document whose text some other row has too, byte for byte."""
    repeated = shared.small(_repeated(docs))
    hashed = docs.where(F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("fp")).join(repeated, "fp")
    # Partial aggregation leaves one row a distinct text and task: a text of thousands of copies is not shuffled thousands of times.
    groups = shared.table(hashed.groupBy("fp", "text").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("copies")).withColumn("texts", F.count(F.lit(1)).over(Window.partitionBy("fp"))).select("fp", "keep_id", "copies", "texts"), "groups")
    members = hashed.select("doc_id", "fp")
    alone = groups.where((F.col("texts") == 1) & (F.col("copies") > 1)).drop("texts")
    out = members.join(shared.small(alone), "fp").select("doc_id", "keep_id", "copies")
    clash = groups.where("texts > 1").select("fp").distinct()
    if clash.limit(1).count():  # different texts of one fingerprint: their bytes decide
        w = Window.partitionBy("fp", "text")
        rest = hashed.join(shared.small(clash), "fp").select("doc_id", F.min("doc_id").over(w).alias("keep_id"), F.count(F.lit(1)).over(w).alias("copies"))
        out = out.unionByName(rest.where("copies > 1"))
    return out


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each distinct text, all columns kept; only texts with a repeated fingerprint are moved and compared."""
    keyed, fp = _keyed(docs)
    other = shared.spare([*docs.columns, fp], "repeated_fp")
    repeated = shared.small(_repeated(docs).withColumnRenamed("fp", other))
    rank = shared.spare([*docs.columns, fp], "rank")
    lone = keyed.join(repeated, F.col(fp) == F.col(other), "left_anti")
    w = Window.partitionBy(fp, "text").orderBy(F.col("doc_id").asc_nulls_last())
    first = keyed.join(repeated, F.col(fp) == F.col(other), "left_semi").withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1)
    return lone.select(*docs.columns).unionByName(first.select(*docs.columns))
