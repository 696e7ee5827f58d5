"""Full-text and JSON search over postings.

Postings are a long table: one row for each run, path and token with its
positions. Written sorted by token, Parquet's row-group bounds do what a term
directory does. Every predicate yields run keys; AND, OR and NOT are semi-joins,
unions and anti-joins of these.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import text
from quillspan.schemas import RUN_KEY

FIELDS = {"inputs": ("langsmith.inputs", "inputs"), "outputs": ("langsmith.outputs", "outputs"), "extra": ("langsmith.extra", "extra"), "attributes_json": ()}
PSEUDO = ("name", "run_type", "status")


def leaves(heads: DataFrame) -> DataFrame:
    """``project_name, trace_id, span_id, ordinal, path, value``: JSON leaves, and name, run type and status as paths of their own."""
    own = F.array(*[F.struct(F.lit(f"run.{c}").alias("path"), F.col(c).alias("value")) for c in PSEUDO])
    return heads.select(*RUN_KEY, F.posexplode(F.concat(own, text.leaves("attributes_json"))).alias("ordinal", "leaf")).select(*RUN_KEY, "ordinal", "leaf.path", "leaf.value")


def postings(leaf_rows: DataFrame) -> DataFrame:
    """``…, path, token, positions``: positions count kept tokens along a path, with a gap after each leaf so that phrases don't run on."""
    # The limit counts bytes; half a character at the cut is no part of a token, as tokens are ASCII.
    kept = text.tokens(F.when(F.octet_length("value") <= text.MAX_VALUE, F.col("value")).otherwise(F.substring(F.col("value").cast("binary"), 1, text.MAX_VALUE).cast("string")))
    by_leaf = leaf_rows.where(F.col("value").isNotNull()).select(*RUN_KEY, "path", "ordinal", kept.alias("tokens"))
    # A path's leaves of one run come together; the offset of each is the length, with gaps, of those before.
    run = by_leaf.groupBy(*RUN_KEY, "path").agg(F.array_sort(F.collect_list(F.struct("ordinal", "tokens"))).alias("all"))
    flat = F.aggregate("all", F.array().cast("array<string>"), lambda acc, x: F.concat(acc, x["tokens"], F.array(F.lit(None).cast("string"))))
    each = run.select(*RUN_KEY, "path", F.posexplode(flat).alias("position", "token")).where(F.col("token").isNotNull())
    return each.groupBy(*RUN_KEY, "path", "token").agg(F.array_sort(F.collect_list("position")).alias("positions"))


@dataclass
class TextQuery:
    terms: list[str] = field(default_factory=list)
    phrases: list[list[str]] = field(default_factory=list)

    @classmethod
    def parse(cls, query: str) -> TextQuery:
        """Quoted phrases and terms; a quote without end runs to the end."""
        parts = query.split('"')
        phrases = [t for t in (text.tokenise(p) for p in parts[1::2]) if t]
        return cls(sorted(set(text.tokenise(" ".join(parts[::2])))), phrases)


def in_scope(path: Column, scope: Sequence[str], exact: bool = False) -> Column:
    """Paths at or under one of ``scope``; an empty scope is everything but the run's own columns."""
    if not scope:
        return ~path.startswith("run.")
    out = F.lit(False)
    for p in scope:
        out = out | (path == p) | (F.lit(False) if exact else path.startswith(p + "."))
    return out


def _keys(rows: DataFrame) -> DataFrame:
    return rows.select(*RUN_KEY).distinct()


def _back(places: int):
    return lambda p: p - places


def matching_text(posts: DataFrame, query: str, scope: Sequence[str] = (), exact: bool = False) -> DataFrame:
    """Runs with all terms, on any paths in scope, and all phrases, each on one path. An empty query matches nothing."""
    asked = TextQuery.parse(query)
    phrases = [p for p in asked.phrases if len(p) > 1]
    terms = sorted({*asked.terms, *(p[0] for p in asked.phrases if len(p) == 1)})
    words = sorted({*terms, *(t for p in phrases for t in p)})
    rows = posts.where(in_scope(F.col("path"), scope, exact) & (F.col("token").isin(*words) if words else F.lit(False)))
    out = _keys(rows.where(F.col("token").isin(*terms)).groupBy(*RUN_KEY).agg(F.count_distinct("token").alias("n")).where(F.col("n") == len(terms))) if terms else None
    for phrase in phrases:
        # Starts of the phrase on a path are the positions common to all tokens' positions moved back by their place.
        sets = []
        for i, token in enumerate(phrase):
            sets.append(F.transform(F.flatten(F.collect_list(F.when(F.col("token") == token, F.col("positions")))), _back(i)))
        both = sets[0]
        for s in sets[1:]:
            both = F.array_intersect(both, s)
        found = _keys(rows.where(F.col("token").isin(*phrase)).groupBy(*RUN_KEY, "path").agg(both.alias("starts")).where(F.size("starts") > 0))
        out = found if out is None else out.join(found, RUN_KEY, "left_semi")
    return _keys(rows.where(F.lit(False))) if out is None else out


def matching_value(leaf_rows: DataFrame, values: Sequence[str], scope: Sequence[str] = (), exact: bool = False) -> DataFrame:
    """Runs with a leaf in scope whose whole value is one of ``values``."""
    return _keys(leaf_rows.where(in_scope(F.col("path"), scope, exact) & F.col("value").isin(*values) & (F.octet_length("value") <= text.MAX_VALUE)))


def path_test(path: Column, pattern: str) -> Column:
    """Exact path, or parts between ``*`` (or ``%``) found greedily from the left, the last at its first place."""
    if "*" not in pattern and "%" not in pattern:
        return path == pattern
    first, *rest = re.split(r"[*%]", pattern)
    # What is left of the path after each part; null once a part is missing. Plain string functions, in the JVM.
    left = F.when(path.startswith(first), F.substr(path, F.lit(len(first) + 1)))
    for i, part in enumerate(rest):
        if part:
            at = F.instr(left, part)
            left = F.when(at > 0, F.substr(left, at + len(part)))
            if i == len(rest) - 1:
                left = F.when(left == "", left)
    return left.isNotNull()


def matching_key(leaf_rows: DataFrame, pattern: str, scope: Sequence[str] = ()) -> DataFrame:
    """Runs with a leaf at the path, relative to each of ``scope``."""
    tests = [path_test(F.col("path"), f"{p}.{pattern}") for p in scope] or [path_test(F.col("path"), pattern) & ~F.col("path").startswith("run.")]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return _keys(leaf_rows.where(out))


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """Postings as written: conditions on token and path reach the scan and skip row groups. A folder that isn't an index is refused."""
    posts = spark.read.parquet(path)
    if missing := {"token", "path", "positions", *RUN_KEY} - set(posts.columns):
        raise ValueError(f"not a postings index, it lacks {', '.join(sorted(missing))}")
    return posts


def write_postings(posts: DataFrame, path: str, files: int | None = None) -> None:
    """Sorted by token and path, so that a query reads the row groups whose bounds hold its tokens."""
    ranged = posts.repartitionByRange(files, "token", "path") if files else posts.repartitionByRange("token", "path")
    ranged.sortWithinPartitions("token", "path").write.mode("overwrite").parquet(path)
