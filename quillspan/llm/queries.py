"""Queries of the corpus operators over their whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import ann, exact_dedup, langid, mixing, near_dedup, packing, pii, suffix_dedup, toxicity, warc
from quillspan.llm.shared import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op3_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.private_spans(read(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


def op5_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_warc_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(read(spark, sf_dir, "pages"))
    return found.select("target_uri", "warc_type", "content_length", F.md5("payload").alias("payload_md5"), F.col("error").isNull().alias("valid"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_groups(read(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(read(spark, sf_dir, "documents"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours among all rows, of every row whose id is divisible by 20."""
    return ann.nearest(read(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 20 == 0)


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (op1_toxicity, op2_best_fit_packing, op3_private_spans, op4_exact_dedup, op5_soft_mixing, op6_warc_reader, op7_near_dedup, op8_language_id, op9_suffix_dedup, op10_nearest_neighbours)
}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": """
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS copies
        FROM documents WHERE text IS NOT NULL
        WINDOW w AS (PARTITION BY text) QUALIFY count(*) OVER w > 1
    """,
    "op6_warc_reader": """
        SELECT url AS target_uri, 'resource' AS warc_type, CAST(strlen(html) AS BIGINT) AS content_length, md5(html) AS payload_md5, TRUE AS valid
        FROM pages WHERE url IS NOT NULL AND html IS NOT NULL
    """,
}
