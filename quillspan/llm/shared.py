"""Intermediate tables and parallelism shared by the operators.

Arrow batches of whole texts are bounded by ``spark.sql.execution.arrow.maxBytesPerBatch``
(64 MB unless set), and the operators cut them into chunks: no session setting is touched.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a two-column table that may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors reach, from ``spark.checkpoint.dir``. Where that is unset a local one will do in local mode only; on a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.sparkContext.master or "").startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach: intermediate tables go there")
        found = "file://" + tempfile.mkdtemp(prefix="quillspan-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_WRITTEN: list[str] = []


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete a table of ``table`` that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        known = [w for w in _WRITTEN if path.endswith(w.rsplit("/", 1)[1])]
        for w in known:
            delete(df.sparkSession, w)
            _WRITTEN.remove(w)


def sweep(spark: SparkSession) -> int:
    """Delete all intermediate tables of this process, once results made from them are written or collected; the number deleted."""
    gone = len(_WRITTEN)
    while _WRITTEN:
        delete(spark, _WRITTEN.pop())
    return gone


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spare(columns: list[str], wish: str) -> str:
    """A column name that ``columns`` doesn't have, in any case."""
    taken = {c.lower() for c in columns}
    while wish.lower() in taken:
        wish = "_" + wish
    return wish


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def known_rows(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether a written table has few enough rows to broadcast."""
    return df.limit(limit + 1).count() <= limit


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its row count allows one; otherwise joins shuffle it."""
    return F.broadcast(df) if known_rows(df, limit) else df


def identified(docs: DataFrame, column: str = "doc_id") -> tuple[DataFrame, str]:
    """``docs`` and a column that names each row: ``column`` if it is unique without nulls, else a number written with the rows."""
    seen = docs.groupBy(column).count().agg(F.max("count").alias("most"), F.count(F.when(F.col(column).isNull(), 1)).alias("nulls")).head()
    if (seen["most"] or 1) == 1 and not seen["nulls"]:
        return docs, column
    name = spare(docs.columns, "row_number")
    return table(docs.withColumn(name, F.monotonically_increasing_id()), "identified"), name


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` (label: the smallest node of its connected component) from edges ``a, b``, by alternating large and small stars."""
    now = table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).head()
        if state == before:
            break
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        # small star: of the smaller neighbours, all and the node itself hang on the least
        down = large.groupBy("a").agg(F.min("b").alias("least"))
        small_star = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        now, gone = table(small_star, "edges"), now
        discard(gone)
    return now.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label").unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
