"""Where queries that write tables of their own put them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors reach; a local one in local mode only, where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master or ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        base = "file://" + tempfile.mkdtemp(prefix="quillspan-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
