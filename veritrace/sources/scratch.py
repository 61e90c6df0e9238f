"""Folders and small files through Hadoop's file systems, so that they may lie in any store that Spark reads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the folder that driver and executors share: spark.checkpoint.dir, or one of our own where that
    is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        app = spark.sparkContext.applicationId
        base = _own.setdefault(app, _own.get(app) or "file://" + tempfile.mkdtemp(prefix="veritrace-"))
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write one small file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
