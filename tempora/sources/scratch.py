"""Scratch tables in the folder that driver and executors share: lineage ends at written files,
so a lost executor costs no recomputation."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL = threading.local()  # the blocks that a thread has open


def _open() -> list[list[str]]:
    return _LOCAL.__dict__.setdefault("blocks", [])


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  Only a single-JVM session may fall back to a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _open():
        _open()[-1].append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def bucketed(df: DataFrame, key: str, name: str, *order: str) -> DataFrame:
    """``materialize()`` in buckets of ``key``: joins, windows and groupings by it need not shuffle
    the table again.  ``df`` should come out of a grouping or window by ``key``, so that a task
    holds the rows of few buckets."""
    spark = df.sparkSession
    path, called = scratch_path(spark, name), f"scratch_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, key).sortBy(key, *order).option("path", path).saveAsTable(called)
    out = spark.table(called)
    spark.sql(f"DROP TABLE {called}")  # the files stay, and what has been read from the catalogue
    out._scratch_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete a scratch table that no later plan reads."""
    if path := getattr(df, "_scratch_path", None):
        delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes, at its end, the scratch tables made inside it, but for those put on the list.

    What is returned lazily from inside reads such tables, so write it before the end.
    """
    kept: list[DataFrame] = []
    _open().append([])
    try:
        yield kept
    finally:
        stay = {getattr(df, "_scratch_path", None) for df in kept}
        for path in _open().pop():
            if path not in stay:
                delete(spark, path)
            elif _open():
                _open()[-1].append(path)
