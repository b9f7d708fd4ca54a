"""Intermediate tables in the folder that driver and executors share.

A multi-step job cuts its lineage by writing Parquet below ``spark.checkpoint.dir``.  The files
survive the loss of any executor, unlike a local checkpoint, and are removed when the session's
file system handle closes.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; on a cluster it must be set, a local session may do with a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="groundtable-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder name for one run; it is deleted when the session ends."""
    path = f"{shared_root(spark)}/groundtable-{label}-{uuid.uuid4().hex}"
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def spill(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return the stored table, so later steps do not recompute it."""
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    """The session's shuffle partition count, for explicit repartitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def short_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Arrow batches of fewer rows, for tables of long texts, unless the session sets a size itself.

    Python workers keep the memory of their largest batch, so its size bounds an executor's needs.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(rows))
