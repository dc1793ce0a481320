"""Shared-storage helpers: lineage is cut with tables written where every executor can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FOLDER = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as the session's ``spark.checkpoint.dir`` names it.

    Where it is unset, a session of one machine (master ``local[..]``: tests, a laptop) gets a temporary folder; any
    other raises, since executors could not read one another's local folders.
    """
    folder = spark.conf.get(FOLDER, None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set {FOLDER} to a folder that all executors share; master {master} has several machines")
    folder = "file://" + tempfile.mkdtemp(prefix="sieveworks-")
    spark.conf.set(FOLDER, folder)
    _delete_at_exit(spark, folder)
    return folder


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    """The file system removes ``path`` when the driver ends."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a compressed table in the shared folder and read it back.

    Unlike a local checkpoint the table survives the loss of any executor. It is removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sieveworks-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
