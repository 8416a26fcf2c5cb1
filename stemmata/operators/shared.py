"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session.

    A temporary folder only where it is unset and everything runs on this machine; on a
    cluster each executor would write to its own disk, so there the setting is required.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that all executors share")
        at = getattr(spark, "_stemmata_core_shared", None)
        if not at:
            at = spark._stemmata_core_shared = tempfile.mkdtemp(prefix="stemmata-")
            atexit.register(shutil.rmtree, at, ignore_errors=True)
    return at.rstrip("/")


_written: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: one computation, short lineage.

    The table stays until ``release`` or the end of the session.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def written(spark: SparkSession) -> int:
    """How many tables ``cut`` has written and ``release`` has not deleted."""
    return len(_written.get(spark, []))


def release(spark: SparkSession, keep: int = 0) -> int:
    """Delete the tables of ``cut``, but for the first ``keep``; what was built on them must have been written before."""
    paths = _written.get(spark, [])
    for p in paths[keep:]:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    gone = len(paths[keep:])
    del paths[keep:]
    return gone


def latest(spark: SparkSession) -> str:
    """The folder of the table written last."""
    return _written[spark][-1]


def forget(spark: SparkSession, path: str) -> None:
    """Delete one table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _written[spark].remove(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the files give fewer partitions than there are cores.

    Large inputs come in many splits and are left as they are; only a few small files are
    shuffled, before expensive work per row.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ranked(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """With rank (or another name) = 1, 2, ... in the given order: each sorted part counts on from those before it."""
    place = F.monotonically_increasing_id()  # part * 2^33 + place in the part
    rows = cut(df.orderBy(*order).withColumn("place", place)).withColumn("part", F.shiftright("place", 33))
    parts = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("before"))  # one row per part
    rank = F.col("before") + F.col("place") - F.shiftleft("part", 33) + 1
    return rows.join(F.broadcast(parts), "part").select(*df.columns, rank.alias(name))
