"""Shared plumbing of the corpus operators: narrow inputs, shared folder, checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a counted table of ids may be broadcast (16 bytes each, so a few MB).
SMALL_ROWS = 200_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def narrow(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under fixed names, whatever else the table holds."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir).

    A temporary folder only where it is unset and everything runs on this machine; on a
    cluster each executor would write to its own disk, so there the setting is required.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that all executors share")
        at = getattr(spark, "_stemmata_shared", None)
        if not at:
            at = tempfile.mkdtemp(prefix="stemmata-")
            spark._stemmata_shared = at
            atexit.register(shutil.rmtree, at, ignore_errors=True)
    return at.rstrip("/")


_written: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends, lost executors don't matter.

    The table stays until ``release`` or the end of the session.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables of ``cut`` so far; results built on them must have been written before."""
    paths = _written.pop(spark, [])
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a side only if its counted rows are few; otherwise leave the join to shuffle."""
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def ratio(x: float) -> tuple[int, int]:
    f = Fraction(str(x)).limit_denominator(1000)
    return f.numerator, f.denominator


def batch(schema: list[tuple[str, pa.DataType]], *cols) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(cols, schema)]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in schema])


def pieces(batches: Iterator[pa.RecordBatch], points: int = 400_000):
    """(ids, null mask of the texts, code points, offsets) of parts of the incoming batches."""
    from . import codepoints as C

    for b in batches:
        ids, texts = b.column(0), b.column(1)
        cp, off = C.decode(texts)
        for i, j in C.chunks(off, points):
            yield ids.slice(i, j - i), texts.slice(i, j - i), cp[off[i] : off[j]], off[i : j + 1] - off[i]


def as_long(ids: pa.Array) -> np.ndarray:
    """Ids as int64; rows without an id must have been filtered before."""
    return ids.cast(pa.int64()).to_numpy(zero_copy_only=False).astype(np.int64)


#: Rows of a class that one task pairs with others.
CLASS_ROWS = 1000


def class_pairs(links: DataFrame, members: DataFrame, most: int = 100) -> DataFrame:
    """Pairs (a, b) of rows from links between class representatives and class members.

    ``members`` holds (rep, id, size) for classes of two or more rows, the representative
    (smallest id) included; and, where the rows of a class can have different texts, (copy,
    copies): the smallest id with the same text, and how many rows have it.  All rows of a
    class are paired, except that of over ``most`` rows with equal texts only the one with
    the smallest id stands in pairs with other texts, and the others are linked to it.
    """
    if "copy" not in members.columns:
        members = members.withColumn("copy", F.col("rep")).withColumn("copies", F.col("size"))
    stand = members.where((F.col("copies") <= most) | (F.col("id") == F.col("copy"))).select("rep", "id").distinct()
    # large classes are split into parts, so that no task pairs a whole one
    parts = stand.groupBy("rep").agg(F.ceil(F.count("*") / CLASS_ROWS).cast("int").alias("parts"))
    stand = stand.join(parts, "rep").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    across = links.select("a", "b")
    for end, name in (("a", "ma"), ("b", "mb")):
        across = across.join(parts.withColumnRenamed("rep", end), end, "left").withColumn("part", every).drop("parts")
        across = across.join(stand.select(F.col("rep").alias(end), "part", F.col("id").alias(name)), [end, "part"], "left").drop("part")
    across = across.select(F.coalesce("ma", "a").alias("x"), F.coalesce("mb", "b").alias("y"))
    inside = (
        stand.select("rep", "part", F.col("id").alias("x"))
        .join(stand.select("rep", every.alias("part"), F.col("id").alias("y")), ["rep", "part"])
        .where("x < y").select("x", "y")
    )
    star = members.where((F.col("copies") > most) & (F.col("id") != F.col("copy"))).select(F.col("copy").alias("x"), F.col("id").alias("y"))
    both = across.unionByName(inside).unionByName(star)
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
