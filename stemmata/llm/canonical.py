"""Problem 4: visually identical text with different characters.

Method: Arrow text is copied to numpy code-point arrays; lookup-table gathers, expansion
offsets and vectorised composition of marks make the consistent form of whole batches.

Null texts stay null and are no case; empty texts stay empty.  Any extra columns of the
input are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codepoints as C
from .common import narrow, pieces, table

FIELDS = (("sections", "section_id", "text"), ("canon", "record_id", "author_name_greek"), ("works", "record_id", "title_greek"))


def _forms(batches):
    for ids, texts, cp, off in pieces(batches):
        out, off2, other = C.consistent(cp, off)
        ok = texts.is_valid().to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([ids, C.encode(out, off2, ok), pa.array(other & ok)], names=["id", "text", "changed"])


def _changed(batches):
    for ids, texts, cp, off in pieces(batches):
        _, _, other = C.consistent(cp, off)
        if other.any():
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(other))], names=["id"])


def consistent_form(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, changed): every row with its text in consistent form."""
    return narrow(df, id_col, text_col).mapInArrow(_forms, "id long, text string, changed boolean")


def inconsistent(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id): rows whose text is stored otherwise than in consistent form."""
    return narrow(df, id_col, text_col).where("text is not null").mapInArrow(_changed, "id long")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = [inconsistent(table(spark, folder, t), i, f).select(F.lit(t).alias("tbl"), F.col("id").alias("row_id")) for t, i, f in FIELDS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p4_text(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        consistent_form(table(spark, folder, t), i, f).select(F.lit(t).alias("tbl"), F.col("id").alias("row_id"), "text", "changed")
        for t, i, f in FIELDS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QUERIES = {"p4_found": p4_found, "p4_text": p4_text}
