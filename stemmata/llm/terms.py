"""Problems 3 and 6: frequency of every term, and how distinctive a term is per record.

Frequencies (problem 3) are a heavy-light aggregation: the heaviest terms of a bounded
sample are broadcast; every task counts them exactly in local arrays and sends the arrays
once, summed by place in the list, while only the remaining terms are pre-aggregated per
batch and shuffled; the two count tables are then united.  The sample only decides which
route a term takes: all counts cover all rows.  Texts are cut into terms once: the partial
counts, and the terms of records where weights need them, are written together.

Weights (problem 6) are residual inverse document frequencies: the observed value
``-log2(df/N)`` minus the value expected of a Poisson spread with the same collection
frequency, ``-log2(1 - exp(-cf/N))``, times the frequency of the term in the record.

Null and empty texts have no terms but count as rows of the collection.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codepoints as C
from .common import cut, narrow, pieces, table

#: Bounds of the heavy list: terms, and rows of the sample they are taken from.
HEAVY_TERMS, SAMPLE_ROWS = 4096, 20_000

#: What one pass over the texts gives: partial counts of light terms, of heavy terms, and terms of records.
LIGHT, HEAVY, POST = 0, 1, 2
_PARTS = "kind int, term string, place int, id long, occurrences long, records long"


def _light_counts(terms: C.Terms, first: np.ndarray, count: np.ndarray):
    """Totals by term of (term, record) rows sorted by term."""
    h = terms.hash[first]
    new = np.ones(len(h), np.bool_)
    new[1:] = h[1:] != h[:-1]
    at = np.flatnonzero(new)
    return first[at], np.add.reduceat(count, at), np.diff(np.append(at, len(h)))


def _part(kind: int, n: int, term=None, place=None, ids=None, occ=None, rec=None) -> pa.RecordBatch:
    cols = [(term, pa.string()), (place, pa.int32()), (ids, pa.int64()), (occ, pa.int64()), (rec, pa.int64())]
    arrays = [pa.array(np.full(n, kind, np.int32))] + [pa.nulls(n, t) if c is None else c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in cols]
    return pa.RecordBatch.from_arrays(arrays, names=["kind", "term", "place", "id", "occurrences", "records"])


def _counter(heavy_hash: np.ndarray, min_tf: int | None = None):
    """One pass: partial counts, and terms of records with at least ``min_tf`` occurrences if it is given."""

    def run(batches):
        occ, rec = np.zeros(len(heavy_hash), np.int64), np.zeros(len(heavy_hash), np.int64)
        for ids, _, cp, off in pieces(batches):
            t = C.Terms(cp, off)
            if not len(t.hash):
                continue
            first, row, count = C.count_by_row(t)
            place = np.full(len(first), -1, np.int64)
            if len(heavy_hash):
                at = np.searchsorted(heavy_hash, t.hash[first])
                at[at == len(heavy_hash)] = 0
                is_heavy = heavy_hash[at] == t.hash[first]
                place[is_heavy] = at[is_heavy]
                occ += np.bincount(at[is_heavy], count[is_heavy], len(heavy_hash)).astype(np.int64)
                rec += np.bincount(at[is_heavy], minlength=len(heavy_hash))
            light = place < 0
            if light.any():
                at, o, r = _light_counts(t, first[light], count[light])
                yield _part(LIGHT, len(at), term=t.text(at), occ=o, rec=r)
            if min_tf is not None:
                for kind in (True, False):
                    at = np.flatnonzero((count >= min_tf) & (light == kind))
                    if len(at):
                        who = {"term": t.text(first[at])} if kind else {"place": place[at]}
                        yield _part(POST, len(at), ids=ids.take(pa.array(row[at])), occ=count[at], **who)
        met = np.flatnonzero(rec)
        if len(met):
            yield _part(HEAVY, len(met), place=met, occ=occ[met], rec=rec[met])

    return run


def term_hashes(words: list[str]) -> np.ndarray:
    """The hash of each given term (already in term form)."""
    cp, off = C.decode(pa.array(words, pa.string()))
    C.tables().need(cp)
    return C.hash_runs(cp, off[:-1], np.diff(off)) if len(words) else np.zeros(0, np.uint64)


def heavy_terms(src: DataFrame, rows: int, most: int = HEAVY_TERMS, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """At most ``most`` frequent terms, by a sample of about ``sample_rows`` rows chosen by id."""
    step = max(1, rows // sample_rows)
    few = src.where(F.pmod(F.xxhash64("id"), F.lit(step)) == 0) if step > 1 else src
    counts = few.mapInArrow(_counter(np.zeros(0, np.uint64)), _PARTS).groupBy("term").agg(F.sum("records").alias("n"))
    top = counts.where("n > 1").orderBy(F.desc("n"), "term").limit(most).collect()
    return [r.term for r in top]


class TermStatistics:
    """Counts of every term of one text column, with the heavy list that was used."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, most: int = HEAVY_TERMS, sample_rows: int = SAMPLE_ROWS):
        self.source = narrow(df, id_col, text_col)
        self.rows = df.count()
        words = heavy_terms(self.source.where("text is not null"), self.rows, most, sample_rows)
        hashes = term_hashes(words)
        order = np.argsort(hashes)
        self.heavy_hash = hashes[order]
        self.heavy_text = [words[i] for i in order.tolist()]

    def parts(self, min_tf: int | None = None) -> DataFrame:
        """The result of one pass over all texts, kept in the shared folder."""
        return cut(self.source.where("text is not null").mapInArrow(_counter(self.heavy_hash, min_tf), _PARTS))

    def heavy_counts(self, parts: DataFrame) -> DataFrame:
        """(place, term, occurrences, records) of the heavy terms: at most ``HEAVY_TERMS`` rows."""
        listed = parts.sparkSession.createDataFrame(list(enumerate(self.heavy_text)), "place int, term string")
        total = parts.where(F.col("kind") == HEAVY).groupBy("place").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
        return total.join(F.broadcast(listed), "place").select("place", "term", "occurrences", "records")

    def light_counts(self, parts: DataFrame) -> DataFrame:
        """(term, occurrences, records) of all other terms."""
        return parts.where(F.col("kind") == LIGHT).groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))

    def counts(self) -> DataFrame:
        """(term, occurrences, records, heavy): one row per distinct term, both tables united."""
        parts = self.parts()
        heavy = self.heavy_counts(parts).drop("place").withColumn("heavy", F.lit(True))
        return heavy.unionByName(self.light_counts(parts).withColumn("heavy", F.lit(False)))


def marked_terms(df: DataFrame, id_col: str, text_col: str, rare: int = 1, common: float = 0.2) -> DataFrame:
    """(term, occurrences, records, mark): ``rare`` up to ``rare`` records, ``common`` above the share of all rows."""
    s = TermStatistics(df, id_col, text_col)
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > F.lit(common * s.rows), "common")
    return s.counts().select("term", "occurrences", "records", mark.alias("mark"))


def _ridf(rows: int, cf, df):
    n = F.lit(float(rows))
    return -F.log2(df / n) + F.log2(-F.expm1(-cf / n))


def term_weights(df: DataFrame, id_col: str, text_col: str, min_tf: int = 1, max_df: int | None = None) -> DataFrame:
    """(id, term, tf, df, cf, weight) of each term of each record.

    Heavy terms (a bounded list) meet their statistics in a broadcast table of at most
    ``HEAVY_TERMS`` rows, so the hottest keys are never shuffled; the others are joined
    by term.  ``min_tf`` and ``max_df`` restrict the rows that come out, not the statistics.
    Records without an id count in the statistics and have no rows.
    """
    s = TermStatistics(df, id_col, text_col)
    parts = s.parts(min_tf)
    post = parts.where((F.col("kind") == POST) & F.col("id").isNotNull()).select("id", "term", "place", F.col("occurrences").alias("tf"))
    light = s.light_counts(parts).select("term", F.col("records").alias("df"), F.col("occurrences").alias("cf"))
    heavy = s.heavy_counts(parts).select("place", "term", F.col("records").alias("df"), F.col("occurrences").alias("cf"))
    if max_df is not None:
        light, heavy = light.where(F.col("df") <= max_df), heavy.where(F.col("df") <= max_df)
    cols = ("id", "term", "tf", "df", "cf")
    out = post.where("place is null").drop("place").join(light, "term").select(*cols)
    out = out.unionByName(post.where("place is not null").drop("term").join(F.broadcast(heavy), "place").select(*cols))
    return out.withColumn("weight", F.col("tf") * _ridf(max(1, s.rows), F.col("cf"), F.col("df")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return marked_terms(table(spark, folder, "sections"), "section_id", "text").where("mark is not null").select("term", "mark")


def p3_terms(spark: SparkSession, folder: str) -> DataFrame:
    return marked_terms(table(spark, folder, "sections"), "section_id", "text").withColumnRenamed("records", "sections")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Terms that mark a section, from the weighted table: three occurrences in it, four sections at most.

    Such a term has a positive weight in any collection of more than a few rows; the exact
    rule follows the weights, so that none is lost in a tiny one.
    """
    w = term_weights(table(spark, folder, "sections"), "section_id", "text", min_tf=3, max_df=4)
    return w.where("weight is not null and tf >= 3 and df <= 4").select(F.col("id").alias("section_id"), "term")


def p6_weights(spark: SparkSession, folder: str) -> DataFrame:
    w = term_weights(table(spark, folder, "sections"), "section_id", "text")
    return w.select(F.col("id").alias("section_id"), "term", "tf", F.round("weight", 9).alias("weight"))


QUERIES = {"p3_found": p3_found, "p3_terms": p3_terms, "p6_found": p6_found, "p6_weights": p6_weights}
