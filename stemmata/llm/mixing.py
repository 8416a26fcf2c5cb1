"""Problem 8: mixing sources to target weights.

Sizes are tokens of a public tokenizer (problem 7).  The mixture is the largest one in which
every source that has tokens holds exactly its target share (shares of sources without
tokens are spread over the others in proportion) and no source is repeated more often than
its cap: ``total = min(cap * size / share)``.

Method: systematic sampling.  Within a source every document has the same expected number of
copies ``share * total / size``; documents are put in order of size, the expected copies are
prefix-summed, one random offset per source is added, and a document comes out once for each
integer its stretch of the sum crosses, so a source's share is met up to about one document.
The prefix sum is a rank: buckets of (source, size class, salt) are counted, a running sum
over the bucket counts gives each bucket its first rank, and ranks inside a bucket are local,
so a source with a third of all rows is spread over many tasks.

Defined cases: documents without tokens (null or empty text) add nothing and are never
chosen; sources without a target are left out; equal sizes are ordered by a hash of the id;
targets without tokens appear in the shares with zero.
"""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table
from .tokens import TOKENIZERS, _parts, encoder

#: Rows of one source that share a salt, about.
SALT_ROWS = 50_000
MOST_SOURCES = 10_000


def _sizes(path: str):
    def run(batches):
        enc = encoder(path)
        for b in batches:
            for part in _parts(b):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(enc.count(part.column(1).to_pylist()))], names=["id", "source", "n_tokens"])

    return run


class Mixture:
    def __init__(
        self, docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        seed: int = 7, vocabulary: str = "byte_bpe_50k.json", folder: str = TOKENIZERS,
    ):
        spark = docs.sparkSession
        rows = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.sum("target_share").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("cap")).limit(MOST_SOURCES + 1).collect()
        if len(rows) > MOST_SOURCES:
            raise ValueError("more target sources than fit a plan on the driver")
        want = {r.source: (float(r.share), int(r.cap)) for r in rows}
        src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).cast("string").alias("source"))
        src = src.where(F.col("source").isin(*want)) if want else src.limit(0)
        #: (id, source, n_tokens) of the documents that take part
        self.sizes = cut(src.mapInArrow(_sizes(f"{folder}/{vocabulary}"), "id long, source string, n_tokens long").where("n_tokens > 0"))
        have = {r.source: (int(r.tokens), int(r.docs)) for r in self.sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).collect()}
        whole = sum(want[s][0] for s in have)
        total = min((want[s][1] * have[s][0] * whole / want[s][0] for s in have), default=0.0)
        plan = []
        for s, (share, cap) in want.items():
            tokens, docs_ = have.get(s, (0, 0))
            copies = min(float(cap), share / whole * total / tokens) if tokens else 0.0
            plan.append((s, share, cap, tokens, docs_, copies, random.Random(f"{seed}:{s}").random(), max(1, docs_ // SALT_ROWS)))
        #: one row per target source; at most MOST_SOURCES rows
        self.plan = spark.createDataFrame(
            plan, "source string, target_share double, max_repeats int, available_tokens long, documents long, expected_copies double, offset double, salts int"
        )

    def chosen(self) -> DataFrame:
        """(id, source, n_tokens, copies) of the documents in the mixture, copies >= 1."""
        p = F.broadcast(self.plan.select("source", "max_repeats", "expected_copies", "offset", "salts"))
        docs = self.sizes.join(p, "source").withColumn("h", F.xxhash64("id")).withColumn("class", F.floor(F.log2("n_tokens") * 4)).withColumn("salt", F.pmod("h", "salts"))
        bucket = ["source", "class", "salt"]
        before = Window.partitionBy("source").orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1)
        base = docs.groupBy(*bucket).agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
        inside = F.row_number().over(Window.partitionBy(*bucket).orderBy("n_tokens", "h", "id"))
        rank = F.col("base") + F.col("inside")
        upto = lambda k: F.floor(F.col("offset") + F.col("expected_copies") * k)
        copies = F.least(upto(rank) - upto(rank - 1), F.col("max_repeats").cast("long"))
        return docs.withColumn("inside", inside).join(base, bucket).withColumn("copies", copies).where("copies >= 1").select("id", "source", "n_tokens", "copies")

    def shares(self) -> DataFrame:
        got = self.chosen().groupBy("source").agg(F.count("*").alias("chosen"), F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"))
        zero = F.lit(0).cast("long")
        both = self.plan.join(got, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", zero))
        all_tokens = F.sum("mixed_tokens").over(Window.partitionBy())  # one row per target source
        return both.select(
            "source", "target_share", "max_repeats", "documents", F.coalesce("chosen", zero).alias("chosen_documents"), "available_tokens", "mixed_tokens",
            F.round("expected_copies", 6).alias("expected_copies"), F.round(F.when(all_tokens > 0, F.col("mixed_tokens") / all_tokens).otherwise(0.0), 6).alias("actual_share"),
        )


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    m = Mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))
    return m.chosen().withColumnRenamed("id", "doc_id")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return Mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets")).shares()


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares}
