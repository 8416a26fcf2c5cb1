"""Text-reuse comparison of two collections of units, as one declarative plan.

Candidates are pairs that share enough rare word bigrams, behind a cap on the units a bigram
may occur in; they, or the best ``max_candidates`` of them if it is set, are scored by the
cosine of TF-IDF weighted leave-n-out grams, and aligned: words match by edit distance, runs
of matches on one diagonal are islands, and islands close to each other fuse into blocks.

Candidates, scores and alignment are made for bands of left units against stored parts of the
right side (``operators.bands``), so no row per pair is shuffled.  Only pairs in which a run of
``ngram`` similar words stands are aligned, as no other can keep a block.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import bands
from ..operators import subwords as S
from ..operators import units as U
from ..operators.shared import cut, forget, latest, ranked
from .params import Params


def _hashed(c: str):
    return F.transform(c, lambda w: F.xxhash64(w))


class Side:
    """One collection: (unit, label, orig array, norm array), cut and normalised once, with its grams.

    A side can take part in many comparisons (a static index against a stream).  One that is not
    ``whole`` has hashes of its words only, for candidates and scores of one comparison: less is
    written.  With "texts" it has the normal forms of these hashes too, for the alignment.
    With None it has its words in normal form only, for counts.  Units of hashes are those of
    ``units.hashed_words``, or are made of their normal forms.
    """

    def __init__(self, units: DataFrame, params: Params = Params(), whole: bool | str | None = True):
        self.p = p = params.clamped()
        self.whole = whole
        self._made: dict[str, DataFrame | int] = {}
        if p.cap_units is not None:
            units = units.orderBy("unit").limit(p.cap_units)
        if whole is None:
            self.units = cut(units.select("unit", "norm"))
            return
        if whole is not True:
            hashes = [F.col("words") if "words" in units.columns else _hashed("norm").alias("words"), *(["keys", "texts"] if whole == "texts" else []), *(["subwords"] if "subwords" in units.columns else [])]
            self.units = cut(units.select("unit", *hashes))
            self._at = latest(self.units.sparkSession)
            self.count()
            return
        subs = F.col("norm") if p.merges is None else S.subwords_of(p.merges, p.merge_limit, p.stop)("norm")
        #: (unit, label, orig, norm, subs); subs are what scores count: words, or subwords in subword mode
        self.units = cut(units.select("unit", "label", "orig", "norm", subs.alias("subs")) if p.merges is not None else units.select("unit", "label", "orig", "norm"))

    def _once(self, name: str, make):
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def count(self) -> int:
        return self._once("count", self.units.count)

    def cap(self) -> int:
        """The posting cap, max(40, 4 % of the units)."""
        return max(40, 4 * self.count() // 100)

    def bigrams(self) -> DataFrame:
        """(unit, key): 64-bit hashes stand for bigrams, as shorter keys; what a comparison needs of a right side is made with them."""
        self.index(), self.usual()
        return U.bigrams(self.units, "unit").select("unit", F.xxhash64("gram").alias("key"))

    # -- stored blocks of units (``operators.bands``)

    def blocks(self, left: bool) -> int:
        cores = self.units.sparkSession.sparkContext.defaultParallelism
        return bands.bands(self.count(), cores) if left else bands.parts(self.count())

    def stored(self, left: bool) -> str:
        """(unit, norm, words, subwords) by ranges of the units: words, and hashes of them and of the subwords if these are scored."""
        lean = ["unit", "words", *(["subwords"] if "subwords" in self.units.columns else [])]
        if self.whole == "texts":
            return self._once(f"stored {left}", lambda: bands.store(self.units, self.blocks(left), *lean))
        if not self.whole:
            return self._once(f"stored {left}", lambda: self._instead(bands.store(self.units, self.blocks(left), *lean)))
        columns = ["unit", "norm", _hashed("norm").alias("words"), *([] if self.p.merges is None else [_hashed("subs").alias("subwords")])]
        return self._once(f"stored {left}", lambda: bands.store(self.units.drop("label", "orig"), self.blocks(left), *columns))

    def _instead(self, path: str) -> str:
        """``path`` in the place of the units, which are deleted."""
        spark = self.units.sparkSession
        forget(spark, self._at)
        return path

    def usual(self):
        """Bigrams of more units than the cap."""
        return self._once("usual", lambda: bands.common_keys(self.stored(False), self.units.sparkSession, self.blocks(False), self.count(), self.cap()))

    def index(self) -> str:
        return self._once("index", self._index)

    def _index(self) -> str:
        spark = self.units.sparkSession
        path = bands.index(self.stored(False), spark, self.blocks(False), self.usual())
        if not self.whole and "subwords" not in self.units.columns:
            forget(spark, self.stored(False))
        return path

    def _scored_words(self) -> str:
        return "norm" if self.p.merges is None else "subs"

    def grams(self) -> DataFrame:
        """(unit, gram, c) of the leave-n-out grams."""
        return U.leave_out_grams(self.units, "unit", self.p, self._scored_words())

    def hashed(self) -> DataFrame:
        """The same as hashes, with totals (``units.hashed_grams``)."""
        return self._once("hashed", lambda: cut(U.hashed_grams(self.units, self.p, self._scored_words())))


class Compare:
    """``left`` and ``right``: a ``Side``, or (unit id long, label string, orig array, norm array)."""

    def __init__(self, left: DataFrame | Side, right: DataFrame | Side, params: Params = Params()):
        self.p = params.clamped()
        self.sides = [x if isinstance(x, Side) else Side(x, self.p) for x in (left, right)]
        if all(x.whole is True for x in self.sides):
            self.left, self.right = (
                side.units.select(F.col("unit").alias(k), F.col("label").alias(f"label_{k}"), F.col("orig").alias(f"orig_{k}"), "norm") for side, k in zip(self.sides, "ij"))
        #: for sides of hashes: functions that give the whole units of both sides with the ids in a table (unit)
        self.originals: tuple | None = None
        self._kept_tables: dict[str, DataFrame] = {}
        self._packed: bands.Ranked | None = None
        self._stored_weights: tuple | None = None
        self._few_symbols = None
        self._spellings: str | None = None
        self._right_by_key: str | None = None
        self._texts: str | None = None

    def _once(self, name: str, make) -> DataFrame:
        """A step that several results build on, computed once and kept in the shared folder."""
        if name not in self._kept_tables:
            self._kept_tables[name] = cut(make())
        return self._kept_tables[name]

    def _of_pairs(self, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``left`` and ``right``; for sides of hashes, those of their units that are in ``kept``."""
        if self.originals is None:
            return self.left, self.right
        make = lambda k, of: lambda: of(kept.select(F.col(k).alias("unit")).distinct()).select(F.col("unit").alias(k), F.col("label").alias(f"label_{k}"), F.col("orig").alias(f"orig_{k}"), "norm")
        return tuple(self._once(f"units {k}", make(k, of)) for k, of in zip("ij", self.originals))

    def _sizes(self) -> tuple[int, int]:
        return self.sides[0].count(), self.sides[1].count()

    # -- phase 1: candidates and scores

    def gram_sizes(self) -> DataFrame:
        """(gram, n): in how many right units each bigram occurs."""
        return U.bigrams(self.right, "j").groupBy("gram").agg(F.count("*").alias("n"))

    def cap(self) -> int:
        """The posting cap, max(40, 4 % of the right units)."""
        return self.sides[1].cap()

    def usable_grams(self) -> DataFrame:
        return self.gram_sizes().where(F.col("n") <= self.cap()).select("gram")

    def candidates(self) -> DataFrame:
        """(i, j, shared, rank): the best pairs by shared bigrams; ties by i, then j."""
        return self.packed().frame(self._blocks_of()[0])

    def packed(self) -> bands.Ranked:
        """The same, packed by bands of left units."""
        if self._packed is None:
            left, right = self.sides
            spark = left.units.sparkSession
            path = bands.pairs(left.stored(True), right.index(), spark, self._blocks_of(), self.p.min_shared, right.usual())
            self._packed = bands.Ranked(path, spark, self.p.max_candidates)
        return self._packed

    def _blocks_of(self) -> tuple[int, int]:
        return self.sides[0].blocks(True), self.sides[1].blocks(False)

    def gram_counts(self) -> DataFrame:
        """(side, unit, gram, c) of all units."""
        a, b = (x.grams().select(F.lit(n).alias("side"), "unit", "gram", "c") for n, x in enumerate(self.sides, 1))
        return a.unionByName(b)

    def units(self):
        """Number of units of both sides, empty ones included."""
        return F.lit(sum(self._sizes()))

    def _idf(self, df):
        return F.log(F.lit(1.0) + self.units() / (F.lit(1.0) + df)) + F.lit(1.0)

    def idf(self) -> DataFrame:
        """(gram, df, idf) with idf = ln(1 + n / (1 + df)) + 1."""
        df = self.gram_counts().groupBy("gram").agg(F.count("*").alias("df"))
        return df.withColumn("idf", self._idf(F.col("df")))

    def gram_digests(self) -> DataFrame:
        """(df, grams, digest, idf): of the grams of each document frequency how many, and the sum of the first 32 bits of the MD5 of their texts.

        Grams are counted in slices one after the other (``units.gram_slices``), so neither their texts travel nor all of them lie on disk at once.
        """
        words = [x.units.select("norm") for x in self.sides]
        spark = words[0].sparkSession
        slices = max(1, ceil(sum(w.agg(F.sum(F.size("norm"))).first()[0] or 0 for w in words) / U.SLICE_WORDS))
        some = U.gram_slices(words[0].unionByName(words[1]), self.p, slices)
        both = spark.createDataFrame([r for rows in some for r in rows], "df long, grams long, digest long")
        return both.groupBy("df").agg(F.sum("grams").alias("grams"), F.sum("digest").alias("digest")).withColumn("idf", self._idf(F.col("df")))

    def _hashed(self) -> DataFrame:
        a, b = (x.hashed().withColumn("side", F.lit(n)) for n, x in enumerate(self.sides, 1))
        return a.unionByName(b)

    def weights(self) -> DataFrame:
        """(side, unit, key, w, less): TF-IDF weights of the grams (as hashes) that more than one unit has.

        A gram of one unit matters to the size of its unit only, which knows the sum of
        squares as if all its grams were such; ``less`` corrects that sum for this gram.
        """
        return self._once("weights", self._weights)

    def _weights(self) -> DataFrame:
        grams = self._hashed().where("key is not null")
        df = grams.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
        tf, idf = F.col("c") / F.col("total"), self._idf(F.col("df"))
        return grams.join(df, "key").select("side", "unit", "key", (tf * idf).alias("w"), (tf * tf * (idf * idf - self._idf(F.lit(1)) * self._idf(F.lit(1)))).alias("less"))

    def norms(self) -> DataFrame:
        """(side, unit, norm) of all units with grams."""
        whole = self._hashed().where("key is null").select("side", "unit", (F.col("squares") * self._idf(F.lit(1)) * self._idf(F.lit(1))).alias("part"))
        parts = whole.unionByName(self.weights().select("side", "unit", F.col("less").alias("part")))
        return parts.groupBy("side", "unit").agg(F.sqrt(F.sum("part")).alias("norm"))

    def scored(self) -> DataFrame:
        """(i, j, shared, rank, score): cosine of each candidate, 0 where a side has no grams."""
        return self._once("scored", self.scores)

    def scores(self) -> DataFrame:
        """The same, not written, for those who read it once."""
        return bands.scores(self.packed(), self._scorer(self.packed()), self._blocks_of())

    def _weighted(self) -> tuple:
        """Weights of both sides, stored."""
        if self._stored_weights is None:
            p = self.p
            keep = max(1, p.ngram - p.n_out)
            spark = self.sides[0].units.sparkSession
            stored = [x.stored(left) for x, left in zip(self.sides, (True, False))]
            col = "words" if p.merges is None else "subwords"
            if p.merges is not None and (spellings := self._spelling()):
                stored = [bands.spelled(x, spellings, spark, n) for x, n in zip(stored, self._blocks_of())]
            sides = list(zip(stored, self._blocks_of()))
            words = sum(spark.read.schema(f"{col} array<long>").parquet(x).agg(F.sum(F.size(col))).first()[0] or 0 for x in stored)
            df = bands.gram_df(sides, col, spark, words, p.ngram, keep)
            self._stored_weights = tuple(bands.weighted(x, col, spark, n, df, sum(self._sizes()), p.ngram, keep) for x, n in sides)
            for x in df:
                forget(spark, x)
        return self._stored_weights

    def _spelling(self) -> str | None:
        """(key, subwords) of the words, where sides of hashes have their normal forms and no subwords."""
        if any("subwords" in x.units.columns or x.whole != "texts" for x in self.sides):
            return None
        if self._spellings is None:
            p = self.p
            self._spellings = bands.spelling(self._vocabulary(), self.sides[0].units.sparkSession, S.subwords_of_word(p.merges, p.merge_limit, p.stop))
        return self._spellings

    def _scorer(self, pairs: bands.Ranked):
        """What scores pairs: by numbers made of the symbols of the grams if there are few symbols, else by stored weights."""
        if self._few_symbols is None:
            self._few_symbols = self.p.merges is not None and self._coded()
        return self._few_symbols(pairs) if self._few_symbols else bands.scorer(pairs, *self._weighted(), self._blocks_of())

    def _coded(self):
        """What makes scorers of subwords if they are few enough for an array of all grams, else False."""
        p, n = self.p, self._blocks_of()
        keep = max(1, p.ngram - p.n_out)
        spark = self.sides[0].units.sparkSession
        stored = tuple(x.stored(left) for x, left in zip(self.sides, (True, False)))
        spellings = self._spelling()
        lists = list(zip(stored, n)) if spellings is None else [(spellings, bands.VOCABULARY)]
        found = bands.symbols(lists, "subwords", spark, int(bands.NUMBERED ** (1 / keep) + 1e-9))
        return found is not None and bands.coded_scorer(stored, spellings, spark, n, found, sum(self._sizes()), p.ngram, keep)

    def chosen(self) -> DataFrame:
        return self.scored().where(F.col("score") >= self.p.similarity_threshold)

    def all_pairs(self) -> DataFrame:
        """(i, j, score) of every pair with a common gram: the exhaustive mode."""
        spark, (left, right) = self.sides[0].units.sparkSession, self._weighted()
        if self._right_by_key is None:
            self._right_by_key = bands.by_key(right, spark, self._blocks_of()[1])
        return bands.dense(left, self._right_by_key, spark, self._blocks_of())

    def vocabulary(self) -> DataFrame:
        """(vocab_size): distinct words, or subwords, that take part in the scores."""
        if self.p.merges is None and all(x.whole == "texts" for x in self.sides):
            path = self._vocabulary()
            return self.sides[0].units.sparkSession.read.schema("key long").parquet(path).agg(F.count("*").alias("vocab_size"))
        col = "norm" if self.p.merges is None else "subs"
        both = self.sides[0].units.select(col).unionByName(self.sides[1].units.select(col))
        return both.select(F.explode(col).alias("w")).agg(F.countDistinct("w").alias("vocab_size"))

    def meta(self) -> DataFrame:
        """One row: parameters, counts, mean score, the automatic threshold (reported, not applied)."""
        p = self.p
        n1, n2 = self._sizes()
        auto = F.when(F.count("*") < 2, F.lit(0.0)).otherwise(F.avg("score") + F.lit(1.2) * F.stddev_pop("score"))
        scored = self._kept_tables.get("scored") if "scored" in self._kept_tables else self.scores()  # written only if something else has asked for them
        counted = scored.agg(
            F.count("*").alias("n_candidates"), F.count_if(F.col("score") >= p.similarity_threshold).alias("n_chosen"),
            F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 4).alias("mean"), F.round(auto, 4).alias("threshold"),
        )
        long = lambda x: F.lit(x).cast("long")
        return counted.select(
            long(n1).alias("n1"), long(n2).alias("n2"), long(n1 * n2).alias("n_pairs_total"), "n_candidates", "n_chosen", self.vocabulary().scalar().alias("vocab_size"), "mean", "threshold",
            F.lit(round(p.similarity_threshold, 4)).alias("used_threshold"), F.lit(True).alias("auto_threshold_disabled"), F.lit(p.ngram).alias("ngram"), F.lit(p.n_out).alias("n_out"),
            F.lit(p.min_chain_words).alias("min_chain_words"), F.lit(round(p.fuzz_threshold, 4)).alias("fuzz_threshold"), F.lit("words" if p.merges is None else "subwords").alias("mode"),
        )

    # -- phase 2: alignment

    def _align(self, what: str, kept_only: bool = False) -> DataFrame:
        p = self.p
        pairs = self.packed()
        if p.similarity_threshold > 0:
            pairs = bands.above(pairs, self._scorer(pairs), self._blocks_of(), p.similarity_threshold)
        left, right = (x.stored(side) for x, side in zip(self.sides, (True, False)))
        texts = self._vocabulary() if self.sides[0].whole == "texts" else None
        return bands.align(pairs, left, right, self._blocks_of(), what, p.fuzz_threshold, p.ngram, p.n_out, p.min_chain_words, kept_only, texts)

    def _vocabulary(self) -> str:
        """(key, text) of the words of sides of hashes."""
        if self._texts is None:
            self._texts = bands.vocabulary([x.units for x in self.sides])
        return self._texts

    def aligned(self) -> DataFrame:
        """(i, j) of the chosen pairs with a run of ``ngram`` matching words: no other keeps a block."""
        return self._align("pairs")

    def runs(self, kept_only: bool = False) -> DataFrame:
        """(i, j, d, start, len): maximal runs of matches on the diagonals d = wj - wi of the aligned pairs, or of those that keep a block."""
        return self._align("runs", kept_only)

    def blocks(self, kept_only: bool = False) -> DataFrame:
        """(i, j, d, a, n, core, runs): runs at most n_out words apart, fused; of the aligned pairs, or of those that keep a block."""
        return self._align("blocks", kept_only)

    def _kept_blocks(self) -> DataFrame:
        """Blocks that are long enough, with the number of all blocks of their pair."""
        return self._once("kept", lambda: self._align("kept"))

    def kept(self) -> DataFrame:
        """Blocks that are long enough, numbered k = 0, 1, ... by diagonal and start."""
        return self._kept_blocks().withColumn("k", F.row_number().over(Window.partitionBy("i", "j").orderBy("d", "a")) - 1).drop("band")

    def matched(self, kept: DataFrame | None = None) -> DataFrame:
        """(i, j, side, word, k): matched words and the last block that holds them."""
        k = self.kept() if kept is None else kept
        at = k.select("i", "j", "d", "k", F.explode("runs").alias("r")).select("i", "j", "d", "k", F.explode(F.sequence(F.col("r.start"), (F.col("r.start") + F.col("r.len") - 1).cast("int"))).alias("wi"))
        sides = F.array(F.struct(F.lit("i").alias("side"), F.col("wi").alias("word")), F.struct(F.lit("j").alias("side"), (F.col("wi") + F.col("d")).alias("word")))
        return at.select("i", "j", "k", F.explode(sides).alias("x")).groupBy("i", "j", "x.side", "x.word").agg(F.max("k").alias("k"))

    def bridges(self, kept: DataFrame | None = None) -> DataFrame:
        """(i, j, side, word, fuzz): words in the gaps of a block, with the likeness of the gaps (0 to 100)."""
        k = self.kept() if kept is None else kept
        inner = F.transform(F.sequence(F.lit(1), F.size("runs") - 1), lambda x: F.struct(
            (F.element_at("runs", x)["start"] + F.element_at("runs", x)["len"]).cast("int").alias("g0"), F.element_at("runs", x + 1)["start"].alias("g1")))
        gaps = k.where(F.size("runs") > 1).select("i", "j", "d", "k", F.explode(inner).alias("g")).select("i", "j", "d", "k", "g.g0", "g.g1")
        left, right = self._of_pairs(k)
        words = gaps.join(left.select("i", F.col("norm").alias("ni")), "i").join(right.select("j", F.col("norm").alias("nj")), "j")
        span = lambda arr, a, b: F.array_join(F.slice(arr, a + 1, b - a), " ")
        fuzz = F.round(F.lit(100.0) * X.levenshtein_ratio(span(F.col("ni"), F.col("g0"), F.col("g1")), span(F.col("nj"), F.col("g0") + F.col("d"), F.col("g1") + F.col("d"))), 1)
        each = words.select("i", "j", "d", "k", fuzz.alias("fuzz"), F.explode(F.sequence(F.col("g0"), F.col("g1") - 1)).alias("wi"))
        sides = F.array(F.struct(F.lit("i").alias("side"), F.col("wi").alias("word")), F.struct(F.lit("j").alias("side"), (F.col("wi") + F.col("d")).alias("word")))
        return each.select("i", "j", "k", "fuzz", F.explode(sides).alias("x")).groupBy("i", "j", "x.side", "x.word").agg(F.max_by("fuzz", "k").alias("fuzz"))

    def _of_kept(self, score: bool) -> DataFrame:
        """(i, j, rank, score) of the pairs with a kept block; of all chosen ones where they are scored already or a threshold asks for it."""
        if "scored" in self._kept_tables or self.p.similarity_threshold > 0:
            return self.chosen().select("i", "j", "rank", F.round("score", 4).alias("score"))
        pairs = bands.among(self.packed(), self._kept_blocks())
        if not score:
            return self._once("ranked kept", lambda: pairs.frame(self._blocks_of()[0])).select("i", "j", "rank")
        return self._once("scored kept", lambda: bands.scores(pairs, self._scorer(pairs), self._blocks_of())).select("i", "j", "rank", F.round("score", 4).alias("score"))

    def pairs(self, detail: bool = False, score: bool = True) -> DataFrame:
        """One row per pair with a kept block: score, counts, word ranges, snippets.

        ``detail`` adds the words of both units and the maps of matched and bridging words.
        Without ``score`` that column is left out, and no weights are made for it.
        """
        kept = self.kept()
        per = kept.groupBy("i", "j").agg(F.count("*").alias("n_chained"), F.max("n").alias("chain_len"), F.max("n_blocks").alias("n_blocks"))
        m = self.matched(kept).groupBy("i", "j").agg(*[
            f(F.when(F.col("side") == s, F.col("word"))).alias(f"{n}_{s}") for s in "ij" for n, f in (("lo", F.min), ("hi", F.max), ("words", F.count))
        ])
        about = self._of_kept(score)
        rng = lambda s: F.when(F.col(f"hi_{s}") > F.col(f"lo_{s}"), F.concat((F.col(f"lo_{s}") + 1).cast("string"), F.lit("–"), (F.col(f"hi_{s}") + 1).cast("string"))).otherwise((F.col(f"lo_{s}") + 1).cast("string"))
        start = lambda s: F.greatest(F.lit(0), F.col(f"lo_{s}") - 6)
        snip = lambda s: F.trim(F.array_join(F.slice(f"orig_{s}", start(s) + 1, F.least(F.size(f"orig_{s}"), F.col(f"hi_{s}") + 7) - start(s)), " "))
        left, right = self._of_pairs(kept)
        out = about.join(per, ["i", "j"]).join(m, ["i", "j"]).join(left.drop("norm"), "i").join(right.drop("norm"), "j")
        cols = ["i", "j", "label_i", "label_j", "rank", *["score"][: int(score)], "n_blocks", "n_chained", F.col("words_i").alias("matched_words"), "chain_len",
                rng("i").alias("word_range_i"), rng("j").alias("word_range_j"), snip("i").alias("snippet_i"), snip("j").alias("snippet_j")]
        if not detail:
            return out.select(*cols)
        maps = lambda df, v, name: df.groupBy("i", "j").agg(*[
            F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("word", v))))).alias(f"{name}_{s}") for s in "ij"])
        full = out.join(maps(self.matched(kept), "k", "matched"), ["i", "j"]).join(maps(self.bridges(kept), "fuzz", "bridges"), ["i", "j"], "left")
        return full.select(*cols, F.col("orig_i").alias("tokens_i"), F.col("orig_j").alias("tokens_j"), "matched_i", "matched_j", "bridges_i", "bridges_j")

    # -- presentation

    def result(self) -> tuple[DataFrame, DataFrame]:
        """The comparison as a whole: its meta row and all pairs, longest chain first."""
        return self.meta(), self.pairs(detail=True).orderBy(F.desc("chain_len"), "rank")

    def tsv_rows(self, about_i: DataFrame, about_j: DataFrame) -> DataFrame:
        """(chain_len, rank, line): rows of the export under ``TSV_COLUMNS``, longest chain first.

        ``about_i``: (i, the eight fields of ``index.work_meta``), ``about_j`` with j.  Tabs
        become spaces, nulls are empty.
        """
        p = self.pairs(detail=True)
        for k, about in (("i", about_i), ("j", about_j)):
            p = p.join(about.select(k, *[F.col(c).alias(f"{c}_{k}") for c in ABOUT]), k, "left")
        cols = []
        for k in "ij":
            cols += [F.col(f"{c}_{k}") for c in ABOUT] + [F.col(f"label_{k}"), F.col(f"word_range_{k}"), F.array_join(f"tokens_{k}", " ")]
        # numbers as people write them: no exponent, no zeros at the end
        cols.append(F.regexp_replace(F.regexp_replace(F.col("score").cast("decimal(12,4)").cast("string"), "0+$", ""), "[.]$", ""))
        cols += [F.col(c) for c in ("matched_words", "chain_len", "n_blocks", "n_chained", "snippet_i", "snippet_j")]
        cell = [F.translate(F.coalesce(c.cast("string"), F.lit("")), "\t", " ") for c in cols]
        return p.select("chain_len", "rank", F.concat_ws("\t", *cell).alias("line")).orderBy(F.desc("chain_len"), "rank")

    def events(self, every: int = 150) -> DataFrame:
        """(seq, t, payload): the event stream of the comparison, best candidates first.

        ``toLocalIterator`` over ``orderBy("seq")`` delivers it incrementally.
        """
        spark = self.sides[0].units.sparkSession
        pairs = self.pairs(detail=True)
        if self.p.similarity_threshold <= 0:
            hit, total = cut(pairs.withColumn("n", F.col("rank"))), self.packed().total()
        else:
            # ranks of chosen pairs without gaps; the places of found pairs decide what was found up to a tick
            c = cut(ranked(self.chosen().select("i", "j", "rank"), "rank", name="n").select("i", "j", "n"))
            hit, total = cut(c.join(pairs, ["i", "j"])), c.count()
        pair = hit.select((F.col("n") * 10).alias("seq"), F.lit("pair").alias("t"), F.to_json(F.struct(F.struct(*[x for x in pairs.columns if x != "rank"]).alias("pair"))).alias("payload"))
        # found pairs per stretch between ticks, then a running sum over the stretches
        stretch = hit.groupBy(F.ceil(F.col("n") / every).cast("long").alias("s")).agg(F.count("*").alias("k"))
        steps = spark.range(1, total // every + 1).withColumnRenamed("id", "s").join(stretch, "s", "left")
        found = F.sum(F.coalesce("k", F.lit(0))).over(Window.orderBy("s"))  # one row per tick
        tick = steps.select("s", found.alias("found")).select(
            (F.col("s") * every * 10 + 1).alias("seq"), F.lit("progress").alias("t"), F.to_json(F.struct((F.col("s") * every).alias("done"), F.lit(total).alias("total"), "found")).alias("payload"))
        done = hit.agg(F.lit(total * 10 + 2).cast("long").alias("seq"), F.lit("done").alias("t"), F.to_json(F.struct(F.count("*").alias("found"), F.lit(total).alias("total"))).alias("payload"))
        head = self.meta().select(F.lit(0).cast("long").alias("seq"), F.lit("meta").alias("t"), F.to_json(F.struct("*")).alias("payload"))
        return head.unionByName(pair).unionByName(tick).unionByName(done)


#: Fields of a work in the export, and the columns of the export.
ABOUT = ("author_id", "author_latin", "author_greek", "cts_urn", "title_latin", "title_greek", "edition")
# Column names of the text export.
TSV_COLUMNS = (
    "source1_author_id", "source1_author_latin", "source1_author_greek", "source1_urn", "source1_work_title_latin", "source1_work_title_greek", "source1_edition",
    "source1_section", "source1_word_range", "source1_chapter",
    "source2_author_id", "source2_author_latin", "source2_author_greek", "source2_urn", "source2_work_title_latin", "source2_work_title_greek", "source2_edition",
    "source2_section", "source2_word_range", "source2_chapter",
    "cosine", "matched_words", "chain_len", "n_blocks", "n_chained", "excerpt_1", "excerpt_2",
)
