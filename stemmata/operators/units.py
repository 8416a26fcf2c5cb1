"""Comparison units: cleaned texts, overlapping windows, words, bigrams.

Arrays made here are exploded by the outer form where none is empty: the plain form adds a
filter on the size of the array, which is pushed down to the scan and makes every array twice.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.params import Params


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """Starts of the windows over n words: every size - overlap words until one reaches the end."""
    steps = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap))
    return F.filter(steps, lambda k: (k == 0) | (k + overlap < n))


def windows(df: DataFrame, key: str, text: str, size: int = 140, overlap: int = 25) -> DataFrame:
    """(key, k, windows, words): the words of each text cut into overlapping windows.

    k counts from 1; a text of up to ``size`` words, an empty one included, is one window.
    """
    clean = F.trim(F.regexp_replace(text, X.SPACE, " "))
    words = F.when(F.col("clean") == "", F.array().cast("array<string>")).otherwise(F.split("clean", " "))
    base = df.select(key, clean.alias("clean")).select(key, words.alias("all"))  # a filter on the text would be pushed to the scan and clean it twice
    # the slices are made before they become rows, so no row carries all the words
    slices = F.transform(window_starts(F.size("all"), size, overlap), lambda at: F.slice("all", at + 1, size))
    return base.select(key, F.when(F.col("all").isNotNull(), slices).alias("slices")).select(key, F.size("slices").alias("windows"), F.posexplode_outer("slices").alias("p", "words")).where("p is not null").select(key, (F.col("p") + 1).alias("k"), "windows", "words")


def tokenised(df: DataFrame, key: list[str], text: Column, p: Params) -> DataFrame:
    """(key, orig, norm): raw words and their normal forms, at most ``cap_words`` of them if it is set."""
    words = X.words(X.strip_milestones(text))
    orig = df.where(text.isNotNull()).select(*key, (words if p.cap_words is None else F.slice(words, 1, p.cap_words)).alias("orig"))
    return orig.select(*key, "orig", X.normalize_words(F.col("orig")).alias("norm"))


def bigrams(units: DataFrame, key: str) -> DataFrame:
    """(key, gram): the distinct word bigrams of each unit."""
    n = F.size("norm")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.concat_ws(" ", F.element_at("norm", k), F.try_element_at("norm", k + 1)))
    return units.where(n >= 2).select(key, F.explode_outer(F.array_distinct(pairs)).alias("gram"))


def leave_out_grams(units: DataFrame, key: str, p: Params, col: str = "norm") -> DataFrame:
    """(key, gram, c): how often each choice of ngram - n_out ordered words (or subwords) of a window occurs."""
    keep = max(1, p.ngram - p.n_out)
    n = F.size(col)
    choices = list(combinations(range(p.ngram), keep))
    one = lambda k: F.array(*[F.concat_ws("\u0001", *[F.element_at(col, k + i) for i in c]) for c in choices])
    grams = F.flatten(F.transform(F.sequence(F.lit(1), n - p.ngram + 1), one))
    return units.where(n >= p.ngram).select(key, F.explode_outer(grams).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("c"))


HASHED = "unit long, key long, c int, total int, squares double"


def counted_grams(offs: np.ndarray, h: np.ndarray, ngram: int, keep: int):
    """(key, row, c, total) of the leave-n-out grams of rows of hashed words, each once per row, in no given order."""
    choices = list(combinations(range(ngram), keep))
    n = np.maximum(np.diff(offs) - ngram + 1, 0)
    rows = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offs[:-1], n)
    keys = []
    for chosen in choices:
        acc = np.full(len(at), 0x9E3779B97F4A7C15, np.uint64)
        for k in chosen:
            acc = (acc ^ h[at + k]) * np.uint64(0xD6E8FEB86659FD93)
            acc ^= acc >> np.uint64(32)
        keys.append(acc)
    key, row = np.concatenate(keys), np.tile(rows, len(choices))
    both = key ^ (row + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # one sort of 64 bits for gram and row
    order = np.argsort(both)
    both, key, row = both[order], key[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(key) else np.zeros(0, np.int64)
    c = np.diff(np.append(first, len(key)))
    key, row = key[first], row[first]
    return key, row, c, n[row] * len(choices)


def hashed_grams(units: DataFrame, p: Params, col: str = "norm") -> DataFrame:
    """Leave-n-out grams as 64-bit hashes, counted within each unit without a shuffle.

    Rows (unit, key, c, total) per gram, ``total`` being the number of grams of the unit; and
    one row per unit with a null key, whose ``squares`` is the sum of (c / total)^2.  Units
    without grams have no row.
    """
    keep = max(1, p.ngram - p.n_out)
    ngram = p.ngram

    def run(batches):
        for b in batches:
            unit = b.column(0).to_numpy(zero_copy_only=False)
            offs = b.column(1).offsets.to_numpy()
            h = b.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            key, row, c, total = counted_grams(offs - offs[0], h, ngram, keep)
            if not len(key):
                continue
            yield pa.RecordBatch.from_arrays([pa.array(unit[row]), pa.array(key.view(np.int64)), pa.array(c.astype(np.int32)), pa.array(total.astype(np.int32)), pa.nulls(len(key), pa.float64())], names=["unit", "key", "c", "total", "squares"])
            squares = np.bincount(row, (c / total) ** 2, len(unit))
            some = np.unique(row)
            yield pa.RecordBatch.from_arrays([pa.array(unit[some]), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int32()), pa.nulls(len(some), pa.int32()), pa.array(squares[some])], names=["unit", "key", "c", "total", "squares"])

    hashes = F.transform(col, lambda w: F.xxhash64(w))
    return units.where(F.size(col) >= p.ngram).select("unit", hashes.alias("hashes")).mapInArrow(run, HASHED)


#: Texts cut together, distinct words a task remembers as handed on, and with their normal forms.
CUT_TEXTS, HANDED, KNOWN = 4096, 500_000, 200_000
_MILESTONE, _NO_WORD = r"[\(\[][0-9]+[\)\]]", r"[^\p{L}\p{N}_]+"
_SPACES = X.SPACE.encode().decode("unicode_escape")


def hashed_words(texts: DataFrame, window: tuple[int, int] | None = None, per_text: int = 1, subwords=None) -> DataFrame:
    """(unit, words, keys, texts) of (id, text): the words in normal form as 64-bit hashes, as ``tokenised`` has them.

    ``window``: (size, overlap) of the windows each text is cut into, as ``windows`` has them, the
    units being id * per_text + k.  A milestone and a word lie within one word by white space, so
    each distinct one of these is cut into words once.  ``keys`` and ``texts`` hold hashes and normal
    forms not handed on before by the task, in some row; they are null in the others.
    With ``subwords``, a function of a word, their hashes follow as ``subwords``.
    """
    schema = "unit long, words array<long>, keys array<long>, texts array<string>" + ("" if subwords is None else ", subwords array<long>")
    hashes = lambda some: np.frombuffer(b"".join([hashlib.blake2b(w.encode(), digest_size=8).digest() for w in some]), np.int64)

    def cut_up(ids, text, handed, known):
        clean = pc.replace_substring_regex(pc.replace_substring_regex(text, _MILESTONE, ""), _SPACES, " ")
        clean = pc.utf8_trim(clean, " ")
        n = np.where(pc.equal(clean, "").to_numpy(zero_copy_only=False), 0, pc.add(pc.count_substring(clean, " "), 1).to_numpy(zero_copy_only=False)).astype(np.int64)
        coded = pc.split_pattern(clean.filter(pc.not_equal(clean, "")), " ").flatten().dictionary_encode()
        token = coded.indices.to_numpy(zero_copy_only=False)
        own = pc.split_pattern_regex(pc.replace_substring_regex(coded.dictionary, _MILESTONE, "") if window else coded.dictionary, _NO_WORD)
        flat = own.flatten()
        some = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(own)), pc.list_value_length(own).to_numpy(zero_copy_only=False))
        per = np.bincount(of[some], minlength=len(own)).astype(np.int64)
        words = flat.filter(pa.array(some)).dictionary_encode()
        raw = words.dictionary.to_pylist()
        if len(known) > KNOWN:
            known.clear()
        unseen = [w for w in raw if w not in known]
        normal = [X._normal(w) for w in unseen]
        known.update(zip(unseen, zip(normal, hashes(normal).tolist())))
        normal, keys = map(list, zip(*map(known.__getitem__, raw))) if raw else ([], [])
        h = np.array(keys, np.int64)
        new = {k: w for k, w in zip(keys, normal) if k not in handed}
        if len(handed) + len(new) > HANDED:
            handed.clear()
        handed.update(new)
        ids_of = words.indices.to_numpy(zero_copy_only=False)
        h = h[ids_of]
        if subwords is not None:
            parts = [subwords(w) for w in normal]
            sub_n = np.array([len(x) for x in parts], np.int64)
            sub_at = np.cumsum(sub_n) - sub_n
            kinds = pa.array([x for own in parts for x in own], pa.string()).dictionary_encode()
            sub_h = hashes(kinds.dictionary.to_pylist())[kinds.indices.to_numpy(zero_copy_only=False)]
        # windows over the words by white space, then over the words
        first = np.cumsum(n) - n
        if window:
            size, step = window[0], window[0] - window[1]
            k = 1 + np.maximum(0, (n - window[1] - 1) // step)
            row, at = np.repeat(np.arange(len(n)), k), bands._spans(np.zeros(len(n), np.int64), k)
            unit, a = ids[row] * per_text + at + 1, first[row] + at * step
            b = np.minimum(a + size, first[row] + n[row])
        else:
            unit, a, b = ids, first, first + n
        of_token = np.concatenate([[0], np.cumsum(per)])
        for lo in range(0, len(unit), CUT_TEXTS):
            s = slice(lo, lo + CUT_TEXTS)
            t = token[bands._spans(a[s], b[s] - a[s])]
            upto = np.concatenate([[0], np.cumsum(per[t])])
            ends = np.concatenate([[0], upto[np.cumsum(b[s] - a[s])]]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(h[at_word := bands._spans(of_token[t], per[t])]))
            rest = [None] * (len(lists) - 1)
            cells = [pa.array(unit[s]), lists, pa.array([list(new), *rest], pa.list_(pa.int64())), pa.array([list(new.values()), *rest], pa.list_(pa.string()))]
            if subwords is not None:
                w = ids_of[at_word]
                upto = np.concatenate([[0], np.cumsum(sub_n[w])])[ends].astype(np.int32)
                cells.append(pa.ListArray.from_arrays(pa.array(upto), pa.array(sub_h[bands._spans(sub_at[w], sub_n[w])])))
            yield pa.RecordBatch.from_arrays(cells, names=["unit", "words", "keys", "texts", "subwords"][: len(cells)])
            new = {}

    def run(batches):
        handed, known = set(), {}
        for b in batches:
            for lo in range(0, b.num_rows, CUT_TEXTS):
                some = b.slice(lo, CUT_TEXTS)
                yield from cut_up(some.column(0).to_numpy(zero_copy_only=False), some.column(1), handed, known)

    from . import bands

    return texts.where("text is not null").mapInArrow(run, schema)


#: Words whose grams are counted in one slice.
SLICE_WORDS = 40_000_000
#: Units looked at together, ranges of digests that are counted apart.
SLICE_UNITS, RANGES = 4096, 64


def gram_slices(words: DataFrame, p: Params, slices: int):
    """Rows [df, grams, digest] of each slice of the leave-n-out grams of (norm), slice after slice.

    A slice is chosen by a hash of the gram.  Its grams travel as the first 64 bits of their MD5,
    by ranges, in order and packed; the upper 32 bits are the digest.  What a slice has written is deleted before the next.
    """
    from . import bands
    from .shared import forget

    ngram, keep = p.ngram, max(1, p.ngram - p.n_out)
    choices = list(combinations(range(ngram), keep))
    spark = words.sparkSession

    def sums(key, row, at_word, texts):
        """(md5, n) of distinct grams, in order."""
        both = key ^ (row + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        first = np.unique(both, return_index=True)[1]  # each once per unit
        key, at_word = key[first], at_word[first]
        key, first, n = np.unique(key, return_index=True, return_counts=True)
        at_word = at_word[first]
        joined = pc.binary_join_element_wise(*[texts.take(pa.array(at_word[:, k])) for k in range(keep)], "\u0001")
        md5 = np.frombuffer(b"".join([hashlib.md5(x).digest()[:8] for x in joined.cast(pa.binary()).to_pylist()]), ">u8").astype(np.uint64)
        by = np.argsort(md5)
        return md5[by], n[by]

    def part(which):
        def run(batches):
            for b in batches:
                lists = b.column(0)
                for a in range(0, len(lists), SLICE_UNITS):
                    offs, flat = bands._list(pa.table({"w": lists.slice(a, SLICE_UNITS)}), "w")
                    coded = flat.dictionary_encode()
                    ids = coded.indices.to_numpy(zero_copy_only=False)
                    texts = coded.dictionary
                    h = np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=8).digest() for x in texts.cast(pa.binary()).to_pylist()]), np.uint64)[ids]
                    n = np.maximum(np.diff(offs) - ngram + 1, 0)
                    rows, at = np.repeat(np.arange(len(n)), n), bands._spans(offs[:-1], n)
                    got = []
                    for chosen in choices:
                        acc = np.full(len(at), 0x9E3779B97F4A7C15, np.uint64)
                        for k in chosen:
                            acc = (acc ^ h[at + k]) * np.uint64(0xD6E8FEB86659FD93)
                            acc ^= acc >> np.uint64(32)
                        ok = np.flatnonzero(acc % np.uint64(slices) == which)
                        got.append((acc[ok], rows[ok], np.stack([ids[at[ok] + k] for k in chosen], 1)))
                    key, row, at_word = (np.concatenate(c) for c in zip(*got))
                    if not len(key):
                        continue
                    md5, n = sums(key, row, at_word, texts)
                    cuts = np.searchsorted(md5 >> np.uint64(58), np.arange(RANGES + 1))
                    for r in np.flatnonzero(np.diff(cuts)).tolist():
                        s = slice(cuts[r], cuts[r + 1])
                        cells = [[r], [int(cuts[r + 1] - cuts[r])], [bands._dense(md5[s])], [bands._dense(n[s], False)]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["block", "n", "keys", "counts"])

        return run

    for which in range(slices):
        path = bands._path(spark)
        words.mapInArrow(part(np.uint64(which)), "block int, n long, keys binary, counts binary").write.partitionBy("block").parquet(path)

        def count(batches):
            for r in bands._ids(batches):
                t = bands._block(path, r, ["n", "keys", "counts"])
                if t is None:
                    continue
                cells = t.to_pylist()
                key = np.concatenate([bands._undense(x["keys"], x["n"], np.uint64) for x in cells])
                n = np.concatenate([bands._undense(x["counts"], x["n"], np.int64, False) for x in cells])
                by = np.argsort(key)
                key, n = key[by], n[by]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                df, back = np.unique(np.add.reduceat(n, first), return_inverse=True)
                digest = np.zeros(len(df), np.int64)
                np.add.at(digest, back, (key[first] >> np.uint64(32)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(df), pa.array(np.bincount(back)), pa.array(digest)], names=["df", "grams", "digest"])

        found = spark.range(0, RANGES, 1, RANGES).mapInArrow(count, "df long, grams long, digest long").groupBy("df").agg(F.sum("grams"), F.sum("digest"))
        yield [tuple(r) for r in found.collect()]
        forget(spark, path)


def similar_words(words: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b, of the distinct ``w`` that ``word_match`` at the threshold (0.5 and above), none left out.

    Words x and y, x not the longer, may be k edits apart. Of k + 1 pieces of x one is left whole
    by k edits, at most k places from where it was; so the two meet in a piece of equal text.
    """
    edits = lambda n, m: F.floor(F.lit(1.0 - threshold) * (n + m) + F.lit(1e-9)).cast("int")
    own, lx, ly, k = F.length("w"), F.col("lx"), F.col("ly"), F.col("k")
    most = (2.0 - threshold) / threshold  # of the lengths
    near = lambda df: df.withColumn("k", edits(lx, ly)).where((k >= 1) & (ly - lx <= k)).withColumn("p", F.explode(F.sequence(F.lit(0), k)))
    start, end = (F.floor((F.col("p") + d) * lx / (k + 1)).cast("int") for d in (0, 1))
    x = near(words.select("w", own.alias("lx"), F.explode(F.sequence(own, F.ceil(own * most).cast("int"))).alias("ly")))
    y = near(words.select("w", own.alias("ly"), F.explode(F.sequence(F.floor(own / most).cast("int"), own)).alias("lx")))
    x = x.select(F.col("w").alias("x"), "lx", "ly", "p", F.substring("w", start + 1, end - start).alias("piece"))
    y = y.withColumn("at", F.explode(F.sequence(F.greatest(start - k, F.lit(0)), F.least(start + k, ly - (end - start)))))
    y = y.select(F.col("w").alias("y"), "lx", "ly", "p", F.substring("w", F.col("at") + 1, end - start).alias("piece"))
    met = x.join(y, ["lx", "ly", "p", "piece"]).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return met.where(X.word_match(F.col("a"), F.col("b"), threshold))
