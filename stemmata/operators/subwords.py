"""Subwords by a given list of merges: word and pair frequencies, encoding, stop subwords.

Merges are data the caller supplies (a model file); they are not learnt here.
"""

from __future__ import annotations

import json
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from . import units as U

END = "</w>"


def load_model(path: str) -> tuple[list[tuple[str, str]], list[str]]:
    d = json.load(open(path, encoding="utf-8"))
    return [tuple(m) for m in d["merges"]], d.get("stop", [])


def save_model(path: str, merges: list[tuple[str, str]], stop: list[str]) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"merges": [list(m) for m in merges], "stop": stop}, f, ensure_ascii=False)


def word_frequencies(df: DataFrame, text: str) -> DataFrame:
    """(word, n) over the texts in normal form (normalised before they are cut into words)."""
    # the outer form, so that no text is normalised twice for a filter on the number of words
    return df.select(F.explode_outer(X.words(X.normalize_text(text))).alias("word")).where("word is not null").groupBy("word").agg(F.count("*").alias("n"))


def pair_frequencies(freqs: DataFrame) -> DataFrame:
    """(a, b, n): adjacent symbols of the words, an end mark closing each, weighted by frequency."""
    s = F.concat(F.split("word", ""), F.array(F.lit(END)))
    s = F.filter(s, lambda x: x != "")
    pairs = F.transform(F.sequence(F.lit(1), F.size(s) - 1), lambda k: F.struct(F.element_at(s, k).alias("a"), F.element_at(s, k + 1).alias("b")))
    return freqs.select(F.explode(pairs).alias("p"), "n").groupBy("p.a", "p.b").agg(F.sum("n").alias("n"))


def encode_word(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """Join the adjacent pair of lowest rank, leftmost first, until none is left."""
    parts = [*word, END]
    while found := [(ranks[pair], k) for k, pair in enumerate(zip(parts, parts[1:])) if pair in ranks]:
        k = min(found)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return parts


def encoder(merges: list[tuple[str, str]], merge_limit: int | None = None):
    """A column function: subwords of a word; no merges (limit 0) gives its characters and the end mark."""
    use = merges if merge_limit is None else merges[: max(0, merge_limit)]
    ranks = {m: i for i, m in enumerate(use)}

    def run(words: pd.Series) -> pd.Series:
        return words.map(lambda w: encode_word(w, ranks), na_action="ignore")

    return F.pandas_udf(run, T.ArrayType(T.StringType()))


#: Words a worker remembers at most.
REMEMBERED = 200_000


def subwords_of_word(merges, merge_limit: int | None = None, stop=frozenset()):
    """A function: the subwords of a word in order, without stop subwords."""
    use = list(merges) if merge_limit is None else list(merges)[: max(0, merge_limit)]
    ranks = {tuple(m): i for i, m in enumerate(use)}
    known: dict[str, list[str]] = {}

    def of(word: str) -> list[str]:
        got = known.get(word)
        if got is None:
            if len(known) > REMEMBERED:
                known.clear()
            got = known[word] = [x for x in encode_word(word, ranks) if x not in stop]
        return got

    return of


def subwords_of(merges, merge_limit: int | None = None, stop=frozenset()):
    """A column function: the subwords of an array of words in order, without stop subwords."""
    of = subwords_of_word(merges, merge_limit, stop)

    def run(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda words: [x for w in words for x in of(w)], na_action="ignore")

    return F.pandas_udf(run, T.ArrayType(T.StringType()))


def stop_subwords(freqs: DataFrame, merges: list[tuple[str, str]], n: int = 50) -> DataFrame:
    """(subword, n): the most frequent subwords that end a word, larger first on ties."""
    subs = freqs.select(F.explode(encoder(merges)("word")).alias("subword"), "n").groupBy("subword").agg(F.sum("n").alias("n"))
    return most_frequent(subs.where(F.col("subword").contains(END)), n)


def ending_frequencies(df: DataFrame, text: str, merges: list[tuple[str, str]]) -> DataFrame:
    """(subword, n) of the subwords that end a word of ``word_frequencies``.

    No word reaches over a blank, so each distinct text between blanks is brought into normal form and encoded once.
    """
    ranks = {tuple(m): i for i, m in enumerate(merges)}

    def count(batches):
        for b in batches:
            found = pc.split_pattern(b.column(0).drop_null(), " ").flatten().value_counts()
            yield pa.RecordBatch.from_arrays([found.field(0), found.field(1)], names=["token", "n"])

    def encode(batches):
        total: Counter[str] = Counter()
        for b in batches:
            normal = pa.array([X._normal(x) for x in b.column(0).to_pylist()], pa.string())
            words = pc.split_pattern_regex(normal, U._NO_WORD)
            n = np.repeat(b.column(1).to_numpy(), pc.list_value_length(words).to_numpy(zero_copy_only=False)).tolist()
            for w, k in zip(words.flatten().to_pylist(), n):
                if w:
                    total[encode_word(w, ranks)[-1]] += k
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["subword", "n"])

    tokens = df.select(text).mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return tokens.mapInArrow(encode, "subword string, n long").groupBy("subword").agg(F.sum("n").alias("n"))


def most_frequent(subs: DataFrame, n: int = 50) -> DataFrame:
    return subs.orderBy(F.desc("n"), F.desc("subword")).limit(n)
