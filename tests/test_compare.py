"""Hand-worked comparisons."""

import json
import math
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from stemmata.operators import shared, subwords, units
from stemmata.plans import compare_queries
from stemmata.plans.compare import Compare
from stemmata.plans.params import Params
from stemmata.sources import sinks


def side(spark, *texts):
    rows = [(i, f"L{i}", t.split(), t.split()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "unit long, label string, orig array<string>, norm array<string>")


A, B = "a b c d x e f", "a b c d y e f"


@pytest.mark.parametrize("fuzz,n_out,blocks,kept,n,core,rng", [(1.0, 0, 2, 1, 4, 4, "1–4"), (0.75, 0, 2, 1, 4, 4, "1–4"), (1.0, 1, 1, 1, 6, 4, "1–7"), (0.75, 1, 1, 1, 6, 4, "1–7")])
def test_blocks(spark, fuzz, n_out, blocks, kept, n, core, rng):
    c = Compare(side(spark, A), side(spark, B), Params(fuzz_threshold=fuzz, n_out=n_out))
    assert c.blocks().count() == blocks
    k = c.kept().collect()
    assert len(k) == kept and (k[0]["n"], k[0]["core"]) == (n, core)
    p = c.pairs().first()
    assert (p["word_range_i"], p["chain_len"], p["matched_words"], p["n_blocks"]) == (rng, n, n, blocks)


def test_loose_blocks(spark):
    c = Compare(side(spark, A), side(spark, B), Params(fuzz_threshold=0.5))
    assert c.blocks().count() == 13
    k = c.kept().orderBy("k").collect()
    assert [r["d"] for r in k] == [-3, -2, -1, 0, 1, 2, 3] and c.pairs().first()["chain_len"] == 7


def test_bridges(spark):
    c = Compare(side(spark, A), side(spark, B), Params())
    assert {(r["side"], r["word"], r["fuzz"]) for r in c.bridges().collect()} == {("i", 4, 50.0), ("j", 4, 50.0)}
    d = c.pairs(detail=True).first()
    assert d["bridges_i"] == {4: 50.0} and d["matched_i"] == {0: 0, 1: 0, 2: 0, 3: 0, 5: 0, 6: 0}


def test_grams_and_idf(spark):
    g = units.leave_out_grams(side(spark, "a b c d e"), "unit", Params())
    assert {r["gram"].replace("\u0001", ""): r["c"] for r in g.collect()} == {"abc": 1, "abd": 1, "acd": 1, "bcd": 2, "bce": 1, "bde": 1, "cde": 1}
    assert units.leave_out_grams(side(spark, "a b c"), "unit", Params()).count() == 0
    c = Compare(side(spark, "a b c d"), side(spark, "a b c e"), Params())
    idf = {r["gram"].replace("\u0001", ""): r["idf"] for r in c.idf().collect()}
    assert idf["abc"] == pytest.approx(math.log(5 / 3) + 1) and idf["bcd"] == pytest.approx(math.log(2) + 1)


def test_self_comparison_is_one(spark):
    texts = ["a b c d e f g", "h i j k l m n o p"]
    c = Compare(side(spark, *texts), side(spark, *texts), Params())
    assert {(r["i"], r["j"], round(r["score"], 9)) for r in c.scored().collect()} == {(0, 0, 1.0), (1, 1, 1.0)}
    dense = {(r["i"], r["j"], round(r["score"], 9)) for r in c.all_pairs().collect()}
    assert dense == {(0, 0, 1.0), (1, 1, 1.0)}


def test_thresholds_and_events(spark):
    left, right = side(spark, A, "q r s t u v w"), side(spark, B, "q r s t u v w")
    m = Compare(left, right, Params()).meta().first()
    assert (m["n1"], m["n2"], m["n_candidates"]) == (2, 2, 2)
    lines = [json.loads(x) for x in sinks.ndjson(Compare(left, right, Params()).events(every=1))]
    assert [x["t"] for x in lines] == ["meta", "pair", "progress", "pair", "progress", "done"] and lines[-1] == {"t": "done", "found": 2, "total": 2}
    assert Compare(left, right, Params(similarity_threshold=0.99)).chosen().count() == 1


def test_empty_sides(spark):
    none = side(spark, A).limit(0)
    c = Compare(none, side(spark, B), Params())
    assert c.pairs().count() == 0 and c.meta().first()["threshold"] == 0.0


def test_clamps():
    p = Params(ngram=99, n_out=-3, min_chain_words=0, fuzz_threshold=0.1).clamped()
    assert (p.ngram, p.n_out, p.min_chain_words, p.fuzz_threshold) == (8, 0, 1, 0.5)


def test_subwords(spark):
    merges = [("a", "b"), ("ab", "</w>"), ("c", "</w>"), ("ab", "c</w>")]
    ranks = {m: i for i, m in enumerate(merges)}
    assert subwords.encode_word("ab", ranks) == ["ab</w>"] and subwords.encode_word("abc", ranks) == ["abc</w>"]
    f = spark.createDataFrame([("ab", 3), ("abc", 2)], "word string, n long")
    assert [(r["subword"], r["n"]) for r in subwords.stop_subwords(f, merges).collect()] == [("ab</w>", 3), ("abc</w>", 2)]
    assert f.select(subwords.encoder(merges, 0)("word").alias("s")).first()["s"] == ["a", "b", "</w>"]
    assert {(r["a"], r["b"]): r["n"] for r in subwords.pair_frequencies(f).collect()} == {("a", "b"): 5, ("b", "</w>"): 3, ("b", "c"): 2, ("c", "</w>"): 2}


def test_corpus_queries_keep_all_candidates(spark, tmp_path):
    # 70 equal sections against 70 documents of the same text: 4900 pairs, more than 4000; each bigram
    # occurs in 70 / 7000 units, under the cap of 4 %
    sections = [(i, f"L{i}", "a b c d e") for i in range(70)]
    documents = [(j, "a b c d e" if j < 70 else "x") for j in range(7000)]
    spark.createDataFrame(sections, "section_id long, label string, text string").write.parquet(f"{tmp_path}/sections.parquet")
    spark.createDataFrame(documents, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = compare_queries.candidate_pairs(spark, str(tmp_path)).collect()
    want = sorted((i, j * compare_queries.PER_TEXT + 1) for i in range(70) for j in range(70))
    assert [(r["i"], r["j"]) for r in sorted(got, key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in got) == list(range(1, 4901))
    assert compare_queries.scored_pairs(spark, str(tmp_path)).count() == 4900


def test_dense_keeps_every_common_gram(spark, tmp_path):
    # one common gram among hundreds of others: a score far under 0.02
    sections = [" ".join(f"s{i}x{k}" for k in range(130)) + " a b c d" for i in range(2)] + ["p q r s"]
    documents = [" ".join(f"d{j}x{k}" for k in range(130)) + " a b c e" for j in range(2)] + ["p q r s", "v w x y"]
    spark.createDataFrame([(i, f"L{i}", t) for i, t in enumerate(sections)], "section_id long, label string, text string").write.parquet(f"{tmp_path}/sections.parquet")
    spark.createDataFrame(list(enumerate(documents)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    left, right = ([Counter(".".join(w[k + x] for x in c) for k in range(len(w) - 3) for c in combinations(range(4), 3)) for w in map(str.split, side)] for side in (sections, documents))
    df = Counter(g for u in left + right for g in u)
    weigh = lambda u: {g: c / sum(u.values()) * (math.log(1 + len(left + right) / (1 + df[g])) + 1) for g, c in u.items()}
    norm = lambda w: math.sqrt(sum(x * x for x in w.values()))
    want = {}
    for i, a in enumerate(map(weigh, left)):
        for j, b in enumerate(map(weigh, right)):
            if a.keys() & b.keys():
                want[i, j * compare_queries.PER_TEXT + 1] = round(sum(a[g] * b[g] for g in a.keys() & b.keys()) / (norm(a) * norm(b)), 6)
    got = {(r["i"], r["j"]): r["score"] for r in compare_queries.compare_dense(spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want, abs=2e-6) and len(got) == 5 and min(got.values()) < 0.02


def alike(a, b, threshold):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    total = len(a) + len(b)
    return abs(len(a) - len(b)) / total <= 1.0 - threshold and 1.0 - row[-1] / total >= threshold


@pytest.mark.parametrize("threshold", [0.75, 0.9])
def test_similar_words_by_brute_force(spark, threshold):
    r = random.Random(7)
    some = {"adensis", "odensis", "aebudes", "tebudes", "ab", "abc", "abd"} | {"".join(r.choice("abαé") for _ in range(r.randint(1, 14))) for _ in range(40)}
    for w in sorted(some):
        for edits in (1, 2, 3):
            for _ in range(edits):
                k = r.randrange(len(w) + 1)
                w = w[:k] + r.choice(["", "b", "é", "xy"]) + w[k + r.randrange(2):]
            some.add(w or "a")
    want = {(a, b) for a, b in combinations(sorted(some), 2) if alike(a, b, threshold)}
    got = [tuple(x) for x in units.similar_words(spark.createDataFrame([(w,) for w in sorted(some)], "w string"), threshold).collect()]
    assert set(got) == want and len(got) == len(want) and ("adensis", "odensis") in want


def test_similar_types_with_other_first_letters(spark, tmp_path):
    spark.createDataFrame([("Adensis Tebudes",), ("Odensis aebudes",), (None,)], "author_name_latin string").write.parquet(f"{tmp_path}/canon.parquet")
    got = compare_queries.similar_types(spark, str(tmp_path)).collect()
    assert {(r["a"], r["b"], round(r["ratio"], 6)) for r in got} == {("adensis", "odensis", 0.928571), ("aebudes", "tebudes", 0.928571)}


def test_all_canon_names_are_compared(spark, tmp_path):
    names = [(1, "Plato", "Plato"), (2, "Müller", "Muller"), (3, "Ἀριστοτέλης", "Aristotle"), (4, None, "Homer"), (5, "Homerus", None), (6, None, None), (7, "", "")]
    spark.createDataFrame(names, "record_id long, author_name_latin string, author_name_english string").write.parquet(f"{tmp_path}/canon.parquet")
    ratio = {r["record_id"]: (r["ratio"], r["fuzz"]) for r in compare_queries.levenshtein_ratio(spark, str(tmp_path)).collect()}
    assert ratio == {1: (1.0, 100.0), 2: (0.916666667, 91.7), 3: (0.45, 45.0), 4: (None, None), 5: (None, None), 6: (None, None), 7: (1.0, 100.0)}
    match = {r["record_id"]: tuple(r)[1:] for r in compare_queries.word_match(spark, str(tmp_path)).collect()}
    none = (None,) * 4
    assert match == {1: (True,) * 4, 2: (True,) * 4, 3: (False,) * 4, 4: none, 5: none, 6: none, 7: (True,) * 4}


def test_corpus_units_keep_all_words(spark, tmp_path):
    text = "-".join(f"w{k}" for k in range(1000))  # one word by white space
    spark.createDataFrame([(1, "L", text)], "section_id long, label string, text string").write.parquet(f"{tmp_path}/sections.parquet")
    spark.createDataFrame([(1, text + "-end")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert compare_queries.vocab_size(spark, str(tmp_path)).first()["vocab_size"] == 1001
    assert compare_queries.word_bigrams(spark, str(tmp_path)).count() == 999
    assert compare_queries.candidate_pairs(spark, str(tmp_path)).first()["shared"] == 999


def test_gram_digests_in_slices(spark, monkeypatch):
    monkeypatch.setattr(units, "SLICE_WORDS", 40)
    monkeypatch.setattr(units, "SLICE_UNITS", 3)
    rng = random.Random(8)
    texts = [[" ".join(rng.choice("abcdé") for _ in range(rng.choice([0, 3, 9, 20]))) for _ in range(11)] for _ in range(2)]
    c = Compare(side(spark, *texts[0]), side(spark, *texts[1]))
    want = c.idf().groupBy("df").agg(F.count("*"), F.sum(compare_queries._digest("gram")), F.round(F.min("idf"), 9)).collect()
    before = shared.written(spark)
    got = c.gram_digests().select("df", "grams", "digest", F.round("idf", 9)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 3
    assert shared.written(spark) == before  # no slice stays on disk


def test_events_write_no_row_per_candidate(spark, tmp_path):
    # 60 sections and windows that share three bigrams pairwise, two of them a block; enough others for the cap
    sections = [(i, f"L{i}", f"a b c d {'k l m n o p' if i < 2 else ''} z{i}") for i in range(60)]
    documents = [(j, f"a b c d {'k l m n o p' if j < 2 else ''} y{j}") for j in range(30)] + [(j, "x") for j in range(30, 60)]
    spark.createDataFrame(sections, "section_id long, label string, text string").write.parquet(f"{tmp_path}/sections.parquet")
    spark.createDataFrame(documents, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lean, whole = (compare_queries.comparison(spark, str(tmp_path), whole=w) for w in ("texts", True))
    want = sorted(map(tuple, whole.events(every=7).collect()))
    assert sorted(map(tuple, lean.events(every=7).collect())) == want and len(want) > 1800
    assert "scored" not in lean._kept_tables and lean.packed().total() == 1800
