"""Pairs met in tiles against plain loops, with blocks so small that many tiles arise."""

import random
from collections import defaultdict

import pytest

from stemmata.operators import shared, tiles
from stemmata.plans.compare import Compare, Side
from stemmata.plans.params import Params

from .test_compare import alike, side


@pytest.mark.parametrize("cells,joined,block", [(4_000_000, 2_000_000, 4096), (40, 7, 5), (2000, 50, 9)])
def test_in_common(spark, monkeypatch, cells, joined, block):
    monkeypatch.setattr(tiles, "CELLS", cells)
    monkeypatch.setattr(tiles, "JOINED", joined)
    monkeypatch.setattr(tiles, "BLOCK_UNITS", block)
    monkeypatch.setattr(tiles, "LEAST_BLOCKS", 2)
    monkeypatch.setattr(tiles, "OUT_ROWS", 3)
    r = random.Random(4)
    keys = lambda: {7: 1.0, **{r.choice([1, 2, 3, r.randint(10, 60), -r.randint(1, 9)]): r.random() for _ in range(r.randint(0, 9))}}
    left, right = {i: keys() for i in range(30)}, {1000 + j: keys() for j in range(25)}
    frame = lambda side, name: spark.createDataFrame([(u, k, w) for u, x in side.items() for k, w in x.items()], f"{name} long, key long, w double")
    for least, most in ((1, None), (2, None), (2, 10), (9, None)):
        ok = {k for k in range(-99, 99) if most is None or sum(k in x for x in right.values()) <= most}
        want = {}
        for i, x in left.items():
            for j, y in right.items():
                common = x.keys() & y.keys() & ok
                if len(common) >= least:
                    want[i, j] = (len(common), sum(x[k] * y[k] for k in common))
        got = tiles.in_common(frame(left, "i"), frame(right, "j"), (len(left), len(right)), least, most).collect()
        assert {(g["i"], g["j"]): g["shared"] for g in got} == {k: v[0] for k, v in want.items()} and len(got) == len(want)
        for g in got:
            assert g["dot"] == pytest.approx(want[g["i"], g["j"]][1])
    none = frame(left, "i").limit(0)
    assert tiles.in_common(none, frame(right, "j"), (0, len(right))).count() == 0


@pytest.mark.parametrize("threshold,length", [(0.75, 4), (0.5, 2), (0.9, 3), (1.0, 2)])
def test_may_align(spark, monkeypatch, threshold, length):
    monkeypatch.setattr(tiles, "BLOCK_UNITS", 7)
    monkeypatch.setattr(tiles, "LEAST_BLOCKS", 2)
    r = random.Random(9)
    stock = ["λόγος", "λόγου", "λόγον", "ab", "abc", "b", "", "😀", "ποταμος", "ποταμον", "x" * 70, "x" * 60 + "y" * 10, "καὶ", "και"]
    words = lambda: [r.choice(stock) for _ in range(r.randint(0, 14))]
    left, right = {i: words() for i in range(16)}, {j: words() for j in range(18)}
    left[99] = [r.choice(stock) for _ in range(1200)]
    pairs = [(i, j) for i in left for j in right if (i + j) % 4]
    same = lambda a, b: a == b or alike(a, b, threshold)
    want = set()
    for i, j in pairs:
        x, y = left[i], right[j]
        if any(all(same(x[p + k], y[q + k]) for k in range(length)) for p in range(len(x) - length + 1) for q in range(len(y) - length + 1)):
            want.add((i, j))
    frame = lambda units, name: spark.createDataFrame(list(units.items()), f"{name} long, words array<string>")
    got = [tuple(g) for g in tiles.may_align(spark.createDataFrame(pairs, "i long, j long"), frame(left, "i"), frame(right, "j"), (len(left), len(right)), threshold, length).collect()]
    assert set(got) == want and len(got) == len(want) and want


def test_scores_of_words_and_subwords(spark):
    """Weights from hashed grams equal the plain ones; subword mode scores subwords without the stop ones."""
    import math
    from collections import Counter
    from itertools import combinations

    merges = (("a", "b"), ("ab", "</w>"), ("c", "</w>"))
    r = random.Random(3)
    text = lambda: " ".join(r.choice(["ab", "abc", "c", "ba", "cab"]) for _ in range(r.randint(2, 12)))
    ls, rs = [text() for _ in range(6)], [text() for _ in range(6)]
    from stemmata.operators.subwords import encode_word

    ranks = {m: i for i, m in enumerate(merges)}
    for p, cut in ((Params(min_shared=1), str.split), (Params(min_shared=1, merges=merges, stop=frozenset({"c</w>"})), lambda t: [s for w in t.split() for s in encode_word(w, ranks) if s != "c</w>"])):
        grams = [Counter(x for k in range(len(w) - 3) for x in combinations(w[k : k + 4], 3)) for w in map(cut, ls + rs)]
        df = Counter(g for c in grams for g in c)
        weigh = lambda c: {g: n / sum(c.values()) * (math.log(1 + len(grams) / (1 + df[g])) + 1) for g, n in c.items()}
        size = lambda w: math.sqrt(sum(x * x for x in w.values()))
        w = [weigh(c) for c in grams]
        c = Compare(side(spark, *ls), side(spark, *rs), p)
        for g in c.scored().collect():
            x, y = w[g["i"]], w[6 + g["j"]]
            dot = sum(x[k] * y[k] for k in x.keys() & y.keys())
            assert g["score"] == pytest.approx(dot / (size(x) * size(y)) if dot else 0.0)
        got = {(g["side"], g["unit"]): g["norm"] for g in c.norms().collect()}
        assert got == pytest.approx({(1 + k // 6, k % 6): size(x) for k, x in enumerate(w) if x})
        assert c.meta().first()["mode"] == ("words" if p.merges is None else "subwords")


def test_side_in_several_comparisons_and_release(spark):
    right = Side(side(spark, "a b c d x e f", "q r s t"))
    right.bigrams()  # made before, so that no release takes it
    for text in ("a b c d y e f", "q r s t"):
        before = shared.written(spark)
        assert Compare(side(spark, text), right, Params()).candidates().count() == 1
        assert shared.release(spark, before) > 0
    assert right.units.count() == 2


def test_shared_folder_of_a_cluster():
    class Cluster:
        class conf:
            get = staticmethod(lambda k, d=None: d)

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError):
        shared.shared_folder(Cluster)


def test_windowed_counts(spark, tmp_path):
    from stemmata.streaming import incremental

    rows = [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 23:00:00", "a", 2.0), ("2024-01-02 01:00:00", "b", 4.0), ("2024-01-05 00:00:00", "a", 8.0)]
    spark.createDataFrame(rows, "ts string, event_type string, value double").selectExpr("cast(ts as timestamp) ts", "event_type", "value").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "e"))
    q = incremental.windowed_counts(stream).writeStream.format("memory").queryName("wc").outputMode("complete").start()
    q.processAllAvailable()
    got = defaultdict(float)
    for r in spark.sql("select * from wc").collect():
        got[str(r["start"])[:10], r["event_type"], r["n"]] += r["total"]
    q.stop()
    assert got == {("2024-01-01", "a", 2): 3.0, ("2024-01-02", "b", 1): 4.0, ("2024-01-05", "a", 1): 8.0}


@pytest.mark.parametrize("threshold,ngram,n_out", [(0.75, 4, 1), (0.5, 2, 0), (0.9, 3, 2), (0.8, 5, 1)])
def test_bands_against_loops(spark, monkeypatch, threshold, ngram, n_out):
    """Bands and parts so small that many arise: candidates with ranks, runs, blocks and kept blocks as plain loops have them."""
    from stemmata.operators import bands

    for name, value in (("BAND_UNITS", 5), ("PART_UNITS", 4), ("TOGETHER", 2), ("LEAST_UNITS", 3), ("JOINED", 20), ("PACKED", 3), ("OUT_ROWS", 7), ("ALIGNED", 2), ("GRAM_UNITS", 3)):
        monkeypatch.setattr(bands, name, value)
    r = random.Random(5)
    stock = ["λόγος", "λόγου", "λόγον", "ab", "abc", "b", "ποταμος", "ποταμον", "x" * 40, "x" * 34 + "y" * 6]
    text = lambda: " ".join(r.choice(stock) for _ in range(r.randint(0, 12)))
    ls, rs = [text() for _ in range(14)] + [" ".join(r.choice(stock) for _ in range(150))], [text() for _ in range(60)]
    c = Compare(side(spark, *ls), side(spark, *rs), Params(max_candidates=None, cap_words=None, min_shared=2, fuzz_threshold=threshold, ngram=ngram, n_out=n_out))
    grams = lambda t: set(zip(t.split(), t.split()[1:]))
    often = {g for t in rs for g in grams(t) if sum(g in grams(x) for x in rs) > 40}
    want = [(i, j, len((grams(x) & grams(y)) - often)) for i, x in enumerate(ls) for j, y in enumerate(rs)]
    want = sorted((w for w in want if w[2] >= 2), key=lambda w: (-w[2], w[0], w[1]))
    assert sorted((g["rank"], g["i"], g["j"], g["shared"]) for g in c.candidates().collect()) == [(k, *w) for k, w in enumerate(want, 1)]
    runs, blocks, kept = set(), set(), set()
    for i, j, _ in want:
        x, y = ls[i].split(), rs[j].split()
        own = []
        for d in range(-len(x), len(y)):
            places = [p for p in range(len(x)) if 0 <= p + d < len(y) and (x[p] == y[p + d] or alike(x[p], y[p + d], threshold))]
            ends: list[list[int]] = []
            for p in places:
                if ends and ends[-1][1] == p:
                    ends[-1][1] += 1
                else:
                    ends.append([p, p + 1])
            own += [(d, a, b - a) for a, b in ends]
        if not any(n >= ngram for _, _, n in own):
            continue
        runs |= {(i, j, *o) for o in own}
        fused: list[list] = []
        for d, a, n in sorted(own):
            if fused and fused[-1][0] == d and a - fused[-1][4] <= n_out:
                fused[-1] = [d, fused[-1][1], fused[-1][2] + n, max(fused[-1][3], n), a + n]
            else:
                fused.append([d, a, n, n, a + n])
        blocks |= {(i, j, *f[:4]) for f in fused}
        kept |= {(i, j, *f[:4], len(fused)) for f in fused if f[3] >= ngram and f[2] >= 2}
    assert runs and {tuple(g) for g in c.runs().collect()} == runs
    assert {tuple(g) for g in c.blocks().drop("runs").collect()} == blocks
    assert {tuple(g) for g in c.kept().select("i", "j", "d", "a", "n", "core", "n_blocks").collect()} == kept
    assert {tuple(g) for g in c.aligned().collect()} == {b[:2] for b in blocks}


def test_threshold_leaves_pairs_out_of_the_alignment(spark):
    left, right = side(spark, "a b c d x e f", "q r s t u v w"), side(spark, "a b c d y g h", "q r s t u v w")
    assert {(g["i"], g["j"]) for g in Compare(left, right, Params(similarity_threshold=0.9)).pairs().collect()} == {(1, 1)}
    assert Compare(left, right, Params()).aligned().count() == 2


def test_candidates_write_hashes_only(spark):
    rng = random.Random(5)
    make = lambda n: spark.createDataFrame([(u, "", w, w) for u in range(n) for w in [[f"word{rng.randrange(60)}" for _ in range(30)]]], "unit long, label string, orig array<string>, norm array<string>")
    left, right = make(700).persist(), make(600).persist()
    whole = Compare(left, right).candidates().collect()
    before = shared.written(spark)
    lean = Compare(Side(left, whole=False), Side(right, whole=False))
    got = lean.candidates().collect()
    assert whole and sorted(got) == sorted(whole)
    assert shared.written(spark) - before == 3  # hashes of the left side, index of the right one, pairs
    assert [f.dataType.simpleString() for f in spark.read.parquet(lean.sides[0].stored(True)).drop("block").schema] == ["bigint", "array<bigint>"]
    assert spark.read.parquet(lean.sides[0].stored(True)).select("block").distinct().count() > 1


def test_pairs_score_only_what_keeps_a_block(spark):
    a = side(spark, "a b c d x e f", "p q r s t u v w", "a b c zz d e f yy")
    b = side(spark, "a b c d y e f", "p q r s t u v w", "b c d a e f g")
    p = Params(max_candidates=None, min_shared=1)
    c, whole = Compare(a, b, p), Compare(a, b, p)
    whole.scored()
    want = sorted(whole.pairs().collect())
    assert sorted(c.pairs().collect()) == want and want and whole.scored().count() > len(want)
    assert "scored" not in c._kept_tables and c._kept_tables["scored kept"].count() == len(want)
    bare = Compare(a, b, p)
    got = bare.pairs(score=False)
    assert sorted(got.collect()) == sorted(whole.pairs().drop("score").collect()) and bare._stored_weights is None


def test_dense_in_bands_leaves_bounded_tables(spark, monkeypatch):
    """Bands, parts, strips and slices so small that many arise: all pairs with a common gram, nothing shuffled, slices deleted."""
    from stemmata.operators import bands

    for name, value in (("BAND_UNITS", 5), ("PART_UNITS", 4), ("LEAST_UNITS", 3), ("JOINED", 4), ("OUT_ROWS", 7), ("GRAM_UNITS", 3), ("SLICE_WORDS", 60), ("RANGES", 4), ("CELLS", 9)):
        monkeypatch.setattr(bands, name, value)
    r = random.Random(6)
    text = lambda: " ".join(r.choice("abcdefgh") for _ in range(r.choice([0, 3, 9, 14])))
    ls, rs = [text() for _ in range(17)], [text() for _ in range(19)]
    left, right = side(spark, *ls), side(spark, *rs)
    whole = Compare(left, right, Params(max_candidates=None, min_shared=1))
    w = {n: defaultdict(dict) for n in (1, 2)}
    for x in whole.weights().collect():
        w[x["side"]][x["unit"]][x["key"]] = x["w"]
    size = {(x["side"], x["unit"]): x["norm"] for x in whole.norms().collect()}
    want = {}
    for i, x in w[1].items():
        for j, y in w[2].items():
            if x.keys() & y.keys():
                want[i, j] = sum(x[k] * y[k] for k in x.keys() & y.keys()) / size[1, i] / size[2, j]
    before = shared.written(spark)
    c = Compare(Side(left, whole=False), Side(right, whole=False))
    got = c.all_pairs()
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    rows = got.collect()
    assert {(g["i"], g["j"]): g["score"] for g in rows} == pytest.approx(want) and len(rows) == len(want) > 20
    assert shared.written(spark) - before == 5  # hashes of both sides, their weights, those of the right side by gram


def test_hashed_words_as_tokenised(spark, tmp_path):
    """Sides of hashes have the words of the whole ones, and keep the same blocks."""
    from stemmata.operators import units
    from stemmata.plans import compare_queries as q

    r = random.Random(11)
    odd = ["(12)", "a(3)b", "((1)2)x", "[7]", "Λόγος", "λογοσ", "ﷺ", "x-y", "½", "_z", "\u00a0", "\u2003", "\x1c", "\n", "e\u0301", "…", "ΑΣ", "x²", "(1", "2)", "٣"]
    long = lambda n: " ".join(r.choice(odd) if r.random() < 0.4 else f"w{r.randrange(60)}" for _ in range(n))
    shared_text = " ".join(f"λόγος{k}" for k in range(12))
    texts = [None, "", " ", "\u00a0", *odd, *[long(n) for n in (5, 25, 26, 139, 140, 141, 255, 256, 400)], shared_text + " a b", "c " + shared_text.upper()]
    spark.createDataFrame([(k, f"L{k}", t) for k, t in enumerate(texts)], "section_id long, label string, text string").write.parquet(f"{tmp_path}/sections.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lean, whole = q.comparison(spark, str(tmp_path), whole="texts"), q.comparison(spark, str(tmp_path))
    for a, b in zip(lean.sides, whole.sides):
        text = dict(zip(*(sum(c, []) for c in zip(*[(x["keys"], x["texts"]) for x in a.units.collect() if x["keys"]]))))
        got = {x["unit"]: [text[w] for w in x["words"]] for x in a.units.collect()}
        assert got == {x["unit"]: x["norm"] for x in b.units.collect()} and len(got) > 30
    cols = ("i", "j", "k", "d", "a", "n", "core", "n_blocks")
    want = sorted(map(tuple, whole.kept().select(*cols).collect()))
    assert sorted(map(tuple, lean.kept().select(*cols).collect())) == want and want
    assert "norm" not in spark.read.parquet(lean.sides[1].stored(False)).columns


@pytest.mark.parametrize("numbered", [4_000_000, 0])
def test_subwords_scored_from_hashes(spark, tmp_path, monkeypatch, numbered):
    """Scores by subwords of sides of hashes are those of whole sides, and neither words nor subwords are written as texts."""
    from stemmata.operators import bands
    from stemmata.plans import compare_queries as q

    monkeypatch.setattr(bands, "NUMBERED", numbered)
    r = random.Random(12)
    text = lambda: " ".join(r.choice(["ab", "abc", "c", "Ba(3)", "cab", "αβ"]) for _ in range(r.randint(0, 30)))
    spark.createDataFrame([(k, f"L{k}", text()) for k in range(30)], "section_id long, label string, text string").write.parquet(f"{tmp_path}/sections.parquet")
    spark.createDataFrame([(k, text()) for k in range(30)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    p = Params(max_candidates=None, cap_words=None, merges=(("a", "b"), ("ab", "</w>"), ("c", "</w>")), stop=frozenset({"c</w>"}))
    lean, whole = (q.comparison(spark, str(tmp_path), p, whole=w) for w in (False, True))
    rows = lambda c: {(x["i"], x["j"], x["shared"], x["rank"]): x["score"] for x in c.scored().collect()}
    got, want = rows(lean), rows(whole)
    assert got == pytest.approx(want) and len(want) > 100 and max(want.values()) > 0
    assert all(f.dataType.simpleString() in ("bigint", "array<bigint>", "int") for f in spark.read.parquet(lean.sides[1].stored(False)).schema)


@pytest.mark.parametrize("ngram, n_out", [(4, 1), (2, 0), (3, 2), (5, 2)])
def test_scores_of_few_symbols(spark, monkeypatch, ngram, n_out):
    """Few subwords are scored without lists of their grams; these are counted with repeats, in pieces of some units."""
    import math
    from collections import Counter
    from itertools import combinations

    from stemmata.operators import bands
    from stemmata.operators.subwords import encode_word

    def no_lists(*_):
        raise AssertionError("lists of grams are written")

    monkeypatch.setattr(bands, "weighted", no_lists)
    monkeypatch.setattr(bands, "gram_df", no_lists)
    monkeypatch.setattr(bands, "LEFT_PLACES", 40)
    monkeypatch.setattr(bands, "RIGHT_PLACES", 30)
    merges, stop = (("a", "b"), ("ab", "</w>")), frozenset({"c</w>", "</w>"})
    r = random.Random(ngram)
    text = lambda: " ".join(r.choice(["ab", "abc", "c", "ba", "aaaa", "x"]) for _ in range(r.choice([0, 1, 2, 3, 9, 30])))
    ls, rs = [text() for _ in range(12)], [text() for _ in range(12)]
    subs = [[s for w in t.split() for s in encode_word(w, {m: i for i, m in enumerate(merges)}) if s not in stop] for t in ls + rs]
    grams = [Counter(x for k in range(len(s) - ngram + 1) for x in combinations(s[k : k + ngram], ngram - n_out)) for s in subs]
    df = Counter(g for c in grams for g in c)
    w = [{g: n / sum(c.values()) * (math.log(1 + len(grams) / (1 + df[g])) + 1) for g, n in c.items()} for c in grams]
    size = [math.sqrt(sum(v * v for v in x.values())) for x in w]
    c = Compare(side(spark, *ls), side(spark, *rs), Params(min_shared=1, merges=merges, stop=stop, ngram=ngram, n_out=n_out))
    of = c._scorer(c.packed())
    got = {(i, j): s for band in range(c._blocks_of()[0]) if (x := of(band)) for i, j, s in zip(x[0].tolist(), x[1].tolist(), x[4].tolist())}
    want = {(i, j): sum(v * w[12 + j].get(g, 0) for g, v in w[i].items()) / (size[i] * size[12 + j] or 1) for i, j in got}
    assert got == pytest.approx(want) and len(got) >= 10 and max(got.values()) > 0 and got == {(x["i"], x["j"]): pytest.approx(x["score"]) for x in c.scored().collect()}


@pytest.mark.parametrize("numbered", [4_000_000, 0])
def test_subwords_spelled_once_per_word(spark, tmp_path, monkeypatch, numbered):
    """Sides store words only and score by subwords of the vocabulary; ends of words are counted as those of all words."""
    from stemmata.operators import bands
    from stemmata.operators import subwords as S
    from stemmata.plans import compare_queries as q

    monkeypatch.setattr(bands, "NUMBERED", numbered)
    r = random.Random(13)
    text = lambda: " ".join(r.choice(["ab", "abc", "c", "Ba(3)", "cab ab", "½", "ΑΣ", "ΑΣ́.Β", "x\ny"]) for _ in range(r.randint(0, 30)))
    texts = [None, "", " ", *[text() for _ in range(30)]]
    spark.createDataFrame([(k, f"L{k}", t) for k, t in enumerate(texts)], "section_id long, label string, text string").write.parquet(f"{tmp_path}/sections.parquet")
    spark.createDataFrame([(k, text()) for k in range(30)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    p = Params(max_candidates=None, cap_words=None, merges=(("a", "b"), ("ab", "</w>"), ("c", "</w>")), stop=frozenset({"c</w>"}))
    lean, whole = (q.comparison(spark, str(tmp_path), p, whole=w) for w in ("texts", True))
    rows = lambda c: {(x["i"], x["j"], x["shared"], x["rank"]): x["score"] for x in c.scores().collect()}
    got, want = rows(lean), rows(whole)
    assert got == pytest.approx(want) and len(want) > 100 and max(want.values()) > 0
    assert set(spark.read.parquet(lean.sides[1].stored(False)).columns) == {"unit", "words", "block"}
    s = spark.read.parquet(f"{tmp_path}/sections.parquet")
    plain = [tuple(x) for x in S.stop_subwords(S.word_frequencies(s, "text"), list(p.merges)).collect()]
    assert [tuple(x) for x in S.most_frequent(S.ending_frequencies(s, "text", list(p.merges))).collect()] == plain and len(plain) == 3
