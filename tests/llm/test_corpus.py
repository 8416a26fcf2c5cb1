"""The corpus operators against brute force and on edge cases."""

import base64
import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stemmata.llm import canonical, mixing, neardup, quality, shared, survivor, terms, tokens
from stemmata.llm import codepoints as C

TEXT = "id long, text string, seed string, a long, n string"  # extra columns with clashing names


def texts(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], TEXT)


def plain_terms(text):
    """Term form of a text in consistent form, character by character."""
    flat = "".join(c for c in unicodedata.normalize("NFD", text or "") if not unicodedata.category(c).startswith("M"))
    out, word = [], ""
    for c in flat.lower() + " ":
        if c.isalpha():
            word += "σ" if c == "ς" else c
        elif word:
            out.append(word)
            word = ""
    return out


WORDS = [f"{a}{b}{c}" for a in "βγδκλ" for b in "αεοω" for c in ("νος", "μα", "τις", "ρη")]


def sentences(n, size, seed=1):
    r = random.Random(seed)
    return [[r.choice(WORDS) for _ in range(r.randint(size // 2, size))] for _ in range(n)]


# -- problem 4

@pytest.mark.parametrize("stored,form", [
    ("λόγος", "λόγος"), ("λόγος", "λόγος"), ("ＡＢ，", "AB,"), ("ﬁnis", "finis"), ("a​b­c﻿", "abc"), ("a b　c", "a b c"), ("λoγος", "λόγος".replace("ό", "ο")),
    ("ΤΡΟФЕІΝ".replace("Ф", "Φ"), "ΤΡΟΦΕΙΝ"), ("lеtterа", "lettera"), ("µετα", "μετα"), ("Ωρα", "Ωρα"), ("τί;", "τί;"), ("vόμος", "νόμος"), ("ᾳ", "ᾳ"),
])
def test_form(stored, form):
    cp, off, other = C.consistent(*C.decode(pa.array([stored])))
    assert C.encode(cp, off).to_pylist() == [form] and other.tolist() == [True]


@pytest.mark.parametrize("text", ["B¹ A²", "ᾱ́λος", "Υ̓́μνος", "plain text; τὸ πᾶν·", "tab\tline\n", "", "μετὰ the", "𐅄 😀", "a [12] b"])
def test_no_case(text):
    cp, off, other = C.consistent(*C.decode(pa.array([text])))
    assert C.encode(cp, off).to_pylist() == [text] and other.tolist() == [False]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("abο αόάﬁ́̓ͅ​ Ａ１·;ς\n­о¹😀"), max_size=30)), max_size=6))
def test_form_is_stable_and_batch_free(rows):
    cp, off, other = C.consistent(*C.decode(pa.array(rows, pa.string())))
    whole = C.encode(cp, off).to_pylist()
    for row, out, o in zip(rows, whole, other.tolist()):
        c1, o1, f1 = C.consistent(*C.decode(pa.array([row], pa.string())))
        assert C.encode(c1, o1).to_pylist() == [out] and f1.tolist() == [o] and (o or out == (row or ""))
        c2, o2, f2 = C.consistent(c1, o1)
        assert C.encode(c2, o2).to_pylist() == [out] and unicodedata.normalize("NFC", out) == out
        assert not f2[0] or o  # a word of two scripts without look-alikes stays a case


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abcdeαβόςΣΆ ὖ1.,-\n"), max_size=40), min_size=1, max_size=5))
def test_terms_match_plain_loop(rows):
    rows = [unicodedata.normalize("NFC", r) for r in rows]
    rows = [r for r in rows if not any(len({unicodedata.name(c)[:5] for c in w}) > 1 for w in plain_terms(r))]  # words of one script
    t = C.Terms(*C.decode(pa.array(rows, pa.string())))
    got = t.text(np.arange(len(t.hash))).to_pylist()
    assert [(r, w) for r, w in zip(t.row.tolist(), got)] == [(i, w) for i, r in enumerate(rows) for w in plain_terms(r)]
    same = defaultdict(set)
    for h, w in zip(t.hash.tolist(), got):
        same[h].add(w)
    assert all(len(v) == 1 for v in same.values())


def test_inconsistent_rows(spark):
    df = texts(spark, [(1, "a b"), (2, "ab"), (3, None), (4, ""), (5, "x" * 200_000 + "​")])
    assert {r["id"] for r in canonical.inconsistent(df, "id", "text").collect()} == {1, 5}
    got = {r["id"]: (r["text"], r["changed"]) for r in canonical.consistent_form(df, "id", "text").collect()}
    assert got[1] == ("a b", True) and got[3] == (None, False) and got[4] == ("", False)
    assert canonical.consistent_form(df.limit(0), "id", "text").count() == 0


# -- problems 3 and 6

def collection():
    rows = [(i, " ".join(w)) for i, w in enumerate(sentences(60, 25))] + [(100, None), (101, ""), (102, "· 12 —"), (103, "Μόνος μόνος ΜΌΝΟΣ"), (103, "Μόνος")]
    return rows


@pytest.mark.parametrize("most", [0, 5, 4096])
def test_counts(spark, most):
    rows = collection()
    occ, rec = Counter(), Counter()
    for _, t in rows:
        w = plain_terms(t)
        occ.update(w)
        rec.update(set(w))
    s = terms.TermStatistics(texts(spark, rows), "id", "text", most=most)
    got = {r["term"]: (r["occurrences"], r["records"]) for r in s.counts().collect()}
    assert got == {w: (occ[w], rec[w]) for w in occ} and s.rows == len(rows)


def test_marks_and_weights(spark):
    rows = collection()
    df = texts(spark, rows)
    rec, occ = Counter(), Counter()
    for _, t in rows:
        rec.update(set(plain_terms(t)))
        occ.update(plain_terms(t))
    want = {w: "rare" if n == 1 else "common" if n > len(rows) / 5 else None for w, n in rec.items()}
    assert {r["term"]: r["mark"] for r in terms.marked_terms(df, "id", "text").collect()} == want
    n = len(rows)
    ridf = lambda w: -np.log2(rec[w] / n) + np.log2(1 - np.exp(-occ[w] / n))
    got = Counter()
    for r in terms.term_weights(df, "id", "text").collect():
        assert r["weight"] == pytest.approx(r["tf"] * ridf(r["term"]))
        got[r["id"], r["term"], r["tf"]] += 1
    assert got == Counter((i, w, k) for i, t in rows for w, k in Counter(plain_terms(t)).items())
    few = {(r["id"], r["term"]) for r in terms.term_weights(df, "id", "text", min_tf=3, max_df=4).collect()}
    assert few == {(i, w) for i, t in rows for w, k in Counter(plain_terms(t)).items() if k >= 3 and rec[w] <= 4}
    none = texts(spark, [(1, None)]).where("id = 2")
    assert terms.marked_terms(none, "id", "text").count() == 0 and terms.term_weights(none, "id", "text").count() == 0


# -- problem 1

def near_pairs(rows, share=(7, 10), least=20):
    docs = [(i, Counter(plain_terms(t))) for i, t in rows if i is not None]
    docs = [(i, c) for i, c in docs if sum(c.values()) >= least]
    out = set()
    for x, (i, a) in enumerate(docs):
        for j, b in docs[x + 1 :]:
            if i != j and sum((a & b).values()) * share[1] >= share[0] * max(sum(a.values()), sum(b.values())):
                out.add((min(i, j), max(i, j)))
    return out


def edited(seed=3):
    r = random.Random(seed)
    rows, base = [], sentences(40, 60, seed)
    for k, w in enumerate(base):
        rows.append((k * 10, " ".join(w)))
        for v in range(1, 5):
            x = list(w)
            for _ in range(r.randint(0, len(x) // 2)):
                x[r.randrange(len(x))] = f"{r.choice(WORDS)}{r.choice('αεηο')}"
            if r.random() < 0.3:
                r.shuffle(x)
            rows.append((k * 10 + v, ", ".join(x)))
    return rows


def test_near_duplicates(spark):
    rows = edited() + [(900, None), (901, ""), (902, "λίγα"), (903, rows_text := " ".join(sentences(1, 60, 9)[0])), (904, rows_text), (904, rows_text), (None, rows_text), (905, "α β " * 30_000), (906, "β α " * 29_000)]
    nd = neardup.NearDuplicates(texts(spark, rows), "id", "text")
    got = [(r["a"], r["b"]) for r in nd.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == near_pairs(rows) and (903, 904) in got and (905, 906) in got


def test_near_duplicates_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 3)  # every tile is split
    rows = edited(5)[:60]
    assert {(r["a"], r["b"]) for r in neardup.NearDuplicates(texts(spark, rows), "id", "text").pairs().collect()} == near_pairs(rows)
    assert neardup.NearDuplicates(texts(spark, rows).limit(0), "id", "text").pairs().count() == 0


def test_hot_class_is_a_star(spark):
    same = " ".join(sentences(1, 60, 11)[0])
    rows = [(i, same) for i in range(300)] + [(1000, same + " νέον")]
    got = {(r["a"], r["b"]) for r in neardup.NearDuplicates(texts(spark, rows), "id", "text").pairs().collect()}
    assert got == {(0, i) for i in range(1, 300)} | {(0, 1000)}


@pytest.mark.parametrize("class_rows", [1000, 20])
def test_hot_class_of_different_texts(spark, monkeypatch, class_rows):
    monkeypatch.setattr("stemmata.llm.common.CLASS_ROWS", class_rows)
    words = sentences(1, 60, 11)[0]
    order = [" ".join(words[k:] + words[:k]) for k in range(3)]  # the same terms
    rows = [(i, order[i % 2]) for i in range(120)] + [(1000 + i, order[0] + " νέον") for i in range(2)]
    got = {(r["a"], r["b"]) for r in neardup.NearDuplicates(texts(spark, rows), "id", "text").pairs().collect()}
    ids = [i for i, _ in rows]
    assert got == {(a, b) for a in ids for b in ids if a < b}
    rows = [(i, order[0]) for i in range(110)] + [(200 + i, order[1 + i % 2]) for i in range(6)] + [(1000, order[0] + " νέον")]
    got = {(r["a"], r["b"]) for r in neardup.NearDuplicates(texts(spark, rows), "id", "text").pairs().collect()}
    ids = [0, *range(200, 206), 1000]
    assert got == {(0, i) for i in range(1, 110)} | {(a, b) for a in ids for b in ids if a < b}


# -- problem 5

def test_shared_spans(spark):
    r = random.Random(2)
    noise = lambda n: "".join(r.choice("αβγδε ζ😀") for _ in range(n))
    p150, p149, long = noise(150), noise(149), noise(700)
    rows = [(1, noise(80) + p150 + noise(90)), (2, p150), (3, noise(30) + p149), (4, p149 + noise(60)), (5, long), (6, noise(10) + long[100:400] + noise(20) + long[450:690]), (7, long), (8, None), (9, ""), (10, "— " * 120), (11, "— " * 100 + "x"), (None, long), (12, noise(100_000))]
    known = [(i, t) for i, t in rows if i is not None]
    grams = defaultdict(set)
    for i, t in known:
        for k in range(len(t or "") - 149):
            grams[t[k : k + 150]].add(i)
    want = {(a, b) for s in grams.values() for a in s for b in s if a < b}
    sp = shared.SharedSpans(texts(spark, rows), "id", "text")
    assert {(x["a"], x["b"]) for x in sp.pairs().collect()} == want and {(1, 2), (5, 6), (6, 7), (5, 7), (10, 11)} <= want and (3, 4) not in want
    cover = {i: [False] * len(t or "") for i, t in known}
    for i, t in known:
        for k in range(len(t or "") - 149):
            if len(grams[t[k : k + 150]]) > 1:
                cover[i][k : k + 150] = [True] * 150
    got = {x["id"]: x["shared_chars"] for x in sp.coverage().collect()}
    assert got == {i: sum(cover[i]) for i, t in known if len(t or "") >= 150}
    assert shared.SharedSpans(texts(spark, rows).limit(0), "id", "text").pairs().count() == 0


# -- problem 7

@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    with open(f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.sampled_from("abtheing 'sll\n\t\x1c\x85 ​é́Ωωκαὶ1²中😀<|endoftext|>_-"), max_size=60))
def test_encoding(reference, text):
    assert tokens.encoder(f"{tokens.TOKENIZERS}/byte_bpe_50k.json").encode([text]).to_pylist() == [reference.encode_ordinary(text)]


def test_encoding_of_rows(spark, data, reference):
    rows = [(1, None), (2, ""), (3, "<|endoftext|>"), (4, "ἀλετονταί " * 20_000), (4, "x"), (5, "x" * 3000)]
    got = sorted((r["id"], list(r["ids"])) for r in tokens.encode(texts(spark, rows), "id", "text").collect())
    assert got == sorted((i, reference.encode_ordinary(t or "")) for i, t in rows)
    sf = spark.read.parquet(f"{data}/documents.parquet")
    want = {r["doc_id"]: reference.encode_ordinary(r["text"] or "") for r in sf.collect()}
    assert {r["doc_id"]: list(r["ids"]) for r in tokens.p7_ids(spark, data).collect()} == want


def test_forgetting(monkeypatch, reference):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    e = tokens.Encoder(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    for t in ("one two three four five", "two six seven", "one eight"):
        assert e.encode([t]).to_pylist() == [reference.encode_ordinary(t)] and e.count([t, None]).tolist() == [len(reference.encode_ordinary(t)), 0]


# -- problem 8

def test_mixture(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SALT_ROWS", 50)
    r = random.Random(4)
    docs = [(i, " word" * r.randint(1, 60), s) for s, k in (("big", 900), ("mid", 300), ("tiny", 40), ("other", 50)) for i in range(hash(s) % 7 * 10_000, hash(s) % 7 * 10_000 + k)] + [(-1, None, "big"), (-2, "", "mid"), (-3, "word", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumnRenamed("doc_id", "k").withColumn("doc_id", __import__("pyspark").sql.functions.monotonically_increasing_id())
    targets = spark.createDataFrame([("big", 0.5, 2), ("mid", 0.3, 2), ("tiny", 0.1, 3), ("none", 0.1, 4)], "source string, target_share double, max_repeats int")
    m = mixing.Mixture(df, targets)
    shares = {x["source"]: x for x in m.shares().collect()}
    for s, t in (("big", 0.5), ("mid", 0.3), ("tiny", 0.1)):
        assert shares[s]["actual_share"] == pytest.approx(t / 0.9, abs=0.01)
    assert shares["none"]["mixed_tokens"] == 0 and shares["tiny"]["expected_copies"] == 3.0
    rows = m.chosen().collect()
    cap = {"big": 2, "mid": 2, "tiny": 3}
    assert all(1 <= x["copies"] <= cap[x["source"]] and x["n_tokens"] > 0 for x in rows) and len({x["id"] for x in rows}) == len(rows)
    e = shares["big"]["expected_copies"]
    assert abs(sum(x["copies"] for x in rows if x["source"] == "big") - e * 900) <= 1
    assert {tuple(x) for x in rows} == {tuple(x) for x in mixing.Mixture(df, targets).chosen().collect()}
    assert mixing.Mixture(df.limit(0), targets).chosen().count() == 0 and mixing.Mixture(df, targets.limit(0)).chosen().count() == 0


# -- problem 9

GOOD = ["ὁ δὲ λόγος καὶ τὸ ἔργον, ὡς οἱ παλαιοὶ λέγουσι, τῆς ψυχῆς ἐστιν.", "A short sentence of the night.", "the one and the other\nwere in the house of\nthe king and his men.\n\n• one\n• two", "der Mann und die Frau sind in der Stadt.", "in the house of the king 😀 and his men, who were there."]
BAD = ["• alpha\n• beta\n• gamma\n• delta", "1) one\n2. two\n3) three", "a;12;3.4\nb;;7\nc;1;2", "| a | 1 |\n|---|---|\n| b | 2 |", "Name, 12, 33\nOther, 4\nThird, 5, 6", "-=-=-=-=-=-=", "deadbeef0123\n99aa88bb77cc", "same line here\n" * 9, "<div n=\"1\"><lb/></div>\n" * 4, "uf.opb eriKs ςaρπὸ οσςῖ rWet;biu udn rüEcb Aσλ;μ", "ΚÃ¼Ã©Ã Ã¼Ã©", "alpha: the first\nbeta: the second one\ngamma: a third"]


def test_quality(spark):
    rows = [(i, t) for i, t in enumerate(GOOD)] + [(100 + i, t) for i, t in enumerate(BAD)] + [(200, None), (201, ""), (202, " \n​"), (203, "the king and the men of the house. " * 8000)]
    words = ["the", "and", "of", "in", "δὲ", "καὶ", "τὸ", "τῆς", "οἱ", "ὁ", "ὡς", "der", "und", "die", "sind"]
    got = {r["id"]: r for r in quality.text_statistics(texts(spark, rows), "id", "text", words).collect()}
    assert {i for i, r in got.items() if r["reasons"]} == {100 + i for i in range(len(BAD))} and len(got) == len(rows)
    assert (got[1]["words"], got[1]["lines"], got[1]["n_chars"], got[1]["ended_share"]) == (6, 1, 30, 1.0) and got[1]["common_share"] == pytest.approx(1 / 3)
    assert got[100]["bullet_share"] == 1.0 and got[107]["repeated_share"] == pytest.approx(8 / 9) and got[200]["words"] == 0
    assert quality.text_statistics(texts(spark, rows).limit(0), "id", "text", []).count() == 0


# -- problem 2

def test_survivors(spark, tmp_path):
    ts = "2024-01-0{} 00:00:00"
    canon = [
        (1, "0012", None, "Homerus", "Homer", ["b"], ts.format(1)), (2, "tlg0012", "900", "Hom…", None, ["a"], ts.format(2)), (3, None, "viaf:900", "Homeros", "(vacat)", ["zz", "b"], ts.format(3)),
        (4, " 12", None, "Homeric", "Homer", ["b"], ts.format(3)), (5, None, None, "Solo", "Solo", ["a"], ts.format(1)), (6, "0013", None, " ", "?", None, None), (7, "13", None, None, "Late", [], None), (8, None, "77", "X", None, ["a"], None), (9, None, "77", "Y", None, ["a"], ts.format(1))]
    works = [
        (1, "0012", "001", "Ilias", "urn:cts:greekLit:tlg0012.tlg001.", "b", ts.format(1)), (2, None, None, "n/a", "urn:cts:greekLit:tlg0012.tlg001", "b", ts.format(1)), (3, "TLG 0012", "1", "Ilias...", "urn:cts:greekLit:tlg0012.tlg002", "a", None), (4, "0012", "002", "Od", None, "a", ts.format(1))]
    cast = lambda df: df.withColumn("seen_at", df["seen_at"].cast("timestamp"))
    cast(spark.createDataFrame(canon, "record_id long, author_id string, viaf_id string, author_name_latin string, author_name_english string, source array<string>, seen_at string")).write.parquet(str(tmp_path / "canon.parquet"))
    cast(spark.createDataFrame(works, "record_id long, author_id string, work_id string, title_latin string, cts_urn string, source string, seen_at string")).write.parquet(str(tmp_path / "works.parquet"))
    spark.createDataFrame([("a", 1), ("b", 2)], "source string, tier int").write.parquet(str(tmp_path / "source_tiers.parquet"))
    got = {tuple(r) for r in survivor.p2_found(spark, str(tmp_path)).collect()}
    assert got == {("author_name_latin", 3), ("author_name_english", 4), ("author_name_english", 7), ("author_name_latin", 9), ("title_latin", 1), ("cts_urn", 2)}


def test_survivors_in_sql(spark, data):
    import duckdb

    c = duckdb.connect()
    for t in ("canon", "works", "source_tiers"):
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    for name, sql in survivor.SQL.items():
        df = survivor.QUERIES[name](spark, data)
        cur = c.execute(sql)
        assert sorted(d[0] for d in cur.description) == sorted(df.columns)
        order = [[d[0] for d in cur.description].index(x) for x in df.columns]
        assert sorted(map(tuple, df.collect())) == sorted(tuple(r[k] for k in order) for r in cur.fetchall())


@pytest.mark.parametrize("block_rows", [10_000, 7])
def test_boilerplate_anchor(spark, monkeypatch, block_rows):
    monkeypatch.setattr(shared, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(shared, "HELD_PAIRS", 50)
    r = random.Random(8)
    notice = "".join(r.choice("αβγδε ζ") for _ in range(180))
    rows = [(i, f"{i:05d}" * r.randint(0, 9) + notice + "".join(r.choice("λμν ") for _ in range(40))) for i in range(60)] + [(100, notice[:149] + "!"), (101, "x" * 400)]
    got = [(x["a"], x["b"]) for x in shared.SharedSpans(texts(spark, rows), "id", "text").pairs().collect()]
    assert set(got) == {(a, b) for a in range(60) for b in range(a + 1, 60)} and len(got) == len(set(got))


@pytest.mark.parametrize("at", [0, 3, 5])
def test_extension_from_a_seed(at):
    x, y = (np.array([ord(c) for c in t], np.uint32) for t in ("zzabcdefgzz", "qabcdefgq"))
    assert shared.extend(x, y, [(2 + at, 1 + at), (2 + at, 1 + at)], 7) == [(2, 1, 7)]
    assert shared.extend(x, y, [(2 + at, 1 + at)], 8) == []


def test_many_pairs_of_one_tile(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HELD_PAIRS", 20)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 10)
    words = sentences(1, 60, 21)[0]
    rows = [(i, " ".join(words[: len(words) - i % 5] + [WORDS[i % 7]])) for i in range(50)]
    assert {(r["a"], r["b"]) for r in neardup.NearDuplicates(texts(spark, rows), "id", "text").pairs().collect()} == near_pairs(rows)


def test_near_duplicates_across_size_bands(spark):
    words = [f"λ{'αβγδε'[i % 5]}{'ικλμ'[i // 5 % 4]}{'νξοπρ'[i // 20 % 5]}{'στυ'[i // 100]}" for i in range(300)]
    rows = [(n, " ".join(words[:n])) for n in (*range(44, 92, 3), 63, 64, 65, 182, 200, 255, 256, 258)]
    got = {(r["a"], r["b"]) for r in neardup.NearDuplicates(texts(spark, rows), "id", "text").pairs().collect()}
    assert got == near_pairs(rows) and (63, 64) in got and (200, 256) in got


def test_short_run_before_a_long_one(spark):
    r = random.Random(5)
    noise = lambda n, s: "".join(r.choice(s) for _ in range(n))
    rows = []
    for k in range(40):
        x, y = noise(r.randint(64, 120), "αβγδε "), noise(150, "αβγδε ")
        rows += [(2 * k, noise(r.randint(0, 70), "λμν") + x + "!" + y + "?"), (2 * k + 1, noise(r.randint(0, 70), "ρστ") + x + ";" + y + ".")]
    got = {(x["a"], x["b"]) for x in shared.SharedSpans(texts(spark, rows), "id", "text").pairs().collect()}
    assert got == {(2 * k, 2 * k + 1) for k in range(40)}


def test_published_rules_alone(spark):
    prose = "the king and the men of the house were there in the night and they saw it. " * 4
    cases = {
        "mean word length": "a i o u e " * 12, "signs per word": "the end # of the # men and … so it # was", "bullet lines": "• the one\n• the two\n• and three\n",
        "ellipsis lines": "the one...\nthe two…\nand the end.", "words without letters": "the 12 34 -- 5 67 and", "few stop words": "βατος " * 60, "duplicate lines": "the man went home.\n" * 3,
    }
    rows = [(0, prose), (1, "A short word."), *[(10 + i, t) for i, t in enumerate(cases.values())], (99, "the man went to his own house and home.\n" * 2 + "and the other one did not.\nso it was.\nthen it ended.")]
    got = {r["id"]: r["reasons"] for r in quality.text_statistics(texts(spark, rows), "id", "text", ["the", "and", "of", "in", "it"], domain=None).collect()}
    assert got[0] == [] and got[1] == []
    for i, reason in enumerate(cases):
        assert reason in got[10 + i]
    assert got[99] == ["duplicate line characters"]


def test_shared_folder(spark, monkeypatch):
    from stemmata.llm import common

    df = common.cut(texts(spark, [(1, "a")]))
    assert df.count() == 1 and common.release(spark) >= 1 and common.release(spark) == 0

    class Cluster:
        class conf:
            get = staticmethod(lambda k, d=None: d)

        class sparkContext:
            master = "spark://x:7077"

    with pytest.raises(ValueError):
        common.shared_folder(Cluster)


def test_bounded_memory(monkeypatch, reference):
    monkeypatch.setattr(tokens, "REMEMBERED_PAIRS", 2)
    monkeypatch.setattr(C, "REMEMBERED", 1)
    e = tokens.Encoder(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    for t in ("one two three four five", "κατὰ τὴν γῆν", "unter den Linden"):
        assert e.encode([t]).to_pylist() == [reference.encode_ordinary(t)]
    for stored, form in (("e\u0301a\u0300", "éà"), ("o\u0302u\u0308", "ôü")):
        cp, off, _ = C.consistent(*C.decode(pa.array([stored])))
        assert C.encode(cp, off).to_pylist() == [form]
