"""Hand-computed values of the text functions."""

import pytest
from pyspark.sql import functions as F

from stemmata.functions import text as X
from stemmata.operators import lod, units


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)) if cols else spark.range(1)
    return df.select(expr.alias("v")).first()["v"]


def test_normal_form(spark):
    assert one(spark, X.normalize_text("a"), a="Ποταμὸς") == "ποταμος"
    assert one(spark, X.normalize_text("a"), a="ﬁn ½ Ａ") == "fin 1⁄2 a"
    assert one(spark, X.normalize_text("a"), a=None) is None
    assert one(spark, X.strip_greek("a"), a="Ποταμὸς") == "ποταμοσ"
    assert one(spark, X.normalize_words(X.words(F.col("a"))), a="Ἀρχὴ τοῦ") == ["αρχη", "του"]
    assert one(spark, X.normalize_words(X.words(F.col("a"))), a="·") == []


def test_tokens(spark):
    assert one(spark, X.strip_milestones(F.col("a")), a="a (15) b [2]  c") == "a b c"
    assert one(spark, X.words(X.strip_milestones(F.col("a"))), a="été, a_b (15) 15") == ["été", "a_b", "15"]


@pytest.mark.parametrize("a,b,t,ratio,match", [
    ("ποταμον", "ποταμος", 0.75, 1 - 1 / 14, True), ("abc", "xyz", 0.5, 0.5, True), ("ab", "abc", 0.8, 0.8, False), ("ab", "abc", 0.75, 0.8, True), ("", "", 0.9, 1.0, True)])
def test_likeness(spark, a, b, t, ratio, match):
    assert one(spark, X.levenshtein_ratio(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(ratio)
    assert one(spark, X.word_match(F.col("a"), F.col("b"), t), a=a, b=b) is match


@pytest.mark.parametrize("text,name,epi", [("Homerus Epic.", "Homerus", "Epic."), ("Dionysius Hist. et Rhet.", "Dionysius", "Hist. et Rhet."), ("Acta Alexandrinorum", "Acta Alexandrinorum", None), ("Epic.", "", "Epic.")])
def test_epitheton(spark, text, name, epi):
    assert tuple(one(spark, X.peel_epitheton(F.col("a")), a=text)) == (name, epi)


@pytest.mark.parametrize("b,d,era", [
    ("-0484-01-01", "-0425-01-01", "5th c. B.C."), ("-0099-01-01", "-0020-01-01", "1th c. B.C."), ("0046-01-01", "0120-01-01", "1st–2nd c. A.D."),
    ("-0063-09-23", "0014-08-19", "1st c. B.C."), (None, None, None), (None, "0301-01-01", "4th c. A.D.")])
def test_era(spark, b, d, era):
    assert one(spark, X.format_era(F.col("b"), F.col("d")), b=b, d=d) == era


def test_small_functions(spark):
    assert one(spark, X.first_script(F.col("a")), a="De figuris (= Περὶ σχημάτων)") == "la"
    assert one(spark, X.first_script(F.col("a")), a="Περὶ Συντάξεως") == "grc"
    assert one(spark, X.first_script(F.col("a")), a="123") is None
    assert one(spark, X.first_script(F.col("a")), a=None) is None
    assert one(spark, X.viaf_curie(F.col("a")), a="https://viaf.org/viaf/108159964/") == "viaf:108159964"
    assert one(spark, X.latin_to_greek(F.col("a")), a="mhnin") == "μηνιν"
    assert one(spark, X.latin_to_greek(F.col("a")), a="homeros") == "ηομερος"
    for text, greek in (("xc", "ξχ"), ("Charis", "χηαρις"), ("ass s1", "ασς ς1")):
        assert one(spark, X.latin_to_greek(F.col("a")), a=text) == greek == X.typed_in_greek(text)
    assert one(spark, X.strip_greek("a"), a="ΛΌΓΟΣ λόγος ½") == "λογος λογοσ 1⁄2"
    assert one(spark, X.expand_curie(F.col("a"), lod.PREFIXES), a="wd:Q1") == "http://www.wikidata.org/entity/Q1"
    assert [one(spark, X.expand_curie(F.col("a"), lod.PREFIXES), a=a) for a in ("http://x:y", "plain", "no:1", None)] == ["http://x:y", "plain", "no:1", None]
    assert tuple(one(spark, X.exact_work(F.col("a")), a=" 31.002 ")) == ("0031", "002") and one(spark, X.exact_work(F.col("a")), a="31.02") is None
    assert one(spark, X.json_one_or_list(F.array("a", "a")), a='x "y"') == '"x \\"y\\""' and one(spark, X.json_one_or_list(F.array("a", F.lit("b"))), a="x") == '["x","b"]'
    assert one(spark, X.zero_fill(F.col("a"), 4), a="17") == "0017"
    assert one(spark, X.zero_fill(F.col("a"), 4), a="12345") == "12345"
    assert one(spark, X.quote_url(F.col("a")), a="a b&c") == "a%20b%26c"
    assert one(spark, X.escape_html(F.col("a")), a="<a href='x'>&\"") == "&lt;a href=&#39;x&#39;&gt;&amp;&quot;"
    assert one(spark, X.json_quote(F.col("a")), a='Ἰλιὰς "x"\\') == '"Ἰλιὰς \\"x\\"\\\\"'
    assert one(spark, lod.publishable(F.col("a"), F.lit(True)), a="restricted:x") is False


@pytest.mark.parametrize("n,spans", [(0, [(0, 0)]), (140, [(0, 140)]), (141, [(0, 140), (115, 141)]), (255, [(0, 140), (115, 255)]), (256, [(0, 140), (115, 255), (230, 256)])])
def test_windows(spark, n, spans):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)))], "id long, t string")
    rows = units.windows(df, "id", "t").orderBy("k").collect()
    got = [(int(r["words"][0][1:]), int(r["words"][-1][1:]) + 1) if r["words"] else (0, 0) for r in rows]
    assert got == spans and [r["k"] for r in rows] == list(range(1, len(spans) + 1))
