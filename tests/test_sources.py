"""Small inputs of every reader, and round trips of the sinks."""

import json
import sqlite3

from pyspark.sql import functions as F

from stemmata.operators import index, lod
from stemmata.sources import files, html, sinks, xml
from stemmata.streaming import incremental


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return str(p)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_author_list(spark, tmp_path):
    p = put(tmp_path, "a.html", "<ul><li>0012 Homerus Epic.</li><li>0001 Apollonius <b>Rhodius</b> Epic.</li></b><li>0012 Other</li><li>x</li></ul>")
    assert rows(html.author_list(html.files(spark, p)), "author_id") == [("0001", "Apollonius Rhodius", "Epic."), ("0012", "Homerus", "Epic.")]


def test_author_table(spark, tmp_path):
    row = "<tr><td>{}</td><td>{} ( <a>2 works</a> ) <div class='works'>{}</div></td></tr>"
    p = put(tmp_path, "b.html", "<table>" + row.format("31", "New Name Hist.", "<span>001 <i>Newest</i></span><br><span>002 B</span>") + row.format("0031", "Old", "<span>001 Older</span><span>003 C</span>") + "<tr><td>1</td></tr></table>")
    a, w = html.author_table(html.files(spark, p))
    assert rows(a, "author_id") == [("0031", "New Name", "Hist.")]
    assert rows(w, "work_id") == [("0031", "001", "Newest"), ("0031", "002", "B"), ("0031", "003", "C")]


def test_hopper(spark, tmp_path):
    ref = "Perseus%3Atext%3A{}%3Abook%3D{}%3Achapter%3D{}"
    words = "".join(f'<a href="x" class="text">ἀνήρ{i}</a> ' for i in range(9))
    p = put(tmp_path, "c.html", words + ref.format("1.1", 2, 10) + " " + ref.format("1.2", 1, 1) + " " + ref.format("1.1", 2, 9) + " " + ref.format("1.1", 2, 9))
    assert [r[1:] for r in rows(html.hopper_sections(html.files(spark, p)), "index")] == [("1.1", 2, 9, 0), ("1.1", 2, 10, 1)]


TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>T</title></titleStmt><sourceDesc><p>Ed. 1900</p></sourceDesc></fileDesc></teiHeader>
<text><body><div type="edition"><div type="textpart" n="1"><head>H</head><div type="textpart" n="2"><p>on<hi>e</hi> two</p></div><div type="textpart"><l n="5">three</l></div></div>
<div type="textpart" n="9"/><div type="textpart" n="3"><p>four</p></div></div></body></text></TEI>"""


def test_tei(spark, tmp_path):
    f = html.files(spark, put(tmp_path, "t.xml", TEI))
    b = [r[1:] for r in rows(xml.read_tei(f), "sec_index", "block_pos")]
    assert b == [("T", "Ed. 1900", 0, "1", 0, "head", None, "H"), ("T", "Ed. 1900", 0, "1", 1, "para", None, "on e two"), ("T", "Ed. 1900", 0, "1", 2, "line", "5", "three"), ("T", "Ed. 1900", 2, "3", 0, "para", None, "four")]
    assert [r[1:] for r in rows(xml.read_tei_units(f), "unit")] == [(0, "1.2", "on e two"), (1, "1.?", "three"), (2, "3", "four")]
    assert xml.read_tei(html.files(spark, put(tmp_path, "bad.xml", "<TEI"))).count() == 0


def test_inventory(spark, tmp_path):
    t = """<ti:TextInventory xmlns:ti="http://x"><ti:textgroup urn="urn:cts:greekLit:tlg0012"><ti:groupname xml:lang="eng">Homer</ti:groupname><ti:groupname xml:lang="lat">Homerus L.</ti:groupname>
<ti:work urn="urn:cts:greekLit:tlg0012.tlg001"><ti:title xml:lang="eng">Iliad</ti:title><ti:edition urn="urn:cts:greekLit:tlg0012.tlg001.perseus-eng1"><ti:label xml:lang="eng">x</ti:label></ti:edition>
<ti:edition urn="urn:cts:greekLit:tlg0012.tlg001.perseus-grc2"><ti:label xml:lang="grc">Ἰλιάς</ti:label><ti:description xml:lang="eng">Monro</ti:description></ti:edition></ti:work></ti:textgroup></ti:TextInventory>"""
    a, w = xml.read_inventory(spark, put(tmp_path, "i.xml", t))
    assert rows(a, "author_id") == [("0012", "Homer", "Homerus L.", None)]
    r = w.first()
    assert (r["work_id"], r["title_english"], r["title_greek"], r["edition"], r["greek_edition_urn"][-4:]) == ("001", "Iliad", "Ἰλιάς", "Monro", "grc2")


def test_lists(spark, tmp_path):
    md = "| 0012.001 |  | Ilias | x | y | z |\n| 0012.002 | Homer | Odyssea | urn:cts:greekLit:tlg0012.tlg002 | y | z |\n| 0012.001 | Z | Late | x | y | z |\nno\n"
    a, w = files.work_list(html.files(spark, put(tmp_path, "l.md", md)))
    assert rows(a, "author_id") == [("0012", "Homer")]
    assert rows(w, "work_id") == [("0012", "001", "Ilias", None), ("0012", "002", "Odyssea", "urn:cts:greekLit:tlg0012.tlg002")]
    tree = {"tree": [{"path": f"data/tlg0001/tlg001/{x}.xml"} for x in ("perseus-eng2", "perseus-grc2", "1st1K-grc1")] + [{"path": "data/tlg0001/tlg002/perseus-eng1.xml"}, {"path": "README"}]}
    assert rows(files.repository_tree(html.files(spark, put(tmp_path, "t.json", json.dumps(tree)))), "work_id") == [("0001", "001", "1st1K-grc1.xml")]


def test_bindings_and_overlay(spark, tmp_path):
    v = lambda **k: {n: {"value": x} for n, x in k.items()}
    b = {"results": {"bindings": [v(tlg="0012", qidStr="http://w/Q1", grcLabel="Ὅμηρος"), v(tlg="0012", qidStr="http://w/Q2"), v(tlg="0013", birth="-0484-01-01", death="-0425-01-01")]}}
    got = {r["author_id"]: r for r in files.bindings(html.files(spark, put(tmp_path, "b.json", json.dumps(b)))).collect()}
    assert got["0012"]["wikidata_qid"] == "Q1" and got["0013"]["era"] == "5th c. B.C."
    o = files.overlay(html.files(spark, put(tmp_path, "o.json", json.dumps({"0012": {"works": {"001": {"title_english": "The Iliad"}}}}))))
    assert rows(o.select("author_id", "work_id", "title_english"), "work_id") == [("0012", "001", "The Iliad")]
    base = spark.createDataFrame([("0012", "001", "Ilias", "Iliad", None, None, None, True)], "author_id string, work_id string, title_latin string, title_english string, title_greek string, edition string, cts_urn string, cts_confirmed boolean")
    once = index.upsert_works(base, o)
    twice = index.upsert_works(once.select(*base.columns), o)
    r = once.first()
    assert (r["title_english"], r["title_latin"], r["action"], r["source"]) == ("The Iliad", "Ilias", "patched", "local:curated") and once.exceptAll(twice).count() == 0
    text = {"title": "T", "sections": [{"index": 0, "label": "1", "blocks": [{"kind": "para", "text": "x"}]}]}
    c = files.cached_texts(html.files(spark, put(tmp_path, "c.json", json.dumps(text)))).select("sec_index", "label", "kind", "text")
    assert rows(c, "sec_index") == [(0, "1", "para", "x")]
    d = files.resolve([c.where("text = 'y'"), c, c.withColumn("text", F.lit("z"))], ["sec_index"])
    assert [(r["text"], r["tier"]) for r in d.collect()] == [("x", 1)]
    p = files.plain_blocks(html.files(spark, put(tmp_path, "p.txt", "one\ntwo\n\n \n three \n")))
    assert [r["text"] for r in p.orderBy("block_pos").collect()] == ["one\ntwo", "three"]
    ar = put(tmp_path, "ar.json", json.dumps({"response": {"docs": [{"identifier": f"i{k}", "title": "t"} for k in range(9)]}}))
    wi = put(tmp_path, "wi.json", json.dumps({"query": {"search": [{"title": f"A {k}"} for k in range(9)]}}))
    links = files.api_links(html.files(spark, ar), html.files(spark, wi))
    assert links.where("id = 'archive'").count() == 5 and links.where("url = 'https://texts.example/A_0'").count() == 1


def test_sinks(spark, data, tmp_path):
    a = index.merge_authors(spark.read.parquet(f"{data}/canon.parquet"))
    w = index.merge_works(spark.read.parquet(f"{data}/works.parquet"))
    sinks.write_sqlite(a, w, str(tmp_path / "x.db"))
    with sqlite3.connect(str(tmp_path / "x.db")) as db:
        assert db.execute("select count(*) from works").fetchone()[0] == w.count()
    sinks.write_csv(index.flat(a, w), str(tmp_path / "csv"), ["author_id", "work_id"])
    back = spark.read.csv(str(tmp_path / "csv"), header=True)
    assert back.count() == index.flat(a, w).count() and {r[0] for r in back.select("cts_confirmed").distinct().collect()} <= {"True", "False", None}
    sinks.write_jsonld(lod.nodes(a, w), str(tmp_path / "g.json"), {"id": "@id"}, lod.head_nodes("Index", {"id": "source/1", "type": "Book"}))
    graph = json.load(open(tmp_path / "g.json"))["@graph"]
    assert len(graph) == a.count() + 2 and graph[1]["source"] == graph[0]["id"] and {n.get("inScheme") for n in graph[2:]} == {lod.BASE}
    sinks.write_ntriples(lod.editions(w.withColumn("source", F.lit(None).cast("string"))), str(tmp_path / "nt"), "editions")
    assert spark.read.text(str(tmp_path / "nt")).where("value = '# editions'").count() == 1
    sinks.write_json(index.documents(a, w), str(tmp_path / "c.json"))
    doc = json.load(open(tmp_path / "c.json"))
    assert list(doc) == sorted(doc) and len(doc) == a.count() and sum(len(x["works"]) for x in doc.values()) == w.join(a, "author_id").count()
    assert "| authors |" in sinks.report_text(index.report(a, w))


def test_streams(spark, tmp_path):
    right = spark.createDataFrame([(7, "r", "a b c d e".split(), "a b c d e".split())], "unit long, label string, orig array<string>, norm array<string>")
    src = tmp_path / "in"
    spark.createDataFrame([(1, "n", "a b c d e")], "unit long, label string, text string").write.parquet(str(src))
    got = []
    q = incremental.stream_candidates(spark.readStream.schema("unit long, label string, text string").parquet(str(src)), right, lambda df, e: got.extend(tuple(r) for r in df.collect()))
    q.processAllAvailable()
    q.stop()
    assert got == [(1, 7, 4)]


def test_schema_rules(spark):
    good = {"author_id": "0012", "author_name_latin": None, "source": ["x"], "works": {"001": {"work_id": "001", "cts_urn": "urn:cts:greekLit:tlg0012.tlg001", "cts_confirmed": True}}}
    bad = [
        ({**good, "source": []}, "source"), ({**good, "extra": 1}, "unknown key"), ({**good, "era": 5}, "era"), ({k: v for k, v in good.items() if k != "author_name_latin"}, "author_name_latin missing"),
        ({**good, "works": {"001": {**good["works"]["001"], "cts_confirmed": "yes"}}}, "cts_confirmed"), ({**good, "works": {"1": {**good["works"]["001"], "cts_urn": "urn:x"}}}, "key"), ({**good, "author_id": "12"}, "author_id"),
    ]
    docs = spark.createDataFrame([("0012", json.dumps(d)) for d in [good, *[b for b, _ in bad]]], "author_id string, node string").withColumn("n", F.monotonically_increasing_id())
    assert index.schema_violations(docs.where("n = 0")).count() == 0 or index.schema_violations(spark.createDataFrame([("0012", json.dumps(good))], "author_id string, node string")).count() == 0
    for d, rule in bad:
        got = {r["rule"] for r in index.schema_violations(spark.createDataFrame([("0012", json.dumps(d))], "author_id string, node string")).collect()}
        assert rule in got and len(got) <= 2
    assert {r["rule"] for r in index.schema_violations(spark.createDataFrame([("12", "no json")], "author_id string, node string")).collect()} >= {"no object", "key"}


def test_leaks(spark):
    lines = spark.createDataFrame([('<x/0012.001> <p> "Ed. Monro 1920" .',), ('<x/0012.0011> <p> "short" .',), ("<x/0013.001> <p> <y> .",)], "line string")
    guarded = spark.createDataFrame([("x/0012.001",), ("Monro",), ("rt",), ("absent",), (None,), ("",)], "secret string")
    got = {(r["line"].split(">")[0][1:], r["secret"]) for r in lod.leaks(lines, guarded).collect()}
    assert got == {("x/0012.001", "x/0012.001"), ("x/0012.001", "Monro"), ("x/0012.0011", "x/0012.001"), ("x/0012.0011", "rt")}


def test_hopper_candidates_and_texts(spark):
    w = spark.createDataFrame([("0012", "001", "urn:cts:greekLit:tlg0012.tlg001.perseus-grc2"), ("0012", "002", None)], "author_id string, work_id string, greek_edition_urn string")
    got = [(r["work_id"], r["doc"].rsplit(".", 1)[-1]) for r in html.hopper_candidates(w).orderBy("work_id", "place").collect()]
    assert got == [("001", x) for x in ("perseus-grc2", "perseus-grc1", "perseus-grc3", "tlg001")] + [("002", x) for x in ("perseus-grc1", "perseus-grc2", "perseus-grc3", "tlg002")]
    p = spark.createDataFrame([("a", '<a class="text">μῆνιν</a> <a>no</a><a class="text"> </a><a class="text">ἄειδε</a>')], "path string, value string")
    assert [tuple(r) for r in html.hopper_texts(p).collect()] == [("a", "μῆνιν ἄειδε")]


def test_passages(spark):
    refs = '<r xmlns="http://chs.harvard.edu/xmlns/cts"><urn>urn:x:1.1</urn><urn>urn:x:1.2</urn><urn>urn:x:1.3</urn><urn/></r>'
    tei = '<p xmlns="http://www.tei-c.org/ns/1.0"><head>H</head><l n="7">one  two</l><l/></p>'
    a = spark.createDataFrame([("w", refs), ("v", "<broken"), ("u", None)], "path string, value string")
    p = spark.createDataFrame([("urn:x:1.1", tei), ("urn:x:1.3", tei), ("urn:x:1.2", "<x")], "path string, value string")
    got = rows(xml.read_passages(a, p), "sec_index", "block_pos")
    assert got == [("w", k, f"1.{k + 1}", b, *t) for k in (0, 2) for b, t in enumerate([("para", None, "H one two"), ("head", None, "H"), ("line", "7", "one two")])]


def test_tiers(spark):
    t = "author_id string, work_id string, label string, text string"
    local = spark.createDataFrame([("0001", "001", "1", "here")], t)
    tei = TEI + "<!-- " + "x" * 200 + " -->"
    repo = spark.createDataFrame([("0001", "001", "p1", tei), ("0002", "001", "p2", tei), ("0003", "001", "p3", "<TEI/>")], "author_id string, work_id string, path string, value string")
    page = spark.createDataFrame([("0003", "001", "1.1", "page"), ("0002", "001", "1.1", "page")], t)
    got = files.work_texts(local, repo, page.limit(0), page).orderBy("author_id", "label").collect()
    assert [(r["author_id"], r["label"], r["tier"]) for r in got] == [("0001", "1", 0), ("0002", "1.2", 1), ("0002", "1.?", 1), ("0002", "3", 1), ("0003", "1.1", 3)]


def test_corpus_texts(spark):
    j = {"sections": [{"index": 0, "label": "1", "blocks": [{"text": "a"}, {"kind": "x"}, {"text": "b"}]}]}
    p = spark.createDataFrame([("a.xml", TEI), ("b.json", json.dumps(j)), ("c.json", json.dumps({"blocks": [{"text": "c"}]})), ("d.txt", "plain"), ("e.txt", ""), ("f.json", "no"), ("g.xml", "<"), ("h.md", "x")], "path string, value string")
    assert rows(files.corpus_texts(p), "path") == [("a.xml", "H on e two three four"), ("b.json", "a  b"), ("c.json", "c"), ("d.txt", "plain")]


def test_build(spark, tmp_path):
    page = lambda name, text: html.files(spark, put(tmp_path, name, text))
    from stemmata.plans.build import build_index

    a, w = build_index(
        spark, classic=page("a.html", "<ul><li>0012 Homerus Epic.</li></ul>"), listed=page("l.md", "| 0012.001 | Homer | Ilias | x | y | z |\n| 0099.001 | New | Old | x | y | z |\n"),
        graph=page("b.json", json.dumps({"results": {"bindings": [{"tlg": {"value": "0012"}, "grcLabel": {"value": "Ὅμηρος"}}, {"tlg": {"value": "5555"}}]}})),
        curated=page("o.json", json.dumps({"0012": {"works": {"001": {"title_english": "Iliad"}, "002": {"title_latin": "Odyssea"}}}})))
    got = {r["author_id"]: r for r in a.collect()}
    assert set(got) == {"0012", "0099"} and got["0012"]["author_name_greek"] == "Ὅμηρος" and got["0012"]["epitheton"] == "Epic." and got["0012"]["author_name_english"] == "Homer"
    assert {(r["author_id"], r["work_id"], r["title_latin"], r["title_english"], r["action"]) for r in w.collect()} == {("0012", "001", "Ilias", "Iliad", "patched"), ("0012", "002", "Odyssea", None, "added"), ("0099", "001", "Old", None, "kept")}
    a, w = build_index(spark)
    assert a.count() == 0 and w.count() == 0


def test_fetch(spark, tmp_path):
    from stemmata.sources.fetch import fetch

    page = put(tmp_path, "page.html", "<p>ἄνδρα</p>" + "x" * 300)
    short = put(tmp_path, "short.html", "no")
    a = spark.createDataFrame([("a", f"file://{page}"), ("b", f"file://{short}"), ("c", f"file://{page}.gone"), ("d", None), ("e", "no address")], "path string, url string").coalesce(1)
    got = rows(fetch(a, str(tmp_path / "cache"), least_bytes=200), "path")
    assert [(p, s) for p, _, s in got] == [("a", "fetched"), ("b", "failed"), ("c", "failed"), ("d", "failed"), ("e", "failed")] and got[0][1].startswith("<p>ἄνδρα") and got[1][1] is None
    assert rows(fetch(a, str(tmp_path / "cache"), least_bytes=200), "path")[0][2] == "cached"


def test_elements_of_many_pages_come_in_bounded_frames():
    import pandas as pd

    page = "<p>" + "<a class='text'>x</a>" * 999 + "</p>"
    frames = list(html._parse(iter([pd.DataFrame({"path": [str(k) for k in range(100)], "value": [page] * 100})])))
    assert sum(map(len, frames)) == 100_000 and max(map(len, frames)) <= 21_000
