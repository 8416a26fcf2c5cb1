"""The command line from sources to answers."""

import json
import sqlite3

from stemmata.cli import main
from stemmata.operators import lod


def test_index_commands(spark, data, tmp_path, capsys):
    put = lambda name, text: (tmp_path / name).write_text(text, encoding="utf-8") and str(tmp_path / name)
    run = lambda *argv: main([str(x) for x in argv], spark)
    classic = put("a.html", "<ul><li>0012 Homerus Epic.</li><li>0013 Hesiodus Epic.</li></ul>")
    listed = put("l.md", "| 0012.001 | Homer | Ilias | x | y | z |\n| 0013.001 | Hesiod | Theogonia | x | y | z |\n")
    secret = put("o.json", json.dumps({"0013": {"works": {"001": {"edition": "Secret Ed. 1900", "source": "restricted:x"}}}}))
    assert run("build", "--out", tmp_path / "i0", "--classic", classic, "--listed", listed) == 0
    assert run("overlay", "--index", tmp_path / "i0", "--pages", secret, "--out", tmp_path / "i1") == 0
    assert run("validate", "--index", tmp_path / "i1") == 0
    assert run("export", "--index", tmp_path / "i1", "--out", tmp_path / "e") == 0
    assert set(json.load(open(tmp_path / "e/index.json"))) == {"0012", "0013"} and "| authors | 2 |" in (tmp_path / "e/report.md").read_text()
    with sqlite3.connect(tmp_path / "e/index.db") as db:
        assert db.execute("select author_id, latin_title, seq from works order by 1").fetchall() == [("0012", "Ilias", 1), ("0013", "Theogonia", 1)]
    assert run("publish", "--index", tmp_path / "i1", "--out", tmp_path / "p") == 0
    assert len(json.load(open(tmp_path / "p/index.jsonld"))["@graph"]) == 4
    assert run("guard", "--index", tmp_path / "i1", "--published", tmp_path / "p/links.nt") == 0
    leaky = put("leak.nt", f"<{lod.BASE}0013.001> <p> <o> .\n")
    capsys.readouterr()
    assert run("guard", "--index", tmp_path / "i1", "--published", leaky) == 1 and capsys.readouterr().out == "1 leaks\n"
    assert run("search", "--index", tmp_path / "i1", "hes") == 0 and capsys.readouterr().out == "0013\tHesiodus\n"
    assert run("query", "section_index", "--data", data, "--out", tmp_path / "q") == 0 and spark.read.parquet(str(tmp_path / "q")).count() > 0


def test_compare_command(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("one two three four five six\n\nother words here", encoding="utf-8")
    (tmp_path / "b.txt").write_text("zero\n\none two three four five seven", encoding="utf-8")
    assert main(["compare", str(tmp_path / "a.txt"), str(tmp_path / "b.txt"), "--min-shared", "2", "--max-candidates", "0"], spark) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [x["t"] for x in lines] == ["meta", "pair", "done"] and lines[1]["pair"]["word_range_i"] == "1–5" and (lines[1]["pair"]["label_i"], lines[1]["pair"]["label_j"]) == ("1", "2")
