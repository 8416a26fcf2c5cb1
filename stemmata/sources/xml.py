"""TEI texts and CTS inventories as rows."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_T = "{http://www.tei-c.org/ns/1.0}"
BLOCKS = "path string, title string, edition string, sec_index int, label string, block_pos int, kind string, n string, text string"
UNITS = "path string, unit int, label string, text string"


def _inner(el) -> str:
    return " ".join(" ".join(el.itertext()).split())


def _edition(root):
    body = root.find(f".//{_T}body")
    if body is None:
        return None
    found = body.find(f".//{_T}div[@type='edition']")
    return body if found is None else found


def _parts(el) -> list:
    return [c for c in el if c.tag == f"{_T}div" and c.get("type") == "textpart"]


_KINDS = {f"{_T}head": "head", f"{_T}l": "line", f"{_T}p": "para"}


def tei_blocks(text: str) -> list[tuple]:
    """(title, edition, sec_index, label, block_pos, kind, n, text); broken files have no rows.

    Sections are the parts right below the edition, else its numbered divs, else all of it.
    Blocks of nested parts belong to their section; empty sections leave a gap in the index.
    """
    try:
        root = ET.fromstring(text)
    except (ET.ParseError, TypeError, ValueError):
        return []
    ed = _edition(root)
    head = root.find(f".//{_T}teiHeader//{_T}titleStmt/{_T}title")
    src = root.find(f".//{_T}teiHeader//{_T}sourceDesc")
    title, edition = (_inner(head) if head is not None else None), ((_inner(src) or None) if src is not None else None)
    if ed is None:
        return []
    secs = _parts(ed) or [c for c in ed if c.tag == f"{_T}div" and c.get("n")]
    numbered = [(i, s.get("n") or str(i + 1), s) for i, s in enumerate(secs)] if secs else [(0, "1", ed)]
    rows = []
    for i, label, s in numbered:
        blocks = [(_KINDS[e.tag], e.get("n") if e.tag == f"{_T}l" else None, _inner(e)) for e in s.iter() if e.tag in _KINDS]
        rows += [(title, edition, i, label, k, *b) for k, b in enumerate(b for b in blocks if b[2])]
    return rows


def tei_units(text: str) -> list[tuple[str, str]]:
    """(label, text) of the deepest parts, labelled by the dotted path of their numbers."""
    try:
        ed = _edition(ET.fromstring(text))
    except (ET.ParseError, TypeError, ValueError):
        return []
    if ed is None:
        return []
    out, todo = [], [(c, c.get("n") or "?") for c in reversed(_parts(ed))]
    if not todo:
        return [("1", _inner(ed))] if _inner(ed) else []
    while todo:
        el, label = todo.pop()
        kids = _parts(el)
        if kids:
            todo += [(c, f"{label}.{c.get('n') or '?'}") for c in reversed(kids)]
        elif _inner(el):
            out.append((label, _inner(el)))
    return out


def _rows(parse, names, ints):
    def run(batches):
        for pdf in batches:
            rows = [(p, *r) for p, v in zip(pdf["path"], pdf["value"]) for r in parse(v)]
            df = pd.DataFrame(rows, columns=names)
            for c in ints:
                df[c] = df[c].astype("int32")
            yield df

    return run


def read_tei(files: DataFrame) -> DataFrame:
    """Blocks of (path, value) TEI files."""
    return files.mapInPandas(_rows(tei_blocks, ["path", "title", "edition", "sec_index", "label", "block_pos", "kind", "n", "text"], ["sec_index", "block_pos"]), BLOCKS)


def read_tei_units(files: DataFrame) -> DataFrame:
    """Comparison units of (path, value) TEI files."""
    numbered = lambda v: [(i, *u) for i, u in enumerate(tei_units(v))]
    return files.mapInPandas(_rows(numbered, ["path", "unit", "label", "text"], ["unit"]), UNITS)


_CTS = "{http://chs.harvard.edu/xmlns/cts}"


def passage_refs(text: str) -> list[tuple[int, str]]:
    """(place, urn) of the valid references of a work; a broken answer has none."""
    try:
        return [(i, u.text) for i, u in enumerate(u for u in ET.fromstring(text).iter(f"{_CTS}urn") if u.text)]
    except (ET.ParseError, TypeError, ValueError):
        return []


def passage_blocks(text: str) -> list[tuple]:
    """(block_pos, kind, n, text) of a passage."""
    try:
        root = ET.fromstring(text)
    except (ET.ParseError, TypeError, ValueError):
        return []
    blocks = [(_KINDS[e.tag], e.get("n") if e.tag == f"{_T}l" else None, _inner(e)) for e in root.iter() if e.tag in _KINDS]
    return [(k, *b) for k, b in enumerate(b for b in blocks if b[2])]


def read_passages(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """(path, sec_index, label, block_pos, kind, n, text) of works served passage by passage.

    ``answers``: (path, value) lists of references; ``passages``: (path, value) with the
    reference as path.  Passages that are missing or empty leave a gap in the index.
    """
    refs = answers.mapInPandas(_rows(passage_refs, ["path", "sec_index", "urn"], ["sec_index"]), "path string, sec_index int, urn string")
    blocks = passages.mapInPandas(_rows(passage_blocks, ["urn", "block_pos", "kind", "n", "text"], ["block_pos"]), "urn string, block_pos int, kind string, n string, text string")
    return refs.join(blocks, "urn").select("path", "sec_index", F.substring_index("urn", ":", -1).alias("label"), "block_pos", "kind", "n", "text")


_NAME = T.ArrayType(T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_xml:lang", T.StringType())]))
_EDITION = T.ArrayType(T.StructType([T.StructField("_urn", T.StringType()), T.StructField("ti:label", _NAME), T.StructField("ti:description", _NAME)]))
_WORK = T.ArrayType(T.StructType([T.StructField("_urn", T.StringType()), T.StructField("ti:title", _NAME), T.StructField("ti:edition", _EDITION), T.StructField("ti:translation", _EDITION)]))
INVENTORY = T.StructType([T.StructField("_urn", T.StringType()), T.StructField("ti:groupname", _NAME), T.StructField("ti:work", _WORK)])


def _named(col, lang: str):
    """The last filled value of a language."""
    hit = F.filter(col, lambda x: (x["_xml:lang"] == lang) & (F.coalesce(F.trim(x["_VALUE"]), F.lit("")) != ""))
    return F.try_element_at(F.transform(hit, lambda x: F.trim(x["_VALUE"])), F.lit(-1))


def read_inventory(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Authors (english, latin, greek) and works (titles, urns, edition) of a CTS inventory."""
    raw = spark.read.format("xml").option("rowTag", "ti:textgroup").schema(INVENTORY).load(path)
    g = raw.select(F.regexp_extract("_urn", r"tlg([0-9]{4})$", 1).alias("author_id"), F.col("`ti:groupname`").alias("names"), F.col("`ti:work`").alias("works")).where("author_id <> ''")
    authors = g.select("author_id", *[_named(F.col("names"), k).alias(n) for k, n in (("eng", "english"), ("lat", "latin"), ("grc", "greek"))])
    w = g.select("author_id", F.explode("works").alias("w")).select("author_id", F.regexp_extract("w._urn", r"tlg[0-9]{4}\.tlg([0-9]{3})$", 1).alias("work_id"), "w").where("work_id <> ''")
    none = F.array().cast(_EDITION)
    eds = F.concat(F.coalesce(F.col("w.`ti:edition`"), none), F.coalesce(F.col("w.`ti:translation`"), none))
    urns = F.filter(F.transform(eds, lambda x: x["_urn"]), lambda u: F.coalesce(u, F.lit("")) != "")
    greek = F.filter(urns, lambda u: F.contains(u, F.lit("-grc")))
    labels = F.flatten(F.transform(eds, lambda x: F.coalesce(x["ti:label"], F.array().cast(_NAME))))
    grc = F.filter(labels, lambda x: (x["_xml:lang"] == "grc") & (F.coalesce(F.trim(x["_VALUE"]), F.lit("")) != ""))
    own = F.coalesce(F.col("w.`ti:edition`"), none)
    preferred = F.coalesce(F.try_element_at(F.filter(own, lambda x: F.contains(x["_urn"], F.lit("-grc"))), F.lit(1)), F.try_element_at(own, F.lit(1)))
    titles = F.col("w.`ti:title`")
    works = w.select(
        "author_id", "work_id", _named(titles, "eng").alias("title_english"), _named(titles, "lat").alias("title_latin"),
        F.coalesce(_named(titles, "grc"), F.trim(F.try_element_at(grc, F.lit(1))["_VALUE"])).alias("title_greek"), F.col("w._urn").alias("cts_urn"), F.lit(True).alias("cts_confirmed"),
        urns.alias("edition_urns"), F.coalesce(F.try_element_at(greek, F.lit(1)), F.try_element_at(urns, F.lit(1))).alias("greek_edition_urn"),
        F.trim(F.try_element_at(preferred["ti:description"], F.lit(1))["_VALUE"]).alias("edition"))
    return authors, works
