"""Element rows of HTML pages, and the author lists read from them."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ELEMENTS = "path string, pos int, parent int, tag string, class string, attrs map<string,string>, text string, lead string"


class _Rows(HTMLParser):
    """Elements in document order: text of the subtree, and own text before the first a, div or br."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[int] = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        for p in self.open[-1:]:
            if tag in ("a", "div", "br"):
                self.rows[p]["cut"] = True
        self.rows.append({"parent": self.open[-1] if self.open else None, "tag": tag, "class": a.get("class"), "attrs": a, "parts": [], "lead": [], "cut": False})
        if tag not in VOID:
            self.open.append(len(self.rows) - 1)

    def handle_endtag(self, tag):
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.rows[self.open[k]]["tag"] == tag), None)
        if at is not None:  # a stray end tag closes nothing
            del self.open[at:]

    def handle_data(self, data):
        for i in self.open:
            self.rows[i]["parts"].append(data)
        if self.open and not self.rows[self.open[-1]]["cut"]:
            self.rows[self.open[-1]]["lead"].append(data)


#: Rows of elements handed on together, about, so that a batch of many pages is never held as a whole.
FRAME_ROWS = 20_000


def _frame(rows: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=["path", "pos", "parent", "tag", "class", "attrs", "text", "lead"])
    df["parent"] = df["parent"].astype("Int32")
    return df


def _parse(batches):
    for pdf in batches:
        out = []
        for path, page in zip(pdf["path"], pdf["value"]):
            p = _Rows()
            p.feed(page or "")
            p.close()
            out += [(path, i, r["parent"], r["tag"], r["class"], r["attrs"], " ".join(r["parts"]).strip(), " ".join(r["lead"]).strip()) for i, r in enumerate(p.rows)]
            if len(out) >= FRAME_ROWS:
                yield _frame(out)
                out = []
        yield _frame(out)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): one row per file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def elements(pages: DataFrame) -> DataFrame:
    """(path, pos, parent, tag, class, attrs, text, lead) of all elements of (path, value) pages."""
    return pages.mapInPandas(_parse, ELEMENTS)


def author_list(pages: DataFrame) -> DataFrame:
    """(author_id, author_name_latin, epitheton) of list items ``NNNN Name epitheton``; the first item of an id wins."""
    li = elements(pages).where("tag = 'li'").select("path", "pos", F.regexp_replace("text", r"(?U)\s+", " ").alias("t"))
    hit = li.where(F.col("t").rlike(r"^[0-9]{4} .+$")).select(F.substring("t", 1, 4).alias("author_id"), F.struct("path", "pos").alias("at"), F.expr("substring(t, 6)").alias("name"))
    one = hit.groupBy("author_id").agg(F.min_by("name", "at").alias("name"))
    return one.select("author_id", X.peel_epitheton(F.col("name")).alias("p")).select("author_id", F.col("p.name").alias("author_name_latin"), "p.epitheton")


def author_table(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Authors and works of a table of updates, newest first.

    A row has exactly two cells of its own: the number, and the name followed by links and a
    ``div.works`` of spans ``NNN Title``.  The first name of an author and the first title of
    a work win; works are united over the updates.
    """
    e = elements(pages)
    td = e.where("tag = 'td'").select("path", F.col("parent").alias("tr"), "pos", "text", "lead")
    rows = td.groupBy("path", "tr").agg(F.sort_array(F.collect_list(F.struct("pos", "text", "lead"))).alias("c")).where("size(c) = 2")
    rows = rows.select("path", "tr", F.trim(F.col("c")[0]["text"]).alias("raw"), F.col("c")[1]["pos"].alias("cell"), F.col("c")[1]["lead"].alias("lead")).where(F.col("raw").rlike("^[0-9]{1,4}$"))
    rows = rows.withColumn("author_id", X.zero_fill(F.col("raw"), 4))
    name = F.trim(F.regexp_replace("lead", r"\([^(]*$", ""))
    first = rows.groupBy("author_id").agg(F.min_by(name, F.struct("path", "tr")).alias("name"))
    authors = first.select("author_id", X.peel_epitheton(F.col("name")).alias("p")).select("author_id", F.col("p.name").alias("author_name_latin"), "p.epitheton")
    div = e.where("tag = 'div' and class = 'works'").select("path", F.col("pos").alias("div"), F.col("parent").alias("cell"))
    span = e.where("tag = 'span'").select("path", F.col("parent").alias("div"), "pos", F.regexp_replace("text", r"(?U)\s+", " ").alias("t")).where(F.col("t").rlike("^[0-9]{3} "))
    w = rows.select("path", "cell", "author_id").join(div, ["path", "cell"]).join(span, ["path", "div"])
    works = w.groupBy("author_id", F.substring("t", 1, 3).alias("work_id")).agg(F.min_by(F.trim(F.expr("substring(t, 5)")), F.struct("path", "pos")).alias("title_latin"))
    return authors, works


#: Least signs of Greek words on a page of a text, and what stands before a reference in its links.
LEAST_SIGNS, REFERENCE = 30, "Perseus%3Atext%3A"


def hopper_candidates(works: DataFrame) -> DataFrame:
    """(author_id, work_id, place, doc): documents to ask for, in order, each once.

    ``works``: (author_id, work_id, greek_edition_urn or null).
    """
    work = X.urn(F.col("author_id"), F.col("work_id"))
    docs = F.array_distinct(F.array_compact(F.array(X.blank_to_null(F.col("greek_edition_urn")), *[F.concat(work, F.lit(f".perseus-grc{k}")) for k in (1, 2, 3)], work)))
    return works.select("author_id", "work_id", F.posexplode(docs).alias("place", "doc"))


def hopper_texts(pages: DataFrame) -> DataFrame:
    """(path, text): the words of a page, which stand in anchors of their own."""
    words = elements(pages).where("tag = 'a' and class = 'text' and trim(text) <> ''")
    per = words.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("w"))
    return per.select("path", F.trim(F.regexp_replace(F.array_join("w", " "), X.SPACE, " ")).alias("text"))


def hopper_sections(pages: DataFrame) -> DataFrame:
    """(path, text_id, index, book, chapter): passages of the text that a page refers to most.

    Pages need words of at least ``LEAST_SIGNS`` signs with a Greek letter; ties of the text
    id go to the one met first.  References are URL-encoded: text, ``book=``, ``chapter=``.
    """
    readable = hopper_texts(pages).where((F.length("text") >= LEAST_SIGNS) & F.col("text").rlike("[ἀ-῿]")).select("path")
    pieces = pages.join(readable, "path", "left_semi").select("path", F.posexplode(F.split("value", REFERENCE)).alias("pos", "piece")).where("pos > 0")
    decoded = F.try_url_decode(F.regexp_extract("piece", "^([0-9A-Za-z.%]*)", 1))
    r = pieces.select("path", "pos", F.split(decoded, ":").alias("p")).where((F.size("p") >= 3) & F.col("p")[0].rlike("^[0-9.]+$") & F.col("p")[1].startswith("book=") & F.col("p")[2].startswith("chapter="))
    number = lambda k, name: F.regexp_extract(F.col("p")[k], f"^{name}=([0-9]+)", 1)
    refs = r.select("path", "pos", F.col("p")[0].alias("text_id"), F.try_to_number(number(1, "book"), F.lit("999999999")).cast("int").alias("book"), F.try_to_number(number(2, "chapter"), F.lit("999999999")).cast("int").alias("chapter")).where("book is not null and chapter is not null")
    per = refs.groupBy("path", "text_id").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    top = per.groupBy("path").agg(F.max_by("text_id", F.struct("n", (-F.col("first")).alias("f"))).alias("text_id"))
    w = Window.partitionBy("path", "text_id").orderBy("book", "chapter")
    return refs.join(top, ["path", "text_id"]).select("path", "text_id", "book", "chapter").distinct().withColumn("index", F.row_number().over(w) - 1)
