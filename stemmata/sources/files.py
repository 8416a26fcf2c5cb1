"""Lists, trees, bindings and plain texts as rows.

Readers take rows (path, value) of whole files, as ``html.files`` gives them, so that cached
pages in a table are read the same way as files in a folder.  Lists are exploded by the
outer form and empty ones dropped after it, so that no page is parsed twice for a filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import xml

# Fixed value: the grammar of the identifier of a Greek work.
_URN = r"urn:cts:greekLit:tlg[0-9]{4}\.tlg[0-9]{3}"
BINDINGS = "results struct<bindings:array<struct<{}>>>".format(", ".join(f"{n}:struct<value:string>" for n in ("tlg", "qidStr", "viaf", "periodLabel", "birth", "death", "grcLabel")))
#: Answers of fewer bytes than this are no texts but messages of a server.
LEAST_BYTES = 200


def _digits(c: Column, n: int) -> Column:
    return (F.length(c) == n) & (F.translate(c, "0123456789", "") == "")


def work_list(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Authors and works of a Markdown table; first rows win, an empty author name is filled later.

    A row has six cells, of which the first three are the number ``NNNN.NNN``, the author and
    the title; none of these is without a character.
    """
    lines = pages.select("path", F.posexplode_outer(F.split("value", "\r?\n")).alias("pos", "v"))
    r = lines.select("path", "pos", "v", F.split(F.rtrim("v"), "[|]").alias("c")).where("size(c) = 8 and c[0] = '' and c[7] = '' and c[2] <> '' and c[3] <> ''")
    r = r.withColumn("id", F.split(F.trim(F.col("c")[1]), "[.]")).where(F.size("id") == 2)
    r = r.where(_digits(F.col("id")[0], 4) & _digits(F.col("id")[1], 3))
    r = r.select(
        F.struct("path", "pos").alias("at"), F.col("id")[0].alias("author_id"), F.col("id")[1].alias("work_id"), F.trim(F.col("c")[2]).alias("author"), F.trim(F.col("c")[3]).alias("title"),
        X.blank_to_null(F.regexp_extract("v", f"({_URN})", 1)).alias("cts_urn"))
    authors = r.groupBy("author_id").agg(F.min_by("author", F.when(F.col("author") != "", F.col("at"))).alias("author_name"))
    works = r.groupBy("author_id", "work_id").agg(F.min_by(F.struct("title", "cts_urn"), "at").alias("w")).select("author_id", "work_id", F.col("w.title").alias("title_latin"), "w.cts_urn")
    return authors, works


def repository_tree(pages: DataFrame) -> DataFrame:
    """(author_id, work_id, file): the Greek file of each work in Git tree listings.

    Files stand at ``data/tlgNNNN/tlgNNN/<name>.xml``.  Greek files without an English mark
    come first, by family and place; else the first file that is not English; works with
    English files only are left out.
    """
    tree = pages.select("path", F.from_json("value", "tree array<struct<path:string>>").alias("j")).select("path", F.posexplode_outer("j.tree").alias("pos", "t"))
    part = lambda k: F.col("p")[k]
    number = lambda k, n: part(k).startswith("tlg") & _digits(F.substring(part(k), 4, 99), n)
    r = tree.withColumn("p", F.split("t.path", "/")).where((F.size("p") == 4) & (part(0) == "data") & part(3).endswith(".xml") & (F.length(part(3)) > 4)).where(number(1, 4) & number(2, 3))
    r = r.select(F.struct("path", "pos").alias("at"), F.substring(part(1), 4, 4).alias("author_id"), F.substring(part(2), 4, 3).alias("work_id"), part(3).alias("file"))
    f = F.col("file")
    pref = F.when(~f.contains("grc"), 9).when(f.contains("1st1K-grc"), 0).when(f.contains("perseus-grc"), 1).otherwise(2)
    return r.where(~f.contains("eng")).groupBy("author_id", "work_id").agg(F.min_by("file", F.struct(pref, "at")).alias("file"))


def bindings(pages: DataFrame) -> DataFrame:
    """Authors of cached results of bindings; of several rows the last that says anything wins, else the first."""
    b = pages.select("path", F.from_json("value", BINDINGS).alias("j")).select("path", F.posexplode_outer("j.results.bindings").alias("pos", "b"))
    v = lambda n: X.blank_to_null(F.col(f"b.{n}.value"))
    r = b.select(
        F.struct("path", "pos").alias("at"), v("tlg").alias("author_id"), X.blank_to_null(F.regexp_extract(F.coalesce(v("qidStr"), F.lit("")), "([^/]*)$", 1)).alias("wikidata_qid"), v("viaf").alias("viaf_id"), v("grcLabel").alias("greek"),
        v("birth").alias("birth"), v("death").alias("death"), v("periodLabel").alias("period")).where("author_id is not null")
    r = r.withColumn("era", F.coalesce(X.format_era(F.col("birth"), F.col("death")), "period"))
    cols = F.struct(*["wikidata_qid", "viaf_id", "greek", "birth", "death", "period", "era"])
    says = F.coalesce("era", "greek", "viaf_id").isNotNull()
    best = F.coalesce(F.max_by(F.when(says, cols), F.when(says, F.col("at"))), F.min_by(cols, "at"))
    return r.groupBy("author_id").agg(best.alias("x")).select("author_id", "x.*")


def plain_blocks(pages: DataFrame) -> DataFrame:
    """(path, block_pos, text): paragraphs of plain texts between blank lines."""
    parts = F.filter(F.transform(F.split("value", r"\n\s*\n"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")
    return pages.select("path", F.posexplode_outer(parts).alias("block_pos", "text")).where("block_pos is not null")


def overlay(pages: DataFrame) -> DataFrame:
    """Works of curation overlays ``{author: {works: {work: {...}}}}``."""
    work = "struct<title_latin:string,title_english:string,title_greek:string,cts_urn:string,cts_confirmed:boolean,edition:string,source:string>"
    raw = pages.select(F.from_json("value", f"map<string,struct<works:map<string,{work}>>>").alias("m"))
    a = raw.select(F.explode_outer("m").alias("author_id", "a"))
    return a.select("author_id", F.explode_outer("a.works").alias("work_id", "w")).where("work_id is not null").select("author_id", "work_id", "w.*")


_TEXT = "title string, sections array<struct<index:int,label:string,blocks:array<struct<kind:string,n:string,text:string>>>>, blocks array<struct<kind:string,n:string,text:string>>"


def cached_texts(pages: DataFrame) -> DataFrame:
    """Blocks of parsed texts kept as JSON, with their titles."""
    d = pages.select("path", F.from_json("value", _TEXT).alias("j")).select("path", "j.title", F.explode_outer("j.sections").alias("s"))
    return d.select("path", "title", F.col("s.index").alias("sec_index"), "s.label", F.posexplode_outer("s.blocks").alias("block_pos", "b")).where("block_pos is not null").select("path", "title", "sec_index", "label", "block_pos", "b.*")


def corpus_texts(pages: DataFrame) -> DataFrame:
    """(path, text) of the files of a corpus by their ending: TEI, parsed JSON or plain text; empty ones are left out."""
    of = lambda e: pages.where(F.col("path").endswith(e))
    tei = xml.read_tei(of(".xml")).groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sec_index", "block_pos", "text"))), lambda x: x["text"]), " ").alias("text"))
    said = lambda blocks: F.array_join(F.transform(blocks, lambda b: F.coalesce(b["text"], F.lit(""))), " ")
    j = of(".json").select("path", F.from_json("value", _TEXT).alias("j"))
    parsed = j.select("path", F.when(F.col("j.sections").isNotNull(), said(F.flatten("j.sections.blocks"))).otherwise(said("j.blocks")).alias("text"))
    plain = of(".txt").select("path", F.col("value").alias("text"))
    return tei.unionByName(parsed).unionByName(plain).where("coalesce(text, '') <> ''")


def served(pages: DataFrame) -> DataFrame:
    """Pages long enough to be texts."""
    return pages.where(F.octet_length("value") >= LEAST_BYTES)


def resolve(providers: list[DataFrame], key: list[str]) -> DataFrame:
    """Rows of the first provider that has a key; providers in order of precedence."""
    tiers = [d.withColumn("tier", F.lit(i)) for i, d in enumerate(providers)]
    both = tiers[0]
    for t in tiers[1:]:
        both = both.unionByName(t, allowMissingColumns=True)
    best = both.groupBy(*key).agg(F.min("tier").alias("tier"))  # combined before the shuffle, however many rows a key has
    return both.join(best, [*key, "tier"], "left_semi")


def work_texts(local: DataFrame, repository: DataFrame, passages: DataFrame, pages: DataFrame) -> DataFrame:
    """(author_id, work_id, label, text, tier) of comparison units by the first tier that has the work.

    ``local``: (author_id, work_id, label, text) of texts kept here; ``repository``:
    (author_id, work_id, path, value) of TEI files, of which short answers do not count;
    ``passages`` and ``pages``: (author_id, work_id, label, text) read by ``xml.read_passages``
    and ``html.hopper_texts``.
    """
    files = served(repository)
    units = xml.read_tei_units(files.select("path", "value")).join(files.select("path", "author_id", "work_id"), "path")
    cols = ("author_id", "work_id", "label", "text")
    return resolve([d.select(*cols) for d in (local, units, passages, pages)], ["author_id", "work_id"])


def api_links(archive: DataFrame, wiki: DataFrame) -> DataFrame:
    """Links found by cached answers (path, value) of two search services: at most five scans and four pages of an answer."""
    docs = archive.select("path", F.from_json("value", "response struct<docs:array<struct<identifier:string,title:string,date:string>>>").alias("j"))
    a = docs.select("path", F.posexplode_outer("j.response.docs").alias("p", "d")).where("p < 5 and d.identifier is not null").select(
        "path", F.lit("archive").alias("id"), F.substring(F.coalesce("d.title", F.lit("Scan")), 1, 120).alias("label"), F.lit(5).alias("link_rank"), F.lit("scan").alias("link_type"), F.concat(F.lit("https://scans.example/"), "d.identifier").alias("url"), F.coalesce("d.date", F.lit("")).alias("detail"))
    hits = wiki.select("path", F.from_json("value", "query struct<search:array<struct<title:string>>>").alias("j"))
    w = hits.select("path", F.posexplode_outer("j.query.search").alias("p", "h")).where("p < 4").select(
        "path", F.lit("wiki").alias("id"), F.col("h.title").alias("label"), F.lit(4).alias("link_rank"), F.lit("text").alias("link_type"), F.concat(F.lit("https://texts.example/"), X.quote_url(F.replace("h.title", F.lit(" "), F.lit("_")))).alias("url"), F.lit("").alias("detail"))
    return a.unionByName(w)
