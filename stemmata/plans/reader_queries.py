"""Queries that write the tables as pages of each format and read them back.

Every record of a table goes through its reader; the SQL states what must come back.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import subwords as S
from ..operators.shared import shared_folder
from ..sources import files, html, xml
from .compare_queries import _FLAT, _norm, table
from .index_queries import _dig

_SPACED = r"[\s\p{Z}\x{85}\x{0b}\x{1c}-\x{1f}]+"
_KEY = lambda c: F.lpad(F.col(c).cast("string"), 12, "0")  # noqa: E731  sorts as the number
_PAGE = lambda df, path, value: df.select(path.alias("path"), value.alias("value"))


def _canon(spark, folder):
    return table(spark, folder, "canon").withColumn("aid", X.digits(F.col("author_id"), 4)).where("aid is not null and author_name_latin is not null")


def html_author_list(spark, folder):
    """Author names of canon as list items, one page per record; the first item of an author wins."""
    c = _canon(spark, folder)
    li = F.concat(F.lit("<ul><li>"), F.col("aid"), F.lit(" <b>"), X.escape_html(F.col("author_name_latin")), F.lit("</b></li></ul>"))
    got = html.author_list(_PAGE(c, _KEY("record_id"), li))
    return got.select("author_id", F.concat_ws(" ", X.blank_to_null(F.col("author_name_latin")), "epitheton").alias("display"))


def html_author_table(spark, folder):
    """Works as rows of a table of updates, one page per record; the first title of a work wins."""
    w = _works(spark, folder)
    row = F.concat(F.lit("<table><tr><td>"), F.col("aid"), F.lit("</td><td>Name ( <a>works</a> ) <div class='works'><span>"), F.col("wid"), F.lit(" <i>"), X.escape_html(F.col("title_latin")), F.lit("</i></span></div></td></tr></table>"))
    return html.author_table(_PAGE(w, _KEY("record_id"), row))[1]


def _works(spark, folder):
    w = table(spark, folder, "works").withColumn("aid", X.digits(F.col("author_id"), 4)).withColumn("wid", X.digits(F.col("work_id"), 3))
    # the formats have room for four and three digits; white space is made plain before it is written
    w = w.withColumn("title_latin", F.trim(F.regexp_replace("title_latin", X.SPACE, " ")))
    return w.where("length(aid) = 4 and length(wid) = 3 and title_latin rlike '[A-Za-z]'")


def md_work_list(spark, folder):
    """Works as a Markdown table, one page per record."""
    w = _works(spark, folder)
    title = F.replace(F.col("title_latin"), F.lit("|"), F.lit("/"))
    line = F.concat(F.lit("| no | row |\n| "), F.col("aid"), F.lit("."), F.col("wid"), F.lit(" | Author | "), title, F.lit(" | "), F.coalesce("cts_urn", F.lit("")), F.lit(" | x | z |\n"))
    return files.work_list(_PAGE(w, _KEY("record_id"), line))[1]


def repo_tree_files(spark, folder):
    """The preferred Greek file of every work, from tree listings, one per author."""
    w = _works(spark, folder)
    name = F.when(F.col("source") == "cts:inventory", "perseus-grc2").when(F.col("source") == "list:works", "1st1K-grc1").when(F.col("source") == "list:late", "other-1").otherwise("perseus-eng3")
    path = F.concat(F.lit("data/tlg"), "aid", F.lit("/tlg"), "wid", F.lit("/"), name, F.lit("."), F.col("record_id").cast("string"), F.lit(".xml"))
    tree = w.groupBy("aid").agg(F.sort_array(F.collect_list(F.struct("record_id", path.alias("path")))).alias("t"))
    value = F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["path"].alias("path"))).alias("tree")))
    return files.repository_tree(_PAGE(tree, F.col("aid"), value))


def graph_bindings(spark, folder):
    """Records of canon as bindings of a graph, one answer per author."""
    c = table(spark, folder, "canon").withColumn("aid", X.digits(F.col("author_id"), 4)).where("aid is not null")
    v = lambda x: F.when(x.isNotNull(), F.struct(x.alias("value")))
    born = F.when(F.col("record_id") % 3 == 0, F.concat(F.lit("-0"), F.lpad((F.col("record_id") % 900).cast("string"), 3, "0"), F.lit("-05-06T00:00:00Z")))
    b = F.struct(v(F.col("aid")).alias("tlg"), v(F.concat(F.lit("http://graph.example/Q"), F.col("record_id").cast("string"))).alias("qidStr"), v(F.col("viaf_id")).alias("viaf"), v(F.col("author_name_greek")).alias("grcLabel"), v(F.col("era")).alias("periodLabel"), v(born).alias("birth"))
    per = c.groupBy("aid").agg(F.sort_array(F.collect_list(F.struct("record_id", F.to_json(b).alias("b")))).alias("l"))
    value = F.concat(F.lit('{"results":{"bindings":['), F.array_join(F.transform("l", lambda x: x["b"]), ","), F.lit("]}}"))
    return files.bindings(_PAGE(per, F.col("aid"), value)).select("author_id", "wikidata_qid", "viaf_id", "greek", "era")


def _rooted(batches):
    """Each part of the rows as one XML file."""
    yield pd.DataFrame({"value": ['<ti:TextInventory xmlns:ti="http://chs.harvard.edu/xmlns/cts">']})
    yield from batches
    yield pd.DataFrame({"value": ["</ti:TextInventory>"]})


def cts_inventory_works(spark, folder):
    """Works as a CTS inventory in files of a folder, read by its group elements."""
    w = _works(spark, folder).where("source = 'cts:inventory'")
    tag = lambda name, lang, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f'<ti:{name} xml:lang="{lang}">'), X.escape_html(F.col(c)), F.lit(f"</ti:{name}>")))
    urn = X.urn(F.col("aid"), F.col("wid"))
    group = F.concat(
        F.lit('<ti:textgroup urn="urn:cts:greekLit:tlg'), F.col("aid"), F.lit('"><ti:work urn="'), urn, F.lit('">'), F.concat_ws("", tag("title", "lat", "title_latin"), tag("title", "eng", "title_english")),
        F.lit('<ti:edition urn="'), urn, F.lit('.perseus-eng1"/><ti:edition urn="'), urn, F.lit('.perseus-grc'), F.col("record_id").cast("string"), F.lit('"/></ti:work></ti:textgroup>'))
    at = f"{shared_folder(spark)}/inventory-{uuid.uuid4().hex}"
    w.select(group.alias("value")).mapInPandas(_rooted, "value string").write.text(at)
    return xml.read_inventory(spark, at)[1].select("author_id", "work_id", "title_latin", "title_english", "greek_edition_urn", F.size("edition_urns").alias("editions"))


def _section_xml(spark, folder):
    s = table(spark, folder, "sections")
    el = F.when(F.col("kind") == "head", "head").when(F.col("kind") == "line", "l").otherwise("p")
    n = F.when((F.col("kind") == "line") & F.col("n").isNotNull(), F.concat(F.lit(' n="'), X.escape_html(F.col("n")), F.lit('"'))).otherwise("")
    part = F.concat(F.lit('<div type="textpart" n="'), X.escape_html(F.coalesce("label", F.lit("?"))), F.lit('"><'), el, n, F.lit(">"), X.escape_html(F.coalesce("text", F.lit(""))), F.lit("</"), el, F.lit("></div>"))
    return s, part


def tei_sections(spark, folder):
    """Sections as TEI files of one part each, read as blocks."""
    s, part = _section_xml(spark, folder)
    page = F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div type="edition">'), part, F.lit("</div></body></text></TEI>"))
    got = xml.read_tei(_PAGE(s, F.col("section_id").cast("string"), page))
    return got.select(F.col("path").cast("long").alias("section_id"), "sec_index", "label", "block_pos", "kind", "n", "text")


def tei_leaf_units(spark, folder):
    """Sections as parts below a part, read as units with dotted labels."""
    s, part = _section_xml(spark, folder)
    page = F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div type="edition"><div type="textpart" n="7">'), part, F.lit('<div type="textpart"/></div></div></body></text></TEI>'))
    got = xml.read_tei_units(_PAGE(s, F.col("section_id").cast("string"), page))
    return got.select(F.col("path").cast("long").alias("section_id"), "unit", "label", "text")


def passage_sections(spark, folder):
    """Sections as passages under a list of two references each, the second of them missing."""
    s = table(spark, folder, "sections")
    urn = F.concat(F.lit("urn:cts:greekLit:"), F.col("section_id").cast("string"))
    refs = F.concat(F.lit('<r xmlns="http://chs.harvard.edu/xmlns/cts"><urn>'), urn, F.lit(":9.8</urn><urn>"), urn, F.lit(":9.9</urn></r>"))
    body = F.concat(F.lit('<p xmlns="http://www.tei-c.org/ns/1.0">'), X.escape_html(F.coalesce("text", F.lit(""))), F.lit("</p>"))
    got = xml.read_passages(_PAGE(s, F.col("section_id").cast("string"), refs), _PAGE(s, F.concat(urn, F.lit(":9.9")), body))
    return got.select(F.col("path").cast("long").alias("section_id"), "sec_index", "label", "kind", "text")


def cached_text_blocks(spark, folder):
    """Sections as parsed texts kept in JSON."""
    s = table(spark, folder, "sections")
    block = F.struct("kind", "n", "text")
    doc = F.to_json(F.struct(F.col("work_id").alias("title"), F.array(F.struct(F.col("sec_index").alias("index"), "label", F.array(block).alias("blocks"))).alias("sections")))
    got = files.cached_texts(_PAGE(s, F.col("section_id").cast("string"), doc))
    return got.select(F.col("path").cast("long").alias("section_id"), "title", "sec_index", "label", "block_pos", "kind", "n", "text")


def overlay_works(spark, folder):
    """Titles of works as curation overlays, one file per record."""
    w = _works(spark, folder)
    one = F.struct("title_latin", "title_english", F.col("source").alias("source"))
    doc = F.to_json(F.create_map(F.coalesce("aid", F.lit("")), F.struct(F.create_map(F.coalesce("wid", F.lit("")), one).alias("works"))))
    return files.overlay(_PAGE(w, _KEY("record_id"), doc)).select("author_id", "work_id", "title_latin", "title_english", "source")


def hopper_passages(spark, folder):
    """Sections as pages with an anchor per word and references to passages of two texts."""
    s = table(spark, folder, "sections").where("text is not null")
    words = F.regexp_extract_all("text", F.lit(r"([\p{L}\p{M}]+)"), F.lit(1))
    anchors = F.array_join(F.transform(words, lambda w: F.concat(F.lit('<a href="#" class="text">'), w, F.lit("</a>"))), " ")
    ref = lambda t, b, c: F.concat(F.lit("<a href='?doc=" + html.REFERENCE), F.lit(t), F.lit("%3Abook%3D"), b.cast("string"), F.lit("%3Achapter%3D"), c.cast("string"), F.lit("'>x</a>"))
    b, c = F.col("section_id") % 7, F.col("section_id") % 11
    page = F.concat(F.lit("<p>"), anchors, ref("2.0", b, c), ref("1.5", b, c + 1), ref("1.5", b, c), ref("1.5", b, c), F.lit("</p>"))
    got = html.hopper_sections(_PAGE(s, F.col("section_id").cast("string"), page))
    return got.select(F.col("path").cast("long").alias("section_id"), "text_id", "book", "chapter", "index")


def hopper_docs(spark, folder):
    """Documents to ask for, for every work with and without a known edition."""
    w = _works(spark, folder)
    one = w.groupBy("aid", "wid").agg(F.max(F.when(F.col("source") == "cts:inventory", F.concat(X.urn(F.col("aid"), F.col("wid")), F.lit(".perseus-grc2")))).alias("greek_edition_urn"))
    return html.hopper_candidates(one.select(F.col("aid").alias("author_id"), F.col("wid").alias("work_id"), "greek_edition_urn"))


def found_links(spark, folder):
    """Titles of works as answers of two search services, one answer per author: at most five and four of each count."""
    per = _works(spark, folder).groupBy("aid").agg(F.sort_array(F.collect_list(F.struct("record_id", "title_latin"))).alias("l"))
    a = F.to_json(F.struct(F.struct(F.transform("l", lambda x: F.struct(x["record_id"].cast("string").alias("identifier"), x["title_latin"].alias("title"))).alias("docs")).alias("response")))
    w = F.to_json(F.struct(F.struct(F.transform("l", lambda x: F.struct(x["title_latin"].alias("title"))).alias("search")).alias("query")))
    return files.api_links(_PAGE(per, F.col("aid"), a), _PAGE(per, F.col("aid"), w)).select(F.col("path").alias("author_id"), "id", "label", "link_rank", "url")


def corpus_words(spark, folder):
    """Words of a corpus of files: documents as plain text, sections as TEI and JSON."""
    d = table(spark, folder, "documents")
    s, part = _section_xml(spark, folder)
    page = F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body>'), part, F.lit("</body></text></TEI>"))
    name = F.concat(F.lit("s"), F.col("section_id").cast("string"))
    pages = _PAGE(d, F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")), F.col("text"))
    pages = pages.unionByName(_PAGE(s.where("section_id % 2 = 0"), F.concat(name, F.lit(".xml")), page)).unionByName(_PAGE(s.where("section_id % 2 = 1"), F.concat(name, F.lit(".json")), F.to_json(F.struct(F.array(F.struct("text")).alias("blocks")))))
    return S.word_frequencies(files.corpus_texts(pages), "text")


def text_resolution(spark, folder):
    """Sections of every work from the first tier that has it: one provider, then long others, then all."""
    s = table(spark, folder, "sections").select("section_id", "author_id", "work_id", "provider", F.col("text").alias("value"))
    tiers = [s.where(F.col("provider").startswith("a")), files.served(s), s]
    return files.resolve([t.drop("value") for t in tiers], ["author_id", "work_id"]).select("section_id", "tier")


_CANON = f"select *, {_dig('author_id', 4)} aid from canon"
_WORKS = f"""select * from (select * replace (trim(regexp_replace(title_latin, '{_SPACED}', ' ', 'g')) as title_latin), {_dig('author_id', 4)} aid, {_dig('work_id', 3)} wid from works) where length(aid) = 4 and length(wid) = 3 and regexp_matches(title_latin, '[A-Za-z]')"""
_INNER = f"trim(regexp_replace(text, '{_SPACED}', ' ', 'g'))"
_KIND = "case when kind in ('head', 'line') then kind else 'para' end"

SQL = {
    "html_author_list": f"""with c as (select aid, trim(regexp_replace(author_name_latin, '{_SPACED}', ' ', 'g')) t, record_id from ({_CANON}) where length(aid) = 4 and author_name_latin is not null)
  select aid author_id, arg_min(t, record_id) display from c where t <> '' group by aid""",
    "html_author_table": f"select aid author_id, wid work_id, arg_min(title_latin, record_id) title_latin from ({_WORKS}) group by aid, wid",
    "md_work_list": rf"select aid author_id, wid work_id, arg_min(replace(title_latin, '|', '/'), record_id) title_latin, nullif(arg_min(coalesce(regexp_extract(cts_urn, 'urn:cts:greekLit:tlg[0-9]{{4}}\.tlg[0-9]{{3}}'), ''), record_id), '') cts_urn from ({_WORKS}) group by aid, wid",
    "repo_tree_files": f"""with f as (select aid, wid, record_id, case source when 'cts:inventory' then 1 when 'list:works' then 0 when 'list:late' then 9 end pref, case source when 'cts:inventory' then 'perseus-grc2' when 'list:works' then '1st1K-grc1' else 'other-1' end || '.' || record_id || '.xml' file from ({_WORKS}) where source in ('cts:inventory', 'list:works', 'list:late'))
  select aid author_id, wid work_id, file from (select *, row_number() over (partition by aid, wid order by pref, record_id) rn from f) where rn = 1""",
    "graph_bindings": f"""with c as (select aid, record_id, nullif(viaf_id, '') viaf_id, nullif(author_name_greek, '') greek, nullif(era, '') period, case when record_id % 3 = 0 then -(record_id % 900) end b from ({_CANON}) where aid is not null),
  e as (select *, case when b < 0 then ((99 - b) // 100) || case ((99 - b) // 100) when 1 then 'st' when 2 then 'nd' when 3 then 'rd' else 'th' end || ' c. B.C.' when b = 0 then '0th c. A.D.' else period end era from c),
  r as (select *, row_number() over (partition by aid order by coalesce(era, greek, viaf_id) is not null desc, case when coalesce(era, greek, viaf_id) is not null then -record_id else record_id end) rn from e)
  select aid author_id, 'Q' || record_id wikidata_qid, viaf_id, greek, era from r where rn = 1""",
    "cts_inventory_works": f"select aid author_id, wid work_id, title_latin, nullif(trim(title_english), '') title_english, 'urn:cts:greekLit:tlg' || aid || '.tlg' || wid || '.perseus-grc' || record_id greek_edition_urn, 2 editions from ({_WORKS}) where source = 'cts:inventory'",
    "tei_sections": f"select section_id, 0 sec_index, coalesce(label, '?') as label, 0 block_pos, {_KIND} kind, case when kind = 'line' then n end n, {_INNER} as text from sections where {_INNER} <> ''",
    "tei_leaf_units": f"select section_id, 0 unit, '7.' || coalesce(label, '?') as label, {_INNER} as text from sections where {_INNER} <> ''",
    "passage_sections": f"select section_id, 1 sec_index, '9.9' as label, 'para' kind, {_INNER} as text from sections where {_INNER} <> ''",
    "cached_text_blocks": "select section_id, work_id title, sec_index, label, 0 block_pos, kind, n, text from sections",
    "overlay_works": f"select aid author_id, wid work_id, title_latin, title_english, source from ({_WORKS})",
    "hopper_passages": r"""with s as (select section_id, array_to_string(regexp_extract_all(text, '[\p{L}\p{M}]+'), ' ') body from sections where text is not null)
  select section_id, '1.5' text_id, section_id % 7 book, section_id % 11 + k chapter, k as index from s, (select unnest([0, 1]) k) where length(body) >= 30 and regexp_matches(body, '[ἀ-῿]')""",
    "hopper_docs": f"""with w as (select aid, wid, bool_or(source = 'cts:inventory') c, 'urn:cts:greekLit:tlg' || aid || '.tlg' || wid u from ({_WORKS}) group by aid, wid),
  d as (select aid, wid, case when c then [u || '.perseus-grc2', u || '.perseus-grc1', u || '.perseus-grc3', u] else [u || '.perseus-grc1', u || '.perseus-grc2', u || '.perseus-grc3', u] end l from w)
  select aid author_id, wid work_id, generate_subscripts(l, 1) - 1 place, unnest(l) doc from d""",
    "found_links": f"""with w as (select *, row_number() over (partition by aid order by record_id) rn from ({_WORKS}))
  select aid author_id, 'archive' id, left(title_latin, 120) as label, 5 link_rank, 'https://scans.example/' || record_id url from w where rn <= 5
  union all select aid, 'wiki', title_latin, 4, 'https://texts.example/' || replace(url_encode(replace(title_latin, ' ', '_')), '+', '%20') from w where rn <= 4""",
    "corpus_words": f"""with t as (select text from documents union all select case when section_id % 2 = 0 then {_INNER} else text end from sections),
  w as (select unnest(regexp_extract_all(strip_accents({_FLAT.replace('{0}', 'text', 1)}), '[\\p{{L}}\\p{{N}}_]+')) w from t) select {_norm('w')} word, count(*) n from w group by 1""",
    "text_resolution": """with t as (select section_id, author_id, work_id, case when starts_with(provider, 'a') then 0 when strlen(text) >= 200 then 1 else 2 end tier from sections)
  select section_id, m tier from (select *, min(tier) over (partition by author_id, work_id) m from t) where tier <= m or (m > 0 and tier <= m)""",
}
QUERIES = {f.__name__: f for f in (
    html_author_list, html_author_table, md_work_list, repo_tree_files, graph_bindings, cts_inventory_works, tei_sections, tei_leaf_units, passage_sections, cached_text_blocks, overlay_works,
    hopper_passages, hopper_docs, found_links, corpus_words, text_resolution)}
