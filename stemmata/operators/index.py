"""The index of authors and works: merge of sources, overlay, flattening, checks, search.

Sources are merged in one aggregation per level instead of a chain of full outer joins: each
source contributes its first record per key (a struct minimum, combined before the shuffle),
and the columns of the merged row are coalesced in the order of priority.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .shared import ranked

CLASSIC, LATE, LISTED, CTS, GRAPH = "list:classic", "list:late", "list:works", "cts:inventory", "wiki:graph"
CREATING = (CLASSIC, LATE, LISTED, CTS)  # sources whose ids make authors; the graph only adds to them
CURATED = "local:curated"


def _first_of(tag: str, *fields: str) -> Column:
    return F.min(F.when(F.col("tag") == tag, F.struct("record_id", *fields))).alias(tag)


def merge_authors(canon: DataFrame) -> DataFrame:
    """One row per author of the creating sources, with merged fields and provenance."""
    fields = ("author_name_latin", "author_name_english", "author_name_greek", "epitheton", "era", "viaf_id")
    rec = canon.select(X.digits(F.col("author_id"), 4).alias("author_id"), "record_id", *fields, F.explode("source").alias("tag")).where("author_id is not null")
    tags = (*CREATING, GRAPH)
    got = rec.groupBy("author_id").agg(*[_first_of(t, *fields) for t in tags])
    got = got.where(F.coalesce(*[F.col(f"`{t}`.record_id") for t in CREATING]).isNotNull())
    f = lambda t, c: F.col(f"`{t}`.{c}")
    return got.select(
        "author_id",
        X.first_filled(*[f(t, "author_name_latin") for t in CREATING]).alias("author_name_latin"),
        X.first_filled(f(CTS, "author_name_english"), f(LISTED, "author_name_english")).alias("author_name_english"),
        X.first_filled(f(CLASSIC, "epitheton"), f(LATE, "epitheton")).alias("epitheton"),
        f(GRAPH, "author_name_greek").alias("author_name_greek"), f(GRAPH, "era").alias("era"), f(GRAPH, "viaf_id").alias("viaf_id"),
        F.array_compact(F.array(*[F.when(f(t, "record_id").isNotNull(), F.lit(t)) for t in tags])).alias("source"),
    )


def merge_works(works: DataFrame) -> DataFrame:
    """One row per (author_id, work_id): list titles first, the inventory overriding the rest."""
    fields = ("title_latin", "title_english", "title_greek", "edition", "cts_urn")
    rec = works.select(X.digits(F.col("author_id"), 4).alias("author_id"), X.digits(F.col("work_id"), 3).alias("work_id"), "record_id", *fields, F.col("source").alias("tag"))
    rec = rec.where("author_id is not null and work_id is not null").where(F.col("tag").isin(LATE, LISTED, CTS))
    got = rec.groupBy("author_id", "work_id").agg(*[_first_of(t, *fields) for t in (LATE, LISTED, CTS)])
    f = lambda t, c: F.col(f"`{t}`.{c}")
    return got.select(
        "author_id", "work_id",
        X.first_filled(f(LATE, "title_latin"), f(LISTED, "title_latin"), f(CTS, "title_latin")).alias("title_latin"),
        X.blank_to_null(f(CTS, "title_english")).alias("title_english"), X.blank_to_null(f(CTS, "title_greek")).alias("title_greek"),
        X.blank_to_null(f(CTS, "edition")).alias("edition"),
        F.coalesce(X.first_filled(f(CTS, "cts_urn"), f(LISTED, "cts_urn")), X.urn(F.col("author_id"), F.col("work_id"))).alias("cts_urn"),
        f(CTS, "record_id").isNotNull().alias("cts_confirmed"),
    )


def upsert_works(base: DataFrame, patch: DataFrame) -> DataFrame:
    """Overlay: filled columns of the patch win, unknown works are added; applying it twice changes nothing.

    Adds ``action``: kept, patched or added, and the tier of new works.
    """
    cols = ("title_latin", "title_english", "title_greek", "edition", "cts_urn")
    b = base.select("author_id", "work_id", *[F.col(c).alias(f"b_{c}") for c in cols], F.col("cts_confirmed").alias("b_confirmed"), F.lit(True).alias("in_base"))
    p = patch.select("author_id", "work_id", *[F.col(c).alias(f"p_{c}") for c in cols], F.col("source").alias("p_source"), F.lit(True).alias("in_patch"))
    both = b.join(p, ["author_id", "work_id"], "full")
    merged = [X.first_filled(F.col(f"p_{c}"), F.col(f"b_{c}")).alias(c) for c in cols[:-1]]
    urn = F.coalesce(X.first_filled(F.col("p_cts_urn"), F.col("b_cts_urn")), X.urn(F.col("author_id"), F.col("work_id"))).alias("cts_urn")
    action = F.when(F.col("in_base").isNull(), "added").when(F.col("in_patch"), "patched").otherwise("kept")
    return both.select(
        "author_id", "work_id", *merged, urn, F.coalesce("b_confirmed", F.lit(False)).alias("cts_confirmed"),
        F.when(F.col("in_patch"), F.coalesce("p_source", F.lit(CURATED))).alias("source"), action.alias("action"),
    )


def upsert_cache(existing: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Fresh rows win, all others stay."""
    return existing.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def readable(works: DataFrame, repo: DataFrame, local: DataFrame) -> DataFrame:
    """Works with flags: readable (confirmed, in the repository, or local) and exportable (not by local text)."""
    k = ["author_id", "work_id"]
    both = works.join(repo.select(*k, F.lit(True).alias("in_repo")), k, "left").join(local.select(*k, F.lit(True).alias("has_local")), k, "left")
    exp = F.col("cts_confirmed") | F.coalesce("in_repo", F.lit(False))
    return both.withColumn("exportable", exp).withColumn("has_local_text", F.coalesce("has_local", F.lit(False))).withColumn("readable", exp | F.col("has_local_text")).drop("in_repo", "has_local")


def flat(authors: DataFrame, works: DataFrame, how: str = "left") -> DataFrame:
    """Author columns beside work columns; ``left`` keeps authors without works."""
    return authors.withColumn("source", F.array_join("source", ";")).join(works, "author_id", how)


def nested(authors: DataFrame, works: DataFrame) -> DataFrame:
    """Authors with a map of their works in order of work_id."""
    one = F.struct(*[F.col(c) for c in works.columns if c != "author_id"])
    per = works.groupBy("author_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("work_id", one.alias("work"))))).alias("works"))
    return authors.join(per, "author_id", "left")


def violations(authors: DataFrame, works: DataFrame) -> DataFrame:
    """(severity, key, message) of every broken rule of identifiers."""
    rule = lambda df, ok, sev, key, msg: df.where(~F.coalesce(ok, F.lit(False))).select(F.lit(sev).alias("severity"), key.alias("key"), F.lit(msg).alias("message"))
    a, w = F.col("author_id"), F.concat_ws(".", "author_id", "work_id")
    twice = works.groupBy("author_id", "work_id").count().where("count > 1")
    parts = [
        rule(authors, a.rlike("^[0-9]{4}$"), "error", a, "author id"),
        rule(authors, F.size("source") > 0, "error", a, "no source"),
        rule(works, F.col("work_id").rlike("^[0-9]{3}$"), "error", w, "work id"),
        rule(works, F.col("cts_urn").rlike(r"^urn:cts:greekLit:tlg[0-9]{4}\.tlg[0-9]{3}$"), "warning", w, "urn form"),
        rule(works, F.col("cts_urn") == X.urn(F.col("author_id"), F.col("work_id")), "warning", w, "urn of another work"),
        twice.select(F.lit("error").alias("severity"), w.alias("key"), F.lit("twice").alias("message")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def report(authors: DataFrame, works: DataFrame) -> DataFrame:
    """(measure, n, whole, share) of the coverage of the index."""
    n_a, n_w = F.col("authors"), F.col("works")
    filled = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) != "")
    a = authors.agg(F.count("*").alias("authors"), filled("author_name_greek").alias("greek"), filled("era").alias("era"), filled("viaf_id").alias("viaf"), filled("epitheton").alias("epitheton"))
    w = works.agg(F.count("*").alias("works"), F.count_if("cts_confirmed").alias("confirmed"), filled("title_greek").alias("greek_titles"), F.countDistinct("author_id").alias("with_works"))
    row = a.select("*", *[w.select(c).scalar().alias(c) for c in w.columns])  # one row beside one row
    m = lambda name, n, whole: F.struct(F.lit(name).alias("measure"), n.cast("long").alias("n"), whole.cast("long").alias("whole"), X.percent(n, whole).alias("share"))
    rows = F.array(
        m("authors", n_a, n_a), m("works", n_w, n_w), m("authors with works", F.col("with_works"), n_a), m("confirmed works", F.col("confirmed"), n_w), m("greek names", F.col("greek"), n_a),
        m("eras", F.col("era"), n_a), m("viaf ids", F.col("viaf"), n_a), m("epitheta", F.col("epitheton"), n_a), m("greek titles", F.col("greek_titles"), n_w))
    per = authors.select(F.explode("source").alias("s")).groupBy("s").agg(F.count("*").alias("n")).select(F.concat(F.lit("source "), F.col("s")).alias("measure"), "n", F.lit(None).cast("long").alias("whole"), F.lit(None).cast("string").alias("share"))
    return row.select(F.explode(rows).alias("r")).select("r.*").unionByName(per)


def blob(df: DataFrame) -> Column:
    return F.lower(F.concat_ws(" ", "author_name_latin", "author_name_english", "author_name_greek", "epitheton", "author_id"))


def search(authors: DataFrame, q: str, limit: int = 50) -> DataFrame:
    """Authors that match a query, best first: by number, or by text found in names, epitheton and id."""
    q = q.strip().lower()
    if q == "":
        return authors.orderBy("author_id").limit(limit).withColumn("rank", F.lit(0))
    if q.isdigit() and len(q) <= 4:
        qid = q.zfill(4)
        return authors.where(F.col("author_id").startswith(qid)).withColumn("rank", F.when(F.col("author_id") == qid, 0).otherwise(1)).orderBy("rank", "author_id").limit(limit)
    flag = lambda c: F.when(F.coalesce(F.lower(F.col(c)).startswith(q), F.lit(False)), 0).otherwise(1)
    rank = flag("author_id") * 4 + flag("author_name_latin") * 2 + flag("author_name_english")
    return authors.where(blob(authors).contains(q)).withColumn("rank", rank).orderBy("rank", "author_id").limit(limit)


def client_search(authors: DataFrame, q: str) -> DataFrame:
    """All authors a query finds, with their place: the order of the search box.

    A number of up to four digits finds the authors whose id starts with it, zero-filled.
    Other queries are read as typed, as Greek keys, and both without accents, and are looked
    for in names, epitheton, id and the Greek name without accents.  Ids that start with the
    query come first, then names that do, then the rest, each in order of id.
    """
    q = q.strip().lower()
    if re.fullmatch("[0-9]{1,4}", q):
        hit = F.col("author_id").startswith(q.zfill(4))
    else:
        greek = X.typed_in_greek(q)
        fields = ("author_name_latin", "author_name_greek", "author_name_english", "epitheton", "author_id")
        text = F.lower(F.concat_ws("  ", *[X.blank_to_null(F.col(c)) for c in fields], X.blank_to_null(X.strip_greek("author_name_greek"))))
        hit = F.lit(q == "")
        for v in dict.fromkeys((q, greek, X.bare_greek(q), X.bare_greek(greek))):
            hit = hit | (text.contains(v) if v else F.lit(False))
    starts = F.coalesce(F.lower("author_name_latin").startswith(q), F.lit(False)) | F.coalesce(F.lower("author_name_english").startswith(q), F.lit(False))
    rank = F.when(F.lit(q == ""), 0).otherwise(F.when(F.col("author_id").startswith(q), 0).otherwise(2) + F.when(starts, 0).otherwise(1))
    return ranked(authors.where(hit).withColumn("rank", rank), "rank", "author_id", name="place")


def client_totals(readable: DataFrame, authors: DataFrame) -> DataFrame:
    """One row (authors, works, readable): the totals above the list; works of no listed author do not count."""
    per = readable.groupBy("author_id").agg(F.count("*").alias("w"), F.count_if("readable").alias("r"))
    zero = F.lit(0).cast("long")
    both = authors.select("author_id").join(per, "author_id", "left")
    return both.agg(F.count("*").alias("authors"), F.coalesce(F.sum("w"), zero).alias("works"), F.coalesce(F.sum("r"), zero).alias("readable"))


def work_titles(works: DataFrame) -> DataFrame:
    """(author_id, work_id, title): the Latin, else English, else Greek title, else the number."""
    return works.select("author_id", "work_id", F.coalesce(X.first_filled(F.col("title_latin"), F.col("title_english"), F.col("title_greek")), F.concat_ws(".", "author_id", "work_id")).alias("title"))


def work_meta(authors: DataFrame, works: DataFrame) -> DataFrame:
    """(author_id, work_id, author_latin, author_greek, titles, edition, cts_urn): a work as exports name it."""
    a = authors.select("author_id", F.col("author_name_latin").alias("author_latin"), F.col("author_name_greek").alias("author_greek"))
    return works.join(a, "author_id", "left").select("author_id", "work_id", "author_latin", "author_greek", "title_latin", "title_greek", "title_english", "edition", "cts_urn")


def export_works(authors: DataFrame, readable: DataFrame) -> DataFrame:
    """The eleven columns of the table of works for another reader, ``seq`` numbering the works of an author."""
    a = authors.select("author_id", F.col("author_name_latin").alias("latin_name"), F.col("author_name_greek").alias("greek_name"))
    seq = F.row_number().over(Window.partitionBy("author_id").orderBy("work_id"))
    return readable.join(a, "author_id").select(
        "author_id", "work_id", seq.alias("seq"), "latin_name", "greek_name", F.col("title_latin").alias("latin_title"), F.col("title_greek").alias("greek_title"), F.col("title_english").alias("english_title"),
        "cts_urn", F.col("cts_confirmed").cast("int").alias("cts_confirmed"), F.col("exportable").cast("int").alias("exportable"))


def export_authors(authors: DataFrame, readable: DataFrame) -> DataFrame:
    """The nine columns of its table of authors."""
    per = readable.groupBy("author_id").agg(F.count("*").alias("work_count"), F.count_if("exportable").alias("readable_count"))
    zero = F.lit(0).cast("long")
    return authors.join(per, "author_id", "left").select(
        "author_id", F.col("author_name_latin").alias("latin_name"), F.col("author_name_greek").alias("greek_name"), F.col("author_name_english").alias("english_name"), "epitheton", "era", "viaf_id",
        F.coalesce("work_count", zero).alias("work_count"), F.coalesce("readable_count", zero).alias("readable_count"))


#: Required keys and the pattern or type of every key of an author and of a work.
AUTHOR_KEYS = {"author_id": "^[0-9]{4}$", **{k: "text" for k in ("author_name_latin", "author_name_greek", "author_name_english", "epitheton", "era", "viaf_id")}, "source": "list", "works": "object"}
WORK_KEYS = {"work_id": "^[0-9]{3}$", **{k: "text" for k in ("title_latin", "title_english", "title_greek", "edition")}, "cts_urn": r"^urn:cts:greekLit:tlg[0-9]{4}\.tlg[0-9]{3}$", "cts_confirmed": "flag"}
AUTHOR_REQUIRED, WORK_REQUIRED = ("author_id", "author_name_latin", "works", "source"), ("work_id", "cts_urn", "cts_confirmed")


def _broken(doc: Column, key: Column, pattern: str, keys: dict[str, str], required: tuple[str, ...]) -> Column:
    """Names of the rules that one JSON object breaks."""
    there = F.json_object_keys(doc)
    v = lambda k: F.variant_get(F.try_parse_json(doc), f"$.{k}", "variant")
    kind = lambda k: F.schema_of_variant(v(k))
    rules = [F.when(there.isNull(), F.lit("no object")), F.when(~key.rlike(pattern), F.lit("key"))]
    rules += [F.when(~F.array_contains(there, k), F.lit(f"{k} missing")) for k in required]
    rules.append(F.when(F.size(F.array_except(there, F.array(*[F.lit(k) for k in keys]))) > 0, F.lit("unknown key")))
    for k, t in keys.items():
        has = F.array_contains(there, k)
        if t == "text":
            ok = kind(k).isin("STRING", "VOID")
        elif t == "flag":
            ok = kind(k) == "BOOLEAN"
        elif t == "object":
            ok = kind(k).startswith("OBJECT")
        elif t == "list":
            ok = F.size(F.try_variant_get(F.try_parse_json(doc), f"$.{k}", "array<string>")) > 0
        else:
            ok = (kind(k) == "STRING") & F.variant_get(F.try_parse_json(doc), f"$.{k}", "string").rlike(t)
        rules.append(F.when(has & ~F.coalesce(ok, F.lit(False)), F.lit(k)))
    return F.array_compact(F.array(*rules))


def schema_violations(docs: DataFrame) -> DataFrame:
    """(key, rule) of every rule of the index document that (author_id, node) JSON breaks; works are keyed author.work."""
    a = docs.select(F.col("author_id").alias("key"), F.explode(_broken(F.col("node"), F.col("author_id"), "^[0-9]{4}$", AUTHOR_KEYS, AUTHOR_REQUIRED)).alias("rule"))
    w = docs.select("author_id", F.explode(F.from_json(F.get_json_object("node", "$.works"), "map<string,string>")).alias("work_id", "work"))
    w = w.select(F.concat_ws(".", "author_id", "work_id").alias("key"), F.explode(_broken(F.col("work"), F.col("work_id"), "^[0-9]{3}$", WORK_KEYS, WORK_REQUIRED)).alias("rule"))
    return a.unionByName(w)


def documents(authors: DataFrame, works: DataFrame) -> DataFrame:
    """(author_id, node): the index document of each author as JSON, nulls kept, works keyed by number."""
    work = F.struct("work_id", "title_latin", "title_english", "title_greek", "edition", "cts_urn", "cts_confirmed")
    per = works.groupBy("author_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("work_id", work.alias("w"))))).alias("works"))
    none = F.create_map().cast("map<string,struct<work_id:string,title_latin:string,title_english:string,title_greek:string,edition:string,cts_urn:string,cts_confirmed:boolean>>")
    node = F.struct(*[F.col(c) for c in ("author_id", "author_name_latin", "author_name_greek", "author_name_english", "epitheton", "era", "viaf_id", "source")], F.coalesce("works", none).alias("works"))
    return authors.join(per, "author_id", "left").select("author_id", F.to_json(node, {"ignoreNullFields": "false"}).alias("node"))


# Search pages of four libraries (id, label, rank, address before the query, detail).
SEARCHES = (
    ("bsb", "Bayerische Staatsbibliothek (digitale Sammlungen)", 6, "https://www.digitale-sammlungen.de/de/search?query=", "Search link — a successful hit is not guaranteed."),
    ("google-books", "Google Books", 7, "https://www.google.com/search?tbm=bks&q=", "Search link."),
    ("hathitrust", "HathiTrust", 8, "https://catalog.hathitrust.org/Search/Results?q=", "Search link."),
    ("gallica", "BnF Gallica", 9, "https://gallica.bnf.fr/Search?q=", "Search link."),
)


def search_links(authors: DataFrame, works: DataFrame, searches=SEARCHES) -> DataFrame:
    """Links to search pages for every work, asking for its author and title."""
    names = authors.select("author_id", "author_name_english", "author_name_latin")
    asked = F.concat_ws(" ", X.first_filled(F.trim("author_name_english"), F.trim("author_name_latin")), X.first_filled(F.trim("title_english"), F.trim("title_latin"), F.trim("title_greek")))
    each = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(label).alias("label"), F.lit(rank).alias("link_rank"), F.lit(url).alias("url"), F.lit(detail).alias("detail")) for i, label, rank, url, detail in searches])
    made = works.join(names, "author_id", "left").select("author_id", "work_id", X.quote_url(asked).alias("q"), F.explode(each).alias("l"))
    return made.select("author_id", "work_id", "l.label", "l.link_rank", F.lit("scan").alias("link_type"), F.lit("search").alias("kind"), F.concat("l.url", "q").alias("url"), "l.detail")


def rank_links(links: DataFrame) -> DataFrame:
    """Links of each work in order of rank, longer details first; whole duplicates count once."""
    d = F.length(F.coalesce("detail", F.lit("")))
    w = Window.partitionBy("author_id", "work_id").orderBy("link_rank", d.desc(), "url", "link_id")
    return links.distinct().withColumn("place", F.row_number().over(w))
