"""Queries on the index of authors and works, and on the units and blocks of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import index as I
from ..operators import lod as L
from ..operators import subwords as S
from ..sources import files
from .compare_queries import _FLAT, _norm


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def authors(spark, folder):
    return I.merge_authors(table(spark, folder, "canon"))


def works(spark, folder):
    return I.merge_works(table(spark, folder, "works"))


def _curated(spark, folder):
    w = table(spark, folder, "works").where(F.col("source") == I.CURATED)
    w = w.withColumn("author_id", X.digits(F.col("author_id"), 4)).withColumn("work_id", X.digits(F.col("work_id"), 3)).where("author_id is not null and work_id is not null")
    first = Window.partitionBy("author_id", "work_id").orderBy("record_id")
    return w.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")


def _overlaid(spark, folder):
    return I.upsert_works(works(spark, folder), _curated(spark, folder))


def _repo(spark, folder):
    return table(spark, folder, "source_links").where("link_type = 'text' and kind = 'confirmed'").select("author_id", "work_id").distinct()


def _local(spark, folder):
    return table(spark, folder, "sections").select("author_id", "work_id").distinct()


def _readable(spark, folder):
    return I.readable(works(spark, folder), _repo(spark, folder), _local(spark, folder))


def author_merge_full_outer(spark, folder):
    return authors(spark, folder).withColumn("source", F.array_join("source", ";"))


def work_union(spark, folder):
    return works(spark, folder)


def provenance_array(spark, folder):
    return authors(spark, folder).select(F.posexplode("source").alias("pos", "tag")).groupBy("pos", "tag").agg(F.count("*").alias("n"))


def overlay_upsert(spark, folder):
    return _overlaid(spark, folder)


def cache_upsert(spark, folder):
    """Late rows of canon (loaded over a week after they were seen) replace the earlier row of their author."""
    c = table(spark, folder, "canon").withColumn("aid", X.digits(F.col("author_id"), 4)).where("aid is not null")
    late = F.col("loaded_at") > F.col("seen_at") + F.expr("interval 7 days")
    latest = lambda d: d.groupBy("aid").agg(F.max("record_id").alias("record_id"))
    return I.upsert_cache(latest(c.where(~late)), latest(c.where(late)), "aid")


def readable_counts(spark, folder):
    return _readable(spark, folder).groupBy("author_id").agg(F.count("*").alias("work_count"), F.count_if("readable").alias("readable_count"))


def exportable_seq(spark, folder):
    w = Window.partitionBy("author_id").orderBy("work_id")
    return _readable(spark, folder).select("author_id", "work_id", F.row_number().over(w).alias("seq"), F.col("exportable").cast("int").alias("exportable"))


def canon_flat_left(spark, folder):
    return I.flat(authors(spark, folder), works(spark, folder)).withColumn("cts_confirmed", F.initcap(F.col("cts_confirmed").cast("string")))


def flat_inner(spark, folder):
    return I.flat(authors(spark, folder), works(spark, folder), "inner").select("author_id", "author_name_latin", "work_id", "title_latin", "cts_urn")


def nested_canon(spark, folder):
    n = I.nested(authors(spark, folder), works(spark, folder))
    return n.select("author_id", F.coalesce(F.size(F.map_keys("works")), F.lit(0)).alias("works"), F.array_join(F.map_keys("works"), " ").alias("ids"))


def author_detail(spark, folder):
    r = _readable(spark, folder)
    per = r.groupBy("author_id").agg(F.sort_array(F.collect_list(F.concat("work_id", F.when(F.col("readable"), "+").otherwise("-"), F.when(F.col("has_local_text"), "t").otherwise("")))).alias("w"))
    return authors(spark, folder).join(per, "author_id", "left").select("author_id", "author_name_latin", F.array_join("w", " ").alias("works"))


def build_report(spark, folder):
    return I.report(authors(spark, folder), works(spark, folder))


def validate_ids(spark, folder):
    return I.violations(authors(spark, folder), works(spark, folder))


def validation_summary(spark, folder):
    return validate_ids(spark, folder).groupBy("severity", "message").agg(F.count("*").alias("n"))


def author_search(spark, folder):
    return I.search(authors(spark, folder), "mi", 50).select("author_id", "rank")


def author_search_id(spark, folder):
    return I.search(authors(spark, folder), "17").select("author_id", "rank")


def author_search_translit(spark, folder):
    """The search box with Latin letters that also stand for Greek ones."""
    return I.client_search(authors(spark, folder), "mi").select("author_id", "rank", "place")


def client_search_id(spark, folder):
    return I.client_search(authors(spark, folder), "1").select("author_id", "rank", "place")


def client_paging(spark, folder):
    """The second page of five authors in order of id: paging is the feature."""
    return authors(spark, folder).select("author_id").orderBy("author_id").offset(5).limit(5)


def client_totals(spark, folder):
    return I.client_totals(_readable(spark, folder), authors(spark, folder))


def exact_work_jump(spark, folder):
    """Where the query ``author.work``, made from the numbers of every record, leads."""
    w = table(spark, folder, "works").select("record_id", F.concat_ws(".", F.coalesce("author_id", F.lit("")), F.coalesce("work_id", F.lit(""))).alias("q"))
    return w.select("record_id", X.exact_work(F.col("q")).alias("x")).select("record_id", "x.author_id", "x.work_id")


def work_titles(spark, folder):
    return I.work_titles(works(spark, folder))


def work_meta(spark, folder):
    return I.work_meta(authors(spark, folder), works(spark, folder))


def export_works(spark, folder):
    return I.export_works(authors(spark, folder), _readable(spark, folder))


def export_authors(spark, folder):
    return I.export_authors(authors(spark, folder), I.readable(works(spark, folder), _repo(spark, folder), _local(spark, folder)))


def schema_check(spark, folder):
    """Broken rules of the documents of all authors; documents of odd ids lose their sources, which must be found."""
    a = authors(spark, folder).withColumn("source", F.when(F.col("author_id").cast("int") % 2 == 0, F.col("source")).otherwise(F.array().cast("array<string>")))
    return I.schema_violations(I.documents(a, works(spark, folder)))


def source_ranking(spark, folder):
    return I.rank_links(table(spark, folder, "source_links")).select("author_id", "work_id", "place", "link_id", "link_rank", "url")


def source_discovery(spark, folder):
    """Ranked links of every work: what the tables know, then search links made from its names."""
    a, w = authors(spark, folder), works(spark, folder)
    known = table(spark, folder, "source_links").select("link_id", "author_id", "work_id", "label", "link_rank", "link_type", "kind", "url", "detail")
    made = I.search_links(a, w)
    return I.rank_links(known.unionByName(made, allowMissingColumns=True)).select("author_id", "work_id", "place", "link_rank", "kind", "url")


def most_common_id(spark, folder):
    """The provider with most sections of each work; ties by its smallest section."""
    per = table(spark, folder, "sections").where("provider is not null").groupBy("author_id", "work_id", "provider").agg(F.count("*").alias("n"), F.min("section_id").alias("first"))
    return per.groupBy("author_id", "work_id").agg(F.max(F.struct("n", (-F.col("first")).alias("f"), "provider")).alias("m")).select("author_id", "work_id", "m.provider", "m.n")


def era_format(spark, folder):
    """Eras of made-up lives: years from the record number on both sides of our era."""
    c = table(spark, folder, "canon").select("record_id", ((F.col("record_id") * 37) % 1500 - 800).cast("int").alias("b"))
    iso = lambda y: F.concat(F.when(y < 0, "-").otherwise(""), F.lpad(F.abs(y).cast("string"), 4, "0"), F.lit("-01-01"))
    b = F.when(F.col("record_id") % 7 == 0, None).otherwise(iso(F.col("b")))
    d = F.when(F.col("record_id") % 5 == 0, None).otherwise(iso(F.col("b") + 60))
    return c.select("record_id", X.format_era(b, d).alias("era"))


def peel_epitheton(spark, folder):
    c = table(spark, folder, "canon").select("record_id", F.concat_ws(" ", "author_name_latin", "epitheton").alias("display"))
    return c.select("record_id", X.peel_epitheton(F.col("display")).alias("p")).select("record_id", "p.name", "p.epitheton")


def first_script(spark, folder):
    return table(spark, folder, "works").select("record_id", X.first_script(F.col("title_greek")).alias("greek"), X.first_script(F.col("title_latin")).alias("latin"))


def title_buckets(spark, folder):
    t = L.title_buckets(works(spark, folder))
    return t.select("author_id", "work_id", *[F.array_join(c, "|").alias(c) for c in ("la", "grc", "en")])


def publishable(spark, folder):
    o = _overlaid(spark, folder)
    return o.select("author_id", "work_id", L.publishable(F.col("source"), F.col("cts_confirmed")).alias("publishable"))


def triples_links(spark, folder):
    return L.links(authors(spark, folder), _overlaid(spark, folder), qids=_qids(spark, folder))


def _qids(spark, folder):
    """Stand-in for the ids of the graph: one per author it knows, from its first record."""
    c = table(spark, folder, "canon").where(F.array_contains("source", I.GRAPH)).select(X.digits(F.col("author_id"), 4).alias("author_id"), "record_id").where("author_id is not null")
    return c.groupBy("author_id").agg(F.concat(F.lit("Q"), F.min("record_id").cast("string")).alias("wikidata_qid"))


def triples_editions(spark, folder):
    return L.editions(_overlaid(spark, folder))


def ntriples_lines(spark, folder):
    return L.ntriples(L.editions(_overlaid(spark, folder)))


def jsonld_nodes(spark, folder):
    return L.nodes(authors(spark, folder), works(spark, folder), qids=_qids(spark, folder), source_iris={I.CLASSIC: "https://lists.example/", I.LATE: "https://lists.example/", I.CTS: "https://cts.example/"})


def _restricted(spark, folder):
    """The index with the works of one source as a restricted tier."""
    w = table(spark, folder, "works").where("source = 'scan:ocr'").withColumn("author_id", X.digits(F.col("author_id"), 4)).withColumn("work_id", X.digits(F.col("work_id"), 3)).where("author_id is not null and work_id is not null")
    first = Window.partitionBy("author_id", "work_id").orderBy("record_id")
    w = w.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn").withColumn("source", F.lit("restricted:scan"))
    return I.upsert_works(works(spark, folder), w)


def leak_check(spark, folder):
    """Guarded strings found in what is published, and in a publication without the firewall, where they must be found."""
    o = _restricted(spark, folder)
    hidden = o.where(F.col("source").startswith("restricted:"))
    iri = F.concat(F.lit(L.BASE), F.col("author_id"), F.lit("."), F.col("work_id"))
    guarded = hidden.select(iri.alias("secret")).unionByName(hidden.where("coalesce(edition, '') <> ''").select(F.concat(iri, F.lit("> <"), F.lit(L.CITATION), F.lit('> "'), F.col("edition")).alias("secret")))
    out = None
    for name, src in (("published", o), ("unguarded", o.withColumn("source", F.lit(None).cast("string")).withColumn("cts_confirmed", F.lit(True)))):
        lines = L.ntriples(L.links(authors(spark, folder), src).unionByName(L.editions(src)))
        found = L.leaks(lines, guarded).groupBy("secret").agg(F.count("*").alias("lines")).withColumn("publication", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out


def section_index(spark, folder):
    """Blocks per section of a work."""
    return table(spark, folder, "sections").groupBy("author_id", "work_id", "sec_index", "label").agg(F.count("*").alias("blocks"), F.count_if(F.col("kind") == "line").alias("lines"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"))


def text_blocks(spark, folder):
    """Paragraphs of plain texts, split at blank lines."""
    d = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("value"))
    return files.plain_blocks(d).select(F.col("path").cast("long").alias("doc_id"), "block_pos", F.length("text").alias("chars"), F.md5(F.regexp_replace("text", r"[\s\p{Z}\x85\x1c-\x1f]", "")).alias("ink"))


def word_freqs(spark, folder):
    return S.word_frequencies(table(spark, folder, "sections"), "text")


def bpe_pair_counts(spark, folder):
    return S.pair_frequencies(S.word_frequencies(table(spark, folder, "sections"), "text"))


#: A short model for the queries: merges a caller would read from a file.
MERGES = [("ο", "υ"), ("α", "ι"), ("τ", "ο"), ("κ", "αι"), ("ς", "</w>"), ("ν", "</w>"), ("τ", "α"), ("ε", "ι"), ("κ", "αι</w>"), ("το", "ν</w>")]


def bpe_tokens(spark, folder):
    f = S.word_frequencies(table(spark, folder, "sections"), "text")
    return f.select("word", F.array_join(S.encoder(MERGES)("word"), " ").alias("subwords"))


def stop_subwords(spark, folder):
    return S.stop_subwords(S.word_frequencies(table(spark, folder, "sections"), "text"), MERGES)


def json_props(spark, folder):
    return table(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).groupBy("k").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


def transliterate(spark, folder):
    c = table(spark, folder, "canon").select("record_id", X.latin_to_greek(F.col("author_name_latin")).alias("greek"), X.strip_greek("author_name_greek").alias("bare"))
    return c


def source_badges(spark, folder):
    badge = F.when(F.col("kind") == "search", "search").when(F.col("link_type") == "text", "text").when(F.col("link_type") == "metadata", "meta").otherwise("scan")
    return table(spark, folder, "source_links").select("link_id", "url", badge.alias("badge"), X.escape_html(F.coalesce("label", F.lit(""))).alias("label"))


# -- the same in SQL ---------------------------------------------------------------------

def _dig(c: str, n: int) -> str:
    d = f"regexp_extract(coalesce({c}, ''), '([0-9]+)', 1)"
    return f"case when {d} = '' then null when length({d}) < {n} then lpad({d}, {n}, '0') else {d} end"


_TAGS = (*I.CREATING, I.GRAPH)
_AUTH = f"""
with ar as (select {_dig('author_id', 4)} author_id, record_id, author_name_latin, author_name_english, author_name_greek, epitheton, era, viaf_id, unnest(source) tag from canon),
af as (select * from (select *, row_number() over (partition by author_id, tag order by record_id) rn from ar where author_id is not null) where rn = 1),
ids as (select distinct author_id from af where tag in {I.CREATING}),
authors as (select ids.author_id, coalesce(nullif(c.author_name_latin, ''), nullif(l.author_name_latin, ''), nullif(w.author_name_latin, ''), nullif(t.author_name_latin, '')) author_name_latin,
  coalesce(nullif(t.author_name_english, ''), nullif(w.author_name_english, '')) author_name_english, coalesce(nullif(c.epitheton, ''), nullif(l.epitheton, '')) epitheton,
  g.author_name_greek, g.era, g.viaf_id,
  list_filter([{', '.join(f"case when {x}.author_id is not null then '{t}' end" for x, t in zip('clwtg', _TAGS))}], lambda x: x is not null) source
  from ids {' '.join(f"left join (select * from af where tag = '{t}') {x} on {x}.author_id = ids.author_id" for x, t in zip('clwtg', _TAGS))})"""
_WORK = f"""wr as (select {_dig('author_id', 4)} author_id, {_dig('work_id', 3)} work_id, record_id, title_latin, title_english, title_greek, edition, cts_urn, source tag from works),
wf as (select * from (select *, row_number() over (partition by author_id, work_id, tag order by record_id) rn from wr where author_id is not null and work_id is not null) where rn = 1),
wid as (select distinct author_id, work_id from wf where tag in ('list:late', 'list:works', 'cts:inventory')),
wk as (select wid.author_id, wid.work_id, coalesce(nullif(l.title_latin, ''), nullif(w.title_latin, ''), nullif(t.title_latin, '')) title_latin, nullif(t.title_english, '') title_english,
  nullif(t.title_greek, '') title_greek, nullif(t.edition, '') edition, coalesce(nullif(t.cts_urn, ''), nullif(w.cts_urn, ''), 'urn:cts:greekLit:tlg' || wid.author_id || '.tlg' || wid.work_id) cts_urn, t.record_id is not null cts_confirmed
  from wid {' '.join(f"left join (select * from wf where tag = '{t}') {x} using (author_id, work_id)" for x, t in (('l', I.LATE), ('w', I.LISTED), ('t', I.CTS)))})"""
_BOTH = _AUTH + ", " + _WORK
_ONLYW = "with " + _WORK
_OVER = f""", cu as (select * from wf where tag = '{I.CURATED}'),
ov as (select coalesce(b.author_id, p.author_id) author_id, coalesce(b.work_id, p.work_id) work_id,
  {', '.join(f"coalesce(nullif(p.{c}, ''), nullif(b.{c}, '')) {c}" for c in ('title_latin', 'title_english', 'title_greek', 'edition'))},
  coalesce(nullif(p.cts_urn, ''), nullif(b.cts_urn, ''), 'urn:cts:greekLit:tlg' || coalesce(b.author_id, p.author_id) || '.tlg' || coalesce(b.work_id, p.work_id)) cts_urn,
  coalesce(b.cts_confirmed, false) cts_confirmed, p.tag as source, case when b.author_id is null then 'added' when p.author_id is not null then 'patched' else 'kept' end as action
  from wk b full join cu p on b.author_id = p.author_id and b.work_id = p.work_id)"""
_READ = """, rd as (select wk.*, wk.cts_confirmed or r.author_id is not null exportable, s.author_id is not null has_local_text, wk.cts_confirmed or r.author_id is not null or s.author_id is not null readable
  from wk left join (select distinct author_id, work_id from source_links where link_type = 'text' and kind = 'confirmed') r using (author_id, work_id) left join (select distinct author_id, work_id from sections) s using (author_id, work_id))"""
_PUB = "coalesce(case when source like 'restricted:%' then false when cts_confirmed then true else source = 'local:curated' end, false)"
_VIOL = r""", viol as (
select 'error' severity, author_id as key, 'author id' message from authors where not regexp_full_match(author_id, '[0-9]{4}')
union all select 'error', author_id, 'no source' from authors where len(source) = 0
union all select 'error', author_id || '.' || work_id, 'work id' from wk where not regexp_full_match(work_id, '[0-9]{3}')
union all select 'warning', author_id || '.' || work_id, 'urn form' from wk where not regexp_full_match(cts_urn, 'urn:cts:greekLit:tlg[0-9]{4}\.tlg[0-9]{3}')
union all select 'warning', author_id || '.' || work_id, 'urn of another work' from wk where cts_urn <> 'urn:cts:greekLit:tlg' || author_id || '.tlg' || work_id)"""
_MEAS = (("authors", "n_a", "n_a"), ("works", "n_w", "n_w"), ("authors with works", "w_w", "n_a"), ("confirmed works", "con", "n_w"), ("greek names", "gr", "n_a"), ("eras", "er", "n_a"), ("viaf ids", "vi", "n_a"), ("epitheta", "ep", "n_a"), ("greek titles", "gt", "n_w"))
_BLOB = "lower(concat_ws(' ', author_name_latin, author_name_english, author_name_greek, epitheton, author_id))"


def _script(c: str) -> str:
    x = f"regexp_extract({c}, '([Ͱ-Ͽἀ-῿A-Za-z])', 1)"
    return f"case when {x} is null or {x} = '' then null when regexp_matches({x}, '[A-Za-z]') then 'la' else 'grc' end"


_SUF = "case {0} when 1 then 'st' when 2 then 'nd' when 3 then 'rd' else 'th' end"
_CB, _CD = "((abs(b) + 99) // 100)", "((abs(d) + 99) // 100)"
_LO, _HI = f"least({_CB}, {_CD})", f"greatest({_CB}, {_CD})"

def _one_or_list(values: str, name: str) -> str:
    each = f"list_transform({values}, lambda x: to_json(x)::varchar)"
    return f"case when len({values}) = 1 then '\"{name}\":' || {each}[1] when len({values}) > 1 then '\"{name}\":[' || array_to_string({each}, ',') || ']' end"


def _bare(x: str) -> str:
    wide = "\u00a0\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"  # spaces that NFKD makes plain
    flat = f"replace(strip_accents(translate({_FLAT.replace('{0}', x, 1)}, '{wide}', '{' ' * len(wide)}')), 'ς', 'σ')"
    return f"lower(regexp_replace({flat}, '([\\p{{L}}])Σ([^\\p{{L}}]|$)', '\\1ς\\2', 'g'))"


def _bpe(word: str) -> str:
    """The subwords of a word by ``MERGES``: none uses a pair that a later one makes, so they may run in order."""
    s = f"chr(2) || array_to_string(list_transform(range(1, length({word}) + 1), lambda k: substring({word}, k::bigint, 1)) || ['</w>'], chr(3) || chr(2)) || chr(3)"
    for a, b in MERGES:
        s = f"replace({s}, chr(2) || '{a}' || chr(3) || chr(2) || '{b}' || chr(3), chr(2) || '{a}{b}' || chr(3))"
    return f"string_split(regexp_replace({s}, '^\\x02|\\x03$', '', 'g'), chr(3) || chr(2))"


_CLIENT = f"lower(concat_ws('  ', nullif(author_name_latin, ''), nullif(author_name_greek, ''), nullif(author_name_english, ''), nullif(epitheton, ''), author_id, nullif({_bare('author_name_greek')}, '')))"
_STARTS = "(coalesce(starts_with(lower(author_name_latin), 'mi'), false) or coalesce(starts_with(lower(author_name_english), 'mi'), false))"
_QID = f""", qids as (select {_dig('author_id', 4)} author_id, 'Q' || min(record_id) qid from canon where list_contains(source, '{I.GRAPH}') and {_dig('author_id', 4)} is not null group by 1)"""
_FREQ = f"with f as (select {_norm('w')} word, count(*) n from (select unnest(regexp_extract_all(strip_accents({_FLAT.replace('{0}', 'text', 1)}), '[\\p{{L}}\\p{{N}}_]+')) w from sections) group by 1)"

SQL = {
    "author_merge_full_outer": _AUTH + " select * exclude (source), array_to_string(source, ';') source from authors",
    "work_union": _ONLYW + " select * from wk",
    "provenance_array": _AUTH + " select pos - 1 pos, tag, count(*) n from (select generate_subscripts(source, 1) pos, unnest(source) tag from authors) group by all",
    "overlay_upsert": _ONLYW + _OVER + " select * from ov",
    "cache_upsert": f"""with c as (select {_dig('author_id', 4)} aid, record_id, loaded_at > seen_at + interval 7 days late from canon), f as (select aid, max(record_id) record_id from c where aid is not null and late group by aid)
  select aid, record_id from f union all select aid, max(record_id) from c where aid is not null and not late and aid not in (select aid from f) group by aid""",
    "readable_counts": _ONLYW + _READ + " select author_id, count(*) work_count, count(*) filter (readable) readable_count from rd group by author_id",
    "exportable_seq": _ONLYW + _READ + " select author_id, work_id, row_number() over (partition by author_id order by work_id) seq, exportable::int exportable from rd",
    "canon_flat_left": _BOTH + " select authors.* exclude (source), array_to_string(source, ';') source, wk.* exclude (author_id, cts_confirmed), case when cts_confirmed then 'True' when not cts_confirmed then 'False' end cts_confirmed from authors left join wk using (author_id)",
    "flat_inner": _BOTH + " select author_id, author_name_latin, work_id, title_latin, cts_urn from authors join wk using (author_id)",
    "nested_canon": _BOTH + " select author_id, count(work_id) works, string_agg(work_id, ' ' order by work_id) ids from authors left join wk using (author_id) group by author_id",
    "author_detail": _BOTH + _READ + " select author_id, any_value(author_name_latin) author_name_latin, string_agg(work_id || case when readable then '+' else '-' end || case when has_local_text then 't' else '' end, ' ' order by work_id) works from authors left join rd using (author_id) group by author_id",
    "build_report": _BOTH + f""", a as (select count(*) n_a, count(nullif(author_name_greek, '')) gr, count(nullif(era, '')) er, count(nullif(viaf_id, '')) vi, count(nullif(epitheton, '')) ep from authors),
  w as (select count(*) n_w, count(*) filter (cts_confirmed) con, count(title_greek) gt, count(distinct author_id) w_w from wk), r as (select * from a, w)
  {' union all '.join(f"select '{m}' measure, {n} n, {x} whole, case when {x} = 0 then '0%' else format('{{:.1f}}%', round(100.0 * {n} / {x}, 1)) end share from r" for m, n, x in _MEAS)}
  union all select 'source ' || s, count(*), null, null from (select unnest(source) s from authors) group by s""",
    "validate_ids": _BOTH + _VIOL + " select * from viol",
    "validation_summary": _BOTH + _VIOL + " select severity, message, count(*) n from viol group by all",
    "author_search": _AUTH + f""" select author_id, 4 * (not starts_with(author_id, 'mi'))::int + 2 * (not coalesce(starts_with(lower(author_name_latin), 'mi'), false))::int + (not coalesce(starts_with(lower(author_name_english), 'mi'), false))::int as rank
  from authors where contains({_BLOB}, 'mi') order by rank, author_id limit 50""",
    "author_search_id": _AUTH + " select author_id, (author_id <> '0017')::int as rank from authors where starts_with(author_id, '0017') order by rank, author_id limit 50",
    "author_search_translit": _AUTH + f""", h as (select author_id, case when starts_with(author_id, 'mi') then 0 else 2 end + case when {_STARTS} then 0 else 1 end as rank from authors where contains({_CLIENT}, 'mi') or contains({_CLIENT}, 'μι'))
  select author_id, rank, row_number() over (order by rank, author_id) place from h""",
    "client_search_id": _AUTH + " select author_id, case when starts_with(author_id, '1') then 0 else 2 end + 1 as rank, row_number() over (order by starts_with(author_id, '1') desc, author_id) place from authors where starts_with(author_id, '0001')",
    "client_paging": _AUTH + " select author_id from authors order by author_id limit 5 offset 5",
    "client_totals": _BOTH + _READ + " select (select count(*) from authors) authors, count(*) works, count(*) filter (readable) readable from rd where author_id in (select author_id from authors)",
    "exact_work_jump": r"""with q as (select record_id, coalesce(author_id, '') || '.' || coalesce(work_id, '') q from works), m as (select record_id, trim(q) q, regexp_full_match(trim(q), '[0-9]{1,4}\.[0-9]{3}') ok from q)
  select record_id, case when ok then lpad(split_part(q, '.', 1), 4, '0') end author_id, case when ok then split_part(q, '.', 2) end work_id from m""",
    "work_titles": _ONLYW + " select author_id, work_id, coalesce(title_latin, title_english, title_greek, author_id || '.' || work_id) title from wk",
    "work_meta": _BOTH + " select author_id, work_id, author_name_latin author_latin, author_name_greek author_greek, title_latin, title_greek, title_english, edition, cts_urn from wk left join authors using (author_id)",
    "export_works": _BOTH + _READ + """ select author_id, work_id, row_number() over (partition by author_id order by work_id) seq, author_name_latin latin_name, author_name_greek greek_name, title_latin latin_title, title_greek greek_title, title_english english_title,
  cts_urn, cts_confirmed::int cts_confirmed, exportable::int exportable from rd join authors using (author_id)""",
    "export_authors": _BOTH + _READ + """ select author_id, author_name_latin latin_name, author_name_greek greek_name, author_name_english english_name, epitheton, era, viaf_id, count(rd.work_id) work_count, count(*) filter (rd.exportable) readable_count
  from authors left join rd using (author_id) group by all""",
    "schema_check": _BOTH + r""" select author_id as key, 'source' as rule from authors where author_id::int % 2 = 1 or len(source) = 0
  union all select author_id, 'key' from authors where not regexp_full_match(author_id, '[0-9]{4}') union all select author_id, 'author_id' from authors where not regexp_full_match(author_id, '[0-9]{4}')
  union all select author_id || '.' || work_id, 'cts_urn' from wk join authors using (author_id) where not regexp_full_match(cts_urn, 'urn:cts:greekLit:tlg[0-9]{4}\.tlg[0-9]{3}')
  union all select author_id || '.' || work_id, r from wk join authors using (author_id), (select unnest(['key', 'work_id']) r) where not regexp_full_match(work_id, '[0-9]{3}')""",
    "source_ranking": "select author_id, work_id, row_number() over (partition by author_id, work_id order by link_rank nulls first, length(coalesce(detail, '')) desc, url nulls first, link_id nulls first) place, link_id, link_rank, url from (select distinct * from source_links)",
    "source_discovery": _BOTH + f""", q as (select author_id, work_id, replace(url_encode(concat_ws(' ', coalesce(nullif(trim(author_name_english), ''), nullif(trim(author_name_latin), '')), coalesce(nullif(trim(title_english), ''), nullif(trim(title_latin), ''), nullif(trim(title_greek), '')))), '+', '%20') q
  from wk left join authors using (author_id)),
  l as (select link_id, author_id, work_id, link_rank, kind, url, detail from (select distinct * exclude (seen_at) from source_links)
    {' '.join(f"union all select null, author_id, work_id, {r}, 'search', '{u}' || q, '{d}' from q" for _, _, r, u, d in I.SEARCHES)})
  select author_id, work_id, row_number() over (partition by author_id, work_id order by link_rank nulls first, length(coalesce(detail, '')) desc, url nulls first, link_id nulls first) place, link_rank, kind, url from l""",
    "most_common_id": "select author_id, work_id, provider, n from (select *, row_number() over (partition by author_id, work_id order by n desc, f) rn from (select author_id, work_id, provider, count(*) n, min(section_id) f from sections where provider is not null group by all)) where rn = 1",
    "era_format": f"""with c as (select record_id, ((record_id * 37) % 1500 - 800)::int y from canon), e as (select record_id, case when record_id % 7 = 0 then null else y end b, case when record_id % 5 = 0 then null else y + 60 end d from c)
  select record_id, case when b < 0 and d < 0 then {_LO} || 'th' || case when {_LO} <> {_HI} then '–' || {_HI} || 'th' else '' end || ' c. B.C.'
  when b >= 0 and d >= 0 then {_LO} || {_SUF.format(_LO)} || case when {_LO} <> {_HI} then '–' || {_HI} || {_SUF.format(_HI)} else '' end || ' c. A.D.'
  when coalesce(b, d) is not null then coalesce({_CB}, {_CD}) || {_SUF.format(f'coalesce({_CB}, {_CD})')} || case when coalesce(b, d) < 0 then ' c. B.C.' else ' c. A.D.' end end era from e""",
    "first_script": f"select record_id, {_script('title_greek')} greek, {_script('title_latin')} latin from works",
    "title_buckets": _ONLYW + f""", b as (select author_id, work_id, list_filter([{{'l': case when {_script('title_latin')} = 'grc' then 'grc' else 'la' end, 't': title_latin}}, {{'l': case when {_script('title_greek')} = 'grc' then 'grc' else 'la' end, 't': title_greek}},
  {{'l': case when {_script('title_english')} = 'grc' then 'grc' else 'en' end, 't': title_english}}], lambda x: coalesce(x.t, '') <> '') v from wk)
  select author_id, work_id, """ + ", ".join(f"case when len(list_filter(v, lambda x: x.l = '{k}')) = 2 and list_filter(v, lambda x: x.l = '{k}')[1].t = list_filter(v, lambda x: x.l = '{k}')[2].t then list_filter(v, lambda x: x.l = '{k}')[1].t else coalesce(array_to_string(list_transform(list_filter(v, lambda x: x.l = '{k}'), lambda x: x.t), '|'), '') end {k}" for k in ("la", "grc", "en")) + " from b",
    "publishable": _ONLYW + _OVER + f" select author_id, work_id, {_PUB} publishable from ov",
    "triples_links": _BOTH + _QID + _OVER + f""", p as (select * from ov where {_PUB}), m as (select author_id, regexp_extract(regexp_replace(regexp_replace(trim(viaf_id), '^viaf:', ''), '/+$', ''), '([^/]*)$', 1) v from authors),
  mm as (select author_id, '{L.VIAF}' || v as iri from m where regexp_full_match(v, '[0-9]+') union all select author_id, '{L.PREFIXES['wd']}' || qid from qids join authors using (author_id))
  select '{L.BASE}' || author_id subject, '{L.EXACT}' predicate, iri as object, false as literal from mm union all select '{L.BASE}' || author_id, '{L.IDENTIFIER}', 'tlg' || author_id, true from (select distinct author_id from mm)
  union all select '{L.BASE}' || author_id, '{L.HAS_PART}', '{L.BASE}' || author_id || '.' || work_id, false from p union all select '{L.BASE}' || author_id || '.' || work_id, '{L.IDENTIFIER}', cts_urn, true from p
  union all select '{L.BASE}' || author_id || '.' || work_id, '{L.EXACT}', '{L.READER}' || cts_urn || '/', false from p where cts_confirmed""",
    "jsonld_nodes": _BOTH + _QID + f""", tb as (select author_id, work_id, list_filter([{{'l': case when {_script('title_latin')} = 'grc' then 'grc' else 'la' end, 't': title_latin}}, {{'l': case when {_script('title_greek')} = 'grc' then 'grc' else 'la' end, 't': title_greek}},
  {{'l': case when {_script('title_english')} = 'grc' then 'grc' else 'en' end, 't': title_english}}], lambda x: coalesce(x.t, '') <> '') v from wk),
  tl as (select author_id, work_id, {', '.join(f"case when len(list_filter(v, lambda x: x.l = '{k}')) = 2 and list_filter(v, lambda x: x.l = '{k}')[1].t = list_filter(v, lambda x: x.l = '{k}')[2].t then [list_filter(v, lambda x: x.l = '{k}')[1].t] else list_transform(list_filter(v, lambda x: x.l = '{k}'), lambda x: x.t) end {k}" for k in ('la', 'grc', 'en'))} from tb),
  wn as (select wk.author_id, wk.work_id, '{{' || concat_ws(',', '"id":' || to_json('{L.BASE}' || wk.author_id || '.' || wk.work_id), '"type":"Work"', '"author":' || to_json('{L.BASE}' || wk.author_id), '"cts_urn":' || to_json(cts_urn), '"ctsConfirmed":' || cts_confirmed::varchar,
    case when cts_confirmed then '"exactMatch":' || to_json('{L.READER}' || cts_urn || '/') end, case when not cts_confirmed then '"proposed":true' end, {', '.join(_one_or_list(k, f'title_{k}') for k in ('la', 'grc', 'en'))}, '"edition":' || to_json(nullif(edition, ''))) || '}}' w
    from wk join tl on tl.author_id = wk.author_id and tl.work_id = wk.work_id),
  per as (select author_id, '[' || string_agg(w, ',' order by work_id) || ']' ws from wn group by author_id),
  vm as (select author_id, regexp_extract(regexp_replace(regexp_replace(trim(viaf_id), '^viaf:', ''), '/+$', ''), '([^/]*)$', 1) v from authors),
  am as (select authors.*, list_filter([case when qid is not null then 'wd:' || qid end, case when regexp_full_match(v, '[0-9]+') then 'viaf:' || v end], lambda x: x is not null) ms,
    list_distinct(list_filter([{', '.join(f"case when list_contains(source, '{t}') then '{u}' end" for t, u in (('list:classic', 'https://lists.example/'), ('list:late', 'https://lists.example/'), ('cts:inventory', 'https://cts.example/')))}], lambda x: x is not null)) ds0, ws
    from authors left join qids using (author_id) left join vm using (author_id) left join per using (author_id)),
  an as (select *, case when len(ds0) = 2 then ['https://lists.example/', 'https://cts.example/'] else ds0 end ds from am)
  select author_id, '{{' || concat_ws(',', '"id":' || to_json('{L.BASE}' || author_id), '"type":"Author"', '"inScheme":' || to_json('{L.BASE}'), '"tlg_id":' || to_json('tlg' || author_id), '"name_la":' || to_json(nullif(author_name_latin, '')), '"name_grc":' || to_json(nullif(author_name_greek, '')), '"name_en":' || to_json(nullif(author_name_english, '')),
    '"epithet":' || to_json(nullif(epitheton, '')), '"floruit":' || to_json(nullif(era, '')), {_one_or_list('ms', 'exactMatch')}, {_one_or_list('ds', 'derivedFrom')}, '"works":' || ws) || '}}' node from an""",
    "peel_epitheton": f"""with c as (select record_id, concat_ws(' ', author_name_latin, epitheton) display from canon),
  t as (select record_id, display, list_filter(regexp_split_to_array(trim(display), '[\\s\\p{{Z}}\\x{{85}}\\x{{0b}}]+'), lambda x: x <> '') tok from c),
  n as (select *, coalesce(list_position(list_transform(list_reverse(tok), lambda x: regexp_replace(lower(x), '^[<>()\\[\\],]+|[<>()\\[\\],]+$', '', 'g') in ({', '.join(repr(g) for g in X.GENRES)})), false) - 1, len(tok)) k from t)
  select record_id, case when k = 0 then trim(display) else array_to_string(tok[1:len(tok) - k], ' ') end as name, case when k > 0 then array_to_string(tok[len(tok) - k + 1:], ' ') end epitheton from n""",
    "transliterate": f"""select record_id, translate(replace(regexp_replace(regexp_replace(lower(author_name_latin), 's([a-z])', 'σ\\1', 'g'), 's([a-z])', 'σ\\1', 'g'), 's', 'ς'), '{X.LATIN_KEYS}', '{X.GREEK_KEYS}') greek, {_bare('author_name_greek')} bare from canon""",
    "bpe_pair_counts": _FREQ + """, l as (select list_transform(range(1, length(word) + 1), lambda k: substring(word, k::bigint, 1)) || ['</w>'] s, n from f), p as (select unnest(list_zip(s[:-2], s[2:])) x, n from l)
  select x[1] a, x[2] b, sum(n)::bigint n from p group by 1, 2""",
    "bpe_tokens": _FREQ + f" select word, array_to_string({_bpe('word')}, ' ') subwords from f",
    "stop_subwords": _FREQ + f", t as (select unnest({_bpe('word')}) subword, n from f) select subword, sum(n)::bigint n from t where contains(subword, '</w>') group by subword order by n desc, subword desc limit 50",
    "triples_editions": _ONLYW + _OVER + f" select '{L.BASE}' || author_id || '.' || work_id subject, '{L.CITATION}' predicate, edition as object, true as literal from ov where {_PUB} and coalesce(edition, '') <> ''",
    "ntriples_lines": _ONLYW + _OVER + f" select '<{L.BASE}' || author_id || '.' || work_id || '> <{L.CITATION}> ' || to_json(edition)::varchar || ' .' line from ov where {_PUB} and coalesce(edition, '') <> ''",
    "leak_check": _BOTH + f""", rs as (select * from (select {_dig('author_id', 4)} aid, {_dig('work_id', 3)} wid, edition, row_number() over (partition by {_dig('author_id', 4)}, {_dig('work_id', 3)} order by record_id) rn from works where source = 'scan:ocr') where rn = 1 and aid is not null and wid is not null),
  hid as (select aid, wid, coalesce(nullif(rs.edition, ''), nullif(wk.edition, '')) ed, wk.cts_confirmed is not null known from rs left join wk on wk.author_id = aid and wk.work_id = wid)
  select '{L.BASE}' || aid || '.' || wid secret, 'unguarded' publication, 3 + (ed is not null)::int as lines from hid
  union all select '{L.BASE}' || aid || '.' || wid || '> <{L.CITATION}> "' || ed, 'unguarded', 1 from hid where ed is not null""",
    "word_freqs": f"select {_norm('w')} word, count(*) n from (select unnest(regexp_extract_all(strip_accents({_FLAT.replace('{0}', 'text', 1)}), '[\\p{{L}}\\p{{N}}_]+')) w from sections) group by 1",
    "section_index": "select author_id, work_id, sec_index, label, count(*) blocks, count(*) filter (kind = 'line') lines, sum(coalesce(length(text), 0))::bigint chars from sections group by all",
    "text_blocks": r"""with p as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n[\s\x0b]*\n'), lambda b: regexp_replace(b, '^[\s\p{Z}\x{85}\x{0b}]+|[\s\p{Z}\x{85}\x{0b}]+$', '', 'g')), lambda b: b <> '') v from documents where text is not null),
  q as (select doc_id, generate_subscripts(v, 1) - 1 block_pos, unnest(v) block from p)
  select doc_id, block_pos, length(block) chars, md5(regexp_replace(block, '[\s\p{Z}\x{85}\x{0b}\x{1c}-\x{1f}]', '', 'g')) ink from q""",
    "json_props": "select k, count(*) n, max(event_id) as last from (select event_id, try_cast(json_extract_string(props, '$.k') as bigint) k from events) group by k",
    "source_badges": "select link_id, url, case when kind = 'search' then 'search' when link_type = 'text' then 'text' when link_type = 'metadata' then 'meta' else 'scan' end badge, replace(replace(replace(replace(replace(coalesce(label, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') as label from source_links",
}
QUERIES = {f.__name__: f for f in (
    author_merge_full_outer, work_union, provenance_array, overlay_upsert, cache_upsert, readable_counts, exportable_seq, canon_flat_left, flat_inner, nested_canon, author_detail,
    build_report, validate_ids, validation_summary, author_search, author_search_id, author_search_translit, client_search_id, client_paging, client_totals, exact_work_jump, work_titles, work_meta, export_works, export_authors, schema_check, source_ranking, source_discovery,
    most_common_id, era_format, peel_epitheton, first_script, title_buckets, publishable, triples_links, triples_editions, ntriples_lines, jsonld_nodes, leak_check, section_index,
    text_blocks, word_freqs, bpe_pair_counts, bpe_tokens, stop_subwords, json_props, transliterate, source_badges)}
