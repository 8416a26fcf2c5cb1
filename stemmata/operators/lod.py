"""Linked data of the index: triples, nested nodes, and what may be published.

IRIs hang below a base the caller gives; nothing is published under a fixed address.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

BASE = "https://example.org/canon/"
EXACT, IDENTIFIER = "http://www.w3.org/2004/02/skos/core#exactMatch", "http://purl.org/dc/terms/identifier"
HAS_PART, CITATION = "http://purl.org/dc/terms/hasPart", "http://purl.org/dc/terms/bibliographicCitation"
VIAF = "https://viaf.org/viaf/"


def publishable(source: Column, confirmed: Column) -> Column:
    """Restricted tiers never, confirmed works always, others only if curated here."""
    return F.coalesce(F.when(source.startswith("restricted:"), F.lit(False)).when(confirmed, F.lit(True)).otherwise(source == "local:curated"), F.lit(False))


#: Prefixes of the identifiers that authors are matched with.
PREFIXES = {"wd": "http://www.wikidata.org/entity/", "viaf": VIAF}
READER = "https://reader.example/"


def _triples(df: DataFrame, s: Column, p: str, o: Column, literal: bool) -> DataFrame:
    return df.select(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"), F.lit(literal).alias("literal"))


def matched(authors: DataFrame, qids: DataFrame | None = None) -> DataFrame:
    """authors with ``matches``: the graph's id and the name authority's id of each, as CURIEs, each once.

    ``qids``: (author_id, wikidata_qid), one row per author at most.
    """
    a = authors.withColumn("viaf_curie", X.viaf_curie(F.regexp_replace(F.trim("viaf_id"), "^viaf:", "")))
    if qids is None:
        a = a.withColumn("wikidata_qid", F.lit(None).cast("string"))
    else:
        a = a.join(qids.select("author_id", "wikidata_qid"), "author_id", "left")
    wd = F.concat(F.lit("wd:"), X.blank_to_null(F.col("wikidata_qid")))
    return a.withColumn("matches", F.array_distinct(F.array_compact(F.array(wd, F.col("viaf_curie"))))).drop("viaf_curie")


def links(authors: DataFrame, works: DataFrame, base: str = BASE, qids: DataFrame | None = None) -> DataFrame:
    """(subject, predicate, object, literal): matches of authors, parts and identifiers of publishable works."""
    a_iri = F.concat(F.lit(base), F.col("author_id"))
    w_iri = F.concat(a_iri, F.lit("."), F.col("work_id"))
    a = matched(authors, qids).where(F.size("matches") > 0)
    w = works.where(publishable(F.col("source"), F.col("cts_confirmed")))
    parts = [
        _triples(a.select("author_id", F.explode("matches").alias("match")), a_iri, EXACT, X.expand_curie(F.col("match"), PREFIXES), False),
        _triples(a, a_iri, IDENTIFIER, F.concat(F.lit("tlg"), F.col("author_id")), True),
        _triples(w, a_iri, HAS_PART, w_iri, False),
        _triples(w, w_iri, IDENTIFIER, F.col("cts_urn"), True),
        _triples(w.where("cts_confirmed"), w_iri, EXACT, F.concat(F.lit(READER), F.col("cts_urn"), F.lit("/")), False),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def editions(works: DataFrame, base: str = BASE) -> DataFrame:
    w = works.where(publishable(F.col("source"), F.col("cts_confirmed")) & (F.coalesce("edition", F.lit("")) != ""))
    return _triples(w, F.concat(F.lit(base), F.col("author_id"), F.lit("."), F.col("work_id")), CITATION, F.col("edition"), True)


def ntriples(triples: DataFrame) -> DataFrame:
    """(line): one N-Triples statement per row."""
    obj = F.when(F.col("literal"), X.json_quote(F.col("object"))).otherwise(F.concat(F.lit("<"), F.col("object"), F.lit(">")))
    return triples.select(F.concat(F.lit("<"), F.col("subject"), F.lit("> <"), F.col("predicate"), F.lit("> "), obj, F.lit(" .")).alias("line"))


def title_buckets(works: DataFrame) -> DataFrame:
    """(author_id, work_id, la, grc, en): titles filed by the script they are written in, each once."""
    cols = (("title_latin", "la"), ("title_greek", "la"), ("title_english", "en"))
    lang = lambda c, d: F.when(X.first_script(F.col(c)) == "grc", "grc").otherwise(d)
    all_ = F.filter(F.array(*[F.struct(lang(c, d).alias("l"), F.col(c).alias("t")) for c, d in cols]), lambda x: F.coalesce(x["t"], F.lit("")) != "")
    pick = lambda name: F.array_distinct(F.transform(F.filter(all_, lambda x: x["l"] == name), lambda x: x["t"]))
    return works.select("author_id", "work_id", pick("la").alias("la"), pick("grc").alias("grc"), pick("en").alias("en"))


def nodes(authors: DataFrame, works: DataFrame, base: str = BASE, qids: DataFrame | None = None, source_iris: dict[str, str] | None = None) -> DataFrame:
    """(author_id, node): JSON of an author with nested works; empty keys are left out.

    Titles of one language, matches and sources are a string if there is one, else a list.
    Confirmed works match a text that can be read, others are marked as proposed.
    """
    quoted = lambda c: X.json_quote_text(X.blank_to_null(F.col(c)))
    a_iri, w_iri = F.concat(F.lit(base), F.col("author_id")), F.concat(F.lit(base), F.col("author_id"), F.lit("."), F.col("work_id"))
    t = works.join(title_buckets(works), ["author_id", "work_id"])
    work = X.json_object(
        id=X.json_quote_text(w_iri), type=F.lit('"Work"'), author=X.json_quote_text(a_iri), cts_urn=quoted("cts_urn"), ctsConfirmed=F.col("cts_confirmed").cast("string"),
        exactMatch=F.when(F.col("cts_confirmed"), X.json_quote_text(F.concat(F.lit(READER), F.col("cts_urn"), F.lit("/")))), proposed=F.when(~F.col("cts_confirmed"), F.lit("true")),
        title_la=X.json_one_or_list(F.col("la")), title_grc=X.json_one_or_list(F.col("grc")), title_en=X.json_one_or_list(F.col("en")), edition=quoted("edition"))
    per = t.groupBy("author_id").agg(F.sort_array(F.collect_list(F.struct("work_id", work.alias("w")))).alias("ws"))
    a = matched(authors, qids).join(per, "author_id", "left")
    iris = source_iris or {}
    known = F.create_map(*[x for k, v in iris.items() for x in (F.lit(k), F.lit(v))]) if iris else None
    derived = F.transform("source", lambda s: F.try_element_at(known, s)) if iris else F.array().cast("array<string>")
    node = X.json_object(
        id=X.json_quote_text(a_iri), type=F.lit('"Author"'), inScheme=X.json_quote_text(F.lit(base)), tlg_id=X.json_quote_text(F.concat(F.lit("tlg"), F.col("author_id"))),
        name_la=quoted("author_name_latin"), name_grc=quoted("author_name_greek"), name_en=quoted("author_name_english"), epithet=quoted("epitheton"), floruit=quoted("era"),
        exactMatch=X.json_one_or_list(F.col("matches")), derivedFrom=X.json_one_or_list(derived),
        works=F.concat(F.lit("["), F.array_join(F.transform("ws", lambda x: x["w"]), ","), F.lit("]")))
    return a.select("author_id", node.alias("node"))


def head_nodes(label: str, source: dict, base: str = BASE) -> list[dict]:
    """The nodes before the authors: the work that defines the numbers, and the scheme that cites it."""
    return [source, {"id": base, "type": "skos:ConceptScheme", "rdfs:label": label, "source": source["id"]}]


#: Signs of a guarded string that lines are searched for.
SEED = 8


def leaks(lines: DataFrame, guarded: DataFrame) -> DataFrame:
    """(line, secret): published lines that hold a guarded string anywhere; empty means the firewall holds.

    ``lines``: (line); ``guarded``: (secret), IRIs and edition strings of restricted works.
    Lines and strings meet on the last signs of the string, so this stays an equi-join.
    """
    g = guarded.where(F.coalesce("secret", F.lit("")) != "").select("secret").distinct().withColumn("n", F.least(F.length("secret"), F.lit(SEED)))
    g = g.withColumn("seed", F.expr("right(secret, n)"))
    at = F.sequence(F.lit(1), F.greatest(F.length("line") - F.col("n") + 1, F.lit(1)))
    lengths = g.select("n").distinct()  # SEED rows at most
    seeds = lines.select("line").distinct().select("line", F.explode(F.sequence(F.lit(1), F.lit(SEED))).alias("n")).join(F.broadcast(lengths), "n").where(F.length("line") >= F.col("n"))
    seeds = seeds.select("line", "n", F.explode(F.array_distinct(F.transform(at, lambda k: F.substring("line", k, F.col("n"))))).alias("seed"))
    return seeds.join(g, ["n", "seed"]).where(F.contains(F.col("line"), F.col("secret"))).select("line", "secret").distinct()
