"""Command line: build the index, export and publish it, check it, search it, compare texts, run a query."""

from __future__ import annotations

import argparse
import json
import os
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import registry
from .operators import index as I
from .operators import lod as L
from .operators import units as U
from .plans.build import build_index
from .plans.compare import Compare
from .plans.params import Params
from .sources import files, html, sinks, xml

SOURCES = ("classic", "late", "listed", "graph", "curated")


def _index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/authors"), spark.read.parquet(f"{folder}/works")


def _save(authors: DataFrame, works: DataFrame, folder: str) -> None:
    if "source" not in works.columns:
        works = works.withColumn("source", F.lit(None).cast("string"))
    authors.write.mode("overwrite").parquet(f"{folder}/authors")
    works.write.mode("overwrite").parquet(f"{folder}/works")


def build(spark, a) -> int:
    pages = {n: html.files(spark, getattr(a, n)) for n in SOURCES if getattr(a, n)}
    _save(*build_index(spark, inventory=a.inventory, **pages), a.out)
    return 0


def overlay(spark, a) -> int:
    authors, works = _index(spark, a.index)
    _save(authors, I.upsert_works(works, files.overlay(html.files(spark, a.pages))), a.out)
    return 0


def export(spark, a) -> int:
    authors, works = _index(spark, a.index)
    os.makedirs(a.out, exist_ok=True)
    works = works.drop("source", "action")
    sinks.write_csv(I.flat(authors, works), f"{a.out}/index.csv", ["author_id", "work_id"])
    sinks.write_json(I.documents(authors, works), f"{a.out}/index.json")
    none = works.select("author_id", "work_id").limit(0)
    repo = files.repository_tree(html.files(spark, a.tree)).select("author_id", "work_id") if a.tree else none
    flags = I.readable(works, repo, none)
    sinks.write_sqlite(I.export_authors(authors, flags), I.export_works(authors, flags), f"{a.out}/index.db", "latin_name")
    with open(f"{a.out}/report.md", "w", encoding="utf-8") as f:
        f.write(sinks.report_text(I.report(authors, works)))
    return 0


def publish(spark, a) -> int:
    authors, works = _index(spark, a.index)
    os.makedirs(a.out, exist_ok=True)
    qids = files.bindings(html.files(spark, a.graph)) if a.graph else None
    head = L.head_nodes("Index of authors and works", {"id": f"{a.base}source", "type": "schema:Book"}, a.base)
    sinks.write_jsonld(L.nodes(authors, works, a.base, qids), f"{a.out}/index.jsonld", {"id": "@id", "type": "@type"}, head)
    sinks.write_ntriples(L.links(authors, works, a.base, qids), f"{a.out}/links.nt", "cross references")
    sinks.write_ntriples(L.editions(works, a.base), f"{a.out}/editions.nt", "editions")
    return 0


def validate(spark, a) -> int:
    """Prints the broken rules; fails on errors, not on warnings."""
    bad = I.violations(*_index(spark, a.index)).groupBy("severity", "message").agg(F.count("*").alias("n"), F.min("key").alias("first")).orderBy("severity", "message").collect()
    for r in bad:
        print(f"{r['severity']}: {r['message']}: {r['n']}, first {r['first']}")
    return int(any(r["severity"] == "error" for r in bad))


def guard(spark, a) -> int:
    """Fails if a published line holds an IRI or an edition of a restricted work."""
    _, works = _index(spark, a.index)
    hidden = works.where(F.col("source").startswith("restricted:"))
    iri = F.concat(F.lit(a.base), F.col("author_id"), F.lit("."), F.col("work_id"))
    found = L.leaks(spark.read.text(a.published).select(F.col("value").alias("line")), hidden.select(iri.alias("secret")).unionByName(hidden.select(F.col("edition").alias("secret"))))
    n = found.count()
    print(f"{n} leaks" if n else "no leaks")
    return int(n > 0)


def search(spark, a) -> int:
    for r in I.search(_index(spark, a.index)[0], a.query, a.limit).toLocalIterator():
        print(r["author_id"], r["author_name_latin"] or r["author_name_english"] or "", sep="\t")
    return 0


def _units(spark, path: str, p: Params) -> DataFrame:
    """Windows of the leaf units of TEI files, or of the paragraphs of plain texts."""
    pages = html.files(spark, path)
    parts = xml.read_tei_units(pages.where("path like '%.xml'")).select("path", F.col("unit").alias("pos"), "label", "text")
    plain = files.plain_blocks(pages.where("path not like '%.xml'")).select("path", F.col("block_pos").alias("pos"), (F.col("block_pos") + 1).cast("string").alias("label"), "text")
    both = parts.unionByName(plain).withColumn("key", F.struct("path", "pos", "label"))
    w = U.windows(both, "key", "text", p.window, p.overlap)
    label = F.when(F.col("windows") > 1, F.concat("key.label", F.lit("#"), F.col("k").cast("string"))).otherwise(F.col("key.label"))
    w = w.select(F.monotonically_increasing_id().alias("unit"), label.alias("label"), F.array_join("words", " ").alias("text"))
    return U.tokenised(w, ["unit", "label"], F.col("text"), p)


def compare(spark, a) -> int:
    """Prints the events of a comparison of two sets of files as JSON lines, best matches first."""
    p = Params(**{f.name: getattr(a, f.name) for f in fields(Params) if getattr(a, f.name, None) is not None})
    if p.max_candidates <= 0:
        p = Params(**{**p.__dict__, "max_candidates": None})
    for line in sinks.ndjson(Compare(_units(spark, a.left, p), _units(spark, a.right, p), p).events()):
        print(line)
    return 0


def query(spark, a) -> int:
    df = registry.queries()[a.name](spark, a.data)
    if a.out:
        df.write.mode("overwrite").parquet(a.out)
    else:
        for r in df.toLocalIterator():
            print(json.dumps(r.asDict(recursive=True), ensure_ascii=False, default=str))
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="stemmata", description=__doc__)
    sub = top.add_subparsers(required=True)

    def command(run, *options, **defaults):
        c = sub.add_parser(run.__name__, help=run.__doc__)
        c.set_defaults(run=run)
        for o in options:
            c.add_argument(o, **({"required": True} if o in ("--index", "--out", "--pages", "--published", "--data") and o not in defaults.get("free", ()) else {}))
        return c

    command(build, "--out", "--inventory", *[f"--{n}" for n in SOURCES])
    command(overlay, "--index", "--pages", "--out")
    command(export, "--index", "--out", "--tree")
    command(publish, "--index", "--out", "--graph").add_argument("--base", default=L.BASE)
    command(validate, "--index")
    command(guard, "--index", "--published").add_argument("--base", default=L.BASE)
    c = command(search, "--index")
    c.add_argument("query")
    c.add_argument("--limit", type=int, default=50)
    c = command(compare)
    c.add_argument("left")
    c.add_argument("right")
    for name, kind in (("ngram", int), ("n_out", int), ("min_chain_words", int), ("fuzz_threshold", float), ("similarity_threshold", float), ("min_shared", int), ("max_candidates", int)):
        c.add_argument(f"--{name.replace('_', '-')}", dest=name, type=kind)
    c = command(query, "--data", "--out", free=("--out",))
    c.add_argument("name", choices=sorted(registry.queries()))
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("stemmata").getOrCreate()
    return a.run(spark, a)
