"""The index built from its sources in one call: pages in, authors and works out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import index as I
from ..sources import files, html, xml

_A = "record_id long, author_id string, author_name_latin string, author_name_english string, author_name_greek string, epitheton string, era string, viaf_id string, source array<string>"
_W = "record_id long, author_id string, work_id string, title_latin string, title_english string, title_greek string, edition string, cts_urn string, source string"


def build_index(spark, classic: DataFrame | None = None, late: DataFrame | None = None, listed: DataFrame | None = None, inventory: str | None = None, graph: DataFrame | None = None, curated: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(authors, works) merged from whatever sources are given; a missing source is an empty one.

    ``classic``, ``late``, ``listed``, ``graph``, ``curated``: (path, value) pages of the author
    list, the table of updates, the list of works, the graph's bindings and the overlay;
    ``inventory``: path of the CTS inventory.
    """
    a, w = spark.createDataFrame([], _A), spark.createDataFrame([], _W)
    zero = F.lit(0).cast("long").alias("record_id")  # one record per source and key
    add = lambda to, df, tag, array: to.unionByName(df.select(zero, "*", (F.array(F.lit(tag)) if array else F.lit(tag)).alias("source")), allowMissingColumns=True)
    if classic is not None:
        a = add(a, html.author_list(classic), I.CLASSIC, True)
    if late is not None:
        x, y = html.author_table(late)
        a, w = add(a, x, I.LATE, True), add(w, y, I.LATE, False)
    if listed is not None:
        x, y = files.work_list(listed)
        a = add(a, x.select("author_id", F.col("author_name").alias("author_name_latin"), F.col("author_name").alias("author_name_english")), I.LISTED, True)
        w = add(w, y, I.LISTED, False)
    if inventory is not None:
        x, y = xml.read_inventory(spark, inventory)
        a = add(a, x.select("author_id", F.col("english").alias("author_name_english"), F.coalesce("latin", "english").alias("author_name_latin")), I.CTS, True)
        w = add(w, y.select("author_id", "work_id", "title_latin", "title_english", "title_greek", "edition", "cts_urn"), I.CTS, False)
    if graph is not None:
        g = files.bindings(graph)
        a = add(a, g.select("author_id", F.col("greek").alias("author_name_greek"), "era", "viaf_id"), I.GRAPH, True)
    authors, works = I.merge_authors(a), I.merge_works(w)
    if curated is not None:
        works = I.upsert_works(works, files.overlay(curated))
    return authors, works
