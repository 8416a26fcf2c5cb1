"""Problem 2: best representative of each duplicate group, field by field.

Method: field-by-field survivorship.  Records get the key of their group, and one
aggregation takes, for each attribute, the maximum of a composite struct
(counts, source priority, timestamp, smallest id), so every field is decided in the same
shuffle and hot groups are combined before it.

Keys: the number however written; without a number, the second identifier (tied to the
number that other records give for it, else standing for itself); with neither, the record
stands alone.

Defined cases: null, blank, stand-in and cut-short values don't count; no value, no row;
ties go to the smallest record id; unknown source tags rank last; a null timestamp is older
than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# What stands for "no value" once case, blanks and brackets are gone.
STAND_INS = ("0", "?", "??", "???", "-", "--", "–", "—", "n/a", "na", "nil", "nan", "none", "null", "tba", "tbd", "unknown", "vacat", "sine nomine", "sine titulo", "s.n.", "s.t.", "xxx")
LAST_TIER = 1_000_000


def number(col: Column, width: int) -> Column:
    """The digits of an identifier, zero-filled to the width; null without digits."""
    digits = F.regexp_replace(F.regexp_extract(F.coalesce(col, F.lit("")), r"([0-9]+)", 1), "^0+(?=[0-9])", "")
    filled = F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)
    return F.when(digits == "", None).otherwise(filled)


def counts_as_value(col: Column) -> Column:
    """Neither null nor blank, a stand-in, or visibly cut short (an ellipsis at the end)."""
    text = F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), r"[\s ]+", " "))
    bare = F.lower(F.trim(F.regexp_replace(text, r"[\[\]()<>{}]", "")))
    return (bare != "") & ~bare.isin(*STAND_INS) & text.rlike(r"[\p{L}\p{N}]") & ~text.rlike(r"(…|\.\.+)[\])}]?$")


def tiers(spark: SparkSession, folder: str) -> Column:
    """The tier of a tag as a literal map; the table of tags is fixed and its size is checked."""
    rows = table(spark, folder, "source_tiers").where("source is not null and tier is not null").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("source_tiers: more tags than fit a literal map")
    if not rows:
        return F.create_map(F.lit(""), F.lit(LAST_TIER))
    return F.create_map(*[x for r in rows for x in (F.lit(r.source), F.lit(int(r.tier)))])


def survivors(df: DataFrame, key: str, record: str, tier: str, seen: str, fields: dict[str, Column]) -> DataFrame:
    """(key, records, field_name, record_id): the record whose value survives, per group and field.

    ``fields`` gives, for each field, the condition under which its value counts.
    """
    best = [
        F.max(F.when(ok, F.struct((-F.col(tier)).alias("t"), F.col(seen).alias("s"), (-F.col(record)).alias("r")))).alias(f"f{i}")
        for i, ok in enumerate(fields.values())
    ]
    got = df.groupBy(key).agg(F.count("*").alias("records"), *best)
    listed = F.array(*[F.struct(F.lit(name).alias("field_name"), (-F.col(f"f{i}")["r"]).alias("record_id"), F.col(f"f{i}").isNotNull().alias("ok")) for i, name in enumerate(fields)])
    return got.select(key, "records", F.explode(listed).alias("x")).where("x.ok").select(key, "records", "x.field_name", "x.record_id")


def author_keys(canon: DataFrame) -> DataFrame:
    """canon with ``key``: records of one author share it."""
    viaf = F.regexp_extract(F.coalesce(F.col("viaf_id"), F.lit("")), r"([0-9]+)\D*$", 1)
    base = canon.withColumn("number", number(F.col("author_id"), 4)).withColumn("viaf", F.when(viaf == "", None).otherwise(viaf))
    known = base.where("number is not null and viaf is not null").groupBy("viaf").agg(F.min("number").alias("known"))
    own = F.concat(F.lit("record "), F.coalesce(F.col("record_id").cast("string"), F.lit("")))
    numbered = base.where("number is not null").withColumn("known", F.lit(None).cast("string"))
    by_viaf = base.where("number is null and viaf is not null").join(known, "viaf", "left").select(*numbered.columns)
    alone = base.where("number is null and viaf is null").withColumn("known", F.lit(None).cast("string"))
    key = F.coalesce("number", "known", F.concat(F.lit("viaf "), F.col("viaf")), own)
    return numbered.unionByName(by_viaf).unionByName(alone).withColumn("key", key)


def work_keys(works: DataFrame) -> DataFrame:
    """works with ``author``, ``work`` (null if unknown) and ``key``: records of one work share it."""
    urn = F.coalesce(F.col("cts_urn"), F.lit(""))
    a, w = number(F.col("author_id"), 4), number(F.col("work_id"), 3)
    there = a.isNotNull() & w.isNotNull()
    ua = number(F.regexp_extract(urn, r"tlg([0-9]+)\.tlg[0-9]+", 1), 4)
    uw = number(F.regexp_extract(urn, r"tlg[0-9]+\.tlg([0-9]+)", 1), 3)
    own = F.concat(F.lit("record "), F.coalesce(F.col("record_id").cast("string"), F.lit("")))
    return (
        works.withColumn("author", F.when(there, a).otherwise(ua)).withColumn("work", F.when(there, w).otherwise(uw))
        .withColumn("key", F.coalesce(F.concat_ws(".", F.when(F.col("author").isNotNull() & F.col("work").isNotNull(), F.col("author")), F.when(F.col("author").isNotNull() & F.col("work").isNotNull(), F.col("work"))), F.lit("")))
        .withColumn("key", F.when(F.col("key") == "", own).otherwise(F.col("key")))
    )


def _canon(spark: SparkSession, folder: str) -> DataFrame:
    ranks = tiers(spark, folder)
    rank = F.array_min(F.transform(F.coalesce(F.col("source"), F.array().cast("array<string>")), lambda s: F.coalesce(F.element_at(ranks, s), F.lit(LAST_TIER))))
    df = author_keys(table(spark, folder, "canon")).withColumn("rank", F.coalesce(rank, F.lit(LAST_TIER)))
    return survivors(df, "key", "record_id", "rank", "seen_at", {f: counts_as_value(F.col(f)) for f in ("author_name_latin", "author_name_english")})


def _works(spark: SparkSession, folder: str) -> DataFrame:
    ranks = tiers(spark, folder)
    df = work_keys(table(spark, folder, "works")).withColumn("rank", F.coalesce(F.element_at(ranks, F.coalesce(F.col("source"), F.lit(""))), F.lit(LAST_TIER)))
    exact = F.col("cts_urn") == F.concat(F.lit("urn:cts:greekLit:tlg"), F.col("author"), F.lit(".tlg"), F.col("work"))
    return survivors(df, "key", "record_id", "rank", "seen_at", {"title_latin": counts_as_value(F.col("title_latin")), "cts_urn": F.coalesce(exact, F.lit(False))})


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    both = _canon(spark, folder).unionByName(_works(spark, folder))
    return both.where("records >= 2").select("field_name", "record_id")


def p2_records(spark: SparkSession, folder: str) -> DataFrame:
    """(field_name, key, records, record_id): the surviving record of every group, single records too."""
    return _canon(spark, folder).unionByName(_works(spark, folder)).select("field_name", "key", "records", "record_id")


_KEYED = r"""
with tiers as (select source, min(tier) tier from source_tiers group by source),
c0 as (select *, nullif(regexp_replace(regexp_extract(coalesce(author_id, ''), '([0-9]+)', 1), '^0+([0-9])', '\1'), '') d,
  nullif(regexp_extract(coalesce(viaf_id, ''), '([0-9]+)', 1), '') v from canon),
c1 as (select *, case when length(d) < 4 then lpad(d, 4, '0') else d end num from c0),
known as (select v, min(num) num from c1 where num is not null and v is not null group by v),
c2 as (select c1.*, coalesce(c1.num, known.num, 'viaf ' || c1.v, 'record ' || record_id) as key,
  coalesce((select min(coalesce(t.tier, 1000000)) from unnest(c1.source) u(s) left join tiers t on t.source = u.s), 1000000) as rank
  from c1 left join known on c1.v = known.v),
w0 as (select *, nullif(regexp_extract(coalesce(author_id, ''), '([0-9]+)', 1), '') a0, nullif(regexp_extract(coalesce(work_id, ''), '([0-9]+)', 1), '') w0,
  nullif(regexp_extract(coalesce(cts_urn, ''), 'tlg([0-9]+)\.tlg[0-9]+', 1), '') ua, nullif(regexp_extract(coalesce(cts_urn, ''), 'tlg[0-9]+\.tlg([0-9]+)', 1), '') uw from works),
w1 as (select *, case when a0 is not null and w0 is not null then a0 else ua end x, case when a0 is not null and w0 is not null then w0 else uw end y from w0),
w2 as (select w1.*, case when length(x) < 4 then lpad(x, 4, '0') else x end au, case when length(y) < 3 then lpad(y, 3, '0') else y end wk, coalesce(tiers.tier, 1000000) as rank
  from w1 left join tiers on tiers.source = w1.source),
w3 as (select *, coalesce(au || '.' || wk, 'record ' || record_id) as key from w2),
vals as (
  select 'author_name_latin' field_name, key, record_id, rank, seen_at, author_name_latin val from c2
  union all select 'author_name_english', key, record_id, rank, seen_at, author_name_english from c2
  union all select 'title_latin', key, record_id, rank, seen_at, title_latin from w3),
good as (
  select field_name, key, record_id, rank, seen_at from vals
  where trim(coalesce(val, '')) <> '' and not regexp_matches(trim(val), '(…|\.\.+)[\])}]?$') and regexp_matches(val, '[\p{L}\p{N}]')
    and lower(trim(regexp_replace(trim(val), '[\[\]()<>{}]', '', 'g'))) not in ('0','n/a','na','nil','nan','none','null','tba','tbd','unknown','vacat','sine nomine','sine titulo','s.n.','s.t.','xxx')
  union all select 'cts_urn', key, record_id, rank, seen_at from w3 where cts_urn = 'urn:cts:greekLit:tlg' || au || '.tlg' || wk),
sizes as (select 'c' tbl, key, count(*) records from c2 group by key union all select 'w', key, count(*) from w3 group by key),
best as (select *, row_number() over (partition by field_name, key order by rank, seen_at desc nulls last, record_id) rn from good)
"""
_TBL = "case when field_name like 'author%' then 'c' else 'w' end"
SQL = {
    "p2_found": _KEYED + f"select field_name, record_id from best join sizes on sizes.key = best.key and sizes.tbl = {_TBL} where rn = 1 and records >= 2",
    "p2_records": _KEYED + f"select field_name, best.key as key, records, record_id from best join sizes on sizes.key = best.key and sizes.tbl = {_TBL} where rn = 1",
}
QUERIES = {"p2_found": p2_found, "p2_records": p2_records}
