"""Problem 1: near-duplicate records with small edits.

Two records belong together when the terms they have in common (counted with repeats, in
any order) are at least a share ``similarity`` of the number of terms of the longer one.

Method: size-banded tiles with hashed bitmap signatures.

1. Every occurrence of a term is an element of its own: (term, 1st), (term, 2nd), ...
   Elements have one global order, rarest first, by a fixed-size sketch of frequencies
   (2^20 counters over all rows, so its size never depends on the data).
2. If two records share the required number ``t`` of elements, they share at least ``m`` of
   those that are among the rarest ``n - t + m`` of both.  A record goes into one tile for
   each of these; an element the sketch has counted once needs none.  A pair is looked at
   further only if it is met in ``m`` tiles (``MEETINGS``).
3. A tile is keyed by the element and a band of sizes (each four times as wide as the one
   before).  A record close enough to the next band to have a partner there is a guest of
   its tile as well; two guests meet at home only.  In a tile records are sorted by size and
   meet only sizes within the similarity.  The place of the element and the bit count of the
   two 256-bit signatures bound the overlap from above; survivors are checked by an exact
   intersection of their sorted element arrays.
4. Tiles of frequent elements are split into blocks of bounded size and every pair of
   blocks is a tile, so no tile outgrows a task; pairs leave a tile as they are met.

Records with the same terms form one class first and only its smallest id takes part.

Defined cases: null, empty and short texts (under ``min_terms``) are in no pair; records
without id are ignored; a repeated id is never paired with itself; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codepoints as C
from .common import as_long, class_pairs, cut, narrow, pieces, ratio, small, table

SKETCH_BITS = 20
SIGNATURE_BITS, OWN_BITS = 256, 64
BLOCK_ROWS = 20_000
#: Pairs a task holds before it hands them on.
HELD_PAIRS = 1_000_000
MEETINGS = 3
_BLOCK_BITS, _BAND_AT = 28, 56
_STEP = np.uint64(0xA24BAED4963EE407)


def _elements(t: C.Terms, rows: int):
    """Elements of a batch as (row, 64-bit hash), sorted by row; and sizes of the rows."""
    order = np.lexsort((t.hash, t.row))
    h, r = t.hash[order], t.row[order]
    n = len(h)
    new = np.ones(n, np.bool_)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    nth = (np.arange(n) - start).astype(np.uint64)
    return r, C.scramble(h + nth * _STEP), np.bincount(r, minlength=rows)


_FIRST = "id long, n int, m1 long, m2 long, bucket int, hits long"


def _survey(min_terms: int):
    """One row per record of enough terms (size, two sums of element hashes), then sketch counters."""

    def run(batches):
        counters = np.zeros(1 << SKETCH_BITS, np.int64)
        for ids, _, cp, off in pieces(batches):
            t = C.Terms(cp, off)
            rows = len(off) - 1
            r, e, n = _elements(t, rows)
            ok = n >= min_terms
            if not ok.any():
                continue
            keep = ok[r]
            counters += np.bincount((e[keep] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
            at = np.cumsum(n) - n
            pick = np.flatnonzero(ok)
            m1 = np.add.reduceat(e, at[pick]) if len(pick) == rows else np.array([e[a : a + k].sum(dtype=np.uint64) for a, k in zip(at[pick].tolist(), n[pick].tolist())], np.uint64)
            e2 = C.scramble(e ^ _STEP)
            m2 = np.add.reduceat(e2, at[pick]) if len(pick) == rows else np.array([e2[a : a + k].sum(dtype=np.uint64) for a, k in zip(at[pick].tolist(), n[pick].tolist())], np.uint64)
            k = len(pick)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(pick)), pa.array(n[pick].astype(np.int32)), pa.array(m1.view(np.int64)), pa.array(m2.view(np.int64)), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64())],
                names=["id", "n", "m1", "m2", "bucket", "hits"],
            )
        met = np.flatnonzero(counters)
        if len(met):
            z = len(met)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(z, pa.int64()), pa.nulls(z, pa.int32()), pa.nulls(z, pa.int64()), pa.nulls(z, pa.int64()), pa.array(met.astype(np.int32)), pa.array(counters[met])],
                names=["id", "n", "m1", "m2", "bucket", "hits"],
            )

    return run


class Order:
    """The global order of elements: a level per sketch counter, and own bits of the most frequent."""

    def __init__(self, bucket: np.ndarray, hits: np.ndarray):
        full = np.zeros(1 << SKETCH_BITS, np.int64)
        full[bucket] = hits
        self.level = np.minimum(255, np.floor(8 * np.log2(np.maximum(full, 1)))).astype(np.uint8)
        self.own = np.zeros(1 << SKETCH_BITS, np.uint8)
        top = np.argsort(-full, kind="stable")[:OWN_BITS]
        top = top[full[top] > 0]
        self.own[top] = np.arange(1, len(top) + 1)
        self.blocks = np.minimum(-(-full // BLOCK_ROWS), (1 << _BLOCK_BITS) - 1).astype(np.int32)  # 0 or 1: one tile
        self.single = full <= 1

    def keys(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b = (e >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
        return (self.level[b].astype(np.uint64) << np.uint64(56)) | (e >> np.uint64(8)), b


_TILE = "key long, tile long, blk int, id long, n int, pos int, s0 long, s1 long, s2 long, s3 long"


def size_band(n: np.ndarray) -> np.ndarray:
    """0 for 1 to 3, 1 for 4 to 15, 2 for 16 to 63, ..."""
    return np.searchsorted(4 ** np.arange(1, 31, dtype=np.int64), n.astype(np.int64), "right")


def _sorted_elements(t: C.Terms, rows: int, min_terms: int, order: Order):
    r, e, n = _elements(t, rows)
    keep = n[r] >= min_terms
    r, e = r[keep], e[keep]
    key, b = order.keys(e)
    o = np.lexsort((key, r))
    r, key, b = r[o], key[o], b[o]
    n = np.where(n >= min_terms, n, 0)
    place = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
    return r, key, b, n, place


def _tiles(min_terms: int, num: int, den: int, meetings: int, shared):
    def run(batches):
        order = shared.value
        for ids, _, cp, off in pieces(batches):
            t = C.Terms(cp, off)
            rows = len(off) - 1
            r, key, b, n, place = _sorted_elements(t, rows, min_terms, order)
            if not len(r):
                continue
            bits = np.zeros((rows, SIGNATURE_BITS), np.bool_)
            own = order.own[b]
            light = OWN_BITS + (key * np.uint64(0xD1342543DE82EF95) >> np.uint64(32)) % np.uint64(SIGNATURE_BITS - OWN_BITS)
            bits[r, np.where(own > 0, own.astype(np.int64) - 1, light.astype(np.int64))] = True
            sig = np.packbits(bits, axis=1).view(np.int64).reshape(rows, SIGNATURE_BITS // 64)
            need = -(-n * num // den)
            at = np.flatnonzero((place < (n - need + meetings)[r]) & ~order.single[b])
            if not len(at):
                continue
            doc = as_long(ids)
            nb = np.maximum(order.blocks[b[at]].astype(np.int64), 1)
            mine = (C.scramble(doc.view(np.uint64))[r[at]] % nb.astype(np.uint64)).astype(np.int64)
            rep = np.repeat(np.arange(len(at)), nb)
            other = np.arange(len(rep)) - np.repeat(np.cumsum(nb) - nb, nb)
            mine, at = mine[rep], at[rep]
            row = r[at]
            band = size_band(n[row])
            guest = np.flatnonzero(n[row].astype(np.int64) * den >= 4 ** (band + 1) * num)
            tile = (np.minimum(mine, other) << _BLOCK_BITS) | np.maximum(mine, other) | (band << _BAND_AT)
            tile = np.concatenate([tile, tile[guest] + (1 << _BAND_AT)])
            at, row, mine = (np.concatenate([x, x[guest]]) for x in (at, row, mine))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[at].view(np.int64)), pa.array(tile), pa.array(mine.astype(np.int32)), pa.array(doc[row]), pa.array(n[row].astype(np.int32)), pa.array(place[at].astype(np.int32))]
                + [pa.array(sig[row, k]) for k in range(4)],
                names=["key", "tile", "blk", "id", "n", "pos", "s0", "s1", "s2", "s3"],
            )

    return run


def _meet(cols: list[np.ndarray], num: int, den: int, meetings: int):
    """Pairs of one run of whole tiles, sorted by (key, tile, n), that may reach the overlap; and how often they met.

    Yields (pairs, times met) as often as many have come together; the times of a pair add up.
    """
    key, tile, blk, doc, n, pos, *sig = cols
    size = len(key)
    last = np.ones(size, np.bool_)
    last[:-1] = (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])
    ends = np.flatnonzero(last)
    end = ends[np.searchsorted(ends, np.arange(size))]
    mask = (1 << _BLOCK_BITS) - 1
    cross = ((tile >> _BLOCK_BITS) & mask) != (tile & mask)
    guest = size_band(n) != (tile >> _BAND_AT)
    left = n.astype(np.int64) - pos
    i = np.flatnonzero(end > np.arange(size))
    lag, got, held = 1, [], 0

    def out():
        pairs, met = np.unique(np.concatenate(got), axis=0, return_counts=True)
        ok = pairs[:, 0] < pairs[:, 1]
        return pairs[ok], met[ok]

    while len(i):
        j = i + lag
        i = i[(j <= end[i]) & (n[i].astype(np.int64) * den >= n[np.minimum(j, size - 1)].astype(np.int64) * num)]
        if not len(i):
            break
        j = i + lag
        need = -(-n[j].astype(np.int64) * num // den)
        ok = (np.minimum(left[i], left[j]) > need - meetings) & ~(guest[i] & guest[j])
        if cross[i].any():
            ok &= ~cross[i] | (blk[i] != blk[j])
        a, b, need = i[ok], j[ok], need[ok]
        if len(a):
            apart = np.zeros(len(a), np.int64)
            for s in sig:
                apart += np.bitwise_count((s[a] ^ s[b]).view(np.uint64))
            ok = (n[a].astype(np.int64) + n[b] - apart) >= 2 * need
            a, b = a[ok], b[ok]
            if len(a):
                got.append(np.stack([np.minimum(doc[a], doc[b]), np.maximum(doc[a], doc[b])], 1))
                held += len(a)
                if held >= HELD_PAIRS:
                    yield out()
                    got, held = [], 0
        lag += 1
    if got:
        yield out()


def _matcher(num: int, den: int, meetings: int):
    def run(batches):
        held: list[list[np.ndarray]] = []
        rows = 0

        def flush(cols):
            for p, met in _meet(cols, num, den, meetings):
                if len(met):
                    yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(met.astype(np.int64))], names=["a", "b", "met"])

        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if not len(cols[0]):
                continue
            held.append(cols)
            rows += len(cols[0])
            ends = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))
            if rows < 50_000 or (not len(ends) and len(held) > 1 and held[-2][0][-1] == cols[0][0]):
                continue
            whole = [np.concatenate(x) for x in zip(*held)]
            ends = np.flatnonzero((whole[0][1:] != whole[0][:-1]) | (whole[1][1:] != whole[1][:-1]))
            if not len(ends):
                held = [whole]
                continue
            stop = int(ends[-1]) + 1
            held, rows = [[x[stop:] for x in whole]], len(whole[0]) - stop
            yield from flush([x[:stop] for x in whole])
        if held:
            yield from flush([np.concatenate(x) for x in zip(*held)])

    return run


def _arrays(min_terms: int, shared):
    def run(batches):
        order = shared.value
        for ids, _, cp, off in pieces(batches):
            t = C.Terms(cp, off)
            rows = len(off) - 1
            r, key, _, n, _ = _sorted_elements(t, rows, min_terms, order)
            pick = np.flatnonzero(n)
            if not len(pick):
                continue
            ends = np.zeros(len(pick) + 1, np.int32)
            np.cumsum(n[pick], out=ends[1:])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(pick)), pa.ListArray.from_arrays(pa.array(ends), pa.array(key.view(np.int64)))], names=["id", "elements"])

    return run


def _overlap(num: int, den: int):
    """Rows (a, b, x, y) with sorted element arrays to (a, b, common, longer) of those that reach the similarity."""

    def run(batches):
        for b in batches:
            x, y = b.column(2), b.column(3)
            sizes = [np.diff(c.offsets.to_numpy()) for c in (x, y)]
            pair = np.concatenate([np.repeat(np.arange(len(k)), k) for k in sizes])
            element = np.concatenate([c.flatten().to_numpy(zero_copy_only=False).view(np.uint64) for c in (x, y)])
            order = np.lexsort((element, pair))  # merges the two sorted arrays of each pair
            pair, element = pair[order], element[order]
            twice = (pair[1:] == pair[:-1]) & (element[1:] == element[:-1])
            common = np.bincount(pair[1:][twice], minlength=b.num_rows).astype(np.int64)
            longer = np.maximum(*sizes).astype(np.int64)
            ok = pa.array(common * den >= longer * num)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok), pa.array(common).filter(ok), pa.array(longer).filter(ok)], names=["a", "b", "common", "longer"])

    return run


def _copies(members: DataFrame, src: DataFrame, most: int = 100) -> DataFrame:
    """members with (copy, copies): the smallest id of the same text in the class, and its rows.

    Only classes of over ``most`` rows need their texts; in others all rows are paired.
    """
    alike = members.withColumn("copy", F.col("rep")).withColumn("copies", F.col("size"))
    large = members.where(F.col("size") > most)
    rows = large.count()
    if not rows:
        return alike
    texts = src.join(small(large.select("id").distinct(), rows), "id", "left_semi").select("id", F.sha2("text", 256).alias("sha")).distinct()
    texts = large.join(texts, "id")
    groups = texts.groupBy("rep", "sha").agg(F.min("id").alias("copy"), F.count("*").alias("copies"))
    return cut(alike.where(F.col("size") <= most).unionByName(texts.join(groups, ["rep", "sha"]).select(*alike.columns)))


class NearDuplicates:
    """Links between classes of records with the same terms, and the members of the classes."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, similarity: float = 0.7, min_terms: int = 20):
        spark = df.sparkSession
        num, den = ratio(similarity)
        meetings = min(MEETINGS, max(1, -(-min_terms * num // den)))
        src = narrow(df, id_col, text_col).where("id is not null and text is not null")
        seen = cut(src.mapInArrow(_survey(min_terms), _FIRST))
        counts = seen.where("bucket is not null").groupBy("bucket").agg(F.sum("hits").alias("hits")).toArrow()  # at most 2^20 rows
        order = Order(counts["bucket"].to_numpy(), counts["hits"].to_numpy())
        shared = spark.sparkContext.broadcast(order)
        self.sizes = seen.where("id is not null").select("id", "n", "m1", "m2")
        group = ["n", "m1", "m2"]
        classes = self.sizes.groupBy(*group).agg(F.min("id").alias("rep"), F.count("*").alias("size")).where("size > 1")
        #: (rep, id, size, copy, copies) of the classes of two or more records
        self.members = _copies(cut(self.sizes.join(classes, group).select("rep", "id", "size").distinct()), src)
        spare = self.members.where("id <> rep").select("id").distinct()
        first = src.join(small(spare, spare.count()), "id", "left_anti")
        tiles = first.mapInArrow(_tiles(min_terms, num, den, meetings, shared), _TILE).repartition("key", "tile").sortWithinPartitions("key", "tile", "n")
        maybe = tiles.mapInArrow(_matcher(num, den, meetings), "a long, b long, met long").groupBy("a", "b").agg(F.sum("met").alias("met"))
        #: (a, b): pairs that passed the bounds in enough tiles
        self.candidates = maybe = cut(maybe.where(F.col("met") >= meetings).select("a", "b"))
        ends = maybe.select(F.explode(F.array("a", "b")).alias("id"), "a", "b")
        # only texts of candidates are cut into elements again
        some = src.join(small(ends.select("id").distinct(), maybe.count() * 2), "id", "left_semi").select("id", "text")
        full = some.mapInArrow(_arrays(min_terms, shared), "id long, elements array<long>")
        # both arrays of a pair meet in one group of two rows
        met = ends.join(full, "id").groupBy("a", "b").agg(F.max_by("elements", "id").alias("x"), F.min_by("elements", "id").alias("y"))
        #: (a, b, common, longer): links between representatives of different classes; longer is the larger size
        self.links = met.mapInArrow(_overlap(num, den), "a long, b long, common long, longer long")

    def pairs(self) -> DataFrame:
        """(a, b), a < b, of records; over 100 records of equal text in the star form of ``class_pairs``."""
        return class_pairs(self.links.select("a", "b"), self.members)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    nd = NearDuplicates(table(spark, folder, "sections"), "section_id", "text")
    return nd.pairs().select(F.col("a").alias("section_id_a"), F.col("b").alias("section_id_b"))


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    """(section_id, class_id, links): the class of rows with the same terms, and its links to other classes."""
    nd = NearDuplicates(table(spark, folder, "sections"), "section_id", "text")
    both = nd.links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    ids = nd.sizes.select(F.col("id").alias("section_id")).distinct()
    cls = ids.join(nd.members.select(F.col("id").alias("section_id"), "rep").distinct(), "section_id", "left").select("section_id", F.coalesce("rep", "section_id").alias("class_id"))
    return cls.join(both, "class_id", "left").select("section_id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


QUERIES = {"p1_found": p1_found, "p1_classes": p1_classes}
