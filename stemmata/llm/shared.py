"""Problem 5: long exact spans shared between records.

Method: seed and extend.  Rolling hashes of ``k`` code points are winnowed over windows of
``w`` hashes with ``k + w - 1 = min_length``, so two records that share a stretch of at
least ``min_length`` code points share an anchor inside it (about 2/(w+1) anchors per code
point).  Records are joined on anchors; every anchor two records share is a seed, which is
extended both ways on the texts as stored, from where it stands to the first difference, and
the maximal repeats of at least ``min_length`` are kept, so hash collisions never show.
Anchors of very many records are split into blocks, and every pair of blocks is a task's
group of its own; pairs leave a group as they are met.

Records with equal texts form one class first and only its smallest id takes part.

Defined cases: null, empty and shorter texts share nothing; records without id are
ignored; an empty table gives an empty result.  A stretch that a record repeats within
itself is no shared stretch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codepoints as C
from .common import as_long, class_pairs, cut, narrow, pieces, small, table

_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_inverse = np.ones(1, np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    global _inverse
    if len(_inverse) < n:
        p = np.full(max(n, 2 * len(_inverse)), np.uint64(pow(int(C._P), -1, 1 << 64)), np.uint64)
        p[0] = 1
        _inverse = np.multiply.accumulate(p)
    return _inverse


def _slide(x: np.ndarray, w: int, pick, fill) -> np.ndarray:
    """pick over x[i:i+w] for every i, by doubling; beyond the end counts as ``fill``."""
    out, have = x.copy(), 1
    while have < w:
        step = min(have, w - have)
        nxt = np.full_like(out, fill)
        nxt[:-step] = out[step:] if step < len(out) else nxt[:-step]
        out = pick(out, nxt)
        have += step
    return out


def anchor_size(min_length: int) -> int:
    """Code points of an anchor."""
    return max(1, min_length * 3 // 7)


def anchors(cp: np.ndarray, off: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowed anchors of a batch: row, position in the row, 64-bit hash of k code points."""
    k = anchor_size(min_length)
    w = min_length - k + 1
    size = np.diff(off)
    keep = size >= min_length
    if not keep.all():
        pos = np.repeat(keep, size)
        cp, off2 = C.drop(cp, off, pos)
    else:
        off2 = off
    n = len(cp)
    if n < min_length:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64)
    p = C.powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(C.tables().mixed[cp] * p[:n], out=total[1:])
    g = np.full(n, _TOP, np.uint64)
    g[: n - k + 1] = C.scramble((total[k:] - total[: n - k + 1]) * _inverse_powers(n + 1)[: n - k + 1]) >> np.uint64(1)
    row = np.repeat(np.arange(len(off2) - 1), np.diff(off2))
    left = off2[1:][row] - np.arange(n)  # code points from here to the end of the row
    g[left < k] = _TOP
    least = _slide(g, w, np.minimum, _TOP)
    least[left < min_length] = 0
    most = _slide(least[::-1], w, np.maximum, np.uint64(0))[::-1]
    at = np.flatnonzero((g == most) & (g != _TOP))
    return row[at], at - off2[row[at]], g[at]


def _seeds(min_length: int):
    def run(batches):
        for ids, _, cp, off in pieces(batches):
            row, pos, g = anchors(cp, off, min_length)
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), ids.take(pa.array(row)), pa.array(pos.astype(np.int32))], names=["seed", "id", "pos"])

    return run


#: Anchors of more places than this are split; pairs a task holds before it hands them on.
BLOCK_ROWS, HELD_PAIRS = 10_000, 500_000
_BLOCK_BITS = 31


def _meet(seed: np.ndarray, tile: np.ndarray, blk: np.ndarray, doc: np.ndarray, pos: np.ndarray):
    """Seeds (a, b, place in a, place in b) of whole groups, sorted by (seed, tile); yields bounded parts."""
    size = len(seed)
    last = np.ones(size, np.bool_)
    last[:-1] = (seed[1:] != seed[:-1]) | (tile[1:] != tile[:-1])
    ends = np.flatnonzero(last)
    end = ends[np.searchsorted(ends, np.arange(size))]
    cross = (tile >> _BLOCK_BITS) != (tile & ((1 << _BLOCK_BITS) - 1))
    i, lag, got, held = np.flatnonzero(end > np.arange(size)), 1, [], 0
    while len(i):
        i = i[i + lag <= end[i]]
        j = i + lag
        ok = (doc[i] != doc[j]) & (~cross[i] | (blk[i] != blk[j]))
        a, b = i[ok], j[ok]
        if len(a):
            swap = doc[a] > doc[b]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            got.append(np.stack([doc[a], doc[b], pos[a].astype(np.int64), pos[b].astype(np.int64)], 1))
            held += len(a)
            if held >= HELD_PAIRS:
                yield np.concatenate(got)
                got, held = [], 0
        lag += 1
    if got:
        yield np.concatenate(got)


def _matcher(k: int):
    """Seeds (a, b, shift, part, place in a), one per pair, diagonal and stretch of k code points."""

    def out(cols):
        for p in _meet(*cols):
            p[:, 3] -= p[:, 2]
            keys = np.stack([p[:, 0], p[:, 1], p[:, 3], p[:, 2] // k], 1)
            keys, first = np.unique(keys, axis=0, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1])] + [pa.array(c.astype(np.int32)) for c in (keys[:, 2], keys[:, 3], p[first, 2])], names=["a", "b", "shift", "part", "pa"])

    def run(batches):
        held: list[list[np.ndarray]] = []
        rows = 0
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if not len(cols[0]):
                continue
            held.append(cols)
            rows += len(cols[0])
            if rows < 100_000:
                continue
            whole = [np.concatenate(x) for x in zip(*held)]
            ends = np.flatnonzero((whole[0][1:] != whole[0][:-1]) | (whole[1][1:] != whole[1][:-1]))
            if not len(ends):
                held, rows = [whole], rows // 2  # one group: wait for more before looking again
                continue
            stop = int(ends[-1]) + 1
            held, rows = [[x[stop:] for x in whole]], len(whole[0]) - stop
            yield from out([x[:stop] for x in whole])
        if held:
            yield from out([np.concatenate(x) for x in zip(*held)])

    return run


def _reach(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the common start of two arrays, looked at in growing pieces."""
    n, at, step = min(len(x), len(y)), 0, 256
    while at < n:
        stop = min(n, at + step)
        differ = np.flatnonzero(x[at:stop] != y[at:stop])
        if len(differ):
            return at + int(differ[0])
        at, step = stop, step * 4
    return n


def extend(x: np.ndarray, y: np.ndarray, seeds: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """(start in x, start in y, length) of the maximal repeats that seeds (place in x, place in y) stand in.

    A seed inside a repeat already found on its diagonal is not extended again.
    """
    out, done = [], {}
    for p, q in sorted(seeds):
        if p < done.get(q - p, 0):
            continue
        ahead = _reach(x[p:], y[q:])
        back = _reach(x[:p][::-1], y[:q][::-1])
        done[q - p] = p + max(1, ahead)
        if ahead + back >= least:
            out.append((p - back, q - back, ahead + back))
    return out


def _extend(least: int):
    """Rows (a, b, seeds as two lists, x, y) to maximal repeats (a, b, start_a, start_b, length)."""

    def run(batches):
        for b in batches:
            x, xo = C.decode(b.column(4))
            y, yo = C.decode(b.column(5))
            da, db, pas, pbs = (b.column(k).to_pylist() for k in range(4))
            rows = []
            for i in range(len(da)):
                rows += [(da[i], db[i], *r) for r in extend(x[xo[i] : xo[i + 1]], y[yo[i] : yo[i + 1]], list(zip(pas[i], pbs[i])), least)]
            if rows:
                r = np.array(rows, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(r[:, k]) for k in range(5)], names=["a", "b", "start_a", "start_b", "length"])

    return run


def _in_blocks(seeds: DataFrame) -> DataFrame:
    """(seed, tile, blk, id, pos): places of hot anchors once in every pair of blocks their own stands in."""
    hot = seeds.groupBy("seed").agg(F.count("*").alias("places")).where(F.col("places") > BLOCK_ROWS)
    hot = cut(hot.select("seed", F.ceil(F.col("places") / BLOCK_ROWS).cast("int").alias("blocks")))
    rows = hot.count()
    zero = F.lit(0).cast("long")
    if not rows:
        return seeds.select("seed", zero.alias("tile"), F.lit(0).alias("blk"), "id", "pos")
    both = seeds.join(small(hot, rows), "seed", "left").withColumn("blk", F.coalesce(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.lit(0)))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    both = both.withColumn("other", other)
    tile = F.shiftleft(F.least("blk", "other").cast("long"), _BLOCK_BITS).bitwiseOR(F.greatest("blk", "other").cast("long"))
    return both.select("seed", tile.alias("tile"), "blk", "id", "pos")


class SharedSpans:
    """Maximal repeats between records of different texts, and the classes of equal texts."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, min_length: int = 150):
        src = narrow(df, id_col, text_col).where(F.col("id").isNotNull() & (F.length("text") >= min_length))
        #: (id, size in code points, hash) of records long enough
        self.sizes = src.select("id", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("same"))
        classes = self.sizes.groupBy("same").agg(F.min("id").alias("rep"), F.countDistinct("id").alias("size")).where("size > 1")
        #: (rep, id, size, chars) of the classes of two or more records
        self.members = cut(self.sizes.join(classes, "same").select("rep", "id", "size", "chars").distinct())
        spare = self.members.where("id <> rep").select("id")
        first = src.join(small(spare, spare.count()), "id", "left_anti")
        seeds = cut(first.mapInArrow(_seeds(min_length), "seed long, id long, pos int"))
        seeds = _in_blocks(seeds).repartition("seed", "tile").sortWithinPartitions("seed", "tile", "id")
        met = seeds.mapInArrow(_matcher(anchor_size(min_length)), "a long, b long, shift int, part int, pa int")
        # anchors of a diagonal less than their own length apart overlap, so they stand in one repeat
        met = met.groupBy("a", "b", "shift", "part").agg(F.min("pa").alias("pa"))
        met = cut(met.groupBy("a", "b").agg(F.collect_list("pa").alias("pas"), F.collect_list(F.col("pa") + F.col("shift")).alias("pbs")))
        ends = met.select(F.explode(F.array("a", "b")).alias("id"), "a", "b", "pas", "pbs")
        need = ends.select("id").distinct()
        texts = src.join(small(need, met.count() * 2), "id", "left_semi")
        pairs = ends.join(texts, "id").groupBy("a", "b").agg(
            F.first("pas").alias("pas"), F.first("pbs").alias("pbs"), F.min_by("text", "id").alias("x"), F.max_by("text", "id").alias("y")
        )
        #: (a, b, start_a, start_b, length): maximal repeats between class representatives
        self.repeats = pairs.select("a", "b", "pas", "pbs", "x", "y").mapInArrow(
            _extend(min_length), "a long, b long, start_a long, start_b long, length long"
        )

    def pairs(self) -> DataFrame:
        """(a, b), a < b, of records; classes of over 100 equal texts in the star form of ``class_pairs``."""
        return class_pairs(self.repeats.select("a", "b").distinct(), self.members.select("rep", "id", "size"))

    def coverage(self) -> DataFrame:
        """(id, chars, shared_chars): code points of each record that stand in a stretch shared elsewhere."""
        r = self.repeats
        spans = r.select(F.col("a").alias("rep"), F.col("start_a").alias("s"), (F.col("start_a") + F.col("length")).alias("e")).unionByName(
            r.select(F.col("b").alias("rep"), F.col("start_b").alias("s"), (F.col("start_b") + F.col("length")).alias("e"))
        ).distinct()
        # union of intervals: each start adds what lies beyond the furthest end before it
        per = spans.groupBy("rep", "s").agg(F.max("e").alias("e"))
        listed = per.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("l"))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("e"))
        total = F.aggregate(
            "l", start,
            lambda acc, x: F.struct(
                (acc["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(acc["e"], x["s"]))).alias("n"),
                F.greatest(acc["e"], x["e"]).alias("e"),
            ),
        )["n"]
        covered = listed.select("rep", total.alias("shared"))
        # every copy of a text that stands in two or more records is shared whole
        ids = self.sizes.select("id", "chars").distinct()
        whole = self.members.select("id", F.lit(True).alias("whole")).distinct()
        return (
            ids.join(whole, "id", "left").join(covered.withColumnRenamed("rep", "id"), "id", "left")
            .select("id", "chars", F.when(F.col("whole"), F.col("chars").cast("long")).otherwise(F.coalesce("shared", F.lit(0).cast("long"))).alias("shared_chars"))
        )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    s = SharedSpans(table(spark, folder, "sections"), "section_id", "text")
    return s.pairs().select(F.col("a").alias("section_id_a"), F.col("b").alias("section_id_b"))


def p5_shared(spark: SparkSession, folder: str) -> DataFrame:
    """(section_id, n_chars, shared_chars, shared_share): every section; short ones share nothing."""
    src = table(spark, folder, "sections")
    got = SharedSpans(src, "section_id", "text").coverage().select(F.col("id").alias("section_id"), "shared_chars")
    n = F.coalesce(F.length("text"), F.lit(0))
    rows = src.where("section_id is not null").select("section_id", n.alias("n_chars"))
    shared = F.coalesce("shared_chars", F.lit(0).cast("long"))
    return rows.join(got, "section_id", "left").select(
        "section_id", "n_chars", shared.alias("shared_chars"),
        F.round(F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(0.0), 6).alias("shared_share"),
    )


QUERIES = {"p5_found": p5_found, "p5_shared": p5_shared}
