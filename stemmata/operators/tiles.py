"""Pairs of units met in tiles: a bounded block of left units against a bounded block of right units.

Counting what pairs of units have in common by a plain join emits one row per pair and common
key and shuffles all of them.  Here every key is shipped only to the tiles where both sides
have it, and pairs are counted inside a tile, so nothing per pair is shuffled and a frequent
key costs a tile its units, not their product.  A tile holds at most about ``BLOCK_UNITS``
units of each side, whatever the size of the collection; keys on one side only never travel.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Units of a block, about; blocks of a side at least, so that small inputs use all cores.
BLOCK_UNITS, LEAST_BLOCKS = 4096, 6
#: Cells of a strip of the count matrix, joined rows looked at together, rows of an output batch.
CELLS, JOINED, OUT_ROWS = 4_000_000, 2_000_000, 100_000


def blocks(units: int) -> int:
    return max(LEAST_BLOCKS, ceil(units / BLOCK_UNITS))


def block_of(unit: str, n: int) -> Column:
    return F.pmod(F.xxhash64(unit), F.lit(n)).cast("int")


def _by_tile(df: DataFrame, tiles: int, *order: str) -> DataFrame:
    """Rows (lb, rb, ...) with whole tiles in tasks, in the given order.

    The number of tasks is given, as the optimiser would join small ones by their bytes and
    leave cores idle, while a tile's work is in its pairs.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(tiles, 4 * spark.sparkContext.defaultParallelism))
    return df.repartition(tasks, "lb", "rb").sortWithinPartitions("lb", "rb", *order)


def _tiles(batches):
    """Columns of whole tiles from batches sorted by their first two columns."""
    held: list[pa.RecordBatch] = []
    last = None

    def whole():
        return [c.combine_chunks() for c in pa.Table.from_batches(held).columns]

    for b in batches:
        if not b.num_rows:
            continue
        x, y = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        edges = np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
        for at, stop in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows]):
            tile = (x[at], y[at])
            if held and tile != last:
                yield whole()
                held = []
            held.append(b.slice(at, stop - at))
            last = tile
    if held:
        yield whole()


def _sum(left_unit, left_key, left_w, right_unit, right_key, right_w, least: int):
    """(i, j, shared, dot) of pairs with at least ``least`` keys in common; right rows are sorted by key."""
    lu, li = np.unique(left_unit, return_inverse=True)
    ru, rj = np.unique(right_unit, return_inverse=True)
    nr = len(ru)
    order = np.argsort(li, kind="stable")
    li, left_key, left_w = li[order], left_key[order], left_w[order]
    start = np.searchsorted(right_key, left_key, "left")
    n = np.searchsorted(right_key, left_key, "right") - start
    upto = np.concatenate([[0], np.cumsum(n)])
    strip = max(1, CELLS // max(1, nr))
    for a in range(0, len(lu), strip):
        lo, hi = np.searchsorted(li, [a, a + strip])
        total = int(upto[hi] - upto[lo])
        if not total:
            continue
        size = min(strip, len(lu) - a) * nr
        sparse = total * 8 < size and total <= JOINED
        if not sparse:
            count, dot = np.zeros(size, np.int32), np.zeros(size)
        at = lo
        while at < hi:  # joined rows of a strip come in parts
            to = min(hi, max(at + 1, int(np.searchsorted(upto, upto[at] + JOINED, "right")) - 1))
            k = n[at:to]
            rep = np.repeat(np.arange(at, to), k)
            pos = np.arange(int(upto[to] - upto[at])) + np.repeat(start[at:to] - (upto[at:to] - upto[at]), k)
            cell = (li[rep] - a) * nr + rj[pos]
            w = left_w[rep] * right_w[pos]
            if sparse:
                hit, back = np.unique(cell, return_inverse=True)
                c, d = np.bincount(back, minlength=len(hit)), np.bincount(back, w, len(hit))
            else:
                count += np.bincount(cell, minlength=size).astype(np.int32)
                dot += np.bincount(cell, w, size)
            at = to
        if not sparse:
            hit = np.flatnonzero(count >= least)
            c, d = count[hit], dot[hit]
        else:
            ok = c >= least
            hit, c, d = hit[ok], c[ok], d[ok]
        for s in range(0, len(hit), OUT_ROWS):
            h = hit[s : s + OUT_ROWS]
            yield pa.RecordBatch.from_arrays(
                [pa.array(lu[a + h // nr]), pa.array(ru[h % nr]), pa.array(c[s : s + OUT_ROWS].astype(np.int64)), pa.array(d[s : s + OUT_ROWS])], names=["i", "j", "shared", "dot"])


def _counter(least: int):
    def run(batches):
        for _, _, key, side, unit, w in _tiles(batches):
            key, side, unit, w = (c.to_numpy(zero_copy_only=False) for c in (key, side, unit, w))
            a, b = side == 1, side == 2
            yield from _sum(unit[a], key[a], w[a], unit[b], key[b], w[b], least)

    return run


def in_common(left: DataFrame, right: DataFrame, units: tuple[int, int], least: int = 1, most: int | None = None) -> DataFrame:
    """(i, j, shared, dot) of all pairs of a left and a right unit with at least ``least`` common keys.

    ``left``: (i, key, w), ``right``: (j, key, w) with long keys, each once per unit; ``dot`` is
    the sum of the products of the weights.  Keys of more than ``most`` right units do not
    count.  ``units``: numbers of units of both sides.
    """
    nl, nr = map(blocks, units)
    both = left.select("key", F.lit(1).alias("side"), F.col("i").alias("unit"), "w").unionByName(right.select("key", F.lit(2).alias("side"), F.col("j").alias("unit"), "w"))
    per = both.groupBy("key").agg(F.count_if(F.col("side") == 1).alias("l"), F.count_if(F.col("side") == 2).alias("r")).where("l > 0 and r > 0")
    if most is not None:
        per = per.where(F.col("r") <= most)
    own = F.when(F.col("side") == 1, block_of("unit", nl)).otherwise(block_of("unit", nr))
    rows = cut(both.join(per.select("key"), "key", "left_semi").withColumn("own", own))  # keys of both sides only
    there = lambda s: F.collect_set(F.when(F.col("side") == s, F.col("own")))
    places = rows.select("key", "side", "own").distinct().groupBy("key").agg(there(1).alias("lefts"), there(2).alias("rights"))
    sent = rows.join(places, "key").select("key", "side", "unit", "w", "own", F.explode(F.when(F.col("side") == 1, F.col("rights")).otherwise(F.col("lefts"))).alias("other"))
    lb, rb = (F.when(F.col("side") == s, F.col("own")).otherwise(F.col("other")) for s in (1, 2))
    tiled = sent.select(lb.alias("lb"), rb.alias("rb"), "key", "side", "unit", "w")
    return _by_tile(tiled, nl * nr, "key").mapInArrow(_counter(least), "i long, j long, shared long, dot double")


# -- pairs that may hold a run of similar words


class _Words:
    """Distinct words of a tile: lengths, letter signatures, code points."""

    def __init__(self, words: pa.Array):
        text = words.to_pylist()
        self.size = np.fromiter(map(len, text), np.int64, len(text))
        self.start = np.cumsum(self.size) - self.size
        self.points = np.frombuffer("".join(text).encode("utf-32-le"), np.uint32)
        # two bits for each of 32 classes of letters: one or more, two or more of them
        row = np.repeat(np.arange(len(text)), self.size)
        cls = (self.points * np.uint32(2654435761) >> np.uint32(27)).astype(np.int64)
        per = np.bincount(row * 32 + cls, minlength=len(text) * 32).reshape(len(text), 32) if len(text) else np.zeros((0, 32), np.int64)
        bit = np.uint64(1) << np.arange(32, dtype=np.uint64)
        self.sig = ((per >= 1) * bit).sum(1, dtype=np.uint64) | (((per >= 2) * bit).sum(1, dtype=np.uint64) << np.uint64(32))

    def distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Edit distances of pairs of words, many pairs at a time."""
        out = np.zeros(len(a), np.int64)
        width = np.maximum(self.size[a], self.size[b])
        order = np.argsort(width, kind="stable")
        at = 0
        while at < len(order):
            some = order[at : at + max(1, 400_000 // max(1, int(width[order[min(len(order) - 1, at + 4095)]])))][:4096]
            out[some] = self._distances(a[some], b[some])
            at += len(some)
        return out

    def _distances(self, a, b):
        la, lb = self.size[a], self.size[b]
        m = int(lb.max(initial=0))
        pad = lambda w, n: self.points[np.minimum(self.start[w][:, None] + np.arange(n), max(0, len(self.points) - 1))]
        if not len(self.points):
            return np.maximum(la, lb)
        x, y = pad(a, int(la.max(initial=0))), pad(b, m)
        step = np.arange(m + 1)
        row = np.tile(step, (len(a), 1))
        out = np.where(la == 0, lb, 0)
        for p in range(x.shape[1]):
            best = np.empty_like(row)
            best[:, 0] = p + 1
            best[:, 1:] = np.minimum(row[:, :-1] + (x[:, p, None] != y), row[:, 1:] + 1)
            row = np.minimum.accumulate(best - step, axis=1) + step
            done = la == p + 1
            out[done] = row[done, lb[done]]
        return out


def _runs(threshold: float, run_length: int):
    """Pairs of a tile whose words are similar along ``run_length`` places of one diagonal."""
    c = 2.0 * (1.0 - threshold)
    k = run_length

    def tile(kind, a, b, words):
        unit = kind < 2
        where = {int(s): {} for s in (0, 1)}
        flat = words.flatten().dictionary_encode()
        ids = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        w = _Words(flat.dictionary)
        offs = words.offsets.to_numpy()
        offs = offs - offs[0]
        for r in np.flatnonzero(unit).tolist():
            where[int(kind[r])][int(a[r])] = (int(offs[r]), int(offs[r + 1]))
        low, high = (w.size * (1.0 - c)).astype(np.float32), (w.size * (1.0 + c)).astype(np.float32)
        pairs = np.flatnonzero(~unit)
        left, right = a[pairs], b[pairs]
        cuts = np.concatenate([[0], np.flatnonzero(left[1:] != left[:-1]) + 1, [len(left)]]) if len(left) else np.zeros(1, np.int64)
        open_pair, open_a, open_b, found, waiting = [], [], [], [], 0

        def settle():
            """Exact distances of what the letters allow."""
            nonlocal open_pair, open_a, open_b, waiting
            if not open_pair:
                return
            p, x, y = np.concatenate(open_pair), np.concatenate(open_a), np.concatenate(open_b)  # pair; (cells, k) word ids
            key, back = np.unique(x.ravel() * len(w.size) + y.ravel(), return_inverse=True)
            u, v = key // len(w.size), key % len(w.size)
            total = w.size[u] + w.size[v]
            like = u == v
            rest = np.flatnonzero(~like)
            like[rest] = w.distances(u[rest], v[rest]) <= (1.0 - threshold) * total[rest] + 1e-9
            found.append(np.unique(p[like[back].reshape(x.shape).all(1)]))
            open_pair, open_a, open_b, waiting = [], [], [], 0

        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            span = where[0].get(int(left[s]))
            ends = [where[1].get(int(j)) for j in right[s:e].tolist()]
            if span is None or span[1] - span[0] < k:
                continue
            ok = [t for t, q in enumerate(ends) if q is not None and q[1] - q[0] >= k]
            for part in range(0, len(ok), 64):  # 64 partners together
                some = ok[part : part + 64]
                x = ids[span[0] : span[1]]
                y = np.concatenate([ids[ends[t][0] : ends[t][1]] for t in some])
                n = np.array([ends[t][1] - ends[t][0] for t in some])
                stop = np.cumsum(n)
                for top in range(0, len(x) - k + 1, 512):  # long units in parts
                    xs = x[top : top + 512 + k - 1]
                    near = np.bitwise_count(w.sig[xs][:, None] ^ w.sig[y][None, :]) <= np.minimum(high[y][None, :] - low[xs][:, None], high[xs][:, None] - low[y][None, :]) + np.float32(1e-2)
                    run = near[: len(xs) - k + 1, : len(y) - k + 1].copy()
                    for d in range(1, k):
                        run &= near[d : len(xs) - k + 1 + d, d : len(y) - k + 1 + d]
                    r, q = np.nonzero(run)
                    t = np.searchsorted(stop, q, "right")
                    inside = q + k <= stop[t]
                    r, q, t = r[inside], q[inside], t[inside]
                    if not len(r):
                        continue
                    wx, wy = xs[r[:, None] + np.arange(k)], y[q[:, None] + np.arange(k)]
                    pair = s + np.array(some)[t]
                    sure = np.unique(pair[(wx == wy).all(1)])
                    if len(sure):
                        found.append(sure)
                        rest = ~np.isin(pair, sure)
                        pair, wx, wy = pair[rest], wx[rest], wy[rest]
                    open_pair.append(pair), open_a.append(wx), open_b.append(wy)
                    waiting += len(pair)
                    if waiting > 200_000:
                        settle()
        settle()
        hit = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return left[hit], right[hit]

    def run(batches):
        for _, _, kind, a, b, words in _tiles(batches):
            i, j = tile(kind.to_numpy(zero_copy_only=False), a.to_numpy(zero_copy_only=False), pc.fill_null(b, 0).to_numpy(zero_copy_only=False), words)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j)], names=["i", "j"])

    return run


def may_align(pairs: DataFrame, left: DataFrame, right: DataFrame, units: tuple[int, int], threshold: float, run_length: int) -> DataFrame:
    """(i, j) of the pairs with a run of ``run_length`` similar words on a diagonal.

    ``pairs``: (i, j); ``left``: (i, words), ``right``: (j, words).  Words are similar as in
    ``word_match`` at the threshold.  Letter counts in a 64-bit signature bound the edit
    distance from below, so exact distances are needed only where a whole run may hold.  A
    unit travels once to each tile it has a pair in, not once per pair.
    """
    rows = _sent(pairs, left, right, units, {"words": "array<string>"})
    return rows.mapInArrow(_runs(threshold, run_length), "i long, j long")


def _sent(pairs: DataFrame, left: DataFrame, right: DataFrame, units: tuple[int, int], columns: dict[str, str]) -> DataFrame:
    """Rows (lb, rb, kind, a, b, columns) of tiles: kind 0 left units, 1 right units, 2 the pairs, in this order."""
    nl, nr = map(blocks, units)
    p = cut(pairs.select("i", "j", block_of("i", nl).alias("lb"), block_of("j", nr).alias("rb")))
    no = F.lit(None).cast("long").alias("b")
    parts = [
        p.select("i", "lb", "rb").distinct().join(left, "i").select("lb", "rb", F.lit(0).alias("kind"), F.col("i").alias("a"), no, *columns),
        p.select("j", "lb", "rb").distinct().join(right, "j").select("lb", "rb", F.lit(1).alias("kind"), F.col("j").alias("a"), no, *columns),
        p.select("lb", "rb", F.lit(2).alias("kind"), F.col("i").alias("a"), F.col("j").alias("b"), *[F.lit(None).cast(t).alias(c) for c, t in columns.items()]),
    ]
    return _by_tile(parts[0].unionByName(parts[1]).unionByName(parts[2]), nl * nr, "kind", "a")


def _dots(batches):
    for _, _, kind, a, b, keys, ws in _tiles(batches):
        kind, a, b = kind.to_numpy(zero_copy_only=False), a.to_numpy(zero_copy_only=False), pc.fill_null(b, 0).to_numpy(zero_copy_only=False)
        offs = keys.offsets.to_numpy()
        offs = offs - offs[0]
        key, w = keys.flatten().to_numpy(zero_copy_only=False), ws.flatten().to_numpy(zero_copy_only=False)
        span = [dict(zip(a[kind == s].tolist(), zip(offs[:-1][kind == s].tolist(), offs[1:][kind == s].tolist()))) for s in (0, 1)]
        pairs = np.flatnonzero(kind == 2)
        left, right = a[pairs], b[pairs]
        cuts = np.concatenate([[0], np.flatnonzero(left[1:] != left[:-1]) + 1, [len(left)]]) if len(left) else np.zeros(1, np.int64)
        dot = np.zeros(len(left))
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            own = span[0].get(int(left[s]))
            if own is None:
                continue
            k, x = key[own[0] : own[1]], w[own[0] : own[1]]
            for part in range(s, e, 256):  # that many partners together
                ends = [span[1].get(int(j), (0, 0)) for j in right[part : min(e, part + 256)].tolist()]
                other = np.concatenate([key[f:t] for f, t in ends])
                at = np.searchsorted(k, other)
                at[at == len(k)] = 0
                hit = np.flatnonzero(k[at] == other) if len(k) else np.zeros(0, np.int64)
                who = np.repeat(np.arange(len(ends)), [t - f for f, t in ends])
                y = np.concatenate([w[f:t] for f, t in ends])
                dot[part : part + len(ends)] = np.bincount(who[hit], x[at[hit]] * y[hit], len(ends))
        if len(left):
            yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.array(dot)], names=["i", "j", "dot"])


def dots(pairs: DataFrame, left: DataFrame, right: DataFrame, units: tuple[int, int]) -> DataFrame:
    """(i, j, dot) of given pairs: sums of products of the weights of common keys.

    ``left``: (i, keys, ws), ``right``: (j, keys, ws) with sorted keys.  The work grows with
    the pairs, however frequent a key is; a unit travels once to each tile it has a pair in.
    """
    return _sent(pairs, left, right, units, {"keys": "array<long>", "ws": "array<double>"}).mapInArrow(_dots, "i long, j long, dot double")
