"""Bands of left units against stored parts of the right units: candidates, scores, alignment.

Both sides are written once, in ranges of their unit ids.  A task takes a band of left units and
reads the parts of the right side one after the other, so no row per key or per pair is shuffled
and memory is bounded by a band and a part, whatever the size of the collection.  The pairs of
a band are kept packed, in the order of their rank.
"""

from __future__ import annotations

import hashlib
import uuid
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tiles
from .shared import _written, forget, shared_folder
from .units import counted_grams

#: Units of a band and of a part at most, about; units of a band at least, so that small inputs use all cores.
BAND_UNITS, PART_UNITS, LEAST_UNITS = 8192, 8192, 256
#: Parts read together by scores and alignment.
TOGETHER = 5
#: Joined rows looked at together, pairs of a packed row, rows of an output batch, grams weighted together (in units).
JOINED, PACKED, OUT_ROWS, GRAM_UNITS = 2_000_000, 500_000, 100_000, 4096
#: Aligned pairs whose words are compared together.
ALIGNED = 1000
#: Grams up to which scores look weights up by number, in an array of all.
NUMBERED = 4_000_000


def bands(units: int, cores: int) -> int:
    return max(1, ceil(units / BAND_UNITS), min(4 * cores, ceil(units / LEAST_UNITS)))


def parts(units: int) -> int:
    return max(1, ceil(units / PART_UNITS))


# -- stored blocks


def _path(spark: SparkSession) -> str:
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    _written.setdefault(spark, []).append(path)
    return path


def store(df: DataFrame, n: int, *columns) -> str:
    """Write columns of (unit, ...) in about n ranges of the unit, as ``block`` 0, 1, ... in their order; nothing is shuffled."""
    path = _path(df.sparkSession)
    ends = df.approxQuantile("unit", [k / n for k in range(1, n)], 0.1 / n) if n > 1 else []
    block = F.size(F.filter(F.array(*map(F.lit, ends)), lambda x: x < F.col("unit"))) if ends else F.lit(0)
    df.select(*columns, block.alias("block")).write.partitionBy("block").parquet(path)
    return path


def _made(spark: SparkSession, n: int, run, schema: str) -> str:
    """Write what ``run`` gives for each block, by block."""
    path = _path(spark)
    spark.range(0, n, 1, n).mapInArrow(run, f"block int, {schema}").write.partitionBy("block").parquet(path)
    return path


def _ids(batches):
    for b in batches:
        yield from b.column(0).to_pylist()


def _read(path: str, columns: list[str]) -> pa.Table | None:
    """All files below a folder; None if there are none."""
    fs, root = pafs.FileSystem.from_uri(path)
    found = sorted(x.path for x in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if x.path.endswith(".parquet"))
    tables = []
    for f in found:
        with fs.open_input_file(f) as at:
            tables.append(pq.ParquetFile(at).read(columns=columns))
    return pa.concat_tables(tables).combine_chunks() if tables else None


def _block(path: str, block: int | range, columns: list[str]) -> pa.Table | None:
    """Columns of a block, or of several; None without rows."""
    read = (_read(f"{path}/block={b}", columns) for b in (block if isinstance(block, range) else [block]))
    tables = [t for t in read if t is not None and t.num_rows]
    return pa.concat_tables(tables).combine_chunks() if tables else None


def _together(n: int) -> list[range]:
    return [range(a, min(n, a + TOGETHER)) for a in range(0, n, TOGETHER)]


def _column(t: pa.Table, name: str):
    return t.column(name).combine_chunks() if t.column(name).num_chunks != 1 else t.column(name).chunk(0)


def _list(t: pa.Table, name: str):
    """Offsets and flat values of a list column without nulls."""
    c = _column(t, name)
    offs = c.offsets.to_numpy().astype(np.int64)
    return offs - offs[0], c.flatten()


def _units(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted unit ids and the rows they are in."""
    unit = _column(t, "unit").to_numpy(zero_copy_only=False)
    order = np.argsort(unit, kind="stable")
    return unit[order], order


def _bigrams(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the distinct bigrams of each row, from the hashes of its words, in no given order."""
    offs, h = _list(t, "words")
    h = h.to_numpy(zero_copy_only=False).view(np.uint64)
    n = np.maximum(np.diff(offs) - 1, 0)
    at, row = _spans(offs[:-1], n), np.repeat(np.arange(len(n)), n)
    key = (h[at] ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
    key = ((key ^ key >> np.uint64(32)) ^ h[at + 1]) * np.uint64(0xD6E8FEB86659FD93)
    key ^= key >> np.uint64(32)
    both = key ^ (row + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # one sort of 64 bits for bigram and row
    first = np.unique(both, return_index=True)[1]
    return row[first], key[first].view(np.int64)


def _spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... n[0] of them, then those of start[1], ..."""
    return np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)


# -- pairs with common keys


def common_keys(path: str, spark: SparkSession, n: int, units: int, most: int) -> np.ndarray:
    """Sorted keys that more than ``most`` of all units have.

    Such a key exceeds its share in some block, so only those that do are counted over all.
    """

    def local(only):
        def run(batches):
            for block in _ids(batches):
                t = _block(path, block, ["words"])
                if t is None:
                    continue
                key, n = np.unique(_bigrams(t)[1], return_counts=True)
                ok = n * units > most * t.num_rows if only is None else np.isin(key, only)
                yield pa.RecordBatch.from_arrays([pa.array(key[ok]), pa.array(n[ok])], names=["key", "n"])

        return run

    over = lambda only: spark.range(0, n, 1, n).mapInArrow(local(only), "key long, n long")
    some = np.array([r["key"] for r in over(None).select("key").distinct().collect()], np.int64)  # at most keys per unit * units / most
    if not len(some):
        return some
    return np.sort(np.array([r["key"] for r in over(some).groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > most).select("key").collect()], np.int64))


def _dense(x: np.ndarray, steps: bool = True) -> bytes:
    """Numbers, or their steps, compressed: first bytes together, then second ones."""
    flat = np.diff(x, prepend=x.dtype.type(0)) if steps else x
    return pa.compress(np.ascontiguousarray(flat.view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes(), codec="zstd", asbytes=True)


def _undense(blob: bytes, n: int, kind, steps: bool = True) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(blob, decompressed_size=size * n, codec="zstd", asbytes=True), np.uint8)
    flat = np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()
    return np.cumsum(flat, dtype=kind) if steps else flat


#: Cells of the index of a part.
INDEX = ("units", "keys", "starts", "who")


def index(path: str, spark: SparkSession, n: int, without: np.ndarray) -> str:
    """Lists of the units of each key, per part."""

    def run(batches):
        for block in _ids(batches):
            t = _block(path, block, ["unit", "words"])
            if t is None:
                continue
            unit, order = _units(t)
            who, key = _bigrams(t)
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            who = place[who]
            ok = ~np.isin(key, without)
            who, key = who[ok], key[ok]
            by = np.lexsort((who, key))
            who, key = who[by], key[by]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            cells = [unit, key[first], np.append(first, len(key)), who]
            sizes = [len(c) for c in cells]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([sizes])] + [pa.array([_dense(c)], pa.binary()) for c in cells], names=["block", "sizes", *INDEX])

    return _made(spark, n, run, "sizes array<long>, " + ", ".join(f"{c} binary" for c in INDEX))


def _index(path: str, block: int):
    t = _block(path, block, ["sizes", *INDEX])
    if t is None:
        return None
    return [_undense(_column(t, c)[0].as_py(), n, kind) for c, n, kind in zip(INDEX, _column(t, "sizes")[0].as_py(), (np.int64, np.int64, np.int64, np.int32))]


def _often(code: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes that occur at least ``least`` times, sorted, and how often."""
    code.sort()
    some = code[: len(code) - least + 1][code[least - 1 :] == code[: len(code) - least + 1]]
    first = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1]])) if len(some) else np.zeros(0, np.int64)
    return some[first], np.diff(np.append(first, len(some))) + least - 1


def _met(row, order, sorted_key, ix, n_left: int, least: int):
    """(left place, right place, shared) of the pairs of a band and a part with enough common keys."""
    units, keys, starts, who = ix
    if not len(keys) or not len(sorted_key):
        return
    at = np.searchsorted(keys, sorted_key)
    at[at == len(keys)] = 0
    ok = np.flatnonzero(keys[at] == sorted_key)
    src, at = order[ok], at[ok]
    back = np.argsort(src, kind="stable")  # by left unit
    r, at = row[src[back]], at[back]
    start, n = starts[at], starts[at + 1] - starts[at]
    upto = np.concatenate([[0], np.cumsum(n)])
    kind = np.int32 if n_left * len(units) < 2**31 else np.int64
    r = r.astype(kind)
    a = 0
    while a < len(r):  # whole left units
        b = int(np.searchsorted(upto, upto[a] + JOINED, "right")) - 1
        b = len(r) if b >= len(r) else int(np.searchsorted(r, r[b], "left"))
        if b <= a:
            b = int(np.searchsorted(r, r[a], "right"))
        code = np.repeat(r[a:b] * kind(len(units)), n[a:b]) + who[_spans(start[a:b], n[a:b])]
        hit, shared = _often(code, least)
        if len(hit):
            yield hit // kind(len(units)), hit % kind(len(units)), shared
        a = b


def _pack(i: np.ndarray, j: np.ndarray) -> bytes:
    return _dense(np.concatenate([np.diff(i, prepend=0), np.diff(j, prepend=0)]), False)


def _unpack(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    flat = _undense(blob, 2 * n, np.int64, False)
    return np.cumsum(flat[:n]), np.cumsum(flat[n:])


def pairs(left: str, ix: str, spark: SparkSession, n: tuple[int, int], least: int, without: np.ndarray) -> str:
    """All pairs with at least ``least`` common keys, packed by band and number of keys: (shared, seq, n, blob)."""

    def run(batches):
        for band in _ids(batches):
            t = _block(left, band, ["unit", "words"])
            if t is None:
                continue
            unit, rows = _units(t)
            row, key = _bigrams(t)
            place = np.empty(len(rows), np.int64)
            place[rows] = np.arange(len(rows))
            row = place[row]
            by = np.argsort(row, kind="stable")
            row, key = row[by], key[by]
            ok = ~np.isin(key, without)
            row, key = row[ok], key[ok]
            order = np.argsort(key, kind="stable")
            got = []
            for part in range(n[1]):
                if (x := _index(ix, part)) is not None:
                    got += [(a, x[0][b], s) for a, b, s in _met(row, order, key[order], x, len(unit), least)]
            if not got:
                continue
            a, j, s = (np.concatenate(c) for c in zip(*got))
            by = np.lexsort((j, a, -s))
            a, j, s = a[by], j[by], s[by]
            edges = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                for seq, at in enumerate(range(lo, hi, PACKED)):
                    to = min(hi, at + PACKED)
                    cells = [[band], [int(s[lo])], [seq], [to - at], [_pack(unit[a[at:to]], j[at:to])]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["block", "shared", "seq", "n", "blob"])

    return _made(spark, n[0], run, "shared long, seq int, n long, blob binary")


class Ranked:
    """Packed pairs with their ranks: most keys first, then by i and j; the best ``most`` of them if it is set."""

    def __init__(self, path: str, spark: SparkSession, most: int | None = None):
        self.path, self.most, self.spark = path, most, spark
        rows = spark.read.schema("shared long, seq int, n long, blob binary, block int").parquet(path).select("block", "shared", "seq", "n").collect()  # some per band
        self.before: dict[tuple[int, int, int], int] = {}
        at = 0
        for r in sorted(rows, key=lambda r: (-r["shared"], r["block"], r["seq"])):
            self.before[r["block"], r["shared"], r["seq"]] = at
            at += r["n"]
        self.all = at

    def total(self) -> int:
        """How many pairs there are."""
        return self.all if self.most is None else min(self.all, self.most)

    def reader(self):
        """A function that gives (i, j, shared, rank) of the pairs of a band, a packed row at a time."""
        path, most, before = self.path, self.most, self.before

        def read(band: int):
            t = _block(path, band, ["shared", "seq", "n", "blob"])
            for r in t.to_pylist() if t is not None else []:
                at = before[band, r["shared"], r["seq"]]
                keep = r["n"] if most is None else min(r["n"], most - at)
                if keep > 0:
                    i, j = (x[:keep] for x in _unpack(r["blob"], r["n"]))
                    yield i, j, np.full(keep, r["shared"]), at + 1 + np.arange(keep)

        return read

    def frame(self, n: int) -> DataFrame:
        """(i, j, shared, rank)."""
        read = self.reader()

        def run(batches):
            for band in _ids(batches):
                for cells in read(band):
                    for a in range(0, len(cells[0]), OUT_ROWS):
                        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + OUT_ROWS]) for c in cells], names=["i", "j", "shared", "rank"])

        return self.spark.range(0, n, 1, n).mapInArrow(run, "i long, j long, shared long, rank long")


def _whole(read, band: int):
    """All pairs of a band as (i, j, shared, rank), sorted by j, then i; None without pairs."""
    got = list(read(band))
    if not got:
        return None
    i, j, shared, rank = (np.concatenate(c) for c in zip(*got))
    by = np.lexsort((i, j))
    return i[by], j[by], shared[by], rank[by]


def _of_part(units: np.ndarray, j: np.ndarray) -> tuple[int, int]:
    """The range of pairs sorted by j whose j are in a part."""
    return int(np.searchsorted(j, units[0], "left")), int(np.searchsorted(j, units[-1], "right"))


# -- scores


#: Words whose grams are counted in one slice, ranges of keys that are counted apart (a power of 2).
SLICE_WORDS, RANGES = 40_000_000, 64


def _cuts(key: np.ndarray, ranges: int) -> np.ndarray:
    """Where the ranges of sorted unsigned keys begin and end, by their first bits."""
    return np.concatenate([[0], np.searchsorted(key, np.arange(1, ranges, dtype=np.uint64) * np.uint64(2**64 // ranges), "left"), [len(key)]])


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    by = np.argsort(key)
    key, n = key[by], n[by]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def gram_df(sides: list[tuple[str, int]], col: str, spark: SparkSession, words: int, ngram: int, keep: int) -> list[str]:
    """Packed (keys, df) of the grams that several units of the stored sides (path, blocks) have, by ranges of the keys.

    Grams are counted in slices, one after the other: a slice travels as sorted and packed keys,
    and what it has written is deleted before the next, so its size on disk is bounded.
    """
    blocks = [(path, b) for path, n in sides for b in range(n)]
    slices = np.uint64(max(1, ceil(words / SLICE_WORDS)))

    def part(which):
        def run(batches):
            for at in _ids(batches):
                t = _block(*blocks[at], [col])
                if t is None:
                    continue
                offs, h = _list(t, col)
                h = h.to_numpy(zero_copy_only=False).view(np.uint64)
                got = []
                for a in range(0, len(offs) - 1, GRAM_UNITS):
                    key = counted_grams(offs[a : a + GRAM_UNITS + 1], h, ngram, keep)[0]
                    key = key[key % slices == which]
                    got.append(_summed(key, np.ones(len(key), np.int32)))
                key, n = _summed(*(np.concatenate(c) for c in zip(*got)))
                cuts = _cuts(key, RANGES)
                for r in np.flatnonzero(np.diff(cuts)).tolist():
                    s = slice(cuts[r], cuts[r + 1])
                    yield _packed(r, key[s], n[s])

        return run

    def count(path):
        def run(batches):
            for r in _ids(batches):
                cells = list(_keys_of(path, r))
                if cells:
                    key, n = _summed(*(np.concatenate(c) for c in zip(*cells)))
                    yield _packed(r, key[n > 1], n[n > 1])

        return run

    out = []
    for which in range(int(slices)):
        path = _made(spark, len(blocks), part(np.uint64(which)), PACKED_KEYS)
        out.append(_made(spark, RANGES, count(path), PACKED_KEYS))
        forget(spark, path)
    return out


PACKED_KEYS = "n long, keys binary, counts binary"


def _packed(block: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    cells = [[block], [len(key)], [_dense(key)], [_dense(n.astype(np.int32), False)]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["block", "n", "keys", "counts"])


def _keys_of(path: str, block: int):
    t = _block(path, block, ["n", "keys", "counts"])
    for r in t.to_pylist() if t is not None else []:
        yield _undense(r["keys"], r["n"], np.uint64), _undense(r["counts"], r["n"], np.int32, False)


def weighted(path: str, col: str, spark: SparkSession, n: int, df_paths: list[str], all_units: int, ngram: int, keep: int) -> str:
    """(unit, norm, keys, ws) of the units with grams: weights of the grams that several units have, by their numbers."""

    numbers, upto_all = {}, 0  # of the first gram of each range: a gram's number is its place in all of df
    for df_path in df_paths:
        for r in sorted(spark.read.schema("n long, block int").parquet(df_path).select("block", "n").collect(), key=lambda r: r["block"]):
            numbers[df_path, r["block"]] = upto_all
            upto_all += r["n"]

    def idf(df):
        return np.log(1.0 + all_units / (1.0 + df)) + 1.0

    def some(block, unit, offs, h):
        key, row, c, total = counted_grams(offs, h, ngram, keep)
        if not len(key):
            return None
        order = np.argsort(key)
        s, df, number = key[order], np.ones(len(key), np.int64), np.zeros(len(key), np.int64)
        cuts = _cuts(s, RANGES).tolist()
        for df_path in df_paths:
            for r in range(RANGES):
                own = s[cuts[r] : cuts[r + 1]]
                for k, d in _keys_of(df_path, r) if len(own) else []:
                    if len(k):
                        at = np.searchsorted(k, own)
                        at[at == len(k)] = 0
                        ok = np.flatnonzero(k[at] == own)
                        df[order[cuts[r] + ok]] = d[at[ok]]
                        number[order[cuts[r] + ok]] = numbers[df_path, r] + at[ok]
        key = number
        w = c / total * idf(df)
        norm = np.sqrt(np.bincount(row, w * w, len(unit)))
        often = df > 1
        row, key, w = row[often], key[often], w[often]
        by = np.lexsort((key, row))
        row, key, w = row[by], key[by], w[by]
        upto = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(unit)))]).astype(np.int32))
        t = pa.RecordBatch.from_arrays([pa.array(np.full(len(unit), block, np.int32)), pa.array(unit), pa.array(norm), pa.ListArray.from_arrays(upto, pa.array(key)), pa.ListArray.from_arrays(upto, pa.array(w))], names=["block", "unit", "norm", "keys", "ws"])
        return t.filter(pa.array(norm > 0))

    def run(batches):
        for block in _ids(batches):
            t = _block(path, block, ["unit", col])
            if t is None:
                continue
            unit = _column(t, "unit").to_numpy(zero_copy_only=False)
            offs, h = _list(t, col)
            h = h.to_numpy(zero_copy_only=False).view(np.uint64)
            for a in range(0, len(unit), GRAM_UNITS):
                b = min(len(unit), a + GRAM_UNITS)
                got = some(block, unit[a:b], offs[a : b + 1] - offs[a], h[offs[a] : offs[b]])
                if got is not None and got.num_rows:
                    yield got

    return _made(spark, n, run, "unit long, norm double, keys array<long>, ws array<double>")


def _weights(path: str, block: int | range):
    t = _block(path, block, ["unit", "norm", "keys", "ws"])
    if t is None:
        return None
    unit, rows = _units(t)
    offs, keys = _list(t, "keys")
    return unit, _column(t, "norm").to_numpy()[rows], offs[rows], offs[rows + 1], keys.to_numpy(zero_copy_only=False), _list(t, "ws")[1].to_numpy(zero_copy_only=False)


def _place(units: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the wanted units among the sorted ones, -1 where they are not."""
    at = np.minimum(np.searchsorted(units, wanted), max(0, len(units) - 1))
    return np.where(units[at] == wanted, at, -1) if len(units) else np.full(len(wanted), -1)


def scorer(ranked: Ranked, left: str, right: str, n: tuple[int, int]):
    """A function that gives (i, j, shared, rank, score) of all pairs of a band, or None."""
    read = ranked.reader()

    def of(band: int):
        got = _whole(read, band)
        if got is None:
            return None
        i, j, shared, rank = got
        score = np.zeros(len(i))
        x = _weights(left, band)
        for part in _together(n[1]) if x is not None else []:
            y = _weights(right, part)
            if y is None:
                continue
            lo, hi = _of_part(y[0], j)
            pl, pr = _place(x[0], i[lo:hi]), _place(y[0], j[lo:hi])
            ok = np.flatnonzero((pl >= 0) & (pr >= 0))
            ok = ok[np.argsort(pl[ok], kind="stable")]
            a, b = pl[ok], pr[ok]
            dot = np.zeros(len(ok))
            most = 1 + max(int(x[4].max(initial=0)), int(y[4].max(initial=0)))
            row = np.zeros(most) if most <= NUMBERED else None  # the weights of one left unit by number
            cuts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1], [True]])) if len(a) else np.zeros(1, np.int64)
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                k0, k1 = x[2][a[s]], x[3][a[s]]
                k, w = x[4][k0:k1], x[5][k0:k1]
                if not len(k):
                    continue
                if row is not None:
                    row[k] = w
                for f in range(s, e, 1024):  # that many partners together
                    own = b[f : min(e, f + 1024)]
                    size = y[3][own] - y[2][own]
                    span = _spans(y[2][own], size)
                    other = y[4][span]
                    if row is not None:
                        some = np.flatnonzero(size)
                        if len(some):
                            dot[f + some] = np.add.reduceat(row[other] * y[5][span], (np.cumsum(size) - size)[some])
                        continue
                    at = np.searchsorted(k, other)
                    at[at == len(k)] = 0
                    hit = np.flatnonzero(k[at] == other)
                    who = np.repeat(np.arange(len(own)), size)
                    dot[f : f + len(own)] = np.bincount(who[hit], w[at[hit]] * y[5][span[hit]], len(own))
                if row is not None:
                    row[k] = 0.0
            score[lo + ok] = dot / (x[1][a] * y[1][b])
        return i, j, shared, rank, score

    return of


def scores(ranked: Ranked, of, n: tuple[int, int]) -> DataFrame:
    """(i, j, shared, rank, score): cosine of all pairs by a scorer, 0 where a side has no grams or none in common."""

    def run(batches):
        for band in _ids(batches):
            got = of(band)
            for a in range(0, len(got[0]) if got else 0, OUT_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + OUT_ROWS]) for c in got], names=["i", "j", "shared", "rank", "score"])

    return ranked.spark.range(0, n[0], 1, n[0]).mapInArrow(run, "i long, j long, shared long, rank long, score double")


def above(ranked: Ranked, of, n: tuple[int, int], threshold: float) -> Ranked:
    """The pairs with at least this score, packed again in no given order."""

    def run(batches):
        for band in _ids(batches):
            got = of(band)
            if got is None:
                continue
            ok = np.flatnonzero(got[4] >= threshold)
            for seq, a in enumerate(range(0, len(ok), PACKED)):
                some = ok[a : a + PACKED]
                cells = [[band], [0], [seq], [len(some)], [_pack(got[0][some], got[1][some])]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["block", "shared", "seq", "n", "blob"])

    return Ranked(_made(ranked.spark, n[0], run, "shared long, seq int, n long, blob binary"), ranked.spark)


# -- scores by grams of few symbols

#: Places of symbols whose grams are held together: of left units, with their weights, and of right units.
LEFT_PLACES, RIGHT_PLACES = 4_000_000, 4_000_000


class Coded:
    """Grams of few symbols as numbers that need no list: the symbols of a gram are the digits of its number.

    The choices of a window that are shifts of each other are one kind of gram, so each place of a
    unit begins one gram of each kind; how many windows have it follows from the place and the
    length of the unit.  A gram that would reach beyond its unit has the number ``none``.
    """

    def __init__(self, symbols: int, ngram: int, keep: int):
        self.symbols, self.ngram, self.keep = symbols, ngram, keep
        self.kinds = [c for c in combinations(range(ngram), keep) if c[0] == 0]
        self.none = symbols**keep
        self._times: dict[int, np.ndarray] = {}

    def room(self, places: int) -> np.ndarray:
        """Memory for the grams of so many places, used again by each piece of units."""
        return np.empty((places, len(self.kinds)), np.int64)

    def grams(self, codes: np.ndarray, sizes: np.ndarray, room: np.ndarray | None = None) -> tuple[list[int], np.ndarray]:
        """Where each unit begins, and ends, among the numbers of all grams, by place and kind; no unit is shorter than a window."""
        n, kinds, number = len(codes), self.kinds, np.int32 if self.none < 2**31 else np.int64
        x = np.zeros(n + self.ngram, number)
        x[:n] = codes
        out = room[:n] if room is not None and n <= len(room) else self.room(n)
        ends = np.cumsum(sizes)
        for a in range(0, n, 16384):  # so that all steps stay in the cache
            m = min(n, a + 16384) - a
            made = {(0,): x[a : a + m]}
            for f, kind in enumerate(kinds):
                for k in range(1, len(kind)):
                    if kind[: k + 1] not in made:
                        made[kind[: k + 1]] = made[kind[:k]] * number(self.symbols) + x[a + kind[k] : a + kind[k] + m]
                out[a : a + m, f] = made[kind]
        for f, kind in enumerate(kinds):
            for back in range(1, kind[-1] + 1):
                out[ends - back, f] = self.none
        return (np.concatenate([[0], ends]) * len(kinds)).tolist(), out.ravel()

    def times(self, n: int) -> np.ndarray:
        """How many windows of a unit of n symbols have the gram of each place and kind."""
        got = self._times.get(n)
        if got is None:
            at = np.arange(n)[:, None]
            shifts = np.array([self.ngram - 1 - kind[-1] for kind in self.kinds])
            got = np.maximum(0, np.minimum(at, shifts) - np.maximum(0, at - (n - self.ngram)) + 1).astype(np.float64).ravel()
            if n <= 2048:
                self._times[n] = got
        return got


def symbols(sides: list[tuple[str, int]], col: str, spark: SparkSession, most: int) -> np.ndarray | None:
    """Distinct values of the lists of the stored sides, frequent ones first; None if there are more than ``most``."""
    blocks = [(path, b) for path, n in sides for b in range(n)]

    def run(batches):
        for at in _ids(batches):
            t = _block(*blocks[at], [col])
            if t is not None:
                found = _list(t, col)[1].value_counts()[: most + 1]
                yield pa.RecordBatch.from_arrays([found.field(0), found.field(1)], names=["symbol", "n"])

    found = spark.range(0, len(blocks), 1, len(blocks)).mapInArrow(run, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).limit(most + 1).collect()
    return np.array([r["symbol"] for r in sorted(found, key=lambda r: (-r["n"], r["symbol"]))], np.int64) if len(found) <= most else None


def spelling(vocabulary: str, spark: SparkSession, of) -> str:
    """(key, subwords): the subwords of each word of a vocabulary, by ``of``, as hashes."""

    def run(batches):
        for block in _ids(batches):
            t = _block(vocabulary, block, ["key", "text"])
            if t is None:
                continue
            parts = [of(w) for w in _column(t, "text").to_pylist()]
            kinds = pa.array([x for own in parts for x in own], pa.string()).dictionary_encode()
            h = np.frombuffer(b"".join([hashlib.blake2b(x.encode(), digest_size=8).digest() for x in kinds.dictionary.to_pylist()]), np.int64)
            ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(t.num_rows, block, np.int32)), _column(t, "key"), pa.ListArray.from_arrays(pa.array(ends), pa.array(h[kinds.indices.to_numpy(zero_copy_only=False)], pa.int64()))], names=["block", "key", "subwords"])

    return _made(spark, VOCABULARY, run, "key long, subwords array<long>")


def _speller(path: str):
    """A function that gives (offsets, subwords) of lists of words, as offsets and hashes, by a ``spelling``."""
    t = _block(path, range(VOCABULARY), ["key", "subwords"])
    if t is None:
        return lambda offs, h: (np.zeros(len(offs), np.int64), np.zeros(0, np.int64))
    key = _column(t, "key").to_numpy()
    order = np.argsort(key)
    offs_of, of = _list(t, "subwords")
    key, start, size, of = key[order], offs_of[:-1][order], np.diff(offs_of)[order], of.to_numpy(zero_copy_only=False)

    def spell(offs, h):
        words = h.dictionary_encode()
        at = np.searchsorted(key, words.dictionary.to_numpy(zero_copy_only=False))[words.indices.to_numpy(zero_copy_only=False)]
        n = size[at]
        return np.concatenate([[0], np.cumsum(n)])[offs], of[_spans(start[at], n)]

    return spell


def spelled(path: str, spellings: str, spark: SparkSession, n: int) -> str:
    """(unit, subwords) of the stored words."""

    def run(batches):
        spell = _speller(spellings)
        for block in _ids(batches):
            t = _block(path, block, ["unit", "words"])
            if t is not None:
                offs, h = spell(*_list(t, "words"))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(t.num_rows, block, np.int32)), _column(t, "unit"), pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(h, pa.int64()))], names=["block", "unit", "subwords"])

    return _made(spark, n, run, "unit long, subwords array<long>")


def coded(path: str, spellings: str | None, spark: SparkSession, n: int, symbols: np.ndarray, ngram: int, keep: int) -> str:
    """Units with grams, their sizes and symbols as codes, and in how many units each gram is, packed by block.

    The symbols are those of the stored words by ``spellings``, or the stored ``subwords``.
    """
    kind = np.min_scalar_type(max(0, len(symbols) - 1))

    def run(batches):
        c, spell, order = Coded(len(symbols), ngram, keep), spellings and _speller(spellings), np.argsort(symbols)
        room = c.room(RIGHT_PLACES)
        for block in _ids(batches):
            t = _block(path, block, ["unit", "words" if spell else "subwords"])
            if t is None:
                continue
            unit, rows = _units(t)
            if spell:
                offs, h = spell(*_list(t, "words"))
            else:
                offs, h = _list(t, "subwords")
                h = h.to_numpy(zero_copy_only=False)
            sizes = np.diff(offs)[rows]
            ok = sizes >= ngram
            unit, sizes, rows = unit[ok], sizes[ok], rows[ok]
            code = order.astype(kind)[np.searchsorted(symbols, h, sorter=order)][_spans(offs[rows], sizes)]
            df, seen = np.zeros(c.none + 1, np.int32), np.empty(c.none + 1, np.int32)
            for a, b, p, q in _pieces(sizes, RIGHT_PLACES):
                ends, grams = c.grams(code[p:q], sizes[a:b], room)
                at = np.arange(int(sizes[a:b].max(initial=0)) * len(c.kinds), dtype=np.int32)
                for s, e in zip(ends[:-1], ends[1:]):
                    own = grams[s:e]
                    seen[own] = at[: e - s]
                    df[own[seen[own] == at[: e - s]]] += 1  # each once per unit
            cells = [_dense(unit), _dense(sizes, False), _dense(code, False), _dense(df, False)]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([[len(unit), len(code)]])] + [pa.array([x], pa.binary()) for x in cells], names=["block", "n", "units", "sizes", "codes", "df"])

    return _made(spark, n, run, "n array<long>, units binary, sizes binary, codes binary, df binary")


def coded_df(sides: list[tuple[str, int]], spark: SparkSession, cells: int) -> np.ndarray:
    """In how many units of all blocks each gram is."""
    blocks = [(path, b) for path, n in sides for b in range(n)]
    tasks = min(len(blocks), spark.sparkContext.defaultParallelism)

    def run(batches):
        for at in _ids(batches):
            df = np.zeros(cells, np.int32)
            for path, block in blocks[at::tasks]:
                if (t := _block(path, block, ["df"])) is not None:
                    df += _undense(_column(t, "df")[0].as_py(), cells, np.int32, False)
            yield pa.RecordBatch.from_arrays([pa.array([_dense(df, False)], pa.binary())], names=["df"])

    return sum(_undense(r["df"], cells, np.int32, False) for r in spark.range(0, tasks, 1, tasks).mapInArrow(run, "df binary").collect())


def _codes(path: str, block: int, kind):
    """(units, sizes, codes) of a block."""
    t = _block(path, block, ["n", "units", "sizes", "codes"])
    if t is None:
        return None
    units, codes = _column(t, "n")[0].as_py()
    return tuple(_undense(_column(t, name)[0].as_py(), n, k, name == "units") for name, n, k in (("units", units, np.int64), ("sizes", units, np.int64), ("codes", codes, kind)))


def _pieces(sizes: np.ndarray, most: int) -> list[tuple[int, int, int, int]]:
    """Ranges of units (from, to), and of their places, of about ``most`` places at most."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    out, a = [], 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + most, "right")) - 1)
        out.append((a, b, int(upto[a]), int(upto[b])))
        a = b
    return out


class _Weighing:
    """Counts of the grams of one unit at a time, times the square of their idf."""

    def __init__(self, c: Coded, df: bytes, all_units: int):
        self.c = c
        self.idf2 = (np.log(1.0 + all_units / (1.0 + _undense(df, c.none + 1, np.int32, False))) + 1.0) ** 2
        self.idf2[c.none] = 0.0
        self.n = np.zeros(c.none + 1)

    def of(self, grams: np.ndarray, size: int) -> tuple[np.ndarray, float]:
        """The weight of each gram, and the size of the unit."""
        times = self.c.times(size)
        np.add.at(self.n, grams, times)
        w = self.n[grams] * self.idf2[grams]
        self.n[grams] = 0.0
        return w, float(np.sqrt(w @ times))


def coded_norms(path: str, spark: SparkSession, n: int, c: Coded, df: bytes, all_units: int, kind) -> str:
    """Sizes of the units of each block, in their order."""

    def run(batches):
        weigh = None
        for block in _ids(batches):
            x = _codes(path, block, kind)
            if x is None:
                continue
            if weigh is None:
                weigh, room = _Weighing(c, df, all_units), c.room(RIGHT_PLACES)
            norm = []
            for a, b, p, q in _pieces(x[1], RIGHT_PLACES):
                ends, grams = c.grams(x[2][p:q], x[1][a:b], room)
                norm += [weigh.of(grams[s:e], size)[1] for s, e, size in zip(ends[:-1], ends[1:], x[1][a:b].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([norm], pa.list_(pa.float64()))], names=["block", "norms"])

    return _made(spark, n, run, "norms array<double>")


def coded_scorer(sides: tuple[str, str], spellings: str | None, spark: SparkSession, n: tuple[int, int], symbols: np.ndarray, all_units: int, ngram: int, keep: int):
    """A function that makes scorers by grams of few symbols: no list of grams is written, sorted or looked up, they are made of the codes at each use."""
    c, kind = Coded(len(symbols), ngram, keep), np.min_scalar_type(max(0, len(symbols) - 1))
    left, right = (coded(path, spellings, spark, k, symbols, ngram, keep) for path, k in zip(sides, n))
    df = _dense(coded_df([(left, n[0]), (right, n[1])], spark, c.none + 1), False)
    norms = coded_norms(right, spark, n[1], c, df, all_units, kind)
    return lambda ranked: _coded_scorer(ranked, left, right, norms, n[1], c, df, all_units, kind)


def _coded_scorer(ranked: Ranked, left: str, right: str, norms: str, parts: int, c: Coded, df: bytes, all_units: int, kind):
    read = ranked.reader()

    def of(band: int):
        got = _whole(read, band)
        if got is None:
            return None
        i, j, shared, rank = got
        score = np.zeros(len(i))
        x = _codes(left, band, kind)
        if x is None:
            return i, j, shared, rank, score
        weigh, row, room = _Weighing(c, df, all_units), np.zeros(c.none + 1), c.room(RIGHT_PLACES)
        take = row.take
        for a, b, p, q in _pieces(x[1], LEFT_PLACES):
            unit = x[0][a:b]
            ends, grams = c.grams(x[2][p:q], x[1][a:b])
            ws, size = np.empty(len(grams)), np.empty(len(unit))
            for k, (s, e, m) in enumerate(zip(ends[:-1], ends[1:], x[1][a:b].tolist())):
                ws[s:e], size[k] = weigh.of(grams[s:e], m)
            for part in range(parts):
                y = _codes(right, part, kind)
                if y is None or not len(y[0]):
                    continue
                lo, hi = _of_part(y[0], j)
                pl, pr = _place(unit, i[lo:hi]), _place(y[0], j[lo:hi])
                ok = np.flatnonzero((pl >= 0) & (pr >= 0))  # by right unit
                if not len(ok):
                    continue
                norm = _column(_block(norms, part, ["norms"]), "norms")[0].values.to_numpy()
                wanted = np.unique(pr[ok])
                start = np.cumsum(y[1]) - y[1]
                for f, g, _, _ in _pieces(y[1][wanted], RIGHT_PLACES):
                    some = wanted[f:g]
                    own = y[1][some]
                    r_ends, r_grams = c.grams(y[2][_spans(start[some], own)], own, room)
                    lists = [r_grams[s:e] for s, e in zip(r_ends[:-1], r_ends[1:])]
                    times = [c.times(m) for m in own.tolist()]
                    at = ok[np.searchsorted(pr[ok], some[0], "left") : np.searchsorted(pr[ok], some[-1], "right")]
                    at = at[np.argsort(pl[at], kind="stable")]
                    u, v = pl[at], np.searchsorted(some, pr[at])
                    cuts = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1], [True]])).tolist()
                    dot, partner = [], v.tolist()
                    for s, e, k in zip(cuts[:-1], cuts[1:], u[cuts[:-1]].tolist()):
                        mine = grams[ends[k] : ends[k + 1]]
                        row[mine] = ws[ends[k] : ends[k + 1]]
                        dot += [take(lists[m]) @ times[m] for m in partner[s:e]]
                        row[mine] = 0.0
                    score[lo + at] = np.array(dot) / (size[u] * norm[some[v]])
        return i, j, shared, rank, score

    return of


# -- all pairs with a common gram

#: Cells of a strip of the matrix of scores.
CELLS = 2**18
#: Cells of the weights of a part by key.
BY_KEY = (("units", np.int64), ("keys", np.int64), ("starts", np.int64), ("who", np.int32), ("ws", np.float64))


def by_key(path: str, spark: SparkSession, n: int) -> str:
    """Lists of the units of each gram, with their weights over the size of the unit, per part."""

    def run(batches):
        for block in _ids(batches):
            x = _weights(path, block)
            if x is None:
                continue
            unit, row, key, w = _flat(x)
            by = np.argsort(key, kind="stable")
            row, key, w = row[by].astype(np.int32), key[by], w[by]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            cells = [unit, key[first], np.append(first, len(key)), row, w]
            names = [c for c, _ in BY_KEY]
            packed = [_dense(c, name != "ws") for c, name in zip(cells, names)]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([[len(c) for c in cells]])] + [pa.array([c], pa.binary()) for c in packed], names=["block", "sizes", *names])

    return _made(spark, n, run, "sizes array<long>, " + ", ".join(f"{c} binary" for c, _ in BY_KEY))


def _flat(x):
    """(units, row, key, w): the weights of ``_weights`` over the size of the unit, by unit."""
    unit, norm, start, stop, keys, ws = x
    at, row = _spans(start, stop - start), np.repeat(np.arange(len(unit)), stop - start)
    return unit, row, keys[at], ws[at] / norm[row]


def dense(left: str, right: str, spark: SparkSession, n: tuple[int, int]) -> DataFrame:
    """(i, j, score) of all pairs with a common gram; ``left``: weights, ``right``: those by key. Nothing is shuffled."""

    def met(unit, row, inv, distinct, w, cells):
        units, keys, starts, who, ws = cells
        if not len(keys):
            return
        at = np.searchsorted(keys, distinct)
        at[at == len(keys)] = 0
        there = keys[at] == distinct
        ok = np.flatnonzero(there[inv])
        at, row, w = at[inv[ok]], row[ok], w[ok]
        start, size = starts[at], starts[at + 1] - starts[at]
        upto = np.concatenate([[0], np.cumsum(size)])
        wide = len(units)
        strip = max(1, CELLS // wide)
        for a in range(0, len(unit), strip):
            lo, hi = np.searchsorted(row, [a, a + strip]).tolist()
            score = None
            while lo < hi:  # joined rows of a strip come in parts
                to = min(hi, max(lo + 1, int(np.searchsorted(upto, upto[lo] + JOINED, "right")) - 1))
                span = _spans(start[lo:to], size[lo:to])
                some = np.bincount(np.repeat((row[lo:to] - a) * wide, size[lo:to]) + who[span], np.repeat(w[lo:to], size[lo:to]) * ws[span], strip * wide)
                score = some if score is None else score + some
                lo = to
            if score is not None:
                hit = np.flatnonzero(score)
                yield unit[a + hit // wide], units[hit % wide], score[hit]

    def run(batches):
        for band in _ids(batches):
            x = _weights(left, band)
            if x is None:
                continue
            unit, row, key, w = _flat(x)
            distinct, inv = np.unique(key, return_inverse=True)
            for part in range(n[1]):
                t = _block(right, part, ["sizes", *(c for c, _ in BY_KEY)])
                if t is None:
                    continue
                cells = [_undense(_column(t, c)[0].as_py(), size, kind, c != "ws") for (c, kind), size in zip(BY_KEY, _column(t, "sizes")[0].as_py())]
                held, rows = [], 0
                for got in met(unit, row, inv, distinct, w, cells):
                    held.append(got)
                    rows += len(got[0])
                    if rows >= OUT_ROWS:
                        yield from _batches(held)
                        held, rows = [], 0
                yield from _batches(held)

    def _batches(held):
        cols = [np.concatenate(c) for c in zip(*held)]
        for a in range(0, len(cols[0]) if cols else 0, OUT_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c[a : a + OUT_ROWS]) for c in cols], names=["i", "j", "score"])

    return spark.range(0, n[0], 1, n[0]).mapInArrow(run, "i long, j long, score double")


class Among:
    """Some of the packed pairs, with their ranks."""

    def __init__(self, whole: Ranked, path: str):
        self.whole, self.path, self.spark = whole, path, whole.spark

    def reader(self):
        path, read_all = self.path, self.whole.reader()

        def read(band: int):
            t = _block(path, band, ["i", "j"])
            if t is None:
                return
            i, j = (_column(t, c).to_numpy() for c in "ij")
            ui, uj = np.unique(i), np.unique(j)
            some = np.unique(_place(ui, i) * len(uj) + _place(uj, j))
            for cells in read_all(band):
                a, b = _place(ui, cells[0]), _place(uj, cells[1])
                code = a * len(uj) + b
                ok = np.flatnonzero((a >= 0) & (b >= 0) & (_place(some, code) >= 0))
                if len(ok):
                    yield tuple(c[ok] for c in cells)

        return read

    frame = Ranked.frame


def among(ranked: Ranked, pairs: DataFrame) -> Among:
    """Those of the packed pairs that are in ``pairs`` (i, j, band), which are some of them."""
    path = _path(ranked.spark)
    pairs.select("i", "j", "band").distinct().withColumnRenamed("band", "block").write.partitionBy("block").parquet(path)
    return Among(ranked, path)


# -- alignment

#: Ranges of a vocabulary.
VOCABULARY = 16


def vocabulary(units: list[DataFrame]) -> str:
    """Distinct (key, text) of the ``keys`` and ``texts`` of units, by ranges of the keys."""
    both = units[0].select("keys", "texts").unionByName(units[1].select("keys", "texts")).where("keys is not null")
    each = both.select(F.explode_outer(F.arrays_zip("keys", "texts")).alias("x")).select(F.col("x.keys").alias("key"), F.col("x.texts").alias("text")).where("key is not null")
    path = _path(units[0].sparkSession)
    each.groupBy("key").agg(F.min("text").alias("text")).withColumn("block", F.pmod("key", F.lit(VOCABULARY)).cast("int")).write.partitionBy("block").parquet(path)
    return path


def _texts(path: str, keys: np.ndarray) -> pa.Array:
    """The texts of distinct keys."""
    own = keys % VOCABULARY
    order, parts = [np.zeros(0, np.int64)], []
    for r in range(VOCABULARY):
        some = np.flatnonzero(own == r)
        t = _block(path, r, ["key", "text"]) if len(some) else None
        if t is None:
            continue
        k = _column(t, "key").to_numpy()
        by = np.argsort(k)
        order.append(some)
        parts.append(_column(t, "text").take(pa.array(by[np.searchsorted(k[by], keys[some])])))
    if not parts:
        return pa.array([], pa.string())
    return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(order))))


#: Rows of an alignment by what is asked for.
ALIGNMENT = {
    "pairs": "i long, j long",
    "runs": "i long, j long, d int, start int, len long",
    "blocks": "i long, j long, d int, a int, n long, core long, runs array<struct<start:int,len:long>>",
    "kept": "i long, j long, d int, a int, n long, core long, runs array<struct<start:int,len:long>>, n_blocks long, band int",
}


class _Similar:
    """Similar words of one dictionary, as ``word_match`` has it, and a bound by letters that loses none."""

    def __init__(self, words: pa.Array, threshold: float):
        self.w, self.t = tiles._Words(words), threshold
        self.c = 2.0 * (1.0 - threshold)
        kinds, self.kind = np.unique(self.w.size, return_inverse=True)  # lengths
        la, lb = kinds[:, None], kinds[None, :]
        self.bound = np.clip(np.floor(self.c * (la + lb) - np.abs(la - lb) + 1e-2) + 1, 0, 65).astype(np.uint8)

    def near(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """(x, y): whether words may be similar."""
        used, back = np.unique(self.kind[x], return_inverse=True)
        bound = self.bound[used][:, self.kind[y]]
        near = self.w.sig[x][:, None] ^ self.w.sig[y][None, :]
        return np.bitwise_count(near) < bound[back]

    def like(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether pairs of words are similar."""
        key, back = np.unique(x * len(self.w.size) + y, return_inverse=True)
        u, v = key // len(self.w.size), key % len(self.w.size)
        ok = u == v
        total = self.w.size[u] + self.w.size[v]
        rest = np.flatnonzero(~ok & (np.abs(self.w.size[u] - self.w.size[v]) / np.maximum(total, 1) <= 1.0 - self.t))
        ok[rest] = 1.0 - self.w.distances(u[rest], v[rest]) / total[rest] >= self.t
        return ok[back]


_BIT = np.tile(np.uint8(1) << np.arange(8, dtype=np.uint8), 8)[:, None]


def _starts(near: np.ndarray, x: np.ndarray, y: np.ndarray, stop: np.ndarray, k: int):
    """(r, q): places of left words, and of right words end to end, at which k pairs in a row may be similar.

    ``x`` and ``y``: rows and columns of ``near`` of the words.  Bits of one word stand for 64
    left words, so a run is found by shifts.
    """
    n, step = len(x), 64 - (k - 1)
    for top in range(0, n - k + 1, step):
        some = np.zeros((64, near.shape[1]), np.uint8)
        np.multiply(near.view(np.uint8)[x[top : top + 64]], _BIT[: min(64, n - top)], out=some[: min(64, n - top)])
        bits = np.ascontiguousarray(np.bitwise_or.reduce(some.reshape(8, 8, -1), axis=1).T).view(np.uint64).ravel()[y]
        run = bits.copy()
        for d in range(1, k):
            run[:-d] &= bits[d:] >> np.uint64(d)
        hit = np.flatnonzero(run)
        hit = hit[hit + k <= stop[np.searchsorted(stop, hit, "right")]]
        h, r = np.nonzero(np.unpackbits(run[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")) if len(hit) else (hit, hit)
        ok = r < step
        yield r[ok] + top, hit[h[ok]]


def _rows_of(batch: list, sim: _Similar, what: str, n_out: int, core_least: int, n_least: int, kept_only: bool):
    """Rows of the alignment of some pairs: (i, j, r, q, x, y), places and words that may match."""
    size = np.array([len(b[2]) for b in batch])
    p = np.repeat(np.arange(len(batch)), size)
    r, q, x, y = (np.concatenate([b[k] for b in batch]) for k in (2, 3, 4, 5))
    ok = sim.like(x, y)
    p, r, d = p[ok], r[ok], (q - r)[ok]
    by = np.lexsort((r, d, p))
    p, r, d = p[by], r[by], d[by]
    i, j = (np.array([b[k] for b in batch]) for k in (0, 1))
    same = (p[1:] == p[:-1]) & (d[1:] == d[:-1])
    first = np.flatnonzero(np.concatenate([[True], ~(same & (r[1:] == r[:-1] + 1))]))
    length = np.diff(np.append(first, len(p)))
    rp, rd, start = p[first], d[first], r[first]
    joined = (rp[1:] == rp[:-1]) & (rd[1:] == rd[:-1]) & (start[1:] - (start[:-1] + length[:-1]) <= n_out)
    opens = np.flatnonzero(np.concatenate([[True], ~joined]))
    n, core = np.add.reduceat(length, opens), np.maximum.reduceat(length, opens)
    bp, bd, a = rp[opens], rd[opens], start[opens]
    keeps = (core >= core_least) & (n >= n_least)
    if kept_only:
        good = np.zeros(len(batch), bool)
        good[bp[keeps]] = True
    else:
        good = np.ones(len(batch), bool)
    if what == "runs":
        s = good[rp]
        return [i[rp[s]], j[rp[s]], rd[s].astype(np.int32), start[s].astype(np.int32), length[s]]
    s = np.flatnonzero(keeps if what == "kept" else good[bp])
    runs = np.diff(np.append(opens, len(rp)))[s]
    at = _spans(opens[s], runs)
    inner = pa.StructArray.from_arrays([pa.array(start[at].astype(np.int32)), pa.array(length[at])], names=["start", "len"])
    cols = [i[bp[s]], j[bp[s]], bd[s].astype(np.int32), a[s].astype(np.int32), n[s], core[s], pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(runs)]).astype(np.int32)), inner)]
    return cols + [np.bincount(bp, minlength=len(batch))[bp[s]]] if what == "kept" else cols


def align(ranked: Ranked, left: str, right: str, n: tuple[int, int], what: str, threshold: float, run_length: int, n_out: int, n_least: int, kept_only: bool = False, texts: str | None = None) -> DataFrame:
    """Alignment of the pairs with ``run_length`` similar words in a row on a diagonal: no other keeps a block.

    ``what``: their (i, j); all runs; all blocks; the blocks that are long enough, with the
    number of all blocks of the pair.  ``kept_only``: only pairs that have such a block.
    ``texts``: the vocabulary of sides that are stored as hashes of their words.
    """
    read, k = ranked.reader(), run_length
    col = "norm" if texts is None else "words"
    names = [c.split(" ")[0] for c in ALIGNMENT[what].replace("struct<start:int,len:long>", "s").split(", ")]

    def out(cols, band):
        if what == "kept":
            cols = [*cols, np.full(len(cols[0]), band, np.int32)]
        for a in range(0, len(cols[0]), OUT_ROWS):
            yield pa.RecordBatch.from_arrays([c[a : a + OUT_ROWS] if isinstance(c, pa.Array) else pa.array(c[a : a + OUT_ROWS]) for c in cols], names=names)

    def pair_rows(x_tab, y_tab, i, j, band):
        ux, rows_x = _units(x_tab)
        uy, rows_y = _units(y_tab)
        (ox, wx), (oy, wy) = _list(x_tab, col), _list(y_tab, col)
        words = pa.concat_arrays([wx, wy]).dictionary_encode()
        ids = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        sim = _Similar(words.dictionary if texts is None else _texts(texts, words.dictionary.to_numpy()), threshold)
        idx, idy = ids[: len(wx)], ids[len(wx) :]
        by = np.argsort(i, kind="stable")
        i, j = i[by], j[by]
        pl, pr = rows_x[_place(ux, i)], rows_y[_place(uy, j)]
        cuts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1], [True]]))
        mark, there = np.zeros(len(sim.w.size), np.int64), np.zeros(len(sim.w.size), bool)
        waiting, batch = [], []

        def settle():
            """Exact comparison of the runs that letters allow; the pairs that have one."""
            pair, x, y = (np.concatenate(c) for c in zip(*waiting))
            left_over = np.arange(len(pair))
            for d in range(k):
                left_over = left_over[sim.like(x[left_over, d], y[left_over, d])]
            waiting.clear()
            return np.unique(pair[left_over])

        def settled():
            hit = settle()
            if what == "pairs":
                yield from out([i[hit], j[hit]], band)
                return
            for p in hit.tolist():
                x, y = idx[ox[pl[p]] : ox[pl[p] + 1]], idy[oy[pr[p]] : oy[pr[p] + 1]]
                vx, bx = np.unique(x, return_inverse=True)
                vy, by_ = np.unique(y, return_inverse=True)
                r, q = np.nonzero(sim.near(vx, vy)[bx][:, by_])
                batch.append((i[p], j[p], r, q, x[r], y[q]))
                if len(batch) >= ALIGNED:
                    yield from out(_rows_of(batch, sim, what, n_out, k, n_least, kept_only), band)
                    batch.clear()

        held = 0
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            x = idx[ox[pl[s]] : ox[pl[s] + 1]]
            if len(x) < k:
                continue
            vx, bx = np.unique(x, return_inverse=True)
            for f in range(s, e, 256):  # that many partners together
                own = pr[f : min(e, f + 256)]
                size = oy[own + 1] - oy[own]
                y = idy[_spans(oy[own], size)]
                if not len(y):
                    continue
                there[y] = True
                vy = np.flatnonzero(there)
                there[vy] = False
                mark[vy] = np.arange(len(vy))
                stop = np.cumsum(size)
                for r, q in _starts(sim.near(vx, vy), bx, mark[y], stop, k):
                    if len(r):
                        waiting.append((f + np.searchsorted(stop, q, "right"), x[r[:, None] + np.arange(k)], y[q[:, None] + np.arange(k)]))
                        held += len(r)
            if held > 300_000:
                yield from settled()
                held = 0
        if waiting:
            yield from settled()
        if batch:
            yield from out(_rows_of(batch, sim, what, n_out, k, n_least, kept_only), band)

    def run(batches):
        for band in _ids(batches):
            got = _whole(read, band)
            if got is None:
                continue
            i, j = got[:2]
            x = _block(left, band, ["unit", col])
            for part in _together(n[1]):
                y = _block(right, part, ["unit", col])
                if y is None:
                    continue
                lo, hi = _of_part(_units(y)[0], j)
                if hi > lo:
                    yield from pair_rows(x, y, i[lo:hi], j[lo:hi], band)

    return ranked.spark.range(0, n[0], 1, n[0]).mapInArrow(run, ALIGNMENT[what])
