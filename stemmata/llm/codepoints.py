"""Texts as numpy code-point arrays: the one consistent form, words, and word hashes.

An Arrow string column is copied once into a flat ``uint32`` array with row offsets; every
later step is a table gather, a run-boundary computation or a segmented reduction over the
whole batch.  Python string functions only ever see *distinct* characters (to fill the
lookup tables) and *distinct* letter-plus-marks clusters (to look up their composition).

Consistent form of a text:

* invisible characters (category Cf, variation selectors, control characters other than
  tab and line ends) are removed,
* spaces other than U+0020 become U+0020,
* wide, narrow, joined and otherwise variant code points of a sign become that sign
  (compatibility decompositions other than raised/lowered signs, fractions, and spacing
  accents),
* marks are composed with their letter where a precomposed form exists (NFC),
* in a word that mixes scripts, look-alike letters go over to the script of the word.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTER, MARK, INVISIBLE, SPACE, DIGIT, VISIBLE = 1, 2, 4, 8, 16, 32
LATIN, GREEK, CYRILLIC, OTHER = 1, 2, 4, 8

# Letters that look alike (Latin, Greek, Cyrillic), capitals then small letters.
LOOK_ALIKES = (
    ("A", "Α", "А"), ("B", "Β", "В"), ("C", "Ϲ", "С"), ("E", "Ε", "Е"), ("H", "Η", "Н"),
    ("I", "Ι", "І"), ("J", "Ϳ", "Ј"), ("K", "Κ", "К"), ("M", "Μ", "М"), ("N", "Ν", ""),
    ("O", "Ο", "О"), ("P", "Ρ", "Р"), ("S", "", "Ѕ"), ("T", "Τ", "Т"), ("X", "Χ", "Х"),
    ("Y", "Υ", "У"), ("Z", "Ζ", ""), ("", "Γ", "Г"), ("", "Π", "П"), ("", "Φ", "Ф"),
    ("a", "α", "а"), ("c", "ϲ", "с"), ("e", "ε", "е"), ("i", "ι", "і"), ("j", "ϳ", "ј"),
    ("k", "κ", "к"), ("n", "η", ""), ("o", "ο", "о"), ("p", "ρ", "р"), ("s", "", "ѕ"),
    ("t", "τ", "т"), ("u", "υ", ""), ("v", "ν", ""), ("x", "χ", "х"), ("y", "γ", "у"),
    ("w", "ω", ""),
)
_SAME_SIGN = ("<wide>", "<narrow>", "<compat>", "<font>", "<initial>", "<medial>", "<final>",
              "<isolated>", "<noBreak>", "<circle>", "<square>", "<small>", "<vertical>")
_SCRIPTS = {"LATIN": LATIN, "GREEK": GREEK, "CYRILLIC": CYRILLIC}
_EXTENT = 0x110000
_P = np.uint64(0x9E3779B97F4A7C15)
_FIRST = 0x2200


def _same_sign(ch: str) -> str:
    """The usual sign(s) for one character, without touching raised forms or accents."""
    d = unicodedata.decomposition(ch)
    if d.startswith("<"):
        tag, *rest = d.split(" ")
        if tag not in _SAME_SIGN or (rest[0] == "0020" and len(rest) > 1):
            return ch
        return "".join(_same_sign(chr(int(x, 16))) for x in rest)
    n = unicodedata.normalize("NFC", ch)
    return "".join(map(_same_sign, n)) if n != ch else ch

#: Clusters of letter and marks that a worker remembers at most, about.
REMEMBERED = 200_000


class Tables:
    """Lookup tables over all code points, filled block by block as characters turn up."""

    def __init__(self) -> None:
        self.known = np.zeros(_EXTENT, np.bool_)
        self.kind = np.zeros(_EXTENT, np.uint8)
        self.script = np.zeros(_EXTENT, np.uint8)
        self.flag = np.zeros(_EXTENT, np.bool_)   # stored otherwise than in consistent form
        self.sign = np.arange(_EXTENT, dtype=np.uint32)  # one-to-one part of the form
        self.base = np.arange(_EXTENT, dtype=np.uint32)  # lower case, unmarked
        self.many: dict[int, str] = {}             # one-to-several part of the form
        self.long = np.zeros(_EXTENT, np.bool_)
        self.low = np.zeros(_EXTENT, np.bool_)     # small letters
        self.high = np.zeros(_EXTENT, np.bool_)    # capitals
        self.twin = {s: np.arange(_EXTENT, dtype=np.uint32) for s in (LATIN, GREEK, CYRILLIC)}
        self.alike = np.zeros(_EXTENT, np.bool_)
        self.mixed = scramble(np.arange(1, _EXTENT + 1, dtype=np.uint64))
        for row in LOOK_ALIKES:
            for ch in filter(None, row):
                self.alike[ord(ch)] = True
                for s, to in zip((LATIN, GREEK, CYRILLIC), row):
                    if to:
                        self.twin[s][ord(ch)] = ord(to)
        self.clusters: dict[bytes, tuple[bytes, bool]] = {}
        self.fill(np.arange(_FIRST, dtype=np.uint32))

    def fill(self, points: np.ndarray) -> None:
        for c in points.tolist():
            ch, cat = chr(c), unicodedata.category(chr(c))
            kind = 0
            if cat[0] == "L":
                kind = LETTER | VISIBLE
            elif cat[0] == "M" and not (0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF or c in (0x34F, 0x180B, 0x180C, 0x180D)):
                kind = MARK | VISIBLE
            elif ch.isspace() and cat in ("Zs", "Zl", "Zp", "Cc"):
                kind = SPACE
            elif cat in ("Cf", "Cc", "Mn") or c in (0x115F, 0x1160, 0x3164, 0xFFA0):
                kind = INVISIBLE
            elif cat[0] == "N":
                kind = DIGIT | VISIBLE
            elif cat != "Cn":
                kind = VISIBLE
            if c in (0x115F, 0x1160, 0x3164, 0xFFA0):
                kind = INVISIBLE
            self.kind[c] = kind
            form = "" if kind == INVISIBLE else " " if cat == "Zs" else _same_sign(ch)
            self.flag[c] = form != ch
            if len(form) == 1:
                self.sign[c] = ord(form)
            elif form:
                self.many[c] = form
                self.long[c] = True
            if kind & LETTER:
                bare = [x for x in unicodedata.normalize("NFD", form[0].lower()) if not unicodedata.category(x).startswith("M")]
                b = (bare or [ch])[0]
                self.base[c] = ord("σ" if b in "ςϲ" else b)
                name = unicodedata.name(form[0], "").split(" ")[0]
                self.low[c], self.high[c] = cat == "Ll", cat in ("Lu", "Lt")
                self.script[c] = _SCRIPTS.get(name, OTHER)
            self.known[c] = True

    def need(self, cp: np.ndarray) -> None:
        ok = self.known[cp]
        if not ok.all():
            self.fill(np.unique(cp[~ok]))
            grown = [ord(x) for c in np.unique(cp[self.long[cp]]).tolist() for x in self.many[c]]
            grown += self.sign[np.unique(cp)].tolist()
            rest = np.unique(np.array(grown, np.uint32))
            self.fill(rest[~self.known[rest]])


_tables: Tables | None = None


def tables() -> Tables:
    global _tables
    if _tables is None:
        _tables = Tables()
        _tables.need(np.array(sorted({ord(x) for v in _tables.many.values() for x in v} | set(_tables.sign[:_FIRST].tolist())), np.uint32))
    return _tables


def decode(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows, and row offsets into them; null rows have no code points."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if len(col) == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null("")
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    cp = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(cp) == len(raw):
        return cp, off - off[0]
    heads = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=heads[1:])
    return cp, heads[off - off[0]]


def encode(cp: np.ndarray, off: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """An Arrow string array of the rows ``cp[off[i]:off[i+1]]``."""
    size = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF), out=size[1:])
    data = cp.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    out = pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(size[off].astype(np.int64).tobytes()), pa.py_buffer(data))
    if valid is not None and not valid.all():
        out = pc.if_else(pa.array(valid), out, pa.scalar(None, pa.large_string()))
    return out.cast(pa.string())


def chunks(off: np.ndarray, points: int = 1_000_000):
    """Row ranges of about so many code points; a single longer row is a range of its own."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, min(n, int(np.searchsorted(off, off[i] + points, "right")) - 1))
        yield i, j
        i = j


def drop(cp: np.ndarray, off: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pos = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(keep, out=pos[1:])
    return cp[keep], pos[off]


def spread(cp: np.ndarray, off: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Replace signs; joined letters and the like become several."""
    wide = t.long[cp]
    if not wide.any():
        return t.sign[cp], off
    at = np.flatnonzero(wide)
    forms = [t.many[c] for c in cp[at].tolist()]
    reps = np.ones(len(cp), np.int64)
    reps[at] = [len(f) for f in forms]
    start = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(reps, out=start[1:])
    out = np.repeat(t.sign[cp], reps)
    body = np.frombuffer("".join(forms).encode("utf-32-le"), np.uint32)
    k = reps[at]
    idx = np.repeat(start[at] - (np.cumsum(k) - k), k) + np.arange(len(body))
    out[idx] = t.sign[body]
    return out, start[off]


def runs(member: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``member`` that stay inside a row."""
    n = len(member)
    edge = np.zeros(n + 1, np.bool_)
    edge[off] = True
    prev = np.empty(n, np.bool_)
    if n:
        prev[0] = False
        prev[1:] = member[:-1]
    first = member & (~prev | edge[:n])
    nxt = np.empty(n, np.bool_)
    if n:
        nxt[-1] = False
        nxt[:-1] = member[1:]
    last = member & (~nxt | edge[1:])
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def mend_scripts(cp: np.ndarray, start: np.ndarray, end: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Letters of mixed words in the script of the word; and which words are mixed.

    ``cp`` may hold marks inside the words.  The script of a word is that of most of its
    letters which have no look-alike, else of most letters (ties: Greek, Latin, Cyrillic).
    """
    if not len(start):
        return cp, np.zeros(0, np.bool_)
    scr = t.script[cp]
    idx = np.empty(2 * len(start), np.int64)
    idx[0::2], idx[1::2] = start, end
    pad = np.append(scr, np.uint8(0))
    seen = np.bitwise_or.reduceat(pad, idx)[0::2]
    mixed = (seen & (seen - 1)) != 0
    if mixed.any():
        cp = cp.copy()
        for w in np.flatnonzero(mixed).tolist():
            a, b = int(start[w]), int(end[w])
            s, part = scr[a:b], cp[a:b]
            sure = ~t.alike[part]
            best = max((GREEK, LATIN, CYRILLIC), key=lambda x: (int(((s == x) & sure).sum()), int((s == x).sum())))
            cp[a:b] = np.where((s != best) & (s != 0), t.twin[best][part], part)
    return cp, mixed


def clusters(cp: np.ndarray, off: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compose letters with the marks that follow them: new points, offsets, rows changed."""
    mark = (t.kind[cp] & MARK) != 0
    changed = np.zeros(len(off) - 1, np.bool_)
    if not mark.any():
        return cp, off, changed
    start, end = runs(mark, off)
    row = np.searchsorted(off, start, "right") - 1
    start = np.where(start > off[row], start - 1, start)  # with the letter before
    size = end - start
    drop_to = np.ones(len(cp), np.bool_)
    cp = cp.copy()
    if len(t.clusters) > REMEMBERED:
        t.clusters.clear()
    for n in np.unique(size).tolist():  # one gather per cluster length
        which = np.flatnonzero(size == n)
        body = cp[start[which][:, None] + np.arange(n)]
        kinds, back = np.unique(body, axis=0, return_inverse=True)
        back = back.reshape(-1)
        made = np.zeros((len(kinds), n), np.uint32)
        used = np.zeros(len(kinds), np.int64)
        diff = np.zeros(len(kinds), np.bool_)
        for k, pts in enumerate(kinds):
            key = pts.tobytes()
            if key not in t.clusters:
                text = key.decode("utf-32-le")
                form = unicodedata.normalize("NFC", text)
                t.clusters[key] = ((form if len(form) <= n else text).encode("utf-32-le"), form != text)
            got, d = t.clusters[key]
            pts2 = np.frombuffer(got, np.uint32)
            made[k, : len(pts2)], used[k], diff[k] = pts2, len(pts2), d
        t.need(made[made > 0])
        cp[start[which][:, None] + np.arange(n)] = made[back]
        drop_to[start[which][:, None] + np.arange(n)] = np.arange(n) < used[back][:, None]
        changed[row[which[diff[back]]]] = True
    cp, off = drop(cp, off, drop_to)
    return cp, off, changed


def consistent(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The consistent form of each row, and whether the row was stored otherwise."""
    t = tables()
    t.need(cp)
    flagged = t.flag[cp]
    hits = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(flagged, out=hits[1:])
    other = (hits[off[1:]] - hits[off[:-1]]) > 0
    gone = t.kind[cp] == INVISIBLE
    if gone.any():
        cp, off = drop(cp, off, ~gone)
    if other.any():
        cp, off = spread(cp, off, t)
    cp, off, made = clusters(cp, off, t)
    word = (t.kind[cp] & (LETTER | MARK)) != 0
    start, end = runs(word, off)
    cp, mixed = mend_scripts(cp, start, end, t)
    rows = np.searchsorted(off, start[mixed], "right") - 1
    other |= made
    other[rows] = True
    if len(rows):  # a letter of the right script may take up marks the other could not
        cp, off, _ = clusters(cp, off, t)
    return cp, off, other


_pow = np.ones(1, np.uint64)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> np.ndarray:
    global _pow
    if len(_pow) < n:
        m = max(n, 256, 2 * len(_pow))
        p = np.full(m, _P, np.uint64)
        p[0] = 1
        _pow = np.multiply.accumulate(p)
    return _pow


def hash_runs(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of back-to-back runs ``values[start[i]:start[i]+size[i]]``."""
    if not len(start):
        return np.zeros(0, np.uint64)
    place = np.arange(len(values), dtype=np.int64) - np.repeat(start, size)
    p = powers(int(size.max()) + 1)
    h = np.add.reduceat(tables().mixed[values] * p[place], start)
    return scramble(h + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Terms:
    """The terms of a batch: ``row``, 64-bit ``hash``, and their letters for ``text(which)``."""

    def __init__(self, cp: np.ndarray, off: np.ndarray) -> None:
        t = tables()
        t.need(cp)
        kind = t.kind[cp]
        keep = (kind != INVISIBLE) & ((kind & MARK) == 0)
        if not keep.all():
            cp, off = drop(cp, off, keep)
        if t.long[cp].any():
            cp, off = spread(cp, off, t)
        letter = (t.kind[cp] & LETTER) != 0
        start, end = runs(letter, off)
        size = end - start
        cp = cp[letter]
        self.start = np.cumsum(size) - size
        self.size = size
        cp, _ = mend_scripts(t.sign[cp], self.start, self.start + size, t)
        self.letters = t.base[cp]
        self.row = np.searchsorted(off, start, "right") - 1
        self.hash = hash_runs(self.letters, self.start, size)

    def text(self, which: np.ndarray) -> pa.Array:
        n = self.size[which]
        off = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=off[1:])
        idx = np.repeat(self.start[which] - off[:-1], n) + np.arange(off[-1])
        return encode(self.letters[idx], off)


def count_by_row(terms: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (term, row) pairs of a batch: index of a first occurrence, row, count."""
    order = np.argsort(terms.hash, kind="stable")  # rows ascend within a term
    h, r = terms.hash[order], terms.row[order]
    new = np.ones(len(h), np.bool_)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    return order[at], r[at], np.diff(np.append(at, len(h)))
