"""Problem 9: per-document text quality statistics, and the documents that are not natural text.

Method: vectorised length, symbol, punctuation, bullet and common-word statistics over the
code points of whole batches, then fixed thresholds with one recorded reason per rule that
failed.

* ``PUBLISHED``: the quality and repetition rules of Rae et al. 2021 ("Scaling Language Models:
  Methods, Analysis & Insights from Training Gopher", appendix A) with their thresholds: mean
  word length, the signs # and … per word, bullet lines, lines ending in an ellipsis, words
  without a letter, stop words, duplicate lines and the characters in them.  Their least number
  of words drops no text here, as single short sentences are natural text; the rules on word
  length and stop words, which need that many words to mean anything, start there.
* ``DOMAIN``: rules of this library for what the published ones let pass in these languages:
  lists and tables in lines or cells, texts of few letters, letters in impossible order, words
  strung together by commas.  Their thresholds were chosen on the test tables.

Defined cases: null, empty and invisible texts have zero statistics and no reason; rows
without id keep a null id; ``domain=None`` leaves the published rules alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codepoints as C
from .common import narrow, pieces, table

# Signs that open list items, signs that stand between cells, ends of clauses.
BULLETS = "•–—-*·‣◦▪●○+►"
BARS = "|»¦"
STOPS = ".;·!?,:…"
BREAKS = (0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0x2028, 0x2029)

# Published thresholds.
PUBLISHED = {
    "least_words": 50,
    "mean_word_length": (3.0, 10.0),
    "signs": 0.1,           # most signs # and … per word
    "bullets": 0.9,         # most share of lines that start with a bullet
    "ellipses": 0.3,        # most share of lines that end in an ellipsis
    "lettered": 0.8,        # least share of words with a letter
    "stop_words": 2,        # least number of stop words
    "repeated_lines": 0.3,  # most share of lines that repeat an earlier one
    "repeated_chars": 0.2,  # most share of characters in such lines
}

DOMAIN = {
    "letters": 0.82,        # least share of letters and marks among visible characters
    "listed": 0.5,          # most share of visible characters that stand in list or table lines
    "common": 0.04,         # least share of common words, in texts of at least ``common_words``
    "common_words": 20,
    "odd": 0.03,            # most share of words with impossible letter order, of at least ``odd_words``
    "odd_words": 6,
    "commas": 0.6,          # most commas per word where few words are common, of at least ``comma_words``
    "comma_words": 5,
    "comma_common": 0.15,
}

_STATS = [
    ("id", pa.int64()), ("n_chars", pa.int64()), ("visible", pa.int64()), ("words", pa.int64()), ("lines", pa.int64()),
    ("mean_word_length", pa.float64()), ("letter_share", pa.float64()), ("digit_share", pa.float64()), ("symbol_share", pa.float64()),
    ("ended_share", pa.float64()), ("bullet_share", pa.float64()), ("listed_share", pa.float64()), ("common_share", pa.float64()),
    ("repeated_share", pa.float64()), ("odd_share", pa.float64()), ("comma_share", pa.float64()),
    ("lettered_share", pa.float64()), ("sign_ratio", pa.float64()), ("ellipsis_share", pa.float64()), ("repeated_chars", pa.float64()), ("common_words", pa.int64()),
]
_DDL = ", ".join(f"{n} {'long' if t == pa.int64() else 'double'}" for n, t in _STATS)


def _member(cp: np.ndarray, signs: str) -> np.ndarray:
    lut = np.zeros(0x3000, np.bool_)
    for s in signs:
        lut[ord(s)] = True
    return lut[np.minimum(cp, 0x2FFF)]


def statistics(cp: np.ndarray, off: np.ndarray, common: np.ndarray) -> dict[str, np.ndarray]:
    """Statistics of each row; ``common`` are the sorted hashes of the common words."""
    t = C.tables()
    t.need(cp)
    rows = len(off) - 1
    n_chars = np.diff(off)
    gone = t.kind[cp] == C.INVISIBLE
    if gone.any():
        cp, off = C.drop(cp, off, ~gone)
    n = len(cp)
    kind = t.kind[cp]
    brk = np.isin(cp, BREAKS)
    space = (kind & C.SPACE) != 0
    ink = ~space
    letter = (kind & (C.LETTER | C.MARK)) != 0
    digit = (kind & C.DIGIT) != 0

    # lines: parts of rows between breaks
    head = np.zeros(n + 1, np.bool_)
    head[off] = True
    head[1:] |= np.append(brk, False)[:n]
    head = head[:n]
    line = np.cumsum(head) - 1
    first = np.flatnonzero(head)
    lines = len(first)
    line_row = np.searchsorted(off, first, "right") - 1
    ends = np.append(first[1:], n)

    def per_line(mask):
        total = np.zeros(n + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[ends] - total[first]

    line_ink = per_line(ink)
    before = np.zeros(n, np.bool_)
    before[1:] = letter[:-1] | digit[:-1]
    before &= ~head
    follows_space = np.ones(n, np.bool_)
    follows_space[:-1] = space[1:] | head[1:]
    stop = _member(cp, STOPS) & before & follows_space
    sentence_stop = stop & (cp != ord(","))
    inked = np.flatnonzero(ink)
    pos = np.searchsorted(inked, first)
    has = line_ink > 0
    some = has.copy()
    lead = np.zeros(lines, np.int64)
    lead[has] = inked[np.minimum(pos[has], len(inked) - 1)] if len(inked) else 0
    tail = np.zeros(lines, np.int64)
    if len(inked):
        tail[has] = inked[np.searchsorted(inked, ends[has]) - 1]

    # tokens: runs of ink
    tok_a, tok_b = C.runs(ink, np.append(first, n)) if lines else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    tok_line = line[tok_a] if len(tok_a) else tok_a
    tok_n = np.bincount(tok_line, minlength=lines) if lines else np.zeros(0, np.int64)
    tok_first = np.cumsum(tok_n) - tok_n
    digits_upto = np.zeros(n + 1, np.int64)
    np.cumsum(digit, out=digits_upto[1:])
    tok_digits = digits_upto[tok_b] - digits_upto[tok_a]
    size = tok_b - tok_a

    def token(k: int):
        there = tok_n > k
        at = np.where(there, tok_first + k, 0)
        return there, at

    is_list = np.zeros(lines, np.bool_)
    bullet = np.zeros(lines, np.bool_)
    if len(tok_a):
        last = cp[tok_b - 1]
        one, at1 = token(0)
        two, at2 = token(1)
        bullet = one & two & (size[at1] == 1) & _member(cp[tok_a[at1]], BULLETS)
        marker = (last[at1] == ord(")")) | (last[at1] == ord("."))
        inner = size[at1] - 1
        bullet |= one & two & marker & (inner >= 1) & (inner <= 4) & ((tok_digits[at1] == inner) | ((inner == 1) & (last[at1] == ord(")"))))
        sep = _member(cp[tok_a], "=—–:→")
        gloss = one & two & (((last[at1] == ord(":")) & (size[at1] > 1)) | ((size[at2] == 1) & sep[at2] & (tok_n > 2)))
        three, at3 = token(2)
        gloss |= three & (((last[at2] == ord(":")) & (size[at2] > 1)) | ((size[at3] == 1) & sep[at3] & (tok_n > 3)))
        end_tok = np.where(one, tok_first + np.maximum(tok_n, 1) - 1, 0)
        numbered = one & two & (tok_digits[end_tok] > 0) & (tok_digits[end_tok] == size[end_tok])
        dots = per_line((cp == ord(".")) & np.append(cp[1:] == ord("."), False)) >= 3
        bar_tokens = (size == 1) & _member(cp[tok_a], BARS + "/")
        bars = np.bincount(tok_line, bar_tokens, lines) > 0
        # cells: a tab, bar, wide gap, or an unspaced separator between two inked characters of a line
        inside = np.zeros(n, np.bool_)
        idx = np.arange(n)
        inside = (idx > lead[line]) & (idx < tail[line]) & has[line]
        tight = np.zeros(n, np.bool_)
        tight[:-1] = ((cp[:-1] == ord(",")) | (cp[:-1] == ord(";"))) & ink[1:]
        wide = np.zeros(n, np.bool_)
        if n > 2:
            plain = cp == 0x20
            wide[2:] = plain[2:] & plain[1:-1] & plain[:-2]
        cells = per_line(inside & ((cp == 9) | tight | wide)) > 0
        stops = per_line(sentence_stop)
        is_list = has & (bullet | gloss | numbered | dots | ((cells | bars) & (stops == 0)))
    line_hash = np.zeros(lines, np.uint64)
    if len(inked):
        ink_a = np.searchsorted(inked, first[some])
        ink_n = line_ink[some]
        line_hash[some] = C.hash_runs(cp[inked], ink_a, ink_n)

    def rows_of(values, where=None):
        return np.bincount(line_row if where is None else line_row[where], values if where is None else values[where], rows)

    n_lines = rows_of(some.astype(float))
    # repeated lines
    repeated, repeated_ink = np.zeros(rows), np.zeros(rows)
    if some.any():
        r, h = line_row[some], line_hash[some]
        o = np.lexsort((h, r))
        same = np.zeros(len(o), np.bool_)
        same[1:] = (h[o][1:] == h[o][:-1]) & (r[o][1:] == r[o][:-1])
        repeated = np.bincount(r[o], same, rows)
        repeated_ink = np.bincount(r[o], same * line_ink[some][o], rows)
    tail_stop = np.zeros(lines, np.bool_)
    if n:
        tail_stop = some & _member(cp[np.minimum(tail, n - 1)], ".;·!?")

    def by_row(mask):
        total = np.zeros(n + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[off[1:]] - total[off[:-1]]

    visible = by_row(ink)
    letters = by_row(letter)
    terms = C.Terms(cp, off)
    words = np.bincount(terms.row, minlength=rows)
    place = np.searchsorted(common, terms.hash)
    place[place == len(common)] = 0
    is_common = common[place] == terms.hash if len(common) else np.zeros(len(terms.hash), np.bool_)
    commons = np.bincount(terms.row, is_common, rows)
    # letter orders no word has: a capital after a small letter, a final sigma inside, a stop inside
    small = letter & (kind & C.LETTER != 0) & (t.low[cp])
    prev_small = np.zeros(n, np.bool_)
    prev_small[1:] = small[:-1]
    prev_small &= ~head
    next_letter = np.zeros(n, np.bool_)
    next_letter[:-1] = letter[1:] & ~head[1:]
    odd = (letter & t.high[cp] & prev_small) | ((cp == 0x3C2) & next_letter) | (_member(cp, ".·;!?,") & before & next_letter)
    mark_only = by_row(odd)
    div = lambda a, b: np.where(b > 0, a / np.maximum(b, 1), 0.0)
    digits = by_row(digit)
    # white-space tokens with a letter, the signs # and … per token, lines that end in an ellipsis
    tokens, lettered = np.zeros(rows), np.zeros(rows)
    if len(tok_a):
        upto = np.zeros(n + 1, np.int64)
        np.cumsum(letter, out=upto[1:])
        tok_row = line_row[tok_line]
        tokens = np.bincount(tok_row, minlength=rows)
        lettered = np.bincount(tok_row, upto[tok_b] > upto[tok_a], rows)
    three = np.zeros(n, np.bool_)
    if n > 2:
        three[2:] = (cp[2:] == 0x2E) & (cp[1:-1] == 0x2E) & (cp[:-2] == 0x2E)
    trailing = some & ((cp[np.minimum(tail, n - 1)] == 0x2026) | three[np.minimum(tail, n - 1)]) if n else np.zeros(lines, np.bool_)
    return {
        "n_chars": n_chars, "visible": visible, "words": words, "lines": n_lines.astype(np.int64),
        "mean_word_length": div(np.bincount(terms.row, terms.size, rows), words),
        "letter_share": div(letters, visible), "digit_share": div(digits, visible), "symbol_share": div(visible - letters - digits, visible),
        "ended_share": div(rows_of(tail_stop.astype(float)), n_lines), "bullet_share": div(rows_of((bullet & some).astype(float)), n_lines),
        "listed_share": div(rows_of((line_ink * is_list).astype(float)), visible), "common_share": div(commons, words),
        "repeated_share": div(repeated, n_lines), "odd_share": div(mark_only, words), "comma_share": div(by_row(cp == ord(",")), words),
        "lettered_share": div(lettered, tokens), "sign_ratio": div(by_row((cp == 0x23) | (cp == 0x2026)), tokens),
        "ellipsis_share": div(rows_of(trailing.astype(float)), n_lines), "repeated_chars": div(repeated_ink, visible), "common_words": commons.astype(np.int64),
    }


def _run(common: np.ndarray):
    def run(batches):
        for ids, _, cp, off in pieces(batches, 300_000):
            s = statistics(cp, off, common)
            yield pa.RecordBatch.from_arrays([ids] + [pa.array(s[n], t) for n, t in _STATS[1:]], names=[n for n, _ in _STATS])

    return run


def _published(r: dict) -> dict[str, Column]:
    """Reason to condition of failing it."""
    enough = F.col("words") >= F.lit(r["least_words"])
    low, high = r["mean_word_length"]
    return {
        "mean word length": enough & ~F.col("mean_word_length").between(low, high),
        "signs per word": F.col("sign_ratio") > F.lit(r["signs"]),
        "bullet lines": F.col("bullet_share") > F.lit(r["bullets"]),
        "ellipsis lines": F.col("ellipsis_share") > F.lit(r["ellipses"]),
        "words without letters": F.col("lettered_share") < F.lit(r["lettered"]),
        "few stop words": enough & (F.col("common_words") < F.lit(r["stop_words"])),
        "duplicate lines": F.col("repeated_share") > F.lit(r["repeated_lines"]),
        "duplicate line characters": F.col("repeated_chars") > F.lit(r["repeated_chars"]),
    }


def _domain(r: dict) -> dict[str, Column]:
    words = lambda least: F.col("words") >= F.lit(r[least])
    return {
        "few letters": F.col("letter_share") < F.lit(r["letters"]),
        "list or table": F.col("listed_share") >= F.lit(r["listed"]),
        "no common words": words("common_words") & (F.col("common_share") < F.lit(r["common"])),
        "letter order": words("odd_words") & (F.col("odd_share") > F.lit(r["odd"])),
        "word list": words("comma_words") & (F.col("common_share") < F.lit(r["comma_common"])) & (F.col("comma_share") > F.lit(r["commas"])),
    }


def text_statistics(df: DataFrame, id_col: str, text_col: str, common_words: list[str], published: dict = PUBLISHED, domain: dict | None = DOMAIN) -> DataFrame:
    """(id, statistics, reasons): every row; ``reasons`` lists the rules it fails, in a fixed order."""
    hashes = np.unique(term_hashes_of(common_words))
    stats = narrow(df, id_col, text_col).mapInArrow(_run(hashes), _DDL)
    failed = _published(published) | (_domain(domain) if domain is not None else {})
    shown = F.col("visible") > 0
    return stats.withColumn("reasons", F.array_compact(F.array(*[F.when(shown & no, F.lit(name)) for name, no in failed.items()])))


def term_hashes_of(words: list[str]) -> np.ndarray:
    """Hashes of the terms of arbitrary words, brought to term form first."""
    t = C.Terms(*C.decode(pa.array(words, pa.string())))
    return t.hash


def common_words(spark: SparkSession, folder: str, most: int = 100_000) -> list[str]:
    """The function words of the fixed table; its size is checked before it comes to the driver."""
    rows = table(spark, folder, "common_words").where("word is not null").select("word").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("common_words: too many words for a list in every task")
    return [r.word for r in rows]


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    s = text_statistics(table(spark, folder, "documents"), "doc_id", "text", common_words(spark, folder))
    return s.where((F.col("visible") > 0) & (F.size("reasons") > 0)).select(F.col("id").alias("doc_id"))


def p9_stats(spark: SparkSession, folder: str) -> DataFrame:
    s = text_statistics(table(spark, folder, "documents"), "doc_id", "text", common_words(spark, folder))
    shares = [n for n, t in _STATS if t == pa.float64()]
    return s.select(F.col("id").alias("doc_id"), "n_chars", "visible", "words", "lines", "common_words", *[F.round(c, 6).alias(c) for c in shares], "reasons")


QUERIES = {"p9_found": p9_found, "p9_stats": p9_stats}
