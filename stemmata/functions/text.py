"""Column functions on text: normal form, tokens, distances, identifiers, transliteration.

All of them are built-in expressions except ``normalize_words``, which needs NFKD and is an
Arrow-batched pandas UDF (Spark has no Unicode normalisation).
"""

from __future__ import annotations

import re
import sys
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"([\p{L}\p{N}_]+)"
#: White space by its Unicode property and the four separators U+001C to U+001F, spelt out: faster than (?U)\s.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
_SEP = "\u0001"

# Latin letters and the Greek letters typed by them.
LATIN_KEYS = "abgdezhqiklmnxoprtufcyw"
GREEK_KEYS = "αβγδεζηθικλμνξοπρτυφχψω"


def blank_to_null(c: Column) -> Column:
    return F.when(c == "", None).otherwise(c)


def first_filled(*cols: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def strip_milestones(c: Column) -> Column:
    """Without ``(12)`` and ``[3]``, white space collapsed and trimmed."""
    bare = F.regexp_replace(c, r"[\(\[][0-9]+[\)\]]", "")
    return F.trim(F.regexp_replace(bare, SPACE, " "))


def words(c: Column) -> Column:
    """Maximal runs of letters, numbers and underscores of the raw text."""
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(1))


#: Runs of characters of a combining class.
_MARKS = re.compile("[" + "".join(re.escape(chr(c)) for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))) + "]+")


def _normal(text: str) -> str:
    return text.lower() if text.isascii() else _MARKS.sub("", unicodedata.normalize("NFKD", text).lower())


@F.pandas_udf(T.StringType())
def normalize_text(s: pd.Series) -> pd.Series:
    """NFKD, lower case, without characters of a combining class; null stays null."""
    return s.map(_normal, na_action="ignore")


@F.arrow_udf(T.ArrayType(T.StringType()))
def _normal_words(lists: pa.Array) -> pa.Array:
    flat = lists.flatten().dictionary_encode()
    normal = pa.array(map(_normal, flat.dictionary.to_pylist()), pa.string()).take(flat.indices)
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    upto = np.zeros(len(lists) + 1, np.int32)
    np.cumsum(size, out=upto[1:])
    return pa.ListArray.from_arrays(pa.array(upto), normal, mask=lists.is_null() if lists.null_count else None)


def normalize_words(array: Column) -> Column:
    """Every word of an array in normal form; each distinct word of a batch is brought into it once."""
    return _normal_words(array)


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """``1 - distance / (length a + length b)``; two empty words are equal."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(a, b) / total)


def word_match(a: Column, b: Column, threshold: float) -> Column:
    """Equal, or a ratio of at least ``threshold`` that the lengths alone do not rule out."""
    total = F.length(a) + F.length(b)
    reachable = F.try_divide(F.abs(F.length(a) - F.length(b)), total) <= F.lit(1.0 - threshold)
    return (a == b) | (reachable & (levenshtein_ratio(a, b) >= F.lit(threshold)))


def zero_fill(c: Column, width: int) -> Column:
    """Left-padded with zeros; longer values are left alone."""
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def urn(author: Column, work: Column) -> Column:
    return F.concat(F.lit("urn:cts:greekLit:tlg"), author, F.lit(".tlg"), work)


def latin_to_greek(c: Column) -> Column:
    """Greek letters for the Latin keys they are typed with; an s that ends a word is final."""
    inner = F.regexp_replace(F.lower(c), r"s(?=[a-z])", "σ")
    return F.translate(F.regexp_replace(inner, "s", "ς"), LATIN_KEYS, GREEK_KEYS)


def typed_in_greek(text: str) -> str:
    """``latin_to_greek`` of one string."""
    low = text.lower()
    ends = "".join("ς" if c == "s" and not ("a" <= low[k + 1 : k + 2] <= "z") else "σ" if c == "s" else c for k, c in enumerate(low))
    return ends.translate(str.maketrans(LATIN_KEYS, GREEK_KEYS))


def bare_greek(text: str) -> str:
    """NFKD without U+0300 to U+036F, small final sigmas as the other one, then lower case."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not "\u0300" <= c <= "\u036f")
    return bare.replace("ς", "σ").lower()


@F.pandas_udf(T.StringType())
def strip_greek(s: pd.Series) -> pd.Series:
    """``bare_greek`` of a column; null stays null."""
    return s.map(bare_greek, na_action="ignore")


def first_script(c: Column) -> Column:
    """``grc`` or ``la`` by the first Greek or ASCII letter, else null."""
    ch = F.regexp_extract(c, "([Ͱ-Ͽἀ-῿A-Za-z])", 1)
    return F.when(ch.rlike("[A-Za-z]"), "la").when(ch != "", "grc")


def viaf_curie(c: Column) -> Column:
    """``viaf:<digits>`` from the last part of a path, else null."""
    last = F.regexp_extract(F.regexp_replace(c, "/+$", ""), r"([^/]*)$", 1)
    return F.when(last.rlike("^[0-9]+$"), F.concat(F.lit("viaf:"), last))


def expand_curie(c: Column, prefixes: dict[str, str]) -> Column:
    """The IRI of ``prefix:rest`` for a known prefix; IRIs and other values stay as they are."""
    known = F.create_map(*[x for k, v in prefixes.items() for x in (F.lit(k), F.lit(v))])
    base = F.try_element_at(known, F.substring_index(c, ":", 1))
    return F.when(c.startswith("http") | ~F.contains(c, F.lit(":")) | base.isNull(), c).otherwise(F.concat(base, F.regexp_replace(c, "^[^:]*:", "")))


def exact_work(q: Column) -> Column:
    """struct(author_id, work_id) of a query ``number.number`` that names one work, else null."""
    pattern = r"^([0-9]{1,4})\.([0-9]{3})$"
    t = F.trim(q)
    return F.when(t.rlike(pattern), F.struct(F.lpad(F.regexp_extract(t, pattern, 1), 4, "0").alias("author_id"), F.regexp_extract(t, pattern, 2).alias("work_id")))


def quote_url(c: Column) -> Column:
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def json_quote(c: Column) -> Column:
    """A JSON string literal without escaping letters beyond ASCII."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'^\{"v":(.*)\}$', 1)


def json_object(**fields: Column) -> Column:
    """A JSON object of fields that are JSON already; null fields are left out."""
    parts = [F.concat(F.lit(f'"{k}":'), v) for k, v in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def json_one_or_list(values: Column) -> Column:
    """JSON of an array of strings, each once: null if empty, the string itself if there is one, else a list."""
    each = F.transform(F.array_distinct(F.array_compact(values)), json_quote_text)
    return F.when(F.size(each) == 1, F.element_at(each, 1)).when(F.size(each) > 1, F.concat(F.lit("["), F.array_join(each, ","), F.lit("]")))


def json_quote_text(c: Column) -> Column:
    """``json_quote`` for use inside lambdas: quotation marks, backslashes and control characters."""
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for sign, code in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(sign), F.lit(code))
    return F.concat(F.lit('"'), c, F.lit('"'))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit("0%")).otherwise(F.format_string("%.1f%%", F.round(100.0 * part / whole, 1)))


def ordinal(n: Column) -> Column:
    """1st 2nd 3rd, everything else with th."""
    return F.concat(n.cast("string"), F.when(n == 1, "st").when(n == 2, "nd").when(n == 3, "rd").otherwise("th"))


def _year(c: Column) -> Column:
    y = F.regexp_extract(F.coalesce(c, F.lit("")), r"^(-?[0-9]{1,4})-[0-9]{2}-[0-9]{2}", 1)
    return F.when(y == "", None).otherwise(y.cast("int"))


def format_era(birth: Column, death: Column) -> Column:
    """Centuries of a life from ISO dates, e.g. ``1st–2nd c. A.D.``.

    Two years before Christ give an ascending range that always ends in th; with only one
    year, or one on either side, the first one known speaks alone.
    """
    b, d = _year(birth), _year(death)
    cb, cd = ((F.abs(y) + 99) / 100 for y in (b, d))
    cb, cd = F.floor(cb).cast("int"), F.floor(cd).cast("int")
    lo, hi = F.least(cb, cd), F.greatest(cb, cd)
    span = lambda name, era: F.concat(name(lo), F.when(lo != hi, F.concat(F.lit("–"), name(hi))).otherwise(""), F.lit(era))
    always = lambda n: F.concat(n.cast("string"), F.lit("th"))
    alone, year = F.coalesce(cb, cd), F.coalesce(b, d)
    return (
        F.when((b < 0) & (d < 0), span(always, " c. B.C."))
        .when((b >= 0) & (d >= 0), span(ordinal, " c. A.D."))
        .when(year.isNotNull(), F.concat(ordinal(alone), F.when(year < 0, " c. B.C.").otherwise(" c. A.D.")))
    )


# Abbreviations of genres that may close an author's name.
GENRES = (
    "hist.", "phil.", "comic.", "trag.", "epic.", "gramm.", "lyr.", "rhet.", "eccl.", "med.", "soph.", "poeta", "theol.", "eleg.", "alchem.", "epigr.",
    "iamb.", "geogr.", "orat.", "math.", "astrol.", "apol.", "perieg.", "astron.", "erot.", "mech.", "paradox.", "biogr.", "tact.", "myth.",
    "chronogr.", "parodius", "geom.", "paroemiogr.", "epist.", "epistulae", "epistula", "mus.", "fab.", "lexicogr.", "lex.", "pharmac.", "iatr.",
    "dialect.", "scr.", "poet.", "et",
)


def peel_epitheton(display: Column) -> Column:
    """struct(name, epitheton): the trailing genre words of a display name, or null if there are none."""
    tokens = F.filter(F.split(F.trim(display), r"(?U)\s+"), lambda t: t != "")
    is_genre = lambda t: F.regexp_replace(F.lower(t), r"^[<>()\[\],]+|[<>()\[\],]+$", "").isin(*GENRES)
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("open"))
    step = lambda acc, t: F.struct((acc["n"] + F.when(acc["open"] & is_genre(t), 1).otherwise(0)).alias("n"), (acc["open"] & is_genre(t)).alias("open"))
    tail = F.aggregate(F.reverse(tokens), start, step)["n"]
    kept = F.size(tokens) - tail
    name = F.when(tail == 0, F.trim(display)).otherwise(F.array_join(F.slice(tokens, 1, kept), " "))
    return F.when(display.isNotNull(), F.struct(name.alias("name"), F.when(tail > 0, F.array_join(F.slice(tokens, kept + 1, F.greatest(tail, F.lit(1))), " ")).alias("epitheton")))


def digits(c: Column, width: int) -> Column:
    """The first digits of an identifier, zero-filled; null without digits."""
    d = F.regexp_extract(F.coalesce(c, F.lit("")), "([0-9]+)", 1)
    return F.when(d == "", None).otherwise(zero_fill(d, width))
