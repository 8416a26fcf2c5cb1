"""Problem 7: encoding of a corpus with a public byte-level BPE tokenizer.

Method: prefix-sharing trie traversal.  The words of a batch (the pieces of the tokenizer's
split pattern) are reduced to the distinct ones not met before.  In sorted order these are
the depth-first traversal of their trie: the stack holds, for every prefix on the current
path, the last token of its encoding, and only the part that differs from the word before
is computed.  The last token of a prefix is the one vocabulary entry ending there that is
compatible with the last token of what stands before it, i.e. the merges of the two taken
together would not have joined anything across their border.  A word's encoding is read
off its path backwards.

Defined cases: null and empty texts give an empty list; look-alikes of control tokens are
ordinary text; any text can be encoded, as all 256 bytes are tokens.
"""

from __future__ import annotations

import json
import os
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import narrow, table

#: Folder of the public vocabulary files; never part of this repository.
TOKENIZERS = os.environ.get("STEMMATA_TOKENIZERS", "/opt/tokenizers")
#: Distinct words a worker remembers at most.
REMEMBERED = 400_000
#: Pairs of tokens it remembers at most, about.
REMEMBERED_PAIRS = 2_000_000

_W = r"\p{White_Space}"
# Fixed value: the published split pattern of the vocabulary, with white space by its Unicode property.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_W}\p{{L}}\p{{N}}]+|{_W}+(?!\P{{White_Space}})|{_W}+"


def _byte_signs() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 as itself, the rest from U+0100 on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens by their bytes, and the two tokens each was merged from; ids in order of merging."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        sign = _byte_signs()
        to_bytes = lambda s: bytes(sign[c] for c in s)
        self.ids: dict[bytes, int] = {}
        for text, i in model["vocab"].items():
            if all(c in sign for c in text):
                self.ids[to_bytes(text)] = i
        n = max(self.ids.values()) + 1
        self.left, self.right = list(range(n)), list(range(n))
        self.size = [1] * n
        self.joined: dict[tuple[int, int], int] = {}
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            x, y = self.ids[to_bytes(a)], self.ids[to_bytes(b)]
            z = self.ids[to_bytes(a + b)]
            self.joined[x, y] = z
            self.left[z], self.right[z] = x, y
        lengths: dict[bytes, set[int]] = {}
        for tok, i in self.ids.items():
            self.size[i] = len(tok)
            if i < n and len(tok) > 1:
                lengths.setdefault(tok[-2:], set()).add(len(tok))
        #: lengths of the tokens by their last two bytes, longest first
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in lengths.items()}
        self.fits: dict[int, bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Would the merges leave the border between tokens a and b alone?"""
        key = a << 20 | b
        got = self.fits.get(key)
        if got is None:
            got = self.fits[key] = self._compatible(a, b)
        return got

    def _compatible(self, a: int, b: int) -> bool:
        bound = 1 << 40  # a merge across the border counts only if it comes before this rank
        while True:
            z = self.joined.get((a, b))
            if z is not None and z < bound:
                return False
            # undo the later of the two merges; the border then lies between smaller tokens
            if a > b and self.left[a] != a:
                bound, a = a, self.right[a]
            elif self.left[b] != b:
                bound, b = b + 1, self.left[b]
            elif self.left[a] != a:
                bound, a = a, self.right[a]
            else:
                return True

    def encode_sorted(self, words: list[bytes]) -> list[list[int]]:
        """Encodings of distinct words in ascending order, walking their trie depth first."""
        ids, lengths, size, compatible = self.ids, self.lengths, self.size, self.compatible
        fits = self.fits
        out, path, before = [], [-1], b""
        for word in words:
            n, m = len(word), min(len(word), len(before))
            same = 0
            while same < m and word[same] == before[same]:
                same += 1
            del path[same + 1 :]
            for end in range(same + 1, n + 1):
                found = -1
                if end > 1:
                    for k in lengths.get(word[end - 2 : end], ()):
                        if k <= end:
                            tok = ids.get(word[end - k : end])
                            if tok is not None:
                                if k == end:
                                    found = tok
                                    break
                                prev = path[end - k]
                                ok = fits.get(prev << 20 | tok)
                                if ok or (ok is None and compatible(prev, tok)):
                                    found = tok
                                    break
                path.append(found if found >= 0 else ids[word[end - 1 : end]])
            at, enc = n, []
            while at:
                enc.append(path[at])
                at -= size[path[at]]
            enc.reverse()
            out.append(enc)
            before = word
        return out


class Encoder:
    """Encodes batches of texts; remembers a bounded number of distinct words."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.split = regex.compile(PATTERN).findall
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.start = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.int32)

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Places of all words of all texts, and the number of words of each text."""
        parts = [self.split(t) if t else [] for t in texts]
        each = np.fromiter(map(len, parts), np.int64, len(parts))
        words = list(chain.from_iterable(parts))
        if len(self.known) > REMEMBERED:
            self.clear()
        if len(self.vocabulary.fits) > REMEMBERED_PAIRS:
            self.vocabulary.fits.clear()
        place = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(place < 0).tolist()
        if missing:
            new = sorted({words[i] for i in missing}, key=str.encode)
            made = self.vocabulary.encode_sorted([w.encode() for w in new])
            n = len(self.known)
            self.known.update(zip(new, range(n, n + len(new))))
            sizes = np.fromiter(map(len, made), np.int64, len(made))
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(made), np.int32, int(sizes.sum()))])
            place[missing] = [self.known[words[i]] for i in missing]
        return place, each

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        place, each = self.words(texts)
        first = self.start[place]
        size = self.start[place + 1] - first
        ends = np.cumsum(size)
        idx = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - size), size)
        done = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(each)])]
        return pa.ListArray.from_arrays(pa.array(done.astype(np.int32)), pa.array(self.flat[idx]))

    def count(self, texts: list[str | None]) -> np.ndarray:
        place, each = self.words(texts)
        size = np.concatenate([[0], np.cumsum(self.start[place + 1] - self.start[place])])
        return np.diff(size[np.concatenate([[0], np.cumsum(each)])])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker process for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _parts(batch: pa.RecordBatch, points: int = 1_000_000):
    """Slices of a batch of about so many bytes of text."""
    size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + points, "right")))
        yield batch.slice(i, j - i)
        i = j


def _encode(path: str):
    def run(batches):
        enc = encoder(path)
        for b in batches:
            for part in _parts(b):
                yield pa.RecordBatch.from_arrays([part.column(0), enc.encode(part.column(1).to_pylist())], names=["id", "ids"])

    return run


def _count(path: str):
    def run(batches):
        enc = encoder(path)
        for b in batches:
            for part in _parts(b):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(enc.count(part.column(1).to_pylist()))], names=["id", "n_tokens"])

    return run


def encode(df: DataFrame, id_col: str, text_col: str, vocabulary: str = "byte_bpe_50k.json", folder: str = TOKENIZERS) -> DataFrame:
    """(id, ids): every row, with the token ids of its text."""
    return narrow(df, id_col, text_col).mapInArrow(_encode(f"{folder}/{vocabulary}"), "id long, ids array<int>")


def token_counts(df: DataFrame, id_col: str, text_col: str, vocabulary: str = "byte_bpe_50k.json", folder: str = TOKENIZERS) -> DataFrame:
    """(id, n_tokens): every row, with the number of tokens of its text."""
    return narrow(df, id_col, text_col).mapInArrow(_count(f"{folder}/{vocabulary}"), "id long, n_tokens long")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode(table(spark, folder, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "ids")


QUERIES = {"p7_ids": p7_ids}
