"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is halved down to leaves, the leaves of a whole batch are encoded together, and neighbours are joined up the tree. A join
re-encodes a window around the seam. The window grows until each of its edges stands at a cut that holds whatever stands around
it: between a letter and anything but a letter, a digit and anything but a digit, or anything but white space and white space.
No pre-token of the pattern contains such a place, so no merge crosses it, and the tokens outside the window are those of the
whole text. A text without such places grows the window to its ends: slower, and right. Decoding concatenates bytes up the tree.

Leaves are encoded through the same cuts: each distinct segment of a batch is encoded once and remembered, in at most ``memo``
entries, after which the memory is emptied. Segments are found by a hash and then compared letter by letter; should two have one hash, their batch is
encoded leaf by leaf instead.

Defined results: a null text has null tokens, an empty one none; rows that repeat are encoded each; what looks like a special token
is ordinary text.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from .words import mix, prefix_sums, slices, tidied

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=\P{White_Space})(?=\p{White_Space})")
_WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
_OTHER, _LETTER, _DIGIT, _SPACE, _UNSURE = range(5)
_TOP = 0x20000


@dataclass(frozen=True)
class Params:
    tokenizer: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    pattern: str = PATTERN  # the cuts above are proven for this pattern
    leaf_chars: int = 4096
    window_chars: int = 16  # the first window on each side of a seam
    slice_chars: int = 1 << 18
    memo: int = 150_000


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    kind = np.full(_TOP, _OTHER, dtype=np.uint8)
    for c in range(_TOP):
        cat = unicodedata.category(chr(c))
        kind[c] = _LETTER if cat[0] == "L" else _DIGIT if cat[0] == "N" else _UNSURE if cat == "Cn" else _OTHER
    kind[[ord(c) for c in _WHITE]] = _SPACE
    return kind


class Bpe:
    def __init__(self, p: Params, vocabulary: bytes) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.p = p
        self.enc = tiktoken.Encoding("own", pat_str=p.pattern, mergeable_ranks=ranks, special_tokens={})
        self.vocabulary = max(ranks.values()) + 1
        self.bytes = np.zeros(self.vocabulary, dtype=np.int64)
        for token, i in ranks.items():
            self.bytes[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.used = np.zeros(1 << 16, dtype=np.int32), 0
        self.table, self.rows = np.zeros((1 << 14, 5), dtype=np.int64), 0  # where its tokens start, how many they are, its bytes, where its letters start, how many they are
        self.letters, self.spelt = np.zeros(1 << 16, dtype=np.uint32), 0

    def _learn(self, segments: list[str], hashes: list[int]) -> np.ndarray:
        """Entries of the new segments. Those that white space around them can't change are encoded in one go, a line each."""
        size = np.array([len(x.encode()) for x in segments], dtype=np.int64)
        plain = np.array([not (x[-1].isspace() or x[:2].isspace()) for x in segments])
        count = np.zeros(len(segments), dtype=np.int64)
        lines = np.flatnonzero(plain)
        tokens = np.array(self.enc.encode_ordinary("\n".join([segments[k] for k in lines] + [""])), dtype=np.int32)
        ends = np.cumsum(self.bytes[tokens])
        last = np.searchsorted(ends, np.cumsum(size[lines] + 1) - 1)  # the last token of each line, before its line feed
        count[lines] = np.diff(last, prepend=-2) - 1
        single = [np.delete(tokens, last + 1)]
        for k in np.flatnonzero(~plain):
            single.append(np.array(self.enc.encode_ordinary(segments[k]), dtype=np.int32))
            count[k] = len(single[-1])
        order = np.concatenate([lines, np.flatnonzero(~plain)])
        new = np.concatenate(single)
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.rows + len(segments) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.flat[self.used : self.used + len(new)] = new
        n = count[order]
        start = np.empty(len(segments), dtype=np.int64)
        start[order] = self.used + np.cumsum(n) - n
        entry = np.arange(self.rows, self.rows + len(segments))
        letters = np.frombuffer("".join(segments).encode("utf-32-le"), dtype=np.uint32)
        while self.spelt + len(letters) > len(self.letters):
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
        self.letters[self.spelt : self.spelt + len(letters)] = letters
        length = np.array([len(x) for x in segments], dtype=np.int64)
        self.table[entry] = np.stack([start, count, size, self.spelt + np.cumsum(length) - length, length], axis=1)
        self.spelt += len(letters)
        self.known.update(zip(hashes, entry.tolist()))
        self.used += len(new)
        self.rows += len(segments)
        return entry

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all texts one after the other, where each text's tokens start: one entry more than texts)."""
        if len(self.known) > self.p.memo:
            self._forget()
        joined = "".join(texts)
        text_start = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) for t in texts], out=text_start[1:])
        if not joined:
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
        cps = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        kind = _kinds()[cps] if int(cps.max()) < _TOP else np.where(cps < _TOP, _kinds()[np.minimum(cps, _TOP - 1)], np.uint8(_UNSURE))
        a, b = kind[:-1], kind[1:]
        sure = (a != _UNSURE) & (b != _UNSURE)
        new = np.ones(len(cps), dtype=bool)
        new[1:] = sure & (a != b) & ((a == _LETTER) | (a == _DIGIT) | (b == _SPACE))
        new[text_start[:-1][text_start[:-1] < len(cps)]] = True
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(cps))
        prefix = prefix_sums(cps, start)
        distinct, first, which = np.unique(mix(prefix[end] - prefix[start]), return_index=True, return_inverse=True)
        get = self.known.get
        entry = np.array([get(x, -1) for x in distinct.tolist()], dtype=np.int64)
        new = np.flatnonzero(entry < 0)
        if len(new):
            s, e = start[first[new]].tolist(), end[first[new]].tolist()
            entry[new] = self._learn([joined[x:y] for x, y in zip(s, e)], distinct[new].tolist())
        length, own = self.table[entry, 4][which], self.table[entry, 3][which]
        if (length != end - start).any() or (self.letters[np.repeat(own - start, length) + np.arange(len(cps))] != cps).any():  # two segments of one hash
            each = [np.array(self.enc.encode_ordinary(t), dtype=np.int32) for t in texts]
            return np.concatenate(each), np.append(0, np.cumsum([len(t) for t in each]))
        n, at = self.table[entry, 1][which], self.table[entry, 0][which]
        ends = np.cumsum(n)
        tokens = self.flat[np.repeat(at - ends + n, n) + np.arange(int(ends[-1]))]
        seg = np.searchsorted(start, text_start)
        return tokens, np.append(0, ends)[seg]

    def join(self, text: str, a: int, m: int, b: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Tokens of text[a:b] from those of text[a:m] and text[m:b]."""
        w = self.p.window_chars
        while True:
            x, y = max(a, m - w), min(b, m + w)
            near = text[max(a, x - 1) : min(b, y + 1)]
            cuts = [max(a, x - 1) + c.start() for c in _CUT.finditer(near)]
            lo = max((c for c in cuts if c <= m), default=a if x == a else None)
            hi = min((c for c in cuts if c >= m), default=b if y == b else None)
            if lo is not None and hi is not None:
                break
            w *= 2
        if lo == hi:
            return np.concatenate([left, right])
        i = self._tokens_of(left[::-1], len(text[lo:m].encode()))
        j = self._tokens_of(right, len(text[m:hi].encode()))
        return np.concatenate([left[: len(left) - i], np.array(self.enc.encode_ordinary(text[lo:hi]), dtype=np.int32), right[j:]])

    def _tokens_of(self, tokens: np.ndarray, size: int) -> int:
        """How many of the first tokens make up so many bytes."""
        if not size:
            return 0
        w = 16
        while True:
            ends = np.cumsum(self.bytes[tokens[:w]])
            if ends[-1] >= size or w >= len(tokens):
                k = int(np.searchsorted(ends, size))
                if k == len(ends) or ends[k] != size:
                    raise AssertionError("a cut isn't a token's edge")
                return k + 1
            w *= 4

    def spans(self, a: int, b: int) -> Iterator[tuple[int, int]]:
        """The leaves of text[a:b], from left to right."""
        if b - a <= self.p.leaf_chars:
            yield a, b
        else:
            yield from self.spans(a, (a + b) // 2)
            yield from self.spans((a + b) // 2, b)

    def _reduce(self, text: str, a: int, b: int, leaves: Iterator[np.ndarray]) -> np.ndarray:
        if b - a <= self.p.leaf_chars:
            return next(leaves)
        m = (a + b) // 2
        left = self._reduce(text, a, m, leaves)
        return self.join(text, a, m, b, left, self._reduce(text, m, b, leaves))

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        parts = [[t[a:b] for a, b in self.spans(0, len(t))] for t in texts]
        tokens, at = self.encode_flat([x for p in parts for x in p])
        leaf = iter(tokens[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist()))
        return [self._reduce(t, 0, len(t), leaf) for t in texts]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]

    def decode(self, tokens: np.ndarray) -> bytes:
        if len(tokens) <= self.p.leaf_chars:
            return self.enc.decode_bytes(tokens.tolist())
        m = len(tokens) // 2
        return self.decode(tokens[:m]) + self.decode(tokens[m:])


_made: dict[Params, Bpe] = {}


def vocabulary(p: Params) -> bytes:
    with open(p.tokenizer, "rb") as f:
        return f.read()


def sent(spark: SparkSession, p: Params) -> Broadcast[bytes]:
    """The vocabulary's file (one or two MB) for the executors, which need not have it."""
    return spark.sparkContext.broadcast(vocabulary(p))


def bpe(p: Params, file: bytes | None = None) -> Bpe:
    """The encoder of this process."""
    if p not in _made:
        if len(_made) > 1:
            _made.clear()
        _made[p] = Bpe(p, vocabulary(p) if file is None else file)
    return _made[p]


def encoded(texts: pa.Array, p: Params, file: bytes | None = None) -> Iterator[tuple[int, pa.Array, list[str | None], list[np.ndarray]]]:
    """(first row, slice, its texts, their tokens), slice by slice; null counts as empty."""
    b = bpe(p, file)
    for at, part in slices(texts, p.slice_chars):
        own = part.to_pylist()
        yield at, part, own, b.encode_batch([t or "" for t in own])


def encode(docs: DataFrame, p: Params = Params(), verify: bool = True) -> DataFrame:
    """(doc_id, tokens, n_tokens, round_trip) of every row of docs; round_trip says that decoding gives the text's bytes again (null unless
    ``verify``, and for null texts). Encoded where the document is read; nothing is shuffled."""
    file = sent(docs.sparkSession, p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bpe(p, file.value)
        for batch in batches:
            for at, part, texts, tokens in encoded(batch.column(1), p, file.value):
                n = np.array([len(t) for t in tokens], dtype=np.int32)
                null = np.array([t is None for t in texts], dtype=bool)
                offsets = pa.array(np.append(0, np.cumsum(n)).astype(np.int32), mask=np.append(null, False))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(tokens), pa.int32()))
                same = pa.array([b.decode(k) == t.encode() if verify and t is not None else None for t, k in zip(texts, tokens)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), lists, pa.array(n, mask=null), same], names=["doc_id", "tokens", "n_tokens", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidied(run), "doc_id long, tokens array<int>, n_tokens int, round_trip boolean")


def decode(rows: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, text) from (doc_id, tokens): null for null; bytes that are no UTF-8 become U+FFFD."""
    file = sent(rows.sparkSession, p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bpe(p, file.value)
        for batch in batches:
            text = [None if t is None else b.decode(np.array(t, dtype=np.int32)).decode(errors="replace") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), F.col("tokens").cast("array<int>")).mapInArrow(tidied(run), "doc_id long, text string")
