"""Cutting texts into chunks: by paragraphs, sentences and, where these are too long, by size.

Lengths count UTF-16 code units. Inside, a text is held as a string of code units, so that lengths and slices are those of Python; marks
beyond the basic plane count as characters of their own.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import stream
from ..functions.languages import char_limit
from ..functions.text import WS

_GRAPHEME = regex.compile(r"(?:[\ud800-\udbff][\udc00-\udfff]|\P{M})\p{M}*|\p{M}+")
_MARKS = regex.compile(r"^\p{M}+")
_SENTENCE = re.compile("(?<=[.!?।。！？])" + WS + "+")
_EDGES = re.compile(f"\\A{WS}+|{WS}+\\Z")
_SPACE = re.compile(WS)


def units(text: str) -> str:
    """The text with a character for each code unit."""
    if text.isascii() or max(text) < "\U00010000":
        return text
    raw = text.encode("utf-16-le", "surrogatepass")
    return "".join(map(chr, memoryview(raw).cast("H")))


def whole(text: str) -> str:
    """The text back from its code units."""
    return text if text.isascii() else text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _trim(text: str) -> str:
    return _EDGES.sub("", text)


@dataclass(frozen=True)
class Chunker:
    """``size`` characters a chunk, or as many as ``token_limit`` tokens of the text's language have; neighbours share ``overlap`` characters at most."""

    size: float | None = None
    overlap: int = 75
    token_limit: float | None = None
    prefix: Callable[[dict], str | None] | None = None
    segment: Callable[[str, str], str] | None = None  # puts blanks between words
    segments: Callable[[str], bool] | None = None  # whether it does so for a language

    def __post_init__(self) -> None:
        name, given = ("token_limit", self.token_limit) if self.token_limit is not None else ("size", 512 if self.size is None else self.size)
        if not given > 0:
            raise ValueError(f"{name} must be a positive number, not {given}")

    def limit(self, language: str | None) -> int:
        if self.token_limit is None:
            return int(self.size or 512)
        return char_limit(language, self.token_limit)

    def tail(self, text: str) -> str:
        """What the next chunk repeats of a chunk."""
        if self.overlap <= 0 or len(text) <= self.overlap:
            return ""
        end = text[-self.overlap :]
        if "\udc00" <= end[0] <= "\udfff":
            end = end[1:]
        end = _MARKS.sub("", end)
        return end.partition(" ")[2] if " " in end else end

    def chunk(self, text: str, metadata: dict | None = None) -> list[str]:
        """The chunks in order."""
        metadata = metadata or {}
        text = units(text)
        if not _trim(text):
            return []
        size, out, held = self.limit(metadata.get("language")), [], ""
        for paragraph in _paragraphs(text):
            if len(held) + len(paragraph) + 1 <= size:
                held = f"{held}\n\n{paragraph}" if held else paragraph
                continue
            if held:
                out.append(_trim(held))
                held = self.tail(out[-1])
            if len(paragraph) > size:
                made = list(self._sentences(paragraph, size))
                out += made
                held = self.tail(made[-1]) if made else ""
            else:
                held = f"{held} {paragraph}" if held else paragraph
        if _trim(held):
            out.append(_trim(held))
        return self._labelled(out, metadata)

    def chunk_segmented(self, text: str, metadata: dict | None = None) -> list[str]:
        """As ``chunk``, but paragraphs that are too long are cut between words as the segmenter finds them."""
        metadata = metadata or {}
        language = metadata.get("language")
        if not (self.segment and self.segments and language and self.segments(language)):
            return self.chunk(text, metadata)
        text = units(text)
        size, out, held = self.limit(language), [], ""
        for paragraph in _paragraphs(text) if _trim(text) else []:
            if len(held) + len(paragraph) + 2 <= size:
                held = f"{held}\n\n{paragraph}" if held else paragraph
                continue
            if held:
                out.append(_trim(held))
                held = ""
            if len(paragraph) > size:
                out += self._packed(_words(paragraph, units(self.segment(whole(paragraph), language)), size), size)
            else:
                held = paragraph
        if _trim(held):
            out.append(_trim(held))
        return self._labelled(out, metadata)

    def _labelled(self, chunks: list[str], metadata: dict) -> list[str]:
        label = self.prefix(metadata) if self.prefix and chunks else None
        chunks = [whole(c) for c in chunks]
        return [c if c.startswith(label) else f"{label} {c}" for c in chunks] if label else chunks

    def _sentences(self, text: str, size: int) -> Iterator[str]:
        held = ""
        for sentence in _SENTENCE.split(text):
            if len(held) + len(sentence) + 1 <= size:
                held = f"{held} {sentence}" if held else sentence
                continue
            todo = sentence
            if held:
                yield _trim(held)
                again = self.tail(_trim(held))
                todo = f"{again} {sentence}" if again else sentence
            held = todo
            if len(todo) > size:
                held = ""
                for g in _GRAPHEME.findall(todo):
                    if len(held) + len(g) > size:
                        yield _trim(held)
                        again = self.tail(held)
                        held = again if len(again) < size else ""
                    held += g
        if _trim(held):
            yield _trim(held)

    def _packed(self, words: list[str], size: int) -> Iterator[str]:
        held: list[str] = []
        for w in words:
            if held and sum(map(len, held)) + len(w) > size:
                if text := _trim("".join(held)):
                    yield text
                held = self._last(held)
            held.append(w)
        if text := _trim("".join(held)):
            yield text

    def _last(self, words: list[str]) -> list[str]:
        """The last words, at least one, that the overlap holds."""
        n, total = 0, 0
        for w in reversed(words if self.overlap > 0 else []):
            if n and total + len(w) > self.overlap:
                break
            n, total = n + 1, total + len(w)
        return words[len(words) - n :]


def _paragraphs(text: str) -> list[str]:
    return [p for p in re.split("\n\n+", text) if _trim(p)]


def _words(text: str, segmented: str, size: int) -> list[str]:
    """The text cut where the segmented one has blanks; words that are too long are cut into graphemes."""
    ends, n = set(), 0
    for c in segmented:
        if _SPACE.match(c):
            ends.add(n)
        else:
            n += 1
    out, held, n = [], "", 0
    for c in text:
        held += c
        if not _SPACE.match(c):
            n += 1
            if n in ends:
                out.append(held)
                held = ""
    if held:
        out.append(held)
    return [g for w in out for g in (_GRAPHEME.findall(w) if len(w) > size else [w])]


def chunk_frame(docs: DataFrame, chunker: Chunker = Chunker(), segmented: bool = False) -> DataFrame:
    """(id, chunk_index, content) of each row of (id, text, language); nothing is shuffled. A null text has no chunks."""
    cut = chunker.chunk_segmented if segmented else chunker.chunk

    arrow_id = to_arrow_type(docs.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in stream.slices(b.column(1)):
                rows, number, content = [], [], []
                for n, (t, lang) in enumerate(zip(texts.to_pylist(), b.column(2).slice(at, len(texts)).to_pylist()), at):
                    made = [] if t is None else cut(t, {"language": lang} if lang else {})
                    rows += [n] * len(made)
                    number += range(len(made))
                    content += made
                ids = b.column(0).take(pa.array(rows, pa.int64())).cast(arrow_id)
                yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), pa.array(content, pa.string())], names=["id", "chunk_index", "content"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text", "language").mapInArrow(run, f"id {kind}, chunk_index int, content string")
