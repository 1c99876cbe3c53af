"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped so that each block-level element is a line of its own, however its source is wrapped (``pre`` keeps its lines); empty lines are those that the page has between
texts. The block at a line is that line and the next ones, ``block`` of them; its size is the sum of their text lengths. Where sizes surge past ``surge`` the main text begins, where
they dive below ``dive`` it ends, and the text between is kept. Of the first ``block`` - 1 lines of a region, those are left out at its start that are shorter than ``dive`` and that
the surge doesn't need: only the window let them in. A page may have several regions.

Defined results: a null page has null text, one without a surge the empty text and no regions; pages of any length are
read whole, in time proportional to their length; rows of one page_id are each extracted; markup that is never closed ends at the page's end.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import tidied

_DROPPED = ("script", "style", "noscript", "template", "svg", "head", "iframe", "textarea", "select")
_LINE = frozenset("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
_TOKEN = re.compile(r"<(?:!--|[!?]|/?([a-zA-Z][a-zA-Z0-9:-]*))")
_QUOTE_OR_END = re.compile(r"""=\s*(["'])|>""")
_CLOSE = {t: re.compile(rf"</{t}\b", re.IGNORECASE) for t in _DROPPED}
_BLANK = re.compile(r"\s+")


@dataclass(frozen=True)
class Params:
    block: int = 3
    surge: int = 120
    dive: int = 40
    least_line: int = 80  # a line at a region's edge that is shorter is trimmed


def _after(page: str, i: int, dead: set[int]) -> int:
    """Where the tag that opens before i is over. A quote opens after = only, as in browsers, and is read to its end however long it is. One that is never closed
    doesn't hide the rest of the page: the next > ends the tag. dead: where quotes open from which no end of a tag is reached; none is read twice, so a page takes
    time proportional to its length."""
    near = page.find(">", i)
    if near < 0:
        return len(page)
    at, opened = i, []
    while m := _QUOTE_OR_END.search(page, at):
        if m.group() == ">":
            return m.end()
        opened.append(m.end())
        at = -1 if m.end() in dead else page.find(m.group(1), m.end()) + 1 or -1
        if at < 0:
            break
    dead.update(opened)
    return near + 1


def lines(page: str) -> list[str]:
    """Lines of text, white space folded; empty lines stay, as they are part of the distribution."""
    out: list[str] = []
    at, n = 0, len(page)
    missing: set[str] = set()
    dead: set[int] = set()
    first, pre = 0, 0  # where the text of this element begins in out; how many pre are open

    def fold() -> None:
        """Source line breaks within the text since ``first`` are blanks; those around it stay, as empty lines."""
        nonlocal first
        if not pre and first < len(out):
            x = "".join(out[first:])
            if text := x.strip():
                before, _, after = x.partition(text)
                out[first:] = [before, text.replace("\n", " "), after]
        first = len(out)

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            out.append(page[at:])
            break
        if m.start() > at:
            out.append(page[at : m.start()])
        tag = (m.group(1) or "").lower()
        if not tag:
            if m.group() == "<!--":
                end = -1 if "-->" in missing else page.find("-->", m.end())
                if end < 0:
                    missing.add("-->")
                at = end + 3 if end >= 0 else _after(page, m.end(), dead)
            else:
                at = _after(page, m.end(), dead)
            continue
        at = _after(page, m.end(), dead)
        if tag in _CLOSE and page[m.start() + 1] != "/" and page[at - 2 : at] != "/>":
            end = None if tag in missing else _CLOSE[tag].search(page, at)
            if end is None:
                missing.add(tag)  # no later one can be closed either; its content is kept
            else:
                at = _after(page, end.end(), dead)
            tag = "p"
        if tag in _LINE:
            parted = out[-1:] == ["\n"]  # the end of one element and the start of the next are one break
            fold()
            if not parted:
                out.append("\n")
            first = len(out)
            if tag == "pre":
                pre = max(0, pre - 1) if page[m.start() + 1] == "/" else pre + 1
    fold()
    return [_BLANK.sub(" ", html.unescape(x)).strip() for x in "".join(out).split("\n")]


def regions(size: list[int], p: Params) -> list[tuple[int, int]]:
    """``stretches`` down to their long lines: what is sure to be text. Short lines at both edges are trimmed, and stretches without a long line left out."""
    n = len(size)
    block = sum(size[: p.block])
    out: list[tuple[int, int]] = []
    start = -1
    for i in range(n + 1):
        if start < 0 and i < n and block >= p.surge:
            start = i
        elif start >= 0 and (i == n or block < p.dive):
            a, b = start, min(n, i + 1) if i < n and size[i] >= p.least_line else i
            while a < b and size[a] < p.least_line:
                a += 1
            while b > a and size[b - 1] < p.least_line:
                b -= 1
            if a < b:
                out.append((a, b))
            start = -1
        if i < n:
            block += (size[i + p.block] if i + p.block < n else 0) - size[i]
    return out


def stretches(size: list[int], p: Params) -> list[tuple[int, int]]:
    """(first line, line after the last) of each stretch between a surge and the dive that follows, without what only the window over its start let in."""
    n = len(size)
    block = sum(size[: p.block])
    out: list[tuple[int, int]] = []
    start = -1
    for i in range(n + 1):
        if start < 0 and i < n and block >= p.surge:
            start, rest = i, block
            while start < min(i + p.block, n) - 1 and size[start] < p.dive and rest - size[start] >= p.surge:
                rest -= size[start]
                start += 1
        elif start >= 0 and (i == n or block < p.dive):
            out.append((start, i))
            start = -1
        if i < n:
            block += (size[i + p.block] if i + p.block < n else 0) - size[i]
    return out


def text_of(page: str, p: Params = Params()) -> tuple[str, int]:
    """(main text, regions)."""
    ls = lines(page)
    found = stretches([len(x) for x in ls], p)
    return "\n".join(x for a, b in found for x in ls[a:b] if x), len(found)


def extract(pages: DataFrame, p: Params = Params()) -> DataFrame:
    """(page_id, url, text, n_regions) of every page. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                got = [None if h is None else text_of(h, p) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([g and g[0] for g in got], pa.string()), pa.array([g and g[1] for g in got], pa.int32())], names=["page_id", "url", "text", "n_regions"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(tidied(run), "page_id long, url string, text string, n_regions int")
