"""Synonyms: the lookup from its rows, expansion of a query, and the query strings for text search and BM25."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Window, functions as F

from .text import WS

Lookup = dict[str, dict[str, list[str]]]
CAP = 5
_WS = re.compile(WS + "+")
_SPECIAL = str.maketrans("", "", "!\"&'()*:<>\\|")


def split(text: str) -> list[str]:
    return [w for w in _WS.split(text) if w]


def sanitize(word: str) -> str:
    return _WS.sub(" ", word.translate(_SPECIAL)).strip()


def load(rows: Iterable[dict], normalize: Callable[[str, str], str] | None = None) -> Lookup:
    """From rows of language, term, synonyms (a list, or one in JSON) and direction, in the order of language, term and synonyms.
    Rows that can't be read are skipped; a term has at most five synonyms, the first ones. ``normalize(word, language)`` is applied to all of them."""
    out: Lookup = {}

    def add(language: str, term: str, words: list[str]) -> None:
        have = out.setdefault(language, {}).setdefault(term, [])
        for w in words:
            if w != term and w not in have and len(have) < CAP:
                have.append(w)

    for row in rows:
        found = row["synonyms"]
        if isinstance(found, str):
            try:
                found = json.loads(found)
            except ValueError:
                continue
        if not isinstance(found, (list, tuple)):
            continue
        term, words = row["term"].lower(), [w.lower() for w in found if isinstance(w, str)]
        if normalize is not None:
            term, words = normalize(term, row["language"]), [normalize(w, row["language"]) for w in words]
        add(row["language"], term, words)
        if row["direction"] == "two_way":
            for w in words:
                add(row["language"], w, [term])
    return out


def lookup_frame(rows: DataFrame) -> DataFrame:
    """(language, term, synonyms) as ``load`` has it, of a table of any size. synonyms: an array, or JSON in a string."""
    if dict(rows.dtypes)["synonyms"] == "string":
        # variants keep their type: an element that isn't a string is left out, not turned into one
        parsed = F.try_parse_json("synonyms")
        is_array = F.schema_of_variant(parsed).startswith("ARRAY")
        items = F.expr("cast(try_parse_json(synonyms) as array<variant>)")
        rows = rows.withColumn("_s", F.when(is_array, F.transform(F.filter(items, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: v.cast("string"))))
    else:
        rows = rows.withColumn("_s", F.col("synonyms"))
    order = [F.col(c) for c in ("language", "term", "synonyms", "direction")]
    rows = rows.where(F.col("_s").isNotNull()).withColumn("_row", F.struct(*order)).select("language", F.lower("term").alias("t"), "direction", "_row", F.posexplode(F.transform("_s", F.lower)).alias("p", "w"))
    there = rows.select("language", F.col("t").alias("term"), F.col("w").alias("word"), "_row", F.lit(0).alias("back"), "p")
    back = rows.where("direction = 'two_way'").select("language", F.col("w").alias("term"), F.col("t").alias("word"), "_row", F.lit(1).alias("back"), "p")
    first = there.unionByName(back).where("term <> word").groupBy("language", "term", "word").agg(F.min(F.struct("_row", "back", "p")).alias("o"))
    ranked = first.withColumn("k", F.row_number().over(Window.partitionBy("language", "term").orderBy("o"))).where(F.col("k") <= CAP)
    return ranked.groupBy("language", "term").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]).alias("synonyms"))


def merge(lookup: Lookup) -> tuple[dict[str, list[str]], int]:
    """(all languages in one, words of the longest term)."""
    out: dict[str, list[str]] = {}
    for terms in lookup.values():
        for term, words in terms.items():
            have = out.setdefault(term, [])
            have += [w for w in dict.fromkeys(words) if w not in have][: CAP - len(have)]
    return out, max((len(t.split(" ")) for t in out), default=1)


def _matches(words: list[str], known: dict[str, list[str]], longest: int):
    """(words taken, their synonyms or None) from left to right, the longest term first."""
    low = [w.lower() for w in words]
    at = 0
    while at < len(words):
        n = next((n for n in range(min(longest, len(words) - at), 1, -1) if " ".join(low[at : at + n]) in known), 1)
        yield words[at : at + n], known.get(" ".join(low[at : at + n]))
        at += n


def expand(query: str, lookup: Lookup) -> str:
    """The query with synonyms behind what they stand for; no word is added that the query or an earlier synonym has."""
    known, longest = merge(lookup)
    if not known:
        return query
    words = split(query)
    seen, out = {w.lower() for w in words}, []
    for taken, synonyms in _matches(words, known, longest):
        out += taken
        for s in synonyms or []:
            for w in split(s):
                if w.lower() not in seen:
                    seen.add(w.lower())
                    out.append(w)
    return " ".join(out)


def _phrase(words: Iterable[str]) -> str:
    return " <-> ".join(s for w in words if (s := sanitize(w)))


def fts_query(query: str, lookup: Lookup) -> str:
    """All words must occur; a word with synonyms, or one of these; synonyms of several words as phrases."""
    known, longest = merge(lookup)
    groups = []
    for taken, synonyms in _matches(split(query), known, longest):
        own = _phrase(taken)
        if not own and len(taken) == 1:
            continue
        terms = list(dict.fromkeys(t for t in [own, *(_phrase(split(s)) for s in synonyms or [])] if t))
        if terms:
            groups.append(f"({' | '.join(terms)})" if len(terms) > 1 else terms[0])
    return " & ".join(groups)


def bm25_query(query: str, lookup: Lookup) -> str:
    """The expanded query as a list of terms."""
    return " ".join(s for w in split(expand(query, lookup)) if (s := sanitize(w)))
