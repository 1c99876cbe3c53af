"""What a search gets from outside: stop words and synonyms kept for a while, embedders, rerankers and segmenters."""

from __future__ import annotations

import json
import math
import time
import unicodedata
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import synonyms
from ..functions.languages import base


class Embedder(Protocol):
    def embed_query(self, text: str) -> list[float]: ...

    def embed_documents(self, texts: list[str]) -> list[list[float]]: ...


class Segmenter(Protocol):
    def segments_language(self, language: str) -> bool: ...

    def segment(self, text: str, language: str) -> str: ...


class Cached:
    """What ``load(tenant)`` gives, kept for ``seconds``."""

    def __init__(self, load: Callable[[str], object], seconds: float = 30.0, clock: Callable[[], float] = time.monotonic) -> None:
        self._load, self._seconds, self._clock, self._have = load, seconds, clock, {}

    def get(self, tenant: str):
        at, value = self._have.get(tenant, (-math.inf, None))
        if self._clock() - at >= self._seconds:
            value = self._load(tenant)
            self._have[tenant] = (self._clock(), value)
        return value

    def invalidate(self, tenant: str | None = None) -> None:
        self._have.clear() if tenant is None else self._have.pop(tenant, None)


def stop_word_sets(rows: DataFrame, normalize: Callable[[str, str], str] | None = None) -> DataFrame:
    """(language, words) of (language, word), in lower case and, if given, normalised: each distinct word once, in Arrow batches."""
    word = F.lower("word")
    if normalize is not None:

        @F.pandas_udf(T.StringType())
        def normal(words: pd.Series, languages: pd.Series) -> pd.Series:
            return pd.Series([normalize(w, x) for w, x in zip(words, languages)], index=words.index)

        rows = rows.select("language", word.alias("word")).where("word is not null").distinct()
        word = normal(F.col("word"), F.col("language"))
    return rows.groupBy("language").agg(F.sort_array(F.collect_set(word)).alias("words"))


def stop_words(table: DataFrame, normalize: Callable[[str, str], str] | None = None, **kept) -> Cached:
    """By tenant, the stop words of all languages together, from a table (tenant_id, language, word)."""

    def load(tenant: str) -> list[str]:
        sets = stop_word_sets(table.where(F.col("tenant_id") == tenant), normalize)
        return sorted({w for r in sets.collect() for w in r["words"]})

    return Cached(load, **kept)


def synonym_lookup(table: DataFrame, normalize: Callable[[str, str], str] | None = None, **kept) -> Cached:
    """By tenant, the lookup from a table (tenant_id, language, term, synonyms, direction); terms and synonyms normalised if that is given."""

    def load(tenant: str) -> synonyms.Lookup:
        rows = table.where(F.col("tenant_id") == tenant).orderBy("language", "term", "synonyms").collect()
        return synonyms.load((r.asDict() for r in rows), normalize)

    return Cached(load, **kept)


def embedded(rows: DataFrame, text: str, embedder: Embedder, batch: int = 32) -> DataFrame:
    """Adds ``embedding`` to each row, in batches; fails if the embedder gives a different number of vectors."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out: list[list[float]] = []
            for at in range(0, len(s), batch):
                asked = [t or "" for t in s.iloc[at : at + batch]]
                got = embedder.embed_documents(asked)
                if len(got) != len(asked):
                    raise ValueError(f"{len(asked)} texts, but {len(got)} embeddings")
                out += got
            yield pd.Series(out, index=s.index)

    return rows.withColumn("embedding", embed(F.col(text)))


@dataclass
class HashEmbedder:
    """An embedder that needs no model: signed counts of hashed words, at unit length."""

    dimensions: int = 64

    def embed_query(self, text: str) -> list[float]:
        import zlib

        from ..functions.tsquery import words

        v = [0.0] * self.dimensions
        for w in words(text):
            h = zlib.crc32(w.encode())
            v[h % self.dimensions] += 1.0 if h >> 31 else -1.0
        norm = math.sqrt(sum(x * x for x in v))
        return [x / norm for x in v] if norm else v

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        return [self.embed_query(t) for t in texts]


def _post(url: str, body: dict, headers: dict[str, str], timeout: float) -> dict:
    asked = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(asked, timeout=timeout) as r:
        return json.load(r)


@dataclass
class HttpEmbedder:
    """An embeddings endpoint of the usual kind: {model, input} to {data: [{index, embedding}]}. Retries what may pass, and checks what it gets."""

    url: str
    model: str
    api_key: str | None = None
    query_prefix: str = "query: "
    document_prefix: str = "passage: "
    batch: int = 32
    timeout: float = 30.0
    retries: int = 2
    wait: float = 0.25
    post: Callable[[str, dict, dict, float], dict] = _post
    sleep: Callable[[float], None] = time.sleep

    def embed_query(self, text: str) -> list[float]:
        return self._embed([self.query_prefix + text])[0]

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        return [v for at in range(0, len(texts), self.batch) for v in self._embed([self.document_prefix + t for t in texts[at : at + self.batch]])]

    def _embed(self, texts: list[str]) -> list[list[float]]:
        headers = {"Authorization": f"Bearer {self.api_key}"} if self.api_key else {}
        for attempt in range(self.retries + 1):
            try:
                return self._checked(self.post(self.url, {"model": self.model, "input": texts}, headers, self.timeout), len(texts))
            except urllib.error.HTTPError as e:
                if attempt == self.retries or e.code != 429 and e.code < 500:
                    raise
            except (urllib.error.URLError, TimeoutError, ConnectionError):
                if attempt == self.retries:
                    raise
            self.sleep(self.wait * 2**attempt)
        raise AssertionError

    @staticmethod
    def _checked(answer: dict, n: int) -> list[list[float]]:
        data = answer.get("data") if isinstance(answer, dict) else None
        if not isinstance(data, list) or len(data) != n:
            raise ValueError(f"no list of {n} embeddings")
        indices = [d.get("index") for d in data]
        if any(i is not None for i in indices):
            if sorted(i if isinstance(i, int) else -1 for i in indices) != list(range(n)):
                raise ValueError("indices aren't a permutation")
            data = sorted(data, key=lambda d: d["index"])
        out = [d.get("embedding") for d in data]
        if not all(isinstance(v, list) and v and all(isinstance(x, (int, float)) and math.isfinite(x) for x in v) for v in out):
            raise ValueError("an embedding isn't a list of finite numbers")
        return out


@dataclass
class HttpReranker:
    """A rerank endpoint: {query, texts} to [{index, score}], so many texts at a time."""

    url: str
    timeout: float = 30.0
    post: Callable[[str, dict, dict, float], list] = _post

    def __call__(self, query: str, texts: list[str]) -> list[float]:
        scores = {r["index"]: float(r["score"]) for r in self.post(self.url, {"query": query, "texts": texts}, {}, self.timeout)}
        return [scores.get(k, 0.0) for k in range(len(texts))]


@dataclass
class HttpJudge:
    """A chat endpoint that grades texts for a query: 0, 1 or 2 each. What it answers is read as the first digits of these; grades that are missing are 0."""

    url: str
    model: str
    api_key: str | None = None
    timeout: float = 60.0
    post: Callable[[str, dict, dict, float], dict] = _post

    def grade(self, query: str, texts: list[str]) -> list[int]:
        if not texts:
            return []
        listed = "\n".join(f"[{k}] {t}" for k, t in enumerate(texts, 1))
        ask = f"Rate how well each passage answers the question: 0 not at all, 1 partly, 2 fully. Answer with {len(texts)} digits only.\nQuestion: {query}\n{listed}"
        headers = {"Authorization": f"Bearer {self.api_key}"} if self.api_key else {}
        answer = self.post(self.url, {"model": self.model, "temperature": 0, "messages": [{"role": "user", "content": ask}]}, headers, self.timeout)
        said = [int(c) for c in str(answer["choices"][0]["message"]["content"]) if c in "012"]
        return (said + [0] * len(texts))[: len(texts)]


def judged(results: DataFrame, judge: HttpJudge) -> DataFrame:
    """Adds ``grades`` to results (query, texts: array of string), a call a row."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def grade(queries: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([judge.grade(q or "", [t or "" for t in ts]) for q, ts in zip(queries, texts)], index=queries.index)

    return results.withColumn("grades", grade(F.col("query"), F.col("texts")))


@dataclass
class HttpSegmenter:
    """A segmentation endpoint: {text} to {text}. It may only put in white space; an answer that changes more is refused."""

    url: str
    languages: tuple[str, ...] = ("th",)
    timeout: float = 5.0
    retries: int = 1
    post: Callable[[str, dict, dict, float], dict] = _post

    def segments_language(self, language: str) -> bool:
        return base(language) in self.languages

    def segment(self, text: str, language: str) -> str:
        if not text.strip() or not self.segments_language(language):
            return text
        for attempt in range(self.retries + 1):
            try:
                got = self.post(self.url, {"text": text}, {}, self.timeout)["text"]
                break
            except (OSError, KeyError):
                if attempt == self.retries:
                    raise
        if "".join(got.split()) != "".join(text.split()):
            raise ValueError("the segmenter changed the text")
        return got


@dataclass
class FixedSegmenter:
    """A segmenter that needs no dictionary: a blank after every ``every`` characters."""

    languages: tuple[str, ...] = ("th", "zh", "ja")
    every: int = 3

    def segments_language(self, language: str) -> bool:
        return base(language) in self.languages

    def segment(self, text: str, language: str) -> str:
        if not text.strip() or not self.segments_language(language):
            return text
        return " ".join(text[k : k + self.every] for k in range(0, len(text), self.every))


class DictionarySegmenter:
    """A segmenter with a word list: the longest word that fits at each place, from left to right; what no word covers stays together, and never begins with a mark."""

    def __init__(self, words: Iterable[str], languages: tuple[str, ...] = ("th", "zh", "ja", "lo", "km", "my")) -> None:
        self.words = frozenset(w for w in words if w)
        self.longest = max(map(len, self.words), default=1)
        self.languages = languages

    def segments_language(self, language: str) -> bool:
        return base(language) in self.languages

    def segment(self, text: str, language: str) -> str:
        if not text.strip() or not self.segments_language(language):
            return text
        return " ".join(p for run in text.split() for p in self._split(run))

    def _split(self, run: str) -> Iterator[str]:
        at = unknown = 0
        while at < len(run):
            n = next((n for n in range(min(self.longest, len(run) - at), 0, -1) if run[at : at + n] in self.words and not (at + n < len(run) and unicodedata.category(run[at + n])[0] == "M")), 0)
            if not n:
                at += 1
                continue
            if unknown < at:
                yield run[unknown:at]
            yield run[at : at + n]
            at += n
            unknown = at
        if unknown < at:
            yield run[unknown:]
