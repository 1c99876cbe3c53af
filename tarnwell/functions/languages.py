"""What is known of languages: stemming configurations, index groups, chunk sizes and a recommended set-up."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

_REGIONS = {"english": "en US IN", "spanish": "es ES MX", "french": "fr FR", "german": "de DE", "italian": "it IT", "portuguese": "pt PT", "romanian": "ro RO", "arabic": "ar SA EG"}
CONFIGS: dict[str, list[str]] = {k: [v[:2], *(f"{v[:2]}-{r}" for r in v[3:].split())] for k, v in _REGIONS.items()}
BM25_GROUPS = {k: v for k, v in CONFIGS.items() if k != "arabic"}
BM25_LANGUAGES = [c for v in BM25_GROUPS.values() for c in v]
CJK_CODES = ("zh", "zh-CN", "ja", "ja-JP", "ko", "ko-KR")
_RATIO = {3.2: "de en es fr it ms pt ro", 2.4: "ar hi si", 1.5: "th", 1.2: "ja ko zh"}
CHARS_PER_TOKEN = {code: ratio for ratio, codes in _RATIO.items() for code in codes.split()}


def base(language: str | None) -> str:
    return (language or "").split("-")[0].lower()


def fts_config(language: str | None) -> str:
    """By the exact code; ``simple`` for all others."""
    return next((k for k, v in CONFIGS.items() if language in v), "simple")


def _mapped(language: Column, groups: dict[str, list[str]]) -> Column:
    out = F.lit("simple")
    for k, v in groups.items():
        out = F.when(language.isin(v), k).otherwise(out)
    return out


def fts_config_of(language: Column) -> Column:
    return _mapped(language, CONFIGS)


def bm25_group(language: str | None) -> str:
    return next((k for k, v in BM25_GROUPS.items() if language in v), "simple")


def bm25_group_of(language: Column) -> Column:
    """The index that a document of the language is in."""
    return _mapped(language, BM25_GROUPS)


def bm25_index(language: str | None) -> str:
    group = BM25_GROUPS.get(bm25_group(language))
    return f"bm25_{group[0] if group else 'simple'}"


def char_limit(language: str | None, token_limit: float) -> int:
    """Characters that so many tokens of the language hold, by its base code."""
    ratio = CHARS_PER_TOKEN.get(base(language)) if language else None
    return math.floor(token_limit * ratio) if ratio else int(token_limit)


@dataclass(frozen=True)
class Recommendation:
    embedder: str
    dimensions: int
    max_tokens: int
    vector_min_score: float
    stemming: str
    needs_normalization: bool
    is_cjk: bool


def recommend(language: str | None) -> Recommendation:
    """A set-up to start from; stemming by the exact code or the base."""
    b = base(language)
    config = next((k for k, v in CONFIGS.items() if language in v or b in v), "none")
    return Recommendation("BAAI/bge-m3", 1024, 8192, 0.4, config, b in ("ar", "th"), b in ("zh", "ja", "ko"))
