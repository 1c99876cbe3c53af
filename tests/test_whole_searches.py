"""Queries over whole tables against brute force, where SQL can't express them."""

import math

import numpy as np
import pytest

from tarnwell.functions import synonyms as S, tsquery as Q, wordsim as W
from tarnwell.functions.languages import fts_config
from tarnwell.operators.chunker import Chunker
from tarnwell.plans import catalogue as C
from tarnwell.sources.store import DocumentStore

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["vector_probed_topk", "vector_coded_topk"])
def test_recall_of_approximate_searches(spark, name):
    rows = C._vectors(spark, SF).collect()
    ids = np.array([r["id"] for r in rows])
    x = np.array([r["embedding"] for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    score = np.round(x @ x.T, 6)
    asked = np.flatnonzero(ids % 50 == 0)
    want = {(int(ids[q]), int(ids[k])): score[q, k] for q in asked for k in np.lexsort((ids, -score[q]))[:10] if score[q, k] >= 0.1}
    got = {(r["query_id"], r["id"]): r["score"] for r in C.queries()[name](spark, SF).collect()}
    assert {q for q, _ in got} == {int(ids[q]) for q in asked} and len(got) <= len(want)
    assert len(set(want) & set(got)) >= 0.9 * len(want) and all(abs(got[k] - want[k]) < 2e-6 for k in set(want) & set(got))


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


LOOKUP = S.load({"language": a, "term": b, "synonyms": c, "direction": d} for a, b, c, d in C.SYNONYMS)


def fts(documents, queries, config_of, k):
    """{(query, id): (rank, score)} of queries {id: tree}."""
    out = {}
    vectors = {(i, c): Q.vector(t, c) for i, t, lang in documents for c in [config_of(lang)]}
    for q, tree in queries.items():
        found = sorted((-math.floor(Q.rank(tree, v) * 1e6 + 0.5) / 1e6, i) for (i, _), v in vectors.items() if Q.matches(tree, {t: set(p) for t, p in v.items()}))
        out |= {(q, i): (n, -s) for n, (s, i) in enumerate(found[:k], 1)}
    return out


def ranked(df):
    return {(r["query_id"], r["id"]): (r["rank"], r["score"]) for r in df.collect()}


def test_text_search(spark, documents):
    plain = {q: Q.parse(" & ".join(t.split())) for q, t in C.ASKED}
    got = ranked(C.fts_cover_density_topk(spark, SF))
    assert got == fts(documents, plain, lambda lang: "simple", 20) and len(got) > 10
    stemmed = {q: Q.query_tree(S.fts_query(t, LOOKUP), t, "english") for q, t in C.ASKED}
    got = ranked(C.fts_stemmed_topk(spark, SF))
    assert got == fts(documents, {q: t for q, t in stemmed.items() if t is not None}, fts_config, 20) and len(got) > 10


def test_chunks(spark, documents):
    chunker, got = Chunker(token_limit=256), {}
    for r in C.chunk_documents(spark, SF).collect():
        got.setdefault(r["id"], {})[r["chunk_index"]] = r["content"]
    want = {i: dict(enumerate(chunker.chunk(t, {"language": lang}))) for i, t, lang in documents}
    assert got == {i: x for i, x in want.items() if x} and sum(map(len, got.values())) > len(got)
    for i, t, _ in documents:  # nothing of a text is lost
        assert all(w in " ".join(got[i].values()) for w in t.split()[:50])


def test_synonyms(spark):
    got = {r["query_id"]: (r["expanded"], r["fts"], r["bm25"]) for r in C.synonym_expand(spark, SF).collect()}
    assert got[2] == ("released under the license permit licence", "released & under & the & (license | permit | licence)", "released under the license permit licence")
    assert got[1][1] == "the & (hand | palm | fist) & of & there" and got[5][1] == "(token | key | secret <-> key) & with & in" and got[6] == ("der die und", "der & die & und", "der die und")


def hybrid(spark, documents):
    """The hybrid search written out: three legs of twenty rows, ranks fused."""
    stop = set(C.STOP)
    vectors = {r["id"]: np.array(r["embedding"], dtype=float) for r in C._vectors(spark, SF).collect()}
    unit = {i: v / np.linalg.norm(v) for i, v in vectors.items()}
    half = lambda x: math.copysign(math.floor(abs(x) * 1e6 + 0.5) / 1e6, x)
    have = {i for i, _, _ in documents}
    grams = {i: W.grams(t) for i, t, _ in documents}
    out = {}
    for q, t in C.ASKED:
        if q not in vectors:
            continue
        lexical = " ".join(w for w in t.split() if w not in stop) or t
        legs = [sorted((-half(unit[q] @ unit[i]), i) for i in have & set(unit) if half(unit[q] @ unit[i]) >= 0.1)[:20]]
        own = set(W.grams(lexical))
        legs.append(sorted((-s, i) for i in have if (s := half(W.word_similarity(own, grams[i]))) >= 0.35)[:20])
        tree = Q.query_tree(S.fts_query(lexical, LOOKUP), t, "english")
        legs.append([] if tree is None else sorted((-s, i) for (_, i), (_, s) in fts(documents, {q: tree}, fts_config, 20).items()))
        score, seen = {}, {}
        for n, leg in enumerate(legs):
            for rank, (_, i) in enumerate(leg, 1):
                score[i] = score.get(i, 0) + 1 / (60 + rank)
                seen.setdefault(i, (n, rank))
        best = sorted(score, key=lambda i: (-score[i], seen[i], i))[:10]
        out |= {(q, i): (k, round(score[i], 9)) for k, i in enumerate(best, 1)}
    return out


def test_hybrid_search(spark, documents):
    got = ranked(C.hybrid_search_e2e(spark, SF))
    want = hybrid(spark, documents)
    assert set(got) == set(want) and len(got) > 30 and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-9 for k in want)


def test_reranked_search(spark, documents):
    text = {i: t for i, t, _ in documents}
    asked = dict(C.ASKED)
    rows = C.hybrid_search_reranked(spark, SF).collect()
    by = {}
    for r in rows:
        q = set(asked[r["query_id"]].split())
        assert abs(r["score"] - len(q & set(text[r["id"]].lower().split())) / len(q)) < 1e-6
        by.setdefault(r["query_id"], []).append((r["rank"], r["score"]))
    assert by and all([n for n, _ in sorted(x)] == list(range(1, len(x) + 1)) and [s for _, s in sorted(x)] == sorted((s for _, s in x), reverse=True) for x in by.values())


def test_stream_has_every_text(spark, documents, monkeypatch):
    made, real = [], DocumentStore.__post_init__
    monkeypatch.setattr(DocumentStore, "__post_init__", lambda self: (made.append(self), real(self))[1])
    C.streaming_ingest(spark, SF).collect()
    chunker = Chunker(token_limit=512)
    got = {(r["source_id"], r["chunk_index"]): r["content"] for r in made[-1].scan(C.TENANT).collect()}
    assert got == {(str(i), str(k)): c for i, t, lang in documents for k, c in enumerate(chunker.chunk(t, {"language": lang}))}
