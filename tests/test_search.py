import math
import random

import pytest
from pyspark.sql import functions as F

from tarnwell.functions import tsquery as Q, wordsim as W
from tarnwell.operators import evaluate, fusion, legs, rerank
from tarnwell.plans.search import SearchOptions, search
from tarnwell.sources.providers import HashEmbedder, embedded


def frame(spark, *parts):
    rows = [("q", leg, k + 1, i, None if s is None else float(s)) for leg, part in enumerate(parts) for k, (i, s) in enumerate(part)]
    return spark.createDataFrame(rows, "query_id string, leg int, rank int, id string, score double")


def ids(df):
    return [r["id"] for r in sorted(df.collect(), key=lambda r: r["rank"])]


def test_reciprocal_ranks(spark):
    assert ids(fusion.rrf(frame(spark, [("A", 1), ("B", 1)], [("B", 1), ("C", 1)])))[0] == "B"
    assert ids(fusion.rrf(frame(spark, [("A", 1), ("B", 1), ("C", 1)], []), top_k=2)) == ["A", "B"]
    two = frame(spark, [("v", 1)], [("k", 1)])
    assert ids(fusion.rrf(two, weights=(0.9, 0.1)))[0] == "v" and ids(fusion.rrf(two, weights=(0.1, 0.9)))[0] == "k"
    third = fusion.rrf(frame(spark, [("a", 1)], [("b", 1)], [("c", 1)]), weights=(1, 1)).where("id = 'c'").first()
    assert third["score"] == 1 / 61
    assert ids(fusion.rrf(frame(spark, [("z", 1)], [("a", 1)]))) == ["z", "a"]  # a tie: the first leg first
    assert ids(fusion.rrf(frame(spark, [("z", 1)], [("a", 1)]), weights=(0, 1))) == ["a", "z"]  # weight 0 doesn't remove a leg


def test_normalisation(spark):
    leg = frame(spark, [("a", 0.95), ("b", 0.8), ("c", 0.55)])
    norm = {r["id"]: r["norm"] for r in fusion.normalized(leg).collect()}
    assert norm["a"] == 1 and norm["c"] == 0 and norm["b"] == pytest.approx(0.625)
    length = math.sqrt(0.95**2 + 0.8**2 + 0.55**2)
    assert {r["id"]: r["norm"] for r in fusion.normalized(leg, "l2").collect()}["b"] == pytest.approx(0.8 / length)
    for scores in ([("a", 0.4), ("b", 0.4)], [("a", None), ("b", float("nan"))], [("a", 3.0)]):
        assert {r["norm"] for r in fusion.normalized(frame(spark, scores)).collect()} == {1.0}
    assert {r["norm"] for r in fusion.normalized(frame(spark, [("a", 0.0)]), "l2").collect()} == {0.0}
    got = {r["id"]: r["score"] for r in fusion.linear(frame(spark, [("A", 0.9), ("B", 0.5)], [("A", 0.3)]), (1, 2)).collect()}
    assert got == {"A": 3.0, "B": 0.0}
    with pytest.raises(ValueError):
        fusion.normalized(leg, "other")


def test_floors(spark):
    scored = frame(spark, [("A", 0.0711), ("B", 0.0075), ("C", 0.0000263)])
    assert fusion.rerank_floors(scored).count() == 2 and fusion.rerank_floors(scored, 0).count() == 3 and fusion.rerank_floors(scored, 0.01, 0.01).count() == 1
    assert fusion.rerank_floors(frame(spark, [("A", -2.25), ("B", -4.82), ("C", -9.77)])).count() == 3
    assert fusion.min_relevance(scored, 0.1).count() == 2 and fusion.min_relevance(scored, None).count() == 3
    assert (fusion.fused_limit(5, False, 30), fusion.fused_limit(5, True, 30), fusion.fused_limit(5, True, None), fusion.fused_limit(5, True, 2)) == (5, 30, 5, 5)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    words = "cash delivery phone phones market running run hand token licence the of and".split()
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 14))), rng.choice(["en", "en-US", "de", "ar", "xx"]), f"t{k % 3}", str(k)) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, content string, language string, source_type string, source_id string")
    return embedded(df.withColumns({"content_normalized": F.col("content"), "metadata": F.lit('{"a":"b"}'), "config": F.lit("simple")}), "content", HashEmbedder(16)).persist()


def test_vector_legs_agree(spark, docs):
    q = docs.where("id < 5").select(F.col("id").alias("query_id"), "embedding")
    bad = q.limit(1).select(F.lit(99).cast("long").alias("query_id"), F.array(F.lit(0.0).cast("float")).alias("embedding"))
    one = {tuple(r) for r in legs.vector(docs, q, 7, 0.1).collect()}
    assert one == {tuple(r) for r in legs.vector_batch(docs, q.unionByName(bad), 7, 0.1).collect()} == {tuple(r) for r in legs.vector_batch(docs, q, 7, 0.1, at_once=2).collect()}
    celled, centres = legs.cells(docs.where("content <> ''"), 4)
    all_ = legs.vector_probed(celled, centres, q, 7, 0.1, 4)
    assert {tuple(r) for r in all_.collect()} == one


def test_trigram_leg(spark, docs):
    q = spark.createDataFrame([(1, "phone market"), (2, "licens"), (3, None), (4, "?")], "query_id int, text string")
    got = {(r["query_id"], r["id"]): r["score"] for r in legs.trigram(docs, q, None, 0.35).collect()}
    want = {}
    for k, t in ((1, "phone market"), (2, "licens")):
        for r in docs.collect():
            s = round(W.word_similarity(set(W.grams(t)), W.grams(r["content"])), 6)
            if s >= 0.35:
                want[k, r["id"]] = s
    assert got == want and len(want) > 5


def test_text_search_leg(spark, docs):
    built = {1: "cash & delivery", 2: "(phone | cash <-> delivery) & the", 3: "run"}
    q = spark.createDataFrame([(k, b, b, "simple") for k, b in built.items()] + [(4, "", "", "simple")], "query_id int, text string, built string, config string")
    got = {(r["query_id"], r["id"]): r["score"] for r in legs.tsvector(docs, q, None).collect()}
    want = {}
    for k, b in built.items():
        for r in docs.collect():
            v = Q.vector(r["content"])
            if Q.matches(Q.parse(b), {t: set(p) for t, p in v.items()}):
                want[k, r["id"]] = round(Q.rank(Q.parse(b), v), 6)
    assert got == want and len({k for k, _ in want}) == 3
    stemmed = legs.tsvector(docs.withColumn("config", F.lit("english")), q.where("query_id = 3").withColumn("config", F.lit("english")), None)
    assert {r["id"] for r in stemmed.collect()} == {r["id"] for r in docs.collect() if {"run", "running"} & set(r["content"].split())}


def test_bm25_leg(spark, docs):
    q = spark.createDataFrame([(1, "cash cash phone", "en"), (2, "hand", "th"), (3, "", "en")], "query_id int, text string, language string")
    got = {(r["query_id"], r["id"]): r["score"] for r in legs.bm25(docs, q, None).collect()}
    rows, want = docs.collect(), {}
    for k, terms, ls in ((1, {"cash", "phone"}, {"en", "en-US"}), (2, {"hand"}, {"ar", "xx"})):
        own = [(r["id"], r["content"].split()) for r in rows if r["language"] in ls and r["content"]]
        avg = sum(len(w) for _, w in own) / len(own)
        for i, w in own:
            s = sum(math.log(1 + (len(own) - d + 0.5) / (d + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / avg)) for t in terms if t in w for d in [sum(t in x for _, x in own)])
            if s > 0:
                want[k, i] = round(s, 6)
    assert got == pytest.approx(want) and len(want) > 5


def test_keyword_router(spark, docs):
    q = spark.createDataFrame([(1, "cash", "zh"), (2, "cash", "zh-TW"), (3, "cash", None)], "query_id int, text string, language string")
    by = {r["query_id"]: r["score"] for r in legs.keyword(docs.where("content like '%cash%'"), q, 1, 0.1, cjk=True).collect()}
    assert set(by) == {1, 2, 3} and by[1] == 1.0
    plain = legs.keyword(docs, q, 3, 0.5)
    assert plain.where("query_id = 1").select("id").collect() == plain.where("query_id = 2").select("id").collect()


def test_filters(spark, docs):
    assert {r["source_type"] for r in legs.in_filters(docs, ["t0", "t2"], [], None).collect()} == {"t0", "t2"}
    assert legs.in_filters(docs, None, ["3"]).count() == 1
    with pytest.raises(ValueError, match="source_type"):
        legs.in_filters(docs, ["a,b"])


def test_failing_legs_are_named(spark, docs):
    def broken():
        raise RuntimeError("no index")

    with pytest.raises(legs.LegError, match=r"2 of 3 search legs failed \(keyword: no index; fts: no index\)"):
        legs.search_legs({"vector": lambda: docs, "keyword": broken, "fts": broken})


def asked(spark):
    return spark.createDataFrame([(1, "Cash on THE delivery?"), (2, "phones!")], "query_id int, text string")


def embed(df, text):
    return embedded(df, text, HashEmbedder(16))


@pytest.mark.parametrize("how", [{}, {"text_search": "bm25", "fusion": "linear"}, {"min_relevance": 0.9}, {"stemming": False}])
def test_search(spark, docs, how):
    o = SearchOptions(top_k=4, vector_min_score=0.2, language="en", source_types=("t0", "t1"), **how)
    got = search(docs, asked(spark), o, embed=embed, stop_words=["the", "on"], lookup={"en": {"phones": ["phone"]}}).collect()
    assert {r["query_id"] for r in got} == {1, 2} and all(r["source_type"] in ("t0", "t1") and r["metadata"] == {"a": "b"} for r in got)
    for k in (1, 2):
        own = sorted((r for r in got if r["query_id"] == k), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1)) and len(own) <= 4
        assert [r["score"] for r in own] == sorted((r["score"] for r in own), reverse=True)


def test_search_needs_a_language(spark, docs):
    with pytest.raises(ValueError, match="language"):
        search(docs, asked(spark), SearchOptions(languages=("en", "de")))
    assert SearchOptions(languages=("de",)).query_language() == "de"


def test_reranking(spark, docs):
    o = SearchOptions(top_k=2, vector_min_score=-1.0, language="en", rerank=True, rerank_candidates=6)
    best = search(docs, asked(spark), o, embed=embed, scorer=lambda q, ts: [float(len(t)) for t in ts]).collect()
    assert len(best) == 4 and all(r["score"] == len(r["content"]) for r in best)

    def down(q, ts):
        raise ConnectionError("down")

    assert search(docs, asked(spark), o, embed=embed, scorer=down).count() == 12  # the fused list, uncut
    assert one_overlap(spark) == pytest.approx(2 / 3)


def one_overlap(spark):
    return spark.sql("select 'a b c' q, 'C x a' t").select(rerank.token_overlap(F.col("q"), F.col("t"))).first()[0]


def test_measures(spark):
    rows = [(["a"], "a", "x"), (["x", "b"], "b", "y"), (["x", "a", "a"], "a", "y"), ([], "a", None)]
    df = spark.createDataFrame(rows[:2], "ranked array<string>, target string, dialect string")
    s = evaluate.summarize(df).first()
    assert (s["n"], s["recall_1"], s["recall_3"], s["mrr_10"]) == (2, 0.5, 1.0, 0.75)
    one = spark.createDataFrame(rows[2:3], df.schema)
    assert evaluate.summarize(one).first()["ndcg_10"] == round(1 / math.log2(3), 6)
    assert evaluate.summarize(df.limit(0)).first()["n"] == 0 and evaluate.summarize(df.limit(0)).first()["mrr_10"] == 0
    got = {(r["attribute"], r["value"]): r["n"] for r in evaluate.slices(spark.createDataFrame(rows, df.schema), "dialect").collect()}
    assert got == {("all", None): 4, ("dialect", "x"): 1, ("dialect", "y"): 2, ("dialect", None): 1}


def test_none_is_the_default():
    o = SearchOptions(top_k=None, vector_min_score=None, rrf_k=None, text_search=None, min_relevance=None, language="en")
    assert o == SearchOptions(language="en")


def test_legs_that_fail_while_they_run_are_named(spark):
    fine = frame(spark, [("a", 1)]).select("query_id", "leg", "rank", "id", "score")
    broken = fine.withColumn("score", F.raise_error(F.lit("broken inside")).cast("double"))
    assert legs.search_legs({"vector": lambda: fine, "keyword": lambda: fine}, eager=True).count() == 2
    with pytest.raises(legs.LegError, match="2 of 3 search legs failed .*keyword: .*broken inside.*fts: "):
        legs.search_legs({"vector": lambda: fine, "keyword": lambda: broken, "fts": lambda: broken}, eager=True)


def test_search_tells_what_it_does(spark, docs):
    from contextlib import contextmanager

    said = []

    class Said:
        @contextmanager
        def span(self, name):
            said.append(name)
            yield self

        def set(self, name, value):
            said.append((name, value))

    class First:
        """A text search of one's own: the document of id 1."""

        def build(self, query, lookup):
            return query

        def leg(self, docs, queries, k, stemming):
            return queries.select("query_id", F.lit(2).alias("leg"), F.lit(1).alias("rank"), F.lit(1).cast("long").alias("id"), F.lit(1.0).alias("score"))

    q = docs.where("id = 3").select(F.lit(1).alias("query_id"), F.lit("cash").alias("text"), "embedding")
    got = search(docs, q, SearchOptions(language="en", text_search=First(), vector_min_score=2.0, keyword_min_score=2.0, eager=True), tracer=Said())
    assert [r["id"] for r in got.collect()] == [1]
    assert [x for x in said if isinstance(x, str)] == ["search", "prepare", "legs", "fuse"] and ("text_search", "First") in said and ("language", "en") in said


def test_probed_search_makes_no_rows_of_pairs(spark):
    """What the expression finds in the probed cells, by products: no join of documents with queries."""
    import numpy as np

    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.normal(size=(200, 8)))], "id long, embedding array<double>")
    asked = [*rng.normal(size=(30, 8)).tolist(), [0.0] * 8, [1.0, 2.0]]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id int, embedding array<double>")
    celled, centres = legs.cells(docs, 5)
    found = legs.vector_probed(celled, centres, q, 6, 0.1, 2)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    unit = lambda x: x / np.linalg.norm(x)
    rows = [(r["id"], r["cell"], unit(np.array(r["embedding"]))) for r in celled.collect()]
    want = set()
    for n, v in enumerate(asked[:30]):
        near = np.argsort([-unit(np.array(c)) @ unit(np.array(v)) for c in centres], kind="stable")[:2]
        scored = sorted((-round(float(x @ unit(np.array(v))), 6), i) for i, c, x in rows if c in near)
        want |= {(n, i, -s) for s, i in scored[:6] if -s >= 0.1}
    assert {(r["query_id"], r["id"], r["score"]) for r in found.collect()} == want
