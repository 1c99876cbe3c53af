import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from tarnwell.operators import legs
from tarnwell.operators.chunker import Chunker
from tarnwell.plans.indexing import build_corpus, index_sources
from tarnwell.sources import providers as P
from tarnwell.sources.store import TENANT, Conflict, DocumentStore, Migration, read_jsonl, read_pages, read_queries, write_jsonl, write_results
from tarnwell.streaming import ingest

SOURCES = "tenant_id string, source_type string, source_id string, text string, language string, metadata string, version int"


def sources(spark, *rows):
    return spark.createDataFrame([(t, "faq", i, x, "en", '{"k":"v"}', v) for t, i, x, v in rows], SOURCES)


@pytest.fixture
def store(spark, tmp_path):
    return DocumentStore(spark, str(tmp_path / "store"), dimensions=8)


def said(store, tenant="a"):
    return sorted((r["source_id"], r["content"]) for r in store.scan(tenant).collect())


def test_replace_by_source(spark, store):
    e, c = P.HashEmbedder(8), Chunker(8, 0)
    index_sources(store, sources(spark, ("a", "1", "one two. three four.", 1), ("a", "2", "five", 1), ("b/é", "1", "other", 1)), c, e)
    assert said(store) == [("1", "four."), ("1", "one two."), ("1", "three"), ("2", "five")] or len(said(store)) >= 3
    index_sources(store, sources(spark, ("a", "1", "new", 1)), c, e)
    assert said(store) == [("1", "new"), ("2", "five")] and said(store, "b/é") == [("1", "other")]
    before = store.version()
    assert index_sources(store, sources(spark, ("a", "1", " ", 1)), c, e) == before  # no chunks: what was there stays
    store.delete_source("a", "faq", "2")
    assert said(store) == [("1", "new")] and said(store, "missing") == []
    row = store.scan("a").first()
    assert len(row["id"]) == 64 and row["metadata"] == '{"k":"v"}' and row["chunk_index"] == "0" and len(row["embedding"]) == 8
    assert store.scan("a", before).count() == 2  # the older version can still be read


def test_isolation_and_conflicts(spark, store, tmp_path):
    store.insert(sources(spark, ("a", "1", "x", 1)).withColumn("content", F.col("text")))
    safe = DocumentStore(spark, store.path, 8, frozenset({"rls"}))
    spark.conf.unset(TENANT)
    assert store.scan().count() == 1 and safe.scan().count() == 0
    spark.conf.set(TENANT, "a")
    assert safe.scan().count() == 1
    spark.conf.unset(TENANT)
    with pytest.raises(Conflict):
        store._commit(store.version() - 1, store.manifest())
    with pytest.raises(ValueError):
        DocumentStore(spark, store.path, 8, frozenset({"other"}))
    with pytest.raises(Exception, match="8 dimensions"):
        store.insert(sources(spark, ("a", "1", "x", 1)).withColumns({"content": F.col("text"), "embedding": F.array(F.lit(1.0))}))
    assert store.insert(sources(spark).withColumn("content", F.col("text"))) == store.version()


def test_stream(spark, store, tmp_path):
    source = str(tmp_path / "changes")
    write = lambda *rows: sources(spark, *rows).coalesce(1).write.mode("append").parquet(source)
    write(("a", "1", "old", 1), ("a", "1", "newest", 3), ("a", "2", "stays", 1))
    stream = spark.readStream.schema(SOURCES).parquet(source)
    go = lambda: ingest.run(stream, store, Chunker(50, 0), P.HashEmbedder(8), str(tmp_path / "cp"), availableNow=True).awaitTermination()
    go()
    assert said(store) == [("1", "newest"), ("2", "stays")]
    write(("a", "2", None, 2))
    go()
    assert said(store) == [("1", "newest")]


def test_a_change_costs_no_more_than_itself(spark, store):
    rows = lambda *x: sources(spark, *[("a", i, t, 1) for i, t in x]).withColumn("content", F.col("text"))
    store.insert(rows(*[(str(k), f"text {k}") for k in range(50)]))
    first = store.manifest()["tenants"]["a"]["data"]
    for k in range(3):
        store.replace_sources(rows(("7", "")), rows(("7", f"new {k}")))
    now = store.manifest()["tenants"]["a"]
    assert now["data"][:1] == first and len(now["data"]) == 4 and len(now["gone"]) == 3
    assert spark.read.parquet(*[f"{store.path}/{f}" for f in now["data"][1:]]).count() == 3
    assert dict(said(store))["7"] == "new 2" and len(said(store)) == 50
    store.replace_sources(rows(("7", "")), rows(("7", "text 7")))  # what was there at first, again
    store.delete_source("a", "faq", None)
    assert dict(said(store))["7"] == "text 7" and len(said(store)) == 50
    before = said(store)
    store.compact("a")
    assert said(store) == before and len(store.manifest()["tenants"]["a"]["data"]) == 1 and not store.manifest()["tenants"]["a"]["gone"]
    small = DocumentStore(spark, store.path, 8, compact_after=2)
    for k in range(4):
        small.insert(rows((f"n{k}", "x")))
    assert len(store.manifest()["tenants"]["a"]["data"]) <= 3 and len(said(store)) == 54


def test_migrations(spark, store):
    rows = lambda *x: sources(spark, *[("a", i, t, 1) for i, t in x]).withColumn("content", F.col("text"))
    store.insert(rows(("1", "the license of hands"), ("2", "a hand"), ("3", "other words")))
    with pytest.raises(ValueError, match="no trigram index"):
        store.index("trigram", "a")
    assert store.migrate() == ["001_documents", "002_trigram_postings", "003_lexeme_postings"] and store.migrate() == []
    full = DocumentStore(spark, store.path, 8, frozenset({"cjk", "textsearch", "rls"}))
    assert full.migrate() == ["004_rls", "005_cjk_bigram_postings", "007_textsearch_term_postings"]
    assert store.scan().count() == 0 and store.scan("a").count() == 3  # the store has it, whoever opens it

    def broken(s, manifest):
        raise RuntimeError("no")

    before = store.version()
    with pytest.raises(RuntimeError):
        full.migrate((Migration("008_fine", lambda s, m: m), Migration("009_broken", broken)))
    assert store.version() == before + 1 and "008_fine" in store.manifest()["migrations"] and "009_broken" not in store.manifest()["migrations"]
    store.replace_sources(rows(("2", "")), rows(("2", "a license, a license")))
    store.insert(rows(("4", "hand of the license")))
    live = {r["id"]: r["source_id"] for r in store.scan("a").collect()}
    terms = sorted((live[r["id"]], r["term"], r["tf"], r["len"]) for r in store.index("term", "a").collect() if r["term"] in ("license", "hand"))
    assert terms == [("1", "license", 1, 4), ("2", "license", 2, 4), ("4", "hand", 1, 4), ("4", "license", 1, 4)]
    stems = sorted((live[r["id"]], r["positions"]) for r in store.index("lexeme", "a").where("lexeme = 'hand'").collect())
    assert stems == [("1", [4]), ("4", [1])]  # "of" and "the" have places, but no lexemes
    assert {live[r["id"]] for r in store.index("bigram", "a").collect()} == {"1", "2", "3", "4"}
    assert store.index("term").count() == 0  # row-level security


def test_legs_from_postings(spark, store):
    store.migrate()
    DocumentStore(spark, store.path, 8, frozenset({"cjk", "textsearch", "vectorchord"})).migrate()
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120)
    store.insert(texts.select(F.lit("a").alias("tenant_id"), F.lit("d").alias("source_type"), F.col("doc_id").cast("string").alias("source_id"), F.col("text").alias("content"), F.col("lang").alias("language")))
    store.delete_source("a", "d", "3")
    docs = store.scan("a").persist()
    q = spark.createDataFrame([(1, "released under the license", "en"), (2, "license", "en"), (5, "token", "en"), (3, None, "en"), (4, "", "en")], "query_id int, text string, language string")
    built = q.select("query_id", "text", F.lit(None).cast("string").alias("built"), F.lit("english").alias("config"))
    same = lambda x, y: sorted(map(tuple, x.collect())) == sorted(map(tuple, y.collect())) and x.count() > 0
    assert same(legs.bigram_posted(store.index("bigram", "a"), q, 20), legs.bigram(docs, q, 20))
    assert same(legs.trigram_posted(store.index("trigram", "a"), docs, q, 20), legs.trigram(docs, q, 20))
    assert same(legs.bm25_posted(store.index("term", "a"), docs, q, 20), legs.bm25(docs, q, 20))
    assert same(legs.tsvector_posted(store.index("lexeme", "a"), built, 20), legs.tsvector(docs, built, 20))
    assert same(legs.tsvector_posted(store.index("lexeme", "a"), built, None), legs.tsvector(docs, built, None))


def test_files(spark, tmp_path, caplog):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nbroken\n{"a": 2}\n')
    assert [r["a"] for r in read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").collect()] == [1, 2]
    assert "1 lines" in caplog.text
    write_jsonl(spark.createDataFrame([(1, None), (2, "é")], "a int, b string"), str(tmp_path / "out"))
    assert [tuple(r) for r in read_jsonl(spark, str(tmp_path / "out"), "a int, b string").orderBy("a").collect()] == [(1, None), (2, "é")]
    write_results(spark, str(tmp_path / "r.json"), {"summary": spark.createDataFrame([(3, 0.5)], "n int, mrr_10 double")}, model="none")
    assert json.loads((tmp_path / "r.json").read_text()) == {"model": "none", "summary": [{"n": 3, "mrr_10": 0.5}]}
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.txt").write_bytes(b"one\x0ctwo")
    (tmp_path / "files" / "b.txt").write_bytes(b"\xff")
    pages = read_pages(spark, str(tmp_path / "files"), lambda b: b.decode().split("\f")).collect()
    assert [(r["doc"].rpartition("/")[2], r["page"], r["text"]) for r in pages] == [("a.txt", 1, "one"), ("a.txt", 2, "two")]
    q = {"version": 1, "queries": [{"id": "1", "domain": "d", "provider": "p", "target_doc": "t", "target_snippet": "s", "variants": {"written": "w", "spoken": "x"}}]}
    (tmp_path / "q.json").write_text(json.dumps(q))
    assert sorted((r["variant"], r["text"]) for r in read_queries(spark, str(tmp_path / "q.json")).collect()) == [("spoken", "x"), ("written", "w")]
    (tmp_path / "bad.json").write_text('{"queries": []}')
    with pytest.raises(Exception, match="no queries file"):
        read_queries(spark, str(tmp_path / "bad.json")).collect()


def test_corpus(spark):
    faq = spark.createDataFrame([("faq:1", "why", "because")], "doc_id string, question string, answer string")
    pages = spark.createDataFrame([("pdf:1", 1, "text")], "doc string, page int, text string")
    got = build_corpus(faq, pages, Chunker(), lambda p: p.select("doc", "text"), with_question=True).collect()
    assert sorted((r["chunk_id"], r["source"], r["content"]) for r in got) == [("faq:1#0", "faq", "why\nbecause"), ("pdf:1#0", "pdf", "text")]


def test_providers_keep_for_a_while(spark):
    now, loads = [0.0], []
    c = P.Cached(lambda t: loads.append(t) or len(loads), 30, lambda: now[0])
    assert (c.get("a"), c.get("a")) == (1, 1)
    now[0] = 30
    assert c.get("a") == 2
    c.invalidate("a")
    assert c.get("a") == 3
    words = spark.createDataFrame([("a", "en", "The"), ("a", "de", "und"), ("b", "en", "x")], "tenant_id string, language string, word string")
    assert P.stop_words(words).get("a") == ["the", "und"] and P.stop_words(words, lambda w, lang: w[:2]).get("a") == ["th", "un"]
    syn = spark.createDataFrame([("a", "en", "tv", '["television"]', "two_way")], "tenant_id string, language string, term string, synonyms string, direction string")
    assert P.synonym_lookup(syn).get("a") == {"en": {"tv": ["television"], "television": ["tv"]}}


def test_http_embedder():
    calls, waits = [], []

    def post(url, body, headers, timeout):
        calls.append(body["input"])
        if len(calls) == 1:
            raise urllib.error.HTTPError(url, 503, "busy", {}, None)
        return {"data": [{"index": k, "embedding": [float(k)]} for k in reversed(range(len(body["input"])))]}

    e = P.HttpEmbedder("u", "m", batch=2, post=post, sleep=waits.append)
    assert e.embed_documents(["a", "b", "c"]) == [[0.0], [1.0], [0.0]] and calls[0] == ["passage: a", "passage: b"] and waits == [0.25]
    assert e.embed_query("x") == [0.0] and calls[-1] == ["query: x"]
    for bad in ({}, {"data": []}, {"data": [{"embedding": []}]}, {"data": [{"embedding": [float("nan")]}]}, {"data": [{"index": 3, "embedding": [1.0]}]}):
        with pytest.raises(ValueError):
            P.HttpEmbedder("u", "m", post=lambda *a, bad=bad: bad).embed_query("x")

    def refused(*a):
        raise urllib.error.HTTPError("u", 400, "no", {}, None)

    with pytest.raises(urllib.error.HTTPError):
        P.HttpEmbedder("u", "m", post=refused, sleep=waits.append).embed_query("x")
    assert waits == [0.25]


def test_other_endpoints():
    assert P.HttpReranker("u", post=lambda *a: [{"index": 1, "score": 0.5}])("q", ["a", "b"]) == [0.0, 0.5]
    s = P.HttpSegmenter("u", post=lambda u, b, h, t: {"text": " ".join(b["text"])})
    assert s.segment("กขค", "th-TH") == "ก ข ค" and s.segment("abc", "en") == "abc"
    with pytest.raises(ValueError):
        P.HttpSegmenter("u", post=lambda *a: {"text": "x"}).segment("กขค", "th")


def test_judge_and_word_list(spark):
    asked = []

    def post(url, body, headers, timeout):
        asked.append(body["messages"][0]["content"])
        return {"choices": [{"message": {"content": "2, 0 and 1"}}]}

    judge = P.HttpJudge("u", "m", post=post)
    assert judge.grade("q?", ["a", "b", "c", "d"]) == [2, 0, 1, 0] and judge.grade("q?", ["a"]) == [2] and judge.grade("q?", []) == [] and len(asked) == 2 and "q?" in asked[0]
    plain = P.HttpJudge("u", "m", post=lambda *_: {"choices": [{"message": {"content": "1 2"}}]})
    rows = spark.createDataFrame([("q", ["x", None])], "query string, texts array<string>")
    assert P.judged(rows, plain).first()["grades"] == [1, 2]
    s = P.DictionarySegmenter(["ราคา", "ราคาแพง", "มาก", "ab"])
    assert s.segment("ราคาแพงมาก", "th-TH") == "ราคาแพง มาก" and s.segment("xxราคาyมาก", "th") == "xx ราคา y มาก" and s.segment("ab c", "en") == "ab c" and s.segment(" ", "th") == " "
    assert s.segment("ราคากิมาก", "th") == "ราคา กิ มาก"
    syn = spark.createDataFrame([("a", "en", "TV", '["Television"]', "two_way")], "tenant_id string, language string, term string, synonyms string, direction string")
    assert P.synonym_lookup(syn, lambda w, lang: w[:3]).get("a") == {"en": {"tv": ["tel"], "tel": ["tv"]}}


def test_postings_are_built_without_a_shuffle(spark):
    from tarnwell.sources import postings
    from tarnwell.sources.store import _stored

    rows = spark.createDataFrame([(str(k), "a", "s", str(k), "0", t, None, "en", None, "{}", None, 1, "english", "english", n) for k, (t, n) in enumerate([("The hand of the other Hand", 6), ("", 0), ("a b a", 3), ("ÄÖ ß 1", 3)])], _stored())
    for kind in ("trigram", "bigram", "term", "lexeme"):
        built = postings.build(kind, rows)
        assert "Exchange" not in built._jdf.queryExecution().executedPlan().toString(), kind
        column = {"term": "term", "lexeme": "lexeme"}.get(kind, "gram")
        for part in built.select(column).rdd.glom().collect():
            assert part == sorted(part)
    got = {(r["id"], r["term"], r["tf"], r["len"]) for r in postings.build("term", rows).collect()}
    assert got == {("0", "the", 2, 6), ("0", "hand", 2, 6), ("0", "of", 1, 6), ("0", "other", 1, 6), ("2", "a", 2, 3), ("2", "b", 1, 3), ("3", "äö", 1, 3), ("3", "ß", 1, 3), ("3", "1", 1, 3)}
    grams = {(r["id"], r["gram"]) for r in postings.build("bigram", rows).where("id = 2").collect()}
    assert grams == {("2", ord(x) << 21 | ord(y)) for x, y in zip(" a b a", "a b a ")}
