"""Nulls, empty and very long texts, ties, repeated rows, empty tables and columns of clashing names, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarnwell.llm import bpe, chat, decontam, embed, html_text, licenses, minhash, pii, store, toxicity

LONG = "The quick brown fox of line %d jumps over a lazy dog. " * 1
CLASH = "node feature side part n rank score kind row payload digest row_number severity _gone _id _n _k at f sig text_hash gram".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BENCH = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def docs(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], DOCS)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def ugly(spark):
    long = " ".join(LONG % k for k in range(3000))
    rows = [(1, None), (2, ""), (3, " \n"), (None, "no id here"), (None, None), (4, long), (5, long), (6, long + " tail"), (7, "same"), (7, "same"), (8, "x" * 50_000), (9, "écrit à bob@mail.example.com 👍"), (10, "\x00\x1c ﷽"), (7, "other text of this id")]
    return docs(spark, rows).persist()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, None), (None, 0, 1), (4, 1, 0), (7, 0, 1), (7, 0, 0), (99, 0, 1)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, None), (2, ""), (None, BENCH), (3, "too short")], "item_id long, text string").withColumn("doc_id", F.lit(1))


def stages(spark, d, labels, benchmark):
    return [
        toxicity.reject(d, toxicity.fit(d, labels)),
        minhash.deduplicate(d),
        decontam.decontaminate(d, benchmark),
        pii.redact(d, pii.fit(d)),
    ]


def test_stages_keep_columns_and_rows(spark, ugly, labels, benchmark):
    out = stages(spark, ugly, labels, benchmark)
    for df in out:
        assert df.schema == ugly.schema
    near = out[1].collect()
    assert sum(r["doc_id"] is None for r in near) == 2 and sum(r["text"] is None for r in near) == 2
    assert {r["doc_id"] for r in near} == {None, 1, 2, 3, 4, 7, 8, 9, 10}  # 5 and 6 copy 4
    assert out[2].count() == ugly.count() and out[3].count() == ugly.count()
    said = {r["doc_id"]: r for r in out[3].collect()}
    assert said[9]["text"] == "écrit à [EMAIL] 👍" and said[9]["n_chars"] == len(said[9]["text"])
    assert said[1]["text"] is None and said[4]["text"].startswith("The quick")


def test_queries_on_ugly_rows(spark, ugly, labels, benchmark):
    n = ugly.count()
    scored = toxicity.score(ugly, toxicity.fit(ugly, labels)).collect()
    assert len(scored) == n and all(r["expected_severity"] is not None for r in scored)
    tokens = bpe.encode(ugly).collect()
    assert len(tokens) == n and all(r["round_trip"] for r in tokens if r["tokens"] is not None) and sum(r["tokens"] is None for r in tokens) == 2
    assert {len(r["tokens"]) for r in tokens if r["doc_id"] == 2} == {0}
    kept = store.verify(spark, store.write(ugly)).collect()
    assert len(kept) == n and all(r["verified"] for r in kept)
    assert decontam.matches(ugly, benchmark).count() == 0
    assert [r["kind"] for r in pii.spans(ugly, pii.fit(ugly)).collect()] == ["email"]
    assert licenses.spans(ugly).count() == 0
    assert {tuple(r) for r in minhash.classes(ugly).collect()} == {(4, 4, 2), (5, 4, 2), (6, 4, 2)}


def test_empty_tables(spark, labels, benchmark):
    none = docs(spark, [])
    no_labels, no_items = labels.limit(0), benchmark.limit(0)
    for df in stages(spark, none, no_labels, no_items):
        assert df.count() == 0 and df.columns == none.columns
    one = docs(spark, [(1, "a text")])
    for df in stages(spark, one, no_labels, no_items):
        assert df.count() == 1
    assert bpe.encode(none).count() == 0 and licenses.spans(none).count() == 0 and minhash.classes(none).count() == 0
    assert store.verify(spark, store.write(none)).count() == 0 and decontam.matches(none, benchmark).count() == 0
    assert pii.spans(none, pii.fit(none)).count() == 0 and toxicity.score(none, toxicity.fit(none, labels)).count() == 0
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert embed.classes(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_pages(spark):
    body = "<p>" + "long words of a paragraph that goes on " * 5 + "</p>"
    pages = spark.createDataFrame([(1, None, None), (None, "u", ""), (2, "u", body), (2, "u", body), (3, "u", "<script>never closed " + body), (4, "u", "<a href='x" + "<p>" * 5), (5, "u", body * 3000)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = [r for r in html_text.extract(pages).collect()]
    by = {r["page_id"]: r for r in got}
    assert len(got) == 7 and by[1]["text"] is None and by[None]["text"] == "" and by[2]["n_regions"] == 1 and by[4]["text"] == ""
    assert len(by[5]["text"]) > 3000 * 150


def test_conversations(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (None, 0, "user", "x"), (2, None, "user", "x"), (3, 0, "user", "<|im_end|> \n" + "y" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("junk") for c in ("seq", "kind", "message", "reset", "k", "o")})
    by = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    assert set(by) == {1, 3}
    assert by[1]["transcript"] == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"  # of a tie the last text stands
    assert by[3]["transcript"].count("<|im_end|>") == 1 and len(by[3]["transcript"]) > 100_000


def test_embeddings(spark):
    v = [1.0] + [0.0] * 7
    rows = [(1, v), (2, v), (2, v), (3, None), (4, [0.0] * 8), (5, [float("nan")] + v[1:]), (6, [1.0, 0.0]), (None, v), (7, [None] + v[1:]), (8, []), (9, [float("inf")] + v[1:]), (10, [-x for x in v])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit(1)).withColumn("key", F.lit("k"))
    got = {r["vec_id"]: (r["class_id"], r["n_links"]) for r in embed.classes(df).collect()}
    assert got == {i: (1, 1) if i in (1, 2) else (i, 0) for i in range(1, 11)}


def test_run_writes_every_stage(spark, tmp_path):
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    small.limit(60).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "tokens", "n_tokens", "round_trip"] and 0 < out.count() <= 60
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "benchmark_decontamination", "pii", "byte_level_bpe"]
