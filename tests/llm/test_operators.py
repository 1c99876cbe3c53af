"""Operators against brute force, round trips and held-out rows."""

import itertools
import random
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tarnwell.llm import bpe, chat, decontam, embed, html_text, licenses, minhash, pairs, pii, queries, store, toxicity
from tarnwell.llm.words import grams, mix, mix_int, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").persist()


# HTML


def brute_regions(size, p):
    block = [sum(size[i : i + p.block]) for i in range(len(size))] + [-1]
    out, i = [], 0
    while i < len(size):
        if block[i] < p.surge:
            i += 1
            continue
        j = next(k for k in range(i, len(size) + 1) if block[k] < p.dive)
        end = j + 1 if j < len(size) and size[j] >= p.least_line else j
        long = [k for k in range(i, min(end, len(size))) if size[k] >= p.least_line]
        if long:
            out.append((long[0], long[-1] + 1))
        i = j + 1 if j < len(size) else j
    return out


@given(st.lists(st.integers(0, 200), max_size=40))
@settings(max_examples=300, deadline=None)
def test_regions(size):
    p = html_text.Params()
    assert html_text.regions(size, p) == brute_regions(size, p)


def test_main_text_of_page():
    paragraph = "This sentence of the article is long enough to count as text of the page, so it stays. " * 2
    page = f"<html><head><title>T</title></head><body><nav><ul>{'<li><a href=/x>link</a></li>' * 9}</ul></nav><script>var x = '<p>{paragraph}</p>'</script><!-- {paragraph} --><article><p>{paragraph}</p><p>A &amp; B</p><p>{paragraph}</p></article><footer>© me</footer></body></html>"
    text, n = html_text.text_of(page)
    assert n == 1 and text.split("\n") == [paragraph.strip(), "A & B", paragraph.strip()]


# chat


def test_streamed_answer_is_regenerated(spark):
    log = [(1, 0, "message", 0, "user", "hi"), (1, 1, "message", 1, "assistant", "he"), (1, 2, "delta", 1, "assistant", "llo"), (1, 3, "message", 2, "user", "more"), (1, 4, "regenerate", 1, "assistant", "he"), (1, 5, "delta", 1, "assistant", "y"), (1, 6, "edit", 0, "user", "hi!")]
    df = spark.createDataFrame(log, "conv_id long, seq long, kind string, message long, role string, text string")
    out = chat.render(chat.messages(chat.events(df, "seq", "kind", "message"))).first()
    assert out["transcript"] == "<|im_start|>user\nhi!<|im_end|>\n<|im_start|>assistant\nhey<|im_end|>\n"


# token store


def test_store_round_trip(spark, docs):
    path = store.write(docs)
    kept = store.verify(spark, path).collect()
    assert len(kept) == docs.count() and all(r["verified"] for r in kept)
    b = bpe.bpe(bpe.Params())
    tokens = {r["doc_id"]: r["tokens"] for r in store.reconstruct(spark, path).collect()}
    for r in docs.collect():
        assert tokens[r["doc_id"]] == b.enc.encode_ordinary(r["text"])
    chunks = store.chunks(spark, path).collect()
    uses = store.recipes(spark, path).select(F.explode("digests").alias("digest"))
    assert len({bytes(c["digest"]) for c in chunks}) == len(chunks) == uses.distinct().count() < uses.count()


def test_store_tokenises_at_the_cost_of_one_call_a_text():
    rng = np.random.default_rng(3)
    b, p = bpe.bpe(bpe.Params()), bpe.Params(slice_chars=1 << 14)
    made = np.array(list("aeiounrst"))[rng.integers(9, size=(300_000, 9))].view("U9").reshape(-1, 300)  # more words than the encoder remembers, hardly one of them twice
    texts = [" ".join(x) for x in made.tolist()]
    odd = [None, "", "  two\n\n", "a word and more " * 3000, "中" * 20_000 + "x"]  # the last two are longer than a slice
    rows = pa.array(texts[:20] + odd + texts[20:40])
    got = [t for _, _, tokens in store.tokenised(rows, p) for t in tokens]
    assert [t.tolist() for t in got] == [b.enc.encode_ordinary(t or "") for t in rows.to_pylist()]

    def seconds(run):
        at = time.process_time()
        run()
        return time.process_time() - at

    one_call = lambda: [np.array(b.enc.encode_ordinary(t), dtype=np.int32) for t in texts]
    whole = lambda: list(store.tokenised(pa.array(texts), bpe.Params()))
    assert min(seconds(whole) for _ in range(3)) < 2 * min(seconds(one_call) for _ in range(3))


@pytest.mark.parametrize("damage", ["payload", "size", "lost"])
def test_damage_is_found(spark, docs, damage):
    path = store.write(docs.limit(20))
    recipes, stored = store.recipes(spark, path), store.chunks(spark, path)
    rows = [r.asDict() for r in stored.orderBy("digest").collect()]
    hit = rows[len(rows) // 2]["digest"]
    users = {r["doc_id"] for r in recipes.collect() if hit in r["digests"]}
    if damage == "payload":
        rows = [r | ({"payload": bytes(r["payload"][:-1]) + bytes([r["payload"][-1] ^ 1])} if r["digest"] == hit else {}) for r in rows]
    elif damage == "size":
        rows = [r | ({"n_ids": r["n_ids"] + 1} if r["digest"] == hit else {}) for r in rows]
    else:
        rows = [r for r in rows if r["digest"] != hit]
    other = path + "-damaged"
    recipes.write.parquet(f"{other}/part=recipes")
    spark.createDataFrame(rows, stored.schema).write.parquet(f"{other}/part=chunks")
    assert users and {r["doc_id"] for r in store.verify(spark, other).collect() if not r["verified"]} == users


@given(st.lists(st.integers(0, 50_000), max_size=3000))
@settings(max_examples=30, deadline=None)
def test_cuts(ids):
    p, a = store.Params(), np.array(ids, dtype=np.int32)
    ends = store.cuts(a, p)
    sizes = np.diff([0, *ends])
    assert (ends[-1:] or [0]) == [len(ids)] and (sizes <= p.most).all() and (sizes[:-1] >= p.least).all()


def test_cuts_follow_content():
    a = np.random.default_rng(0).integers(0, 50_000, 6000).astype(np.int32)
    b = np.concatenate([np.arange(37, dtype=np.int32), a])
    one, two = store.cuts(a, store.Params()), [e - 37 for e in store.cuts(b, store.Params())]
    assert len(set(one) & set(two)) > 0.7 * len(one)


# decontamination


def brute_matches(rows, items, p):
    def ws(t):
        return words(pa.array([t])).hash.tolist() if t else []

    out = {}
    for (d, dt), (i, it) in itertools.product(rows, items):
        a, b = ws(dt), ws(it)
        if len(b) < p.least_item:
            continue
        need, best = min(p.min_words, len(b)), None
        for x, y in itertools.product(range(len(a)), range(len(b))):
            n = 0
            while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                n += 1
            if n >= need and (best is None or (-n, x, y) < best):
                best = (-n, x, y)
        if best:
            out[d, i] = (-best[0], best[1], best[2])
    return out


def test_longest_matches(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(6)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(n)) for k, n in enumerate((30, 20, 14, 13, 12, 9, 7, 40))]
    rows = [(k, text(rng.randrange(0, 60))) for k in range(20)]
    rows += [(100 + k, f"{text(5)}, {t.upper()}! {text(4)}") for k, t in items] + [(200, items[0][1][:60]), (201, items[7][1] + " " + items[7][1])]
    p = decontam.Params(block_words=150)
    got = decontam.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), p).collect()
    assert {(r["doc_id"], r["item_id"]): (r["match_words"], r["doc_word"], r["item_word"]) for r in got} == brute_matches(rows, items, p)
    several = decontam.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), decontam.Params(broadcast_chars=100))
    assert several.count() == len(got)


# PII


def test_personal_data(spark):
    clean = [(k, f"plain text number {k} about version 2.1.3 and 12 of 345 things") for k in range(50)]
    said = {100: ("write to ann.lee@mail.example.com today", "email", "ann.lee@mail.example.com"), 101: ("call +1 (212) 555-0142 now", "phone", "+1 (212) 555-0142"), 102: ("host 192.0.2.77 is up", "ip", "192.0.2.77"), 103: ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962"), 104: ("card 4111111111111111 was used", "account", "4111111111111111"), 105: ("card 9807915762804490!!", "account", "9807915762804490"), 106: ("IBAN DE89370400440532013000 here", "iban", "DE89370400440532013000"), 107: ("ssn 123-45-6789 there", "ssn", "123-45-6789")}
    rows = clean + [(k, t) for k, (t, _, _) in said.items()] + [(300 + k, f"mail{k}@mail.example.com and 10.{k}.7.9 and {4000_0000_0000_0000 + 7919 * k}") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    text = dict(rows)
    found = {}
    for r in pii.spans(df, pii.fit(df)).collect():
        found.setdefault(r["doc_id"], []).append((r["kind"], text[r["doc_id"]][r["start"] : r["end"]]))
    assert not set(found) & {k for k, _ in clean}
    for k, (_, kind, span) in said.items():
        assert found.get(k) == [(kind, span)], (k, found.get(k))
    assert all(sorted(x[0] for x in found[300 + k]) == ["account", "email", "ip"] for k in range(40))


def test_reliabilities_are_found():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.3
    right = np.array([0.95, 0.9, 0.85, 0.6, 0.8])
    votes = np.where(rng.random((20_000, 5)) < right, 1, -1) * np.where(truth, 1, -1)[:, None]
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    q, got, share = pii.reliabilities(patterns, n.astype(float), pii.Params())
    assert abs(share - 0.3) < 0.02 and np.abs(got[0] - right).max() < 0.04


# BPE

ALPHABET = st.text(st.sampled_from("ab Z'sltdrevm.,!?\n\t  é1２中👍́‍\x1c\xa0x"), max_size=80)


@given(ALPHABET, st.integers(2, 9))
@settings(max_examples=500, deadline=None)
def test_tree_gives_the_tokens_of_the_whole(text, leaf):
    b = bpe.bpe(bpe.Params(leaf_chars=leaf, window_chars=2))
    tokens = b.encode(text)
    assert tokens.tolist() == b.enc.encode_ordinary(text) and b.decode(tokens) == text.encode()


def test_text_without_cuts():
    b = bpe.bpe(bpe.Params(leaf_chars=64))
    for text in ("abcdefghij" * 3000, "中" * 5000, " " * 3000 + "x", "'" * 3000, "<|endoftext|>" * 100):
        assert b.encode(text).tolist() == b.enc.encode_ordinary(text)


def test_encoded_frames_decode(spark, docs):
    rows = bpe.encode(docs)
    assert rows.where("not round_trip").count() == 0
    both = bpe.decode(rows).join(docs.select("doc_id", F.col("text").alias("t")), "doc_id")
    assert both.where("text = t").count() == docs.count()


# toxicity


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    model = toxicity.fit(d, labels.where(~held))
    scored = toxicity.score(d, model).join(labels.where(held).select("doc_id", F.col("toxic").alias("label")), "doc_id")
    n = {(r["label"], r["toxic"]): r["count"] for r in scored.groupBy("label", "toxic").count().collect()}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) > 0.9 and n.get((0, True), 0) / n[0, False] < 0.02


def test_severity_is_ordered(spark):
    rows = [(k, "good plain words here") for k in range(60)] + [(100 + k, "good words " + "awful nasty vile " * (1 + k % 9)) for k in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _ in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(d, toxicity.fit(d, labels)).collect()}
    assert got[0]["expected_severity"] < got[100]["expected_severity"] < got[108]["expected_severity"]
    assert all(got[i]["toxic"] == (i >= 100) for i, _ in rows)


# near-duplicates


def brute_classes(rows, linked):
    """{id: (class, links)} of rows (id, thing) by all pairs; linked says whether two things are. Equal rows are one."""
    rows = list(dict.fromkeys(rows))
    n, root = {}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, x), (j, y) in itertools.combinations(rows, 2):
        if linked(x, y):
            n[i], n[j] = n.get(i, 0) + 1, n.get(j, 0) + 1
            a, b = sorted((find(i), find(j)))
            root[b] = a
    for (i, x), (j, y) in itertools.combinations(rows, 2):
        if i != j and x == y:  # what can't be linked with itself, such as an empty text, doesn't come here
            assert linked(x, y)
    return {i: (find(i), n[i]) for i in n}


def copies_of_copies(seed, bases, words_=60):
    rng = random.Random(seed)
    rows = []
    for _ in range(bases):
        text = [f"v{rng.randrange(300)}" for _ in range(rng.randrange(20, words_ + 20))]
        for c in range(rng.randrange(1, 7)):
            copy = list(text)
            for _ in range(rng.randrange(0, 5) * c):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(300)}"
            rows += [" ".join(copy)] * rng.choice([1, 1, 1, 2, 5])
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("p", [minhash.Params(), minhash.Params(block=2, hot=3)])
def test_links_are_those_of_all_signatures(spark, p):
    texts = copies_of_copies(2, 25)
    rows = list(enumerate(texts)) + [(0, texts[1]), (2, texts[3]), (2, texts[2]), (900, texts[0]), (900, texts[5])]  # ids of several texts, too
    # signatures of their own: the least of each hash over the set of shingles
    factors = [int(f) for f in mix(np.arange(1, p.coordinates + 1, dtype=np.uint64) * np.uint64(2 * p.seed + 1) << np.uint64(20)) | np.uint64(1)]
    gram = {}

    def signature(text):
        ws = text.split()
        own = set()
        for k in range(max(1, len(ws) - p.shingle + 1)):
            g = tuple(ws[k : k + p.shingle])
            if g not in gram:
                gram[g] = int(grams(words(pa.array([" ".join(g)])).hash, len(g))[0])
            own.add(gram[g])
        return tuple(mix_int(min(g * f & (2**64 - 1) for g in own)) >> 32 for f in factors)

    sig = {t: signature(t) for t in set(texts)}
    want = brute_classes([(i, sig[t]) for i, t in rows], lambda x, y: sum(map(int.__eq__, x, y)) >= p.least)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string"), p).collect()}
    assert got == want and len(got) > 60 and max(n for _, n in got.values()) > 4


@pytest.mark.parametrize("finish", [0, 10**6])
def test_components(spark, finish):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(1900, 1980)] + [(None, 1), (5, 5)]
    got = {r["id"]: r["group"] for r in pairs.components(spark.createDataFrame(edges, "a long, b long").repartition(5), "a", "b", finish, hot=20).collect()}
    want = brute_classes([(v, v) for e in edges if None not in e and e[0] != e[1] for v in e], lambda x, y: False)
    root = {v: v for e in edges if None not in e and e[0] != e[1] for v in e}
    for _ in range(len(root)):
        for a, b in edges:
            if a in root and b in root:
                root[a] = root[b] = min(root[a], root[b])
    assert not want and got == root


def test_a_key_of_a_million_rows(spark):
    """Signatures that all share a value, which is skipped, and copies that are one posting: linear, and no task numbers or holds them."""
    n = 1_000_000
    began = time.time()
    rows = spark.range(n).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("node"))
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert pairs.by_key(rows, table, "k", hot=100_000).count() == n
    assert time.time() - began < 60
    copies = spark.range(200_000).select(F.col("id").alias("doc_id"), F.lit("one text that very many documents share, word by word").alias("text"))
    got = minhash.classes(copies).agg(F.count("*"), F.min("class_id"), F.max("class_id"), F.min("n_links"), F.max("n_links")).first()
    assert tuple(got) == (200_000, 0, 0, 199_999, 199_999) and time.time() - began < 120


def test_one_document_of_each_group_stays(spark):
    text = " ".join(f"t{k}" for k in range(60))
    rows = [(5, text), (3, text + " end"), (9, "start " + text), (4, "quite another text of its own"), (None, text)]
    kept = minhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r[0] is None, r[0] or 0) for r in kept.select("doc_id").collect()) == [(False, 3), (False, 4), (True, 0)]


def test_blocks_meet_once(spark):
    df = spark.range(37).select((F.col("id") % 2).alias("key"), F.col("id").alias("node"))
    large = df.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 4")
    cut = pairs.blocked(df, "key", "node", large, block=4)

    def fn(b, size):
        side, node = b.column("side").to_numpy(), b.column("node").to_numpy()
        across = b.column("across").to_numpy(zero_copy_only=False)
        for i, j in pairs.part_pairs(size, 10):
            ok = (side[i] != side[j]) | ~across[i]
            yield pa.RecordBatch.from_arrays([pa.array(node[i[ok]]), pa.array(node[j[ok]])], names=["a", "b"])

    got = sorted(tuple(sorted(r)) for r in pairs.by_part(cut, "key", fn, "a long, b long").collect())
    assert got == sorted((i, j) for i, j in itertools.combinations(range(37), 2) if i % 2 == j % 2)


# licences


def test_licenses_against_sql(spark):
    rng = random.Random(8)
    filler = lambda n: " ".join(rng.choice(["lorem", "ipsum", "the", "license", "under"]) for _ in range(n))
    rows = []
    for k, (_, t) in enumerate(licenses.TEMPLATES * 2):
        ws = t.split()
        for _ in range(k % 4):
            ws[rng.randrange(len(ws))] = "changed"
        ws.insert(rng.randrange(len(ws)), "inserted")
        rows.append((k, f"{filler(7)}\n{' '.join(ws)}. {filler(5)}"))
    rows += [(90, None), (91, ""), (92, rows[3][1]), (92, rows[3][1]), (93, licenses.TEMPLATES[1][1] + ". " + licenses.TEMPLATES[1][1]), (94, licenses._MIT + " " + licenses._APACHE)]
    got = sorted(tuple(r) for r in licenses.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert got == sorted(c.execute(licenses.oracle_sql()).fetchall())
    assert {r[1] for r in got if r[0] == 94} == {"MIT", "Apache-2.0"} and len([r for r in got if r[0] == 93]) == 2 and len(got) > 20


# embeddings


def near_vectors(seed, n, dim=64, low=0.86, high=0.97):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((n, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal((n, dim))
    b -= (b * a).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    s = rng.uniform(low, high, n)[:, None]
    return np.float32(np.concatenate([a, a * s + b * np.sqrt(1 - s * s)]))


@pytest.mark.parametrize("p", [embed.Params(), embed.Params(block=3, hot=5)])
def test_near_embeddings(spark, tmp_path, p):
    """Against SQL: vectors around the threshold, a chain, a large group, and copies."""
    x = near_vectors(0, 150)
    rng = np.random.default_rng(1)
    group = np.float32(x[0] + rng.standard_normal((40, 64)) * 0.02)
    x = np.concatenate([x, group, x[:5], x[:1], group[:3] * 2])
    rows = [(1000 - k, [float(v) for v in r]) for k, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {a: (b, n) for a, b, n in c.execute(queries.OP10_SQL).fetchall()}
    found = embed.classes(df, p).collect()
    got = {r["vec_id"]: (r["class_id"], r["n_links"]) for r in found}
    assert set(got) == set(want) and len(got) == len(rows)
    links = sum(n for _, n in want.values())
    assert sum(abs(got[i][1] - want[i][1]) for i in want) <= 0.02 * links and all(got[i][1] <= want[i][1] and got[i][0] >= want[i][0] for i in want)
    assert 0 < sum(r["n_exact"] for r in found) < links


def test_recall_at_the_threshold(spark):
    for n in (300, 3000):
        x = near_vectors(5, n, low=0.9, high=0.905)
        got = embed.classes(spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<float>")).agg(F.sum("n_links")).first()[0] / 2
        y = x.astype(float)
        y /= np.linalg.norm(y, axis=1)[:, None]
        want = np.triu(y @ y.T >= 0.9, 1).sum()
        assert 0.96 * want <= got <= want
    shapes = [embed.bands(n, embed.Params()) for n in (10**3, 10**6, 10**9)]
    assert [b for b, _ in shapes] == [14, 24, 34] and all(b * k < 40_000 for b, k in shapes)


def test_estimates_are_unbiased():
    rng = np.random.default_rng(4)
    x, y = (v / np.linalg.norm(v, axis=1)[:, None] for v in rng.standard_normal((2, 4000, 32)))
    y = x * 0.7 + y * 0.5
    y = np.float32(y / np.linalg.norm(y, axis=1)[:, None])
    p = embed.Params()
    c, f = embed.codes(np.float32(x), p), embed.frame(32, p)
    n = len(f)
    estimate = ((c.bits * 2.0 - 1) / np.sqrt(n) * (y @ f.T / np.sqrt(n / 32))).sum(axis=1) / c.factor
    error = estimate - (x * y).sum(axis=1)
    assert abs(error.mean()) < 0.002 and 0.5 < error.std() / (c.error * np.sqrt(1 - (x * y).sum(axis=1) ** 2)).mean() < 1.3
