"""Queries against versions that are written anew, in plain Python, from what their docstrings say."""

import hashlib
import html as html_
import math
import random
import re
import time
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

import corpus_pipeline
from tarnwell.llm import bpe, chat, decontam, licenses, minhash, pii, queries, store, toxicity
from tarnwell.llm.words import words

SF = "/root/testdata/sf0.001"


def rows_of(spark, name, *columns):
    return [tuple(r[c] for c in columns) for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]


def plain_words(text):
    """Runs of letters, marks and digits, each letter in lower case."""
    out, word = [], ""
    for c in text or "":
        if unicodedata.category(c)[0] in "LMN":
            word += c.lower() if len(c.lower()) == 1 else c
        elif word:
            out.append(word)
            word = ""
    return out + [word] * bool(word)


# 1


def plain_page(page):
    """For pages of plain markup: no comments, raw text elements dropped, one line an element."""
    block = "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
    page = re.sub(r"(?is)<(script|style|noscript|template|svg|head|iframe|textarea|select)\b[^>]*>.*?</\1\b[^>]*>", "<p>", page)
    page = re.sub(r"(?s)<!--.*?-->", "", page)
    lines, text, broke, pre = [], "", False, 0

    def close():
        nonlocal text
        if body := text.strip():
            before, _, after = text.partition(body)
            text = before + (body if pre else body.replace("\n", " ")) + after
        lines.append(text)
        text = ""

    for x in re.split(r"(</?[a-zA-Z][^>]*>|<![^>]*>)", page):
        m = re.fullmatch(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*>", x)
        if m is None:
            if x and not re.fullmatch(r"<![^>]*>", x):
                text, broke = text + x, False
        elif m.group(2).lower() in block:
            if not broke:
                close()
                lines.append("\n")
            broke = True
            if m.group(2).lower() == "pre":
                pre = max(0, pre - 1) if m.group(1) else pre + 1
    close()
    out = lines
    got = [re.sub(r"\s+", " ", html_.unescape(x)).strip() for x in "".join(out).split("\n")]
    size = [len(x) for x in got]
    window = [sum(size[k : k + 3]) for k in range(len(size))]
    kept, k = [], 0
    while k < len(size):
        if window[k] < 120:
            k += 1
            continue
        start, rest = k, window[k]
        while start < min(k + 3, len(size)) - 1 and size[start] < 40 and rest - size[start] >= 120:
            rest, start = rest - size[start], start + 1
        end = next((j for j in range(k + 1, len(size)) if window[j] < 40), len(size))
        kept.append((start, end))
        k = end + 1 if end < len(size) else end
    return "\n".join(x for a, b in kept for x in got[a:b] if x), len(kept)


def test_op1_on_whole_pages(spark):
    got = {r["page_id"]: (r["text"], r["n_regions"]) for r in queries.op1_html_extraction(spark, SF).collect()}
    pages = dict(rows_of(spark, "pages", "page_id", "html"))
    plain = {i: h for i, h in pages.items() if not re.search(r'<[^<>]*="[^"<]*>[^"<]*"', h)}
    assert len(got) == len(pages) and len(plain) > 0.8 * len(pages)
    assert {i: got[i] for i in plain} == {i: plain_page(h) for i, h in plain.items()}


# 2


def fold(log):
    """Events one after the other, over the state of their conversation. An event: (conv, seq, kind, message, role, text)."""
    order = {"message": 0, "edit": 1, "regenerate": 2, "delta": 3, "delete": 4}
    clean = set()
    for c, seq, kind, m, role, text in log:
        kind = kind if kind in order else "message"
        if c is not None and m is not None:
            clean.add((c, -(2**63) if seq is None else seq, order[kind], role if role is not None or kind != "message" else "user", text or "", m))
    state = {}
    for c, seq, kind, role, text, m in sorted(clean, key=lambda e: (e[0], e[1], e[2], e[3] is not None, e[3] or "", e[4], e[5])):
        now = state.setdefault(c, {})
        s = now.setdefault(m, {"text": "", "role": None, "spoken": None, "since": seq, "gone": False, "out": False})
        if kind == 3:
            s["text"] += text
            s["spoken"] = role if role is not None else s["spoken"]
            continue
        if kind == 4:
            s["gone"] = True
            continue
        s["text"], s["gone"] = text, False
        s["role"] = role if role is not None else s["role"]
        if kind == 0:
            s["since"], s["out"] = seq, False
        if kind == 2:
            for n, other in now.items():
                other["out"] |= n > m
    return sorted((c, m, s["role"] or s["spoken"] or "user", s["text"]) for c, now in state.items() for m, s in now.items() if not s["gone"] and not s["out"])


@pytest.mark.parametrize("seed", range(4))
def test_op2_folds_any_log(spark, seed):
    rng = random.Random(seed)
    log = [(rng.choice([0, 1, 2, 3, None]), rng.choice([None, *range(60)]), rng.choice(["message", "delta", "delta", "edit", "regenerate", "delete", None, "other"]), rng.choice([0, 1, 2, 3, 4, None]), rng.choice(["user", "assistant", "system", None, None]), rng.choice([*"abcd", "", None])) for _ in range(500)]
    df = spark.createDataFrame(log, "conv_id long, no long, what string, about long, role string, text string")
    got = chat.messages(chat.events(df, seq="no", kind="what", message="about")).collect()
    assert sorted(tuple(r) for r in got) == fold(log)


def test_op2_keeps_roles_and_what_is_discarded(spark):
    log = [(1, 0, "message", 0, "user", "q"), (1, 1, "message", 1, "assistant", "a"), (1, 2, "edit", 1, None, "b"), (1, 3, "message", 2, "user", "more"), (1, 4, "regenerate", 1, None, "c"), (1, 5, "edit", 2, None, "back?")]
    df = spark.createDataFrame(log, "conv_id long, seq long, kind string, message long, role string, text string")
    assert [tuple(r)[1:] for r in chat.messages(chat.events(df, "seq", "kind", "message")).orderBy("message").collect()] == [(0, "user", "q"), (1, "assistant", "c")] == [x[1:] for x in fold(log)]


# 3 and 6


def encoder():
    p = bpe.Params()
    import base64

    with open(p.tokenizer, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=p.pattern, mergeable_ranks=ranks, special_tokens={})


def manifest(ids, p=store.Params()):
    """(chunks, root): the rolling hash as Python integers, the tree by recursion."""
    mask, ends, at = 2**64 - 1, [], 0

    def mix(h):
        h ^= h >> 30
        h = h * 0xBF58476D1CE4E5B9 & mask
        h ^= h >> 27
        h = h * 0x94D049BB133111EB & mask
        return h ^ h >> 31

    marks = []
    for k in range(len(ids) - p.window + 1):
        h = 0
        for x in ids[k : k + p.window]:
            h = (h * 0x9E3779B97F4A7C15 + x) & mask
        if mix(h) % (1 << p.mask_bits) == 0:
            marks.append(k + p.window)
    for m in [*marks, len(ids)]:
        while m - at > p.most:
            at += p.most
            ends.append(at)
        if m - at >= p.least or m == len(ids) > at:
            at = m
            ends.append(at)
    b2 = lambda b: hashlib.blake2b(b, digest_size=p.digest_bytes).digest()
    leaves = [b2(b"\0" + b2(b"".join(x.to_bytes(2, "little") for x in ids[a:b]))) for a, b in zip([0, *ends], ends)]

    def tree(level):
        if len(level) < 2:
            return level[0] if level else b2(b"")
        up = [b2(b"\1" + level[k] + level[k + 1]) for k in range(0, len(level) - 1, 2)]
        return tree(up + ([level[-1]] if len(level) % 2 else []))

    return len(leaves), tree(leaves).hex()


def test_op3_and_op6_on_every_document(spark):
    enc = encoder()
    ids = {i: enc.encode_ordinary(t) for i, t in rows_of(spark, "documents", "doc_id", "text")}
    got = queries.op6_byte_level_bpe(spark, SF).collect()
    assert {r["doc_id"]: r["tokens"] for r in got} == ids and all(r["round_trip"] and r["n_tokens"] == len(r["tokens"]) for r in got)
    rows = queries.op3_token_store(spark, SF).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["n_chunks"], r["root"], r["verified"]) for r in rows} == {i: (len(x), *manifest(x), True) for i, x in ids.items()}


def thue_morse(n, a, b):
    t = [0]
    while len(t) < n:
        t += [1 - x for x in t]
    return "".join(a if x == 0 else b for x in t), "".join(b if x == 0 else a for x in t)


def test_texts_that_collide_under_powers(spark):
    """Differences of these two vanish under powers of any number modulo 2^64."""
    x, y = thue_morse(2048, "a", "b")
    h = words(pa.array([x, y])).hash
    assert h[0] != h[1]
    b, enc = bpe.bpe(bpe.Params()), encoder()
    assert [t.tolist() for t in b.encode_batch([x, y, x])] == [enc.encode_ordinary(t) for t in (x, y, x)]
    df = spark.createDataFrame([(1, x), (2, y)], "doc_id long, text string")
    path = store.write(df)
    assert {r["doc_id"]: r["tokens"] for r in store.reconstruct(spark, path).collect()} == {1: enc.encode_ordinary(x), 2: enc.encode_ordinary(y)}


def test_segments_of_one_hash_are_told_apart(monkeypatch):
    b, enc = bpe.Bpe(bpe.Params(), bpe.vocabulary(bpe.Params())), encoder()
    monkeypatch.setattr(bpe, "mix", lambda h: h & np.uint64(7))
    texts = ["the cat sat on the mat", "another text of other words", "", "the dog, 12 times"]
    for _ in range(2):
        assert [t.tolist() for t in b.encode_batch(texts)] == [enc.encode_ordinary(t) for t in texts]


# 4


def test_op4_in_several_passes(spark):
    docs, items = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    whole = sorted(tuple(r) for r in decontam.matches(docs, items).collect())
    assert whole and whole == sorted(tuple(r) for r in decontam.matches(docs, items, decontam.Params(broadcast_chars=700)).collect())
    assert sorted(r[0] for r in decontam.decontaminate(docs, items, decontam.Params(broadcast_chars=700)).select("doc_id").collect()) == sorted(r[0] for r in decontam.decontaminate(docs, items).select("doc_id").collect())


# 5


def test_op5_refitted(spark):
    p, docs = pii.Params(), rows_of(spark, "documents", "doc_id", "text")
    found = [(i, c) for i, t in docs for c in pii.candidates(t, p)]
    n = Counter(c[2:] for _, c in found)
    sigmoid = lambda z: 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))
    chance = {}
    for kind in range(len(pii.KINDS)):
        own = {k: c for k, c in n.items() if k[0] == kind}
        if not own:
            continue
        votes = {k: [k[1] // 3**j % 3 - 1 for j in range(5)] for k in own}
        hit, miss, share = [0.8] * 5, [0.8] * 5, 0.5
        for _ in range(p.em_steps):
            q = {}
            for k, v in votes.items():
                yes, no = math.log(share), math.log(1 - share)
                for j in range(5):
                    yes += math.log(hit[j]) if v[j] > 0 else math.log(1 - hit[j]) if v[j] < 0 else 0
                    no += math.log(1 - miss[j]) if v[j] > 0 else math.log(miss[j]) if v[j] < 0 else 0
                q[k] = sigmoid(yes - no)
            share = (sum(own[k] * q[k] for k in own) + 1) / (sum(own.values()) + 2)
            for j in range(5):
                cast = [k for k in own if votes[k][j]]
                hit[j] = (sum(own[k] * q[k] for k in cast if votes[k][j] > 0) + p.prior_right) / (sum(own[k] * q[k] for k in cast) + p.prior_right + p.prior_wrong)
                miss[j] = (sum(own[k] * (1 - q[k]) for k in cast if votes[k][j] < 0) + p.prior_right) / (sum(own[k] * (1 - q[k]) for k in cast) + p.prior_right + p.prior_wrong)
        x = {k: [1.0] + [float(v > 0) for v in votes[k]] + [float(v < 0) for v in votes[k]] + [float(k[2] == s) for s in range(6)] for k in own}
        w, m, v2, total = [0.0] * 17, [0.0] * 17, [0.0] * 17, sum(own.values())
        for t in range(1, p.fit_steps + 1):
            off = {k: own[k] / total * (sigmoid(sum(a * b for a, b in zip(w, x[k]))) - q[k]) for k in own}
            for f in range(17):
                g = sum(off[k] * x[k][f] for k in own) + (p.l2 * w[f] if f else 0)
                m[f], v2[f] = 0.9 * m[f] + 0.1 * g, 0.999 * v2[f] + 0.001 * g * g
            w = [w[f] - 0.1 * m[f] / (1 - 0.9**t) / (math.sqrt(v2[f] / (1 - 0.999**t)) + 1e-8) for f in range(17)]
        chance |= {k: sigmoid(sum(a * b for a, b in zip(w, x[k]))) for k in own}
    want = {(i, c[0], c[1], pii.KINDS[c[2]]): chance[c[2:]] for i, c in found if chance[c[2:]] >= p.accept}
    got = {(r["doc_id"], r["start"], r["end"], r["kind"]): r["probability"] for r in queries.op5_pii(spark, SF).collect()}
    assert set(got) == set(want) and len(got) > 5 and all(abs(got[k] - want[k]) < 1e-4 for k in want)


def test_op5_takes_linear_time():
    for unit in ("-", "a-", "a", "1.", "1 ", "a.", "+1", "/1", "_", "=-", "a@b."):
        began = time.process_time()
        for _ in pii.candidates(unit * (10**6 // len(unit)), pii.Params()):
            pass
        assert time.process_time() - began < 15, unit


# 7


def test_op7_refitted(spark):
    """The same model by dense matrices over words as strings."""
    p = toxicity.Params()
    docs, labels = dict(rows_of(spark, "documents", "doc_id", "text")), {}
    for i, t in rows_of(spark, "labels", "doc_id", "toxic"):
        labels[i] = max(t, labels.get(i, 0))

    def features(text):
        n = Counter()
        for w in plain_words(text):
            n.update([(0, w)] + [(k, w[:k]) for k in p.prefixes if len(w) > k])
        return n

    rows = sorted(i for i in docs if i in labels)
    per = {i: features(docs[i]) for i in docs}
    bad, good = sum(labels[i] for i in rows), sum(1 - labels[i] for i in rows)
    nb, ng = Counter(f for i in rows if labels[i] for f in per[i]), Counter(f for i in rows if not labels[i] for f in per[i])
    score, strong = {}, set()
    for f, b in nb.items():
        odds, base = b / bad / ((ng[f] + 0.5) / (good + 1)), (b + ng[f]) / (bad + good)
        if b >= p.least_rows and odds > 2:
            score[f] = b * math.log(b / bad / base) + (ng[f] * math.log(ng[f] / good / base) if ng[f] else 0)
            strong |= {f} if odds >= p.least_odds else set()
    assert 10 < len(score) <= p.most_features
    names = sorted(score)
    marked = {i: sum(bool(({(0, w)} | {(k, w[:k]) for k in p.prefixes if len(w) > k}) & strong) for w in plain_words(docs[i])) for i in rows}
    bounds = np.quantile([marked[i] for i in rows if labels[i]], np.arange(1, p.grades) / p.grades, method="higher")
    grade = np.array([1 + sum(marked[i] > b for b in bounds) if labels[i] else 0 for i in rows])
    dense = lambda ids: np.array([[1 + math.log(per[i][f]) if per[i][f] else 0.0 for f in names] for i in ids])
    x, w = dense(rows), np.zeros(len(names))
    share = np.clip([(grade >= j).mean() for j in range(1, p.grades + 1)], 1e-4, 1 - 1e-4)
    cuts = np.maximum.accumulate(np.log((1 - share) / share)) + np.arange(p.grades) * 1e-3
    m = v = np.zeros(len(names) + p.grades)
    up_to = lambda z: np.concatenate([np.ones((len(z), 1)), 1 / (1 + np.exp(np.clip(cuts - z[:, None], -60, 60))), np.zeros((len(z), 1))], axis=1)
    for t in range(1, p.steps + 1):
        s = up_to(x @ w)
        a, b = s[np.arange(len(s)), grade], s[np.arange(len(s)), grade + 1]
        prob = np.maximum(a - b, 1e-12)
        g = np.concatenate([-((1 - a - b) @ x), [sum((a * (1 - a) / prob)[grade == j]) - sum((b * (1 - b) / prob)[grade == j - 1]) for j in range(1, p.grades + 1)]]) / len(s)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * min(1.0, 2 * (1 - t / (p.steps + 1))) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        step = move * m / (1 - 0.9**t)
        w = w - step[: len(w)]
        w = np.sign(w) * np.maximum(np.abs(w) - np.minimum(move[: len(w)], 50.0) * p.l1, 0)
        cuts = np.maximum.accumulate(cuts - step[len(w) :] + np.arange(p.grades) * 1e-6)
    ids = sorted(docs)
    want = dict(zip(ids, up_to(dense(ids) @ w)[:, 1:-1]))
    got = {r["doc_id"]: r for r in queries.op7_toxicity(spark, SF).collect()}
    assert set(got) == set(want)
    assert all(abs(got[i]["expected_severity"] - want[i].sum()) < 1e-3 and got[i]["toxic"] == (want[i][0] >= p.reject) for i in ids)


def test_op7_takes_grades(spark):
    rows = [(k, "plain words here") for k in range(40)] + [(100 + k, "words " + ["", "bad", "worse thing", "worst thing ever"][k % 3 + 1]) for k in range(60)]
    labels = spark.createDataFrame([(i, i % 100 % 3 + 1 if i >= 100 else 0) for i, _ in rows], "doc_id long, toxic int")
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["severity"] for r in toxicity.score(d, toxicity.fit(d, labels)).collect()}
    assert all(got[i] == (i % 100 % 3 + 1 if i >= 100 else 0) for i, _ in rows)


# 9


def test_op9_with_a_table_of_templates(spark):
    own = [("House-1", "you may do with this text whatever you like as long as you say who wrote it"), ("House-2", None), ("House-3", "")]
    table = spark.createDataFrame(own, "license string, text string")
    docs = spark.createDataFrame([(1, "x y. You may do with this text whatever you like, as long as you say who wrote it!"), (2, "nothing"), (None, None)], "doc_id long, text string")
    want = [(1, "House-1", 2, 19, 17, 1.0)]
    assert [tuple(r) for r in licenses.spans(docs, templates=table).collect()] == want
    assert [tuple(r) for r in licenses.spans(docs, templates=(own[0],)).collect()] == want
    assert [tuple(r) for r in licenses.spans(docs, licenses.Params(broadcast_grams=3), table).collect()] == want


# the pipeline


def plain_pipeline(spark, docs, labels, items):
    """{doc_id, text} after four stages: each decides by its operator's query over what is left, and rows are dropped here."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = lambda rows: spark.createDataFrame(rows, schema)
    model = toxicity.fit(df(docs), labels)
    bad = Counter((r["doc_id"], r["expected_severity"]) for r in toxicity.score(df(docs), model).collect() if r["toxic"])
    score = {t: toxicity.score(df([(0, t, "", "", 0)]), model).first()["toxic"] for t in {r[1] for r in docs}} if bad else {}
    docs = [r for r in docs if not score.get(r[1], False)]
    gone = {r["doc_id"] for r in minhash.classes(df(docs)).collect() if r["doc_id"] != r["class_id"]}
    docs = [r for r in docs if r[0] not in gone]

    def passage(text):
        ws = plain_words(text)
        for i in items:
            own = plain_words(i)
            n = min(13, len(own))
            if len(own) >= 8 and {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} & {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)}:
                return True
        return False

    docs = [r for r in docs if not passage(r[1])]
    p, model, out = pii.Params(), pii.fit(df(docs)), []
    for r in docs:
        text, at = "", 0
        for s, e, kind, votes, shape in pii.candidates(r[1] or "", p):
            if model.probability(kind, votes, shape) >= p.accept:
                text, at = text + r[1][at:s] + f"[{pii.KINDS[kind].upper()}]", e
        out.append((r[0], None if r[1] is None else text + r[1][at:]))
    enc = encoder()
    return sorted(((i, t if t is None else tuple(enc.encode_ordinary(t))) for i, t in out), key=repr)


def test_pipeline_on_ugly_rows(spark, tmp_path):
    from pyspark.sql import functions as F

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    items = [t for _, t in rows_of(spark, "benchmark", "item_id", "text")]
    long = " ".join(f"word{k}" for k in range(20_000))
    rows += [(1000, None, None, None, None), (1001, "", "", "", 0), (None, "no id", "en", "s", 5), (None, None, None, None, None), (1002, long, "en", "s", 1), (1003, long, "en", "s", 1), (1003, long, "en", "s", 1), (1004, "mail bob@mail.example.com or 192.0.2.77 \x00 ﷽ 👍", "en", "s", 1), (1005, items[0], "en", "s", 1), (1006, "x" * 50_000, "en", "s", 1)]
    spark.createDataFrame(rows, schema).withColumns({"node": F.lit(1), "_gone": F.lit("x"), "size": F.lit(2)}).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "tokens", "n_tokens", "round_trip"]
    got = sorted(((r["doc_id"], r["tokens"] if r["tokens"] is None else tuple(r["tokens"])) for r in out.collect()), key=repr)
    assert got == plain_pipeline(spark, rows, spark.read.parquet(f"{SF}/labels.parquet"), items)
    left = {i for i, _ in got}
    assert {None, 1000, 1001, 1002, 1004, 1006} <= left and not {1003, 1005} & left and len(got) < len(rows)


def test_pipeline_on_empty_tables(spark, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
