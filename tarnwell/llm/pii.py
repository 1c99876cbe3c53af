"""Personal data and secrets by weak supervision.

A broad pattern proposes candidate spans of each kind. Five labelers vote on each (+1, -1, or 0 to abstain): two patterns, a
gazetteer and two that look at the context. Expectation-maximisation over the counts of all vote patterns in the corpus
estimates how reliable each labeler is for each kind and how likely each candidate is true. These probabilities are the
targets of a logistic regression over votes and shape, the span classifier that decides. The counts of vote patterns are
sufficient for both, so all candidates of all documents take part and no more than the patterns reach the driver.

Documents are read twice, once to count and once to decide; nothing but the counts is shuffled.

Every pattern that proposes takes time proportional to the text: runs are tried at their start only, everything else is of bounded length.

Defined results: null and empty texts have no spans; spans of a document don't overlap (the leftmost wins); rows that share a
doc_id, or have none, are each looked at; without candidates nothing is found and nothing changed.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .words import slices, tidied

KINDS = ("email", "iban", "ip", "ssn", "account", "phone", "secret")
LABELERS = 5
SHAPES = 6
_CANDIDATE = re.compile(
    r"(?P<email>[\w.+%-]{1,64}@[\w-]+(?:\.[\w-]+)*)"
    r"|(?P<iban>\b[a-z]{2}\d{2}[a-z0-9]{4}\d{7}[a-z0-9]{0,16}\b)"
    r"|(?P<ip>(?<![\w.])\d{1,4}(?:\.\d{1,4}){3,}(?!\w))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<account>(?<![\w.+])\d(?:[ -]?\d){11,18}(?!\w))"
    r"|(?P<phone>(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)[ .-]?|\d{1,4}[ .-])(?:\d{2,4}[ .-]?){1,4}\d{2,4}(?!\w))"
    r"|(?P<secret>(?<![\w/+-])(?=[a-z_+/-]*\d)[\w+/-]{20,}={0,2})",
    re.IGNORECASE | re.ASCII,
)
_TLDS = frozenset("com org net edu gov mil int info biz io ai co dev app me tv de fr es it uk us eu at ch nl be pl pt se no fi dk cz ru cn jp kr in br mx ar ca au nz za ie gr tr example test invalid localhost".split())
_CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 351 352 353 354 358 359 370 371 372 380 385 386 420 421".split())
_IBAN_LENGTH = {"DE": 22, "FR": 27, "ES": 24, "GB": 22, "IT": 27, "NL": 18, "BE": 16, "AT": 20, "CH": 21, "PT": 25, "PL": 28, "SE": 24, "DK": 18, "NO": 15, "FI": 18, "IE": 22, "LU": 20}
_KEY = re.compile(r"(token|secret|passw\w*|pwd|api|key|auth\w*|bearer|credential\w*)\W{0,6}$", re.IGNORECASE)
_NEAR = {
    "email": re.compile(r"e-?mail|contact|write to|reply", re.IGNORECASE),
    "iban": re.compile(r"iban|konto|account|bank", re.IGNORECASE),
    "ip": re.compile(r"\bip\b|host|addr|server|client", re.IGNORECASE),
    "ssn": re.compile(r"ssn|social|security", re.IGNORECASE),
    "account": re.compile(r"card|visa|master|amex|account|pay", re.IGNORECASE),
    "phone": re.compile(r"tel|phone|call|fax|mobile|cell|dial", re.IGNORECASE),
    "secret": re.compile(r"[=:]\W{0,4}$"),
}
_NOT_NEAR = {"ip": re.compile(r"version|release|section|\bv\.?$", re.IGNORECASE), "account": re.compile(r"isbn|order|serial|sku", re.IGNORECASE), "phone": re.compile(r"isbn|order|serial|pages?", re.IGNORECASE)}
_EMAIL = re.compile(r"[a-z0-9_%+-]+(\.[a-z0-9_%+-]+)*@[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{2,}", re.IGNORECASE | re.ASCII)
_PHONE = re.compile(r"\+\d{1,3}[ .-]?(\(\d{1,4}\)[ .-]?)?[\d .-]{5,}|\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}")


@dataclass(frozen=True)
class Params:
    accept: float = 0.5
    context: int = 24  # characters before a span that context labelers see
    em_steps: int = 200
    fit_steps: int = 500
    prior_right: float = 4.0  # pseudo-counts of a labeler's right and wrong votes
    prior_wrong: float = 1.0
    l2: float = 1e-3


@dataclass
class Model:
    weights: np.ndarray  # kinds x features
    right: np.ndarray  # P(+1 | true), P(-1 | false) for each kind and labeler
    share: np.ndarray  # true candidates of each kind

    def probability(self, kind: int, votes: int, shape: int) -> float:
        return float(1 / (1 + math.exp(-max(-60.0, min(60.0, float(self.weights[kind] @ features(votes, shape)))))))


def _sign(x: bool) -> int:
    return 1 if x else -1


def _luhn(d: str) -> bool:
    s = [int(c) for c in reversed(d)]
    return sum(s[::2] + [x * 2 - 9 * (x > 4) for x in s[1::2]]) % 10 == 0


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s.lower()).values())


def _iban(s: str) -> bool:
    s = s.upper()
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _checks(kind: str, s: str, before: str) -> tuple[int, int, int, int]:
    """Votes of two patterns, of the gazetteer, and of the labeler that looks at what touches the span."""
    d = re.sub(r"\D", "", s)
    if kind == "email":
        return _sign(bool(_EMAIL.fullmatch(s))), _sign(".." not in s and not s.startswith(".")), _sign(s.rpartition(".")[2].lower() in _TLDS), -1 if before.endswith(("/", ":")) else 1
    if kind == "iban":
        return _sign(_iban(s)), _sign(len(s) == _IBAN_LENGTH.get(s[:2].upper(), -1)) if s[:2].upper() in _IBAN_LENGTH else 0, _sign(s[:2].upper() in _IBAN_LENGTH), 0
    if kind == "ip":
        parts = s.split(".")
        return _sign(len(parts) == 4), _sign(all(int(x) < 256 and (x == "0" or x[0] != "0") for x in parts)), -1 if int(parts[0]) > 255 or len(parts) != 4 else 1 if 0 < int(parts[0]) < 240 else 0, 0 if not before or before[-1].isspace() else 1 if before[-1] in "([\"'|=:" else 0
    if kind == "ssn":
        a, b, c = s.split("-")
        return _sign(a not in ("000", "666") and a[0] != "9"), _sign(b != "00" and c != "0000"), 0, 0
    if kind == "account":
        return _sign(len(d) in (15, 16) or not d == s), _sign(_luhn(d)), 1 if d[0] in "3456" else 0, _sign(len(set(d)) > 3)
    if kind == "phone":
        code = s[1:].lstrip("+").split(" ")[0] if s[0] == "+" else ""
        known = any(d.startswith(c) for c in _CALLING)
        return _sign(bool(_PHONE.fullmatch(s))), _sign(9 <= len(d) <= 15), (1 if known else -1) if s[0] == "+" else 0 if not code else 1, _sign(bool(re.search(r"[+()]|\d-\d", s)))
    mixed = sum(bool(re.search(x, s)) for x in ("[a-z]", "[A-Z]", r"\d"))
    return _sign(bool(re.fullmatch(r"[0-9a-fA-F]{32,}", s)) or mixed == 3 and s.count("/") + s.count("-") < 3), _sign(_entropy(s) >= 3.0), 1 if _KEY.search(before) else 0, 1 if before[-1:] in ("'", '"', "=") else 0


def candidates(text: str, p: Params) -> Iterator[tuple[int, int, int, int, int]]:
    """(start, end, kind, votes, shape): votes in base 3, one digit a labeler, 0 for -1."""
    for m in _CANDIDATE.finditer(text):
        kind, (start, end) = m.lastgroup, m.span()
        before = text[max(0, start - p.context) : start]
        near = 1 if _NEAR[kind].search(before) else -1 if kind in _NOT_NEAR and _NOT_NEAR[kind].search(before) else 0
        a, b, gazetteer, touch = _checks(kind, m.group(), before)
        votes = sum((v + 1) * 3**k for k, v in enumerate((a, b, gazetteer, near, touch)))
        digits = sum(c.isdigit() for c in m.group())
        yield start, end, KINDS.index(kind), votes, min(2, (end - start) // 16) * 2 + (2 * digits >= end - start)


def votes_of(code: int) -> list[int]:
    return [code // 3**k % 3 - 1 for k in range(LABELERS)]


def features(votes: int, shape: int) -> np.ndarray:
    v = votes_of(votes)
    return np.array([1.0] + [float(x > 0) for x in v] + [float(x < 0) for x in v] + [float(shape == k) for k in range(SHAPES)])


def reliabilities(votes: np.ndarray, n: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, float]:
    """(P(true) of each vote pattern, reliabilities as 2 x labelers, share of true ones) by EM over the patterns' counts."""
    right, share = np.full((2, LABELERS), 0.8), 0.5
    up, down = votes > 0, votes < 0
    for _ in range(p.em_steps):
        yes = math.log(share) + (up * np.log(right[0]) + down * np.log(1 - right[0])).sum(axis=1)
        no = math.log(1 - share) + (up * np.log(1 - right[1]) + down * np.log(right[1])).sum(axis=1)
        q = 1 / (1 + np.exp(np.clip(no - yes, -60, 60)))
        a, b = n * q, n * (1 - q)
        share = float((a.sum() + 1) / (n.sum() + 2))
        right = np.stack([(a @ up + p.prior_right) / (a @ (up | down) + p.prior_right + p.prior_wrong), (b @ down + p.prior_right) / (b @ (up | down) + p.prior_right + p.prior_wrong)])
    return q, right, share


def train(rows: list[tuple[int, int, int, int]], p: Params) -> Model:
    """The model from (kind, votes, shape, count) of all candidates."""
    size = 1 + 2 * LABELERS + SHAPES
    weights, right, share = np.zeros((len(KINDS), size)), np.full((len(KINDS), 2, LABELERS), 0.8), np.full(len(KINDS), 0.5)
    for kind in range(len(KINDS)):
        own = sorted(r[1:] for r in rows if r[0] == kind)
        if not own:
            continue
        n = np.array([r[2] for r in own], dtype=float)
        q, right[kind], share[kind] = reliabilities(np.array([votes_of(r[0]) for r in own]), n, p)
        x, at = np.array([features(r[0], r[1]) for r in own]), n / n.sum()
        w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
        for t in range(1, p.fit_steps + 1):
            g = x.T @ (at * (1 / (1 + np.exp(-np.clip(x @ w, -60, 60))) - q)) + p.l2 * w * (np.arange(size) > 0)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - 0.1 * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        weights[kind] = w
    return Model(weights, right, share)


def _found(texts: pa.Array, p: Params) -> Iterator[tuple[int, str, list[tuple[int, int, int, int, int]]]]:
    """(row, text, candidates) of the rows that have any. Each kind has a digit or an @, so texts without are passed over."""
    for at, part in slices(texts):
        may = pc.fill_null(pc.match_substring_regex(part, "[0-9@]"), False)
        rows = np.flatnonzero(may.to_numpy(zero_copy_only=False))
        for r, text in zip(rows.tolist(), part.take(pa.array(rows)).to_pylist()):
            if found := list(candidates(text, p)):
                yield at + r, text, found


def fit(docs: DataFrame, p: Params = Params()) -> Model:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            for _, _, found in _found(b.column(0), p):
                n.update(f[2:] for f in found)
        if n:
            yield pa.RecordBatch.from_pydict({"kind": [k[0] for k in n], "votes": [k[1] for k in n], "shape": [k[2] for k in n], "n": list(n.values())}, schema=pa.schema([("kind", pa.int32()), ("votes", pa.int32()), ("shape", pa.int32()), ("n", pa.int64())]))

    counted = docs.select(F.col("text").cast("string")).mapInArrow(tidied(run), "kind int, votes int, shape int, n long").groupBy("kind", "votes", "shape").agg(F.sum("n").alias("n"))
    return train([tuple(r) for r in counted.collect()], p)  # at most kinds x 3^labelers x shapes rows


def _decide(model: Model, p: Params) -> Callable[[tuple[int, int, int]], float]:
    seen: dict[tuple[int, int, int], float] = {}

    def decide(f: tuple[int, int, int]) -> float:
        if f not in seen:
            seen[f] = model.probability(*f)
        return seen[f]

    return decide


def spans(docs: DataFrame, model: Model, p: Params = Params()) -> DataFrame:
    """(doc_id, start, end, kind, probability) of every accepted span; start and end in code points."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = _decide(known.value, p)
        for b in batches:
            rows = [(r, s, e, KINDS[k], round(q, 6)) for r, _, found in _found(b.column(1), p) for s, e, k, v, x in found if (q := decide((k, v, x))) >= p.accept]
            if rows:
                r, s, e, k, q = zip(*rows)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r)), pa.array(s, pa.int32()), pa.array(e, pa.int32()), pa.array(k), pa.array(q)], names=["doc_id", "start", "end", "kind", "probability"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidied(run), "doc_id long, start int, end int, kind string, probability double")


def redact(docs: DataFrame, model: Model, p: Params = Params()) -> DataFrame:
    """All rows in all their columns, each accepted span replaced by its kind in brackets; n_chars, if there, is the new text's length."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    text_at, schema = docs.columns.index("text"), docs.schema
    length_at = docs.columns.index("n_chars") if "n_chars" in docs.columns and dict(docs.dtypes)["n_chars"] in ("int", "bigint") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = _decide(known.value, p)
        for b in batches:
            new: dict[int, str] = {}
            for r, text, found in _found(b.column(text_at), p):
                parts, at = [], 0
                for s, e, k, v, x in found:
                    if decide((k, v, x)) >= p.accept:
                        parts += [text[at:s], f"[{KINDS[k].upper()}]"]
                        at = e
                if at:
                    new[r] = "".join(parts) + text[at:]
            if new:
                columns = b.columns
                mask = np.zeros(b.num_rows, dtype=bool)
                mask[list(new)] = True
                values = [new[r] for r in sorted(new)]
                columns[text_at] = pc.replace_with_mask(columns[text_at], pa.array(mask), pa.array(values, columns[text_at].type))
                if length_at is not None:
                    columns[length_at] = pc.replace_with_mask(columns[length_at], pa.array(mask), pa.array([len(v) for v in values], columns[length_at].type))
                b = pa.RecordBatch.from_arrays(columns, schema=b.schema)
            yield b

    return docs.mapInArrow(tidied(run), schema)
