"""Text-search documents and queries: lexemes with positions, a query tree of and, or and phrase, and the cover-density rank.

The rank follows Clarke, Cormack and Tudhope (Relevance Ranking for One to Three Term Queries): each minimal stretch of lexemes that
satisfies the query adds its weight, 0.1 a lexeme harmonically averaged, divided by 1 and the foreign words inside it.
"""

from __future__ import annotations

from dataclasses import dataclass

import regex

from . import stem

_WORD = regex.compile(r"[\p{L}\p{N}]+")
WEIGHT = 0.1


@dataclass(frozen=True)
class Node:
    op: str  # "term", "and", "or" or "phrase"
    parts: tuple = ()  # nodes; of a term, the lexeme


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def vector(text: str, config: str = "simple") -> dict[str, list[int]]:
    """Positions, from 1, of each lexeme; stop words are left out but counted."""
    stemmer, stop = stem.of(config)
    out: dict[str, list[int]] = {}
    for at, w in enumerate(words(text), 1):
        if w not in stop:
            out.setdefault(stemmer(w), []).append(at)
    return out


def _join(op: str, nodes: list[Node | None]) -> Node | None:
    nodes = [n for n in nodes if n is not None]
    return None if not nodes else nodes[0] if len(nodes) == 1 else Node(op, tuple(nodes))


def _term(text: str, config: str, op: str) -> Node | None:
    stemmer, stop = stem.of(config)
    return _join(op, [Node("term", (stemmer(w),)) for w in words(text) if w not in stop])


def plain(text: str, config: str = "simple") -> Node | None:
    """All words of the text must occur; None if there are none."""
    return _term(text, config, "and")


def parse(query: str, config: str = "simple") -> Node | None:
    """A query string as ``synonyms.fts_query`` builds it."""
    groups = []
    for group in query.split(" & "):
        options = group.strip().removeprefix("(").removesuffix(")").split(" | ")
        groups.append(_join("or", [_join("phrase", [n for w in option.split(" <-> ") if (n := _term(w, config, "phrase"))]) for option in options]))
    return _join("and", groups)


def query_tree(built: str, raw: str, config: str = "simple") -> Node | None:
    """The built query; if it has no operator, all words of the raw query."""
    return parse(built, config) if any(op in built for op in ("|", "&", "<->")) else plain(raw, config)


def terms(node: Node) -> set[str]:
    return {node.parts[0]} if node.op == "term" else set().union(*map(terms, node.parts))


def _ends(node: Node, at: dict[str, set[int]]) -> set[int]:
    """Positions at which a match of a term, an or of these, or a phrase ends."""
    if node.op == "term":
        return at.get(node.parts[0], set())
    if node.op == "phrase":
        ends = _ends(node.parts[0], at)
        for n in node.parts[1:]:
            ends = {e + 1 for e in ends} & _ends(n, at)
        return ends
    return set().union(*(_ends(n, at) for n in node.parts))


def matches(node: Node, at: dict[str, set[int]]) -> bool:
    if node.op == "and":
        return all(matches(n, at) for n in node.parts)
    if node.op == "or":
        return any(matches(n, at) for n in node.parts)
    return bool(_ends(node, at))


def rank(node: Node, doc: dict[str, list[int]]) -> float:
    """The cover-density rank; 0 where the document doesn't match."""
    wanted = terms(node)
    entries = sorted((p, t) for t in wanted for p in doc.get(t, ()))
    if node.op == "term":
        return len(entries) * WEIGHT
    total, first = 0.0, 0
    while first < len(entries):
        at: dict[str, set[int]] = {}
        last = next((k for k in range(first, len(entries)) if at.setdefault(entries[k][1], set()).add(entries[k][0]) or matches(node, at)), None)
        if last is None:
            break
        at = {}
        begin = next(k for k in range(last, first - 1, -1) if at.setdefault(entries[k][1], set()).add(entries[k][0]) or matches(node, at))
        n = last - begin
        noise = entries[last][0] - entries[begin][0] - n
        total += WEIGHT / (1 + (noise if noise >= 0 else n // 2))
        first = begin + 1
    return total


