"""Stemmers by configuration. ``simple`` leaves words as they are; ``english`` is the published Porter2 algorithm, ``german``, ``french`` and ``spanish`` are in ``stem_other``; for others
(Italian, Portuguese, Romanian, Arabic) none is built in: they are as ``simple`` until one is registered."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from . import stem_other

ENGLISH_STOP = frozenset(
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own s same she should so some such t than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you your yours yourself yourselves".split()
)
_V = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_KEPT = frozenset("sky news howe atlas cosmos bias andes".split())
_KEPT_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = sorted({"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}.items(), key=lambda x: -len(x[0]))
_STEP3 = sorted({"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}.items(), key=lambda x: -len(x[0]))
_STEP4 = sorted("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split(), key=len, reverse=True)


def _region(w: str, at: int) -> int:
    m = re.compile("[aeiouy][^aeiouy]").search(w, at)
    return m.end() if m else len(w)


def _short_end(w: str) -> bool:
    return bool(re.search("[^aeiouy][aeiouy][^aeiouywxY]$", w) or re.fullmatch("[aeiouy][^aeiouy]", w))


@lru_cache(maxsize=200_000)
def english(word: str) -> str:
    w = word.replace("’", "'").lstrip("'")
    if len(w) <= 2:
        return w
    if w in _WHOLE:
        return _WHOLE[w]
    if w in _KEPT:
        return w
    w = re.sub("(^y)|(?<=[aeiouy])y", "Y", w)
    start = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), 0)
    r1 = start or _region(w, 0)
    r2 = _region(w, r1)
    w = re.sub("('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in _KEPT_1A:
        return w
    for end in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(end):
            if end.startswith("eed"):
                if len(w) - len(end) >= r1:
                    w = w[: len(w) - len(end)] + "ee"
            elif re.search("[aeiouy]", w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(_DOUBLE):
                    w = w[:-1]
                elif r1 >= len(w) and _short_end(w):
                    w += "e"
            break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for end, new in _STEP2:
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: len(w) - len(end)] + new
            break
    else:
        if w.endswith("ogi"):
            w = w[:-1] if len(w) - 3 >= r1 and w[-4:-3] == "l" else w
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    for end, new in _STEP3:
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: len(w) - len(end)] + new
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for end in _STEP4:
        if w.endswith(end):
            if len(w) - len(end) >= r2:
                w = w[: len(w) - len(end)]
            break
    else:
        if w.endswith(("sion", "tion")) and len(w) - 3 >= r2:
            w = w[:-3]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


#: configuration -> (stemmer, stop words)
STEMMERS: dict[str, tuple[Callable[[str], str], frozenset[str]]] = {
    "simple": (lambda w: w, frozenset()),
    "english": (english, ENGLISH_STOP),
    "german": (stem_other.german, stem_other.GERMAN_STOP),
    "french": (stem_other.french, stem_other.FRENCH_STOP),
    "spanish": (stem_other.spanish, stem_other.SPANISH_STOP),
}


def register(config: str, stemmer: Callable[[str], str], stop_words: frozenset[str] = frozenset()) -> None:
    STEMMERS[config] = (stemmer, stop_words)


def of(config: str) -> tuple[Callable[[str], str], frozenset[str]]:
    """The configuration's stemmer; that of ``simple`` where none is registered."""
    return STEMMERS.get(config, STEMMERS["simple"])
