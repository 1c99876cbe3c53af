import math
import uuid

import pytest
from pyspark.sql import functions as F

from tarnwell.functions import languages as L, stem, synonyms as S, text as X, tsquery as Q, wordsim as W


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, want",
    [("", "en"), ("12 !", "en"), ("plain", "en"), ("返品できますか", "ja"), ("小米手机", "zh"), ("小米 phone phone", "en"), ("안녕 hello hello", "ko"), ("ใครขาย", "th"), ("سياسة", "ar"), ("नमस्ते", "hi"), ("नम hello world", "hinglish")],
)
def test_detect_language(spark, text, want):
    assert one(spark, X.detect_language(F.col("t")), t=text) == want


def test_folds(spark):
    assert one(spark, X.normalize_for(F.col("t"), F.lit("ar-SA")), t="سياسة الإرجاع") == "سياسه الارجاع"
    assert one(spark, X.fold_arabic(F.col("t"), fold_yeh=False, fold_teh=False), t="مـدرسة ٣۴ على") == "مدرسة 34 على"
    assert one(spark, X.normalize_for(F.col("t"), F.lit("th")), t="๑๒๓") == "123"
    assert one(spark, X.normalize_for(F.col("t"), F.lit(None).cast("string")), t="é") == "é"


def test_queries_are_cleaned(spark):
    assert one(spark, X.clean_query(F.col("t")), t="  What is　THIS?! (ok) น่ะๆ﻿") == "what is this (ok น่ะ"
    assert one(spark, X.remove_stop_words(F.col("t"), F.array(F.lit("is"))), t="This IS it") == "This it"
    assert one(spark, X.or_before(X.remove_stop_words(F.col("t"), F.array(F.lit("is"))), F.col("t")), t="is IS") == "is IS"


def test_grams(spark):
    assert sorted(one(spark, X.trigrams(F.col("t")), t="two Two words")) == sorted(set(W.grams("two words")))
    assert one(spark, X.query_bigrams(F.col("t")), t="防水機 防水") == ["防水", "水機"]
    assert one(spark, X.bigrams(F.col("t")), t="") == ["  "]
    assert one(spark, X.graphemes(F.col("t")), t="ก็า😀é") == ["ก็", "า", "😀", "é"]


def test_word_similarity():
    assert W.word_similarity(set(W.grams("word")), W.grams("two words")) == 0.8
    assert W.word_similarity(set(W.grams("word")), []) == 0.0 and W.similarity("word", "word") == 1.0
    import random

    rng = random.Random(1)
    for _ in range(200):
        q, t = ({"".join(rng.choice("ab") for _ in range(3)) for _ in range(4)}, ["".join(rng.choice("ab") for _ in range(3)) for _ in range(12)])
        brute = max((len(q & set(t[i:j])) / len(q | set(t[i:j])) for i in range(12) for j in range(i + 1, 13)), default=0)
        assert math.isclose(W.word_similarity(q, t), brute)


def test_metadata_and_ids(spark):
    for bad in ("", "[1]", "null", "3", "{"):
        assert one(spark, X.parse_metadata(F.col("t")), t=bad) == {}
    assert one(spark, X.parse_metadata(F.col("t")), t='{"a": "b"}') == {"a": "b"}
    for name in ("faq:x:1", "é"):
        assert one(spark, X.uuid5(F.col("t")), t=name) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))
    assert one(spark, X.judge_scores(F.col("t"), 4), t="2, 1 and 7") == [2, 1, 0, 0]
    assert one(spark, X.sanitize_term(F.col("t")), t=" (a|b)&'c' ") == "abc"
    assert one(spark, X.vector(F.col("t")), t="[1, 0.5]") == [1.0, 0.5]


def test_scripts(spark):
    assert one(spark, X.script_ratio(F.col("t"), "arabic"), t="ab سي ٣") == 0.5
    assert one(spark, X.dominant(F.col("t"), "thai"), t="ab กข") and not one(spark, X.dominant(F.col("t"), "thai"), t="๑๒")
    assert [one(spark, X.loanword_heavy(F.col("t")), t=t) for t in ("5G", "ซิมการ์ด", "ราคา 5", "a")] == [True, True, False, False]


LOOKUP = {"en": {"phones": ["smartphones"]}}


@pytest.mark.parametrize(
    "query, lookup, want",
    [
        ("best phones market", {"phones": ["smartphones"]}, "best phones smartphones market"),
        ("best phones market", {"phones": ["smartphones", "market"]}, "best phones smartphones market"),
        ("I want cash on delivery", {"cash on delivery": ["cod"]}, "I want cash on delivery cod"),
        ("cash on delivery please", {"cash": ["money"], "cash on delivery": ["cod"]}, "cash on delivery cod please"),
        ("buy tv tv", {"tv": ["television"]}, "buy tv television tv"),
        ("best phones", {"phones": ["new phones"]}, "best phones new"),
        ("a  b", {}, "a  b"),
    ],
)
def test_expansion(query, lookup, want):
    assert S.expand(query, {"en": lookup} if lookup else {}) == want


@pytest.mark.parametrize(
    "query, lookup, want",
    [
        ("best phones market", {"phones": ["smartphones"]}, "best & (phones | smartphones) & market"),
        ("best & phones | market", {}, "best & phones & market"),
        ("test", {"test": ["foo|bar", "baz&qux"]}, "(test | foobar | bazqux)"),
        ("smartwatch", {"smartwatch": ["apple watch", "galaxy watch"]}, "(smartwatch | apple <-> watch | galaxy <-> watch)"),
        ("want cash on delivery", {"cash on delivery": ["cod"]}, "want & (cash <-> on <-> delivery | cod)"),
        ("& |", {"& |": ["cod"]}, "cod"),
        ("| & !", {}, ""),
    ],
)
def test_text_queries(query, lookup, want):
    assert S.fts_query(query, {"en": lookup}) == want


def test_languages_are_merged():
    assert S.expand("best mobile", {"en": {"mobile": ["cellphone"]}, "hi": {"mobile": ["phone"]}}) == "best mobile cellphone phone"
    assert S.bm25_query("want (cash) on delivery", {"en": {"on": ["up!"]}}) == "want cash on up delivery"


ROWS = [("en", "Phone", '["Smartphone", "cell", 7, null]', "two_way"), ("en", "a", '["b","c","d","e","f","g"]', "one_way"), ("en", "x", "broken", "two_way"), ("en", "y", '{"no": 1}', "two_way"), ("en", "s", '["s"]', "one_way")]


def test_lookups_agree(spark):
    rows = [dict(zip(("language", "term", "synonyms", "direction"), r)) for r in sorted(ROWS)]
    got = S.load(rows)
    assert got["en"]["phone"] == ["smartphone", "cell"] and got["en"]["cell"] == ["phone"] and got["en"]["a"] == ["b", "c", "d", "e", "f"]
    frame = S.lookup_frame(spark.createDataFrame(ROWS, "language string, term string, synonyms string, direction string")).collect()
    assert {r["term"]: r["synonyms"] for r in frame} == {k: v for k, v in got["en"].items() if v}


def test_ranks():
    doc = Q.vector("the cash on delivery and cash money on the delivery")
    assert Q.rank(Q.parse("cash"), doc) == pytest.approx(0.2)
    assert Q.rank(Q.parse("cash & delivery"), doc) == pytest.approx(0.05 + 0.05 + 0.025)
    assert Q.rank(Q.parse("(cash <-> on <-> delivery | cod)"), doc) == pytest.approx(0.1)
    assert Q.rank(Q.parse("nothing & cash"), doc) == 0 and Q.parse("") is None and Q.plain("?") is None
    assert not Q.matches(Q.parse("(delivery <-> cash | cod)"), {k: set(v) for k, v in doc.items()})
    assert Q.query_tree("cash", "on Delivery").op == "and"


@pytest.mark.parametrize("word, want", [("consistency", "consist"), ("generously", "generous"), ("relational", "relat"), ("hopping", "hop"), ("hoping", "hope"), ("skies", "sky"), ("flies", "fli"), ("happily", "happili"), ("controlling", "control"), ("knightly", "knight"), ("dying", "die")])
def test_english_stems(word, want):
    assert stem.english(word) == want


def test_recommendations():
    assert [L.recommend(c).stemming for c in ("en-GB", "ar", "th", "zh", "de-DE")] == ["english", "arabic", "none", "none", "german"]
    assert L.recommend("ar-SA").needs_normalization and L.recommend("zh-TW").is_cjk and not L.recommend("en").is_cjk
    assert L.fts_config("en-GB") == "simple" and L.bm25_group("ar") == "simple" and L.bm25_index("es-MX") == "bm25_es" and L.bm25_index("th") == "bm25_simple"
    assert (L.char_limit("th", 512), L.char_limit("zh-TW", 512), L.char_limit("xx", 512), L.char_limit(None, 512)) == (768, 614, 512, 512)


def test_other_stemmers():
    """Pairs of the sample vocabularies that were published with the descriptions."""
    from tarnwell.functions import stem

    pairs = {
        "german": "aufeinanderfolge aufeinanderfolg aufeinander aufeinand kategorien kategori kategorischen kategor auffällig auffall aufenthalt aufenthalt auferlegten auferlegt häuser haus ärgernisse argernis kater kat katholischen kathol",
        "french": "continu continu continua continu continuait continu continuation continu continuel continuel continuelle continuel continuellement continuel contractés contract contradictoirement contradictoir contrainte contraint majestueusement majestu majestueux majestu majeur majeur mains main maintenir mainten maison maison",
        "spanish": "cheque chequ chequeo cheque chevere chever chica chic chicago chicag chicharrones chicharron chiapaneca chiapanec tórax torax torcer torc toreado tor toreo tore torneado torn informaciones inform rápidamente rapid",
    }
    for config, words in pairs.items():
        stemmer, stop = stem.of(config)
        words = words.split()
        assert {w: stemmer(w) for w in words[::2]} == dict(zip(words[::2], words[1::2])) and len(stop) > 100
        for odd in ("", "a", "y", "qu", "ss", "é", "nos", "ement", "ungung"):
            assert isinstance(stemmer(odd), str)


def test_capitals_are_letter_for_letter_as_in_sql(spark):
    import duckdb

    texts = ["".join(X._WIDENED), "Straße und Maß", "plain", "", "a\nß\n", "ŉ ﬁn ᾳ 𐐨ß", None]
    got = [r["u"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.capitals(F.col("t")).alias("u")).collect()]
    assert got == [duckdb.execute("SELECT upper(?)", [t]).fetchall()[0][0] for t in texts]


def test_only_what_may_compose_goes_to_python(spark):
    """Composition of every character alone and behind others; texts that can't change aren't sent."""
    import re
    import unicodedata

    may = re.compile(re.sub(r"\\x{(\w+)}", lambda m: chr(int(m[1], 16)), X._MAY_COMPOSE))
    calm = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not may.match(chr(c))]
    assert len(calm) > 0x300
    assert all(unicodedata.normalize("NFC", a + c) == a + c for a in "aeo<= é" for c in calm)
    texts = ["plain", "caf\u00e9 – “x”", "cafe\u0301", "\u0e01\u0e4d\u0e32", "\u1100\u1161", "", None]
    df = spark.createDataFrame([(t, lang) for t in texts for lang in ("en", "ar", "th", None)], "t string, l string")
    for r in df.select("t", "l", X.normalize_for(F.col("t"), F.col("l")).alias("x"), X.nfc(F.when(F.col("t").rlike(X._MAY_COMPOSE), F.col("t"))).alias("sent")).collect():
        assert r["x"] == (None if r["t"] is None else unicodedata.normalize("NFC", r["t"]))
        assert (r["sent"] is not None) == bool(r["t"] and may.search(r["t"]))


def test_latin_texts_are_not_counted_by_script(spark):
    """Every block's letters but Latin ones lead to the count."""
    df = spark.createDataFrame([(chr(int(x, 16)),) for k, v in X._BLOCKS.items() if k != "latin" for x in __import__("re").findall("{(.*?)}", v)], "t string")
    assert df.where(~F.col("t").rlike(X._OTHER_SCRIPTS)).count() == 0
