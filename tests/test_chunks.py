import pytest
from hypothesis import given, settings, strategies as st

from tarnwell.operators import cleaning
from tarnwell.operators.chunker import Chunker, chunk_frame, units
from tarnwell.sources.providers import FixedSegmenter


def test_sizes():
    assert Chunker().chunk(" \n ") == [] and Chunker(50).chunk("short") == ["short"]
    out = Chunker(50, 10).chunk("x" * 200)
    assert all(len(c) <= 50 for c in out) and len("".join(c[10 if k else 0 :] for k, c in enumerate(out))) >= 200
    for bad in (0, -1, float("nan")):
        with pytest.raises(ValueError):
            Chunker(bad)
        with pytest.raises(ValueError):
            Chunker(token_limit=bad)


def test_marks_and_surrogates_stay_whole():
    out = Chunker(5, 0).chunk("กิ" * 6)
    assert "".join(out) == "กิ" * 6 and not any(c.startswith("ิ") for c in out)
    for c in Chunker(20, 5).chunk("😀" * 10 + "\n\nok"):
        assert "�" not in c and c.encode()
    assert len(units("😀")) == 2


def test_paragraphs_and_overlap():
    # the paragraph's separator counts as one character although it takes two
    assert Chunker(9, 0).chunk("aaaa\n\nbbbb") == ["aaaa\n\nbbbb"]
    assert Chunker(8, 0).chunk("aaaa\n\nbbbb") == ["aaaa", "bbbb"]
    assert Chunker(20, 8).chunk("one two three four\n\nfive six seven") == ["one two three four", "four five six seven"]
    assert Chunker(24, 0).chunk("One sentence here. Another one there! And more?") == ["One sentence here.", "Another one there!", "And more?"]


def test_labels():
    c = Chunker(token_limit=5, overlap=0, prefix=lambda m: m.get("title"))
    assert c.chunk("hello world", {"title": "T"})[0].startswith("T ")
    assert c.chunk("T x", {"title": "T"}) == ["T x"]


def test_segmented():
    s = FixedSegmenter(("th",), 3)
    c = Chunker(token_limit=8, overlap=3, segment=s.segment, segments=s.segments_language)
    out = c.chunk_segmented("abcdefghijklmnopqrstuvwxyz", {"language": "th"})
    assert out[0] == "abcdefghijkl" and out[1].startswith("jkl") and all(len(x) <= 12 for x in out)
    assert c.chunk_segmented("abc def", {"language": "en"}) == c.chunk("abc def", {"language": "en"})


@given(st.text(st.sampled_from("ab .!?\n้ก😀"), max_size=300), st.integers(4, 40), st.integers(0, 10))
@settings(max_examples=200, deadline=None)
def test_nothing_is_lost(text, size, overlap):
    out = Chunker(size, overlap).chunk(text)
    assert all(c.strip() == c or c for c in out)
    for word in set("".join(out)) ^ set(text):
        assert word.isspace()


def test_frame(spark):
    docs = spark.createDataFrame([(1, "a. b.", "en"), (2, None, "en"), (3, "", None)], "id long, text string, language string")
    assert [tuple(r) for r in chunk_frame(docs, Chunker(3, 0)).collect()] == [(1, 0, "a."), (1, 1, "b.")]


def test_recurring_lines(spark):
    pages = spark.createDataFrame([("d", 1, "Head\none สวัสดี\n\nfoot"), ("d", 2, " Head\nสองสองสอง"), ("d", 3, "Head \nfoot\nสาม"), ("e", 1, "Head\nHead")], "doc string, page int, text string")
    assert sorted((r["doc"], r["line"], r["pages"]) for r in cleaning.recurring(pages).collect()) == [("d", "Head", 3), ("d", "foot", 2)]
    kept = {(r["doc"], r["page"]): r["text"] for r in cleaning.without_recurring(pages).collect()}
    assert kept == {("d", 1): "one สวัสดี\n", ("d", 2): "สองสองสอง", ("d", 3): "สาม", ("e", 1): "Head\nHead"}
    clean = {r["doc"]: r["text"] for r in cleaning.clean_documents(pages, "thai").collect()}
    assert clean == {"d": "one สวัสดี\nสองสองสอง\nสาม", "e": ""}


def test_frame_is_cut_in_slices_of_arrow_batches(spark):
    """Slices of a bounded size instead of a batch of whole texts as objects; chunks as one by one."""
    from tarnwell.operators.chunker import Chunker, chunk_frame

    texts = ["One sentence here. " * 9000, None, "", "ß. Ü? " * 60000, "short"]
    docs = spark.createDataFrame([(k, t, "en" if k % 2 else None) for k, t in enumerate(texts)], "id int, text string, language string").coalesce(1)
    made = chunk_frame(docs, Chunker(token_limit=256))
    assert "MapInArrow" in made._jdf.queryExecution().executedPlan().toString()
    want = [(k, n, c) for k, t in enumerate(texts) if t for n, c in enumerate(Chunker(token_limit=256).chunk(t, {"language": "en"} if k % 2 else {}))]
    assert sorted(map(tuple, made.collect())) == want
