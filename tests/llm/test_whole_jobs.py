"""Small cases in which an operator once did less than the whole job."""

import time

import pyarrow as pa

from tarnwell.llm import decontam, html_text


# HTML


def test_short_lines_between_surge_and_dive_are_text():
    start, end = "A first paragraph of seventy characters or so, which begins the text.", "And a last one of some fifty characters, its end."
    middle = "One long paragraph stands between the two and has more than eighty characters of its own to show."
    assert html_text.text_of(f"<nav><li>home</li></nav><article><p>{start}</p><p>{middle}</p><p>{end}</p></article>") == (f"{start}\n{middle}\n{end}", 1)
    short = "<p>Fifty characters stand in each of these lines here.</p>" * 4
    text, n = html_text.text_of(short)
    assert n == 1 and text.count("\n") == 3


def test_stretches_lose_only_what_the_window_let_in():
    p = html_text.Params()
    assert html_text.stretches([4, 4, 170, 5, 170, 4], p) == [(2, 5)]
    assert html_text.stretches([4, 60, 170, 60, 50, 0, 0, 0], p) == [(1, 5)]
    assert html_text.stretches([30, 60, 50, 0, 0, 0, 200], p) == [(0, 3), (6, 7)]


def test_wrapped_source_is_one_line():
    wrapped = "\n".join(f"Line {k} of an article that its editor wrapped at some seventy columns." for k in range(6))
    page = f"<body><ul><li>a\n</ul>\n\n<p>\n{wrapped}\n</p>\n\n\n\n<footer>me</footer>"
    assert html_text.text_of(page) == (wrapped.replace("\n", " "), 1)
    assert html_text.text_of(f"<pre>{wrapped}</pre>") == (wrapped, 1)


def test_long_quoted_values_are_not_text():
    said = "This sentence of the article is long enough to count as text of the page, so it stays here to the end of it."
    value = "<p>" + "not a text of the page but a value of an attribute, however long it may be > " * 1000 + "</p>"
    for quote in "\"'":
        assert html_text.text_of(f"<div data-x={quote}{value}{quote}><p>{said}</p><p>{said}</p></div>") == (f"{said}\n{said}", 1)


def test_quotes_that_stay_open_hide_nothing_and_take_linear_time():
    said = "This sentence of the article is long enough to count as text of the page, so it stays here to the end of it."
    text, n = html_text.text_of(f'<a href="x><p>{said}</p><p>{said}</p>')
    assert n == 1 and text.endswith(f"{said}\n{said}")
    began = time.process_time()
    for tag in ("<a b=\">\" ", "<a b='\">", "<a b=\"'>\" c='>"):
        html_text.text_of(tag * 50_000 + "<a b='")
        html_text.text_of(tag * 50_000 + "<a b=\"")
    assert time.process_time() - began < 20


# decontamination


def test_last_item_may_be_the_shortest():
    first, last = (" ".join(f"{c}{k}" for k in range(n)) for c, n in (("a", 20), ("b", 8)))
    p = decontam.Params()
    for texts in ([f"x {first} y {last} z"], [f"{last} and {first}"], [first, last]):
        found = [h for part in decontam.hits(pa.array(texts), decontam.make_tests([(1, first), (2, last)], p), p) for h in zip(*(x.tolist() for x in part))]
        want = {(texts.index(t), k, n, t.split().index(item.split()[0]), 0) for k, item, n in ((0, first, 20), (1, last, 8)) for t in texts if item in t}
        assert set(found) == want and len(found) == 2
