"""Page shapes with the text that is their article, and the window step against its definition."""

import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from gridloom.llm import html_text

A = "The council met on Tuesday and agreed to repair the old bridge before the winter comes."
B = "Work starts in May, and traffic will be led over the northern road for about ten weeks."
C = "Costs of four million are shared by the town and the county, as the mayor said."
LINKS = "".join(f'<li><a href="/{i}">Story number {i} with a rather long headline to fill a line</a></li>' for i in range(8))
PLINKS = "".join(f'<p><a href="/{i}">Story number {i} with a rather long headline to fill a line</a></p>' for i in range(8))
LONG = " ".join(f"Sentence {i} of a very long report goes on and on." for i in range(30000))

SHAPES = {
    "marked": (f"<nav><ul>{LINKS}</ul></nav><article><h1>Bridge</h1><p>{A}</p><p>Ok.</p></article><footer>© Town</footer>", f"Bridge {A} Ok."),
    "marked, tiny": ("<div class=ad>Buy a very long and cheap advert text now, it is cheap and long and long and long.</div><main><p>Of.</p></main>", "Of."),
    "marked, advert inside": (f'<article><p>{A}</p><div class="ad-box"><p>Buy now</p></div><p>{B}</p></article>', f"{A} {B}"),
    "marked, list of stories at the end": (f"<article><p>{A}</p><p>{B}</p><ul>{LINKS}</ul></article>", f"{A} {B}"),
    "marked, linked paragraph": (f'<article><p>{A}</p><p><a href="x">{B}</a></p><p>{C}</p></article>', f"{A} {B} {C}"),
    "marked, one linked entry": (f'<article><p>{A}</p><ul><li><a href="x">the plan</a></li></ul><p>{C}</p></article>', f"{A} the plan {C}"),
    "marked, comments as articles": (f'<article><p>{A}</p></article><article class="comment"><p>{B}</p></article>', A),
    "marked, header in and out": (f"<header><p>{B}</p></header><article><header><h1>Bridge</h1></header><p>{A}</p></article>", f"Bridge {A}"),
    "marked, inside a doubtful wrapper": (f'<div class="search-widget"><article><p>{A}</p><div class="share">Share it</div></article></div>', A),
    "marked but empty": (f"<main></main><div><p>{A}</p><p>{B}</p></div>", f"{A} {B}"),
    "two articles": (f"<article><p>{A}</p></article><div>Between them</div><article><p>{B}</p></article>", f"{A} {B}"),
    "plain": (f"<ul>{LINKS}</ul><h1>Bridge</h1><p>{A}</p><p>{B}</p><ul>{LINKS}</ul>", f"Bridge {A} {B}"),
    "plain, split by an advert": (f'<p>{A}</p><p>{B}</p><div class="advert"><p>Buy</p><p>this</p><p>now</p></div><p>The end.</p>', f"{A} {B} The end."),
    "plain, split by stories": (f"<p>{A}</p>{PLINKS}<p>{B}</p>", f"{A} {B}"),
    "plain, one linked line": (f'<p>{A}</p><p><a href="x">the plan</a></p><p>{B}</p>', f"{A} the plan {B}"),
    "plain, mostly linked paragraph": (f'<p>{A}</p><p>See <a href="x">{B}</a></p><p>{C}</p>', f"{A} See {B} {C}"),
    "all in a doubtful wrapper": (f'<div class="related-widget"><p>{A}</p><p>{B}</p><div class="comments"><p>{C}</p></div></div>', f"{A} {B}"),
    "all in a form": (f"<form><ul>{LINKS}</ul><p>{A}</p><p>{B}</p></form>", f"{A} {B}"),
    "comments longer than the article": (f'<p>{A}</p><div id="comments">' + f"<p>{C}</p>" * 40 + "</div>", A),
    "login form": (f'<form class="login"><p>Name, password, and some words on how to get a new one if you lost yours.</p></form><p>{A}</p>', A),
    "cookie notice": (f'<div id="cookie-notice"><p>We use cookies and ask you for your leave to use them.</p></div><p>{A}</p><p>{B}</p>', f"{A} {B}"),
    "hidden": (f'<p>{A}</p><div style="display: none"><p>{B}</p></div><p aria-hidden="true">x</p><p>{C}</p>', f"{A} {C}"),
    "roles": (f'<div role="navigation"><p>{B}</p></div><p>{A}</p><div role="contentinfo"><p>{B}</p></div>', A),
    "short only": ("<p>Hi</p>", "Hi"),
    "references, white space, breaks": (f"<p>  Caf&eacute;&nbsp;&amp;\n bar<br>open </p><p>{A}</p>", f"Café & bar open {A}"),
    "unclosed": (f"<p>{A}<p>{B}", f"{A} {B}"),
    "unclosed doubtful paragraph": (f'<p class="share">Share<p>{A}<p>{B}', f"{A} {B}"),
    "cut off in a tag": (f"<article><p>{A}</p><p>{B}</p><div cla", f"{A} {B}"),
    "scripts and comments": (f"<script>if (a < b) document.write('<p>no</p>')</script><!-- <p>no</p> --><style>p {{}}</style><p>{A}</p>", A),
    "very long": (f"<nav>{LINKS}</nav><article><p>{LONG}</p></article>", LONG),
    "nothing but links": (f"<ul>{LINKS}</ul>", ""),
    "empty": ("<html><body></body></html>", ""),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_shape(shape):
    page, want = SHAPES[shape]
    for whole in (page, f"<!DOCTYPE html><html><head><title>T</title></head><body>{page}</body></html>" if shape != "cut off in a tag" else page):
        assert html_text.main_text(whole) == want


def test_windows_against_their_definition():
    rng = np.random.default_rng(6)
    for _ in range(300):
        weights = rng.choice([0, 0, 0, 1, 30, 90], rng.integers(1, 30))
        sums = [sum(int(x) for x in weights[i : i + html_text.WINDOW]) for i in range(len(weights))]
        assert html_text.window_sums(weights).tolist() == sums
        want, i = [], 0
        while i < len(weights):
            if weights[i] > 0:
                j = i
                while j < len(weights) and sums[j] > 0:
                    j += 1
                want.append((i, j, max(sums[i:j])))
                i = j
            i += 1
        assert html_text.stretches(weights) == want


def real_pages():
    return pq.read_table("/root/testdata/sf0.1/pages.parquet", columns=["html"])["html"].to_pylist()


def test_the_windows_decide(monkeypatch):
    """One window over the whole page, which never dives and always has a surge, gives other texts: lists of links that
    lie in an unmarked page come with it, and they are in no text where windows are as they should be."""
    shapes = [SHAPES[n] for n in ("plain", "plain, split by stories", "marked, list of stories at the end")]
    assert [html_text.main_text(page) for page, _ in shapes] == [want for _, want in shapes]
    monkeypatch.setattr(html_text, "stretches", lambda weights: [(0, len(weights), 10**9)])
    for page, want in shapes:
        assert html_text.main_text(page) != want and "headline" in html_text.main_text(page)


def test_real_pages_without_their_marks():
    """With article and main renamed, the windows find the same text, and lose none of it."""
    pages = real_pages()
    got = [(html_text.main_text(p), html_text.main_text(re.sub(r"(</?)(article|main)\b", r"\1div", p))) for p in pages]
    assert sum(a == b for a, b in got) >= 0.995 * len(got)
    assert all(a in b for a, b in got)


def test_real_pages_without_any_evidence():
    """With navigation, footer and advert nameless too, the text is found whole; what is next to it comes with it."""
    pages = real_pages()[:500]
    for p in pages:
        bare = re.sub(r'</?(article|main|nav|footer)\b', lambda m: m[0].replace(m[1], "div"), p).replace(' class="ad"', "")
        assert html_text.main_text(p) in html_text.main_text(bare)


def test_ties_repeats_and_an_empty_table(spark):
    page = SHAPES["plain"][0]
    df = spark.createDataFrame([(1, "u", page, "x"), (1, "u", page, "x"), (2, None, page, None)], "page_id long, url string, html string, n_chars string")
    rows = html_text.extract(df).collect()
    assert len(rows) == 3 and {r["text"] for r in rows} == {SHAPES["plain"][1]}
    assert html_text.extract(df.limit(0)).collect() == []
