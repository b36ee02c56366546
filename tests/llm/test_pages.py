"""Main text of pages against the standard library's parser, on malformed pages, and with the selection switched off."""

from __future__ import annotations

import time
from html.parser import HTMLParser

import pytest

from stockflow.llm import html_text

SF = "/root/testdata/sf0.01"
LONG = "A sentence that is long enough to be the main text of a page, or of a part of it. "


class Article(HTMLParser):
    """The text of <article> by blocks, for pages whose articles hold paragraphs and headings alone."""

    def __init__(self, html):
        super().__init__()
        self.inside, self.blocks = False, [""]
        self.feed(html)
        self.close()
        self.text = " ".join(x for b in self.blocks if (x := " ".join(b.split())))

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "h1", "br", "article"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in ("p", "h1"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_all_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = html_text.extract(pages).collect()
    want = {r.page_id: Article(r.html or "").text for r in pages.collect()}
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


BAD = {
    "open quotes": '<a b="' * 160_000,
    "no end": "<a " * 300_000,
    "inline": "<b>" * 300_000,
    "wrong ends": "<b>" * 120_000 + "</i>" * 120_000,
    "ends in quotes": '<a b=">" ' * 110_000,
    "deep": "<div>" * 180_000,
    "deep and skipped": "<div class=ad>x" * 60_000,
    "open paragraphs": "<p>x" * 200_000,
    "open lists": "<ul><li>x" * 100_000,
    "comments": "<!--" * 250_000,
    "ends alone": "</div>" * 150_000,
    "brackets": "<" * 1_000_000,
    "a quote": "<a '" + '<p x=">' * 140_000,
}


@pytest.mark.parametrize("name", sorted(BAD))
def test_malformed_pages_of_a_megabyte_take_seconds(name):
    began = time.time()
    html_text.main_text(BAD[name])
    assert time.time() - began < 15


def test_text_after_an_open_quote_is_kept():
    assert html_text.main_text(f"<p>{LONG}</p><p title='x>Two</p><p>Three</p>") == f"{LONG.strip()} Two Three"


MENU = "".join(f"<div><a href='/{i}'>Go to page {i}</a></div>" for i in range(6))


@pytest.mark.parametrize("page", [f"<body>{MENU}<div>{LONG}</div><p>Short.</p><div>{LONG}</div>{MENU}</body>", f"<main>{MENU}<h1>Title</h1><p>{LONG}</p>{MENU}<p>Short.</p><p><a href='/s'>Source</a></p></main>"])
def test_surge_and_dive_decide(page, monkeypatch):
    chosen = html_text.main_text(page)
    assert "Go to page" not in chosen and chosen.count("long enough") == page.count("long enough") and "Short." in chosen
    assert ("Source" in page) == ("Source" in chosen)
    monkeypatch.setattr(html_text, "stretches", lambda lines: [[i for i, x in enumerate(lines) if x[0]]])
    assert "Go to page" in html_text.main_text(page)


SOURCES = "".join(f"<li><a href='/{i}'>Source number {i}</a></li>" for i in range(4))


@pytest.mark.parametrize("links", [f"<ul>{SOURCES}</ul>", f"<div class='episodes'><ol>{SOURCES}</ol></div>", SOURCES.replace("li>", "p>"), SOURCES.replace("li>", "div>")])
def test_lists_of_links_inside_an_article_stay(links):
    page = f"<article><h1>Title</h1><p>{LONG}</p><h2>References</h2>{links}<p>{LONG}</p></article>"
    assert html_text.main_text(page) == f"Title {LONG.strip()} References Source number 0 Source number 1 Source number 2 Source number 3 {LONG.strip()}"


@pytest.mark.parametrize("box", ["nav", "div class='related'", "div role='navigation'", "ul class='menu'", "aside"])
def test_boxes_of_links_inside_an_article_fall(box):
    page = f"<article><h1>Title</h1><p>{LONG}</p><{box}><h2>See also</h2><ul>{SOURCES}</ul></{box.split()[0]}><p>Short.</p></article>"
    assert html_text.main_text(page) == f"Title {LONG.strip()} Short."


def test_short_stretches_between_gaps_fall():
    page = f"<nav>n</nav><div>Skip this.</div><nav>n</nav><div>{LONG}</div><p>Short.</p><aside>a</aside><div>And this.</div>"
    assert html_text.main_text(page) == f"{LONG.strip()} Short."
    assert html_text.main_text("<article><nav>n</nav><p>Alone.</p><aside>a</aside><p>Too.</p></article>") == "Alone. Too."
    assert html_text.main_text("<article><ul><li><a>One</a><li><a>Two</a><li><a>Three</a></ul></article>") == "One Two Three"
