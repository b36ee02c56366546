"""Main text of web pages by line-block distribution.

Markup is stripped so that each block element gives a line, whose length is that of its text outside links. A block is
the length of a few successive lines. The main text begins where these lengths surge and ends where they dive to
nothing: at a few successive lines of links alone (menus, lists of other pages), wherever they lie, and at elements that
are never main text (menus, headers, footers, sidebars, notices, adverts, forms, scripts, comments), which are gaps.
Stretches between two dives are kept from their surge on; inside <article> or <main> any text outside links is a surge,
and links in lists or right below a heading (sources, episodes, files) count as text;
elsewhere it takes a block of some length, with which the short lines of its stretch stay, however many wrappers lie
between. An element is a gap by its name, or by a whole class or id; by a class or id it is none if it holds an article,
a main or most of the text.

A page is read in time proportional to its length, however malformed it is: an attribute's open quote at the end of the
page takes their meaning from all later quotes, and an open comment or script goes on to the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
LEAST_BLOCK = 60
LEAST_SHARE = 0.25

OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
QUOTE_OR_END = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

RAW = frozenset("script style noscript template textarea iframe noframes noembed xmp".split())
SKIPPED = RAW | frozenset("head nav footer aside form button select dialog menu svg math canvas object audio video map fieldset datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
CONTENT = frozenset("article main".split())
LISTS = frozenset("ul ol dl".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROOTS = CONTENT | frozenset("html body".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
KEEPS_P_OPEN = frozenset("br td th tr tbody thead tfoot caption option summary".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
NOT_MAIN = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead footer cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus respond widget widgets toolbar pagination pager copyright disclaimer skip".split())
#: Words that make no other thing of a class or id with one of NOT_MAIN, as in "site-footer".
PLACES = frozenset("site global top bottom left right list bar box links buttons".split())
NO_ID = frozenset("h1 h2 h3 h4 h5 h6 p".split())
SHOWN, SOFT, OWN, HARD = range(4)
MOST = 0.5
DEEP = 8
COMMENT = frozenset("comment comments commentlist disqus respond".split())


@lru_cache(4096)
def named(tokens: str) -> frozenset[str]:
    """The words of those classes and ids that say as a whole that an element is none of the main text."""
    found = set()
    for token in tokens.split():
        words = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower()))
        if words & NOT_MAIN and words <= NOT_MAIN | PLACES:
            found |= words
    return frozenset(found)


def not_main(name: str, attributes: str, in_content: bool) -> int:
    """HARD if an element is none of the main text, whatever it holds; SOFT if so unless it holds the main text, OWN unless it holds <main>; else SHOWN."""
    if name in SKIPPED or name == "header" and not in_content:
        return SOFT if name == "form" else HARD
    if not attributes or name not in BLOCK and name != "span":
        return SHOWN
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return SHOWN if name in ("html", "body") else HARD
    words = named(f"{found.get('class', '')} {'' if name in NO_ID else found.get('id', '')}")
    if name in ROOTS:
        split = set(re.findall(r"[a-z]+", found.get("class", "").lower()))
        return HARD if name == "article" and (words | split) & COMMENT else SHOWN
    if words & COMMENT:
        return OWN
    return SOFT if found.get("role", "") in ROLES or words else SHOWN


def tokens_of(html: str) -> Iterator[tuple[str, str, str, str]]:
    """(text before, "/" for an end tag, name, attributes) of each tag, comment (no name) and what follows the last one."""
    at, text_from, quotes, size = 0, 0, True, len(html)
    while m := OPEN.search(html, at):
        start, name = m.start(), m[2]
        if name is None:
            end = html.find("-->", start + 4) if m[0] == "<!--" else html.find(">", m.end())
            if end < 0 and m[0] != "<!--":
                break
            at = size if end < 0 else end + (3 if m[0] == "<!--" else 1)
            yield html[text_from:start], "", "", ""
            text_from = at
            continue
        end, i = -1, m.end()
        while quotes and (q := QUOTE_OR_END.search(html, i)):
            if q[0] == ">":
                end = q.start()
                break
            i = html.find(q[0], q.end()) + 1
            if not i:
                break
        if end < 0:
            quotes = False
            end = html.find(">", m.end())
            if end < 0:
                break
        yield html[text_from:start], m[1], name.lower(), html[m.end() : end]
        at = text_from = end + 1
        if name.lower() in RAW and not m[1]:  # up to its end tag, or the page's end
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = text_from = close.end() if close else size
    yield html[text_from:], "", "", ""


class Page:
    """The lines of a page: (text, length outside links, inside main content, gap), with empty texts for gaps.

    Elements have the numbers of their starts; those in ``shown`` are not skipped. ``held`` gets, for each other SOFT or
    OWN element, the length of its text (infinite if it holds what lets it be shown). Inline elements are not kept on
    the stack, and an element's start and end take the same time however deep they lie.
    """

    def __init__(self, html: str, shown: frozenset[int] = frozenset()) -> None:
        self.shown, self.lines, self.held = shown, [], {}
        self.parts: list[str] = []
        self.plain = self.skipped = self.content = self.hard = self.own = self.total = self.lets_show = self.number = 0
        self.stack: list[tuple[str, bool, int, int, int, int]] = []
        self.places: dict[str, list[int]] = {}  # of open elements on the stack, by name
        self.link = -1  # depth at which a link was opened
        self.lists, self.headed = 0, False  # open lists inside main content; whether links alone have followed a heading
        for text, end, name, attributes in tokens_of(html):
            self._text(text)
            if not name:
                continue
            if name == "a":
                self.link = -1 if end else len(self.stack)
                continue
            if name in BLOCK or name in SKIPPED:
                self._line()
            if end:
                if at := self.places.get(name):
                    self._end(at[-1])
                self.headed |= name in HEADINGS
            elif name not in RAW:
                self._start(name, attributes)
        self._line()

    def _text(self, text: str) -> None:
        if not text or self.hard and self.skipped:
            return
        size = len(text.strip())
        if not self.hard:
            self.total += size
        if not self.skipped:
            self.parts.append(text)
            self.plain += size if self.link < 0 or self.content > 0 and (self.lists > 0 or self.headed) else 0
            self.headed &= self.link >= 0 or not size

    def _line(self) -> None:
        text = " ".join(unescape("".join(self.parts)).split())
        if text:
            self.lines.append((text, self.plain, self.content > 0, False))
        self.parts, self.plain = [], 0

    def _gap(self) -> None:
        self.lines.append(("", 0, self.content > 0, True))

    def _end(self, down_to: int) -> None:
        gap = self.skipped > 0
        while len(self.stack) > down_to:
            name, skip, kind, number, total, lets_show = self.stack.pop()
            self.places[name].pop()
            self.skipped -= skip
            self.hard -= kind == HARD
            self.lists -= name in LISTS and self.content > 0
            self.content -= name in CONTENT
            self.own -= kind == OWN
            if kind in (SOFT, OWN):
                size = self.total - total if kind == SOFT else 0
                self.held[number] = float("inf") if self.lets_show > lets_show else size
        if self.link > len(self.stack):
            self.link = -1
        if gap and not self.skipped:
            self._gap()

    def _start(self, name: str, attributes: str) -> None:
        if name in VOID or attributes.endswith("/") and name not in BLOCK or name not in BLOCK and name not in SKIPPED and name not in ROOTS and name != "span":
            return
        if name == "body":
            self._end(self.places["head"][-1] if self.places.get("head") else len(self.stack))
        for top in range(len(self.stack) - 1, -1, -1):  # ends that HTML leaves out
            other = self.stack[top][0]
            if other in CLOSES.get(name, ()) or other == "p" and name in BLOCK and name not in KEEPS_P_OPEN:
                self._end(top)
                break
            if other in BLOCK or len(self.stack) - top > DEEP:
                break
        kind, self.number = not_main(name, attributes, self.content > 0), self.number + 1
        skip = kind > SHOWN and self.number not in self.shown
        if skip and not self.skipped:
            self._gap()
        if kind == SHOWN and not self.hard and (name == "main" or name == "article" and not self.own):
            self.lets_show += 1
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, skip, kind, self.number, self.total, self.lets_show))
        self.skipped += skip
        self.hard += kind == HARD
        self.own += kind == OWN
        self.lists += name in LISTS and self.content > 0
        self.content += name in CONTENT

    def close(self) -> None:
        """Ends what is still open, for ``held``."""
        self._end(0)


def stretches(lines: list[tuple[str, int, bool, bool]]) -> Iterator[list[int]]:
    """Runs of lines between dives: gaps, and WINDOW or more successive lines of links alone, which belong to none."""
    run: list[int] = []
    links: list[int] = []
    for i, (_, plain, _, gap) in enumerate([*lines, ("", 0, False, True)]):
        if plain == 0 and not gap:
            links.append(i)
            continue
        if len(links) < WINDOW:
            run += links
        elif run:
            yield run
            run = []
        links = []
        if gap:
            if run:
                yield run
            run = []
        else:
            run.append(i)


def surges(lines: list[tuple[str, int, bool, bool]], run: list[int]) -> int:
    """The largest block of a stretch."""
    lengths = [lines[i][1] for i in run]
    blocks, total = 0, 0
    for i, x in enumerate(lengths):
        total += x - (lengths[i - WINDOW] if i >= WINDOW else 0)
        blocks = max(blocks, total)
    return blocks


def main_text(html: str) -> str:
    """The lines between surge and dive points, joined by one space; empty if there are none."""
    page = Page(html)
    lines = page.lines
    page.close()
    if shown := frozenset(i for i, size in page.held.items() if size > max(MOST * page.total, LEAST_BLOCK)):
        lines = Page(html, shown).lines
    if any(inside and text for text, _, inside, _ in lines):
        lines = [x if x[2] else ("", 0, False, True) for x in lines]
    found = [(run, surges(lines, run)) for run in stretches(lines)]
    least = min(LEAST_BLOCK, LEAST_SHARE * max((b for _, b in found), default=0))
    kept = [i for run, b in found if lines[run[0]][2] or b >= least for i in run]
    if not any(lines[i][1] for i in kept):  # an article of links alone
        kept = [i for i, (text, _, inside, _) in enumerate(lines) if text and inside]
    return " ".join(lines[i][0] for i in kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: the main text of each row of ``pages`` and its length in code points.

    A null html is an empty page; an empty page, or one of boilerplate alone, gives an empty text (an element that a class or id calls
    boilerplate is the page's text if it holds most of it, and more than a line). Every row gives one row, repeated ones too; null ids and urls stay; other columns are not passed on. Pages are read whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["text"] = [main_text(x or "") for x in pdf.pop("html")]
            yield pdf

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    out = rows.mapInPandas(run, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
