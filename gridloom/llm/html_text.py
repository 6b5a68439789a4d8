"""Operator 6: main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block element, and every line gets a weight: the length of
its text outside links. The weights of ``WINDOW`` lines are summed from every line on. A dive is a
line where the sum is zero; a stretch goes from the first line with weight to the next dive, and has
a surge where a sum reaches the bar. Stretches with a surge are the text, lines without weight between
included. So a run of menu entries or of links to other stories ends a stretch and is none itself,
while one or two linked lines inside an article stay in it, and headings and short opening lines,
which are next to longer ones, come with these.

Markup is evidence for the weights. Lines of what an element or role declares to be furniture
(navigation, page headers and footers, side bars, hidden parts) weigh nothing; scripts and styles are
no lines. Where the page marks its article (``article`` or ``main``), lines outside weigh nothing,
lines inside have the weight of their whole text unless they are list entries of links only, and the
bar is one character; elsewhere it is ``SURGE`` for one stretch at least, and once there is one, every
other stretch that is mostly text outside links counts. Classes and ids that sound like adverts,
notices, comments and the like, and forms, are doubtful, as such names also stand on wrappers of whole
pages: lines get as their level the number of doubtful elements around them; the lowest level whose
own lines have a surge counts, lines of higher levels weigh nothing. What weighs nothing by such
evidence is no text either where it lies inside a stretch.

Defined results: null or empty html gives an empty text; markup that is not closed ends with its
parent or the page; repeated rows give one result row each; null ids and urls are kept; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import small_batches, table

WINDOW, SURGE = 3, 80

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|title|textarea|noscript|iframe|svg|math|template|object|canvas|audio|video|select)\b[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*+>|<[!?/][^>]*+>",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_PARTS = re.compile(r"[a-z]+")

#: Elements of page furniture, roles and words in classes and ids that hint at it (fixed values).
FURNITURE = frozenset("nav footer aside button menu dialog head".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu sidebar footer "
    "cookie cookies consent notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment "
    "comments disqus reply replies respond related recommended breadcrumb breadcrumbs pagination pager search widget skip toolbar".split()
)
COMMENTS = frozenset("comment comments reply replies".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENTRIES = frozenset("li dd dt td th option".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def _judged(name: str, attrs: str, in_article: bool) -> str:
    """What an element is by its name and attributes: furniture, doubtful or (empty) text."""
    if name in FURNITURE or (name == "header" and not in_article):
        return "furniture"
    if name in ("html", "body", "main"):
        return ""
    doubt = "doubtful" if name == "form" else ""
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return "furniture"
        if key == "style" and "display:none" in value.replace(" ", ""):
            return "furniture"
        if key == "role" and value == "form":
            doubt = "doubtful"
        if key in ("class", "id"):
            marks = COMMENTS if name == "article" else MARKS
            if not marks.isdisjoint(_PARTS.findall(value)) or (name != "article" and not in_article and "header" in _PARTS.findall(value)):
                doubt = "doubtful"
    return doubt


@dataclass
class Lines:
    """Lines of a page in order: text, characters outside links, doubtful elements around it, whether
    it is in a marked article, an entry of a list or table, and declared furniture."""

    text: list[str] = field(default_factory=list)
    plain: list[int] = field(default_factory=list)
    level: list[int] = field(default_factory=list)
    inside: list[bool] = field(default_factory=list)
    entry: list[bool] = field(default_factory=list)
    furniture: list[bool] = field(default_factory=list)


class _Doubts:
    """Doubtful elements that are open, outermost first: name and how many of that name are open in it."""

    def __init__(self):
        self.open: list[list] = []

    def opened(self, name: str) -> None:
        if name in BLOCKS and self.open and self.open[-1][0] == "p":  # a paragraph ends where a block begins
            self.open.pop()
        for e in reversed(self.open):
            if e[0] == name:
                e[1] += 1
                break

    def closed(self, name: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == name:
                self.open[i][1] -= 1
                if not self.open[i][1]:
                    del self.open[i:]
                break


def lines_of(page: str) -> tuple[Lines, bool]:
    """The lines of a page, and whether it marks an article."""
    out, doubts = Lines(), _Doubts()
    text: list[str] = []
    linked = 0
    in_link = 0
    article = 0  # depth of article and main
    marked = False
    entry = False
    within = 0  # doubtful elements that were open where the article began
    skip, depth, skip_in, nested = "", 0, False, 0

    def end_line() -> None:
        nonlocal linked
        if text:
            raw = "".join(text)
            if "&" in raw:
                raw = entities.unescape(raw)
            line = " ".join(raw.split())
            if line:
                out.text.append(line)
                out.plain.append(max(0, len(line) - linked))
                out.level.append(len(doubts.open) - (within if article else 0))
                out.inside.append(article > 0)
                out.entry.append(entry)
                out.furniture.append(bool(skip))
            text.clear()
        linked = 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            text.append(piece)
            if in_link:
                linked += len(piece.strip())
        at = m.end()
        name = m[3]
        if not name:
            if m[1] and not skip and m[1].lower() not in ("svg", "math", "canvas"):
                text.append(" ")
            continue
        name, closing, attrs = name.lower(), bool(m[2]), m[4]
        if skip:
            if name in BLOCKS:
                end_line()
            if name == skip and not attrs.rstrip().endswith("/"):
                depth += -1 if closing else 1
            ends = depth == 0
            if not ends and not closing and not marked and (name == "main" or name == "article" and not _judged(name, attrs, False)) or name == "body" and (closing or skip == "head"):
                ends = True
                if name != skip:
                    depth = 0
            if name in ("article", "main") and name != skip:
                ends = ends or closing and skip_in and nested == 0  # the parent ends
                nested = max(0, nested - 1) if closing else nested + 1
            if not ends:
                continue
            end_line()
            done, skip = skip, ""
            if name == done and depth == 0 and closing:
                continue
        if name in BLOCKS:
            end_line()
            entry = name in ENTRIES and not closing or entry and name not in ENTRIES and name not in ("ul", "ol", "dl", "table")
        elif name == "br":
            text.append(" ")
        if closing:
            if name == "a":
                in_link = max(0, in_link - 1)
            before = len(doubts.open)
            doubts.closed(name)
            if name in ("article", "main") and article and len(doubts.open) == before:
                article -= 1
                if not article:
                    del doubts.open[within:]  # what was not closed inside ends with the article
            continue
        if name in VOID or attrs.endswith("/"):
            continue
        kind = _judged(name, attrs, article > 0)
        if kind == "furniture":
            end_line()
            skip, depth, skip_in, nested = name, 1, article > 0, 0
            continue
        if kind == "doubtful":
            end_line()
            if doubts.open and doubts.open[-1][0] == "p" and name in BLOCKS:
                doubts.open.pop()
            doubts.open.append([name, 1])
        else:
            doubts.opened(name)
            if name in ("article", "main"):
                if not article:
                    within = len(doubts.open)
                article += 1
                marked = True
        if name == "a":
            in_link = 1
        elif name in BLOCKS:
            in_link = 0
    if at < len(page):
        rest = page[at:]
        cut = rest.rfind("<")  # a tag that is cut off at the end of the page
        text.append(rest if cut < 0 or not re.match(r"</?[a-zA-Z!]", rest[cut:]) else rest[:cut])
    end_line()
    return out, marked


def window_sums(weights: np.ndarray) -> np.ndarray:
    """Weights of each line and the next ones, WINDOW in all."""
    total = np.concatenate([[0], np.cumsum(np.concatenate([weights, np.zeros(WINDOW, dtype=weights.dtype)]))])
    return total[WINDOW:][: len(weights)] - total[: len(weights)]


def stretches(weights: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of lines from one with weight to the next dive (exclusive), and the highest sum of a window in it."""
    sums = window_sums(weights)
    heavy, empty = np.flatnonzero(weights > 0), np.flatnonzero(sums == 0)
    out, i = [], 0
    while (k := np.searchsorted(heavy, i)) < len(heavy):
        start = int(heavy[k])
        d = np.searchsorted(empty, start)
        dive = int(empty[d]) if d < len(empty) else len(weights)
        out.append((start, dive, int(sums[start:dive].max())))
        i = dive + 1
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    lines, marked = lines_of(page)
    if not lines.text:
        return ""
    length, plain, level = np.array([len(x) for x in lines.text]), np.array(lines.plain), np.array(lines.level)
    inside, entry, declared = np.array(lines.inside), np.array(lines.entry), np.array(lines.furniture)
    marked = marked and bool((inside & ~declared).any())
    weight = np.where(entry & (plain == 0), 0, length) if marked else plain
    known = declared | ~inside if marked else declared
    weight = np.where(known, 0, weight)
    for bar in (1,) if marked else (SURGE, 1):
        for most in np.unique(level[weight > 0]):
            if any(top >= bar for _, _, top in stretches(np.where(level == most, weight, 0))):
                gone = known | (level > most)
                own = np.where(gone, 0, weight)
                kept = [(a, b) for a, b, top in stretches(own) if top >= bar or 2 * plain[a:b][~gone[a:b]].sum() > length[a:b][~gone[a:b]].sum()]
                return " ".join(lines.text[i] for a, b in kept for i in range(a, b) if not gone[i])
    return ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page) for page in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
