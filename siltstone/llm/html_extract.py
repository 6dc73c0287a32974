"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block of the page; scripts, styles and other raw elements go, and lines inside
menus, headers, footers, sidebars, notices, adverts, forms or reader comments (by element, role, or the words of
class and id, unless it holds an article or most of the page's text) are left out, so they open no gap. Of the lines
that are left, the text lengths, without those of links, are summed over sliding windows. A stretch of windows that
hold text is the text's if it surges to SURGE (or to the page's own highest sum, if that is less): it begins at the
line from which its windows rise from nothing and ends where they dive to nothing. Stretches are weighed by their text;
from the first to the last of the heavy ones all is kept, lists of links between them too, and headings just above.

Elements `article` and `main` are evidence that weighs lines, on pages where they hold half of the text or more: a line
inside counts one at least, and one outside a quarter of its length, and nothing if that is under OUTSIDE. A long passage
outside them is kept, then, as a stretch like any other; a line that counts nothing is left out between the stretches.

In a line, character references are decoded and white space becomes one space; empty lines go; lines are joined by
\\n in page order. Null html counts as empty; a page without text gives an empty string. A tag ends at its `>`, or before
the next `<` outside quotes, which count only after `=`. Very long pages are read whole, in time linear in their length.
Repeated rows and identifiers are extracted row by row; an empty table gives an empty one. Other columns of the input
are left out.
"""

from __future__ import annotations

import functools
import html as _html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, text_of

WINDOW = 3
#: Text of a window from which a surge is one.
SURGE = 40
#: The least that a line outside a page's article counts, a quarter of its length; below that it counts nothing.
OUTSIDE = 15
#: Text of a run that is kept besides the heaviest.
HEAVY = 120
#: Text that an element has to hold so that its name doesn't blank it.
WRAPPED = 240

_NAME = re.compile(r"(/?)([A-Za-z][^\s/><]*)")
_PLAIN = re.compile(r"[^<>\"']*")
_ATTR = re.compile(r"\b(class|id|role|aria-label|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Elements of HTML by what they do here.
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas audio video xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
SKIP = frozenset("nav footer aside form head menu dialog button select option datalist fieldset search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist note".split())
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion promoted banner nav navbar navigation menu menus sidebar side aside footer foot breadcrumb breadcrumbs cookie cookies consent gdpr notice notices notification alert disclaimer comment comments commentlist disqus reply replies respond share sharing social related recommended recommendations newsletter subscribe subscription signup login widget widgets popup modal overlay pagination pager paging toolbar tags tagcloud masthead topbar form search copyright".split()
)
#: First and last words of a class that speaks of what an element has beside or inside it.
BEFORE = frozenset("has no not with without is".split())
AFTER = frozenset("open opened closed on off enabled disabled".split())
#: An open element that one of these closes if it is still open.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES |= {t: {"p"} for t in BLOCK if t not in CLOSES}
CLOSABLE = frozenset().union(*CLOSES.values())
#: What stops that search.
SCOPE = frozenset("article aside blockquote body center details dialog div fieldset figure footer form header html main nav section table ul ol dl".split())


def _unwanted(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """By the element, its role or hidden; by the words of its class or id."""
    if tag in SKIP or tag == "header" and not in_article:
        return True, False
    if not attributes or tag in ("html", "body"):
        return False, False
    named = False
    for name, a, b, c in _ATTR.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden":
            return True, False
        if name == "role" and value.lower() in ROLES:
            return True, False
        if name in ("class", "id") and tag not in ("article", "main"):
            for token in value.split():
                parts = [p.lower() for p in _PART.findall(token)]
                if parts and parts[0] not in BEFORE and parts[-1] not in AFTER:
                    named |= not BOILERPLATE.isdisjoint(parts) or "header" in parts and not in_article and tag not in HEADING
    return False, named


class _Tags:
    """The tags of a page, in one scan forward."""

    def __init__(self, page: str):
        self.page, self.size = page, len(page)
        self.without: set[str] = set()  # quotes that don't come any more

    def end(self, at: int) -> int:
        """Where the attributes that begin at `at` end: at `>`, before the next `<`, or with the page."""
        page = self.page
        while True:
            plain = _PLAIN.match(page, at)
            at = plain.end()
            if at >= self.size or page[at] in "<>":
                return at
            quote = page[at]
            at += 1
            if quote not in self.without and plain[0].rstrip().endswith("="):
                close = page.find(quote, at)
                if close < 0:
                    self.without.add(quote)
                else:
                    at = close + 1

    def __iter__(self):
        """(text before, whether it closes, tag or empty, attributes)"""
        page, at, size, begin = self.page, 0, self.size, 0
        last = page.rfind(">")  # what opens behind it is no tag
        while (lt := page.find("<", at)) >= 0 and lt < last:
            after = page[lt + 1 : lt + 2]
            if after in ("!", "?"):
                yield page[begin:lt], "", "", ""
                if page.startswith("<!--", lt):
                    close = page.find("-->", lt + 4)
                    at = begin = size if close < 0 else close + 3
                elif page.startswith("<![CDATA[", lt):
                    close = page.find("]]>", lt + 9)
                    yield page[lt + 9 : size if close < 0 else close], "", "", ""
                    at = begin = size if close < 0 else close + 3
                else:
                    close = page.find(">", lt)
                    at = begin = size if close < 0 else close + 1
                continue
            m = _NAME.match(page, lt + 1)
            if not m:
                at = lt + 1
                continue
            stop = self.end(m.end())
            yield page[begin:lt], m[1], m[2].lower(), page[m.end() : stop]
            at = begin = stop + 1 if page[stop : stop + 1] == ">" else stop
            if not m[1] and (tag := m[2].lower()) in RAW and not (tag in ("svg", "math") and page[m.end() : stop].rstrip().endswith("/")):
                close = _ends(tag).search(page, at) if tag not in self.without else None
                if not close:
                    self.without.add(tag)
                at = begin = close.end() if close else size
        yield page[begin:], "", "", ""


@functools.cache
def _ends(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>", re.I)


def lines_of(page: str) -> list[tuple[str, int, bool, bool, bool]]:
    """(text, characters outside links, is unwanted, stands in an article, is a heading) of each block."""
    out: list[tuple[str, int, bool, bool, bool]] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, bool, bool, int]] = []  # tag, unwanted, in article, in link, place in named
    state = ["", False, False, False, 0]
    opened: Counter = Counter()  # elements in the stack, by tag
    bounds: list[int] = []  # places in the stack of elements that a new block may close or that stop the search
    # Elements that a class or id calls unwanted: [the one around it, text below it, holds an article]; 0 is the page.
    named: list[list] = [[0, 0, False]]
    within: list[int] = []  # of each line, the innermost of these

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                inside = len("".join("".join(linked).split()))
                heading = any(t in HEADING for t, *_ in stack[-4:])
                out.append((text, max(0, len(text.replace(" ", "")) - inside), state[1], state[2], heading))
                within.append(state[4])
            parts.clear()
            linked.clear()

    def close_from(k: int) -> None:
        """The elements from place k of the stack on are closed."""
        for t, *_ in stack[k:]:
            opened[t] -= 1
        del stack[k:]
        while bounds and bounds[-1] >= k:
            bounds.pop()
        state[:] = list(stack[-1]) if stack else ["", False, False, False, 0]

    for raw, closing, tag, attributes in _Tags(page):
        if raw:
            text = _html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if state[3]:
                linked.append(text)
        if not tag:
            continue
        if tag == "br" or tag in RAW and not closing:
            parts.append(" ")
            continue
        if closing:
            if opened[tag]:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                if any(t in BLOCK for t, *_ in stack[k:]):
                    flush()
                close_from(k)
            elif tag in BLOCK:
                flush()
            continue
        if tag in BLOCK:
            flush()
            if closes := CLOSES.get(tag):
                for k in reversed(bounds):
                    if stack[k][0] in closes:
                        close_from(k)
                        break
                    if stack[k][0] in SCOPE:
                        break
            if tag in ("article", "main") and stack and not stack[-1][2]:
                # elements that should have been closed before the article
                k = len(stack)
                while k and (stack[k - 1][1] or stack[k - 1][4]) and stack[k - 1][0] in ("nav", "ul", "ol", "li", "a", "p", "span", "b", "i"):
                    k -= 1
                close_from(k)
        if tag in VOID:
            continue
        bad, by_name = _unwanted(tag, attributes, state[2])
        at_name = state[4]
        if by_name:
            named.append([at_name, 0, False])
            at_name = len(named) - 1
        if tag in ("article", "main"):
            named[at_name][2] = True
        if tag in CLOSABLE or tag in SCOPE:
            bounds.append(len(stack))
        opened[tag] += 1
        stack.append((tag, state[1] or bad, state[2] or tag in ("article", "main"), state[3] or tag == "a", at_name))
        state[:] = list(stack[-1])
    flush()
    if len(named) == 1:
        return out
    for line, k in zip(out, within):
        named[k][1] += line[1] * (not line[2])
    for k in range(len(named) - 1, 0, -1):
        around, length, article = named[k]
        named[around][1] += length
        named[around][2] |= article
    # A name alone doesn't blank an article or most of the page's text (a line or two are no wrapper).
    least = max(named[0][1] // 2 + 1, WRAPPED)
    gone = [False]
    for around, length, article in named[1:]:
        gone.append(gone[around] or not article and length < least)
    return [(text, n, bad or gone[k], article, heading) for (text, n, bad, article, heading), k in zip(out, within)]


def _weighed(lines: list[tuple[str, int, bool, bool, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """What each line counts, and whether it may be kept when it counts nothing."""
    length, marked = np.array([x[1] for x in lines]), np.array([x[3] for x in lines])
    if not marked.any() or 2 * length[marked].sum() < length.sum():
        return length, np.ones(len(lines), bool)
    outside = np.where(length // 4 >= OUTSIDE, length // 4, 0)
    return np.where(marked, np.maximum(length, 1), outside), marked


def main_text(page: str | None, window: int = WINDOW) -> str:
    lines = [x for x in lines_of(page or "") if not x[2]]
    if not lines:
        return ""
    counts, sure = _weighed(lines)
    begins, ends = _stretches(counts, window, SURGE)
    if not begins:
        return ""
    weigh = np.array([int(counts[a:z].sum()) for a, z in zip(begins, ends)])
    heavy = np.flatnonzero(weigh >= min(weigh.max(), HEAVY))
    a, z = begins[heavy[0]], ends[heavy[-1]]
    while a and lines[a - 1][4] and sure[a - 1]:
        a -= 1
    return "\n".join(lines[i][0] for i in range(a, z) if sure[i] or counts[i])


def _stretches(counts: np.ndarray, window: int, least: int) -> tuple[list[int], list[int]]:
    """Line ranges of the stretches of windows that hold text, those in which a window's sum surges to `least` or to
    the highest sum of all: from the first line with text to the last before the dive."""
    n = len(counts)
    total = np.concatenate([[0], np.cumsum(counts)])
    sums = total[np.minimum(np.arange(n) + window, n)] - total[:n]
    least = min(least, int(sums.max(initial=0)))
    begins, ends = [], []
    held = np.flatnonzero(counts)
    cuts = np.flatnonzero(np.diff(held) > window)  # from a line to the next with text, a whole window holds none
    for first, last in zip(np.r_[held[:1], held[cuts + 1]].tolist(), np.r_[held[cuts], held[-1:]].tolist()):
        if least and sums[first : last + 1].max() >= least:
            begins.append(first)
            ends.append(last + 1)
    return begins, ends


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text string."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("html"))
    return arrow_map(source, run, f"page_id {source.schema[0].dataType.simpleString()}, url string, text string")
