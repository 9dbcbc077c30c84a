"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of the page. What the markup says about a line only weighs it: a line of
the article weighs its text, a line that stands out of it (menus, page headers, footers, sidebars, notices, adverts,
forms and reader comments, by element, role, class or id; anything outside the article where the page marks one) is a
``SINK``. Weights are summed over sliding windows of ``WINDOW`` lines. A surge is the first line with weight of a window
whose sum rises above the level, a dive is a sink or where windows hold nothing any more, and the text between a surge
and its dive is kept; nothing else decides. The level is 0 inside marked articles. On pages without any it is ``RISE``
of the heaviest window, weights leave out links, and text that a sink parts from a stretch of its own container goes
on with it.

Of several marked articles those with links and under ``NEAR`` of the longest are teasers and sink.

Cases: null and empty pages give empty text; unclosed elements end with their parent or at the next section; a tag that
is never closed is text, and costs one pass; text without any markup is one block; repeated rows are extracted each;
other columns are ignored unless kept; an empty table gives no rows. Nothing is cut short.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from terralift.llm.common import map_text

WINDOW = 3
RISE = 0.2
NEAR = 0.2
SINK = -1.0

#: Element names and words of roles, classes and ids.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split())
SPACED = frozenset("td th br img wbr input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUT = frozenset("nav aside footer form button select textarea dialog menu noscript template iframe object svg canvas audio video head".split())
SECTIONS = frozenset("article main section nav aside footer header body".split())
HOLDERS = frozenset("article body center details div fieldset figure html main section table td".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored sponsors promo promotion promoted banner menu nav navbar navigation breadcrumb breadcrumbs sidebar "
    "side aside widget widgets footer foot header masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social related recommended recommendations comment comments commentlist respond disqus discussion replies reply pagination pager copyright search skip hidden".split()
)

RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|title|textarea|noscript|template|iframe|svg|xmp)\b[^<>]*+>.*?(?:</\1\s*+>|\Z)|<!\[CDATA\[|\]\]>|<[!?][^<>]*+>", re.I | re.S)
#: Quoted values may hold angle brackets if something that can follow a value does; no part is ever read twice.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']++|"[^"<>]*+"|'[^'<>]*+'|"[^"]*+"(?=[\s/>])|'[^']*+'(?=[\s/>])|["'])*+)>""")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"([a-z])([A-Z])")


@dataclass
class Line:
    """One block of a page: its pieces of text, how much of it is links, and where it stands (number of the article, or
    0, and of the element that holds the block)."""

    parts: list[str] = field(default_factory=list)
    linked: int = 0
    out: bool = False
    article: int = 0
    home: int = 0

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def _is_out(name: str, rest: str, in_article: bool) -> bool:
    """Whether an element's place marks its text as no part of the article."""
    if name in OUT or (name == "header" and not in_article):
        return True
    if name in ("html", "body", "main"):
        return False
    for key, value in ATTRIBUTE.findall(rest):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id"):
            found = set(WORD.findall(CAMEL.sub(r"\1 \2", value).lower()))
            if found & WORDS and not (in_article and found & {"header", "side"} and not found & (WORDS - {"header", "side"})):
                return True
        elif key == "role" and value.lower() in ROLES:
            return True
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return True
    return False


def lines_of(page: str) -> list[Line]:
    """The blocks of a page in order."""
    page = RAW.sub(lambda m: " " if m.group(1) is None and m.group(0).startswith("<![") else "", page)
    lines = [Line()]
    stack: list[tuple[str, bool, int]] = []  # open elements, whether they stand outside the article, and their holder
    opened: Counter[str] = Counter()
    outsiders: list[int] = []  # places in the stack of elements outside the article
    found = list(TAG.finditer(page))
    closes = {m[2].lower(): m.start() for m in found if m[1]}  # the last end of each element
    out = links = article = number = 0
    at = home = 0

    def cut() -> None:
        if lines[-1].parts:
            lines.append(Line())
        place(lines[-1])

    def place(line: Line) -> None:
        line.out, line.article, line.home = out > 0, number if article else 0, home

    def add(text: str) -> None:
        if not text:
            return
        line = lines[-1]
        if not line.parts:
            place(line)
        text = html.unescape(text)
        line.parts.append(text)
        if links:
            line.linked += len(text.strip())

    def shut(k: int) -> None:
        nonlocal out, links, article, home
        home = stack[k][2]
        for name, outside, _ in stack[k:]:
            opened[name] -= 1
            out -= outside
            links -= name == "a"
            article -= name in ("article", "main") and not outside
        del stack[k:]
        while outsiders and outsiders[-1] >= k:
            outsiders.pop()

    for n, m in enumerate(found):
        add(page[at : m.start()])
        at = m.end()
        name = m[2].lower()
        if m[1]:
            if opened[name]:
                shut(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            if name in BLOCKS:
                cut()
            elif name in SPACED:
                lines[-1].parts and lines[-1].parts.append(" ")
            continue
        if name in BLOCKS:
            if name == "p" and stack and stack[-1][0] == "p":
                shut(len(stack) - 1)
            if name in SECTIONS:  # an element that is never closed ends where the next section begins
                never = next((i for i in outsiders if closes.get(stack[i][0], -1) <= m.start()), None)
                if never is not None:
                    shut(never)
        elif name in SPACED:
            lines[-1].parts and lines[-1].parts.append(" ")
        if name not in VOID and not m[3].endswith("/"):
            outside = _is_out(name, m[3], article > 0)
            if outside:
                outsiders.append(len(stack))
            stack.append((name, outside, home))
            opened[name] += 1
            out += outside
            links += name == "a"
            if name in ("article", "main") and not outside:
                number += article == 0
                article += 1
            if name in HOLDERS:
                home = n + 1
        if name in BLOCKS:
            cut()
    add(page[at:])
    return lines


def window_sums(weights: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Weight of each line and those after it, ``window`` together; sinks hold nothing."""
    total = np.concatenate([[0], np.cumsum(np.maximum(weights, 0))])
    return total[np.minimum(np.arange(len(weights)) + window, len(weights))] - total[:-1]


def stretches(weights: np.ndarray, level: float = 0, homes: list[int] | None = None, window: int = WINDOW) -> list[tuple[int, int]]:
    """(surge, dive) places: from the first line with weight of a window above ``level`` to the next sink, or to where
    windows hold nothing. With ``homes``, text under the level counts as well if its container has text above it."""
    n, sums, found, at = len(weights), window_sums(weights, window), [], 0
    while at < n:
        if weights[at] <= 0:
            at += 1
            continue
        end, high = at, False
        while end < n and weights[end] >= 0 and sums[end] > 0:
            high = high or sums[end] > level
            end += 1
        found.append((at, end, high))
        at = end
    if homes is not None:
        held = {homes[i] for a, b, high in found if high for i in range(a, b)}
        found = [(a, b, high or any(homes[i] in held for i in range(a, b))) for a, b, high in found]
    return [(a, b) for a, b, high in found if high]


def weigh(lines: list[Line], lengths: list[int]) -> tuple[np.ndarray, bool]:
    """The weight of each line, and whether the page marks an article."""
    size: Counter[int] = Counter()
    linked: Counter[int] = Counter()
    for line, length in zip(lines, lengths, strict=True):
        if line.article and not line.out:
            size[line.article] += length
            linked[line.article] += line.linked
    best = max(size.values(), default=0)
    chosen = {a for a, n in size.items() if n >= NEAR * best or not linked[a]}
    inside = [not line.out and (line.article in chosen if chosen else True) for line in lines]
    weights = [(length if chosen else max(0, length - 2 * line.linked)) if ok else SINK for line, length, ok in zip(lines, lengths, inside, strict=True)]
    return np.array(weights, float), bool(chosen)


def main_text(page: str) -> str:
    """Blocks of the article, joined by two line feeds."""
    lines = [(line, line.text()) for line in lines_of(page)]
    lines = [(line, text) for line, text in lines if text]
    weights, marked = weigh([line for line, _ in lines], [len(text) for _, text in lines])
    level = 0 if marked else RISE * window_sums(weights).max(initial=0)
    found = stretches(weights, level, None if marked else [line.home for line, _ in lines])
    return "\n\n".join(lines[i][1] for a, b in found for i in range(a, b))


def extract(pages: DataFrame, keep: list[str], page: str = "html") -> DataFrame:
    """The columns ``keep`` with ``text`` and ``n_chars``."""

    def run(texts: list[str]) -> dict[str, object]:
        made = [main_text(t) for t in texts]
        return {"text": made, "n_chars": [len(t) for t in made]}

    return map_text(pages, run, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], text=page, keep=keep)
