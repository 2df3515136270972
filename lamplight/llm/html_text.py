"""Main text of web pages by the distribution of text over blocks of lines.

Markup is stripped into lines, one for each block element, and every line has a weight.
A line of text weighs its length; one that is mostly links, or stands in a menu, header,
footer, sidebar, notice, advert, form or in reader comments, weighs a little below zero.
Inside an article or main element, if the page has one, a line weighs the threshold more;
outside of it, it is as dull as a menu's.  Weights are summed over sliding windows of
lines, text only where it is of one block with the window's middle.  A line surges where its window's sum reaches the threshold.  From there the text
goes on, in both directions, over lines of the same container however short they are, up
to a dive: a whole window of dull lines in the page's body.  Dull lines are left out but
end nothing by themselves, so an advert inside the text takes nothing with it.

Classes and ids count only where every word of one says so ("ad-box", but not
"alert-levels"), and not at all on a page that has no other text that surges.

Cases: null and empty pages have an empty text; a page of few words, none of which surges,
is kept as far as it isn't dull; a page that ends in the middle of a tag or a character
reference is read as far as it goes; unclosed elements end with their container; very long
pages are read whole; equal rows have equal texts, and lines of equal weight (ties) stay in
page order; an empty table gives an empty result; extra columns are kept, and one that
clashes with a result is replaced by it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Names of HTML elements by what they hold.
SKIPPED = frozenset("script style template noscript iframe svg math object select button textarea canvas audio video head title".split())
RAW = frozenset("script style textarea title iframe noscript template".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the first kind ends where one of the second begins.
ENDS_BEFORE = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
CLOSES_P = BLOCKS - {"html", "body", "tbody", "thead", "tfoot", "tr", "td", "th", "option", "optgroup", "legend", "summary", "dt", "dd", "li"}
#: Words of a class, id or role that name parts which are no main text, and words that may stand beside them.
MARKS = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banners?|sidebars?|side|aside|nav\w*|menus?|breadcrumbs?|header|masthead|footer|foot|copyright|"
    r"notices?|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscribe|signup|login|comments?|repl(?:y|ies)|disqus|respond|share|sharing|social|related|"
    r"recommend\w*|widgets?|toolbar|pagination|pager|search|complementary|contentinfo|alerts?|disclaimers?"
)
BESIDE = re.compile(r"[a-z]?\d*|box|list|area|section|container|wrap(?:per)?|block|inner|outer|left|right|top|bottom|items?|bar|unit|slot|zone|panel|group|content|body|text|main|site|page|links?|buttons?|form|user|reader|the|js|is|global|primary|secondary|thread|policy|message")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: HTML's own white space, for collapsing; other spaces such as &nbsp; follow Python's idea of white space.
SPACE = re.compile(r"\s+")


#: What a line is: text, text whose class or id speaks against it, text in an element that never holds main text.
PLAIN, MARKED, DULL = 0, 1, 2
#: Weight of a dull line.
BELOW = -40.0


class Line(NamedTuple):
    text: str
    main: bool
    kind: int
    links: float
    within: tuple[int, ...]


@lru_cache(maxsize=4096)
def names_boilerplate(value: str) -> bool:
    """Whether one of the names in a class or id consists of words for boilerplate alone."""
    for name in value.split():
        words = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", name)]
        if any(map(MARKS.fullmatch, words)) and all(MARKS.fullmatch(w) or BESIDE.fullmatch(w) for w in words):
            return True
    return False


def kind_of(attributes: str) -> int:
    """What class, id, role, hidden or style say of an element's lines."""
    if not attributes or ("=" not in attributes and "hidden" not in attributes):
        return PLAIN
    kind = PLAIN
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(a or b or c)
        if name in ("class", "id", "role", "aria-label") and names_boilerplate(value):
            kind = MARKED
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return DULL
    return kind


def page_lines(page: str) -> list[Line]:
    """The page's non-empty block texts in order, and where each stands."""
    lines: list[Line] = []
    open_: list[tuple[str, bool, int, int]] = []  # name; whether main begins here or further out, of what kind the lines are; number
    parts: list[str] = []
    main, kind, linked, in_link, link_depth, number = False, PLAIN, 0, False, 0, 0
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = SPACE.sub(" ", html.unescape(raw)).strip()
            if text:
                lines.append(Line(text, main, kind, linked / len(raw), tuple([x[3] for x in open_ if x[0] not in ("html", "body")])))
            parts.clear()
            linked = 0

    def pop(to: int) -> None:
        nonlocal main, kind, in_link
        flush()
        del open_[to:]
        in_link = in_link and to >= link_depth  # an unclosed link ends with its container
        main, kind = open_[-1][1:3] if open_ else (False, PLAIN)

    def push(name: str, inside: bool, of: int) -> None:
        nonlocal main, kind, number
        number += 1
        open_.append((name, inside, of, number))
        main, kind = inside, of

    while at < end:
        found = TOKEN.search(page, at)
        if not found:
            parts.append(page[at:])
            break
        if found.start() > at:
            parts.append(page[at : found.start()])
            linked += in_link * len(parts[-1])
        at = found.end()
        name = found[3]
        if name is None:
            if found[1]:
                parts.append(found[1])
            continue
        name = name.lower()
        if name == "a":
            in_link, link_depth = not found[2], len(open_)
        if found[2]:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    pop(k)
                    break
                if open_[k][0] in ("table", "article", "main", "body") and name not in BLOCKS:
                    break
            else:
                if name in BLOCKS:
                    flush()
            continue
        if name in SKIPPED or name in RAW:
            # what these hold is never text; the inside of raw ones isn't markup either
            if not found[4].endswith("/") or name in RAW:
                closed = re.compile(rf"</{re.escape(name)}\s*[^>]*(?:>|\Z)", re.I).search(page, at)
                if closed:
                    at = closed.end()
                elif name in ("script", "style"):
                    at = end
            continue
        if name == "br":
            parts.append("\n")
            continue
        if name not in BLOCKS:
            if name not in VOID and (of := kind_of(found[4])):
                flush()
                push(name, main, max(kind, of))
            continue
        flush()
        if name in CLOSES_P:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == "p":
                    pop(k)
                    break
                if open_[k][0] in BLOCKS:
                    break
        elif name in ENDS_BEFORE or name in ("dt", "dd", "td", "th", "tr"):
            for k in range(len(open_) - 1, -1, -1):
                if name in ENDS_BEFORE.get(open_[k][0], ()):
                    pop(k)
                    break
                if open_[k][0] in ("ul", "ol", "dl", "table", "tbody", "menu"):
                    break
        if name in VOID:
            continue
        # A header in the article holds its heading; one outside is the page's.
        of = DULL if name in BOILERPLATE and not (name == "header" and main) else PLAIN if name in ("article", "main", "body", "html") else kind_of(found[4])
        push(name, main or name in ("article", "main"), max(kind, of))
    flush()
    return lines


def line_weights(lines: list[Line], window: int, threshold: float) -> np.ndarray:
    """Weight of each line by what it is and where it stands."""
    has_main = any(x.main and x.kind == PLAIN for x in lines)
    # A whole window of lines that are nothing but links is a menu, also in an article.
    linked = np.array([x.links > 0.9 for x in lines], dtype=float)
    menu = np.convolve(np.convolve(linked, np.ones(window))[window - 1 :] == window, np.ones(window)) > 0 if len(lines) >= window else linked < 0

    def weigh(spared: int) -> np.ndarray:
        out = np.full(len(lines), BELOW)
        for i, x in enumerate(lines):
            if x.kind <= spared and not menu[i] and (x.main or not has_main and x.links < 0.7):
                out[i] = len(x.text) + threshold * x.main
        return out

    plain, within = weigh(PLAIN), [x.within for x in lines]
    if not (window_sums(plain, within, window)[plain > 0] >= threshold).any():
        marked = weigh(MARKED)
        if (window_sums(marked, within, window)[marked > 0] >= threshold).any():
            return marked
    return plain


def window_sums(weights: np.ndarray, within: list[tuple[int, ...]], window: int) -> np.ndarray:
    """Sum of the weights of the window of lines around each line: its dull ones, and the text of one block with the line."""
    n = len(weights)
    block = np.array([p[-2] if len(p) > 1 else 0 for p in within], dtype=np.int64)
    sums = np.zeros(n)
    for step in range(-(window // 2), window - window // 2):
        i = np.arange(max(0, -step), max(0, min(n, n - step)))
        sums[i] += np.where((weights[i + step] < 0) | (block[i + step] == block[i]), weights[i + step], 0.0)
    return sums


def story_lines(weights: np.ndarray, within: list[tuple[int, ...]], window: int, threshold: float) -> np.ndarray:
    """Which lines lie between a surge and its dive.

    `within` names the containers of each line inside the page's body from the outside in;
    where a surge has none, a whole window of dull lines is a dive.
    """
    text = weights > 0
    surge = text & (window_sums(weights, within, window) >= threshold)
    if not surge.any():
        return text
    keep, n, at = np.zeros(len(weights), dtype=bool), len(weights), 0
    while at < n:
        if not surge[at]:
            at += 1
            continue
        end = at
        while end < n and surge[end]:
            end += 1
        shared = within[at]
        for path in within[at + 1 : end]:
            k = 0
            while k < min(len(shared), len(path)) and shared[k] == path[k]:
                k += 1
            shared = shared[:k]
        if end - at == 1:
            shared = shared[:-1]  # a line's own element holds nothing else
        keep[at:end] = True
        for step, i in ((-1, at - 1), (1, end)):
            dull = 0
            while 0 <= i < n and not surge[i]:
                dull = 0 if text[i] else dull + 1
                if dull >= window and not shared:
                    break
                if text[i]:
                    keep[i] |= within[i][: len(shared)] == shared
                i += step
        at = end
    return keep


def main_text(page: str, window: int = 3, threshold: float = 80.0) -> str:
    """The kept lines of a page, joined by empty lines."""
    lines = page_lines(page)
    keep = story_lines(line_weights(lines, window, threshold), [x.within for x in lines], window, threshold)
    return "\n\n".join(x.text for x, k in zip(lines, keep.tolist(), strict=True) if k)


def extract_main_text(pages: DataFrame, html_col: str = "html", window: int = 3, threshold: float = 80.0) -> DataFrame:
    """pages without their html, with text and n_chars (code points)."""
    kept = pages.drop("text", "n_chars") if html_col not in ("text", "n_chars") else pages
    others = [c for c in kept.columns if c != html_col]
    schema = T.StructType([*(kept.schema[c] for c in others), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "", window, threshold) for x in batch.column(html_col)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.fieldNames())

    return kept.select(*others, html_col).mapInArrow(extract, schema)
