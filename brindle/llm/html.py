"""Main text of web pages by tag-path ratios.

A page's text is cut into blocks, each with the tag path from the root. For every distinct path the text
and the punctuation of its blocks are set against the number of its nodes. Both ratios are smoothed over
the page's blocks in order and fused. The first wide gap between the paths' fused ratios, under most of the text, parts content
from the rest; blocks under it are kept only where content surrounds them: in the same container, and not mostly links.

Markup that tells menus, adverts, forms, comments and the like is evidence, weighed against where the text of
the page is: an element around most of it is a wrapper, whatever its name, unless the name is unmistakable
and there is an article elsewhere (`judged`). What remains marked has no score and is never kept.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table

#: Fixed values of HTML: elements without content, with raw text, and those that don't break a block.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noframes", "xmp", "svg", "object", "canvas", "audio", "video", "annotation", "annotation-xml"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "label"} | {
    "math", "mfrac", "mi", "mn", "mo", "mover", "mroot", "mrow", "ms", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtext", "munder", "munderover", "semantics"
}
#: A start tag that closes an open element of the second kind, up to the limits named.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody"}, "tfoot": {"tbody"}}
LIMITS = {"ul", "ol", "dl", "table", "select", "body", "div", "article", "section"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: Elements, roles and attribute words that are unmistakably no article text.
OUTSIDE = {"nav", "footer", "button", "select", "dialog", "menu", "head"} | RAW
OUTSIDE_ROLES = {"navigation", "banner", "contentinfo", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
OUTSIDE_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adbox", "banner", "banners", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "respond", "reply", "replies", "disqus", "cookie", "cookies", "consent", "gdpr", "notice", "notices",
    "footer", "masthead", "topbar", "menu", "menus", "nav", "navbar", "navigation", "pagination", "pager", "popup", "modal", "promo", "promotion", "share", "sharing", "social", "skip", "sponsor", "sponsored", "sponsors",
    "subscribe", "subscription", "newsletter", "signup", "login", "toolbar", "copyright", "hidden",
}
#: Those that also name wrappers and layouts, and those of them that may name a part of an article.
BOXES = {"aside", "form", "fieldset"}
BOX_ROLES = {"complementary", "search", "form", "note"}
BOX_WORDS = {"sidebar", "sidebars", "side", "rail", "search", "related", "recommended", "alert", "disclaimer", "foot", "overlay", "widget", "widgets", "legal", "tags"}
VAGUE_WORDS = {"side", "rail", "search", "foot", "legal", "tags", "overlay"}
MAIN_WORDS = {"article", "content", "main", "post", "story", "entry", "body", "text"}
#: Words in front that make a name say something of the layout alone.
LAYOUT_WORDS = {"no", "not", "without", "with", "has", "hide", "hides"}
#: Elements of running text: only unmistakable words count on them.
TEXT_TAGS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "dt", "dd", "pre", "blockquote", "figcaption", "td", "th", "tr"}
#: Strengths of marks.
UNMARKED, VAGUE, BOX, HARD = range(4)
#: Weight of the ratios in a part of an article that a vague word marks.
VAGUE_WEIGHT = 0.5

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[>\"']")
#: Most tags: a few attributes of usual length. The bounds keep a text of `<` without `>` linear; other tags are read piece by piece.
SHORT = re.compile(r"<(/?)([a-zA-Z][^\s/>]{0,40})([^>\"']{0,100}(?:\"[^\"]{0,200}\"[^>\"']{0,100}){0,4})>")
MARKED = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")
PUNCTUATION = re.compile(r"[.,;:!?¡¿…。，、]")


#: Elements whose id says nothing about their part of the page.
OWN_IDS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "section", "li", "dt", "dd", "pre", "blockquote", "figure", "table", "td", "th", "tr"} | INLINE


class Element(NamedTuple):
    """path: a number for each distinct tag path; in_article: an article or main element is around it; weight: of its text's ratios."""

    tag: str
    path: int
    parent: int
    outside: bool
    in_article: bool
    weight: float = 1.0


class Tag(NamedTuple):
    """start and end in the page; name is empty for comments and declarations."""

    start: int
    end: int
    closes: bool
    name: str
    attributes: str


class Block(NamedTuple):
    text: str
    element: int
    linked: int


def attribute_marks(attributes: str, with_id: bool = True) -> tuple[set[str], str, bool, set[str], bool]:
    """Words of class and id, role, whether the element is hidden, the words that may mark it, and whether a whole name says that it is the main part."""
    words: set[str] = set()
    marking: set[str] = set()
    role, hidden, is_main = "", False, False
    for name, value in MARKED.findall(attributes):
        name, value = name.lower(), html.unescape(value.strip("\"'"))
        if name == "class" or name == "id" and with_id:
            for w in value.split():
                parts = [x for x in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", w).lower()) if x]
                words.update(parts)
                if not parts or parts[0] not in LAYOUT_WORDS:
                    marking.update(parts)
                is_main = is_main or len(parts) == 1 and parts[0] in MAIN_WORDS
        elif name == "role":
            role = value.strip().lower()
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
    return words, role, hidden, marking, is_main


def mark_of(tag: str, role: str, hidden: bool, marking: set[str], is_main: bool, in_article: bool) -> int:
    """How strongly an element's own markup says that it is no article text."""
    if tag in OUTSIDE:
        return HARD
    if tag in ("html", "body", "article", "main"):
        return UNMARKED
    top = not in_article and (tag == "header" or "header" in marking and not MAIN_WORDS & marking)
    if top or hidden or role in OUTSIDE_ROLES or OUTSIDE_WORDS & marking:
        return HARD
    found = BOX_WORDS & marking
    if tag in BOXES or role in BOX_ROLES or found and tag not in TEXT_TAGS and not is_main:
        return VAGUE if in_article and tag not in BOXES and role not in BOX_ROLES and found <= VAGUE_WORDS else BOX
    return UNMARKED


#: A text of so many characters beside links, with the end of a sentence, shows that there is an article.
ARTICLE_CHARS = 40
#: Share of the page's text from which on an element is around most of it.
MOST = 0.5
SENTENCE = re.compile(r"[.!?…。]")


def judged(elements: list[Element], marks: list[int], blocks: list[Block]) -> list[Element]:
    """Elements with `outside` and `weight` set by their marks and by where the text is.

    A marked element is a wrapper, and its mark is void, if most of the page's text is in it and it holds a
    heading of the first level, an article or main element, or nothing unmarked looks like an article. Unmistakable
    marks are void only if it holds such an element and nothing unmarked looks like an article.
    """
    n = len(elements)
    every, soft, plain, holds = [0] * n, [0] * n, [True] * n, [e.tag in ("article", "main", "h1") for e in elements]
    hard = [m == HARD for m in marks]
    for i in range(1, n):
        up = elements[i].parent
        hard[i] = hard[i] or hard[up]
        plain[i] = plain[up] and marks[i] == UNMARKED
    article = False
    for b in blocks:
        own = max(0, len(b.text) - b.linked)
        every[b.element] += own
        soft[b.element] += 0 if hard[b.element] else own
        if plain[b.element] and own > (1 - LINKS) * len(b.text):
            article = article or elements[b.element].in_article or own >= ARTICLE_CHARS and bool(SENTENCE.search(b.text))
    for i in range(n - 1, 0, -1):
        up = elements[i].parent
        every[up] += every[i]
        soft[up] += soft[i]
        holds[up] = holds[up] or holds[i]
    out = list(elements)
    for i in range(1, n):
        up, m = out[elements[i].parent], marks[i]
        outside, weight = up.outside, up.weight
        if m == VAGUE:
            weight *= VAGUE_WEIGHT
        elif m == BOX:
            outside = outside or not (soft[i] > MOST * soft[0] and (holds[i] or not article))
        elif m == HARD:
            outside = outside or elements[i].tag in OUTSIDE or not (every[i] > MOST * every[0] and holds[i] and not article)
        if outside or weight != 1.0:
            out[i] = elements[i]._replace(outside=outside, weight=weight)
    return out


def tags(page: str) -> Iterator[Tag]:
    """Tags, comments and declarations in order, in linear time; a `<` that starts none is text. Takes no tag inside a raw element if told its end."""
    quotes, last = True, {'"': page.rfind('"'), "'": page.rfind("'")}
    at = page.find("<")
    while at >= 0:
        resume = at + 1
        if quotes and (m := SHORT.match(page, at)):
            resume = (yield Tag(at, m.end(), m[1] == "/", m[2].lower(), m[3])) or m.end()
        elif page.startswith("!--", at + 1):
            end = page.find("-->", at + 4)
            resume = end + 3 if end >= 0 else len(page)
            resume = (yield Tag(at, resume, False, "", "")) or resume
        elif page[at + 1 : at + 2] in ("!", "?"):
            if (end := page.find(">", at)) < 0:
                return
            resume = (yield Tag(at, end + 1, False, "", "")) or end + 1
        elif m := NAME.match(page, at + 1):
            end, look = -1, m.end()
            while quotes and (stop := STOP.search(page, look)):
                c, k = stop[0], stop.start()
                if c == ">":
                    end = k
                    break
                look = page.find(c, k + 1) + 1 if k < last[c] else k + 1  # a quote that never ends is an ordinary character
            if end < 0:  # a quote swallows the rest of the page: from here on quotes are ordinary characters
                quotes = False
                if (end := page.find(">", m.end())) < 0:
                    return
            resume = (yield Tag(at, end + 1, bool(m[1]), m[2].lower(), page[m.end() : end])) or end + 1
        at = page.find("<", resume)


def parse(page: str) -> tuple[list[Element], list[Block]]:
    """Elements with their paths, and the text blocks in page order."""
    elements, marks = [Element("", 0, -1, False, False)], [UNMARKED]
    paths: dict[tuple[int, str], int] = {}
    stack = [0]
    open_now: defaultdict[str, list[int]] = defaultdict(list)  # the places in the stack of each tag's open elements
    blocks: list[Block] = []
    pieces: list[str] = []
    linked = at = 0
    in_link = False

    def flush() -> None:
        nonlocal linked
        if pieces:
            if text := " ".join(html.unescape("".join(pieces)).split()):
                blocks.append(Block(text, stack[-1], min(linked, len(text))))
            pieces.clear()
        linked = 0

    def pop(k: int) -> None:
        for e in stack[k:]:
            open_now[elements[e].tag].pop()
        del stack[k:]

    def close(ends: set[str], limits: set[str]) -> None:
        """Close the innermost open element of `ends`, and all in it, unless one of `limits` is around the place."""
        k = max((open_now[e][-1] for e in ends if open_now[e]), default=0)
        if k and all(not open_now[x] or open_now[x][-1] <= k for x in limits):
            pop(k)

    found = tags(page)
    tag = next(found, None)
    while tag is not None:
        resume = None
        if tag.start > at:
            piece = page[at : tag.start]
            pieces.append(piece)
            if in_link:
                linked += len(piece)
        at, name = tag.end, tag.name
        if name == "br":
            pieces.append(" ")
        elif name in INLINE and (tag.closes or not OUTSIDE_WORDS & attribute_marks(tag.attributes, False)[3]):
            if name == "a":
                in_link = not tag.closes
            if tag.closes and open_now[name]:  # it is an element that is outside
                flush()
                close({name}, set())
        elif name:
            flush()
            in_link = False
            if tag.closes:
                close({name}, set())
            elif name not in VOID:
                close(CLOSES.get(name, set()), LIMITS - CLOSES.get(name, set()))
                if name in CLOSES_P:
                    close({"p"}, LIMITS)
                up = elements[stack[-1]]
                words, role, hidden, marking, is_main = attribute_marks(tag.attributes, name not in OWN_IDS) if tag.attributes else (set(), "", False, set(), False)
                step = (up.path, f"{name}.{'-'.join(sorted(words))}")
                elements.append(Element(name, paths.setdefault(step, len(paths) + 1), stack[-1], False, up.in_article or name in ("article", "main")))
                marks.append(mark_of(name, role, hidden, marking, is_main, up.in_article))
                if name not in RAW or tag.attributes.rstrip().endswith("/"):
                    open_now[name].append(len(stack))
                    stack.append(len(elements) - 1)
                else:
                    end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                    resume = at = end.end() if end else len(page)
        try:
            tag = found.send(resume)
        except StopIteration:
            tag = None
    if at < len(page):
        pieces.append(page[at:])
    flush()
    return judged(elements, marks, blocks), blocks


def smoothed(values: list[float], radius: int = 2) -> list[float]:
    """Gaussian smoothing over neighbours; ends are weighted by what they have."""
    weights = [math.exp(-(k * k) / (2.0 * max(radius, 1) ** 2 / 4)) for k in range(radius + 1)]
    out = []
    for i in range(len(values)):
        total = norm = 0.0
        for k in range(max(0, i - radius), min(len(values), i + radius + 1)):
            w = weights[abs(k - i)]
            total += w * values[k]
            norm += w
        out.append(total / norm)
    return out


def content_scores(elements: list[Element], blocks: list[Block]) -> list[float]:
    """Fused tag-path ratios of each block: text per node times punctuation per node, smoothed; 0 outside. Text of links doesn't count."""
    by: dict[int, list[float]] = {}
    for b in blocks:
        t = by.setdefault(elements[b.element].path, [0.0, 0.0, 0.0])
        t[0] += max(0, len(b.text) - b.linked)
        t[1] += len(PUNCTUATION.findall(b.text))
        t[2] += 1
    texts = smoothed([by[elements[b.element].path][0] / by[elements[b.element].path][2] for b in blocks])
    marks = smoothed([by[elements[b.element].path][1] / by[elements[b.element].path][2] for b in blocks])
    return [0.0 if elements[b.element].outside else elements[b.element].weight * math.sqrt(t * (1.0 + m)) for b, t, m in zip(blocks, texts, marks, strict=True)]


#: Paths are parted at the first gap of this ratio above which there is this share of the text.
GAP, UPPER = 1.6, 0.75
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Share of its text from which on a block counts as links.
LINKS = 0.5
#: Elements that stand in a container as parts of its text.
PARTS = TEXT_TAGS | {"ul", "ol", "dl", "table", "figure"}


def threshold(paths: list[tuple[float, int]]) -> float:
    """The least score of content, from the scores and text lengths of paths: what stands above the first wide gap under most of the text."""
    found = sorted((p for p in paths if p[0] > 0), reverse=True)
    total, above = sum(n for _, n in found), 0
    for (high, n), (low, _) in zip(found, found[1:]):
        above += n
        if above >= UPPER * total and high >= GAP * low:
            return high
    return found[-1][0] if found else math.inf


def chosen_blocks(elements: list[Element], blocks: list[Block], scores: list[float]) -> list[bool]:
    """Blocks whose path's mean score is above the gap, and headings right before such."""
    by: dict[int, list[float]] = {}
    for b, s in zip(blocks, scores, strict=True):
        e = elements[b.element]
        if not e.outside:
            t = by.setdefault(e.path, [0.0, 0, 0])
            t[0] += s
            t[1] += 1
            t[2] += max(0, len(b.text) - b.linked)
    means = {p: s / n for p, (s, n, _) in by.items()}
    least = threshold([(means[p], int(t[2])) for p, t in by.items()])
    out, before = [], False
    for b in reversed(blocks):
        e = elements[b.element]
        if not e.outside:
            before = means[e.path] >= least or before and e.tag in HEADINGS
        out.append(before and not e.outside)
    return out[::-1]


def main_text(page: str | None) -> str:
    elements, blocks = parse(page) if page else ([], [])
    chosen = chosen_blocks(elements, blocks, content_scores(elements, blocks))
    if not any(chosen):
        return ""
    first, last = chosen.index(True), len(chosen) - 1 - chosen[::-1].index(True)
    deepest = common(elements, blocks[first].element, blocks[last].element)  # elements are in page order, so this holds all between
    article = k = deepest
    while article > 0 and elements[article].tag not in ("article", "main"):
        article = elements[article].parent
    while k > 0 and elements[k].tag in TEXT_TAGS:  # what stands beside a text that is all content belongs to it
        k = elements[k].parent
    around = article if article > 0 else k
    branch = branches(elements, around)
    own = {branch[b.element] for b, c in zip(blocks, chosen, strict=True) if c}

    def near(i: int, b: Block) -> bool:
        """A block that isn't content by its path, but part of the text around it."""
        if elements[b.element].outside or b.linked > LINKS * len(b.text):
            return False
        if article > 0:
            return branch[b.element] >= 0
        child = branch[b.element]
        return first < i < last or child >= 0 and (child in own or child == around or elements[child].tag in PARTS)

    return " ".join(b.text for i, (b, c) in enumerate(zip(blocks, chosen, strict=True)) if c or near(i, b))


def branches(elements: list[Element], around: int) -> list[int]:
    """For each element the child of `around` that it is in, around itself, or -1 outside it."""
    out = [-1] * len(elements)
    out[around] = around
    for i in range(around + 1, len(elements)):
        up = out[elements[i].parent]
        out[i] = i if elements[i].parent == around else up
    return out


def common(elements: list[Element], a: int, b: int) -> int:
    """The innermost element around both; parents have smaller numbers."""
    while a != b:
        if a > b:
            a = elements[a].parent
        else:
            b = elements[b].parent
    return a


def extract_pages(pages: DataFrame) -> DataFrame:
    """Main text of each page, row by row, without a shuffle.

    pages needs page_id, url and html; other columns are left out. Null or empty html, and a page without
    text, give an empty text. Every row gives one row, repeated rows and null ids included. White space
    inside a block (Unicode's) becomes one space; blocks stand in page order, one space between. Returns
    page_id, url, text, n_chars.
    """

    def run(page_id, url, source):
        texts = [main_text(h) for h in source]
        return [page_id, url, texts, [len(t) for t in texts]]

    columns = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return map_rows(columns, run, "page_id long, url string, text string, n_chars long", rows=64)


def op5_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
