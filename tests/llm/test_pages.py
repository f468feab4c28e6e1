"""Main text of pages: layouts, what marks and ratios decide, and time."""

import math
import re
import time
from html.parser import HTMLParser

import pytest

from brindle.llm import html

SENTENCE = "One sentence, and some more words here; then an end. "
BODY = "<h1>Title</h1>" + "".join(f"<p>{SENTENCE * k}</p>" for k in (3, 2, 4, 1, 3))
COMMENTS = f'<div class="comments"><p>{SENTENCE * 5}</p><p>{SENTENCE * 3}</p></div>'


def text_of(source):
    return " ".join(re.sub("<[^>]*>", " ", source).split())


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="content no-sidebar">{BODY}</div>', f'<div class="layout right-sidebar">{BODY}<div class="sidebar"><p>{SENTENCE}</p></div></div>', f'<div class="two-side content">{BODY}</div>',
        f'<div class="legal-text">{BODY}</div>', BODY.replace("<p>", '<p class="search-term">'), f'<form id="aspnetForm">{BODY}{COMMENTS}</form>', f'<form><nav><a>x</a></nav><div class="main">{BODY}</div><div id=footer>{SENTENCE}</div></form>',
        f"<div>{BODY}</div>{COMMENTS * 3}", f'<div class="has-sidebar"><div>{BODY}</div><aside><p>{SENTENCE}</p></aside></div>', f'<div id="page" class="widget"><article>{BODY}</article></div>',
    ],
)
def test_wrappers_keep_their_article(page):
    assert html.main_text(f"<body><nav>Menu a b</nav>{page}<footer>End of it.</footer>") == text_of(BODY)


def test_boxes_go():
    """What marks tell goes where an article stands beside it, however much text it has."""
    for box in ('<div class="sidebar">', '<div class="cookie-notice">', '<div class="related">', '<form>', '<div class="ad">', '<div id="disclaimer">', '<aside>', '<div role="search">', '<div style="display: none">', '<section class="reader-comments">'):
        name = box[1:].split()[0].rstrip(">")
        for times in (1, 30):
            page = f"<body>{box}<p>{SENTENCE * times}</p></{name}><main>{BODY}</main>{box}<p>{SENTENCE}</p></{name}></body>"
            assert html.main_text(page) == text_of(BODY), (box, times)
    assert html.main_text(f'<div class="ad">{SENTENCE}</div><nav>{SENTENCE}</nav><footer>{SENTENCE}</footer>') == ""


def test_blog_page():
    article = f'<h1>A title</h1><p class="byline">By someone, today</p>{BODY[15:]}<figure><img src=x><figcaption>A figure.</figcaption></figure><h2>More</h2><ul><li>First</li><li>Second</li></ul><blockquote>Quoted, words.</blockquote><table><tr><td>1</td><td>2</td></tr></table><pre>x = 1</pre>'
    page = f"""<html><head><title>A title</title></head><body class="single has-sidebar"><div id="wrapper"><header><a href=/>Site</a><p>Tagline, of it.</p></header>
    <ul class="menu"><li><a href=/a>A</a><li><a href=/b>B</a></ul><div class="breadcrumbs">Home &gt; Here</div><div id="main" class="main-content"><article class="post">{article}
    <div class="share-buttons">Share this, please. <a>x</a></div><div class="related-posts"><h3>Related</h3><p><a href=/c>{SENTENCE}</a></p></div></article>
    <div id="comments">{COMMENTS}<form><label>Name</label><textarea>x</textarea><p>{SENTENCE}</p></form></div></div>
    <div id="sidebar"><div class="widget"><p>{SENTENCE * 3}</p></div></div><div class="footer">{SENTENCE}</div></div><script>var x = "<p>{SENTENCE}</p>";</script></body></html>"""
    assert html.main_text(page) == text_of(article)


def test_formulas_stay():
    assert html.main_text("<article><p>Let <math><mi>x</mi><mo>+</mo><mi>y</mi><annotation>x+y</annotation></math> be a number, here.</p></article>") == "Let x+y be a number, here."


class PlainBlocks(HTMLParser):
    """Blocks of a well-formed page without marks: path and text."""

    def __init__(self, page):
        super().__init__()
        self.path, self.blocks = [], []
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.path.append(tag)

    def handle_endtag(self, tag):
        self.path.pop()

    def handle_data(self, data):
        if data.strip():
            self.blocks.append(("/".join(self.path), " ".join(data.split())))


def plain_choice(page):
    """Texts of the blocks whose path is content, by plain sums and a plain search for the gap."""
    blocks = PlainBlocks(page).blocks
    paths = {p for p, _ in blocks}
    ratio = {p: [sum(f(t) for q, t in blocks if q == p) / sum(q == p for q, _ in blocks) for f in (len, lambda t: len(re.findall("[.,;:!?]", t)))] for p in paths}

    def smooth(i, k):
        near = range(max(0, k - 2), min(len(blocks), k + 3))
        weights = [math.exp(-((j - k) ** 2) / 2) for j in near]
        return sum(w * ratio[blocks[j][0]][i] for w, j in zip(weights, near, strict=True)) / sum(weights)

    scores = [math.sqrt(smooth(0, k) * (1 + smooth(1, k))) for k in range(len(blocks))]
    mean = {p: sum(s for s, (q, _) in zip(scores, blocks, strict=True) if q == p) / sum(q == p for q, _ in blocks) for p in paths}
    size = {p: sum(len(t) for q, t in blocks if q == p) for p in paths}
    order = sorted(paths, key=lambda p: (-mean[p], -size[p]))
    upper = next((order[:k] for k in range(1, len(order)) if sum(size[p] for p in order[:k]) >= 0.75 * sum(size.values()) and mean[order[k - 1]] >= 1.6 * mean[order[k]]), order)
    return [p in upper for p, _ in blocks], [t for _, t in blocks]


@pytest.mark.parametrize(
    "page",
    [
        f"<body><ul>{'<li>Go on</li>' * 8}</ul><div>{BODY}<div>small</div></div>{'<section>Small print</section>' * 5}</body>", f"<body><div>{BODY}</div><section>{BODY}</section></body>",
        f"<body><dl>{'<dt>A</dt><dd>B c, d.</dd>' * 9}</dl></body>", f"<body><div>{SENTENCE}</div><div><span>{SENTENCE * 9}</span></div><ul><li>{SENTENCE}</li></ul></body>".replace("span", "pre"),
    ],
)
def test_choice_of_paths(page):
    elements, blocks = html.parse(page)
    found = html.chosen_blocks(elements, blocks, html.content_scores(elements, blocks))
    content, texts = plain_choice(page)
    assert [b.text for b in blocks] == texts
    for k in reversed(range(len(content))):  # headings right before content come along
        content[k] = content[k] or elements[blocks[k].element].tag in ("h1", "h2") and k + 1 < len(content) and content[k + 1]
    assert found == content


def test_ratios_alone():
    """Without any mark the ratios find the article among menus and small print, and constant ratios don't."""
    menu = "".join(f"<li><a href=/{k}>Item {k}</a></li>" for k in range(9))
    page = f"<body><div><ul>{menu}</ul></div><div>Buy it now, please.</div><div>{BODY}</div><div>&copy; host. All of it.</div></body>"
    assert html.main_text(page) == text_of(BODY)
    elements, blocks = html.parse(page)
    assert html.chosen_blocks(elements, blocks, [1.0] * len(blocks)) != html.chosen_blocks(elements, blocks, html.content_scores(elements, blocks))


@pytest.mark.parametrize("piece", ["<x>word, and more. ", "<form><p>word, and more. ", "<div class=legal>word, and more. ", "<p><div>word, and more. ", "<li><ul>word. "])
def test_nested_pages_take_linear_time(piece):
    def took(size):
        page = piece * (size // len(piece))
        began = time.process_time()
        html.main_text(page)
        return time.process_time() - began

    took(20_000)
    small, large = took(250_000), took(2_000_000)
    assert large < 30 * max(small, 0.1)
