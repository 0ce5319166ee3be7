"""HTML extraction: the tree score against a plain reading, hard markup, cost of hostile pages."""

from __future__ import annotations

import random
import time

import pytest

from chromaloom.llm import html_extract as h

T = "Some sentence, with commas, and words enough to count, really it is."


@pytest.mark.parametrize(
    "page,want",
    [
        (f'<article><p title="the hidden valley">{T}</p><p data-hidden="false">more</p></article>', [T, "more"]),
        (f'<article><p data-id="related">{T}</p><div data-role="search">more</div></article>', [T, "more"]),
        (f"<article><p class=it's>{T}</p><p>don't go</p><p>it's so</p></article>", [T, "don't go", "it's so"]),
        (f'<article><p>{T}</p><svg class="i"/><p>more</p><math/><p>end</p></article>', [T, "more", "end"]),
        (f'<article><header class="entry-header"><h1>Title</h1><p>by me</p></header><p>{T}</p></article>', ["Title", T]),
        (f'<article><p id="search">{T}</p><p class="text-header">more</p><h2 class=share>sub</h2></article>', [T, "more", "sub"]),
        (f"<body><div class=top><h1>Title</h1></div><div class=c><p>{T}</p><p>more</p></div></body>", ["Title", T, "more"]),
        (f"<body><header><h1>Site</h1></header><div><p>{T}</p></div></body>", [T]),
        (f'<body><div class="post has-sidebar"><p>{T}</p></div><div class=sidebar><p>{T}</p></div></body>', [T]),
        (f'<article class=post><p>{T}</p><section class="post-comments"><p>nice, very, nice</p></section></article><article class=comment><p>{T}</p></article>', [T]),
        (f"<article><p>{T}</p><p class=ad>buy</p><p hidden>no</p><p style='display: none'>no</p><title>open <p>end</article>", [T, "open", "end"]),
        (f"<article><p>a &lt;b&gt; &amp;amp; &#x41;<p>{T}</article>", ["a <b> &amp; A", T]),
        ("<p a='>' b=\">\">x</p>", ["x"]),
    ],
)
def test_hard_markup(page, want):
    assert h.main_text(page) == "\n\n".join(want)


def plain_score(root, blocks):
    """Scores by walking from every block to the root; densities by looking at every block below."""
    got, order = {}, []
    for b in blocks:
        chain, node = [], b.owner
        while node is not None:
            if node.tag in h.CONTAINERS:
                chain.append(node)
            node = node.parent
        points = 0 if b.heading else 1 + sum(b.text.count(c) for c in ",、，") + min(len(b.text) / 100, 3)
        for node, share in zip(chain, (1, 0.5, 1 / 6, 1 / 9)):
            if node not in got:
                order.append(node)
                got[node] = {"article": 30, "main": 25, "section": 3, "div": 5, "blockquote": 3, "td": 1}.get(node.tag, 0) + 15 * any(w in h.LIKELY for w in node.names.lower().replace("-", " ").split())
            got[node] += points * share
    for node in got:
        below = [b for b in blocks if _under(b.owner, node)]
        total = sum(len(b.text) for b in below)
        got[node] *= 1 - sum(b.linked for b in below) / total if total else 1
    return [(n, got[n]) for n in order]


def _under(node, top):
    while node is not None:
        if node is top:
            return True
        node = node.parent
    return False


def test_scores_equal_a_plain_reading():
    rng = random.Random(4)
    for _ in range(300):
        bits = []
        for _ in range(rng.randrange(3, 40)):
            tag = rng.choice(["div", "p", "section", "article", "b", "a", "h2", "li", "ul", "td", "blockquote", "span"])
            name = rng.choice(["", "", ' class="content"', ' class="entry-x y"', ' id="z"'])
            bits.append(rng.choice([f"<{tag}{name}>", f"</{tag}>", "word, word and word ", "x" * rng.randrange(1, 200), "a, b, c、d"]))
        root = h.parse("".join(bits))
        blocks = h.blocks_of(root)
        want = plain_score(root, blocks)
        got = h.scores(blocks)
        assert [n for n, _ in want] == got and all(n.score == pytest.approx(s) for n, s in want)


@pytest.mark.parametrize("page", ["<div>" * 8000 + "<p>a, b</p>" * 8000, "<b>" * 40000 + "</i></div>" * 8000 + "x", "<b>" * 20000 + "<div>x</div>" * 20000, "<div>" * 8000 + "<li>x" * 8000, "<p " + "a " * 200000, "<table><tr><td><b>" + "<i>" * 20000 + "</b>" * 20000, '<a href="x>' * 20001, "<title>" * 20000 + "<noscript>" * 20000 + "hello"])
def test_hostile_pages_are_cheap(page):
    began = time.perf_counter()
    h.main_text(page)
    assert time.perf_counter() - began < 5
