"""Main text: densities against a naive recomputation, awkward names and wrappers, hostile pages, odd tables."""

import random
import time
from math import e, log

import pytest

from trajlens.llm import text_density

STORY = " ".join(f"Sentence number {n} of the story has quite a few words in it." for n in range(12))
NOISE = "This part says very much as well. " * 60


def main(body):
    return text_density.main_text(f"<html><body>{body}</body></html>")


def test_names_raise_doubts_that_the_page_must_bear_out():
    assert main(f'<div class="article sponsored"><h1>Head</h1><p>{STORY}</p></div>') == f"Head {STORY}"
    assert main(f"<article><header><h1>Head</h1></header><p>{STORY}</p></article>") == f"Head {STORY}"
    assert main(f"<header><h1>Site</h1></header><article><p>{STORY}</p></article>") == STORY
    for given in ("id=comments", "class='reader-comments'", "id=disqus"):
        comments = "".join(f"<p>{NOISE}</p>" for _ in range(5))
        assert main(f"<article><h1>Head</h1><p>{STORY}</p></article><div {given}><h1>Replies</h1>{comments}</div>") == f"Head {STORY}"
        assert main(f"<div><p>{STORY}</p></div><div {given}>{comments}</div>") == STORY
    assert main(f"<article><p>{STORY}</p><p class=notice>{NOISE}</p><p>{STORY}</p></article>") == f"{STORY} {STORY}"
    assert main(f"<div class=ad>{NOISE}</div><article><p>{STORY}</p></article>") == STORY
    # With nothing else on the page, doubts do not count.
    assert main(f"<div class=notice><p>{STORY}</p></div>") == STORY


@pytest.mark.parametrize("page", [
    "<a " * 300_000, "<a \"' " * 150_000, "<div>" * 100_000 + "</p>" * 100_000, "<i>" * 200_000, "<title " * 100_000, "<! " * 300_000,
    "<p><i>" * 100_000, "<li>x" * 150_000, '<a "' * 200_000 + "'", "<!--" * 200_000, "</script   " * 80_000, "<script " * 100_000,
    "<td><p>" * 100_000, "<b></b>" * 100_000, "&lt;" * 200_000, "<p a=" * 150_000, "<p x x=\"y\" " * 80_000 + ">",
])
def test_hostile_pages_take_linear_time(page):
    start = time.perf_counter()
    text_density.main_text(page)
    assert time.perf_counter() - start < 8


def naive(node, body):
    """Characters, tags, and those in links, counted afresh for every node; density by the formula of the module."""
    def count(n):
        c = t = lc = lt = 0
        for child in n.children:
            if isinstance(child, str):
                size = len("".join(child.split()))
                c, lc = c + size, lc + size * n.link
            else:
                a, b, d, f = count(child)
                c, t, lc, lt = c + a, t + b + 1, lc + d, lt + f + (child.tag == "a")
        return c, t, lc, lt

    c, t, lc, lt = count(node)
    body_c, _, body_lc, _ = count(body)
    if not c:
        return 0.0
    rest = max(c - lc, 1)
    t, lc, lt = max(t, 1), max(lc, 1), max(lt, 1)
    base = log(c / rest * lc + max(body_lc, 1) / max(body_c, 1) * c + e)
    return c / t * log(max(c / lc * t / lt, 1.0)) / log(max(base, 1.0001)) if base > 1 else 0.0


def in_line(node):
    return node.tag in ("a", "span", "b") and all(isinstance(child, str) or in_line(child) for child in node.children)


def test_densities_against_a_naive_count():
    draw = random.Random(11)

    def tree(depth):
        if depth == 0 or draw.random() < 0.3:
            return "word " * draw.randrange(0, 12)
        tag = draw.choice(["div", "p", "a", "span", "section", "b"])
        return f"<{tag}>{''.join(tree(depth - 1) for _ in range(draw.randrange(1, 4)))}</{tag}>"

    for _ in range(40):
        root, nodes = text_density.parse(f"<body>{''.join(tree(4) for _ in range(3))}</body>")
        body = text_density._rate(root, nodes)
        for node in nodes:
            assert abs(node.density - naive(node, body)) < 1e-9
            inner = [child for child in node.children if not isinstance(child, str) and not in_line(child)]
            total = sum(naive(child, body) for child in inner) or node.density
            assert abs(node.total - total) < 1e-9
        assert abs(body.best.total - max(n.total for n in nodes if (n is not root or body is root) and not in_line(n))) < 1e-9


def test_headline_of_a_short_article_stays():
    page = f"<nav><a href=x>one</a></nav><article><h1>Head line</h1><p><b>{STORY}<br></p></article><footer>end of page</footer>"
    assert main(page) == f"Head line {STORY}"


def test_extract_keeps_every_row(spark):
    schema = "page_id long, url string, html string, id int, text string, n_chars int"
    rows = [(1, "u", f"<article><p>{STORY}</article>", 1, "x", 2), (1, "u", f"<article><p>{STORY}</article>", 1, "x", 2), (None, None, None, None, None, None),
            (2, "v", "", 1, "x", 2), (3, "w", "<nav>menu</nav>", 1, "x", 2)]
    pages = spark.createDataFrame(rows, schema)
    found = sorted((tuple(row) for row in text_density.extract(pages).collect()), key=str)
    assert found == sorted([(1, "u", STORY, len(STORY))] * 2 + [(None, None, "", 0), (2, "v", "", 0), (3, "w", "", 0)], key=str)
    assert text_density.extract(pages.limit(0)).count() == 0
