"""Operator 8 end to end: pages whose main text is known because they are made of it."""

import random

import pytest

from waymark.llm import html_extract


def words(seed, n):
    r = random.Random(seed)
    return " ".join(f"w{r.randint(0, 500)}" for _ in range(n))


def texts(spark, pages, host="made"):
    df = spark.createDataFrame([(i, f"https://{host}/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in html_extract.main_texts(df).orderBy("page_id").collect()]


def test_sibling_blocks_are_all_kept(spark):
    blocks = lambda i: [f"Title {i}", words(i, 8), words(i + 100, 60), words(i + 200, 10)]
    page = lambda i: "<body><div class='logo'>The site</div>" + "".join(f"<div class='{c}'><p>{t}</p></div>" for c, t in zip(("t", "intro", "story", "ending"), blocks(i))) + "<div class='foot'><p>All rights</p></div>"
    assert texts(spark, [page(i) for i in range(40)]) == ["\n".join(blocks(i)) for i in range(40)]


@pytest.mark.parametrize("odd", [0, 7, 39])
def test_a_heading_that_differs_on_one_page_is_kept_there(spark, odd):
    heading = lambda i: "What the river took" if i == odd else "Summary"
    page = lambda i: f"<body><div class='x'><h2>{heading(i)}</h2><p>{words(i, 40)}</p></div>"
    got = texts(spark, [page(i) for i in range(40)])
    assert got == [("What the river took\n" if i == odd else "") + words(i, 40) for i in range(40)]


def test_a_constant_paragraph_beside_varying_ones_goes(spark):
    sign = "<p>Sign up for our letter and never miss a story</p>"
    parts = lambda i: [f"<p>{words(100 * i + k, 15)}</p>" for k in range(2 + i % 4)]

    def page(i):
        own = parts(i)
        own.insert(i % (len(own) + 1), sign)
        return "<body><div class='x'>" + "".join(own) + "</div>"

    assert texts(spark, [page(i) for i in range(40)]) == ["\n".join(words(100 * i + k, 15) for k in range(2 + i % 4)) for i in range(40)]


def test_a_long_rail_does_not_replace_the_story(spark):
    page = lambda i: f"<body><div class='story'><p>{words(i, 20)}</p></div><div class='rail'><p>{words(i + 99, 90)}</p></div>"
    assert texts(spark, [page(i) for i in range(40)]) == [words(i, 20) for i in range(40)]


PARTS = ["comments", "comment-list", "comments-area", "user-comments", "related-posts", "ad-slot", "ad-container", "sidebar-left", "cookie-bar", "share-buttons", "newsletter-box", "post-navigation", "social-links", "page-footer", "recommended-stories"]
KEPT = ["entry-header", "post-title", "has-sidebar", "content-area", "story-body", "article-section", "main-column", "address", "adept", "shared-memory", "menu-less", "page-wrapper", "text-block"]


def test_parts_inside_an_article_are_known_by_compound_names():
    page = lambda name: f"<article><h1>T</h1><p>a</p><div class='{name}'><p>x</p></div></article>"
    assert [n for n in PARTS if html_extract.extract(page(n)) != "T\na"] == []
    assert [n for n in KEPT if html_extract.extract(page(n)) != "T\na\nx"] == []


@pytest.mark.parametrize("seed", range(4))
def test_made_pages_come_out_as_they_were_made(spark, seed):
    """Blocks of content and of template, shuffled, nested and repeated, with and without an article."""
    r = random.Random(seed)
    article = seed % 2 == 0
    order = r.sample(range(6), 6)
    pages, want = [], []
    for i in range(50):
        content = [[words(r.random(), r.randint(5, 30)) for _ in range(r.randint(1, 5))] for _ in range(3)]
        heads = [f"Head {words(r.random(), 3)}" for _ in range(3)]
        body, kept = [], []
        for k in order:
            if k < 3:
                inner = "".join(f"<p>{t}</p>" for t in content[k])
                body.append(f"<section class='s{'abc'[k]}'><h3>{heads[k]}</h3><div>{inner}</div></section>")
                kept += [heads[k], *content[k]]
            elif k == 3:
                body.append("<div class='q'><p>Constant words of this site</p><p>that stand on every page of it</p></div>")
            elif k == 4:
                body.append(f"<div class='comments-area'><p>{words(r.random(), 40)}</p></div>")
            else:
                body.append(f"<ul class='m'><li>Home of it all</li><li>Visitor number {i}</li></ul>")
        inner = "".join(body)
        if article:
            inner = inner.replace(f"<li>Visitor number {i}</li>", "")
        pages.append("<html><body><div class='top'>Name of the site</div>" + (f"<article>{inner}</article><p>{words(r.random(), 3)}</p>" if article else inner) + "<footer>f</footer>")
        want.append("\n".join(kept))
    copies = [pages[0]] * 30  # a large group of equal pages
    got = texts(spark, pages + copies)
    assert got == want + [want[0]] * 30


def test_near_copies_are_no_template(spark):
    story = [words(k, 30) for k in range(8)]
    page = lambda i: "<body><div class='x'>" + "".join(f"<p>{t if k != i % 8 else words(1000 + i, 30)}</p>" for k, t in enumerate(story)) + "</div>"
    want = ["\n".join(t if k != i % 8 else words(1000 + i, 30) for k, t in enumerate(story)) for i in range(40)]
    assert texts(spark, [page(i) for i in range(40)]) == want
