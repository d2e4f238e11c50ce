"""Main text of pages whose names mislead, whose comments have no name, and of the synthetic pages under other names."""

import hashlib
import re
import tracemalloc
from collections import Counter

import pyarrow.parquet as pq
import pytest

from loomspan.llm import html_extract as h
from tests.conftest import SF

P = ["The first paragraph of the story has some twelve words in it.", "A second one goes on about the same matter at length.", "The third closes it with a remark on all that."]
PROSE = "".join(f"<p>{p}</p>" for p in P)
TEXT = " ".join(P)
SIDE = "<ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul>"


@pytest.mark.parametrize(
    "page",
    [
        f'<body><nav>{SIDE}</nav><div class="content has-sidebar">{PROSE}</div><div class="sidebar">{SIDE}<p>Popular now</p></div></body>',
        f'<main><div class="long-form">{PROSE}</div></main>',
        f'<main><div class="col social-science">{PROSE}</div></main>',
        f'<div class="post related-posts-on">{PROSE}</div><div class="related-posts"><p>Read this too</p></div>',
        f'<form id="aspnetForm"><input name=q>{PROSE}<input type=submit></form>',
        f'<div><section title="the hidden valley">{PROSE}</section></div>',
        f'<article class="post comments-open">{PROSE}</article>',
        f'<article><h2 id="search"></h2>{PROSE}<section id="share-prices"></section></article>',
        f'<div class="sidebar">{PROSE}</div>',
        f'<main>{PROSE}<p hidden>not shown</p><p style="display: none">nor this</p><p aria-hidden=true>nor that</p></main>',
        f'<main><article>{PROSE}<aside>aside</aside><div class="ad-slot">Buy this now</div><div class="cookieNotice">We use cookies</div></article></main>',
        f'<main>{PROSE}<div role="complementary">more</div><div class="newsletter-signup">Sign up today</div></main>',
        f"<table><tr><td>{SIDE}<td>{PROSE}</table>",
    ],
)
def test_no_name_empties_a_page(page):
    assert h.main_text(page) == TEXT


def test_a_teaser_does_not_take_the_place_of_the_text():
    assert h.main_text(f"<div>{PROSE}</div><article><p>A teaser.</p></article>").startswith(TEXT)


COMMENT = "<p>I disagree with all of this, and so do many others that I know.</p>"


@pytest.mark.parametrize(
    "comments",
    [
        f"<section><h3>Comments</h3>{COMMENT}{COMMENT}</section>",
        f"<section><h2>3 comments</h2><div>{COMMENT}</div></section>",
        f"<h3>Kommentare (2)</h3>{COMMENT}{COMMENT}",
        f"<section><div><b>Anna</b>{COMMENT}<p><a href=#>Reply</a></p></div><div>{COMMENT}<p><a href=#>Reply</a></p></div></section>",
        f'<div id="comments">{COMMENT}</div>',
        f'<ol class="comment-list"><li>{COMMENT}</ol>',
        f"<article>{COMMENT}</article>",
        f"<section><h3>Leave a reply</h3>{COMMENT}</section>",
    ],
)
@pytest.mark.parametrize("page", ["<body><main>{}{}</main></body>", "<body><main><article>{}{}</article></main></body>", "<body><article>{}</article>{}</body>", "<body><div>{}{}</div></body>"])
def test_comments_without_a_name_go(page, comments):
    if "<article>" in comments and page.count("article") < 2 and "main" not in page:
        comments = comments.replace("<article>", "<article class=comment>")
    if comments.startswith("<article>") and "<article>" not in page:
        comments = comments.replace("<article>", "<article class=comment>")
    assert h.main_text(page.format(PROSE, comments)) == TEXT


def test_a_section_beside_the_one_article_of_main_goes():
    assert h.main_text(f"<main><article>{PROSE}</article><section>{COMMENT}</section></main>") == TEXT


def test_what_stands_after_a_comments_heading_may_be_article_again():
    page = f"<article><p>{P[0]}</p><h2>Comments</h2>{COMMENT}<h2>Sources</h2><p>{P[1]}</p></article>"
    assert h.main_text(page) == f"{P[0]} Sources {P[1]}"


def test_a_page_that_has_nothing_but_comments_keeps_them():
    assert h.main_text(f"<div class=comments>{COMMENT}</div>").startswith("I disagree")


def learned(pages):
    inside, outside = Counter(), Counter()
    for page in pages:
        if found := h.count_classes(page):
            inside.update(found[0])
            outside.update(found[1])
    return h.learn_weights(inside, outside)


def hashed(page):
    return re.sub(r'class="(\w+)"', lambda m: 'class="k' + re.sub(r"\d", "z", hashlib.md5(m[1].encode()).hexdigest()[:8]) + '"', page)


def overlap(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return 2 * (a & b).total() / max(1, a.total() + b.total())


def test_weights_are_learned_and_matter():
    pages = [r["html"] or "" for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()]
    truth = [" ".join(h.html.unescape(re.sub(r"<[^>]*>", " ", m[1])).split()) if (m := re.search("<article>(.*?)</article>", p, re.S)) else "" for p in pages]
    weights = learned(map(hashed, pages))
    bare = [re.sub(r"(</?)article>", r"\1div>", hashed(p)) for p in pages]  # neither names nor an article to go by
    flat = h.Weights({}, names={})
    scores = [sum(overlap(h.main_text(p, w).replace(" ", ""), t.replace(" ", "")) for p, t in zip(bare, truth)) / len(pages) for w in (weights, flat)]
    same = lambda w: sum(h.main_text(p, w).replace(" ", "") == t.replace(" ", "") for p, t in zip(bare, truth))
    assert same(weights) == len(pages) > same(flat) and scores[0] == 1.0
    assert all(h.main_text(hashed(p), weights).replace(" ", "") == t.replace(" ", "") for p, t in zip(pages, truth))


def test_the_run_decides_what_the_text_is(monkeypatch):
    pages = [r["html"] or "" for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()]
    texts = [h.main_text(p) for p in pages]
    monkeypatch.setattr(h, "best_run", lambda found, *_: (0, len(found) - 1))
    assert sum(a != h.main_text(p) for a, p in zip(texts, pages)) > 0.9 * len(pages)


def test_a_short_article_loses_its_long_comments():
    comments = "".join(f"<p>{i} words of a reader who goes on and on about it all</p>" for i in range(15))
    for page in ("<article><p>Four words and out</p></article><section class=comments>{}</section>", "<main><p>Four words and out</p><section class=comments>{}</section></main>", "<div><p>Four words and out</p><div id=comments>{}</div></div>"):
        assert h.main_text(f"<body>{page.format(comments)}</body>") == "Four words and out"
    long_head = f"<article><p>Four words and out</p><h3>Comments {'so many ' * 20}</h3></article>"
    assert h.main_text(long_head).startswith("Four words and out")


def test_footers_and_menus_of_short_pages_go():
    assert h.main_text("<div><p>Short text.</p></div><footer>Some longer words of the owner of the site.</footer>") == "Short text."
    assert h.main_text("<nav><p>Nothing but a menu on this page</p></nav>") == ""


def test_a_last_tag_that_is_cut_off_is_no_text():
    for tag in ('<a b="ccc', "<a href='x y", "<a b", "<p class=\"a\" id=\"b"):
        assert h.main_text(f"<p>{P[0]}</p>{tag}") == P[0]


def test_ties_go_to_the_first_run():
    assert h.main_text("<div><p>one two three</p></div>" + "<hr>" * 60 + "<div><p>four five six</p></div>") == "one two three"


def test_dips_inside_a_run_go_and_long_ones_do_not_cut_it():
    comments = "<div class=comments>" + "<p>words of readers</p>" * 200 + "</div>"
    assert h.main_text(f"<article><p>{P[0]}</p>{comments}<aside>Also</aside><p>{P[1]}</p></article>") == f"{P[0]} {P[1]}"


def test_deep_nesting_takes_memory_in_proportion():
    tracemalloc.start()
    deep = "<div class=a>" * 50_000 + "down here" + "</div>" * 50_000
    assert h.main_text(deep) == "down here"
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
    unclosed = "".join(f"<div id=n{i}><p>word " for i in range(30_000))
    assert len(h.main_text(unclosed)) == 5 * 30_000 - 1


def test_learning_of_pages(spark):
    named = [(i, f"<body><div class='zz{i}'><p>Words of a box that is found on all pages.</p></div><main>{PROSE}</main></body>".replace(f"zz{i}", "zz")) for i in range(5)]
    weights = h.learn(spark.createDataFrame([(i, p.replace("first", f"first{i}"), "x") for i, p in named], "page_id long, html string, hash string"))
    assert weights.name("zz") == -3.0
    assert h.main_text(f"<body><div class=zz><p>Any words at all here.</p></div><div>{PROSE}</div></body>", weights) == TEXT
    assert h.learn(spark.createDataFrame([(1, "<p>none"), (2, None)], "page_id long, html string")) == h.DEFAULT


def test_repeated_pages_and_long_ones(spark):
    rows = [(1, "u", f"<main>{PROSE}</main>")] * 2 + [(2, None, "<div>" * 3000 + "deep" + "</div>" * 3000), (None, "v", "<p>" + "word " * 300_000)]
    out = h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in out) == [(0, 1_499_999), (1, len(TEXT)), (1, len(TEXT)), (2, 4)]
