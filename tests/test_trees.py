"""Golden values on small literal pages."""

import numpy as np
from pyspark.sql import functions as F

from loomspan.operators import markup, nodes, sections, styles
from loomspan.plans.pages import INLINE_TRACKER
from loomspan.plans.rasters import ssim
from loomspan.plans.texts import headings

HERO = '<html><head><title>T</title></head><body><section id="hero"><h1>Big product name</h1><p>It does the thing faster than before.</p><a class="cta" href="/go">Start now</a></section></body></html>'
FAQ = (
    '<body><section class="faq"><h2>Questions</h2><button aria-expanded="false" aria-controls="q1">How much is it?</button><div id="q1"><p>It is nine per month.</p></div>'
    '<button aria-expanded="false" aria-controls="q2">May I stop?</button><div id="q2"><p>At any time you like.</p></div></section></body>'
)
TABS = (
    '<body><div class="tabs"><div role="tablist"><button role="tab" aria-controls="a">One</button><button role="tab" aria-controls="b">Two</button></div>'
    '<div role="tabpanel" id="a"><p>First panel</p></div><div role="tabpanel" id="b"><p>Second panel</p></div></div></body>'
)
SLIDES = '<body><div class="carousel"><div class="slide"><h3>A first</h3><p>Text one.</p></div><div class="slide"><h3>A second</h3><p>Text two.</p></div></div></body>'
MENU = '<body><nav><ul><li><a href="/">Home</a><li class="menu-item-has-children"><a href="/p">Goods</a><ul class="sub-menu"><li><a href="/p/a">Alpha</a></li></ul></li></ul></nav><main><h1>Welcome here</h1></main></body>'
PRICES = '<body><section class="pricing"><h2>Choose</h2>' + "".join(f'<div class="card"><img src="{x}.png" width="120" height="80"><h3>{x}</h3><p>For {x}.</p><a href="/buy/{x}">Buy {x}</a></div>' for x in ("one", "two", "ten")) + "</section></body>"
PAGES = [(1, HERO), (2, FAQ), (3, TABS), (4, SLIDES), (5, MENU), (6, PRICES), (7, None), (8, "")]


def tree(spark):
    return nodes.parse_html(spark.createDataFrame(PAGES, "page_id long, html string"))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_intervals_hold(spark):
    found = rows(tree(spark).select("page_id", "node_id", "parent_id", "subtree_end", "depth"))
    by = {(p, n): (parent, end, depth) for p, n, parent, end, depth in [(r[0], r[1], r[2] if r[2] is not None else -1, r[3], r[4]) for r in sorted(map(lambda r: (r[0], r[1], -1 if r[2] is None else r[2], r[3], r[4]), found))]}
    for (p, n), (parent, end, depth) in by.items():
        assert end >= n
        if parent >= 0:
            assert by[p, parent][0] < n <= by[p, parent][1] and depth == by[p, parent][2] + 1


def test_list_items_close_each_other_and_paths_count_texts(spark):
    x = tree(spark)
    assert x.where("page_id = 5 and tag = 'li' and depth = 3").count() == 2
    assert ("root > nav:nth-child(1) > ul:nth-child(1) > li:nth-child(2)",) in rows(x.where("page_id = 5 and tag = 'li'").select("path"))
    assert rows(x.where("page_id = 1 and tag = 'h1'").select("css_path")) == [("body:nth-of-type(1) > section:nth-of-type(1) > h1:nth-of-type(1)",)]
    assert rows(x.where("page_id = 1 and tag = 'section'").select("css_path")) == [("#hero",)]


def test_field_counts_and_roles(spark):
    found = rows(sections.fields(tree(spark)).groupBy("page_id").agg(F.count("*"), F.min("role")))
    assert found == [(1, 3, "hero"), (2, 5, "faq"), (3, 4, "unknown"), (4, 4, "unknown"), (5, 4, "navigation"), (6, 13, "pricing")]
    labels = {r.slot_id: r.label for r in sections.fields(tree(spark)).where("page_id = 1").collect()}
    assert labels == {"slot_h1_1": "Hero Heading", "slot_p_2": "Hero Text", "slot_a_3": "Hero Link"}


def test_repeats(spark):
    assert rows(sections.repeats(tree(spark)).select("page_id", "instances")) == [(6, 3)]


def test_interactive_parts(spark):
    assert rows(sections.interactive(tree(spark)).groupBy("page_id", "kind").count()) == [(2, "disclosure", 2), (3, "tabs", 1), (4, "carousel", 1), (5, "dropdown", 1)]


def test_removal_takes_menu_entries(spark):
    page = spark.createDataFrame([(1, '<body><nav><ul><li><a href="#x">X</a></li><li><a href="#y">Y</a></li></ul></nav><section id="x"><p>gone</p></section><section id="y"><p>stays</p></section></body>')], "page_id long, html string")
    x = nodes.parse_html(page)
    left = sections.without_sections(x, spark.createDataFrame([(1, "root > section:nth-child(2)")], "page_id long, path string"))
    assert rows(left.where("tag = '#text'").select("text_content")) == [("Y",), ("stays",)]
    assert rows(sections.orphaned_anchors(left)) == []
    assert rows(left.where("depth = 1").select("tag", "child_idx")) == [("nav", 1), ("section", 2)]


def test_substitution_and_round_trip(spark):
    x = tree(spark)
    html = {r.page_id: r.html for r in markup.compile_html(x).collect()}
    assert html[4] == SLIDES.replace("<body>", "<body>")
    again = nodes.parse_html(spark.createDataFrame(list(html.items()), "page_id long, html string"))
    keys = ["page_id", "node_id", "tag", "path", "text_content"]
    assert rows(again.where("page_id < 7").select(*keys).na.fill("")) == rows(x.where("page_id < 7").select(*keys).na.fill(""))
    changed = sections.substitute(x, spark.createDataFrame([(6, "root > section:nth-child(1) > div:nth-child(2) > img:nth-child(1)", "new.png"), (1, "root > section:nth-child(1) > h1:nth-child(1)", "Other")], "page_id long, path string, value string"))
    html = {r.page_id: r.html for r in markup.compile_html(changed).collect()}
    assert 'src="new.png"' in html[6] and "<h1>Other</h1>" in html[1]


def test_cascade_and_inheritance(spark):
    css = "body{color:#111} #box p{color:#222} .k{color:#333;--m: 4px} p{color:#444;margin:var(--m, 2px)} p:hover{color:red} @media (max-width:600px){p{color:#555}} @font-face{font-family:X}"
    page = '<body><div id="box" class="k"><p class="k">one</p><p style="color:#666">two<span>in</span></p></div><p>three</p></body>'
    x = spark.createDataFrame([(1, page, css)], "page_id long, html string, css string")
    tree_ = nodes.parse_html(x)
    matched = styles.match(x)
    won = {(r.node_id, r.prop): r.value for r in styles.cascade(matched).collect()}
    ids = {r.text_content: r.parent_id for r in tree_.where("tag = '#text'").collect()}
    assert won[ids["one"], "color"] == "#222" and won[ids["two"], "color"] == "#666" and won[ids["three"], "color"] == "#444"
    final = {(r.node_id, r.prop): r.value for r in styles.inherit(tree_, styles.cascade(matched)).collect()}
    assert final[ids["in"], "color"] == "#666" and final[ids["one"], "margin"] == "4px" and final[ids["three"], "margin"] == "2px"
    assert {r.state for r in styles.states(matched).collect()} == {":hover"} and styles.responsive(matched).count() == 3


def test_tokens(spark):
    css = "a{color:#333} b{color:#333;background:#fff;font-family:'Inter';font-size:1rem;padding:8px 16px} c{color:rgb(255,0,0);font-size:14px;margin:24px}"
    found = {(r.category, r.key): r.value for r in styles.tokens(styles.parse_css(spark.createDataFrame([(1, css)], "page_id long, css string"))).collect()}
    assert found == {
        ("colors", "primary"): "#333333", ("colors", "secondary"): "#ff0000", ("colors", "background"): "#ffffff", ("typography", "base"): "Inter", ("typography", "size-1"): "14px",
        ("typography", "size-2"): "16px", ("spacing", "xs"): "8px", ("spacing", "sm"): "16px", ("spacing", "md"): "24px",
    }


def test_structural_score(spark):
    pairs = [(1, "<body><div><p>x</p></div></body>", "<body><div><p>y</p></div></body>"), (2, "<body><p></p><div></div></body>", "<body><p></p><b></b><div></div></body>"), (3, "<body><ul><li></li></ul></body>", "<body><table></table><form></form></body>")]
    found = {r.page_id: r.structural_score for r in markup.structural_score(spark.createDataFrame(pairs, "page_id long, original string, other string")).collect()}
    assert found[1] == 100 and 70 < found[2] < 100 and found[3] < 60


def test_sanitize_and_trackers():
    dirty = '<p onclick="x()" style="color:red;width:expression(1)">a<script>1</script><a href="javascript:x">b</a><a href="/ok">c</a></p>'
    assert markup.sanitize(dirty) == '<p style="color:red">a<a>b</a><a href="/ok">c</a></p>'
    page = '<script src="https://www.google-analytics.com/ga.js"></script><script>gtag("x")</script><noscript><img src="https://www.facebook.com/tr?id=1"></noscript><script src="https://nothotjar.com/x.js"></script><a ping="/p" href="/">h</a>'
    html, counts, urls = markup.strip_trackers(page, INLINE_TRACKER)
    assert html == '<script src="https://nothotjar.com/x.js"></script><a href="/">h</a>'
    assert sum(counts.values()) == 4 and len(urls) == 2


def test_ssim_and_headings():
    a = np.arange(64.0).reshape(8, 8)
    assert ssim(a, a) == 100 and ssim(np.zeros((8, 8)), np.full((8, 8), 255.0)) < 20 and np.isnan(ssim(a, a[:4]))
    assert headings(["Jane Doe\nEXPERIENCE\nplain line of text.\n# Marked"]) == [["Jane Doe", "EXPERIENCE", "Marked"]]
