"""Palettes on pages, and templates of components."""

from loomspan.operators import brand, nodes
from loomspan.plans.values import BLOCK, INLINE

PALETTE = "page_id long, role string, color string"


def test_values_keep_their_notation(spark):
    page = '<body><p style="color:#F00;background:rgb(1, 2, 3)">a</p><p style="color: red; top:0">b</p><i style="border:1px solid #f00">c</i></body>'
    x = nodes.parse_html(spark.createDataFrame([(1, page), (2, page)], "page_id long, html string"))
    old = spark.createDataFrame([(1, "primary", "#ff0000"), (1, "accent", "rgba(1,2,3,1)"), (1, "none", "red")], PALETTE)
    new = spark.createDataFrame([(1, "primary", "rgb(0,16,255)"), (1, "accent", "#0a0b0c"), (1, "none", "#000000")], PALETTE)
    out = brand.restyle(x, brand.remap(old, new))
    found = {(r.page_id, r.tag, r.child_idx): {a.k: a.v for a in r.attrs}["style"] for r in out.where("tag in ('p', 'i')").collect()}
    assert found == {
        (1, "p", 1): "color: #0010ff; background: rgb(10, 11, 12)", (1, "p", 2): "color: red; top:0", (1, "i", 3): "border:1px solid #f00",
        (2, "p", 1): "color:#F00;background:rgb(1, 2, 3)", (2, "p", 2): "color: red; top:0", (2, "i", 3): "border:1px solid #f00",
    }


def test_of_roles_with_one_colour_the_last_counts(spark):
    old = spark.createDataFrame([(1, "a", "#111111"), (1, "b", "#111")], PALETTE)
    new = spark.createDataFrame([(1, "a", "#222222"), (1, "b", "#333333")], PALETTE)
    assert [tuple(r) for r in brand.remap(old, new).collect()] == [(1, "#111111", "#333333")]


def test_compose(spark):
    rows = [
        (1, 0, "a", "s", "div", "<p>x</p>"), (1, 1, "a", "s", "span", "<b>x</b><UL>"), (1, 2, None, None, None, None), (1, 3, "a", None, "em", "plain"), (1, 4, "s_a", "t", "EM", "< P>"), (1, 5, "component_2", "", "p", ""), (2, 0, "a", None, "i", "<section>"),
    ]
    x = spark.createDataFrame(rows, "template_id long, place int, id string, source string, tag string, content string")
    out = {r.template_id: (r.component_count, r.ids, r.errors) for r in brand.compose(x, INLINE, BLOCK).collect()}
    assert out == {
        1: (6, ["a", "s_a", "component_2", "a_3", "t_s_a", "component_2_5"], ["Invalid HTML nesting: <ul> inside <span> (component 's_a')", "Invalid HTML nesting: <p> inside <em> (component 't_s_a')"]),
        2: (1, ["a"], ["Invalid HTML nesting: <section> inside <i> (component 'a')"]),
    }
