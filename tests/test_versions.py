"""Edits of a page and the five rules that they must keep."""

import pytest
from pyspark.sql import functions as F

from loomspan.operators import nodes, versions, workflows


def tree(spark, *pages):
    return nodes.parse_html(spark.createDataFrame(list(enumerate(pages, 1)), "page_id long, html string"))


BEFORE = """<body><nav><ul><li><a href="#kept">k</a></li></ul></nav><div id=" kept " style="margin: 8px; padding: 0"><h1>Title</h1></div>
<section id="gone" style="padding:4px"><p>Words here</p><img src="a.png"></section></body>"""


@pytest.mark.parametrize(
    ("edited", "expected"),
    [
        ('<a href="#kept">k</a><div id=" kept "><h1>Title</h1></div>', []),
        ('<a href=" #gone/part ">k</a><b id="kept"></b><a href="#">top</a>', [(versions.ORPHANED, "Anchor points to missing ID: gone")]),
        ('<div style="display: inline-GRID"></div><div style="display:grid">x</div>', [(versions.EMPTY_GRID, "Grid has 0 items, leaving all cells empty.")]),
        ('<div style="display:grid;grid-template-columns:repeat(0, 1fr)">x</div>', [(versions.EMPTY_GRID, "Grid has invalid column count: 0")]),
        ('<p data-section-index="1">a</p><p data-section-index="1">b</p><i data-section-index="x">c</i>', [(versions.ORDERING, "data-section-index values are not contiguous")]),
        ('<div><p style="order:2">a</p><p style="order: 3">b</p></div>', [(versions.ORDERING, "CSS flex/grid orders are not contiguous")]),
        ('<p style="margin:AUTO;padding: 8PX; margin-left:4px">a</p>', []),
        ('<p style="margin:8px; MARGIN: 9px">a</p>', [(versions.OFF_SCALE, "Spacing property 'margin: 9px' falls outside the page scale.")]),
        ('<p data-slot-id="slot_p_2">Words here</p><h1 data-slot-id="slot_h1_1">Title</h1>', [(versions.DANGLING, "Dangling slot_id reference 'slot_p_2' remains in tree.")]),
    ],
)
def test_each_rule(spark, edited, expected):
    before = versions.with_slots(tree(spark, BEFORE.replace("<ul>", "").replace("<li><a href=\"#kept\">k</a></li></ul>", "")))
    removed = before.where("tag = 'section'").select("page_id", "path")
    found = versions.violations(before, tree(spark, f"<body>{edited}</body>"), removed).collect()
    assert [(r.rule, r.detail) for r in found] == expected


def test_slots_are_those_of_the_removed_subtree(spark):
    before = versions.with_slots(tree(spark, BEFORE))
    removed = before.where("tag = 'section'").select("page_id", "path")
    details = {r.detail.split("'")[1] for r in versions.dangling_slots(before, before, removed).collect()}
    inside = {r.v for r in before.where("path like 'root > section%'").select(nodes.attribute(versions.SLOT).alias("v")).collect() if r.v}
    assert details == inside and len(inside) == 2


def test_reflow_sets_numbers_and_styles(spark):
    before = tree(spark, '<body><p data-section-index="3" style="color: red; order:3; background:url(a;b)">x</p><i>y</i></body>')
    rows = [(1, "root > p:nth-child(1)", "data-section-index", "2"), (1, "root > p:nth-child(1)", "order", "2"), (1, "root > i:nth-child(2)", "margin-bottom", "4px"), (1, "root", None, None)]
    out = versions.reflow(before, spark.createDataFrame(rows, "page_id long, path string, prop string, after string"))
    found = {r.tag: {a.k: a.v for a in r.attrs} for r in out.where("tag <> '#text'").collect()}
    assert found == {"body": {}, "p": {"data-section-index": "2", "style": "color: red; background: url(a;b); order: 2"}, "i": {"style": "margin-bottom: 4px"}}


def test_steps_are_planned_and_put_right(spark):
    page = '<body><section data-section-index="1" id="a">a</section><section data-section-index="2" style="margin-bottom:6px">b</section><section data-section-index="3">c</section></body>'
    x = tree(spark, page, page)
    removals = x.where("depth = 1 and (page_id = 1 and child_idx = 1 or child_idx = 2)").select("page_id", F.when(F.col("child_idx") == 1, 1).otherwise(F.col("page_id")).cast("int").alias("step"), "path")
    removals = removals.withColumn("step", F.when((F.col("page_id") == 1) & F.col("path").endswith("(2)"), 2).otherwise(F.col("step")))
    left, done = workflows.remove_sections(x, removals, versions.violations)
    assert sorted(map(tuple, done.collect())) == [(1, 2, True), (2, 1, True)]
    numbers = {(r.page_id, r.path[-2]): r.n for r in left.where("tag = 'section'").select("page_id", "path", nodes.attribute("data-section-index").alias("n")).collect()}
    assert numbers == {(1, "3"): "1", (2, "1"): "1", (2, "3"): "2"}
    styles = {(r.page_id, r.path[-2], r.prop, r.value) for r in versions.inline_styles(left).collect()}
    assert styles == {(2, "1", "margin-bottom", "6px")}
