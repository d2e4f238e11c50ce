"""Compiled markup: shadow roots, injected values, classes and style objects."""

from pyspark.sql import functions as F

from loomspan.operators import markup, nodes, sections, versions


def tree(spark, *pages):
    return nodes.parse_html(spark.createDataFrame(list(enumerate(pages, 1)), "page_id long, html string"))


def with_shadow(spark, page, shadow, host):
    return sections.attach_shadows(tree(spark, page), tree(spark, shadow).withColumn("host", F.lit(host)))


def test_shadow_pages_round_trip(spark):
    page, shadow = "<body><p>light <b>text</b></p><div id=\"h\"><i>own</i></div></body>", "<body><h2>In</h2><ul><li>a</li><li>b</li></ul></body>"
    html = markup.compile_html(with_shadow(spark, page, shadow, "#h")).first().html
    assert html == '<body><p>light<b>text</b></p><div id="h"><template shadowrootmode="open"><h2>In</h2><ul><li>a</li><li>b</li></ul></template><i>own</i></div></body>'
    start, rest = html.split('<template shadowrootmode="open">')
    inner, end = rest.split("</template>")
    again = with_shadow(spark, start + end, f"<body>{inner}</body>", "#h")
    assert markup.compile_html(again).first().html == html
    keys = ["host_id", "node_id", "parent_id", "tag", "text_content"]
    assert sorted(map(repr, again.select(*keys).collect())) == sorted(map(repr, with_shadow(spark, page, shadow, "#h").select(*keys).collect()))


def test_shadow_roots_in_components_are_static_text(spark):
    jsx = markup.compile_jsx(with_shadow(spark, '<body><div id="h">x</div></body>', "<body><p>`${a}` \\ b</p></body>", "#h")).first().jsx
    assert '<div id="h"><template shadowrootmode="open" dangerouslySetInnerHTML={{ __html: `<p>\\`\\${a}\\` \\\\ b</p>` }} />{"x"}</div>' in jsx


def test_values_go_into_slots_by_their_ids(spark):
    page = '<body><h1>Old title</h1><p>First words</p><img src="a.png"></body>'
    values = spark.createDataFrame([(1, "slot_h1_1", "New"), (1, "slot_img_3", "b.png"), (1, "slot_p_9", "nowhere"), (2, "mine", "New")], "page_id long, slot_id string, value string")
    x = tree(spark, page, '<body><p data-slot-id="mine">Old</p><p>stays</p></body>')
    html = {r.page_id: r.html for r in markup.compile_html(markup.inject(x, values)).collect()}
    assert html == {1: '<body><h1>New</h1><p>First words</p><img src="b.png"></body>', 2: '<body><p data-slot-id="mine">New</p><p>stays</p></body>'}
    assert versions.slot_ids(x).count() == 1


def test_style_objects(spark):
    rows = ["color: red;background:url(a;b.png)", "font-family: \"A B\", serif; --x-y: 1", "width:expression(1);behavior:url(x);top:0", "background:url(data:text/html,x)", "background:url(data:image/png;base64,AA)", "", "x"]
    found = [r.o for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string").orderBy("i").select(markup.style_object(F.col("s")).alias("o")).collect()]
    assert found == [
        '{"color": "red", "background": "url(a;b.png)"}', '{"fontFamily": "\\"A B\\", serif", "--x-y": "1"}', '{"top": "0"}', "{}", '{"background": "url(data:image/png;base64,AA)"}', "{}", "{}",
    ]


def test_documents_without_extra_styles(spark):
    pages = spark.createDataFrame([(1, "T")], "page_id long, title string")
    html = markup.compile_document(tree(spark, "<body class=z><p style='top:0'>a</p><p style='top:0' class=k>b</p></body>"), pages).first().html
    assert html.startswith('<!doctype html>\n<html lang="en">\n<head>\n<meta charset="utf-8">') and "<title>T</title>\n<style>\n.style-1 { top:0 }\n</style>\n</head>\n<body>\n" in html
    assert html.endswith('<p class="style-1">a</p><p class="k style-1">b</p>\n</body>\n</html>\n')
