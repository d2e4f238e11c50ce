"""Ingest, telemetry and edits that no table of the driver has rows for."""

import base64
import io
import json
import zipfile

from pyspark.sql import functions as F

from loomspan.operators import ingest, markup, nodes, sections, styles, versions, workflows
from loomspan.streaming.telemetry import queued, telemetry_stream


def docx(text: str) -> str:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", "".join(f"<w:p><w:t>{line}</w:t></w:p>" for line in text.split("\n")))
    return base64.b64encode(out.getvalue()).decode()


def test_ingest_of_every_kind(spark):
    gif = base64.b64encode(b"GIF89a" + (300).to_bytes(2, "little") + (100).to_bytes(2, "little")).decode()
    rows = [
        (1, "document", docx("# A title\nand a line"), "a.docx"), (2, "document", base64.b64encode(b"%PDF-1.7 x").decode(), "b.txt"), (3, "image", gif, "my_hero-image.gif"), (4, "video", gif, "x.mp4"),
        (5, "text", "hello", None), (6, "image", None, None), (7, "document", base64.b64encode(b"\xff\xfe\x00").decode(), "c.txt"), (8, "audio", base64.b64encode(b"ID3abc").decode(), "d"), (9, "document", "data:text/csv;base64," + base64.b64encode(b"a,b").decode(), "t.CSV"),
    ]
    out = {r.id: r for r in ingest.ingest(spark.createDataFrame(rows, "id int, kind string, payload string, filename string")).collect()}
    assert (out[1].ext, out[1].text, out[1].title) == ("docx", "# A title\nand a line", "A title") and out[1].stored.endswith(".docx")
    assert (out[2].ext, out[2].text, out[2].content_type) == ("pdf", "", "application/pdf")
    assert (out[3].width, out[3].height, out[3].orientation, out[3].alt_text, out[3].content_type) == (300, 100, "landscape", "my hero image", "image/gif")
    assert (out[4].problem, out[4].stored, out[4].file_size) == ("unsupported format", None, None)
    assert out[5].stored == "hello" and out[6].problem == "not base64" and out[7].problem == "unsupported format"
    assert (out[8].ext, out[8].content_type) == ("mp3", "audio/mpeg") and (out[9].ext, out[9].text) == ("csv", "a,b")


def test_telemetry_stream_drops_what_is_over(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"in{i}.json").write_text("\n".join(json.dumps({"client": c, "seq": 10 * i + n}) for c in "ab" for n in range(4)))
    stream = spark.readStream.schema("client string, seq int").option("maxFilesPerTrigger", 1).json(str(tmp_path / "*.json"))
    got: list = []
    telemetry_stream(stream, lambda rows, number: got.extend((number, r.client, r.seq) for r in rows.collect()), str(tmp_path / "state"), capacity=3, available_now=True).awaitTermination()
    assert sorted(c + str(s % 10) for _, c, s in got) == sorted(2 * [c + str(n) for c in "ab" for n in range(3)]) and {n for n, *_ in got} == {0, 1}
    assert queued(spark.createDataFrame([], "client string, seq int"), []).count() == 0


def test_removals_end_at_the_first_that_breaks_a_page(spark):
    pages = [(1, "<body><nav>m</nav><section id=a>x</section><p><a href='#a'>to a</a></p><footer>f</footer></body>"), (2, "<body><nav>m</nav><section>x</section><footer>f</footer></body>")]
    tree = nodes.parse_html(spark.createDataFrame(pages, "page_id long, html string"))
    step = F.when(F.col("tag") == "nav", 1).when(F.col("tag") == "section", 2).when(F.col("tag") == "footer", 3)
    left, done = workflows.remove_sections(tree, tree.where("depth = 1").select("page_id", step.alias("step"), "path").where("step is not null"), versions.violations)
    assert {(r.page_id, r.applied, r.passed) for r in done.collect()} == {(1, 2, False), (2, 3, True)}
    assert {(r.page_id, r.tag) for r in left.where("depth = 1").collect()} == {(1, "p"), (1, "footer")}
    assert workflows.remove_sections(tree, spark.createDataFrame([], "page_id long, step int, path string"), versions.violations)[1].count() == 0


def test_generated_styles_and_own_declarations(spark):
    media = spark.createDataFrame([(1, 5, "@media print", "color", "red", 1), (1, 3, "@media print", "top", "0", 1), (1, 3, "@media screen", "width", "expression(1)", 1)], "page_id long, node_id int, media string, prop string, value string, ord int")
    states = spark.createDataFrame([(1, 3, ":hover", "color", "blue", 2), (1, 3, ":hover", "top", "1px", 1)], "page_id long, node_id int, state string, prop string, value string, ord int")
    rules = spark.createDataFrame([(1, 1, "@font-face { src: url('a.woff') url(b/c.woff) url(data:x) }"), (1, 2, "@keyframes x { </style> }")], "page_id long, ord int, rule string")
    classes, sheets = styles.generated_styles(media, states, rules)
    assert {(r.node_id, r["class"]) for r in classes.collect()} == {(3, "gen-r1"), (5, "gen-r2")}
    assert sheets.first().css == "@font-face { src: url('assets/a.woff') url(b/c.woff) url(data:x) }\n.gen-r1:hover { top: 1px; color: blue }\n@media print {\n  .gen-r1 { top: 0 }\n  .gen-r2 { color: red }\n}"
    assert styles.own_declarations(states.drop("state")).first().style == "top: 1px; color: blue"


def test_crawl_heeds_any_number_of_rules_and_orders_by_discovery(spark):
    starts = spark.createDataFrame([(1, "https://a.b/"), (2, "https://a.b/p2?x#y"), (3, "https://c.d/e/")], "root long, url string")
    links = [("https://a.b/", f"/p{i}", i) for i in range(1, 12_001)] + [("https://a.b/p11999", "/deep", 1), ("https://a.b/p2", "/two", 20_000), ("https://a.b/p2", "https://c.d/", 1), ("https://c.d/e", "../p1#z", 1)]
    links = spark.createDataFrame(links, "url string, href string, pos int")
    rules = spark.createDataFrame([("https://a.b", f"/p{i}") for i in range(100, 1500)] + [("https://a.b", "/p1")], "site string, prefix string")
    out = workflows.crawl(links, starts, most_pages=4, disallowed=rules).collect()
    found = lambda root: [r.url for r in sorted(out, key=lambda r: r.place) if r.root == root]
    assert found(1) == ["https://a.b/", "https://a.b/p2", "https://a.b/p3", "https://a.b/p4"]
    assert found(2) == ["https://a.b/p2", "https://a.b/two"] and found(3) == ["https://c.d/e", "https://c.d/p1"]
    far = workflows.crawl(links, starts, most_pages=20_000).where("root = 1 and depth = 2").orderBy("place").collect()
    assert [r.url.rsplit("/", 1)[1] for r in far] == ["two", "deep"]


def test_deep_imports_are_all_found(spark):
    imports = spark.createDataFrame([(f"s{i}", f"s{i + 1}") for i in range(25)] + [("s25", "s0")], "sheet string, imported string")
    assert workflows.css_closure(imports, spark.createDataFrame([(1, "s0")], "root int, sheet string")).count() == 26


def test_alignment_is_a_longest_common_subsequence():
    assert markup.align([1, 2, 3, 4], [1, 9, 3, 4]) == [(0, 0), (1, None), (None, 1), (2, 2), (3, 3)]
    assert markup.align([], [1]) == [(None, 0)] and markup.align([1, 1], [1]) == [(0, 0), (1, None)]
    assert len([p for p in markup.align(list("abcbdab"), list("bdcaba")) if None not in p]) == 4


def test_what_can_be_clicked(spark):
    tree = nodes.parse_html(spark.createDataFrame([(1, "<body><a>x</a><div role=button>y</div><div tabindex=0>z</div><p>n</p></body>")], "page_id long, html string"))
    assert sections.clickable(tree).count() == 3
