import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from loomspan.functions import prompts
from loomspan.operators import nodes, workflows
from loomspan.sources import tables


def test_catalogue_is_empty_until_written(spark, tmp_path):
    path = str(tmp_path / "catalogue")
    assert tables.read_or_empty(spark, path, tables.KNOWLEDGE).count() == 0
    first = spark.createDataFrame([("u", "colors", "primary", "#000"), ("v", "misc", "k", "1")], tables.KNOWLEDGE)
    tables.upsert(tables.read_or_empty(spark, path, tables.KNOWLEDGE), first, "url", "key").write.parquet(path)
    again = tables.upsert(tables.read_or_empty(spark, path, tables.KNOWLEDGE), spark.createDataFrame([("u", "colors", "primary", "#fff")], tables.KNOWLEDGE), "url", "key")
    assert {(r.url, r.value) for r in again.collect()} == {("u", "#fff"), ("v", "1")}


def test_artifacts(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("index.html", "<p>x</p>")
        z.writestr("../escape.txt", "no")
    archives = spark.createDataFrame([("a.zip", buffer.getvalue()), ("b.zip", b"broken")], "path string, content binary")
    found = tables.unzip(archives)
    assert [(r.path, r.member, bytes(r.content)) for r in found.collect()] == [("a.zip", "index.html", b"<p>x</p>")]
    files = spark.createDataFrame([("x", b"1"), ("y", b"2"), ("z", b"3")], "path string, content binary")
    known = tables.manifest(files.where("path <> 'z'")).withColumn("sha256", F.when(F.col("path") == "y", "0").otherwise(F.col("sha256"))).unionByName(spark.createDataFrame([("w", "0", 1)], "path string, sha256 string, n_bytes long"))
    assert {(r.path, r.status) for r in tables.verify(known, files).collect()} == {("w", "missing"), ("x", "valid"), ("y", "changed"), ("z", "unlisted")}


def test_document_kinds_and_manifest(spark):
    rows = [("a.pdf", b"%PDF-1"), ("b.docx", b"PK\x03\x04..word/document.xml.."), ("c.zip", b"PK\x03\x04.."), ("d.md", b"# x"), ("e", b"plain"), ("f", b"\xff\xfe\x00")]
    x = spark.createDataFrame(rows, "path string, content binary").select("path", tables.document_kind().alias("kind"))
    assert {r.path: r.kind for r in x.collect()} == {"a.pdf": "pdf", "b.docx": "docx", "c.zip": None, "d.md": "md", "e": "txt", "f": None}
    x = spark.createDataFrame([('{"icons":[{"src":"/i/a.png?v=1","sizes":"1"}]}',), ("nope",)], "json string").select(tables.localize_manifest().alias("j"))
    assert [r.j for r in x.collect()] == ['{"icons":[{"src":"assets/a.png","sizes":"1"}]}', "nope"]


def test_prompts(spark):
    x = spark.sql("select map('primary', '#111') as tokens, '<p>\"&' as html")
    r = x.select(prompts.design_prompt().alias("p"), prompts.preview(F.col("html"), F.col("tokens")).alias("v")).first()
    assert r.p == "Use #111 as the primary colour on #ffffff, set text in Arial, sans-serif and space blocks by 16px."
    assert 'srcdoc="<p>&quot;&amp;"' in r.v and "--color-primary:#111;" in r.v
    line = spark.range(1).select(prompts.prometheus(F.lit("m"), F.array(F.lit(0.5), F.lit(1.0)), F.array(F.lit(1), F.lit(2)), F.lit(3), F.lit(4.5)).alias("t")).first().t
    assert line.splitlines() == ["# TYPE m histogram", 'm_bucket{le="0.5"} 1', 'm_bucket{le="1.0"} 2', 'm_bucket{le="+Inf"} 3', "m_sum 4.5", "m_count 3"]


def test_jobs(spark):
    events = [
        (1, 0, 0.0, "enqueue", None), (1, 1, 1.0, "claim", "a"), (1, 2, 2.0, "fail", "a"), (1, 3, 3.0, "claim", "b"), (1, 4, 4.0, "complete", "a"), (1, 5, 5.0, "complete", "b"),
        (2, 0, 0.0, "enqueue", None), (2, 1, 1.0, "claim", "a"), (2, 2, 5000.0, "claim", "b"), (2, 3, 5001.0, "complete", "a"),
        *[(3, i, float(i), k, t) for i, (k, t) in enumerate([("enqueue", None), *[x for n in "abc" for x in (("claim", n), ("fail", n))], ("claim", "d")])],
        (4, 0, 0.0, "enqueue", None), (4, 1, 1.0, "claim", "a"), (4, 2, 2.0, "fail_permanent", "a"),
    ]
    out = {r.job_id: (r.status, r.attempts, r.discarded) for r in workflows.job_states(spark.createDataFrame(events, "job_id long, seq int, t double, kind string, token string")).collect()}
    assert out == {1: ("completed", 2, 1), 2: ("running", 2, 1), 3: ("failed", 3, 0), 4: ("failed", 1, 0)}


JOB_EVENTS = "job_id long, seq int, t double, kind string, token string"


def run_stream(spark, tmp_path, batches, name, schema, make):
    """Rows that a stream gives over batches of rows, a file each, in order; an empty batch at the end lets timers fire."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
        part = next((tmp_path / f"b{i}").glob("part-*"))
        (tmp_path / "in").mkdir(exist_ok=True)
        part.rename(tmp_path / "in" / f"{i}.parquet")
        os.utime(tmp_path / "in" / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = make(stream).writeStream.outputMode("update" if name == "jobs" else "append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.sql(f"select * from {name}").collect()


def test_silent_jobs_are_reopened_without_an_event(spark, tmp_path):
    T = 1_000_000.0
    batches = [
        [(1, 0, T, "enqueue", None), (1, 1, T + 1, "claim", "a"), (2, 0, T, "enqueue", None), (2, 1, T + 1, "claim", "a"), (3, 0, T, "enqueue", None)],
        [(1, 2, T + 900, "heartbeat", "a"), (3, 1, T + 901, "claim", "c")],
        [(9, 0, T + 1900, "enqueue", None)],
        [(9, 1, T + 1910, "claim", "z")],
        [(2, 2, T + 2501, "complete", "a")],
        [(1, 3, T + 2560, "complete", "a"), (3, 2, T + 2561, "fail_permanent", "c")],
    ]
    found = run_stream(spark, tmp_path, batches, "jobs", JOB_EVENTS, workflows.job_state_stream)
    seen = [(r.job_id, r.status, r.discarded) for r in found]
    assert (2, "pending", 0) in seen  # its timer passed between its own events
    last = {r.job_id: tuple(r)[1:] for r in found}
    every = [e for b in batches for e in b]
    whole = workflows.job_states(spark.createDataFrame(every, JOB_EVENTS), until=T + 2500)
    assert last == {r.job_id: tuple(r)[1:] for r in whole.collect()}
    assert last[2][:3] == ("pending", 1, 1) and last[1][0] == "completed" and last[3][0] == "failed"


def test_jobs_at_a_time(spark):
    rows = [(1, 0, 0.0, "enqueue", None), (1, 1, 1.0, "claim", "a"), (2, 0, 0.0, "enqueue", None), (2, 1, 500.0, "claim", "b")]
    at = lambda until: {r.job_id: r.status for r in workflows.job_states(spark.createDataFrame(rows, JOB_EVENTS), until=until).collect()}
    assert at(1801.0) == {1: "running", 2: "running"} and at(1801.5) == {1: "pending", 2: "running"} and at(None) == at(0.0)


def test_replayed_batches_change_no_project(spark, tmp_path):
    path, table = str(tmp_path / "projects"), "project_id long, status string, fidelity double, completed_at double, at struct<ended:double,job_id:bigint>"
    spark.createDataFrame([(i, "processing", None, None, None) for i in (1, 2, 3)], table).write.parquet(f"{path}/batch=-1")
    jobs = lambda *rows: workflows.project_updates(spark.createDataFrame(rows, "job_id long, project_id long, status string, fidelity double, ended double"))
    show = lambda: {r.project_id: (r.status, r.fidelity, r.completed_at) for r in tables.latest_batch(spark, path).collect()}
    first = jobs((10, 1, "completed", 91.5, 5.0), (11, 1, "running", 1.0, None), (12, 2, "failed", None, 4.0), (13, 2, "completed", 80.0, 3.0), (14, 9, "completed", 1.0, 1.0))
    assert tables.commit_batch(spark, path, 0, lambda old: workflows.apply_updates(old, first))
    assert show() == {1: ("completed", 91.5, 5.0), 2: ("failed", 80.0, 3.0), 3: ("processing", None, None)}
    assert not tables.commit_batch(spark, path, 0, lambda old: 1 / 0)
    later = jobs((15, 1, "failed", None, 9.0), (16, 3, "completed", 70.0, 2.0))
    (tmp_path / "projects" / "batch=1").mkdir()  # what a lost run left of batch 1
    assert tables.commit_batch(spark, path, 1, lambda old: workflows.apply_updates(old, later))
    assert show() == {1: ("failed", 91.5, 5.0), 2: ("failed", 80.0, 3.0), 3: ("completed", 70.0, 2.0)}
    assert tables.commit_batch(spark, path, 2, lambda old: workflows.apply_updates(old, first)) and show()[1] == ("failed", 91.5, 5.0)
    assert tables.batch_numbers(spark, path) == [1, 2]
    with pytest.raises(ValueError):
        tables.commit_batch(spark, str(tmp_path / "none"), 0, lambda old: old)


def test_removal_plan(spark):
    page = '<body><nav><a href="#b">B</a></nav><div><section id="a" data-section-index="1"></section><section id="b" data-section-index="2"></section><section id="c" data-section-index="3"></section></div></body>'
    tree = nodes.parse_html(spark.createDataFrame([(1, page)], "page_id long, html string"))
    ids = {r.path: r.node_id for r in tree.collect()}
    at = "root > div:nth-child(2)"
    s = [(1, ids[at], "display", "flex"), (1, ids[at], "flex-direction", "column"), *[(1, ids[f"{at} > section:nth-child({i})"], "width", "33%") for i in (1, 2, 3)], (1, ids[f"{at} > section:nth-child(2)"], "margin-bottom", "8px")]
    plan = workflows.removal_plan(tree, spark.createDataFrame(s, "page_id long, node_id int, prop string, value string"), spark.createDataFrame([(1, f"{at} > section:nth-child(2)")], "page_id long, path string"))
    found = [(r.action, r.path[-12:], r.prop, r.before, r.after) for r in plan.orderBy("step").collect()]
    assert found == [
        ("remove_nav_entry", "nth-child(1)", None, None, None), ("recompute_flex_basis", "nth-child(1)", "width", "33%", "50.0%"), ("recompute_flex_basis", "nth-child(3)", "width", "33%", "50.0%"),
        ("close_spacing_gap", "nth-child(1)", "margin-bottom", "0px", "8px"), ("renumber_order", "nth-child(1)", "data-section-index", "1", "1"), ("renumber_order", "nth-child(3)", "data-section-index", "3", "2"),
    ]


def test_asset_refs(spark):
    page = '<link rel="stylesheet" href="a.css"><link rel=preload as=font href="f.woff"><img src="x.png" srcset="x1.png 1x, x2.png 2x"><script src=s.js></script><meta property="og:image" content="o.png"><a href="#x"><use href="i.svg#k"/>'
    found = {(r.kind, r.ref) for r in workflows.asset_refs(spark.createDataFrame([(1, page)], "page_id long, html string")).collect()}
    assert found == {("link", "a.css"), ("font", "f.woff"), ("img", "x.png"), ("img", "x1.png"), ("img", "x2.png"), ("script", "s.js"), ("img", "o.png"), ("img", "i.svg")}
