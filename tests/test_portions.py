"""What is parsed at a time doesn't grow with a batch of pages."""

import pyarrow as pa

from loomspan.operators import nodes, styles


def test_portions_cover_a_batch_in_order():
    pages = [None, "x" * 10, "y" * 90, "z" * 200, "", *["p"] * 70]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(pages)), pa.int64()), pa.array(pages, pa.string())], ["page_id", "html"])
    parts = list(nodes.portions(batch, most=64, size=100))
    assert [p.num_rows for p in parts] == [3, 1, 64, 7]
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(pages)))
    assert list(nodes.portions(batch.slice(0, 0))) == []


def test_matches_leave_in_portions(spark):
    """Declarations of many pages: each portion is a batch of its own, and none is lost."""
    rows = [(i, f"<style>p{{top:{i}px}}</style><body><p>a</p></body>", "") for i in range(300)] + [(300, None, None), (301, "<body></body>", "p{top:0}")]
    pages = spark.createDataFrame(rows, "page_id long, html string, css string").coalesce(1)
    matched = styles.match(pages)
    assert {(r.page_id, r.value) for r in matched.collect()} == {(i, f"{i}px") for i in range(300)}
    assert "MapInArrow" in matched._jdf.queryExecution().executedPlan().toString()
