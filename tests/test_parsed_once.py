"""Queries with many branches over one tree parse each page once, and branches read their own columns."""

import pytest

from loomspan.plans import QUERIES
from loomspan.session import checkpointed
from tests.conftest import SF


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_kept_tables_are_read_by_column(spark):
    kept = checkpointed(spark.range(10).selectExpr("id", "repeat('x', 100) as wide", "array(struct(id as k)) as attrs"))
    plan = _plan(kept.select("id"))
    assert "FileScan parquet [id#" in plan and "wide" not in plan.split("ReadSchema")[1]
    assert kept.orderBy("id").collect()[3].attrs[0].k == 3


@pytest.mark.parametrize("name", ["page_interactive", "page_without_menu", "page_integrity"])
def test_no_branch_parses_again(spark, name):
    assert "MapInArrow" not in _plan(QUERIES[name](spark, SF))


def test_kept_tables_are_not_broadcast_by_the_size_of_their_files(spark):
    """A column that is the same all over takes next to nothing in a file, but a row each in a broadcast."""
    kept = checkpointed(spark.range(300_000).selectExpr("id div 100 as page_id", "cast(id % 100 as int) as node_id"))
    inner = kept.groupBy("page_id", "node_id").count().where("count >= 1")
    joined = kept.where("node_id < 10").join(inner, ["page_id", "node_id"], "left_semi")
    assert "SortMergeJoin" in _plan(joined) and "Broadcast" not in _plan(joined) and joined.count() == 30_000


@pytest.mark.parametrize("name", ["page_interactive", "page_sections_removed"])
def test_no_nodes_are_broadcast(spark, name):
    assert "Broadcast" not in _plan(QUERIES[name](spark, SF))


def test_nodes_are_dealt_once_a_round(spark):
    """What a plan changes reaches the nodes by page, so that a table dealt by page is not dealt again by page and path."""
    from loomspan.operators import versions

    nodes = spark.createDataFrame([(1, 0, "root", []), (1, 1, "root > p:nth-child(1)", [("style", "margin: 1px; top: 0")]), (2, 0, "root", [])], "page_id long, node_id int, path string, attrs array<struct<k:string,v:string>>")
    plan = spark.createDataFrame([(1, "root > p:nth-child(1)", "margin", "2px"), (1, "root", None, None)], "page_id long, path string, prop string, after string")
    out = versions.reflow(nodes.repartition("page_id"), plan)
    found = {(r.page_id, r.node_id): [tuple(a) for a in r.attrs] for r in out.collect()}
    assert found == {(1, 0): [], (1, 1): [("style", "top: 0; margin: 2px")], (2, 0): []}
    assert "path" not in " ".join(line for line in _plan(out).splitlines() if "Join" in line)


def test_consensus_counts_in_one_pass(spark):
    """Pairs are counted by running sums: no frame that is added up anew for each value."""
    import random

    from pyspark.sql import functions as F

    from loomspan.plans.rasters import TOLERANCE, agreement

    random.seed(7)
    renders = [(i, i % 2, [random.choice([random.uniform(-0.3, 0.3), 0.0, 0.06, 0.12]) for _ in range(5)]) for i in range(60)]
    pixels = spark.createDataFrame(renders, "vec_id long, label int, e array<double>").select("vec_id", "label", F.posexplode("e").alias("pos", "v"))
    x = agreement(pixels)
    assert "RangeFrame" not in _plan(x)
    found = {r.label: r for r in x.collect()}
    for label in (0, 1):
        own = [e for _, of, e in renders if of == label]
        pairs = [sum(max(p, q) - TOLERANCE <= min(p, q) for p, q in zip(a, b)) for i, a in enumerate(own) for b in own[:i]]
        assert found[label].pairs == len(pairs) and abs(found[label].agreement - sum(pairs) * 100 / 5 / len(pairs)) < 1e-9
