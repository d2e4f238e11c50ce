"""What the Jaccard join moves to verify pairs."""

import re

import numpy as np
import pytest

from loomspan.llm import jaccard_join
from loomspan.llm.shared import keep

WORDS = [f"w{i}" for i in range(5000)]


@pytest.fixture
def plain_joins(spark):
    """As on large tables: no side of a join is small enough to be broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def table(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(WORDS, 60))) for i in range(40)]
    rows += [(100 + i, rows[i][1] + " and more") for i in range(5)] + [(0, rows[0][1]), (200, None), (201, "")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_texts_are_not_shuffled(plain_joins, monkeypatch, capsys):
    docs, plans = keep(table(plain_joins)), []

    def explained(df):
        capsys.readouterr()
        df.explain("formatted")
        plans.append(capsys.readouterr().out)
        return keep(df)

    monkeypatch.setattr(jaccard_join, "keep", explained)
    rows = jaccard_join.near_duplicates(docs).select("doc_id", "component_id").collect()
    moved = [m for p in plans for m in re.findall(r"\) Exchange\nInput \[\d+\]: (\[.*\])", p)]
    assert any("hashes#" in m or "first#" in m for m in moved) and not any("text#" in m for m in moved)
    assert {r.doc_id: r.component_id for r in rows if r.doc_id >= 100} == {**{100 + i: i for i in range(5)}, 200: 200, 201: 201}


@pytest.mark.parametrize("most", [6, 27])
def test_few_bits_lose_no_link(spark, monkeypatch, most):
    monkeypatch.setattr(jaccard_join, "MOST_BITS", most)
    rows = jaccard_join.near_duplicates(table(spark)).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows if r.doc_id != r.component_id) == [(100 + i, i) for i in range(5)]


def test_bits_of_no_pairs(spark):
    bits, bit = jaccard_join._marked(spark.createDataFrame([], "key long"))
    assert not bits.any()
    keys = spark.range(-500, 500).selectExpr("id * 7919 as key")
    bits, bit = jaccard_join._marked(keys)
    at = np.array([r.bit for r in keys.select(bit.alias("bit")).collect()])
    assert (bits[at >> 6] >> (at & 63) & 1).all()
