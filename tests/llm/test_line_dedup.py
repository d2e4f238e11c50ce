"""Line dedup against a plain account of which lines stay."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from loomspan.llm import queries
from loomspan.llm.line_dedup import line_bitmaps, line_hashes, sorted_runs, without_repeated_lines
from loomspan.testing import difference, duck
from tests.conftest import SF

SPACE = " \t\n\v\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, length=40, documents=5):
    """(id, text) -> (id, lines, dropped, kept text); rows without an id are documents told apart by their text."""
    key = lambda line: line.strip(SPACE).translate(LOWER)
    holders: dict[str, set] = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add((i is not None, i or 0, "" if i is not None else text or ""))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        drop = [len(key(x)) >= length and len(holders[key(x)]) >= documents and (i is None or max(holders[key(x)])[1] != i) for x in lines]
        out.append((i, len(lines), sum(drop), "\n".join(x for x, gone in zip(lines, drop) if not gone)))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "own", 1) for i, t in rows], "doc_id long, text string, `Kept_Text` string, h1 int")
    out = without_repeated_lines(df)
    assert out.columns == ["doc_id", "text", "h1", "n_lines", "n_dropped", "kept_runs", "kept_text"]
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in out.collect()), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    common = [f"{c} a line that many documents share, number {i}" for i, c in enumerate("ABCDEÄÖÜéß")]
    common += ["short line", "", " ", "x" * 39, "x" * 40, "é" * 40, "é" * 39]
    rows = []
    for i in range(60):
        lines = [rng.choice(common) if rng.random() < 0.7 else f"its own line of document {i} and of no other {rng.random()}" for _ in range(rng.randrange(0, 12))]
        lines = [rng.choice(["", " ", "\t\v", "\r"]) + (x.upper() if x.isascii() and rng.random() < 0.3 else x) + rng.choice(["", "\f ", "\r"]) for x in lines]
        rows.append((i * 7 % 61, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_a_plain_account(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows)


def test_nulls_repeats_and_empty(spark):
    line = "this line is found in every document there is, or nearly"
    rows = [(1, None), (2, ""), (3, "\n"), (4, line), (4, line), (5, f"{line}\n{line}\nown"), (6, f"a\n{line}"), (7, f"{line}\nz\n\n"), (8, f"{line}\n{line.upper()}")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[:-1]) == brute(rows[:-1])
    assert run(spark, []) == []


def test_rows_without_an_id_come_before_all_others(spark):
    line = "this line is found in every document there is, or nearly"
    rows = [(None, f"{line}\n{c}") for c in "abcd"] + [(3, line)]
    assert run(spark, rows) == brute(rows)
    alone = {r[3] for r in run(spark, [(None, f"{line}\n{c}") for c in "abcdef"])}
    assert sum(line in x for x in alone) == 1


def test_long_texts_and_many_lines(spark):
    line = "a line that is dropped from the long documents of this test"
    rows = [(i, "\n".join([line, f"{i} " + "w " * 200_000, *([line, f"line {j} of document {i}"][j % 2] for j in range(20_000))])) for i in range(6)]
    assert run(spark, rows) == brute(rows)


def test_bitmaps_name_the_runs_that_stay(spark):
    line = "this line is found in every document there is, or nearly"
    df = spark.createDataFrame([(i, f"{line}\na\nb\n{line}\n{line}\nc") for i in range(5)] + [(9, f"{line}\n{line}")], "doc_id long, text string")
    out = {r.doc_id: (r.n_lines, r.n_dropped, [tuple(x) for x in r.kept_runs]) for r in line_bitmaps(df).collect()}
    assert out[0] == (6, 3, [(1, 2), (5, 1)]) and out[9] == (2, 0, [(0, 2)])


def test_a_run_is_sorted_and_needs_one_exchange(spark):
    df = spark.createDataFrame([(i, "x" * 45 + "\n" + "x" * 45) for i in range(40)], "__doc long, __text string").withColumn("__twin", F.lit(0).cast("long"))
    runs = sorted_runs(line_hashes(df, 40))
    plan = runs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and "hashpartitioning" not in plan
    assert runs.where("first").count() == 40 and runs.count() == 80


def test_query_equals_its_sql(spark):
    name = "op12_line_dedup"
    assert difference(queries.queries()[name](spark, SF), queries.oracle_sql()[name], duck(SF)) == ""
    assert hashlib.sha256(b"").hexdigest() == run_hash(spark)


def run_hash(spark):
    return without_repeated_lines(spark.createDataFrame([(1, None)], "doc_id long, text string")).select(F.sha2("kept_text", 256).alias("h")).first().h
