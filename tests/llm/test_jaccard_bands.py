"""The second round of the n-gram Jaccard join: all links that the first round left, without pairs that can't be."""

import random
import re

import pytest

from loomspan.llm import jaccard_join as j


def brute(rows):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                least[y] = x
    return {(i, len(sets[i]), root(i)) for i in ids}


def texts(seed, n):
    """Passages that many texts share, and words of their own in numbers around what the threshold allows."""
    rng = random.Random(seed)
    passages = [[f"p{k}w{i}" for i in range(rng.choice((20, 60, 61, 90)))] for k in range(3)]
    rows = []
    for i in range(n):
        words = list(rng.choice(passages))
        for _ in range(rng.randrange(3)):
            words += [f"o{rng.randrange(6)}x{k}" for k in range(rng.randrange(1, 8))]
        if rng.random() < 0.4:
            words = words[: int(len(words) * rng.uniform(0.7, 1))]
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize(("seed", "pivots"), [(1, 8), (2, 1), (3, 1), (4, 2)])
def test_links_equal_brute_force_with_few_pivots(spark, monkeypatch, seed, pivots):
    monkeypatch.setattr(j, "PIVOTS", pivots)
    monkeypatch.setattr(j, "BEFORE", 2)
    rows = texts(seed, 160)
    out = j.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in out.collect()} == brute(rows)


def test_boilerplate_that_does_not_link_makes_no_pairs(spark, monkeypatch):
    common = " ".join(f"c{i}" for i in range(89))
    rows = [(i, f"{common} " + " ".join(f"o{i}x{k}" for k in range(11))) for i in range(400)]
    seen = []
    verified = j._verified
    monkeypatch.setattr(j, "_verified", lambda pairs, *more: (seen.append(pairs.count()), verified(pairs, *more))[1])
    out = j.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.where("component_id <> doc_id").count() == 0 and seen == [0, 0]


def test_prefixes_of_a_text_are_made_once(spark, monkeypatch, tmp_path):
    """Whatever the number of branches that read them. Workers see the patch in closures alone: here, that of _prefixes."""
    rows = texts(5, 120)
    log = tmp_path / "log"
    cut = j.shingles

    def logged(data):
        with open(log, "a") as f:
            f.write("x")
        return cut(data)

    monkeypatch.setattr(j, "shingles", logged)
    docs = spark.createDataFrame(rows, "key long, text string").repartition(3)
    _, classes, often = j.set_classes(docs)
    j._lists(docs, classes, often, 80)
    assert len(log.read_text()) == len(rows)


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_shingles_of_two_rows_stay_across_batches(size):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(size)
    h = sorted(rng.randrange(40) for _ in range(50)) + [77, 77, 77, 90, 95]
    often = [x % 9 == 0 for x in h]
    at = np.array([5 << 32 | 7] * len(h), np.int64)
    at = np.where(often, at | j._FREQUENT, at)
    batch = pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(range(len(h)), pa.int64()), pa.array(at)], ["h", "key", "at"])
    out = [r for b in j._met(iter(batch.slice(i, size) for i in range(0, len(h), size))) for r in b.to_pylist()]
    assert [r["key"] for r in out] == [i for i, x in enumerate(h) if often[i] or h.count(x) > 1]
    assert {(r["n"], r["pos"]) for r in out} == {(7, 5)}
