"""Clustering against assignment by all distances, and the trees against what a cover tree is."""

import hashlib
import math
import random

import numpy as np
import pytest

from loomspan.llm import centroid_cluster as c
from loomspan.llm import queries
from loomspan.testing import difference, duck
from tests.conftest import SF


def brute(rows, clusters=16, rounds=3):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(64 * float(np.float32(x))) for x in v]))
    name = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest())
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:clusters]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), k) for k, m in enumerate(centroids))
    for _ in range(rounds):
        found = [nearest(v)[1] for _, v in kept]
        for k in range(len(centroids)):
            own = [v for (_, v), at in zip(kept, found) if at == k]
            if own:
                centroids[k] = [sum(x) // len(own) for x in zip(*own)]
    last = [nearest(v) for _, v in kept]
    inertia = [sum(d for d, at in last if at == k) for k in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in centroids]
    top = 2**63 - 1
    return sorted(((i, k, d, min(inertia[k], top), min(sum(inertia), top), sha[k]) for (i, _), (d, k) in zip(kept, last)), key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, anchor string")
    return sorted((tuple(r) for r in c.cluster(df).collect()), key=repr)


def vectors(seed, n, spread=0.3, kinds=7):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(kinds, 64))
    return [(i * 13 % 1009, [float(x) for x in middles[rng.integers(kinds)] + spread * rng.normal(size=64)]) for i in range(n)]


@pytest.mark.parametrize(("seed", "n", "spread"), [(1, 300, 0.05), (2, 300, 1.0)])
def test_equals_assignment_by_all_distances(spark, seed, n, spread):
    rows = vectors(seed, n, spread)
    rows += [(5000, None), (5001, [0.1] * 63), (5002, [0.1] * 65), (5003, [None] + [0.1] * 63), (5004, [math.nan] + [0.1] * 63), (5005, [math.inf] + [0.1] * 63), (5006, [0.0] * 64), (None, [0.5] * 64), (None, [-0.5] * 64)]
    rows += rows[:40] + [(6000 + i, rows[0][1]) for i in range(200)]  # repeated rows, and copies under other ids
    assert run(spark, rows) == brute(rows)


def test_few_vectors_ties_and_none(spark):
    square = [(i, [x, y] + [0.0] * 62) for i, (x, y) in enumerate([(1.0, 0.0), (-1.0, 0.0), (0.0, 1.0), (0.0, -1.0), (0.0, 0.0)])]
    assert run(spark, square) == brute(square)
    assert run(spark, [(7, [0.25] * 64)]) == brute([(7, [0.25] * 64)])
    assert run(spark, [(i, [0.25] * 64) for i in range(50)]) == brute([(i, [0.25] * 64) for i in range(50)])
    assert run(spark, []) == [] and run(spark, [(1, None)]) == []


def test_large_components_are_exact(spark):
    rng = random.Random(4)
    rows = [(i, [float(rng.choice((1, -1)) * rng.choice((3, 1_000_001, 1_900_000))) for _ in range(64)]) for i in range(60)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(1, [4_000_000.0] * 64)]) == []  # documented: too large for distances that fit a long


@pytest.mark.parametrize("seed", range(4))
def test_cover_tree(seed):
    rng = np.random.default_rng(seed)
    points = np.unique(np.floor(rng.normal(scale=[1, 10, 60][seed % 3], size=(150, 64))).astype(np.int64) if seed < 3 else rng.integers(0, 3, size=(150, 64)), axis=0)
    order, tree = c.cover_tree(points)
    assert sorted(order) == list(range(len(points)))
    x = points[order].astype(float)
    for i in range(len(tree.center)):
        own = x[tree.start[i] : tree.end[i]]
        assert tree.start[i] <= tree.center[i] < tree.end[i]
        assert np.sqrt(((own - x[tree.center[i]]) ** 2).sum(1)).max() <= tree.radius[i] * (1 + 1e-9)
        inner = range(tree.child[i], tree.child[i] + tree.children[i])
        if len(inner):
            assert [tree.start[j] for j in inner] == [tree.start[i], *(tree.end[j] for j in inner)][:-1] and tree.end[inner[-1]] == tree.end[i]
            apart = [math.dist(x[tree.center[a]], x[tree.center[b]]) for a in inner for b in inner if a < b]
            assert not apart or 2 * min(apart) >= max(math.dist(x[tree.center[i]], x[tree.center[j]]) for j in inner) - 1e-9
        else:
            assert tree.end[i] == tree.start[i] + 1


def test_pruning_leaves_few_pairs_to_compare():
    rng = np.random.default_rng(9)
    middles = rng.integers(-300, 300, size=(16, 64))
    points = np.unique(np.concatenate([m + rng.integers(-9, 9, size=(100, 64)) for m in middles]), axis=0)
    order, tree = c.cover_tree(points)
    found, compared = c.nearest(points[order], tree, middles)
    assert compared < len(points) and (found == ((points[order][:, None] - middles[None]) ** 2).sum(2).argmin(1)).all()


def test_query_equals_its_sql(spark):
    name = "op13_centroid_clustering"
    assert difference(queries.queries()[name](spark, SF), queries.oracle_sql()[name], duck(SF)) == ""
