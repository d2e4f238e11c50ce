"""Centroid clustering by a dual-tree Lloyd iteration, exact in whole numbers.

Vectors are dealt by the nearest of ANCHORS sampled vectors and by a hash, and every CHUNK of neighbours becomes a cover
tree, built once and written as one row. In each round the centroids, a bounded few, become a cover tree too, and the
two are walked together: a pair of nodes whose distance less both radii is above what a vector of the one node surely
has elsewhere is dropped. A node with one centroid left is assigned whole, by sums over its range of the tree's order;
pairs of leaves are compared exactly. A task passes on one sum a centroid. Only centroids reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.shared import keep, passing

DIMENSIONS = 64
CLUSTERS, ROUNDS, SCALE = 16, 3, 64
#: Sampled vectors by which the others are dealt, and vectors of one tree: bounds of a task's memory, not of the result.
ANCHORS, CHUNK = 64, 2048
#: Components (in magnitude, as whole numbers) from here on have squared distances that need not fit a long.
TOO_LARGE = 1 << 27
#: Sums of distances above the largest long are given as that.
LARGEST = (1 << 63) - 1
#: Whole numbers below this have exact squared distances as sums of products in doubles.
_PRODUCTS = 1 << 21
#: Rounding allowed for in bounds, as a share of what they are formed of.
_SLACK = 1e-9


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of x from all rows of y, whole numbers."""
    a, b = x.astype(np.float64), y.astype(np.float64)
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) >= _PRODUCTS:
        return np.array([np.sqrt(((row - b) ** 2).sum(1)) for row in a]).reshape(len(a), len(b))
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T), 0.0))


@dataclass
class Tree:
    """A cover tree over distinct points. Nodes come parent before child; a node's points are start to end of the tree's
    order, within radius of its centre, which is one of them. Its children are the nodes from child on, so many."""

    center: np.ndarray
    start: np.ndarray
    end: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    children: np.ndarray


def cover_tree(points: np.ndarray) -> tuple[np.ndarray, Tree]:
    """(order, tree) of distinct points: order[i] is the point at place i; centres are places.

    Points are taken farthest first: each new one is as far from all before as its separation says, and all others are
    nearer to one of those before than that. A point's level is its separation as a power of two, rounded down, so that
    points of one level or above are apart by as much, and a point's parent is the nearest of higher level, which is
    within twice that. A point stands for itself on every level below its own (levels with nothing else are left out)."""
    n = len(points)
    far = distances(points, points)
    taken, gap = np.zeros(n, np.int64), np.full(n, np.inf)
    near = far[0].copy()
    for k in range(1, n):
        taken[k] = near.argmax()
        gap[k] = near[taken[k]]
        np.minimum(near, far[taken[k]], out=near)
    level = np.full(n, 64, np.int64)
    level[1:] = np.floor(np.log2(gap[1:]))
    below: list[list[tuple[int, list[int]]]] = [[] for _ in range(n)]  # of each point: levels, from the highest, and its children there
    edges = [*np.flatnonzero(np.diff(level, prepend=65)), n]
    for a, b in zip(edges[1:], edges[2:]):  # points a to b are of one level; all of higher ones come before
        parents = taken[far[np.ix_(taken[a:b], taken[:a])].argmin(1)]
        for p, c in zip(parents, taken[a:b]):
            if not below[p] or below[p][-1][0] != level[a]:
                below[p].append((level[a], []))
            below[p][-1][1].append(c)
    center, child, children, ends = [0], [0], [0], [(0, 0)]
    order: list[int] = []
    place = np.zeros(n, np.int64)

    def add(point: int, at: int, node: int) -> None:
        """Fill in a node: point with its children from its at-th level down."""
        began = len(order)
        if at == len(below[point]):
            place[point] = len(order)
            order.append(point)
        else:
            inner = [(point, at + 1), *((c, 0) for c in below[point][at][1])]
            first = len(center)
            child[node], children[node] = first, len(inner)
            for p, _ in inner:
                center.append(p), child.append(0), children.append(0), ends.append((0, 0))
            for i, (p, deeper) in enumerate(inner):
                add(p, deeper, first + i)
        ends[node] = (began, len(order))

    add(0, 0, 0)
    start, end = np.array(ends, np.int64).T
    in_order = np.array(order, np.int64)
    radius = np.array([far[c, in_order[a:b]].max() for c, (a, b) in zip(center, ends)])
    return in_order, Tree(place[center], start, end, radius, np.array(child, np.int64), np.array(children, np.int64))


def _children(nodes: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """(which, child): the children of each of nodes, with the place in nodes of their parent."""
    counts = tree.children[nodes]
    which = np.repeat(np.arange(len(nodes)), counts)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    return which, tree.child[nodes][which] + nth


def _exact(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    d = points - centroids
    return (d * d).sum(1)


def nearest(points: np.ndarray, tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """(cluster, compared): the nearest centroid of each point in the tree's order (ties: smaller number), and how many
    pairs of a point and a centroid were compared one by one."""
    _, number = np.unique(centroids, axis=0, return_index=True)  # equal centroids: the first has all their vectors
    number.sort()
    order, other = cover_tree(centroids[number])
    number = number[order]
    places = centroids[number].astype(np.float64)
    floats = points.astype(np.float64)
    out = np.full(len(points), -1, np.int64)
    best = np.full(len(tree.center), np.inf)
    compared = 0
    q, r = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(q):
        gap = floats[tree.center[q]] - places[other.center[r]]
        d = np.sqrt((gap * gap).sum(1))
        np.minimum.at(best, q, d + tree.radius[q])
        wide = tree.radius[q] + other.radius[r]
        open_pairs = d - wide - _SLACK * (d + wide) <= best[q] * (1 + _SLACK)
        q, r = q[open_pairs], r[open_pairs]
        alone = np.bincount(q, minlength=len(best))[q] == 1
        leaf = other.children[r] == 0
        for node, centroid in zip(q[alone & leaf], number[other.center[r[alone & leaf]]]):
            out[tree.start[node] : tree.end[node]] = centroid
        q, r, leaf = q[~(alone & leaf)], r[~(alone & leaf)], leaf[~(alone & leaf)]
        # Of a node's centroid nodes, those as wide as itself are opened first; then the node itself.
        point = tree.children[q] == 0
        wide = ~leaf & ((other.radius[r] >= tree.radius[q]) | point)
        waits = np.zeros(len(best), bool)
        waits[q[wide]] = True
        done = point & ~waits[q]
        if done.any():
            a, c = tree.start[q[done]], number[other.center[r[done]]]
            compared += len(a)
            first = np.lexsort((c, _exact(points[a], centroids[c]), a))
            a, c = a[first], c[first]
            head = np.diff(a, prepend=-1) != 0
            out[a[head]] = c[head]
        which, inner = _children(r[wide], other)
        stays = waits[q] & ~wide
        opens = ~waits[q] & ~point
        parent, deeper = _children(q[opens], tree)
        best[deeper] = np.minimum(best[deeper], best[q[opens]][parent])
        q, r = np.concatenate((q[wide][which], q[stays], deeper)), np.concatenate((inner, r[stays], r[opens][parent]))
    return out, compared


_TREE = ("center", "start", "end", "child", "children")
_TREE_SCHEMA = "ids array<bigint>, place array<int>, weight array<bigint>, points binary, radius binary, " + ", ".join(f"{k} binary" for k in _TREE)


def _rows(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, DIMENSIONS)


def _nearest_anchor(anchors: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch.column(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(distances(x, anchors).argmin(1).astype(np.int32))], ["vec_id", "v", "anchor"])

    return run


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, v, ...) -> a cover tree for each CHUNK of rows: points are distinct and in the tree's order, weight says how many
    rows are at each, ids and place are the rows' ids and points."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            x, row_point, weight = np.unique(_rows(part.column(1)), axis=0, return_inverse=True, return_counts=True)
            order, tree = cover_tree(x)
            place = np.empty(len(x), np.int32)
            place[order] = np.arange(len(x))
            blobs = [x[order].astype(np.int32), tree.radius, *(getattr(tree, k) for k in _TREE)]
            columns = [pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([place[row_point.ravel()]], pa.list_(pa.int32())), pa.array([weight[order]], pa.list_(pa.int64()))]
            columns += [pa.array([b.tobytes()], pa.binary()) for b in blobs]
            yield pa.RecordBatch.from_arrays(columns, ["ids", "place", "weight", "points", "radius", *_TREE])


def _read(row: dict) -> tuple[np.ndarray, Tree]:
    points = np.frombuffer(row["points"], np.int32).astype(np.int64).reshape(-1, DIMENSIONS)
    return points, Tree(radius=np.frombuffer(row["radius"]), **{k: np.frombuffer(row[k], np.int64) for k in _TREE})


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _sums(centroids: np.ndarray) -> Callable:
    """Trees -> (cluster, n, sums): a row for each cluster that a task has vectors of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), DIMENSIONS), np.int64)
        for row in _chunks(batches):
            points, tree = _read(row)
            cluster, _ = nearest(points, tree, centroids)
            weight = np.array(row["weight"], np.int64)
            np.add.at(n, cluster, weight)
            np.add.at(sums, cluster, points * weight[:, None])
        some = np.flatnonzero(n)
        if len(some):
            columns = [pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", "sums"])

    return run


def _assigned(centroids: np.ndarray) -> Callable:
    """Trees -> (vec_id, cluster, distance), a row for each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _chunks(batches):
            points, tree = _read(row)
            cluster, _ = nearest(points, tree, centroids)
            far = _exact(points, centroids[cluster])
            place = np.array(row["place"], np.int64)
            columns = [pa.array(row["ids"], pa.int64()), pa.array(cluster[place].astype(np.int32)), pa.array(far[place])]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    return run


def whole_vectors(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that are kept, v in whole numbers."""
    v, limit = F.col(f"`{column}`").cast("array<double>"), float(TOO_LARGE)
    whole = F.transform(v, lambda x: F.floor(F.lit(SCALE) * x))
    ok = (F.size(v) == DIMENSIONS) & F.forall(v, lambda x: F.coalesce(F.abs(x * SCALE) < limit, F.lit(False)))
    return vectors.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.when(ok, whole).cast("array<int>").alias("v")).where("v is not null")


def _least_hashes(vectors: DataFrame, seed: int, most: int) -> list[list[int]]:
    """The vectors with the smallest sha256 of `seed:vec_id`, at most so many."""
    hashed = vectors.withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    return [list(r.v) for r in hashed.orderBy(F.asc_nulls_last("hash"), "v").limit(most).select("v").collect()]


def _moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floor(sum / count), where there are vectors."""
    parts = trees.mapInArrow(_sums(centroids), "cluster int, n long, sums array<bigint>")
    sums = parts.select("cluster", "n", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i")
    out = centroids.copy()
    for r in sums.agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():  # clusters x dimensions
        out[r.cluster, r.i] = int(r.x) // int(r.n)
    return out


def cluster(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 1) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row for each kept vector.

    Kept are vectors of exactly 64 components, none null or not finite; component x counts as floor(64 * x). Vectors
    with a component of 2**21 or more in magnitude are not kept, as their distances need not fit a long; an inertia above the largest long is given as that. Centroids start
    as the vectors with the smallest hash of seed and id (rows of one id by their components; rows without an id last).
    Fewer vectors than clusters make fewer clusters. A tie goes to the smaller cluster, a centroid without vectors
    stays. Repeated rows count as often as they are there. An empty table gives an empty table. Other columns are not
    read."""
    with passing() as stay:
        whole = keep(whole_vectors(vectors, id_column, column))
        start = _least_hashes(whole, seed, clusters)
        if not start:
            return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
        anchors = np.array(_least_hashes(whole, seed + 1, ANCHORS), np.int64)
        dealt = keep(whole.mapInArrow(_nearest_anchor(anchors), "vec_id long, v array<int>, anchor int"))
        # The hash lets ranges end within an anchor's vectors, of which there may be very many.
        near = dealt.repartitionByRange("anchor", F.xxhash64("v", "vec_id")).sortWithinPartitions("anchor")
        trees = keep(near.mapInArrow(_trees, _TREE_SCHEMA))
        centroids = np.array(start, np.int64)
        for _ in range(rounds):
            centroids = _moved(trees, centroids)
        out = stay(keep(trees.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long")))
        sums = {r.cluster: int(r.s) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row a cluster
        names = {c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest() for c in sums}
        facts = [(c, min(s, LARGEST), min(sum(sums.values()), LARGEST), names[c]) for c, s in sums.items()]
        named = out.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
        return out.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
