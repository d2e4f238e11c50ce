"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors with cosine >= c are within squared distance d2 = 2 - 2c. A fixed rotation spreads the energy evenly;
the rotated vectors are split into blocks, and if two vectors are within d2, they are within d2 * (block's share of
the dimensions) in one block at least. Each block is range-joined under that budget, by a grid as wide as the block's
radius over so many of the block's coordinates that a cell holds some TILE vectors, however many there are (those
coordinates first that spread the vectors most). A vector is at home in its cell and a guest of the neighbours, on
one side, that its ball of that radius reaches. What is crowded still (vectors that are all alike) is dealt over tiles
of its cell. Inside a tile the grid goes on over further coordinates, in memory.

A pair that meets within the budget is judged there and then: the tile has whole vectors. It counts in the first
block that has it alone, so that links are neither gathered nor made distinct: a tile returns one count for each
vector and one edge for each vector that is linked, never a row for each pair. Only pairs too near the threshold for
single precision leave as pairs, and are verified from the vectors as they came, in double precision.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.shared import components, keep, passing
from loomspan.llm.textscan import mix

COSINE = 0.95
BLOCK = 8
#: Vectors that a tile should hold (8 MB at 64 dimensions).
TILE = 1 << 15
#: Inside a tile: vectors that a finer cell should hold, and coordinates that make it, at most.
FINE, FINER = 32, 3
#: What single precision may be wrong by, with room, in a squared distance or a cosine of unit vectors.
SLACK = 1e-5
#: Elements of one matrix of distances, and pairs that are judged at once.
ROWS, COLUMNS, PAIRS = 1024, 4096, 1 << 16
_COUNT, _EDGE, _CLOSE = 0, 1, 2


@functools.cache
def _rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(1234 + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


@dataclass(frozen=True)
class Block:
    """Coordinates [start, end) of the vectors of one length, and the grid over them: order of the coordinates, how
    many make the cells that tasks get, and how many more the cells inside a tile, by the vectors there."""

    start: int
    end: int
    budget: float
    order: tuple[int, ...]
    depth: int
    shares: tuple[float, ...]

    def finer(self, vectors: int) -> tuple[int, ...]:
        n, left = 0, float(vectors)
        while left > FINE and n < FINER and self.depth + n < len(self.order):
            left *= self.shares[self.depth + n]
            n += 1
        return self.order[self.depth : self.depth + n]


def _bounds(dim: int, cosine: float) -> list[tuple[int, int, float]]:
    """(start, end, budget) of each block; the budget has room for rounding."""
    return [(a, min(dim, a + BLOCK), (2 - 2 * cosine) * (min(dim, a + BLOCK) - a) / dim + SLACK) for a in range(0, dim, BLOCK)]


def _width(budget: float) -> float:
    """Of a cell: a little more than the radius, so that partners are never beyond the next cell."""
    return budget**0.5 * 1.001


def _matrices(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) for each number of dimensions in a batch."""
    flat, sizes = vectors.flatten().to_numpy(zero_copy_only=False), vectors.value_lengths().to_numpy(zero_copy_only=False)
    ids, starts = ids.to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes)))
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield ids[rows], flat[starts[rows][:, None] + np.arange(dim)].astype(np.float64)


def _binary(x: np.ndarray) -> pa.Array:
    """Each row of a matrix as bytes."""
    offsets = np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1] * x.itemsize)
    return pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x))])


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, single precision vectors) for each length of the vectors in a binary column."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    for size in np.unique(np.diff(offsets)):
        rows = np.flatnonzero(np.diff(offsets) == size)
        yield rows, data[offsets[rows][:, None] + np.arange(size)].view(np.float32)


def _rotated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, v, copies) -> (id, copies, x): the rotated unit vector in single precision."""
    for batch in batches:
        for rows, v in _matrices(pa.array(np.arange(batch.num_rows)), batch.column(1)):
            v = v / np.abs(v).max(axis=1)[:, None]
            x = (v / np.linalg.norm(v, axis=1)[:, None] @ _rotation(v.shape[1])).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(2).take(pa.array(rows)), _binary(x)], ["id", "copies", "x"])


def _spread(cosine: float):
    """(x) -> how many vectors of a length are in each cell of each coordinate by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in _by_length(batch.column(0)):
                for a, b, budget in _bounds(x.shape[1], cosine):
                    for i in range(a, b):
                        cell, n = np.unique(np.floor(x[:, i] / _width(budget)).astype(np.int32), return_counts=True)
                        columns = [np.full(len(cell), x.shape[1], np.int32), np.full(len(cell), i, np.int32), cell, n]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["dim", "i", "cell", "n"])

    return run


def grids(rotated: DataFrame, cosine: float) -> dict[int, list[Block]]:
    """The blocks of each length of vectors. A row for each coordinate of each length comes to the driver."""
    cells = rotated.select("x").mapInArrow(_spread(cosine), "dim int, i int, cell int, n long").groupBy("dim", "i", "cell").agg(F.sum("n").alias("n"))
    n = F.col("n").cast("double")
    found = {(r.dim, r.i): r for r in cells.groupBy("dim", "i").agg(F.sum(n).alias("n"), F.sum(n * n).alias("squares")).collect()}
    out: dict[int, list[Block]] = {}
    for dim in sorted({d for d, _ in found}):
        out[dim] = []
        for a, b, budget in _bounds(dim, cosine):
            share = {i: found[dim, i].squares / found[dim, i].n ** 2 for i in range(a, b)}
            order = tuple(sorted(share, key=lambda i: (share[i], i)))
            depth, held = 0, found[dim, a].n
            while depth < len(order) and (held > TILE or not depth):
                held *= share[order[depth]]
                depth += 1
            out[dim].append(Block(a, b, budget, order, depth, tuple(share[i] for i in order)))
    return out


def _home_cells(x: np.ndarray, seed: int, coordinates: tuple[int, ...], budget: float) -> np.ndarray:
    cell, width = np.full(len(x), mix(np.array([seed], np.uint64))[0]), _width(budget)
    for i in coordinates:
        cell = mix(cell + np.floor(x[:, i].astype(np.float64) / width).astype(np.int64).view(np.uint64))
    return cell


def _visits(x: np.ndarray, seed: int, coordinates: tuple[int, ...], budget: float, both_sides: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home) for each cell that the vectors' balls reach: the home cell and neighbours on one side, or on
    both. Coordinates are taken one after the other, and what has left the budget is left out at once."""
    width = _width(budget)
    row, cell = np.arange(len(x)), np.full(len(x), mix(np.array([seed], np.uint64))[0])
    away, moved = np.zeros(len(x)), np.zeros(len(x), bool)
    for i in coordinates:
        place = x[row, i].astype(np.float64) / width
        at = np.floor(place)
        parts = []
        for step in (-1, 0, 1):
            gap = (place - at if step < 0 else at + 1 - place) * width if step else 0.0
            far = away + np.square(gap)
            ok = far <= budget
            if step < 0 and not both_sides:
                ok &= moved
            parts.append((row[ok], mix(cell[ok] + (at[ok] + step).astype(np.int64).view(np.uint64)), far[ok], moved[ok] | (step != 0)))
        row, cell, away, moved = (np.concatenate(p) for p in zip(*parts))
    return row, cell, ~moved


def _deal(plan: dict[int, list[Block]]):
    """(id, copies, x) -> a row for each block and cell that a vector is at home in or a guest of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, copies = (batch.column(i).to_numpy() for i in (0, 1))
            for rows, x in _by_length(batch.column(2)):
                dim = x.shape[1]
                for number, block in enumerate(plan[dim]):
                    row, cell, home = _visits(x, dim << 16 | number, block.order[: block.depth], block.budget, False)
                    for k in range(0, len(row), 1 << 15):
                        r = row[k : k + (1 << 15)]
                        columns = [np.full(len(r), dim, np.int32), np.full(len(r), number, np.int32), cell[k : k + len(r)].view(np.int64), ~home[k : k + len(r)], ids[rows[r]], copies[rows[r]]]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), _binary(x[r])], ["dim", "block", "cell", "guest", "id", "copies", "x"])

    return run


def _homes(plan: dict[int, list[Block]]):
    """(x) -> how many vectors are at home in each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in _by_length(batch.column(0)):
                dim = x.shape[1]
                for number, block in enumerate(plan[dim]):
                    cell, n = np.unique(_home_cells(x, dim << 16 | number, block.order[: block.depth], block.budget).view(np.int64), return_counts=True)
                    columns = [np.full(len(n), dim, np.int32), np.full(len(n), number, np.int32), cell, n]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["dim", "block", "cell", "n"])

    return run


def _distance2(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distance of each row, the same wherever a pair is met: element by element, in double precision."""
    d = np.square(x.astype(np.float64) - y.astype(np.float64))
    return functools.reduce(np.add, d.T)


class Tile:
    """The vectors at home in one tile; what meets them is judged against all of them that are near in the block."""

    def __init__(self, blocks: list[Block], number: int, cosine: float, x: np.ndarray, copies: np.ndarray, sizes: tuple[int, int]):
        self.blocks, self.number, self.block, self.cosine = blocks, number, blocks[number], cosine
        self.x, self.copies, self.sizes = x, copies, sizes
        self.finer = self.block.finer(len(x))
        cell = _home_cells(x, 1, self.finer, self.block.budget)
        self.rows = np.argsort(cell, kind="stable")
        self.cells = cell[self.rows]

    def meet(self, y: np.ndarray | None):
        """Yields (i, j, linked) of the tile's rows i and rows j of y (None: the tile itself, each pair once): rows
        that link one by one, all of i against all of j with a matrix, or (None) pairs that are too close to tell."""
        same = y is None
        y = self.x if same else y
        row, cell, home = _visits(y, 1, self.finer, self.block.budget, not same)
        order = np.argsort(cell, kind="stable")
        row, cell, home = row[order], cell[order], home[order]
        cut = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.empty(0, np.int64)
        low, high = np.searchsorted(self.cells, cell[cut]), np.searchsorted(self.cells, cell[cut], side="right")
        for a, b, p, q in zip(cut.tolist(), [*cut[1:].tolist(), len(cell)], low.tolist(), high.tolist()):
            for i in range(p, q, self.sizes[0]):
                for j in range(a, b, self.sizes[1]):
                    far, end = min(q, i + self.sizes[0]), min(b, j + self.sizes[1])
                    yield from self._judge(self.rows[i:far], row[j:end], y, home[j:end] if same else None)

    def _near(self, block: Block, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        a, b = x[:, block.start : block.end], y[:, block.start : block.end]
        return np.square(a).sum(1)[:, None] + np.square(b).sum(1)[None, :] - 2 * (a @ b.T)

    def _judge(self, i: np.ndarray, j: np.ndarray, y: np.ndarray, home: np.ndarray | None):
        x, z = self.x[i], y[j]
        near = self._near(self.block, x, z)
        open_ = near <= self.block.budget + SLACK
        if home is not None and home.any():  # of a pair that is at home in one cell only one order counts
            open_ &= (i[:, None] < j[None, :]) | ~home[None, :]
        n = int(np.count_nonzero(open_))
        if not n:
            return
        if n * 50 < open_.size:
            p, q = np.nonzero(open_)
            yield from self._one_by_one(i[p], j[q], y)
            return
        # Many pairs: matrices again, and one by one only those that single precision can't tell.
        doubt = open_ & (near > self.block.budget - SLACK)
        for block in self.blocks[: self.number]:
            d = self._near(block, x, z)
            open_ &= d > block.budget - SLACK
            doubt |= d <= block.budget + SLACK
            if not open_.any():
                return
        doubt &= open_
        cosines = x @ z.T
        sure = open_ & ~doubt
        p, q = np.nonzero(doubt & (cosines >= self.cosine - SLACK))
        yield from self._one_by_one(i[p], j[q], y)
        p, q = np.nonzero(sure & (np.abs(cosines - self.cosine) <= SLACK))
        if len(p):
            yield i[p], j[q], None
        yield i, j, sure & (cosines > self.cosine + SLACK)

    def _one_by_one(self, i: np.ndarray, j: np.ndarray, y: np.ndarray):
        for k in range(0, len(i), PAIRS):
            p, q = i[k : k + PAIRS], j[k : k + PAIRS]
            for block in (self.block, *self.blocks[: self.number]):
                d = _distance2(self.x[p, block.start : block.end], y[q, block.start : block.end])
                ok = (d <= block.budget) == (block is self.block)
                p, q = p[ok], q[ok]
            cosines = np.einsum("ij,ij->i", self.x[p].astype(np.float64), y[q].astype(np.float64))
            close, linked = np.abs(cosines - self.cosine) <= SLACK, cosines > self.cosine + SLACK
            if close.any():
                yield p[close], q[close], None
            if linked.any():
                yield p[linked], q[linked], linked


def _components(linked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns of each connected component of a matrix of links, in a few steps where links are many."""
    todo = linked.any(axis=1)
    while todo.any():
        rows = np.zeros(len(todo), bool)
        rows[np.argmax(todo)] = True
        while True:
            columns = linked[rows].any(axis=0)
            more = linked[:, columns].any(axis=1)
            if (more == rows).all():
                break
            rows = more
        todo &= ~rows
        yield np.flatnonzero(rows), np.flatnonzero(columns)


def _forest(n: int, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of nodes 0 to n - 1 that edges (u, v) connect with a smaller root."""
    label = np.arange(n)
    while True:
        new, low = label.copy(), np.minimum(label[u], label[v])
        for at in (u, v, label[u], label[v]):
            np.minimum.at(new, at, low)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            node = np.flatnonzero(label != np.arange(n))
            return node, label[node]
        label = new


def _meet(cosine: float, plan: dict[int, list[Block]], sizes: tuple[int, int]):
    """From rows sorted by tile, those at home first: (kind, a, b, n), a count of links (n, copies counted) of a, an
    edge of a component, or a pair too close to the threshold."""

    def batch_of(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), *map(pa.array, (a, b, n))], ["kind", "a", "b", "n"])

    def judged(tile: Tile, ids: np.ndarray, counts: np.ndarray, y: np.ndarray | None, others: np.ndarray, copies: np.ndarray, theirs: np.ndarray):
        """counts and theirs get the links' copies; yields edges and close pairs."""
        m, us, vs = 0 if y is None else len(ids), [], []

        def edges() -> Iterator[pa.RecordBatch]:
            if us:
                names = ids if y is None else np.concatenate((ids, others))
                node, root = _forest(len(names), np.concatenate(us), np.concatenate(vs))
                us.clear(), vs.clear()
                yield batch_of(_EDGE, names[node], names[root], np.zeros(len(node), np.int64))

        for i, j, linked in tile.meet(y):
            if linked is None:
                yield batch_of(_CLOSE, np.minimum(ids[i], others[j]), np.maximum(ids[i], others[j]), np.zeros(len(i), np.int64))
            elif linked.ndim == 1:
                np.add.at(counts, i, copies[j])
                np.add.at(theirs, j, tile.copies[i])
                us.append(i), vs.append(j + m)
            else:
                np.add.at(counts, i, linked @ copies[j])
                np.add.at(theirs, j, tile.copies[i] @ linked)
                for rows, columns in _components(linked):
                    us.append(np.concatenate((i[rows], j[columns] + m)))
                    vs.append(np.full(len(us[-1]), i[rows[0]]))
            if sum(map(len, us)) > 1 << 20:
                yield from edges()
        yield from edges()

    def counted(ids: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        some = counts > 0
        if some.any():
            yield batch_of(_COUNT, ids[some], ids[some], counts[some])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, parts, tile, ids, counts = None, [], None, np.empty(0, np.int64), np.empty(0, np.int64)

        def settle() -> Iterator[pa.RecordBatch]:
            """All at home are there: they meet each other."""
            nonlocal tile, ids, counts, parts
            if parts:
                ids, copies, x = (np.concatenate(p) for p in zip(*parts))
                tile, counts, parts = Tile(plan[name[0]], name[1], cosine, x, copies, sizes), np.zeros(len(ids), np.int64), []
                yield from judged(tile, ids, counts, None, ids, copies, counts)

        def leave() -> Iterator[pa.RecordBatch]:
            nonlocal tile
            yield from settle()
            if tile is not None:
                yield from counted(ids, counts)
            tile = None

        for batch in batches:
            dim, block, cell, part, guest, number, weight = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(7))
            new = np.flatnonzero(functools.reduce(np.logical_or, (c[1:] != c[:-1] for c in (dim, block, cell, part, guest)))) + 1
            cut = [0, *new.tolist(), len(dim)]
            for a, b in zip(cut[:-1], cut[1:]):
                if a == b:
                    continue
                here = (int(dim[a]), int(block[a]), int(cell[a]), int(part[a]))
                if here != name:
                    yield from leave()
                    name = here
                ((_, x),) = _by_length(batch.column(7).slice(a, b - a))
                if not guest[a]:
                    parts.append((number[a:b], weight[a:b], x))
                    continue
                yield from settle()
                if tile is not None:  # guests of an empty cell meet nobody
                    theirs = np.zeros(b - a, np.int64)
                    yield from judged(tile, ids, counts, x, number[a:b], weight[a:b], theirs)
                    yield from counted(number[a:b], theirs)
        yield from leave()

    return run


def _verify(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.array(np.arange(batch.num_rows))
            ok = np.zeros(batch.num_rows, dtype=bool)
            for (r, x), (_, y) in zip(_matrices(rows, batch.column(2)), _matrices(rows, batch.column(3))):
                # Scaled first: squares of very large or small components would overflow or vanish.
                x, y = x / np.abs(x).max(axis=1)[:, None], y / np.abs(y).max(axis=1)[:, None]
                ok[r] = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y)) >= cosine
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok))

    return run


def links(vectors: DataFrame, cosine: float = COSINE) -> tuple[DataFrame, DataFrame]:
    """Of vectors(id, v, copies), distinct and valid: (id, others), the copies of other vectors with that cosine at
    least, and edges (a, b) that connect what links connect."""
    if not 0 < cosine <= 1:
        raise ValueError("the cosine must be above 0 and at most 1")
    rotated = keep(vectors.select("id", "v", "copies").mapInArrow(_rotated, "id long, copies long, x binary"))
    plan = grids(rotated, cosine)
    dealt = rotated.mapInArrow(_deal(plan), "dim int, block int, cell long, guest boolean, id long, copies long, x binary")
    # Cells that are crowded though they are small: a row for TILE vectors and block at most.
    of = ["dim", "block", "cell"]
    homes = rotated.select("x").mapInArrow(_homes(plan), "dim int, block int, cell long, n long").groupBy(*of).agg(F.sum("n").alias("n"))
    crowded = keep(homes.where(F.col("n") > TILE).select(*of, F.ceil(F.col("n") / TILE).cast("int").alias("tiles")))
    own = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    tiles = F.when(F.col("tiles").isNull(), F.array(F.lit(0))).when(F.col("guest"), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.sequence(F.lit(0), own))
    placed = dealt.join(crowded, of, "left").select("*", F.explode(tiles).alias("tile"), F.coalesce(own, F.lit(0)).alias("own"))
    placed = placed.select(*of, "tile", (F.col("guest") | (F.col("tile") != F.col("own"))).alias("guest"), "id", "copies", "x")
    met = placed.repartition(*of, "tile").sortWithinPartitions(*of, "tile", "guest").mapInArrow(_meet(cosine, plan, (ROWS, COLUMNS)), "kind int, a long, b long, n long")
    met = keep(met)
    close = met.where(F.col("kind") == _CLOSE).select("a", "b")
    x, y = vectors.select(F.col("id").alias("a"), F.col("v").alias("x")), vectors.select(F.col("id").alias("b"), F.col("v").alias("y"))
    pairs = keep(close.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verify(cosine), "a long, b long"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = both.join(vectors.select(F.col("id").alias("b"), "copies"), "b").select("a", F.col("copies").alias("n"))
    counts = met.where(F.col("kind") == _COUNT).select("a", "n").unionByName(more).groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    edges = met.where(F.col("kind") == _EDGE).select("a", "b").unionByName(pairs)
    return counts, edges


def near_duplicates(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """Each row of table with n_links (other rows linked directly), component_id (smallest id reachable, itself
    included) and kept (it is that smallest).

    Null, empty and zero vectors and those with null or non-finite components link with nothing, nor do vectors of
    different lengths. Equal vectors link with each other. Columns of these names are replaced. A null id is replaced
    by a hash of its vector in the join, and may be named so in component_id. An empty table gives an empty table."""
    names = ["n_links", "component_id", "kept"]
    v = F.col(vector_column).cast("array<double>")
    sound = v.isNotNull() & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    rows = table.select(*(F.col(f"`{c}`") for c in table.columns if c.lower() not in names)).withColumns(
        {"__id": F.coalesce(F.col(id_column).cast("long"), F.xxhash64(vector_column)), "__ok": F.coalesce(sound, F.lit(False))}
    )
    hashes = {"__g": F.xxhash64(vector_column), "__h": F.xxhash64(F.lit(7), vector_column)}
    of = rows.where("__ok").withColumns(hashes)
    with passing() as stay:
        classes = keep(of.groupBy("__g", "__h").agg(F.min("__id").alias("rep"), F.count("*").alias("copies")))
        reps = of.select(F.col("__id").alias("id"), "__g", "__h", F.col(vector_column).alias("v")).dropDuplicates(["id"])
        reps = keep(reps.join(classes.select(F.col("rep").alias("id"), "__g", "__h", "copies"), ["id", "__g", "__h"]).select("id", "v", "copies"))
        others, edges = links(reps, cosine)
        others, parts = others.withColumnRenamed("id", "rep"), components(edges).withColumnRenamed("node", "rep")
        named = classes.join(others, "rep", "left").join(parts, "rep", "left").select(
            "__g", "__h",
            (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"),
        )
        named = stay(keep(named))
    # Rows that link with nothing have a key of their own, so that they don't meet in one task.
    keys = {"__g": F.when(F.col("__ok"), hashes["__g"]).otherwise(F.xxhash64("__id")), "__h": F.when(F.col("__ok"), hashes["__h"])}
    out = rows.withColumns(keys).join(named, ["__g", "__h"], "left").withColumns(
        {"n_links": F.coalesce("n", F.lit(0)).cast("long"), "component_id": F.coalesce("c", "__id")}
    )
    return out.withColumn("kept", F.col("component_id") == F.col("__id")).drop("__g", "__h", "__id", "__ok", "n", "c")
