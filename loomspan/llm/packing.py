"""Best-two-fit packing of tokenised documents into sequences.

Packing looks at lengths alone, and there are only `capacity` of them: tasks count the pieces of each length, the
driver packs that histogram (never the documents), and pieces find their place by their rank within their length.
A pattern of lengths is used for as many sequences as the counts allow at once.

Best-two-fit: a sequence is filled greedily, longest first; then its smallest piece gives way to two unpacked ones
that fit the expanded gap more tightly.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.shared import keep
from loomspan.llm.textscan import text_bytes
from loomspan.llm.word_tokens import portions, word_bpe

CAPACITY = 4096
END = 1
#: Pieces that are ranked in one part, about.
RANKED = 50_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _pieces(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_bpe(path)
        end = np.array([END], dtype="<u4").tobytes()
        for batch in batches:
            row, base = batch.column(0), 0
            for part in portions(text_bytes(batch.column(1))):
                out: dict[str, list] = {x: [] for x in ("at", "piece", "start", "length", "ids_crc32", "ids")}
                for i, ids in enumerate(tokenizer.ids([x.tobytes() for x in part])):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                        cut = ids[4 * start : 4 * (start + capacity)]
                        for name, x in zip(out, (base + i, piece, start, len(cut) // 4, zlib.crc32(cut), cut)):
                            if name != "ids" or with_ids:
                                out[name].append(x)
                base += len(part)
                columns = [row.take(pa.array(out["at"])), pa.array(out["piece"], pa.int32()), *(pa.array(out[x], pa.int64()) for x in ("start", "length", "ids_crc32"))]
                names = ["row", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(out["ids"], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """counts[l]: pieces of length l -> patterns (lengths, number of sequences that use them) that pack them all."""
    left = counts.astype(np.int64).copy()
    lengths = np.arange(capacity + 1)
    patterns: list[tuple[list[int], int]] = []
    # largest[x]: the largest length at most x of which a piece is left.
    largest = np.maximum.accumulate(np.where(left > 0, lengths, 0))

    def take(length: int, n: int) -> None:
        nonlocal largest
        was = left[length] > 0
        left[length] -= n
        if was != (left[length] > 0):
            largest = np.maximum.accumulate(np.where(left > 0, lengths, 0))

    while largest[capacity]:
        pattern, gap = [], capacity
        while gap and (best := int(largest[gap])):
            pattern.append(best)
            take(best, 1)
            gap -= best
        if gap and len(pattern) > 1:
            smallest = min(pattern)
            room = gap + smallest
            first = np.flatnonzero(left[: room + 1] > 0)
            if len(first):
                second = largest[room - first].copy()
                # The same length twice needs two pieces; else the next smaller one.
                lone = (second == first) & (left[first] < 2)
                below = np.where(first > 0, largest[np.maximum(first - 1, 0)], 0)
                second = np.where(lone, np.minimum(below, second), second)
                total = np.where(second > 0, first + second, 0)
                i = int(total.argmax())
                if total[i] > smallest:
                    pattern.remove(smallest)
                    take(smallest, -1)
                    for x in (int(first[i]), int(second[i])):
                        pattern.append(x)
                        take(x, 1)
        more = min(int(left[x]) // n for x, n in Counter(pattern).items())
        for x, n in Counter(pattern).items():
            if more:
                take(x, more * n)
        patterns.append((sorted(pattern, reverse=True), 1 + more))
    return patterns


def _slots(patterns: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: from which rank on pieces follow a pattern, its first sequence, how many it takes of the
    length, and the offset of the first of them."""
    used: Counter = Counter()
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for pattern, n in patterns:
        offset = 0
        for x, m in sorted(Counter(pattern).items(), reverse=True):
            out.setdefault(x, []).append((used[x], sequence, m, offset))
            used[x] += n * m
            offset += x * m
        sequence += n
    return {x: tuple(np.array(v, dtype=np.int64).T) for x, v in out.items()}


def _place(slots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                rows = np.flatnonzero(length == x)
                start, first, many, base = table[int(x)]
                i = np.searchsorted(start, rank[rows], side="right") - 1
                nth = rank[rows] - start[i]
                sequence[rows], offset[rows] = first[i] + nth // many[i], base[i] + nth % many[i] * x
            columns = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], [*batch.schema.names, "sequence_id", "offset"])

    return run


def pack(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False
) -> DataFrame:
    """A row for each piece of each row of docs: its columns but the text, then piece, start, length, ids_crc32,
    sequence_id, offset and, on demand, ids (binary, little-endian unsigned 32-bit).

    A null or blank text is the end token alone. Only documents longer than `capacity` are cut. Repeated rows are
    packed as often as they are there. Columns of these names are replaced. An empty table gives an empty table."""
    names = ["piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    others = [c for c in docs.columns if c.lower() not in names and c != text_column]
    rows = docs.select(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others))).alias("row"), F.coalesce(text_column, F.lit("")).alias("text"))
    kind = f"row {rows.schema['row'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    pieces = rows.mapInArrow(_pieces(tokenizer or default_tokenizer(), capacity, with_ids), kind)
    pieces = pieces.withColumn("h", F.xxhash64(*([f"row.c{others.index(id_column)}"] if id_column in others else []), "piece", "ids_crc32"))
    # Pieces of a row that is there very often have one hash: where they stand deals them, and is written with them.
    pieces = keep(pieces.withColumn("deal", F.xxhash64("h", F.monotonically_increasing_id())))

    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in pieces.groupBy("length").count().collect():  # one row a length: `capacity` at most
        counts[r.length] = r["count"]
    slots = docs.sparkSession.sparkContext.broadcast(_slots(best_two_fit(counts, capacity)))

    # Ranks within a length: its pieces are dealt over parts by hash, the more the more pieces there are, so that a frequent
    # length is not one task's.
    parts = 1 + int(counts.max()) // RANKED
    pieces = pieces.withColumn("part", F.pmod("deal", F.lit(parts)).cast("int"))
    sizes = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = sizes.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("h", "ids_crc32", "start"))
    ranked = pieces.join(before, ["length", "part"]).withColumn("rank", F.col("before") + within - 1)
    keepers = ["row", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    placed = ranked.select(*keepers, "rank").mapInArrow(_place(slots), kind + ", rank long, sequence_id long, offset long")
    placed = placed.select("row", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "sequence_id", "offset")
    return placed.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(others)), *placed.columns[1:])


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids) of pack(..., with_ids=True): the packed ids themselves, at most `capacity` each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
