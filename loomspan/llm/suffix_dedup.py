"""Suffix-array dedup over bytes: two-stage suffix sorting within buckets of text that can hold equal strings.

Equal 200-byte strings have the same minimising 96-byte gram at the same place (see anchors.py). Around each gram
that occurs twice the text of its windows is cut out (300 bytes at most); equal cuts are pre-aggregated into one with
a weight. The cuts of one gram form a bucket. A bucket with many different cuts is dealt anew, by the bytes that eight
neighbouring windows share, and where that is not enough by single windows, so that a very frequent passage in ever new surroundings doesn't meet in one task.
Each task then builds the suffix array of its buckets (suffix_sort.py), a few megabytes at a time, and takes the
adjacent common prefixes of 200 bytes and more.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm import anchors
from loomspan.llm.shared import keep, passing, row_key
from loomspan.llm.substring_dedup import _ranges
from loomspan.llm.suffix_sort import repeated_starts
from loomspan.llm.textscan import byte_codes, merge_ranges, range_hash, text_bytes

WINDOW = 200
GRAM = 96
#: A bucket with more different cuts than this is dealt anew by smaller cuts: so many are 1.2 MB, which one suffix array holds.
BUCKET = 4096
#: Windows in a smaller cut, and in the cuts of buckets that are crowded still.
STEPS = (8, 1)
#: Bytes of whole buckets that one suffix array holds (a single larger bucket is still one array).
SORTED_BYTES = 2_000_000
#: Bytes of cuts that leave a task together, besides those of one chunk of a text.
BATCH_BYTES = 1 << 24


def _cuts(window: int, gram: int):
    """From (key, text, grams) a row for each kind of repeated anchor in a text: its windows [low, high], the bytes
    they cover and how often (n) the text has them. Where that is twice or more the windows are known to be repeated:
    rows without a cut have such ranges [low, high) as maximal runs. So periodic text makes few rows."""

    def row_batch(found: list[tuple], cuts: list) -> pa.RecordBatch:
        key, h, low, high, at, n = (np.concatenate(x) for x in zip(*found))
        kinds = (key, h.view(np.int64), low.astype(np.int32), high.astype(np.int32), at.astype(np.int32), n)
        return pa.RecordBatch.from_arrays([*map(pa.array, kinds), pa.array(cuts, pa.binary())], ["key", "h", "low", "high", "at", "n", "cut"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, cuts, held = [], [], 0
            for key, data, repeated in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2)):
                for start, sums, grams, anchor, first, last in anchors.scan(data, window, gram, byte_codes):
                    ok = anchors.is_repeated(grams, anchor, repeated)
                    p, a, b = anchor[ok], first[ok], last[ok]
                    if not len(p):
                        continue
                    # Equal kinds: the gram, its place and the bytes, by hashes of 128 bits together.
                    h, whole = grams[p], range_hash(sums, a, b + window) + (p - a).astype(np.uint64)
                    order = np.lexsort((whole, h))
                    p, a, b, h, whole = p[order], a[order], b[order], h[order], whole[order]
                    one = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (whole[1:] != whole[:-1]))))
                    n = np.diff(np.append(one, len(p)))
                    again = np.repeat(n > 1, n)
                    low, high = merge_ranges(a[again], b[again] + window)
                    found.append([np.full(len(one), key), grams[p[one]], a[one] + start, b[one] + start, p[one] - a[one], n])
                    found.append([np.full(len(low), key), np.zeros(len(low), np.uint64), low + start, high + start, np.zeros(len(low), int), np.zeros(len(low), int)])
                    # A column of bytes has 2 GB at most: the first rows go before too many are held.
                    for x, y in zip(a[one].tolist(), b[one].tolist()):
                        cuts.append(data[start + x : start + y + window].tobytes())
                        held += len(cuts[-1])
                    cuts += [None] * len(low)
                    if held > BATCH_BYTES:
                        yield row_batch(found, cuts)
                        found, cuts, held = [], [], 0
            if found:
                yield row_batch(found, cuts)

    return run


def _repeats(window: int):
    """From (bucket, cut, n), sorted by bucket, the cuts' ranges of repeated windows: (bucket, cut, low, high)."""

    def sort(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        strings = [r[1] for r in rows]
        out: list[tuple] = []
        for (bucket, cut, _), starts in zip(rows, repeated_starts(strings, np.array([r[2] for r in rows], dtype=float), window)):
            if len(starts):
                edge = np.flatnonzero(np.diff(starts) > 1)
                for a, b in zip(starts[np.concatenate(([0], edge + 1))].tolist(), starts[np.concatenate((edge, [len(starts) - 1]))].tolist()):
                    out.append((bucket, cut, a, b))
        if out:
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["bucket", "cut", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for bucket, cut, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held >= SORTED_BYTES and rows[-1][0] != bucket:
                    yield from sort(rows)
                    rows, held = [], 0
                rows.append((bucket, cut, n))
                held += len(cut)
        if rows:
            yield from sort(rows)

    return run


def _suffix_stage(buckets: DataFrame, window: int) -> DataFrame:
    """(bucket, cut, low, high) of the repeated windows within each bucket of buckets(bucket, cut, n)."""
    dealt = buckets.select("bucket", "cut", "n").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_repeats(window), "bucket long, cut binary, low int, high int")


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(key, low, high): byte ranges [low, high) of docs(key, text) whose windows all begin at another place too."""
    rows = anchors.repeated_anchors(docs, anchors.same, window, gram, byte_codes).select("key", "text", "grams").mapInArrow(
        _cuts(window, gram), "key long, h long, low int, high int, at int, n long, cut binary"
    )
    # Equal cuts with their anchor at the same place hold the same windows. They are told apart by h, at and the bytes.
    rows = keep(rows)
    cuts, known = rows.where("cut is not null"), rows.where("cut is null").select("key", "low", "high")
    kinds = keep(cuts.groupBy("h", "at", "cut").agg(F.sum("n").alias("n")))
    large = keep(_crowded(kinds.select(F.col("h").alias("bucket"))))
    small = kinds.select(F.col("h").alias("bucket"), "cut", "n").join(large, "bucket", "left_anti")
    found = [_suffix_stage(small, window).select(F.col("bucket").alias("h"), F.xxhash64("cut").alias("c"), F.col("low").alias("from"), F.col("high").alias("to"))]
    left = kinds.join(large.withColumnRenamed("bucket", "h"), "h").select("h", F.xxhash64("cut").alias("c"), F.lit(0).alias("start"), "at", "cut", "n")
    for step in STEPS:
        pieces = keep(_pieces(left, window, step))
        distinct = pieces.groupBy("bucket", "cut").agg(F.sum("n").alias("n"))
        if step > 1:  # pieces of one window are alike throughout their bucket
            large = keep(_crowded(distinct.select("bucket")))
            left = pieces.join(large, "bucket").drop("bucket")
            distinct = distinct.join(large, "bucket", "left_anti")
        hits = keep(_suffix_stage(distinct, window))
        found.append(pieces.join(hits, ["bucket", "cut"]).select("h", "c", (F.col("start") + F.col("low")).alias("from"), (F.col("start") + F.col("high")).alias("to")))
    # Back to the documents: a cut is known by the hashes of its gram and of its bytes, 128 bits.
    found = keep(functools.reduce(DataFrame.unionByName, found))
    return known.unionByName(cuts.where("n = 1").select("key", "low", "h", F.xxhash64("cut").alias("c")).join(found, ["h", "c"]).select(
        "key", (F.col("low") + F.col("from")).alias("low"), (F.col("low") + F.col("to") + window).alias("high")
    ))


def _crowded(rows: DataFrame) -> DataFrame:
    """Buckets with more rows than one task should sort together."""
    return rows.groupBy("bucket").agg(F.count("*").alias("kinds")).where(F.col("kinds") > BUCKET).select("bucket")


def _pieces(cuts: DataFrame, window: int, step: int) -> DataFrame:
    """(h, c, start, at, cut, n) cut further, `step` windows each, and dealt by the bytes that those windows share.

    Pieces keep to a grid relative to the anchor, so that equal windows are in pieces of the same place; c and start
    still tell the whole cut and the place in it."""
    windows = F.length("cut") - window + 1
    cells = F.sequence(F.floor((F.lit(0) - F.col("at")) / step).cast("int"), F.floor((windows - 1 - F.col("at")) / step).cast("int"))
    first = F.col("cell") * step + F.col("at")
    begin, end = F.greatest(F.lit(0), first), F.least(windows - 1, first + step - 1)
    core = F.substring("cut", first + step, F.lit(window - step + 1))
    x = cuts.withColumn("cell", F.explode(cells))
    return x.select("h", "c", (F.col("start") + begin).alias("start"), (F.col("at") - begin).alias("at"), F.substring("cut", begin + 1, end - begin + window).alias("cut"), "n", F.xxhash64("h", "cell", core).alias("bucket"))


def _without(with_text: bool):
    """From (text, spans, row) the row, its counts and the bytes that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
        kinds |= {"kept_bytes": pa.binary()} if with_text else {}
        for batch in batches:
            out: dict[str, list] = {x: [] for x in kinds}
            for data, spans in zip(text_bytes(batch.column(0)), batch.column(1)):
                raw = data.tobytes()
                low, high = _ranges(spans, len(raw))
                kept = b"".join([raw[a:b] for a, b in zip([0, *high.tolist()], [*low.tolist(), len(raw)])])
                found = (len(raw), len(raw) - len(kept), len(low), hashlib.sha256(kept).hexdigest(), kept)
                for name, x in zip(kinds, found):
                    out[name].append(x)
            yield pa.RecordBatch.from_arrays([batch.column(2), *(pa.array(out[x], k) for x, k in kinds.items())], ["row", *kinds])

    return run


def remove_repeats(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, gram: int = GRAM, with_bytes: bool = True
) -> DataFrame:
    """Each row of docs with the bytes of repeated windows removed.

    The text column gives way to n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, unless
    with_bytes is false, kept_bytes (binary: a cut can fall inside a character); other columns of these names are
    replaced, the rest is kept. A null text is empty. The id tells documents apart (null ids are told apart by their
    text); a row that is there twice counts twice, so that its windows are repeats. An empty table gives an empty table."""
    if window % 8 or not 0 < gram <= window:
        raise ValueError("the window must be a multiple of eight and hold the gram")
    names = ["n_bytes", "n_removed", "n_spans", "kept_bytes", "kept_sha256"]
    others = [c for c in docs.columns if c.lower() not in names and c != text_column]
    keyed = docs.select(
        row_key(id_column, text_column).alias("key"), F.coalesce(text_column, F.lit("")).alias("text"),
        F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others))).alias("row"),
    )
    with passing() as stay:
        spans = stay(keep(anchors.spans_to_rows(repeated_spans(keyed.select("key", "text"), window, gram))))
    joined = keyed.join(spans, "key", "left").select("text", "spans", "row")
    schema = f"row {joined.schema['row'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    out = joined.mapInArrow(_without(with_bytes), schema + ", kept_bytes binary" * with_bytes)
    kept = ["kept_bytes"] * with_bytes
    return out.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(others)), "n_bytes", "n_removed", "n_spans", *kept, "kept_sha256")
