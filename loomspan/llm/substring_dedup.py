"""Substring dedup by level-wise doubling over words.

Windows that are repeated at one length alone are extended to twice that length: from 9 words to 18 and so on, and at
last to the full window (35 words: two halves of 18 that overlap by one), until no candidates survive or the window is
reached. At each level a window survives only if its hash is found twice, and a level is evaluated only around the
survivors of the one before. Longer levels need no look: a longer repeat is a run of repeated full windows.

The first level looks only at window minimisers (see anchors.py), which loses nothing. At the last level runs of
windows with one anchor are first compared whole, so that copies are pre-aggregated; only runs that are found once but
share their anchor with another run are compared window by window. Each comparison uses 128 bits (the anchor's
and the run's or window's hash). Very frequent passages are counted by partial aggregates and joined by plain
equi-joins that AQE may split; no group is collected but the spans of one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm import anchors
from loomspan.llm.shared import discard, keep, passing, row_key
from loomspan.llm.textscan import merge_ranges, mix, range_hash, text_bytes, window_hashes, word_codes, word_spans

WINDOW = 35
SEED = 9


def _words(data: np.ndarray) -> np.ndarray:
    return word_codes(data, *word_spans(data))


_RUNS = "key long, h long, at int, low int, high int, run long, sides array<long>, windows array<long>"


def levels(window: int, seed: int) -> list[int]:
    """Lengths between the seed and the window, each twice the one before."""
    out = [2 * seed]
    while 2 * out[-1] < window:
        out.append(2 * out[-1])
    return out


def _sides(sums: np.ndarray, at: np.ndarray, seed: int, lengths: list[int]) -> np.ndarray:
    """For each level the hashes of the words of that length that end and that begin with the anchor's gram; 0 where
    the text ends before."""
    n, out = len(sums) - 1, np.zeros((len(at), 2 * len(lengths)), np.uint64)
    for i, length in enumerate(lengths):
        for side, begin in ((2 * i, at + seed - length), (2 * i + 1, at)):
            fits = (begin >= 0) & (begin + length <= n)
            out[fits, side] = range_hash(sums, begin[fits], begin[fits] + length) | np.uint64(1)
    return out


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _runs(window: int, seed: int):
    """From (key, text, grams) a row for each repeated anchor: its windows [low, high], the hashes of the longer grams to
    either side, of the whole run and of each window."""
    lengths = levels(window, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {x: [] for x in ("key", "h", "at", "low", "high", "run")}
            sides, windows, sizes = [], [], []
            for key, data, repeated in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2)):
                for start, sums, grams, anchor, first, last in anchors.scan(_words(data), window, seed):
                    ok = anchors.is_repeated(grams, anchor, repeated)
                    p, a, b = anchor[ok], first[ok], last[ok]
                    if not len(p):
                        continue
                    # A window is its two halves of the level before, which overlap.
                    half = window_hashes(sums, lengths[-1])
                    each = mix(half[: len(sums) - window] + mix(half[window - lengths[-1] :]))
                    counts = b - a + 1
                    index = np.repeat(a - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
                    whole = range_hash(sums, a, b + window) + (p - a).astype(np.uint64)
                    for name, x in (("key", np.full(len(p), key)), ("h", grams[p]), ("run", whole)):
                        out[name].append(x.view(np.int64))
                    for name, x in (("at", p + start), ("low", a + start), ("high", b + start)):
                        out[name].append(x.astype(np.int32))
                    sides.append(_sides(sums, p, seed, lengths))
                    windows.append(each[index])
                    sizes.append(counts)
            if sides:
                n = sum(map(len, sides))
                lists = [_lists(np.concatenate(sides).ravel(), np.full(n, 2 * len(lengths))), _lists(np.concatenate(windows), np.concatenate(sizes))]
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x)) for x in out.values()), *lists], [*out, "sides", "windows"])

    return run


def _survivors(alive: DataFrame, level: int, length: int, window: int, seed: int) -> DataFrame:
    """The windows of alive that hold no gram of that length, on either side of the anchor, that is found once."""
    left, right = F.col("sides")[2 * level], F.col("sides")[2 * level + 1]
    twice = alive.select(F.explode(F.array(left, right)).alias("g")).where("g <> 0").groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
    marks = keep(twice.select("g", F.lit(True).alias("twice")))
    x = alive.withColumns({"left": left, "right": right})
    for side in ("left", "right"):
        x = x.join(marks.select(F.col("g").alias(side), F.col("twice").alias(f"{side}_ok")), side, "left")
    # A window holds the left gram if it starts early enough, and the right one if it ends late enough.
    low = F.when(F.col("left_ok"), F.col("low")).otherwise(F.greatest("low", F.col("at") + (seed - length + 1)))
    high = F.when(F.col("right_ok"), F.col("high")).otherwise(F.least("high", F.col("at") + (length - window - 1)))
    x = x.withColumns({"l": low, "u": high}).where("l <= u")
    windows = F.slice("windows", F.col("l") - F.col("low") + 1, F.col("u") - F.col("l") + 1).alias("windows")
    out = keep(x.select("key", "h", "at", F.col("l").alias("low"), F.col("u").alias("high"), "run", "sides", windows))
    discard(marks)
    return out


def repeated_spans(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(key, low, high): word ranges [low, high) of docs(key, text) whose windows all occur at least twice."""
    if window <= 2 * seed:
        raise ValueError("the window must be longer than the doubled seed")
    at_seed = anchors.repeated_anchors(docs, _words, window, seed)
    alive = keep(at_seed.select("key", "text", "grams").mapInArrow(_runs(window, seed), _RUNS))
    for level, length in enumerate(levels(window, seed)):
        before, alive = alive, _survivors(alive, level, length, window, seed)
        discard(before)
        if alive.isEmpty():
            break

    # Last level, whole runs first: copies count together.
    alive = alive.withColumn("place", F.xxhash64("key", "low"))
    distinct = keep(alive.groupBy("h", "run").agg(F.count("*").alias("n"), F.min("place").alias("place")))
    shared = keep(distinct.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1").select("h"))
    copies = alive.join(keep(distinct.where("n > 1").select("h", "run")), ["h", "run"], "left_semi").select("key", "low", "high")
    # Then the windows of runs found once whose anchor is in other runs too; one row stands for each kind of run.
    kinds = distinct.join(shared, "h", "left_semi")
    once = keep(alive.join(keep(kinds.where("n = 1").select("h", "run")), ["h", "run"], "left_semi"))
    many = alive.join(keep(kinds.where("n > 1")), ["h", "run", "place"])  # the one that stands for its kind
    single = once.select("key", "h", "low", F.posexplode("windows").alias("i", "w"))
    counts = (
        single.select("h", "w", F.lit(1).cast("long").alias("n"))
        .unionByName(many.select("h", F.explode("windows").alias("w"), "n"))
        .groupBy("h", "w").agg(F.sum("n").alias("n")).where("n > 1").select("h", "w")
    )
    windows = single.join(keep(counts), ["h", "w"], "left_semi").select("key", (F.col("low") + F.col("i")).alias("low"))
    return copies.select("key", "low", (F.col("high") + window).alias("high")).unionByName(
        windows.select("key", "low", (F.col("low") + window).alias("high"))
    )


def _without(with_text: bool):
    """From (text, spans, row) the row, its counts and what stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"n_words": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
        kinds |= {"kept_text": pa.binary()} if with_text else {}
        for batch in batches:
            out: dict[str, list] = {x: [] for x in kinds}
            for data, spans in zip(text_bytes(batch.column(0)), batch.column(1)):
                starts, ends = word_spans(data)
                n, raw = len(starts), data.tobytes()
                low, high = _ranges(spans, n)
                gone = np.zeros(n + 1, dtype=np.int8)
                gone[low] += 1
                gone[high] -= 1
                kept = np.cumsum(gone[:n]) == 0
                text = b" ".join([raw[a:b] for a, b in zip(starts[kept].tolist(), ends[kept].tolist())])
                sha = hashlib.sha256(text).hexdigest()
                if with_text:  # the rest as it stands, without the removed words and the white space after them
                    next_ = np.concatenate((starts, [len(raw)]))
                    text = b"".join([raw[a:b] for a, b in zip([0, *next_[high].tolist()], [*next_[low].tolist(), len(raw)])])
                found = (n, n - int(kept.sum()), len(low), sha, text)
                for name, x in zip(kinds, found):
                    out[name].append(x)
            yield pa.RecordBatch.from_arrays([batch.column(2), *(pa.array(out[x], k) for x, k in kinds.items())], ["row", *kinds])

    return run


def _ranges(spans: pa.Scalar, n: int) -> tuple[np.ndarray, np.ndarray]:
    if not spans.is_valid or not len(spans.values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    low = np.asarray(spans.values.field("low")).astype(np.int64)
    high = np.minimum(np.asarray(spans.values.field("high")).astype(np.int64), n)
    return merge_ranges(low[low < high], high[low < high])


def remove_repeats(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, seed: int = SEED, with_text: bool = True
) -> DataFrame:
    """Each row of docs with the words of repeated windows removed.

    The text column gives way to n_words, n_removed, n_spans (maximal removed runs), kept_sha256 (of the kept words
    joined by one space) and, unless with_text is false, kept_text (the text without the removed words and the white
    space after each run); other columns of these names are replaced, the rest is kept as it is. A null or blank text has no words. The id tells documents apart (null ids are told
    apart by their text); a row that is there twice counts twice, so that its windows are repeats. An empty table
    gives an empty table."""
    names = ["n_words", "n_removed", "n_spans", "kept_text", "kept_sha256"]
    others = [c for c in docs.columns if c.lower() not in names and c != text_column]
    keyed = docs.select(
        row_key(id_column, text_column).alias("key"), F.coalesce(text_column, F.lit("")).alias("text"),
        F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others))).alias("row"),
    )
    with passing() as stay:
        spans = stay(keep(anchors.spans_to_rows(repeated_spans(keyed.select("key", "text"), window, seed))))
    joined = keyed.join(spans, "key", "left").select("text", "spans", "row")
    schema = f"row {joined.schema['row'].dataType.simpleString()}, n_words long, n_removed long, n_spans long, kept_sha256 string"
    out = joined.mapInArrow(_without(with_text), schema + ", kept_text binary" * with_text)
    text = [F.col("kept_text").cast("string").alias("kept_text")] * with_text
    return out.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(others)), "n_words", "n_removed", "n_spans", *text, "kept_sha256")
