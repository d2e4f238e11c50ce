"""Finding where repeats can be: window minimisers that occur twice.

Equal windows have the same minimising gram at the same place, so a window can only be repeated if its
gram is. About one gram in (grams a window)/2 is a minimiser, and a few per cent of those are repeated, so
that what is shuffled is a small part of the positions. Used by the substring and suffix-array operators.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.shared import keep
from loomspan.llm.textscan import chunks, minimisers, prefix_sums, text_bytes, window_hashes

#: Turns the bytes of a text into its units (bytes or word codes), and units into 64-bit codes, a chunk at a time.
Coder = Callable[[np.ndarray], np.ndarray]


def same(x: np.ndarray) -> np.ndarray:
    return x


def scan(units: np.ndarray, window: int, gram: int, code: Coder = same) -> Iterator[tuple]:
    """(offset, sums, grams, anchor, first, last) for each piece of a sequence: the prefix sums and gram hashes of the
    piece that begins at offset, and its minimisers with the first and last window that choose them."""
    if len(units) < window:
        return
    for start, end in chunks(len(units), window):
        sums = prefix_sums(code(units[start:end]))
        grams = window_hashes(sums, gram)
        yield (start, sums, grams, *minimisers(grams, window - gram + 1))


def _anchor_batches(coder: Coder, window: int, gram: int, code: Coder):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = batch.column(0).to_numpy(zero_copy_only=False), []
            for key, data in zip(keys, text_bytes(batch.column(1))):
                for _, _, grams, anchor, _, _ in scan(coder(data), window, gram, code):
                    h, n = np.unique(grams[anchor], return_counts=True)  # one row even where a text repeats itself
                    found.append((h, np.full(len(h), key), n))
            if found:
                h, key, n = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(key), pa.array(n)], ["h", "key", "n"])

    return run


def repeated_anchors(docs: DataFrame, coder: Coder, window: int, gram: int, code: Coder = same) -> DataFrame:
    """docs(key, text) with the hashes of their anchors that occur at least twice: (key, text, grams array<long>).

    A first pass counts gram hashes (partially aggregated); a second joins the anchors with those found twice,
    an equi-join of two plain shuffles that AQE can split where one gram is very frequent."""
    anchors = docs.select("key", "text").mapInArrow(_anchor_batches(coder, window, gram, code), "h long, key long, n long")
    twice = keep(anchors.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"))
    hits = anchors.select("h", "key").join(twice, "h").groupBy("key").agg(F.collect_list("h").alias("grams"))
    return docs.join(hits, "key")


def is_repeated(grams: np.ndarray, anchor: np.ndarray, repeated: pa.Scalar) -> np.ndarray:
    """Which anchors have one of the repeated grams of their text."""
    return np.isin(grams[anchor], np.asarray(repeated.values).view(np.uint64))


def spans_to_rows(spans: DataFrame) -> DataFrame:
    """(key, low, high) as (key, spans array): bounded by the length of one document."""
    return spans.groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
