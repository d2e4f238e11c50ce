"""LM scoring by cross-entropy difference.

Two n-gram models over one vocabulary, the bytes, of the target (rows labelled good) and of the background (all rows),
hold exact counts of every gram of the corpus and are smoothed alike: with n(x) for the count of a gram,

    p(e | abcd) = (n(abcde) + SMOOTHING * p(e | cd)) / (n(abcd) + SMOOTHING)
    p(e | cd) = (n(cde) + SMOOTHING / 256) / (n(cd) + SMOOTHING)

They are matched in size by scaling the background's counts to the target's bytes. A document's score is its mean loss
a byte under the target less that under the background: the lower, the more target-like. A row of the target is scored
without its own counts in it, so that rows that were learned from and rows that were not compare.

Rows that follow each other form chunks of CHUNK bytes. A chunk sends each distinct gram once, so that the commonest
gram has as many rows as there are chunks; grams are summed by an exact key (the bytes themselves), and go back to the
chunks that have them, where the rows are scored. What is gathered grows with the input; only two totals are collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.pair_rank import held_out
from loomspan.llm.shared import discard, keep
from loomspan.llm.textscan import text_bytes

ORDER = 5
SMOOTHING = 50.0
#: Bytes of text in a chunk (more only for one longer document), and grams that are sorted at once.
CHUNK, SLICE = 1 << 23, 1 << 21
#: The order of a gram stands above its bytes in its key.
_TAG = np.uint64(8 * ORDER)
_ORDERS = (2, 3, 4, 5)


def _grams(texts: list[np.ndarray], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, the ORDER bytes that end there as one number) for each byte of some texts, a slice at a
    time; before a text there are zeros."""
    before = ORDER - 1

    def flush(pieces: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        data = np.concatenate([x for _, context, piece in pieces for x in (context, piece)]).astype(np.uint64)
        sizes = np.array([len(piece) for _, _, piece in pieces])
        key = data[before:].copy()
        for i in range(1, ORDER):
            key |= data[before - i : len(data) - i] << np.uint64(8 * i)
        at = np.arange(sizes.sum()) + before * np.repeat(np.arange(len(sizes)), sizes)
        return np.repeat(np.array([i for i, _, _ in pieces]), sizes), key[at]

    held, pieces = 0, []
    for i, data in enumerate(texts):
        for start in range(0, len(data), most):
            context = data[start - before : start] if start else np.zeros(before, np.uint8)
            pieces.append((i, context, data[start : start + most]))
            held += len(pieces[-1][2])
            if held >= most:
                yield flush(pieces)
                held, pieces = 0, []
    if pieces:
        yield flush(pieces)


def _parts(grams: np.ndarray) -> Iterator[np.ndarray]:
    """The tagged keys of the grams that a gram's loss needs, order by order."""
    short = np.uint64(8)
    for order, x in zip(_ORDERS, ((grams >> short) & np.uint64(0xFFFF), grams & np.uint64(0xFFFFFF), grams >> short, grams)):
        yield x | np.uint64(order) << _TAG


def tally(texts: list[np.ndarray], target: list[bool], most: int = SLICE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys of all orders of some texts, with their counts in the target and in all."""
    flags, found, one = np.array(target, dtype=np.uint64), [], np.uint64(1)
    for number, key in _grams(texts, most):
        key = np.sort(key << one | flags[number])  # sorting plain numbers is many times faster than sorting places
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        found.append((key[edge], np.diff(np.append(edge, len(key)))))
    key, n = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
    out = []
    for part in _parts(key >> one):
        distinct, which = np.unique(part, return_inverse=True)
        out.append((distinct, np.bincount(which, n * (key & one).astype(np.int64), len(distinct)), np.bincount(which, n, len(distinct))))
    keys, good, everything = (np.concatenate(x) for x in zip(*out))
    return keys, good.astype(np.int64), everything.astype(np.int64)


def losses(texts: list[np.ndarray], keys: np.ndarray, counts: np.ndarray, most: int = SLICE) -> np.ndarray:
    """Mean loss a byte of each text, in bits, by the counts of the sorted keys (all that the texts have)."""
    out, place = np.zeros(len(texts)), np.uint64(24)
    for number, key in _grams(texts, most):
        # The text stands below the gram, so that one plain sort gives each gram its texts.
        low = int(number[0])
        key = np.sort(key << place | (number - low).astype(np.uint64))
        gram = key >> place
        edge = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
        pair, triple, four, five = (counts[np.searchsorted(keys, x)] for x in _parts(gram[edge]))
        prior = (triple + SMOOTHING / 256) / (pair + SMOOTHING)
        loss = -np.log2((five + SMOOTHING * prior) / (four + SMOOTHING))
        where = (key & np.uint64((1 << 24) - 1)).astype(np.int64) + low
        out += np.bincount(where, np.repeat(loss, np.diff(np.append(edge, len(key)))), len(texts))
    return out / np.maximum(1, [len(x) for x in texts])


def _chunked(most: int):
    """(text, target, row, at) with at, which names a row, replaced by the at of its chunk's first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held = None, 0
        for batch in batches:
            at, out = batch.column(3).to_pylist(), []
            for a, size in zip(at, map(len, text_bytes(batch.column(0)))):
                if first is None or held + size > most:
                    first, held = a, 0
                held += size
                out.append(first)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.int64())], ["text", "target", "row", "chunk"])

    return run


def _counts(most: int):
    """(text, target, chunk) -> (key, chunk, target, background), once for each key of the rows of a chunk that follow
    each other."""

    def send(texts: list[np.ndarray], target: list[bool], chunk: int) -> Iterator[pa.RecordBatch]:
        keys, *counts = tally(texts, target, most)
        for i in range(0, len(keys), 1 << 16):
            columns = [x[i : i + (1 << 16)] for x in (keys.view(np.int64), np.full(len(keys), chunk), *counts)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "chunk", "target", "background"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, target, chunk = [], [], None
        for batch in batches:
            for data, good, at in zip(text_bytes(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if texts and at != chunk:
                    yield from send(texts, target, chunk)
                    texts, target = [], []
                chunk = at
                texts.append(data)
                target.append(good)
        if texts:
            yield from send(texts, target, chunk)

    return run


def without_own(text: np.ndarray, keys: np.ndarray, counts: np.ndarray, most: int = SLICE) -> float:
    """Mean loss a byte of a text by counts that have its own in them, which are taken out."""
    mine, own, _ = tally([text], [True], most)
    return float(losses([text], mine, counts[np.searchsorted(keys, mine)] - own, most)[0])


def _scores(tokens: tuple[int, int], most: int):
    """The rows of a chunk, and the counts of its keys that other chunks have too, -> losses."""

    def run(rows: pa.Table, counted: pa.Table) -> pa.Table:
        texts, good = text_bytes(rows["text"]), rows["target"].to_pylist()
        keys, *counts = tally(texts, good, most)
        at = np.searchsorted(keys, counted["key"].to_numpy().view(np.uint64))
        out = []
        for name, own, total in zip(("target", "background"), counts, tokens):
            own[at] = counted[name].to_numpy()
            found = losses(texts, keys, own * (tokens[0] / total if total else 0.0), most)
            if name == "target":  # its counts are as they are: it is the size that both are brought to
                for i in np.flatnonzero(good):
                    found[i] = without_own(texts[i], keys, own, most)
            out.append(pa.array(found))
        return pa.table([rows["row"], pa.array([len(x) for x in texts], pa.int64()), *out], ["row", "n_tokens", "target_loss", "background_loss"])

    return run


def score(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", chunk: int = CHUNK, most: int = SLICE) -> DataFrame:
    """Each row of docs, without its text, with n_tokens (bytes), target_loss, background_loss (bits a byte) and score
    (their difference).

    The target is what labels(doc_id, quality) calls good, but for the rows that are held out of learning; each of its rows
    is scored without its own counts, but with those of its copies. Null and
    empty texts have no loss and score 0. Without good rows the target is the prior of an empty model. Repeated rows
    count and score as often as they are there; a very long text is a chunk of its own, counted a slice at a time;
    columns of these names are replaced. An empty table gives an empty one."""
    new = ["n_tokens", "target_loss", "background_loss", "score"]
    others = [c for c in docs.columns if c.lower() not in new and c != text_column]
    row = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)))
    texts = docs.select(F.coalesce(text_column, F.lit("")).alias("text"), F.col(id_column).alias("doc_id"), row.alias("row"))
    good = labels.where((F.col("quality") == 1) & ~held_out()).select("doc_id", F.lit(True).alias("good")).distinct()
    # Labels grow with the corpus: they are never broadcast, so that the plan is the same at every size.
    marked = texts.join(good.hint("merge"), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("target"), "row", F.monotonically_increasing_id().alias("at"))
    kind = marked.schema["row"].dataType.simpleString()
    marked = keep(marked.mapInArrow(_chunked(chunk), f"text string, target boolean, row {kind}, chunk long"))  # chunks must not change any more

    every = Window.partitionBy("key")
    counted = marked.select("text", "target", "chunk").mapInArrow(_counts(most), "key long, chunk long, target long, background long").select(
        "key", "chunk", F.sum("target").over(every).alias("target"), F.sum("background").over(every).alias("background"), F.col("background").alias("own")
    )
    # What one chunk alone has it counts again by itself.
    counted = keep(counted.where("background > own").drop("own"))
    size = F.octet_length("text")
    total = marked.agg(F.sum(F.when(F.col("target"), size)), F.sum(size)).first()
    scores = _scores((total[0] or 0, total[1] or 0), most)
    done = marked.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(scores, f"row {kind}, n_tokens long, target_loss double, background_loss double")
    out = keep(done)
    discard(marked, counted)
    return out.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(others)), *new[:3], (F.col("target_loss") - F.col("background_loss")).alias("score"))
