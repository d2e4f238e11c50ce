"""Quality classifier by Bradley-Terry pairwise ranking.

Every pair of a labelled good and a labelled bad document is a preference; the score is linear in a text's features,
and its weights minimise the logistic loss on feature differences. The threshold is the quantile, at the share of bad
labels, of the scores of all labelled rows that aren't held out; the published score is the logistic function of the
distance to it.

Features are of the text alone: the histogram of its bytes and a dozen measures of words, lines and repetition. The fit
of the weights takes a bounded sample of labelled documents (SAMPLE, in order of a hash of the id) and of their pairs
(PAIRS, drawn at random from all good and bad ones of the sample); the threshold and the scores take all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.fertility import duplicate_lines, repeated_words
from loomspan.llm.shared import keep, passing
from loomspan.llm.textscan import text_bytes, word_codes, word_spans

#: Labelled documents, and pairs of them, that the weights are fitted on, at most.
SAMPLE = 12_000
PAIRS = 60_000
_DIGIT, _UPPER, _STOP, _SYMBOL = (np.isin(np.arange(256), list(x)) for x in (b"0123456789", bytes(range(65, 91)), b".,;:!?", b"#*$%&|<>{}[]=_~^\\/"))


def features(data: np.ndarray) -> np.ndarray:
    """Of one text's UTF-8 bytes; an empty text has zeros."""
    bytes_ = np.bincount(data, minlength=256).astype(np.float64)
    size = max(1, len(data))
    starts, ends = word_spans(data)
    n = max(1, len(starts))
    codes = word_codes(data, starts, ends)
    lengths = ends - starts
    last = data[ends - 1] if len(ends) else data[:0]
    lines = 1 + int(bytes_[10])
    own = np.array([
        np.log1p(len(starts)), lengths.mean() if len(starts) else 0.0, lengths.std() if len(starts) else 0.0, (lengths <= 1).mean() if len(starts) else 0.0,
        len(np.unique(codes)) / n, repeated_words(codes) / n, duplicate_lines(data.tobytes()) / lines, np.log1p(n / lines),
        bytes_[_DIGIT].sum() / size, bytes_[_UPPER].sum() / size, bytes_[_STOP].sum() / n, bytes_[_SYMBOL].sum() / n,
        _STOP[last].mean() if len(last) else 0.0, _SYMBOL[last].mean() if len(last) else 0.0, _UPPER[data[starts]].mean() if len(starts) else 0.0,
    ])
    return np.concatenate((own, own**2, np.sqrt(bytes_ / size))).astype(np.float32)


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def rank(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.rank(x) - self.threshold, -30, 30)))


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, rounds: int = 200, decay: float = 1e-3, seed: int = 5) -> Ranker:
    """From features and labels; without both labels every score is one half."""
    if not good.any() or good.all():
        d = x.shape[1]
        return Ranker(np.zeros(d), np.ones(d), np.zeros(d), 0.0)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    a, b = rng.choice(np.flatnonzero(good), pairs), rng.choice(np.flatnonzero(~good), pairs)
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for i in range(1, rounds + 1):  # Adam on mini-batches of pairs
        part = rng.integers(0, pairs, 2000)
        d = z[a[part]] - z[b[part]]
        g = -(d * (1 / (1 + np.exp(np.clip(d @ w, -30, 30))))[:, None]).mean(0) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.05 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    scores = z @ w
    return Ranker(mean, scale, w, float(np.quantile(scores, (~good).mean())))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, doc_id, good) -> (doc_id, good, x)."""
    for batch in batches:
        x = [features(data).tobytes() for data in text_bytes(batch.column(0))]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(x, pa.binary())], ["doc_id", "good", "x"])


def _ranks(ranker: Ranker):
    """(text, doc_id) -> (doc_id, z)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(data) for data in text_bytes(batch.column(0))]
            z = ranker.rank(np.stack(x)) if x else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(z.astype(np.float64))], ["doc_id", "z"])

    return run


def _scores(ranker: Ranker):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(data) for data in text_bytes(batch.column(0))]
            scores = ranker.score(np.stack(x)) if x else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(scores.astype(np.float64))], ["row", "score"])

    return run


def held_out(id_column: str = "doc_id") -> F.Column:
    """Whether crc32 of the id as text leaves 1 on division by 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ranker:
    """From labels(doc_id, quality) of rows that aren't held out; null labels are none, and of several labels of one
    document the highest counts. Repeated rows of a document are one in the fit of the weights."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    found = texts.join(F.broadcast(chosen), "doc_id").select("text", "doc_id", "good")  # `sample` rows of 9 bytes
    # One row for each document of the sample, however often it is there, so that `sample` rows come to the driver.
    rows = found.mapInArrow(_features, "doc_id long, good boolean, x binary").groupBy("doc_id", "good").agg(F.min("x").alias("x")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    if not rows:
        return fit(np.zeros((1, len(features(np.empty(0, np.uint8))))), np.zeros(1, dtype=bool))
    ranker = fit(np.frombuffer(b"".join(bytes(r.x) for r in rows), np.float32).reshape(len(rows), -1), np.array([r.good for r in rows]))
    if not ranker.weights.any():
        return ranker
    with passing():
        ranked = keep(texts.mapInArrow(_ranks(ranker), "doc_id long, z double").join(known, "doc_id"))
        bad = ranked.agg(F.avg((~F.col("good")).cast("double"))).first()[0]
        ranker.threshold = float(ranked.agg(F.percentile_approx("z", F.lit(bad), F.lit(100_000))).first()[0])
    return ranker


def classify(docs: DataFrame, ranker: Ranker, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False) -> DataFrame:
    """Each row of docs (without its text, unless with_text) with held_out, score (0 to 1) and predicted.

    A null text scores as an empty one; a null id is never held out. Repeated rows score alike. Columns of these names are replaced. An empty
    table gives an empty table."""
    new = ["held_out", "score", "predicted"]
    others = [c for c in docs.columns if c.lower() not in new and (with_text or c != text_column)]
    row = F.struct(held_out(id_column).alias("held_out"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)))
    rows = docs.select(F.coalesce(text_column, F.lit("")).alias("text"), row.alias("row"))
    out = rows.mapInArrow(_scores(ranker), f"row {rows.schema['row'].dataType.simpleString()}, score double")
    return out.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(others)), "row.held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
