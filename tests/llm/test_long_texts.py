"""Texts longer than the chunks that tasks scan at once, and periodic ones."""

import hashlib
import zlib

import numpy as np
import pytest

from loomspan.llm import jaccard_join, lm_score, substring_dedup, suffix_dedup, textscan
from tests.llm.test_operators import covered

RNG = np.random.default_rng(17)
WORDS = ["".join(RNG.choice(list("abcdefghij"), RNG.integers(1, 5))) for _ in range(3000)]


def words(n: int) -> list[str]:
    return [WORDS[i] for i in RNG.integers(0, len(WORDS), n)]


def again(sequence, length: int, extra=()) -> np.ndarray:
    """Which elements are covered by windows found twice in the sequence and the extra ones, by a plain count."""
    counts: dict = {}
    for s in (sequence, *extra):
        for i in range(len(s) - length + 1):
            x = hash(s[i : i + length])
            counts[x] = counts.get(x, 0) + 1
    starts = [i for i in range(len(sequence) - length + 1) if counts[hash(sequence[i : i + length])] > 1]
    gone = np.zeros(len(sequence), bool)
    for i in starts:
        gone[i : i + length] = True
    return gone


def test_suffix_dedup_across_chunks(spark):
    assert textscan.CHUNK == 1 << 20
    text = bytearray(" ".join(words(400_000)).encode()[:1_300_000])
    edge, passage = 1 << 20, bytes(text[5000:5350])
    text[edge - 150 : edge + 200] = passage  # over the edge, and just before and after it
    text[edge - 3000 : edge - 2740] = text[edge + 4000 : edge + 4260]
    text, other = bytes(text), b"tail " + bytes(text[edge - 100 : edge + 240])
    out = {r.doc_id: r for r in suffix_dedup.remove_repeats(spark.createDataFrame([(1, text.decode()), (2, other.decode())], "doc_id long, text string")).collect()}
    for i, s, rest in ((1, text, other), (2, other, text)):
        gone = again(s, 200, [rest])
        kept = bytes(np.frombuffer(s, np.uint8)[~gone])
        assert (out[i].n_removed, out[i].kept_sha256) == (int(gone.sum()), hashlib.sha256(kept).hexdigest())
        assert out[i].n_removed > 300


@pytest.mark.parametrize("period", [1, 7, 96, 150, 333])
def test_suffix_dedup_of_periodic_texts(spark, period):
    unit = "".join(RNG.choice(list("abcdefghijklmnopqrstuvwxyz"), period))
    rows = [(1, (unit * 3000)[:2500] + "the end"), (2, "x" + (unit * 3000)[3:700]), (3, unit * 2), (4, unit[:150])]
    out = {r.doc_id: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sequences = [t.encode() for _, t in rows]
    for (i, _), s, gone in zip(rows, sequences, covered(sequences, 200)):
        assert (out[i].n_removed, out[i].kept_sha256) == (sum(gone), hashlib.sha256(bytes(b for b, g in zip(s, gone) if not g)).hexdigest())


def test_periodic_texts_make_few_rows():
    """A long run of one byte or of a short period is a handful of cuts."""
    import pyarrow as pa

    from loomspan.llm import anchors

    for text in ("a" * 3_000_000, "abcdefg" * 400_000):
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["key", "text"])
        (found,) = anchors._anchor_batches(anchors.same, 200, 96, textscan.byte_codes)(iter([batch]))
        repeated = pa.array([found.column(0).to_pylist()], pa.list_(pa.int64()))
        cuts = list(suffix_dedup._cuts(200, 96)(iter([pa.RecordBatch.from_arrays([*batch.columns, repeated], ["key", "text", "grams"])])))
        assert sum(x.num_rows for x in cuts) < 60 and sum(x.nbytes for x in cuts) < 50_000


def test_word_operators_across_chunks(spark):
    n, edge = (1 << 20) + 60_000, 1 << 20
    w = words(n)
    w[edge - 30 : edge + 30] = w[777:837]  # a passage over the edge
    w[edge + 5000 : edge + 5040] = w[200:240]
    w[50_000:50_200] = ["same"] * 200
    rows = [(1, " ".join(w)), (2, " ".join(w[edge - 40 : edge + 10])), (3, " ".join(w[:-50])), (4, None)]
    docs = spark.createDataFrame(rows[:2] + rows[3:], "doc_id long, text string")
    out = {r.doc_id: r for r in substring_dedup.remove_repeats(docs).collect()}
    ids = {x: i for i, x in enumerate(dict.fromkeys(w))}
    sequences = {i: tuple(ids[x] for x in (t or "").split()) for i, t in rows}
    for i, j in ((1, 2), (2, 1)):
        gone = again(sequences[i], 35, [sequences[j]])
        kept = " ".join(x for x, g in zip(dict(rows)[i].split(), gone) if not g)
        assert (out[i].n_removed, out[i].kept_sha256) == (int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest())
    assert out[1].n_removed > 400
    near = {r.doc_id: r for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert near[1].n_shingles == len({sequences[1][i : i + 5] for i in range(n - 4)})
    assert {i: r.component_id for i, r in near.items()} == {1: 1, 2: 2, 3: 1, 4: 4}


def test_levels_end_where_nothing_survives(spark):
    assert substring_dedup.levels(35, 9) == [18] and substring_dedup.levels(100, 9) == [18, 36, 72] and substring_dedup.levels(36, 9) == [18]
    w = words(600)
    rows = [(i, " ".join(words(50) + w[a:b] + words(50))) for i, (a, b) in enumerate([(0, 150), (20, 170), (300, 420), (305, 420), (500, 520), (500, 520)])]
    for window in (20, 35, 36, 64, 100):
        out = {r.doc_id: r for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=window).collect()}
        sequences = [t.split() for _, t in rows]
        for (i, _), s, gone in zip(rows, sequences, covered(sequences, window)):
            kept = " ".join(x for x, g in zip(s, gone) if not g)
            assert (out[i].n_removed, out[i].kept_sha256) == (sum(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_lm_score_of_a_text_of_many_slices(spark):
    text = " ".join(words(1_300_000))
    assert len(text) > lm_score.SLICE
    one, two = [i for i in range(9) if zlib.crc32(str(i).encode()) % 3 != 1][:2]  # not held out
    labels = spark.createDataFrame([(one, 1), (two, 1)], "doc_id long, quality int")
    docs = spark.createDataFrame([(one, text), (99, "short")], "doc_id long, text string")
    out = {r.doc_id: r for r in lm_score.score(docs, labels).collect()}
    assert out[one].n_tokens == len(text) and abs(out[one].target_loss - 8) < 1e-6 and 0 < out[one].background_loss < 8  # without its own counts the target is empty
    twins = spark.createDataFrame([(one, text), (two, text)], "doc_id long, text string")
    assert all(r.n_tokens == len(text) and 0 < r.target_loss < 8 and abs(r.score) < 0.2 for r in lm_score.score(twins, labels).collect())
