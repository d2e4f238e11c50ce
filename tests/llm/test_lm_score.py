"""Cross-entropy difference against models that are counted gram by gram."""

import collections
import math
import zlib

import numpy as np
import pytest

from loomspan.llm import lm_score
from tests.llm.test_operators import ROWS, prose, table


def brute_force(rows, labels):
    """(doc_id, bytes, target loss, background loss) of rows(doc_id, text, ...)."""
    good = {i for i, q in labels if q == 1 and i is not None and zlib.crc32(str(i).encode()) % 3 != 1}
    counts, sizes = {True: collections.Counter(), False: collections.Counter()}, collections.Counter()
    for i, text, *_ in rows:
        data = (text or "").encode()
        for target in (True, False) if i in good else (False,):
            sizes[target] += len(data)
            padded = bytes(4) + data
            for k in range(len(data)):
                x = padded[k : k + 5]
                counts[target].update((x, x[:4], x[2:], x[2:4] + b"|pair"))
    out = collections.Counter()
    for i, text, *_ in rows:
        padded, losses = bytes(4) + (text or "").encode(), []
        for target in (True, False):
            s, bits, own = sizes[True] / sizes[target] if sizes[target] else 0.0, 0.0, collections.Counter()
            if target and i in good:  # a row of the target is scored without its own counts
                for k in range(len(padded) - 4):
                    x = padded[k : k + 5]
                    own.update((x, x[:4], x[2:], x[2:4] + b"|pair"))
            c = lambda x, all_=counts[target], own=own: all_[x] - own[x]
            for k in range(len(padded) - 4):
                x = padded[k : k + 5]
                prior = (c(x[2:]) * s + 50 / 256) / (c(x[2:4] + b"|pair") * s + 50)
                bits -= math.log2((c(x) * s + 50 * prior) / (c(x[:4]) * s + 50))
            losses.append(round(bits / max(1, len(padded) - 4), 6) + 0.0)
        out[i, len(padded) - 4, *losses] += 1
    return out


@pytest.mark.parametrize("chunk,slice_", [(1 << 23, 1 << 22), (900, 1 << 22), (3000, 700)])
def test_lm_score(spark, chunk, slice_):
    """Whole chunks, many chunks, and texts that are longer than a chunk and a slice."""
    rows = ROWS + [(700 + i, prose(40), "en", "s", 0, "") for i in range(40)]
    labels = [(i, int(i % 2 == 0)) for i, *_ in rows if i is not None] + [(701, None), (None, 1), (2, 1)]
    out = lm_score.score(table(spark, "score", rows), spark.createDataFrame(labels, "doc_id long, quality int"), chunk=chunk, most=slice_).collect()
    assert collections.Counter((r.doc_id, r.n_tokens, round(r.target_loss, 6) + 0.0, round(r.background_loss, 6) + 0.0) for r in out) == brute_force(rows, labels)
    assert all(abs(r.score - (r.target_loss - r.background_loss)) < 1e-9 for r in out)


def test_lm_score_without_rows_or_labels(spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert lm_score.score(table(spark, "x").where("false"), labels).count() == 0
    out = lm_score.score(spark.createDataFrame([(1, "aab"), (2, None), (3, "")], "doc_id long, text string"), labels.where("false")).collect()
    assert {r.doc_id: r.target_loss for r in out} == {1: pytest.approx(8.0), 2: 0.0, 3: 0.0}


def test_slices_cut_long_texts_without_loss():
    text = np.frombuffer(prose(300).encode(), np.uint8)
    whole = lm_score.tally([text, text[:50], text[:0]], [True, False, True])
    for a, b in zip(whole, lm_score.tally([text, text[:50], text[:0]], [True, False, True], 64)):
        assert (a == b).all()


def test_rows_learned_from_score_as_those_that_are_not(spark):
    """Good rows of one kind of prose: the mean score of those in the target is that of those held out of it."""
    rows = [(i, prose(150)) for i in range(600)] + [(i, " ".join(f"x{j * 7919 % 97}" for j in range(i % 50, i % 50 + 120))) for i in range(600, 900)]
    labels = spark.createDataFrame([(i, int(i < 600)) for i, _ in rows], "doc_id long, quality int")
    out = lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    inside, outside = ([r.score for r in out if r.doc_id < 600 and held(r.doc_id) == h] for h in (False, True))
    assert abs(sum(inside) / len(inside) - sum(outside) / len(outside)) < 0.02
