"""Bands of groups that copies or rare scripts dominate."""

import numpy as np

from loomspan.llm import fertility

RNG = np.random.default_rng(5)
WORDS = ["".join(RNG.choice(list("abcdefghi"), RNG.integers(1, 7))) for _ in range(400)]
COMMON = "time people water house world school state family student group country problem hand part place week company system program question".split()


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")


def test_copies_have_one_vote(spark):
    clean = [" ".join(RNG.choice(WORDS, 90)) for _ in range(150)]
    copied = " ".join(RNG.choice(COMMON, 200))  # as many tokens, but of more characters
    out = fertility.quality_rules(docs(spark, clean + [copied] * 600)).collect()
    assert len(out) == 750 and not any(r.base_failed for r in out)
    assert all(r.kept for r in out if r.doc_id < 150)


def test_small_groups_have_bands(spark):
    clean = [" ".join(RNG.choice(WORDS, 90)) for _ in range(60)]
    junk = " | ".join("$$$" + "".join(RNG.choice(list("qxzjkv#$%&<>"), 9)) for _ in range(60))
    out = fertility.quality_rules(docs(spark, [*clean, junk])).collect()
    assert not any(r.base_failed for r in out)
    assert {r.doc_id for r in out if not r.kept} == {60}
