"""Source divergence against sums over all terms, term by term."""

import random
import re
from collections import Counter

import pytest

from loomspan.llm import divergence as d
from loomspan.llm import queries
from loomspan.testing import difference, duck
from tests.conftest import SF


def brute(rows, least=3, most=200):
    docs = [((t or ""), (la or ""), (s or "")) for t, la, s in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(lower)), la, s) for t, la, s in docs]
    out = []
    for lang in {la for _, la, _ in words}:
        found = Counter(w for ws, la, _ in words if la == lang for w in set(ws))
        kept = [w for w, n in found.items() if n >= least]
        counts = {}
        for ws, la, s in words:
            if la == lang:
                counts.setdefault(s, Counter()).update(w for w in ws if w in set(kept))
        whole = sum(counts.values(), Counter())

        def p(c, w):
            return 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept))

        for s, c in counts.items():
            pairs = [(sum((p(c, w) - p(o, w)) ** 2 // p(o, w) for w in kept), other) for other, o in counts.items() if other != s]
            terms = [((p(c, w) - p(whole, w)) ** 2 // p(whole, w), w) for w in kept if c[w] > 0 and p(c, w) > p(whole, w)]
            for part, found_, top in (("pair", pairs, None), ("term", terms, most)):
                ranked = sorted(found_, key=lambda x: (-x[0], x[1].encode()))[:top]
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "text string, lang string, source string, term string, N int")
    return sorted(tuple(r) for r in d.divergence(df, **more).collect())


def corpus(seed, n=120, sources=5):
    rng = random.Random(seed)
    words = ["Ünder", "über", "a", "B", "été", "x1y", "don't", "tail\x7ftail", "日本", "w" * 50, *(f"v{c}" for c in "abcdefghijklmnop")]
    rows = []
    for _ in range(n):
        source = rng.choice([f"s{i}" for i in range(sources)] + ["s0"] * 4)
        text = " ".join(rng.choices(words, weights=[1 / (i + 1 + 3 * (source == "s1")) for i in range(len(words))], k=rng.randrange(0, 40)))
        rows.append((text, rng.choice(["en", "en", "de"]), source))
    return rows


def widened(rows):
    return [(*r, "clash", 7) for r in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_sums_over_all_terms(spark, seed):
    rows = corpus(seed)
    rows += [(None, "en", "empty"), ("", None, None), ("only three here", "fr", "t"), ("only", "fr", "u"), ("Only", "fr", "v"), (None, "xx", "q"), ("one", "xx", "r"), ("!? 12", "en", None)]
    assert run(spark, widened(rows)) == brute(rows)


def test_ties_limits_and_copies(spark):
    rows = [("b a", "en", "s"), ("b a", "en", "s"), ("b a", "en", "s"), ("c d", "en", "t"), ("c d", "en", "t"), ("c d", "en", "t")] * 3
    assert run(spark, widened(rows), most_terms=1) == brute(rows, most=1)
    assert run(spark, []) == []


def test_held_counts_and_pieces_change_nothing(spark, monkeypatch):
    rows = corpus(5)
    monkeypatch.setattr(d, "HELD", 3)
    monkeypatch.setattr(d, "PIECE", 7)
    held = [b for b in d._counts(iter(spark.createDataFrame(rows, "text string, lang string, source string").toArrow().to_batches()))]
    total = Counter()
    for b in held:
        for lang, source, term, n, _ in zip(*(c.to_pylist() for c in b.columns)):
            total[lang, source, term] += n
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    expected = Counter((la, s, w) for t, la, s in rows for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(lower)))
    assert len(held) > 10 and {k: v for k, v in total.items() if k[2]} == dict(expected)


def test_a_very_long_text(spark):
    rows = [("lorem ipsum " * 600_000 + "dolor", "en", "a"), ("lorem dolor", "en", "b"), ("ipsum dolor lorem", "en", "b"), ("ipsum", "en", "c")]
    assert run(spark, widened(rows)) == brute(rows)


def test_query_equals_its_sql(spark):
    name = "op11_source_divergence"
    assert difference(queries.queries()[name](spark, SF), queries.oracle_sql()[name], duck(SF)) == ""
