"""Alignment of two lists: the plain table and its walk, restated here, decide what is right."""

import random
import tracemalloc

from loomspan.operators.markup import align, structural_counts


def by_table(a, b):
    n, m = len(a), len(b)
    common = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            common[i][j] = common[i + 1][j + 1] + 1 if a[i] == b[j] else max(common[i + 1][j], common[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif j == m or (i < n and common[i + 1][j] >= common[i][j + 1]):
            out.append((i, None))
            i += 1
        else:
            out.append((None, j))
            j += 1
    return out


def test_random_lists_pair_as_by_the_table():
    rng = random.Random(7)
    for _ in range(2000):
        kinds = rng.choice((1, 2, 3, 8))
        a, b = ([(rng.randrange(kinds),) for _ in range(rng.randrange(0, 30))] for _ in range(2))
        assert align(a, b) == by_table(a, b)


def test_twenty_thousand_children_in_bounded_memory():
    rng = random.Random(8)
    a = [("li", None, (str(rng.randrange(40)),)) for _ in range(20_000)]
    b = [x for x in a if rng.random() < 0.9]
    tracemalloc.start()
    pairs = align(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(j is not None and i is not None for i, j in pairs) == len(b) and peak < 100 << 20


def test_repeated_siblings_are_dropped_from_the_front():
    original = "<body><nav></nav><div><p></p><p></p><h2></h2></div><hr><div><ul></ul></div></body>"
    nodes, matches = structural_counts(original, "<body><div><p></p><p></p><h2></h2></div></body>")
    assert (nodes, round(matches, 6)) == (8, 5.0)
    assert structural_counts("<body><p id=a class='x y'></p></body>", "<body><p id=a class='y x'></p></body>") == (2, 2.0)
    assert structural_counts("", "") == (1, 1.0)
