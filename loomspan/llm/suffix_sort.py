"""Two-stage suffix sorting of one task's text, and its adjacent common prefixes.

A suffix that is smaller than its successor is sorted directly, by its first `depth` bytes, eight at a time and
only where the bytes so far are equal. The rest are induced: bucket by bucket of first bytes, in ascending order,
the suffixes before those already placed are appended to their own bucket, in the order of the scan.
"""

from __future__ import annotations

import numpy as np


def eight_bytes(text: np.ndarray) -> np.ndarray:
    """For every place the next eight bytes as one big-endian number; beyond the end there are zeros."""
    x = np.zeros(len(text) + 8, dtype=np.uint64)
    x[: len(text)] = text
    for bits in (8, 16, 32):
        step = bits // 8
        x[:-step] = (x[:-step] << np.uint64(bits)) | x[step:]
    return x[: len(text)]


def smaller_than_successor(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one that begins one byte later; the last is larger than the
    empty one after it."""
    n = len(text)
    out = np.zeros(n, dtype=bool)
    if n > 1:
        differs = np.flatnonzero(text[1:] != text[:-1])
        # A run of equal bytes goes the way of the byte that ends it.
        at = np.searchsorted(differs, np.arange(n - 1))
        inside = at < len(differs)
        end = differs[at[inside]]
        out[:-1][inside] = text[end + 1] > text[end]
    return out


def _sort_directly(at: np.ndarray, key: np.ndarray, n: int, depth: int) -> np.ndarray:
    order = at[np.argsort(key[at], kind="stable")]
    tied_from = np.arange(len(order))
    offset = 0
    # `group` marks the runs of suffixes that are equal so far.
    group = np.concatenate(([0], np.cumsum(key[order[1:]] != key[order[:-1]]))) if len(order) else order
    while len(tied_from):
        offset += 8
        if offset >= depth:
            break
        size = np.bincount(group)
        keep = size[group] > 1
        tied_from, group = tied_from[keep], group[keep]
        if not len(tied_from):
            break
        here = order[tied_from]
        k = np.where(here + offset < n, key[np.minimum(here + offset, n - 1)], np.uint64(0))
        again = np.lexsort((k, group))
        order[tied_from] = here[again]
        group, k = group[again], k[again]
        new = (group[1:] != group[:-1]) | (k[1:] != k[:-1])
        group = np.concatenate(([0], np.cumsum(new)))
    return order


def suffix_array(text: np.ndarray, depth: int, key: np.ndarray | None = None) -> np.ndarray:
    """All suffixes of text in order of their first `depth` bytes at least (equal ones beyond that in any order)."""
    n = len(text)
    if not n:
        return np.empty(0, dtype=np.int64)
    key = eight_bytes(text) if key is None else key
    small = smaller_than_successor(text)
    direct = _sort_directly(np.flatnonzero(small), key, n, depth)
    first = text[direct]
    bounds = np.searchsorted(first, np.arange(257))
    queues: list[list[np.ndarray]] = [[] for _ in range(256)]
    queues[int(text[-1])].append(np.array([n - 1]))  # induced by the empty suffix, which comes first
    out = []
    for c in range(256):
        induced = np.concatenate(queues[c]) if queues[c] else np.empty(0, dtype=np.int64)
        parts, edge = [induced], induced
        while len(edge):  # runs of c: a suffix that is followed by one of the same bucket
            edge = edge[edge > 0] - 1
            edge = edge[text[edge] == c]
            parts.append(edge)
        bucket = np.concatenate([*parts, direct[bounds[c] : bounds[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[text[before] > c]
        if len(before):
            byte = text[before]
            order = np.argsort(byte, kind="stable")
            before, byte = before[order], byte[order]
            cuts = np.flatnonzero(np.diff(byte)) + 1
            for part in np.split(before, cuts):
                queues[int(text[part[0]])].append(part)
    return np.concatenate(out)


def common_prefix_at_least(order: np.ndarray, room: np.ndarray, key: np.ndarray, length: int) -> np.ndarray:
    """For each suffix in order but the first, whether its common prefix with the one before has that many bytes
    (a multiple of eight); room: bytes from each place to the end of its own string."""
    out = np.zeros(max(0, len(order) - 1), dtype=bool)
    left = np.flatnonzero((room[order[1:]] >= length) & (room[order[:-1]] >= length)) if len(order) > 1 else np.empty(0, np.int64)
    for offset in range(0, length, 8):
        left = left[key[order[left] + offset] == key[order[left + 1] + offset]]
    out[left] = True
    return out


def repeated_starts(strings: list[bytes], weights: np.ndarray, length: int) -> list[np.ndarray]:
    """For each string, the starts of its substrings of that length that begin at two places at least, in all strings;
    a string of weight w stands for w equal ones."""
    if length % 8:
        raise ValueError("the length must be a multiple of eight")
    sizes = np.array([len(x) for x in strings])
    text = np.frombuffer(b"\xff".join(strings) + b"\xff", dtype=np.uint8)
    begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    owner = np.repeat(np.arange(len(strings)), sizes + 1)
    room = np.repeat(begin + sizes, sizes + 1) - np.arange(len(text))
    key = eight_bytes(text)
    order = suffix_array(text, length, key)
    order = order[room[order] >= length]
    same = common_prefix_at_least(order, room, key, length)
    run = np.concatenate(([0], np.cumsum(~same))) if len(order) else np.empty(0, np.int64)
    total = np.bincount(run, weights=weights[owner[order]]) if len(order) else np.empty(0)
    found = np.sort(order[total[run] > 1]) if len(order) else order
    cuts = np.searchsorted(found, begin)
    return [found[a:b] - s for a, b, s in zip(cuts, [*cuts[1:], len(found)], begin)]
