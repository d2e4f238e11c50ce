"""Vectorised helpers that run inside tasks: words, rolling hashes and window minimisers of one text.

All hashes are 64 bits: a polynomial over the codes of a window (modulo 2**64, odd base), then a
full-avalanche mixer. They only choose or compare windows; callers that need exactness combine two
independent hashes (128 bits) or compare the bytes themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POSITION_BITS = 24
_POSITION_MASK = U64((1 << _POSITION_BITS) - 1)
#: Elements handled at once; longer texts are cut into pieces that overlap by a window less one.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, element by element."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64))
_LOWER_CODES = _BYTE_CODES[_LOWER]
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * powers(len(codes) + 1)[0][: len(codes)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each range [start, end) of the codes whose prefix sums are given; lengths count too."""
    down = powers(len(sums))[1]
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * U64(0xD6E8FEB86659FD93))


def window_hashes(sums: np.ndarray, length: int) -> np.ndarray:
    """Hash of every window of that many codes, by start; empty if there is none."""
    n = len(sums) - length
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    down = powers(len(sums))[1]
    return mix((sums[length:] - sums[:n]) * down[:n] + U64(length * 0xD6E8FEB86659FD93 % (1 << 64)))


def byte_codes(data: np.ndarray) -> np.ndarray:
    return _BYTE_CODES[data]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of the runs without ASCII white space."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    space = _SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1  # starts and ends in turn
    edges = np.concatenate(([0] * (not space[0]), edges, [len(data)] * (not space[-1]))).astype(np.int64, copy=False)
    return edges[::2].copy(), edges[1::2].copy()


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit code for each word; with lower, A-Z count as a-z."""
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    letters = _LOWER_CODES if lower else _BYTE_CODES
    out, i = np.empty(len(starts), dtype=np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, side="right")))
        low, high = int(starts[i]), int(ends[j - 1])
        out[i:j] = range_hash(prefix_sums(letters[data[low:high]]), starts[i:j] - low, ends[i:j] - low)
        i = j
    return out


def shingle_set(codes: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the windows of that many words; the whole sequence if it is shorter."""
    if not len(codes):
        return codes
    sums = prefix_sums(codes)
    h = np.sort(window_hashes(sums, min(size, len(codes))))
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of that many elements, by doubling."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def minimisers(grams: np.ndarray, per_window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of per_window grams, its smallest (leftmost among equals): equal windows choose the
    same one. Returns, for each run of windows with one choice, the gram and the first and last window."""
    n = len(grams) - per_window + 1
    if n <= 0:
        none = np.empty(0, dtype=np.int64)
        return none, none, none
    key = (grams & ~_POSITION_MASK) | np.arange(len(grams), dtype=np.uint64)
    at = (sliding_min(key, per_window) & _POSITION_MASK).astype(np.int64)
    cut = np.flatnonzero(np.diff(at)) + 1
    first = np.concatenate(([0], cut))
    return at[first], first, np.concatenate((cut - 1, [n - 1]))


def chunks(n: int, window: int):
    """Pieces [start, end) such that every window of a sequence of n elements starts in one piece alone."""
    for start in range(0, max(1, n - window + 1), CHUNK):
        yield start, min(n, start + CHUNK + window - 1)


def text_bytes(column: pa.Array) -> list[np.ndarray]:
    """Each text of an Arrow string or binary column as UTF-8 bytes, without copies; null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32, count=len(column) + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    empty = raw[:0]
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return [raw[a:b] if ok else empty for a, b, ok in zip(at[:-1].tolist(), at[1:].tolist(), valid.tolist())]


def merge_ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open ranges as maximal runs; ranges that touch become one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    return starts[new], ends[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(ends) - 1]))]
