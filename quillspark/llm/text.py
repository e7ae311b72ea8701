"""Words, fingerprints and minimizer anchors of whole Arrow batches with numpy.

A batch of texts is treated as one byte buffer. There are two kinds of hashes:
`Prefix` gives polynomials modulo 2^64 for any slice in O(1). Texts can be made that
share one, so they route, sample and weigh, and never decide that two things are
equal. What decides is bytes (`dictionary`) or XXH3 of the whole bytes (`digests`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text handled at once; one longer text is handled alone.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASES = {"byte": 0x9E3779B97F4A7C15 | 1, "word": 0xC2B2AE3D27D4EB4F | 1, "span": 0xD6E8FEB86659FD93 | 1}
_TABLES: dict[tuple[str, bool], np.ndarray] = {}


def _powers(kind: str, n: int, inverse: bool = False) -> np.ndarray:
    have = _TABLES.get((kind, inverse))
    if have is None or len(have) < n:
        base = _BASES[kind]
        base = pow(base, -1, 1 << 64) if inverse else base
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        _TABLES[(kind, inverse)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer, so that all bits of a polynomial count."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit XXH3 of byte ranges."""
    view, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_64_intdigest
    out, step = np.empty(len(start), np.uint64), 1 << 16
    for i in range(0, len(start), step):
        out[i : i + step] = [digest(view[a:b]) for a, b in zip(start[i : i + step].tolist(), end[i : i + step].tolist(), strict=True)]
    return out


def pieces(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Byte ranges, in order and without overlap, as an Arrow array."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[start] += 1
    inside[end] -= 1
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    body = np.ascontiguousarray(data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)])
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(body)])


class Prefix:
    """Prefix sums of a sequence; `of(start, end)` gives the fingerprints of slices. For routing only: see above."""

    def __init__(self, values: np.ndarray, kind: str):
        self.kind, n = kind, len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _powers(kind, n), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * _powers(self.kind, len(self.sums), True)[start])

    def grams(self, k: int) -> np.ndarray:
        """Of every slice of k elements."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[k:] - self.sums[:-k]) * _powers(self.kind, n, True))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `most` bytes; at least one row each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def byte_parts(offsets: np.ndarray, window: int, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, int]]:
    """(begin, end, row offsets from begin, first row) of portions of about `most` bytes; a longer row comes in portions that share window - 1 bytes."""
    for i, j in row_slices(offsets, most):
        a, b = int(offsets[i]), int(offsets[j])
        if j > i + 1 or b - a <= most + window:
            yield a, b, offsets[i : j + 1] - a, i
            continue
        for x in range(a, b - window + 1, most):
            y = min(b, x + most + window - 1)
            yield x, y, np.array([0, y - x]), i


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of some texts: byte ranges, and the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = data = _LOWER[data] if lower else data
        self.offsets = offsets
        inside = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, offsets).astype(np.int64)

    def hashes(self) -> np.ndarray:
        """For routing: see `Prefix`. Taken over about CHUNK_BYTES at a time, or one longer word."""
        out, a = np.empty(len(self.start), np.uint64), 0
        while a < len(out):
            b = max(a + 1, int(np.searchsorted(self.end, self.start[a] + CHUNK_BYTES, "right")))
            at = self.start[a]
            out[a:b] = Prefix(self.data[at : self.end[b - 1]], "byte").of(self.start[a:b] - at, self.end[a:b] - at)
            a = b
        return out

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words with one space after each, and where each begins and ends there."""
        size = self.end - self.start
        end = np.cumsum(size + 1) - 1
        out = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
        body = np.ones(len(out), bool)
        body[end] = False
        out[body] = self.data[~_SPACE[self.data]]
        return out, end - size, end

    def parts(self, window: int, most: int = CHUNK_BYTES // 4) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
        """(hashes, first words of the rows, first row, first word) of portions of about `most` words.

        A longer row comes in portions that share window - 1 words, so that each
        window lies in just one of them.
        """
        for i, j in row_slices(self.first, most):
            a, b = int(self.first[i]), int(self.first[j])
            if j > i + 1 or b - a <= most + window:
                yield self.only(a, b).hashes(), self.first[i : j + 1] - a, i, a
                continue
            for x in range(a, b - window + 1, most):
                y = min(b, x + most + window - 1)
                yield self.only(x, y).hashes(), np.array([0, y - x]), i, x

    def only(self, a: int, b: int) -> Words:
        """Words a to b, without rows."""
        out = Words.__new__(Words)
        out.data, out.start, out.end = self.data, self.start[a:b], self.end[a:b]
        return out


def owners(first: np.ndarray) -> np.ndarray:
    """For each element the row it belongs to, given the first element of each row."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


#: Windows of one run.
MOST_WINDOWS = 256


def window_anchors(grams: np.ndarray, first: np.ndarray, window: int, k: int, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of all windows of `window` elements that lie within one row.

    The anchor of a window is the smallest fingerprint among its k-grams, so that
    equal windows have the same anchor. k-grams marked
    `frequent` (1 or True, 2) come after all others: a window has one only if it has nothing less frequent.
    Returns, for each run of windows with one anchor (at most MOST_WINDOWS): row, a
    place of the anchor, first window, windows, and whether the anchor lies at several
    places. A repeated anchor does not end a run, so a text of one character is a few runs.
    """
    empty = (np.zeros(0, np.int64),) * 5
    length = np.diff(first)
    fit = np.maximum(length - window + 1, 0)
    if not fit.sum():
        return empty
    w, n = window - k + 1, len(grams)
    #: The same number of bits at all sizes, or equal windows would differ; callers cut longer texts into portions.
    assert n < 1 << 28
    low = np.uint64((1 << 28) - 1)
    key = grams if frequent is None else (grams >> np.uint64(2)) | (frequent.astype(np.uint64) << np.uint64(62))
    key = (key & ~low) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // w)
    full = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = key
    grid = full.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    smallest = np.minimum(back[: n - w + 1], ahead[w - 1 : n])
    rows = np.repeat(np.arange(len(length)), fit)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(fit) - fit, fit) + first[:-1][rows]
    place = (smallest[at] & low).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (grams[place[1:]] != grams[place[:-1]]) | (rows[1:] != rows[:-1])
    heads = np.flatnonzero(new)
    size = np.diff(np.append(heads, len(at)))
    if size.max() > MOST_WINDOWS:
        cut = -(-size // MOST_WINDOWS)
        heads = np.repeat(heads, cut) + MOST_WINDOWS * (np.arange(cut.sum()) - np.repeat(np.cumsum(cut) - cut, cut))
        size = np.diff(np.append(heads, len(at)))
    return rows[heads], place[heads], at[heads], size, place[heads + size - 1] != place[heads]


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places the half-open ranges cover."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0
