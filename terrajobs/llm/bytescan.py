"""Vectorized scans over the UTF-8 bytes of Arrow string columns.

Words are runs of bytes other than 0x20 and 0x09-0x0D. Those bytes never occur inside a
multi-byte character, so the byte view gives the same words as the character view.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def _mix_int(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & (2**64 - 1)
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
    return x ^ (x >> 31)


BYTE_CODE = np.array([_mix_int(i + 1) for i in range(256)], dtype=_U)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix)."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers = np.ones(1, _U)
_inverses = np.ones(1, _U)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * SLICE_BYTES + 1)
        p, q = np.full(size, _BASE, _U), np.full(size, _INVERSE, _U)
        p[0] = q[0] = 1
        _powers, _inverses = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return _powers[:n], _inverses[:n]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span; spans are in order and disjoint.

    Prefix sums of byte codes times powers of an odd base, modulo 2**64, computed in
    blocks of bounded size; equal bytes give equal hashes wherever they stand.
    """
    out = np.empty(len(start), _U)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + SLICE_BYTES, side="right")))
        lo, hi = int(start[i]), int(end[j - 1])
        power, inverse = _tables(hi - lo + 1)
        prefix = np.zeros(hi - lo + 1, _U)
        np.cumsum(BYTE_CODE[data[lo:hi]] * power[: hi - lo], out=prefix[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = mix((prefix[e] - prefix[s]) * inverse[s] + (e - s).astype(_U))
        i = j
    return out


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them) for runs of rows
    of about ``limit`` bytes. Null texts count as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        b = min(b, len(column))
        lo = offsets[a]
        yield a, b, data[lo : offsets[b]], offsets[a : b + 1] - lo
        a = b


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each row and the total) of the words in each row."""
    if not len(data):
        empty = np.empty(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    blank = SPACE[data]
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = blank[:-1], blank[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = True
    after[inner - 1] = True
    solid = ~blank
    start, end = np.flatnonzero(solid & before), np.flatnonzero(solid & after) + 1
    return start, end, np.searchsorted(start, offsets)


def shingles(word: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first of each row) of all n-word sequences inside rows; a row with fewer
    than n words but at least one has its whole sequence as one."""
    if not len(word):
        return np.empty(0, _U), np.zeros(len(first), np.int64)
    window = max(len(word) - n + 1, 0)
    h = np.zeros(window, _U)
    for k in range(n):
        h = h * _U(0xD6E8FEB86659FD93) + word[k : k + window]
    h = mix(h)
    count = np.diff(first)
    out, sizes = [], np.zeros(len(count), np.int64)
    if (count >= n).all():
        keep = np.ones(window, bool)
        for k in range(1, n):
            cut = first[1:-1] - k
            keep[cut[(cut >= 0) & (cut < window)]] = False
        sizes = count - n + 1
        return h[keep], np.concatenate([[0], np.cumsum(sizes)])
    for r, c in enumerate(count):
        if c >= n:
            out.append(h[first[r] : first[r] + c - n + 1])
        elif c:
            x = 0
            for w in word[first[r] : first[r] + c].tolist():
                x = (x * 0xD6E8FEB86659FD93 + w) & (2**64 - 1)
            out.append(mix(np.array([(x + int(c)) & (2**64 - 1)], _U)))
        sizes[r] = len(out[-1]) if c else 0
    return (np.concatenate(out) if out else np.empty(0, _U)), np.concatenate([[0], np.cumsum(sizes)])
