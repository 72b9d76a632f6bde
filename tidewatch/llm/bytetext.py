"""Vectorised word and byte work on Arrow string columns (numpy, inside tasks).

Texts are handled as UTF-8 bytes in one buffer. Arrays as long as the bytes are
made for slices of a few MB only, so that a task's memory doesn't follow the
length of its texts; arrays as long as the words are kept for a whole slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_U = np.uint64
#: Odd multipliers of the polynomial and window hashes (fixed: hashes must agree between tasks).
BASE = _U(0x9E3779B97F4A7C15)
STEP = _U(0xD1B54A32D192ED03)


def not_space_table() -> np.ndarray:
    """True for the bytes of words ``[^\\x20\\x09-\\x0D]+``."""
    t = np.ones(256, bool)
    t[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
    return t


def letter_digit_table() -> np.ndarray:
    """True for the bytes of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of lower-cased text."""
    t = np.zeros(256, bool)
    t[0x30:0x3A] = t[0x61:0x7B] = t[0x80:] = True
    return t


LOWER = bytes(range(256)).lower()


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    if n:
        out[0] = 1
        np.cumprod(out, out=out)
    return out


def _inverse(odd: int) -> np.uint64:
    return _U(pow(odd, -1, 1 << 64))


_POW: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("up", ())) < n:
        n = max(n, SLICE_BYTES + 1)
        _POW["up"], _POW["down"] = powers(BASE, n), powers(_inverse(int(BASE)), n)
    return _POW["up"], _POW["down"]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of buf[s:e] for each span; spans ordered by start, none longer than the rest allows."""
    out = np.zeros(len(starts), _U)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, lo + SLICE_BYTES)))
        while j > i + 1 and ends[j - 1] > lo + 2 * SLICE_BYTES:
            j -= 1
        hi = int(ends[i:j].max())
        part = buf[lo:hi].astype(_U)
        part += _U(1)
        up, down = _tables(len(part) + 1)
        part *= up[: len(part)]
        total = np.zeros(len(part) + 1, _U)
        np.cumsum(part, out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(_U) * STEP)
        i = j
    return out


class Slice:
    """Rows ``lo`` to ``hi`` of a batch: their bytes, and where each row's begin."""

    def __init__(self, lo: int, hi: int, buf: np.ndarray, offsets: np.ndarray):
        self.lo, self.hi, self.buf, self.offsets = lo, hi, buf, offsets

    def words(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and the number of words before each row (one more for the end)."""
        buf, n = self.buf, len(self.buf)
        starts, ends = [], []
        first = np.zeros(n + 1, bool)
        first[self.offsets] = True
        for lo in range(0, n, SLICE_BYTES):
            hi = min(n, lo + SLICE_BYTES)
            inside = np.zeros(hi - lo + 2, bool)
            inside[1:-1] = table[buf[lo:hi]]
            inside[0] = lo > 0 and table[buf[lo - 1]]
            inside[-1] = hi < n and table[buf[hi]]
            here = inside[1:-1]
            starts.append(np.flatnonzero(here & (~inside[:-2] | first[lo:hi])) + lo)
            ends.append(np.flatnonzero(here & (~inside[2:] | first[lo + 1 : hi + 1])) + lo + 1)
        none = np.zeros(0, np.int64)
        s, e = (np.concatenate(x) if x else none for x in (starts, ends))
        return s, e, np.searchsorted(s, self.offsets)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """A column of texts (nulls: empty) in slices of about ``most`` bytes; a longer row is a slice of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    _, where, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield Slice(lo, hi, whole[offsets[lo] : offsets[hi]], (offsets[lo : hi + 1] - offsets[lo]).astype(np.int64))
        lo = hi


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive entries of ``words`` (mixed 64-bit word hashes)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.zeros(n, _U)
    for i in range(k):
        out *= STEP
        out += words[i : i + n]
    return mix(out)


def covered(starts: np.ndarray, length: int | np.ndarray, n: int) -> np.ndarray:
    """A mask of n entries: those within ``length`` of any of ``starts``."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + length, n), -1)
    return np.cumsum(delta[:-1]) > 0


def sliding_min_positions(values: np.ndarray, w: int) -> np.ndarray:
    """For each window of w entries, the position of its least value, the rightmost of equals."""
    n = len(values) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, span = values.copy(), 1
    pos = np.arange(len(values))
    while span < w:  # doubling: best[i] covers values[i : i + span]
        step = min(span, w - span)
        a, b = best[: len(best) - step], best[step:]
        right = b <= a
        pos = np.where(right, pos[step:], pos[: len(pos) - step])
        best = np.where(right, b, a)
        span += step
    return pos
