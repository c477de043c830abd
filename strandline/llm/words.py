"""Words of many texts at once: positions and 64-bit hashes from Arrow's own byte buffers."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTES = mix(np.arange(1, 257, dtype=np.uint64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        for name, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def give_back() -> None:
    """Drop tables that are quickly made again and return freed memory to the system.

    Worker processes live on between tasks and stages, beside others on the same machine.
    """
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # a GNU extension
    if trim is not None:
        trim(0)


def in_slices(parts: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in short runs of rows; memory is given back after each batch and at the end.

    What a step makes of a run is then small, however many rows a batch has.
    """
    for part in parts:
        for k in range(0, part.num_rows, rows):
            yield part.slice(k, rows)
        del part
        give_back()


def slices(array: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of texts of about ``limit`` bytes; null is empty.

    A longer text is a run of its own, whole.
    """
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_string()).fill_null("")
    if not len(array):
        return
    buffers = array.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(array):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the number of words before it."""
    full = np.zeros(len(data) + 1, dtype=bool)
    full[:-1] = ~space[data]
    before = np.empty_like(full)
    before[0], before[1:] = False, full[:-1]
    before[offsets[:-1]] = False
    starts = np.flatnonzero(full & ~before)
    last = np.zeros_like(full)
    last[:-1] = full[1:]
    last[offsets[1:][np.diff(offsets) > 0] - 1] = False
    ends = np.flatnonzero(full & ~last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = SLICE) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes (stretches in order, none overlapping)."""
    out = np.empty(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):
        lo = int(starts[first])
        last = max(first + 1, int(np.searchsorted(ends, lo + block, side="right")))
        part = data[lo : int(ends[last - 1])]
        up, down = _powers(max(len(part), block) + 1)
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(BYTES[part] * up[: len(part)], out=total[1:])
        s, e = starts[first:last] - lo, ends[first:last] - lo
        out[first:last] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        first = last
    return out


def shingles(array: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its ``width``-word shingles) for every text.

    A text with fewer words is one shingle; a text without words has none.
    """
    power = BASE
    for row, data, offsets in slices(array):
        data = LOWER[data]
        starts, ends, counts = spans(data, offsets)
        h = hashes(data, starts, ends)
        n = max(0, len(h) - width + 1)
        rolled = np.zeros(n, dtype=np.uint64)
        for i in range(width):
            rolled = rolled * power + h[i : i + n]
        rolled = mix(rolled)
        for k in range(len(offsets) - 1):
            a, b = int(counts[k]), int(counts[k + 1])
            if b - a >= width:
                s = np.sort(rolled[a : b - width + 1])
                keep = np.empty(len(s), dtype=bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                yield row + k, s[keep]
            elif b > a:
                short = np.uint64(b - a)
                for x in h[a:b]:
                    short = mix(np.array([short * power + x], dtype=np.uint64))[0]
                yield row + k, np.array([short], dtype=np.uint64)
            else:
                yield row + k, np.zeros(0, dtype=np.uint64)
