"""Kernels of the exact substring search: rolling hashes and minimisers over the bytes of many texts."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from tickerloom.llm import common

GRAM = 100
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_BASES = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)
_POSITION = np.uint64((1 << 24) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hashes of all substrings of a byte string in constant time: polynomials modulo 2^64."""

    _tables = [common.mixed(np.arange(256, dtype=np.uint64) + np.uint64(seed)) for seed in _SEEDS]
    _inverses = [pow(base, -1, 1 << 64) for base in _BASES]
    _cached: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, which: int):
        n = len(data) + 1
        up, down = self._cached.get(which, (np.empty(0), np.empty(0)))
        if len(up) < n:
            up, down = _powers(_BASES[which], n), _powers(self._inverses[which], n)
            self._cached[which] = up, down
        self.down = down
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(self._tables[which][data] * up[:n - 1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return common.mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])


class Ranges(NamedTuple):
    """Runs of window starts with the same minimiser: text number, first start, count, minimiser, gram and slice hash."""

    text: np.ndarray
    first: np.ndarray
    count: np.ndarray
    place: np.ndarray
    gram: np.ndarray
    slice: np.ndarray


def minimiser_ranges(texts: list[bytes], window: int) -> Ranges:
    """For texts of less than 16 MB together: their windows of ``window`` bytes by minimiser, as runs of starts.

    The minimiser of a window is the leftmost of its grams with the smallest hash, so equal windows have equal
    minimisers at equal places.  ``slice`` identifies all bytes that the windows of a run cover, and where the
    minimiser lies in them.
    """
    lengths = np.array([len(text) for text in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    span = window - GRAM + 1
    empty = np.empty(0, np.int64)
    if len(data) < window:
        return Ranges(empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64))
    rolling = Rolling(data, 0)
    at = np.arange(len(data) - GRAM + 1)
    packed = (rolling.of(at, at + GRAM) & ~_POSITION) | at.astype(np.uint64)
    blocks = -(-len(packed) // span)
    padded = np.full(blocks * span, np.uint64(2 ** 64 - 1))
    padded[:len(packed)] = packed
    grid = padded.reshape(blocks, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(data) - window + 1
    place = (np.minimum(back[:n], ahead[span - 1:span - 1 + n]) & _POSITION).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    valid = np.zeros(n + 1, bool)
    for start, end in zip(offsets[:-1], offsets[1:]):
        if end - start >= window:
            valid[start:end - window + 1] = True
    valid = valid[:n]
    starts = np.flatnonzero(valid)
    if not len(starts):
        return Ranges(empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64))
    new = np.ones(len(starts), bool)
    new[1:] = (place[starts[1:]] != place[starts[:-1]]) | (np.diff(starts) > 1)
    first = starts[new]
    last = starts[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]
    spot = place[first]
    text = np.searchsorted(offsets, first, "right") - 1
    gram = rolling.of(spot, spot + GRAM)
    whole = rolling.of(first, last + window) + (last - first).astype(np.uint64) * np.uint64(1 << 20) + (spot - first).astype(np.uint64)
    base = offsets[text]
    return Ranges(text, first - base, last - first + 1, spot - base, gram, common.mixed(whole))


def blocks_of(rolling: list[Rolling], place: np.ndarray, low: np.ndarray, high: np.ndarray, block: int, window: int):
    """Cut windows that start low..high bytes before ``place`` into blocks by that distance.

    Returns the number of the run, the block, the first and last distance, two hashes of the bytes that all windows
    of a whole block share, and a hash of all bytes of the windows that are there.
    """
    first, last = low // block, high // block
    count = last - first + 1
    run = np.repeat(np.arange(len(place)), count)
    number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[run]
    lo, hi = np.maximum(low[run], number * block), np.minimum(high[run], number * block + block - 1)
    start = place[run] - number * block
    end = start - block + 1 + window
    shared = [table.of(start, end) for table in rolling]
    whole = rolling[0].of(place[run] - hi, place[run] - lo + window) + (lo * 512 + hi).astype(np.uint64)
    return run, number, lo, hi, shared, common.mixed(whole)
