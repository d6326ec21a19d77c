"""Words, windows and hashes of many texts at once, over the bytes of an Arrow text column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
# Odd multipliers of the polynomial hashes, and the constants of the finaliser; fixed values.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = (x ^ (x >> _U(30))) * _U(_MIX[0])
    x = (x ^ (x >> _U(27))) * _U(_MIX[1])
    return x ^ (x >> _U(31))


def mix_one(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], _U))[0])


_BYTE_VALUES = [mix(np.arange(256, dtype=_U) + _U(1 + 1000 * k)) for k in (1, 2)]


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, modulo 2^64."""
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        size = max(n, 1 << 20)
        made = []
        for base in (_BASES[which], pow(_BASES[which], -1, 2**64)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _POWERS[which] = tuple(made)
    forward, back = _POWERS[which]
    return forward[:n], back[:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of ``values[start:end]`` for every span; equal content gives equal hashes wherever it stands."""
    forward, back = powers(which, len(values) + 1)
    sums = np.empty(len(values) + 1, _U)
    sums[0] = 0
    np.cumsum(values * forward[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(_U))


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins and the last ends; a null has none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Where the words of many texts are.

    ``starts`` and ``ends`` are byte places in ``data``; the words of text ``k`` are numbers
    ``first[k]`` to ``first[k + 1]``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = ~SPACE[data]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
        begins[edges] = inside[edges]
        stops[edges - 1] = inside[edges - 1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, lower: bool = False, which: int = 0) -> np.ndarray:
        data = LOWER[self.data] if lower else self.data
        return span_hashes(_BYTE_VALUES[which][data], self.starts, self.ends, which)

    def window_starts(self, width: int) -> np.ndarray:
        """Numbers of the words at which a window of ``width`` words of one text starts."""
        counts = np.maximum(self.counts() - (width - 1), 0)
        return np.repeat(self.first[:-1], counts) + within(counts)


def within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each of consecutive groups of these sizes."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
