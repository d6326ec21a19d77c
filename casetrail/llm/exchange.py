"""Request and response between groups of documents and ranges of hash values.

Documents are grouped into chunks of a few megabytes. For each range of values a chunk sends one
packed row with its own distinct values, and each range answers every chunk with one packed row.
A value that occurs in very many documents is so one entry a chunk, and no range or chunk is hot.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from casetrail.session import ship

#: Bytes of text in a chunk, on average.
CHUNK_BYTES = 4 << 20
#: Chunks there are at least, so that small inputs spread too.
LEAST_CHUNKS = 32


@dataclass(frozen=True)
class Layout:
    """How many chunks the documents form; ``n_bytes`` is the UTF-8 size of all texts."""

    n_bytes: int
    n_rows: int
    n_chunks: int


def layout(docs: DataFrame, text_col: str, chunk_bytes: int = CHUNK_BYTES) -> Layout:
    """Two totals of the table are read to size the plan; they don't change results."""
    ship(docs.sparkSession)
    sums = docs.agg(F.sum(F.octet_length(text_col).cast("long")).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    n_bytes = int(sums["n"] or 0)
    # Larger inputs get larger chunks, so that packed rows do not become too small.
    size = chunk_bytes * min(8.0, max(1.0, (n_bytes / (chunk_bytes * 4096)) ** 0.5))
    return Layout(n_bytes, int(sums["rows"]), max(LEAST_CHUNKS, round(n_bytes / size), int(sums["rows"]) // 200_000))


def chunk_of(id_col: Column, n_chunks: int) -> Column:
    """Rows with the same id are in the same chunk."""
    return F.pmod(F.xxhash64(id_col), F.lit(n_chunks)).cast("int")


@dataclass(frozen=True)
class Cells:
    """A count-min sketch of ``depth`` rows, cut into slices of consecutive cells."""

    width: int
    depth: int
    slice_cells: int

    @property
    def n_slices(self) -> int:
        return self.depth * self.per_row

    @property
    def per_row(self) -> int:
        return -(-self.width // self.slice_cells)

    @staticmethod
    def sized(n_values: int, per_value: int, depth: int) -> Cells:
        """Cells in proportion to the values, so that the estimates are equally sharp at every size."""
        width = max(1 << 16, n_values * per_value)
        slices = max(4, width >> 22)
        slices = slices if slices <= 1024 else int((slices * 1024) ** 0.5)
        return Cells(width, depth, min(1 << 32, -(-width // slices)))

    def cells(self, hashes: np.ndarray, row: int) -> np.ndarray:
        """The cell of each hash in one row of the sketch, numbered so that rows fill whole slices."""
        spread = hashes if row == 0 else (hashes * np.uint64(0x9FB21C651E98DF25 + 2 * row)) ^ (hashes >> np.uint64(32))
        return (spread >> np.uint64(11)) % np.uint64(self.width) + np.uint64(row * self.per_row * self.slice_cells)


def pack_cells(sorted_cells: np.ndarray, cells: Cells) -> list[tuple[int, bytes]]:
    """Per slice, sorted distinct cells as counts per 65,536 and low halves."""
    numbers, at = np.unique(sorted_cells // np.uint64(cells.slice_cells), return_index=True)
    bounds = [*at.tolist(), len(sorted_cells)]
    packed = []
    for number, begin, end in zip(numbers.tolist(), bounds[:-1], bounds[1:]):
        local = (sorted_cells[begin:end] - np.uint64(number * cells.slice_cells)).astype(np.int64)
        high = np.bincount(local >> 16, minlength=(cells.slice_cells >> 16) + 1).astype(np.uint32)
        packed.append((number, high.tobytes() + (local & 0xFFFF).astype(np.uint16).tobytes()))
    return packed


def unpack_cells(payload: bytes, cells: Cells) -> np.ndarray:
    n_high = (cells.slice_cells >> 16) + 1
    high = np.frombuffer(payload, np.uint32, n_high)
    low = np.frombuffer(payload, np.uint16, offset=4 * n_high)
    return (np.repeat(np.arange(n_high, dtype=np.int64), high) << 16) | low


def merge_slice(payloads: list[bytes], cells: Cells) -> list[bytes]:
    """Add the sketches of all chunks over one slice; per chunk, which of its cells another one has too."""
    once = np.zeros(cells.slice_cells, bool)
    again = np.zeros(cells.slice_cells, bool)
    unpacked = [unpack_cells(p, cells) for p in payloads]
    for local in unpacked:
        again[local] |= once[local]
        once[local] = True
    return [np.packbits(again[local]).tobytes() for local in unpacked]


def read_bits(payload: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(payload, np.uint8), count=n).astype(bool)
