"""Benchmark decontamination: q-gram counts in diagonal bands propose regions, banded alignment verifies them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetrail.llm.arrays import text_bytes
from casetrail.session import ship

Q = 8
#: Items are compared as pieces of this many bytes, one from every ``STRIDE`` bytes on, so that every verbatim run of
#: ``PIECE + STRIDE - 1`` bytes of an item holds a whole piece.
PIECE, STRIDE = 80, 16
#: Edits allowed per byte of a piece.
BUDGET = 0.1
#: Bytes of benchmark text that are broadcast at a time; a larger benchmark takes several passes.
BLOCK_BYTES = 4 << 20
PART = 1 << 20
#: Shared q-grams that are held at a time; texts that share more are gone through in overlapping windows.
MOST_HITS = 1 << 21

# Letters and digits in lower case; every other ASCII byte becomes a space.
_FOLD = np.full(256, 32, np.uint8)
for _range in (range(48, 58), range(97, 123), range(128, 256)):
    _FOLD[list(_range)] = list(_range)
_FOLD[65:91] = np.arange(97, 123)


def fold(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with runs of other than letters and digits as one space, where each begins, and each byte's old place."""
    folded = _FOLD[data]
    space = folded == 32
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    edges = offsets[1:-1]
    keep[edges[edges < len(data)]] = True
    places = np.flatnonzero(keep)
    return folded[places], np.searchsorted(places, offsets), places


def grams(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place as one number."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    return np.ndarray((len(data) - Q + 1,), "<u8", np.ascontiguousarray(data).data, strides=(1,))


def banded_distances(pieces: list[np.ndarray], regions: list[np.ndarray], widths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each piece, its least edit distance to any part of its region, and where that part ends.

    Only alignments on the first ``width`` diagonals of a region count. All are aligned at once, a row
    of the piece at a time.
    """
    n, width = len(pieces), max(widths)
    sizes = np.array([len(p) for p in pieces])
    pattern = np.zeros((n, sizes.max()), np.uint8)
    text = np.zeros((n, sizes.max() + width), np.uint8)
    for k in range(n):
        pattern[k, : sizes[k]] = pieces[k]
        part = regions[k][: text.shape[1]]
        text[k, : len(part)] = part
    steps = np.arange(width, dtype=np.int32)
    closed = np.where(steps < np.array(widths)[:, None], 0, 1 << 20).astype(np.int32)
    row = closed.copy()
    distance, stop = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(pattern.shape[1]):
        best = row + (text[:, i : i + width] != pattern[:, i : i + 1])
        np.minimum(best[:, :-1], row[:, 1:] + 1, out=best[:, :-1])
        row = np.minimum.accumulate(best - steps, axis=1) + steps + closed
        done = np.flatnonzero(sizes == i + 1)
        if len(done):
            at = row[done].argmin(axis=1)
            distance[done], stop[done] = row[done, at], at + i + 1
    return distance, stop


@dataclass
class Index:
    """Distinct pieces of one block of the benchmark, the items that have each, and where their q-grams are."""

    items: list[list]
    pieces: list[np.ndarray]
    budget: np.ndarray
    needed: np.ndarray
    codes: np.ndarray
    first: np.ndarray
    piece: np.ndarray
    place: np.ndarray
    filter: np.ndarray

    @staticmethod
    def build(rows: list[tuple[object, str]]) -> Index:
        known: dict[bytes, list] = {}
        for item, text in rows:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            data = np.frombuffer(fold(raw, np.array([0, len(raw)]))[0].tobytes().strip(), np.uint8)
            last = max(len(data) - PIECE, 0)
            for at in sorted({*range(0, last, STRIDE), last}):
                if len(data) >= Q:
                    having = known.setdefault(data[at : at + PIECE].tobytes(), [])
                    if item not in having[-1:]:
                        having.append(item)
        items, pieces = list(known.values()), [np.frombuffer(content, np.uint8) for content in known]
        sizes = np.array([len(p) for p in pieces], np.int64)
        budget = np.floor(sizes * BUDGET).astype(np.int64)
        # Each edit destroys at most Q of a piece's grams.
        needed = sizes - Q + 1 - Q * budget
        # For the shortest pieces the bound would be empty; they are allowed fewer edits.
        short = needed < 1
        budget[short] = np.maximum((sizes[short] - Q) // Q, 0)
        needed[short] = np.maximum(sizes[short] - Q + 1 - Q * budget[short], 1)
        found = [grams(p) for p in pieces]
        codes = np.concatenate(found) if found else np.zeros(0, np.uint64)
        piece = np.repeat(np.arange(len(pieces)), [len(g) for g in found])
        place = np.concatenate([np.arange(len(g)) for g in found]) if found else np.zeros(0, np.int64)
        order = np.argsort(codes, kind="stable")
        distinct, first = np.unique(codes[order], return_index=True)
        bits = np.zeros(1 << 20, bool)
        bits[Index.slot(distinct)] = True
        return Index(items, pieces, budget, needed, distinct, np.r_[first, len(codes)], piece[order], place[order], bits)

    @staticmethod
    def slot(codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def shared(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text place, gram) of every q-gram that the text shares with a piece."""
        codes = grams(data)
        at = np.flatnonzero(self.filter[self.slot(codes)])
        if not len(at) or not len(self.codes):
            return (np.zeros(0, np.int64),) * 2
        number = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
        same = self.codes[number] == codes[at]
        return at[same], number[same]

    def windows(self, at: np.ndarray, number: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The shared q-grams in windows of about ``MOST_HITS`` hits; whatever one band can hold is in one of them as a whole."""
        reach = PIECE + 4 * (int(PIECE * BUDGET) + 1)
        total = np.cumsum(self.first[number + 1] - self.first[number])
        begin, end = 0, 0
        while end < len(at):
            passed = total[begin - 1] if begin else 0
            end = int(np.searchsorted(total, passed + MOST_HITS, side="right"))
            end = max(end, int(np.searchsorted(at, at[begin] + 2 * reach)))
            yield at[begin:end], number[begin:end]
            if end < len(at):
                begin = int(np.searchsorted(at, at[end] - reach))

    def bands(self, at: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The (piece, band) that reach the count which a region within the budget must have."""
        counts = self.first[number + 1] - self.first[number]
        into = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(self.first[number], counts)
        at, piece, place = np.repeat(at, counts), self.piece[into], self.place[into]
        step = self.budget[piece] + 1
        # A match on up to ``step`` neighbouring diagonals lies wholly in one of two overlapping bands.
        band = (at - place + PIECE) // step + 1
        keys = np.concatenate([(piece << 30) + band, (piece << 30) + band - 1])
        # Each gram of the piece counts once in a band, however often the text repeats it.
        grams_of = np.sort((keys << 8) + np.concatenate([place, place]))
        counted = grams_of[np.r_[True, grams_of[1:] != grams_of[:-1]]] >> 8
        heads = np.flatnonzero(np.r_[True, counted[1:] != counted[:-1]])
        counts = np.diff(np.r_[heads, len(counted)])
        return counted[heads[counts >= self.needed[counted[heads] >> 30]]]

    def regions(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, piece, start, end, distance) of the verified regions; the best one for each text and piece."""
        at, number = self.shared(data)
        if not len(at):
            return []
        found = np.unique(np.concatenate([self.bands(*window) for window in self.windows(at, number)]))
        candidates = []
        for key in found.tolist():
            k, number = key >> 30, (key & ((1 << 30) - 1)) - 1
            e, size = int(self.budget[k]), len(self.pieces[k])
            low = number * (e + 1) - PIECE
            high = low + 2 * (e + 1) + size
            # Texts the band touches; their q-grams may have been counted together, the alignment is of one.
            texts = np.searchsorted(offsets, [max(low, 0), max(min(high, len(data)) - 1, 0)], side="right") - 1
            for text in range(int(texts[0]), min(int(texts[1]), len(offsets) - 2) + 1):
                begin, end = max(int(offsets[text]), low - e), min(int(offsets[text + 1]), high + e)
                if end - begin >= size - e:
                    # What the band has before the text's start is filled with bytes that match nothing.
                    candidates.append((text, k, begin, end, begin - (low - e)))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for first in range(0, len(candidates), 512):
            group = candidates[first : first + 512]
            distances, stops = banded_distances(
                [self.pieces[k] for _, k, _, _, _ in group],
                [np.concatenate([np.zeros(pad, np.uint8), data[b:e]]) for _, _, b, e, pad in group],
                [4 * int(self.budget[k]) + 3 for _, k, _, _, _ in group],
            )
            for (text, k, begin, end, pad), distance, stop in zip(group, distances.tolist(), stops.tolist()):
                if distance <= self.budget[k] and distance < best.get((text, k), (1 << 20,))[0]:
                    stop = min(stop - pad, end - begin)
                    best[text, k] = (distance, begin + max(0, stop - len(self.pieces[k]) - distance), begin + stop)
        return [(text, k, start, stop, distance) for (text, k), (distance, start, stop) in best.items()]


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> Iterator[Index]:
    """The benchmark in blocks of about ``block_bytes``, each read and indexed when it is needed."""
    chosen = benchmark.where(F.col(text_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
    total = chosen.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_blocks = -(-total // block_bytes) or 1
    for number in range(n_blocks):
        block = chosen.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == number)
        yield Index.build([(r["item"], r["text"]) for r in block.distinct().collect()])


def contaminated_regions(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", benchmark_text_col: str = "text"
) -> DataFrame:
    """The row with an array ``regions`` of (item, start, end, distance): where pieces of benchmark items occur.

    Both sides are compared as bytes of lower-case letters and digits with single spaces. A piece is
    80 bytes of an item, from every sixteenth byte on (a shorter item is one piece); a text has it if a part of the text is
    within a tenth of the piece's length in edits. So every verbatim run of 95 bytes of an item is found. Such a part shares at least ``length - 7 - 8 * edits`` q-grams with the piece
    on neighbouring diagonals; bands that reach this count are verified by banded alignment. ``start`` and ``end`` are
    byte offsets into the text (the start within ``distance`` bytes).

    The whole of every text is compared with all items, block by block. Null and empty texts have
    no regions, null and too short items (under 8 bytes) match nothing, repeated items are one.
    Repeated rows are each judged. Empty tables give no regions. The input's columns are kept, as ``kept`` (a struct), so
    their names cannot clash; the result is (id, ``kept``, ``regions``).
    """
    spark = docs.sparkSession
    ship(spark)
    result = docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        F.struct("*").alias("kept"),
        F.array().cast("array<struct<item:string,start:long,end:long,distance:int>>").alias("regions"),
    )
    for index in benchmark_blocks(benchmark, item_col, benchmark_text_col):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                raw, offsets = text_bytes(batch.column("text"))
                found: list[list[dict]] = [list(x) for x in batch.column("regions").to_pylist()]
                begin = 0
                while begin < len(found):
                    end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + PART, side="right")) - 1)
                    data, starts, places = fold(raw[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin])
                    ends = np.r_[places, offsets[end] - offsets[begin]]
                    for text, k, start, stop, distance in index.regions(data, starts):
                        base = int(offsets[begin + text] - offsets[begin])
                        place = {"start": int(places[start]) - base, "end": int(ends[stop - 1]) + 1 - base, "distance": distance}
                        found[begin + text] += [{"item": str(item), **place} for item in index.items[k]]
                    begin = end
                regions = pa.array([sorted(x, key=lambda r: (r["start"], r["end"], r["item"])) for x in found], batch.schema.field("regions").type)
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("id", "text", "kept")), regions], ["id", "text", "kept", "regions"])

        result = result.mapInArrow(run, result.schema)
    return result.select(F.col("id").alias(id_col), "kept", "regions")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_regions``, ``items`` (their ids, sorted, comma-joined), ``least_distance``, ``contaminated``, ``kept``."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = contaminated_regions(narrow, benchmark, "id", "text")
    regions = F.col("regions")
    return found.select(
        F.col("id").alias(id_col),
        F.size(regions).cast("long").alias("n_regions"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(regions, lambda r: r["item"]))), ",").alias("items"),
        F.array_min(F.transform(regions, lambda r: r["distance"])).alias("least_distance"),
        (F.size(regions) > 0).alias("contaminated"),
        (F.size(regions) == 0).alias("kept"),
    )
