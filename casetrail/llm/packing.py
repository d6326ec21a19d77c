"""Packing of tokenised texts into sequences: online best fit over a fixed number of open bins."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetrail.llm.arrays import LOWER, SPACE, Words, text_bytes
from casetrail.llm.common import cut
from casetrail.session import ship

#: Tokens a sequence holds, and the id that ends a document.
SEQUENCE, END = 4096, 1
#: Bins that are open at a time.
OPEN_BINS = 1024
#: Pieces packed by one stream, on average, and streams whose open bins are packed again together.
STREAM_ROWS, FAN_IN = 1 << 16, 64
#: Pieces a Python worker remembers, pieces it encodes at a time, and bytes of text it takes at a time.
REMEMBERED, ENCODED, PART = 600_000, 20_000, 1 << 22
# The pre-tokenizer whose pieces are known, and characters that it never joins to letters; fixed values.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_MARKS = np.zeros(256, bool)
_MARKS[[*b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True
# A sequence's number holds the round, the stream and the bin.
_ROUND, _STREAM = 1 << 58, 1 << 24


class Pieces(Words):
    """Words cut further where a letter or digit of ASCII meets one of the characters ``marks``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, marks: np.ndarray):
        super().__init__(data, offsets)
        meets = np.zeros(len(data) + 1, bool)
        if len(data):
            meets[1:-1] = (_ALNUM[data[:-1]] & marks[data[1:]]) | (marks[data[:-1]] & _ALNUM[data[1:]])
        meets[offsets] = False
        at = np.flatnonzero(meets)
        self.starts = np.sort(np.concatenate([self.starts, at]))
        self.ends = np.sort(np.concatenate([self.ends, at]))
        self.first = np.searchsorted(self.starts, offsets)


class WordIds:
    """Token ids of texts, by encoding each distinct piece of a word once.

    For tokenizers whose pre-tokenizer keeps runs of letters, single digits and runs of other visible characters apart
    and drops white space: pieces cut at such borders are encoded independently, so the ids of a text are those of its pieces one after
    the other. No cut is made at characters of added tokens or at an apostrophe, which may belong together with letters.
    Texts of other tokenizers are encoded whole.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            declared = json.load(file)
        kinds = lambda part: [x["type"] for x in ((part or {}).get("normalizers") or (part or {}).get("pretokenizers") or [part or {"type": ""}])]
        first = ((declared.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        added = declared.get("added_tokens", [])
        self.by_piece = (
            kinds(declared.get("normalizer")) == ["NFC", "Replace", "Lowercase"]
            and first.get("pattern", {}).get("Regex") == _PIECES
            and first.get("invert")
            and not any(t["single_word"] or any(c.isspace() for c in t["content"]) for t in added)
        )
        # Characters of added tokens, which are matched before letters become lower case.
        self.special = np.zeros(256, bool)
        self.special[[c for t in added for c in t["content"].encode() if not _ALNUM[c]]] = True
        self.marks = _MARKS & ~self.special
        self.slots: dict[int, int] = {}
        # Slot 0 is the end of a document.
        self.lengths, self.starts, self.used = np.ones(1, np.int64), np.zeros(1, np.int64), np.full(1, 2)
        self.flat = np.full(1, END, np.uint32)

    def forget(self) -> None:
        """Keep only pieces that more than one part has had."""
        kept = np.flatnonzero(self.used > 1)
        place = np.full(len(self.used), -1)
        place[kept] = np.arange(len(kept))
        self.slots = {h: k for h, k in zip(self.slots, place[list(self.slots.values())].tolist()) if k >= 0}
        lengths = self.lengths[kept]
        before = np.cumsum(lengths) - lengths
        self.flat = self.flat[np.repeat(self.starts[kept] - before, lengths) + np.arange(int(lengths.sum()))]
        self.lengths, self.starts = lengths, before
        # Counted anew, so that what is no longer met goes the next time.
        self.used = np.ones(len(kept), np.int64)
        self.used[0] = 2

    def learn(self, hashes: list[int], words: list[str]) -> None:
        found: list[list[int]] = []
        for k in range(0, len(words), ENCODED):
            found += [e.ids for e in self.tokenizer.encode_batch_fast(words[k : k + ENCODED], add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.slots.update(zip(hashes, range(len(self.lengths), len(self.lengths) + len(found))))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.used = np.concatenate([self.used, np.zeros(len(found), np.int64)])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with its end, and where each text's begin and the last ones end."""
        if not self.by_piece:
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            found = [np.array([*e.ids, END], np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *found]), np.cumsum([0, *map(len, found)])
        lowered = LOWER[data]
        pieces = Pieces(lowered, offsets, self.marks)
        odd = np.flatnonzero(self.special[data])
        for k in np.unique(np.searchsorted(pieces.starts, odd, side="right") - 1).tolist():
            lowered[pieces.starts[k] : pieces.ends[k]] = data[pieces.starts[k] : pieces.ends[k]]
        hashes, first, inverse = np.unique(pieces.hashes(), return_index=True, return_inverse=True)
        if len(self.slots) > REMEMBERED:
            self.forget()
        keys = hashes.tolist()
        unknown = [k for k, h in enumerate(keys) if h not in self.slots]
        if unknown:
            raw = lowered.tobytes()
            begin, end = pieces.starts[first], pieces.ends[first]
            self.learn([keys[k] for k in unknown], [raw[begin[k] : end[k]].decode() for k in unknown])
        slot = np.fromiter((self.slots[h] for h in keys), np.int64, len(keys))
        self.used[slot] += 1
        slot = np.insert(slot[inverse], pieces.first[1:], 0)
        lengths = self.lengths[slot]
        before = np.cumsum(lengths) - lengths
        ids = self.flat[np.repeat(self.starts[slot] - before, lengths) + np.arange(int(lengths.sum()))]
        # The end of text k is piece first[k + 1] + k of the longer list.
        ends = before[pieces.first[1:] + np.arange(len(offsets) - 1)] + 1
        return ids, np.concatenate([[0], ends])


@lru_cache(maxsize=1)
def coder_of(path: str) -> WordIds:
    """One for each Python worker, whatever tasks it runs."""
    return WordIds(path)


def _parts(data: np.ndarray, offsets: np.ndarray, may_cut: bool = True) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """First and last text of parts of about ``PART`` bytes, with their bytes; a longer text is cut at white space, if it may be."""
    begin = 0
    while begin < len(offsets) - 1:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + PART, side="right")) - 1)
        low, high = int(offsets[begin]), int(offsets[end])
        if high - low <= 2 * PART or not may_cut:
            yield begin, end, [(data[low:high], offsets[begin : end + 1] - low)]
        else:
            cuts = [low]
            while high - cuts[-1] > PART:
                gaps = np.flatnonzero(SPACE[data[cuts[-1] + PART : min(high, cuts[-1] + 2 * PART)]])
                if len(gaps):
                    cuts.append(cuts[-1] + PART + int(gaps[0]))
                else:
                    rest = np.flatnonzero(SPACE[data[min(high, cuts[-1] + 2 * PART) : high]])
                    cuts.append(min(high, cuts[-1] + 2 * PART) + int(rest[0]) if len(rest) else high)
            cuts += [high] if cuts[-1] < high else []
            yield begin, end, [(data[a:b], np.array([0, b - a])) for a, b in zip(cuts[:-1], cuts[1:])]
        begin = end


def pieces_of(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, size: int) -> DataFrame:
    """(``id``, ``piece``, ``start``, ``length``, ``ids_crc32``) of every piece of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(tokenizer)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for begin, end, segments in _parts(data, offsets, coder.by_piece):
                if len(segments) == 1:
                    ids, first = coder.encode(*segments[0])
                else:
                    # Segments of one text: only the last one's end stays.
                    found = [coder.encode(*s)[0] for s in segments]
                    ids = np.concatenate([x[:-1] for x in found[:-1]] + [found[-1]])
                    first = np.array([0, len(ids)])
                lengths = np.diff(first)
                counts = -(-lengths // size)
                row = np.repeat(np.arange(end - begin), counts)
                number = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = number * size
                length = np.minimum(size, lengths[row] - start)
                at = first[row] + start
                raw = ids.astype("<u4").tobytes()
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, end - begin).take(pa.array(row)),
                        pa.array(number, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    ["id", "piece", "start", "length", "ids_crc32"],
                )

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


class OpenBins:
    """Best fit among a fixed number of open bins.

    Bit ``f`` of ``spaces`` is set while a bin with ``f`` free places is open, so the fullest bin that
    has room for an item is the lowest bit from the item's length on, and the fullest bin of all is the lowest bit.
    """

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.spaces = 0
        self.open: dict[int, list[int]] = {}
        self.n_open = self.n_bins = 0

    def _take(self, space: int) -> int:
        bins = self.open[space]
        number = bins.pop()
        if not bins:
            del self.open[space]
            self.spaces ^= 1 << space
        self.n_open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """Bin and place of an item; where no open bin has room and all are in use, the fullest one closes."""
        fits = self.spaces >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            if self.n_open == self.most:
                self._take((self.spaces & -self.spaces).bit_length() - 1)
            space, number = self.size, self.n_bins
            self.n_bins += 1
        left = space - length
        if left:
            self.open.setdefault(left, []).append(number)
            self.spaces |= 1 << left
            self.n_open += 1
        return number, self.size - space

    def remaining(self) -> list[tuple[int, int]]:
        """(bin, filled) of the bins still open."""
        return sorted((number, self.size - space) for space, bins in self.open.items() for number in bins)


def best_fit(items: DataFrame, level: int, size: int, open_bins: int) -> DataFrame:
    """Pack ``items`` (``item``, ``length``, ``stream``, ``turn``), each stream by itself in the order of ``turn``.

    A row with ``item`` for each item, and one without for each bin that is open at the end of its
    stream: its ``sequence``, and in ``place`` how far it is filled. A stream is read once, and only its open bins are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, stream = None, None

        def rows(kept: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(("item", "stream", "sequence", "place"), r)) for r in kept], schema)

        schema = pa.schema([("item", pa.int64()), ("stream", pa.int64()), ("sequence", pa.int64()), ("place", pa.int64())])

        def closing() -> list[tuple]:
            return [(None, stream, level * _ROUND + stream * _STREAM + n, filled) for n, filled in bins.remaining()] if bins else []

        for batch in batches:
            kept = []
            for item, length, own in zip(*(batch.column(k).to_pylist() for k in ("item", "length", "stream"))):
                if own != stream:
                    kept += closing()
                    bins, stream = OpenBins(size, open_bins), own
                number, place = bins.place(length)
                kept.append((item, own, level * _ROUND + own * _STREAM + number, place))
            yield rows(kept)
        yield rows(closing())

    dealt = items.repartition("stream").sortWithinPartitions("stream", "turn", "item")
    return dealt.select("item", "length", "stream").mapInArrow(run, "item long, stream long, sequence long, place long")


def pack_texts(
    docs: DataFrame, tokenizer: str, size: int = SEQUENCE, open_bins: int = OPEN_BINS, id_col: str = "doc_id", text_col: str = "text", stream_rows: int = STREAM_ROWS
) -> DataFrame:
    """Sequence and offset of every piece of every row's tokens.

    A text's tokens are its ids in ``tokenizer`` (a ``.json`` file present on every executor), no special ones added, then id 1. Texts of more than ``size`` tokens are cut into pieces of that many; the last may be
    shorter. Pieces are dealt at random to streams; each stream places them one after the
    other in the fullest of at most ``open_bins`` open sequences that has room, and closes the fullest one when it
    needs another. The sequences still open at the end of 64 streams are then packed as items themselves, round by
    round until one stream is left, so that many streams waste no more than one.

    Null texts are empty: one piece of length 1. Repeated rows are each packed. Null ids are allowed. An
    empty table gives no rows. Only the id and text columns are read, so others may have any name.

    Result: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.
    """
    ship(docs.sparkSession)
    # Materialised, so that a row's number, which deals it to a stream, stays the same whatever is computed again.
    pieces = cut(pieces_of(docs, tokenizer, id_col, text_col, size).withColumn("item", F.monotonically_increasing_id()))
    streams = 1 + pieces.count() // stream_rows
    turn = F.xxhash64("item")
    placed = cut(best_fit(pieces.select("item", "length", F.pmod(turn, F.lit(streams)).alias("stream"), turn.alias("turn")), 0, size, open_bins))
    found = placed.where("item IS NOT NULL").select("item", "sequence", "place")
    left, level = placed.where("item IS NULL"), 0
    while streams > 1:
        level, streams = level + 1, -(-streams // FAN_IN)
        again = left.select(
            F.col("sequence").alias("item"), F.col("place").alias("length"), F.floor(F.col("stream") / FAN_IN).alias("stream"), F.xxhash64("sequence").alias("turn")
        )
        packed = cut(best_fit(again, level, size, open_bins))
        moved = packed.where("item IS NOT NULL").select(F.col("item").alias("sequence"), F.col("sequence").alias("into"), F.col("place").alias("shift"))
        found = found.join(moved, "sequence", "left").select(
            "item", F.coalesce("into", "sequence").alias("sequence"), (F.col("place") + F.coalesce("shift", F.lit(0))).alias("place")
        )
        left = packed.where("item IS NULL")
    return pieces.join(found, "item").select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", F.col("sequence").alias("sequence_id"), F.col("place").alias("offset")
    )
