"""Removal of repeated word windows: a count-min prefilter, then exact grouping of what it lets through."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetrail.llm.arrays import Words, mix, span_hashes, text_bytes
from casetrail.llm.exchange import Cells, chunk_of, layout, merge_slice, pack_cells, read_bits

#: Rows of the sketch and cells per window; one window in (1 / CELLS_PER_WORD) ** DEPTH passes by chance.
DEPTH = 2
CELLS_PER_WORD = 8
#: Windows a bucket of the exact grouping is planned for, if a sixth of all pass.
BUCKET_WINDOWS = 300_000

_ENTRY = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8")])
#: Stands for a null id, which comes after all others.
_LAST = np.iinfo(np.int64).max


class Windows:
    """The windows of a chunk: two independent hashes of each, its document and its first word."""

    def __init__(self, table: pa.Table, width: int):
        data, offsets = text_bytes(table.column("text"))
        ids = table.column("id").combine_chunks().cast(pa.int64()).fill_null(_LAST)
        self.ids = np.asarray(ids).astype(np.int64)
        self.words = Words(data, offsets)
        self.starts = self.words.window_starts(width)
        ends = self.starts + width
        self.a, self.b = (span_hashes(mix(self.words.hashes(which=k)), self.starts, ends, k) for k in (0, 1))
        self.doc = np.repeat(np.arange(len(self.ids)), np.maximum(self.words.counts() - (width - 1), 0))

    def cells(self, cells: Cells) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """Per row of the sketch: sorted distinct cells, each window's place among them, and their counts."""
        found = [np.unique(cells.cells(self.a, row), return_inverse=True, return_counts=True) for row in range(cells.depth)]
        return [f[0] for f in found], [f[1] for f in found], [f[2] for f in found]

    def repeated(self, cells: Cells, answers: dict[int, bytes]) -> np.ndarray:
        """Numbers of the windows that every row of the merged sketch counts twice or more."""
        passed = np.ones(len(self.a), bool)
        for distinct, inverse, counts in zip(*self.cells(cells)):
            flags = counts > 1
            slices, at = np.unique(distinct // np.uint64(cells.slice_cells), return_index=True)
            bounds = [*at.tolist(), len(distinct)]
            for number, begin, end in zip(slices.tolist(), bounds[:-1], bounds[1:]):
                if number in answers:
                    flags[begin:end] |= read_bits(answers[number], end - begin)
            passed &= flags[inverse]
        return np.flatnonzero(passed)


class Candidates:
    """Windows that passed the sketch, grouped by both hashes within the chunk, and by bucket."""

    def __init__(self, windows: Windows, chosen: np.ndarray, n_buckets: int):
        a, b = windows.a[chosen], windows.b[chosen]
        ids = windows.ids[windows.doc[chosen]]
        bucket = (a >> np.uint64(7)) % np.uint64(n_buckets)
        # Within a group: smallest document first, then the earlier start.
        order = np.lexsort((windows.starts[chosen], ids, b, a, bucket))
        self.a, self.b, self.ids, self.bucket = a[order], b[order], ids[order], bucket[order]
        self.starts = windows.starts[chosen][order]
        new = np.ones(len(order), bool)
        new[1:] = (self.a[1:] != self.a[:-1]) | (self.b[1:] != self.b[:-1]) | (self.bucket[1:] != self.bucket[:-1])
        self.heads = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1

    def by_bucket(self) -> list[tuple[int, int, int]]:
        """(bucket, first group, last group + 1)."""
        numbers, at = np.unique(self.bucket[self.heads], return_index=True)
        bounds = [*at.tolist(), len(self.heads)]
        return list(zip(numbers.tolist(), bounds[:-1], bounds[1:]))


def remove_repeated_windows(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """Remove every word covered by a window of words that also starts earlier.

    A window is ``width`` consecutive words (runs of other than ASCII white space, unchanged) of one
    document; earlier is a smaller id, or the same id and an earlier start. Windows are judged on
    the input. Each chunk of documents makes a sketch of its windows; the merged sketch never
    counts too low, so only windows it counts twice are grouped, exactly, by two independent
    64-bit hashes. Nothing is capped: a window enters the exchange once for each chunk.

    Null texts have no words. A null id comes after all others. Rows that share an id are one place
    in the order: equal windows of them at one start don't remove each other, and the row with the
    earlier start keeps. Texts shorter than a window lose nothing. An empty table gives no rows.
    Only the id (an integer) and text columns are read.

    Result: id, ``n_words``, ``n_removed``, ``kept_text`` (kept words joined by a
    space; null if ``texts`` is false), ``kept_sha256``.
    """
    sizes = layout(docs, text_col)
    n_chunks = sizes.n_chunks
    # Fewer than one word in four bytes is usual; a sketch that is too small lets more through, losing none.
    cells = Cells.sized(max(sizes.n_bytes // 5, 1), CELLS_PER_WORD, DEPTH)
    n_buckets = max(8, sizes.n_bytes // 5 // 6 // BUCKET_WINDOWS)
    source = docs.select(chunk_of(F.col(id_col), n_chunks).alias("chunk"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    by_chunk = source.groupBy("chunk")

    def sketch(table: pa.Table) -> pa.Table:
        windows = Windows(table, width)
        rows = [x for distinct in windows.cells(cells)[0] for x in pack_cells(distinct, cells)]
        return pa.table(
            {
                "slice": pa.array([s for s, _ in rows], pa.int32()),
                "chunk": pa.array([table.column("chunk")[0].as_py()] * len(rows), pa.int32()),
                "payload": pa.array([p for _, p in rows], pa.binary()),
            }
        )

    def merge(table: pa.Table) -> pa.Table:
        answers = merge_slice(table.column("payload").to_pylist(), cells)
        kept = [k for k, bits in enumerate(answers) if any(bits)]
        return pa.table(
            {
                "chunk": table.column("chunk").take(pa.array(kept, pa.int64())),
                "part": table.column("slice").take(pa.array(kept, pa.int64())),
                "payload": pa.array([answers[k] for k in kept], pa.binary()),
            }
        )

    def answers_of(table: pa.Table, kind: str | None = None) -> dict[int, bytes]:
        if kind is not None:
            table = table.filter(pa.compute.equal(table.column("kind"), kind))
        return dict(zip(table.column("part").to_pylist(), table.column("payload").to_pylist()))

    def candidates(docs_table: pa.Table, answers: dict[int, bytes]) -> tuple[Windows, Candidates]:
        windows = Windows(docs_table, width)
        return windows, Candidates(windows, windows.repeated(cells, answers), n_buckets)

    def request(docs_table: pa.Table, flags: pa.Table) -> pa.Table:
        rows = []
        if len(docs_table):
            _, found = candidates(docs_table, answers_of(flags))
            entries = np.empty(len(found.heads), _ENTRY)
            for name, values in (("a", found.a), ("b", found.b), ("doc", found.ids)):
                entries[name] = values[found.heads]
            rows = [(bucket, entries[begin:end].tobytes()) for bucket, begin, end in found.by_bucket()]
        chunk = docs_table.column("chunk")[0].as_py() if len(docs_table) else 0
        return pa.table(
            {
                "bucket": pa.array([b for b, _ in rows], pa.int32()),
                "chunk": pa.array([chunk] * len(rows), pa.int32()),
                "payload": pa.array([p for _, p in rows], pa.binary()),
            }
        )

    def judge(table: pa.Table) -> pa.Table:
        """Per chunk, which of its windows it holds first."""
        parts = [np.frombuffer(p, _ENTRY) for p in table.column("payload").to_pylist()]
        lengths = [len(p) for p in parts]
        entries = np.concatenate(parts)
        order = np.lexsort((entries["doc"], entries["b"], entries["a"]))
        a, b, doc = (entries[name][order] for name in ("a", "b", "doc"))
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        least = doc[new][np.cumsum(new) - 1]
        first = np.empty(len(order), bool)
        first[order] = doc == least
        bits = [np.packbits(x).tobytes() for x in np.split(first, np.cumsum(lengths)[:-1])]
        return pa.table({"chunk": table.column("chunk"), "part": table.column("bucket"), "payload": pa.array(bits, pa.binary())})

    def finish(docs_table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(docs_table):
            return pa.table({n: pa.array([], t) for n, t in (("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("kept_sha256", pa.string()))})
        windows, found = candidates(docs_table, answers_of(answers, "cells"))
        firsts = answers_of(answers, "first")
        holds = np.zeros(len(found.heads), bool)
        for bucket, begin, end in found.by_bucket():
            holds[begin:end] = read_bits(firsts[bucket], end - begin)
        # The first of a group that is first everywhere stays, and with it rows that tie with it.
        removed = np.ones(len(found.group), bool)
        head = found.heads[found.group]
        words = windows.words
        row_of = np.searchsorted(words.first, found.starts, side="right") - 1
        local = found.starts - words.first[row_of]
        removed[holds[found.group] & (found.ids == found.ids[head]) & (local == local[head])] = False
        opened = np.bincount(found.starts[removed], minlength=len(words) + 1)
        closed = np.bincount(found.starts[removed] + width, minlength=len(words) + 1)
        keep = np.cumsum(opened - closed)[: len(words)] == 0
        return kept_words(docs_table.column("id"), words, keep, texts)

    requests = by_chunk.applyInArrow(sketch, "slice int, chunk int, payload binary")
    flags = requests.groupBy("slice").applyInArrow(merge, "chunk int, part int, payload binary")
    asked = by_chunk.cogroup(flags.groupBy("chunk")).applyInArrow(request, "bucket int, chunk int, payload binary")
    firsts = asked.groupBy("bucket").applyInArrow(judge, "chunk int, part int, payload binary")
    answers = flags.withColumn("kind", F.lit("cells")).unionByName(firsts.withColumn("kind", F.lit("first")))
    done = by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(
        finish, "id long, n_words long, n_removed long, kept_text string, kept_sha256 string"
    )
    return done.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_words", "n_removed", "kept_text", "kept_sha256")


def kept_words(ids: pa.ChunkedArray, words: Words, keep: np.ndarray, with_texts: bool) -> pa.Table:
    """Texts of the kept words joined by one space, with counts and digests."""
    data = words.data.tobytes()
    texts, digests, removed = [], [], []
    starts, ends = words.starts.tolist(), words.ends.tolist()
    for begin, end in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        flags = keep[begin:end]
        if flags.all():
            kept = b" ".join([data[s:e] for s, e in zip(starts[begin:end], ends[begin:end])])
        else:
            kept = b" ".join([data[starts[k] : ends[k]] for k in (np.flatnonzero(flags) + begin).tolist()])
        removed.append(end - begin - int(flags.sum()))
        texts.append(kept.decode() if with_texts else None)
        digests.append(hashlib.sha256(kept).hexdigest())
    return pa.table(
        {
            "id": ids,
            "n_words": pa.array(words.counts(), pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "kept_text": pa.array(texts, pa.string()),
            "kept_sha256": pa.array(digests, pa.string()),
        }
    )
