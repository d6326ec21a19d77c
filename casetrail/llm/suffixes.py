"""Removal of byte strings that occur in an earlier document, by merging sorted runs of suffixes.

Suffixes are sorted at anchors: in every string of ``length`` bytes the 20-byte gram with the least
hash is an anchor, so two equal strings have it at the same place. Anchors whose gram occurs in one
document only cannot lie in a repeated string; a sketch of all grams finds them, and never takes a
repeated one for such. Chunks of documents sort the suffixes at the remaining anchors, front-code
them and exchange them by gram; a loser tree merges the runs of a range and never compares a prefix
that is known to be common. The common prefixes that come out of the merge give classes of equal
right parts; equal bytes to the left of the anchor complete them to whole strings.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetrail.llm.arrays import _BYTE_VALUES, mix, powers, text_bytes
from casetrail.llm.exchange import Cells, chunk_of, layout, merge_slice, pack_cells, read_bits

GRAM = 20
CELLS_PER_ANCHOR = 64
#: Entries a bucket of the merge is planned for, if a seventh of all anchors remain.
BUCKET_ENTRIES = 50_000
#: Bytes scanned at once; longer documents are scanned whole.
BLOCK = 1 << 20

_LAST = np.iinfo(np.int64).max
_PLACE = (1 << 28) - 1


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    reach = 1
    least = values
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    return np.minimum(least[: len(least) - (width - reach)], least[width - reach :])


def anchors_of(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and gram hashes of the anchors of one document of at least ``length`` bytes."""
    forward, back = powers(0, len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_VALUES[0][data] * forward[: len(data)], out=sums[1:])
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * back[: len(data) - GRAM + 1])
    ranked = (grams & ~np.uint64(_PLACE)) | np.arange(len(grams), dtype=np.uint64)
    places = sliding_least(ranked, length - GRAM + 1) & np.uint64(_PLACE)
    first = np.ones(len(places), bool)
    first[1:] = places[1:] != places[:-1]
    places = places[first].astype(np.int64)
    return places, grams[places]


class Chunk:
    """Documents of a chunk in the order of their ids, and the anchors of those that can hold one."""

    def __init__(self, table: pa.Table, copies: set[int], length: int):
        ids = np.asarray(table.column("id").combine_chunks().cast(pa.int64()).fill_null(_LAST)).astype(np.int64)
        order = np.argsort(ids, kind="stable")
        self.column = table.column("id").take(pa.array(order))
        self.ids = ids[order]
        self.data, self.offsets = text_bytes(table.column("text").take(pa.array(order)))
        sizes = np.diff(self.offsets)
        # A copy of a whole earlier text is decided by that alone.
        keys = np.asarray(table.column("copy").combine_chunks()).astype(np.int64)[order]
        self.copied = np.array([k in copies for k in keys.tolist()], bool) & (sizes >= length)
        places, grams, docs = [], [], []
        for doc in np.flatnonzero(~self.copied & (sizes >= length)).tolist():
            begin, end = int(self.offsets[doc]), int(self.offsets[doc + 1])
            at, hashes = anchors_of(self.data[begin:end], length)
            places.append(at + begin)
            grams.append(hashes)
            docs.append(np.full(len(at), doc, np.int64))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.places, self.grams, self.docs = join(places, np.int64), join(grams, np.uint64), join(docs, np.int64)

    def cells(self, cells: Cells) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct cells, each anchor's place among them, and which are in several documents here."""
        distinct, first, inverse = np.unique(cells.cells(self.grams, 0), return_index=True, return_inverse=True)
        several = np.zeros(len(distinct), bool)
        several[inverse[self.docs != self.docs[first][inverse]]] = True
        return distinct, inverse, several

    def keep_repeated(self, cells: Cells, answers: dict[int, bytes]) -> None:
        """Drop the anchors whose gram the sketch finds in one document only."""
        distinct, inverse, flags = self.cells(cells)
        slices, at = np.unique(distinct // np.uint64(cells.slice_cells), return_index=True)
        bounds = [*at.tolist(), len(distinct)]
        for number, begin, end in zip(slices.tolist(), bounds[:-1], bounds[1:]):
            if number in answers:
                flags[begin:end] |= read_bits(answers[number], end - begin)
        keep = flags[inverse]
        self.places, self.grams, self.docs = self.places[keep], self.grams[keep], self.docs[keep]


class Run:
    """The suffixes at a chunk's anchors with what stands left of them, sorted within buckets.

    Equal contexts are one entry, with the smallest id that has it.
    """

    def __init__(self, chunk: Chunk, length: int, n_buckets: int):
        reach = length - GRAM
        places, docs = chunk.places, chunk.docs
        begin, end = chunk.offsets[docs], chunk.offsets[docs + 1]
        self.right_size = np.minimum(length, end - places)
        self.left_size = np.minimum(reach, places - begin)
        top = max(len(chunk.data) - 1, 0)
        right = np.minimum(places[:, None] + np.arange(length), top)
        left = np.maximum(places[:, None] - 1 - np.arange(reach), 0)
        right = np.where(np.arange(length) < self.right_size[:, None], chunk.data[right], 0).astype(np.uint8)
        left = np.where(np.arange(reach) < self.left_size[:, None], chunk.data[left], 0).astype(np.uint8)
        bucket = ((chunk.grams >> np.uint64(13)) % np.uint64(n_buckets)).astype(np.int64)
        # One fixed-width key: bucket, suffix, its length, left bytes, their number (never zero bytes at the end).
        key = np.concatenate(
            [
                bucket.astype(">u4").view(np.uint8).reshape(-1, 4),
                right,
                self.right_size[:, None].astype(np.uint8),
                left,
                (self.left_size[:, None] + 1).astype(np.uint8),
            ],
            axis=1,
        )
        whole = np.ascontiguousarray(key).view(f"S{key.shape[1]}").ravel()
        order = np.argsort(whole, kind="stable")  # the anchors are in the order of the ids
        whole = whole[order]
        new = np.ones(len(order), bool)
        new[1:] = whole[1:] != whole[:-1]
        self.order, self.group, self.heads = order, np.cumsum(new) - 1, np.flatnonzero(new)
        at = order[self.heads]
        self.right, self.left, self.bucket = right[at], left[at], bucket[at]
        self.entry_right, self.entry_left = self.right_size[at], self.left_size[at]
        self.entry_ids = chunk.ids[docs[at]]

    def by_bucket(self) -> list[tuple[int, int, int]]:
        numbers, at = np.unique(self.bucket, return_index=True)
        bounds = [*at.tolist(), len(self.bucket)]
        return list(zip(numbers.tolist(), bounds[:-1], bounds[1:]))

    def front_coded(self, begin: int, end: int) -> bytes:
        """Ids, sizes and left bytes of entries, and of each suffix what its predecessor does not have."""
        right, sizes, left_sizes = self.right[begin:end], self.entry_right[begin:end], self.entry_left[begin:end]
        common = np.zeros(end - begin, np.int64)
        differ = right[1:] != right[:-1]
        common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), right.shape[1])
        common[1:] = np.minimum(common[1:], np.minimum(sizes[1:], sizes[:-1]))
        columns = np.arange(right.shape[1])
        rest = right[(columns >= common[:, None]) & (columns < sizes[:, None])]
        left = self.left[begin:end]
        lefts = left[np.arange(left.shape[1]) < left_sizes[:, None]]
        head = np.array([end - begin], np.int64).tobytes() + self.entry_ids[begin:end].tobytes()
        small = [x.astype(np.uint8).tobytes() for x in (common, sizes, left_sizes)]
        return b"".join([head, *small, rest.tobytes(), lefts.tobytes()])


class CodedRun:
    """A front-coded run, decoded."""

    def __init__(self, payload: bytes, reach: int):
        n = int(np.frombuffer(payload, np.int64, 1)[0])
        self.ids = np.frombuffer(payload, np.int64, n, 8)
        at = 8 + 8 * n
        self.common, self.sizes, self.left_sizes = (np.frombuffer(payload, np.uint8, n, at + k * n).astype(np.int64) for k in range(3))
        at += 3 * n
        ends = at + np.cumsum(self.sizes - self.common)
        self.suffixes: list[bytes] = []
        previous = b""
        for common, stop in zip(self.common.tolist(), ends.tolist()):
            previous = previous[:common] + payload[at:stop]
            self.suffixes.append(previous)
            at = stop
        flat = np.frombuffer(payload, np.uint8, offset=at)
        self.left = np.zeros((n, reach), np.uint8)
        self.left[np.arange(reach) < self.left_sizes[:, None]] = flat


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings that agree in the first ``known`` bytes."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    differ = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (differ.bit_length() + 7) // 8


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merge sorted runs of (strings, common prefix with the string before) with a loser tree.

    Returns (run, place) in sorted order, and each one's common prefix with its predecessor. Every
    contender carries its common prefix with the last winner of its node: the longer one is the
    smaller string, and only where both are equal are bytes compared, from there on.
    """
    leaves = 1
    while leaves < len(runs):
        leaves *= 2
    heads: list[bytes | None] = [run[0][0] if run[0] else None for run in runs] + [None] * (leaves - len(runs))
    known = [0] * leaves
    at = [0] * leaves
    losers = [0] * leaves

    def better(a: int, b: int) -> bool:
        """Whether run a's head comes first; the other keeps its common prefix with it."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return x is not None
        if known[a] != known[b]:
            return known[a] > known[b]
        common = common_prefix(x, y, known[a])
        first = len(x) <= len(y) if common == min(len(x), len(y)) else x[common] < y[common]
        known[b if first else a] = common
        return first

    winners = [0] * leaves + list(range(leaves))
    for node in range(leaves - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        first = better(a, b)
        winners[node], losers[node] = (a, b) if first else (b, a)
    champion = winners[1] if leaves > 1 else 0
    order, prefixes = [], []
    while heads[champion] is not None:
        place = at[champion]
        order.append((champion, place))
        prefixes.append(known[champion])
        place += 1
        at[champion] = place
        strings, commons = runs[champion]
        if place < len(strings):
            heads[champion] = strings[place]
            known[champion] = commons[place]
        else:
            heads[champion] = None
        node = (champion + leaves) >> 1
        while node:
            loser = losers[node]
            x, y = heads[champion], heads[loser]
            if y is not None:
                if x is None:
                    losers[node], champion = champion, loser
                else:
                    p, q = known[champion], known[loser]
                    if p < q or (p == q and not better(champion, loser)):
                        losers[node], champion = champion, loser
            node >>= 1
    return order, prefixes


def judge_bucket(payloads: list[bytes], length: int) -> list[bytes]:
    """For each entry of each run, at which distances left of the anchor a repeated string starts.

    Bit ``l`` says that the string from ``l`` bytes before the anchor occurs in a document with a smaller id.
    """
    reach = length - GRAM
    runs = [CodedRun(p, reach) for p in payloads]
    order, prefixes = merge_runs([(r.suffixes, r.common.tolist()) for r in runs])
    which = np.array([r for r, _ in order], np.int64)
    place = np.array([k for _, k in order], np.int64)
    starts = np.cumsum([0] + [len(r.ids) for r in runs])
    flat = starts[which] + place
    ids = np.concatenate([r.ids for r in runs])[flat]
    right = np.concatenate([r.sizes for r in runs])[flat]
    left_size = np.concatenate([r.left_sizes for r in runs])[flat]
    left = np.concatenate([r.left for r in runs])[flat]
    common = np.array(prefixes, np.int64)
    masks = np.zeros(len(flat), np.uint32)
    # Only anchors whose gram several documents have can be part of a repeated string.
    group = np.cumsum(np.r_[True, common[1:] < GRAM]) - 1
    heads = np.flatnonzero(np.r_[True, common[1:] < GRAM])
    mixed = np.maximum.reduceat(ids, heads) > np.minimum.reduceat(ids, heads)
    live = np.flatnonzero(mixed[group])
    forward, _ = powers(1, reach + 1)
    hashes = np.zeros((len(live), reach + 1), np.uint64)
    np.cumsum(_BYTE_VALUES[1][left[live]] * forward[:reach], axis=1, out=hashes[:, 1:])
    for l in range(reach + 1):
        r = length - l
        valid = (left_size[live] >= l) & (right[live] >= r)
        chosen = live[valid]
        if len(chosen) < 2:
            continue
        same_right = np.cumsum(np.r_[True, common[1:] < r])[chosen].astype(np.uint64)
        keys = mix(same_right) + hashes[valid, l] * np.uint64(0xD1342543DE82EF95)
        _, inverse = np.unique(keys, return_inverse=True)
        least = np.full(len(chosen), _LAST)
        np.minimum.at(least, inverse, ids[chosen])
        masks[chosen[ids[chosen] > least[inverse]]] |= np.uint32(1 << l)
    back = np.empty(len(flat), np.uint32)
    back[flat] = masks
    return [part.tobytes() for part in np.split(back, starts[1:-1])]


def remove_repeated_strings(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """Remove every byte covered by a string of ``length`` bytes that also starts in a document with a smaller id.

    Texts are UTF-8 bytes; strings never cross documents, overlaps count, and all are judged on the
    input. ``length`` is between 24 and 51 bytes. Whole copies of an earlier text are found by two 64-bit hashes of
    the text and take no part in the merge. Nothing is capped: equal contexts are one entry a chunk.

    Null texts are empty. A null id comes after all others. Rows that share an id are not earlier
    than each other. Texts shorter than ``length`` lose nothing. An empty table gives no rows. Only the id (an
    integer) and text columns are read. Cuts may fall inside a character, so kept bytes are binary.

    Result: id, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept`` (binary; null
    if ``texts`` is false), ``kept_sha256``.
    """
    if not GRAM + 4 <= length <= GRAM + 31:
        raise ValueError("length must be between 24 and 51")
    sizes = layout(docs, text_col)
    density = 2 / (length - GRAM + 2)
    cells = Cells.sized(max(int(sizes.n_bytes * density), 1), CELLS_PER_ANCHOR, 1)
    n_buckets = max(8, int(sizes.n_bytes * density / 7 / BUCKET_ENTRIES))
    # Rows that share or lack an id are spread by their texts; a whole copy is known by its id and both hashes of its text.
    source = docs.select(
        chunk_of(F.xxhash64(id_col, text_col), sizes.n_chunks).alias("chunk"),
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).alias("text"),
        F.xxhash64(F.col(id_col).cast("long"), F.xxhash64(text_col), F.xxhash64(F.lit(1), text_col)).alias("copy"),
    )
    by_chunk = source.groupBy("chunk")

    # Whole copies: narrow rows, aggregated before they are joined, so a text that is copied very often spreads.
    hashed = source.where(F.octet_length("text") >= length).select(
        F.col("chunk").alias("home"), "copy", F.coalesce("id", F.lit(_LAST)).alias("id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")
    )
    firsts = hashed.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("most > least")
    copied = hashed.join(firsts, ["h1", "h2"]).where("id > least").select("home", "copy")
    copies = copied.groupBy("home", (F.lit(-1) - F.pmod("copy", F.lit(16))).cast("int").alias("part")).agg(F.collect_set("copy").alias("ids"))
    copies = copies.select(F.col("home").alias("chunk"), "part", F.lit(None).cast("binary").alias("payload"), "ids", F.lit("copy").alias("kind"))

    def copies_in(table: pa.Table) -> set[int]:
        return {i for ids in table.column("ids").to_pylist() if ids for i in ids}

    def answers_of(table: pa.Table, kind: str) -> dict[int, bytes]:
        table = table.filter(pa.compute.equal(table.column("kind"), kind))
        return dict(zip(table.column("part").to_pylist(), table.column("payload").to_pylist()))

    def packed(rows: list[tuple[int, bytes]], name: str, docs_table: pa.Table) -> pa.Table:
        chunk = docs_table.column("chunk")[0].as_py() if len(docs_table) else 0
        return pa.table(
            {name: pa.array([k for k, _ in rows], pa.int32()), "chunk": pa.array([chunk] * len(rows), pa.int32()), "payload": pa.array([p for _, p in rows], pa.binary())}
        )

    def sketch(docs_table: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(docs_table, copies_in(answers), length)
        return packed(pack_cells(chunk.cells(cells)[0], cells), "slice", docs_table)

    def merge(table: pa.Table) -> pa.Table:
        bits = merge_slice(table.column("payload").to_pylist(), cells)
        kept = [k for k, b in enumerate(bits) if any(b)]
        at = pa.array(kept, pa.int64())
        return pa.table(
            {"chunk": table.column("chunk").take(at), "part": table.column("slice").take(at), "payload": pa.array([bits[k] for k in kept], pa.binary())}
        )

    def sorted_run(docs_table: pa.Table, answers: pa.Table) -> tuple[Chunk, Run]:
        chunk = Chunk(docs_table, copies_in(answers), length)
        chunk.keep_repeated(cells, answers_of(answers, "cells"))
        return chunk, Run(chunk, length, n_buckets)

    def send(docs_table: pa.Table, answers: pa.Table) -> pa.Table:
        _, run = sorted_run(docs_table, answers)
        return packed([(b, run.front_coded(begin, end)) for b, begin, end in run.by_bucket()], "bucket", docs_table)

    def judge(table: pa.Table) -> pa.Table:
        masks = judge_bucket(table.column("payload").to_pylist(), length)
        return pa.table({"chunk": table.column("chunk"), "part": table.column("bucket"), "payload": pa.array(masks, pa.binary())})

    def finish(docs_table: pa.Table, answers: pa.Table) -> pa.Table:
        chunk, run = sorted_run(docs_table, answers)
        masks = np.zeros(len(run.heads), np.uint32)
        found = answers_of(answers, "masks")
        for bucket, begin, end in run.by_bucket():
            masks[begin:end] = np.frombuffer(found[bucket], np.uint32)
        of_anchor = masks[run.group]
        # Another document of this chunk has the same context and a smaller id.
        later = chunk.ids[chunk.docs[run.order]] > run.entry_ids[run.group]
        starts = []
        for l in range(length - GRAM + 1):
            valid = (run.left_size[run.order] >= l) & (run.right_size[run.order] >= length - l)
            starts.append(chunk.places[run.order[valid & (later | ((of_anchor >> np.uint32(l)) & 1).astype(bool))]] - l)
        marks = np.zeros(len(chunk.data) + length + 1, np.int32)
        repeated = np.zeros(len(chunk.data) + 1, bool)
        repeated[np.concatenate(starts)] = True
        at = np.flatnonzero(repeated)
        marks[at] += 1
        marks[at + length] -= 1
        removed = np.cumsum(marks[: len(chunk.data)]) > 0
        offsets = chunk.offsets
        for doc in np.flatnonzero(chunk.copied).tolist():
            removed[offsets[doc] : offsets[doc + 1]] = True
        n_removed, n_spans, kept, digests = [], [], [], []
        for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            gone = removed[begin:end]
            rest = chunk.data[begin:end][~gone].tobytes()
            n_removed.append(end - begin - len(rest))
            n_spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
            kept.append(rest if texts else None)
            digests.append(hashlib.sha256(rest).hexdigest())
        return pa.table(
            {
                "id": chunk.column,
                "n_bytes": pa.array(np.diff(offsets), pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "n_spans": pa.array(n_spans, pa.int64()),
                "kept": pa.array(kept, pa.binary()),
                "kept_sha256": pa.array(digests, pa.string()),
            }
        )

    def with_copies(answers: DataFrame, kind: str) -> DataFrame:
        return answers.select("chunk", "part", "payload", F.lit(None).cast("array<bigint>").alias("ids"), F.lit(kind).alias("kind"))

    requests = by_chunk.cogroup(copies.groupBy("chunk")).applyInArrow(sketch, "slice int, chunk int, payload binary")
    flags = with_copies(requests.groupBy("slice").applyInArrow(merge, "chunk int, part int, payload binary"), "cells").unionByName(copies)
    runs = by_chunk.cogroup(flags.groupBy("chunk")).applyInArrow(send, "bucket int, chunk int, payload binary")
    judged = runs.groupBy("bucket").applyInArrow(judge, "chunk int, part int, payload binary")
    answers = flags.unionByName(with_copies(judged, "masks"))
    done = by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(
        finish, "id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    )
    return done.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")
