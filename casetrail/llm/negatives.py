"""Hard negatives of anchors: scored in blocks, sorted by (anchor, descending score, id) and read once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casetrail.llm.common import cut
from casetrail.session import ship

#: Rows of a block are in proportion to the square root of all rows, between these bounds.
LEAST_BLOCK, MOST_BLOCK = 1 << 10, 1 << 15
#: Anchors scored at a time.
STRIP = 256
# Stands for a null id, which comes after all others.
_LAST = np.iinfo(np.int64).max

_PACKED = "block long, ids binary, labels binary, uids binary, width int, vectors binary"


def pack(table: pa.Table, scale: int) -> pa.Table:
    """One row with all vectors of a block, in order of their ids; components become ``floor(scale * x)``."""
    order = np.lexsort((np.asarray(table.column("uid")), np.asarray(table.column("id"))))
    vectors = table.column("vector").combine_chunks()
    lengths = np.asarray(pa.compute.list_value_length(vectors)).astype(np.int64)
    whole = np.zeros((len(lengths), int(lengths.max(initial=0))))
    flat = np.floor(scale * np.asarray(vectors.flatten(), dtype=np.float64))
    row = np.repeat(np.arange(len(lengths)), lengths)
    whole[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    whole = whole[order]
    narrow = whole.astype(np.float32)
    stored = narrow if np.array_equal(narrow, whole) else whole
    columns = {name: np.ascontiguousarray(np.asarray(table.column(name))[order]).astype(np.int64).tobytes() for name in ("id", "label", "uid")}
    return pa.table(
        {
            "block": pa.array([table.column("block")[0].as_py()], pa.int64()),
            "ids": pa.array([columns["id"]], pa.binary()),
            "labels": pa.array([columns["label"]], pa.binary()),
            "uids": pa.array([columns["uid"]], pa.binary()),
            "width": pa.array([whole.shape[1] * (1 if stored is narrow else -1)], pa.int32()),
            "vectors": pa.array([stored.tobytes()], pa.binary()),
        }
    )


class Block:
    """The rows of one packed block."""

    def __init__(self, row: dict, prefix: str):
        self.ids, self.labels, self.uids = (np.frombuffer(row[prefix + name], np.int64) for name in ("ids", "labels", "uids"))
        width = row[prefix + "width"]
        kind = np.float32 if width >= 0 else np.float64
        self.vectors = np.frombuffer(row[prefix + "vectors"], kind).reshape(len(self.ids), abs(width)).astype(np.float64)

    def __len__(self) -> int:
        return len(self.ids)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products, exactly; a component that one side lacks is 0, and results end at the range of a long."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if width * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 2.0**53:
        return (a @ b.T).astype(np.int64)
    exact = np.frompyfunc(int, 1, 1)
    found = np.asarray(exact(a).dot(exact(b).T)) if width else np.zeros((len(a), len(b)), object)
    return np.frompyfunc(lambda x: min(max(x, -(2**63)), 2**63 - 1), 1, 1)(found).astype(np.int64)


def strips(anchors: Block, rows: Block) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, scores of all rows, which rows may be its positives), one anchor at a time."""
    for begin in range(0, len(anchors), STRIP):
        found = scores(anchors.vectors[begin : begin + STRIP], rows.vectors)
        for k, own in enumerate(found, begin):
            same = (rows.labels == anchors.labels[k]) & (rows.uids != anchors.uids[k])
            yield k, own, same


def first_by_score(own: np.ndarray, among: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` of the places ``among``, which are in order of id, by descending score and then id."""
    if len(among) > n:
        least = np.partition(own[among], len(among) - n)[len(among) - n]
        among = among[own[among] >= least]
    return among[np.argsort(-own[among], kind="stable")][:n]


def _in_cells(blocks: DataFrame, anchors: DataFrame, run, schema: str) -> DataFrame:
    """Let each block of anchors meet each block of rows in a task of its own."""
    n_rows, n_anchors = (int(x.agg(F.max("block").alias("n")).first()["n"] or 0) + 1 for x in (blocks, anchors))
    left = anchors.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("cell")).withColumnRenamed("block", "anchor_block")
    right = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1))).alias("anchor_block")).withColumn("cell", F.col("block").cast("int"))
    right = right.withColumn("anchor_block", F.col("anchor_block").cast("long"))
    return left.groupBy("anchor_block", "cell").cogroup(right.groupBy("anchor_block", "cell")).applyInArrow(run, schema)


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """For each anchor and each of its first positives, the first negatives whose score is ``low`` to ``high`` percent of the positive's.

    A component x counts as ``floor(scale * x)``, x as double; a score is the integer inner product with the anchor. Positives
    are the other rows of the anchor's label, negatives the rows of other labels, both by descending score and then by id.

    Every block of anchors is scored against every block of rows. Of each pair of blocks only those pairs go on that can be in the result: an
    anchor's best positives there, and the first negatives there of each window, whose bounds follow from the anchor's positives of a
    first pass. What goes on is keyed by (anchor, descending score, id), repartitioned by anchor and sorted within
    partitions; one pass over it opens a window at each positive and gives out the negatives that fall into it. At equal scores positives come
    first, so a window is open before its negatives come. No anchor's pairs are ever held together.

    Rows with a null label, a null vector or a null or non-finite component take no part. Rows equal in id, label and vector
    count once; rows that share only the id are rows of their own. A null id comes after all others and is no anchor unless
    ``is_anchor`` says so. Vectors may differ in length; missing components are 0. An empty table gives no rows. Other columns may have any name.

    Result: ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.
    """
    ship(rows.sparkSession)
    vector = F.col(vector_col)
    fit = F.col(label_col).isNotNull() & vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    chosen = rows.where(fit).select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.col(label_col).cast("long").alias("label"), vector.alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor")
    )
    chosen = cut(chosen.dropDuplicates(["id", "label", "vector"]).withColumn("uid", F.xxhash64("id", "label", "vector")))
    sizes = chosen.agg(F.count(F.lit(1)).alias("rows"), F.count_if("anchor").alias("anchors")).first()
    block = min(MOST_BLOCK, max(LEAST_BLOCK, 8 * round(sizes["rows"] ** 0.5)))

    def packed(frame: DataFrame, n: int) -> DataFrame:
        dealt = frame.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(1 + n // block)))
        return cut(dealt.groupBy("block").applyInArrow(lambda t: pack(t, scale), _PACKED))

    blocks = packed(chosen, sizes["rows"])
    anchors = packed(chosen.where("anchor"), sizes["anchors"])

    def best_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        anchor, score = [], []
        if len(left) and len(right):
            a, r = Block(left.to_pylist()[0], ""), Block(right.to_pylist()[0], "")
            for k, own, same in strips(a, r):
                found = own[first_by_score(own, np.flatnonzero(same), positives)].tolist()
                anchor += [k] * len(found)
                score += found
        cell = left.column("anchor_block")[0].as_py() if len(left) else 0
        return pa.table({"block": pa.array([cell] * len(anchor), pa.int64()), "k": pa.array(anchor, pa.int64()), "score": pa.array(score, pa.int64())})

    first = _in_cells(blocks, anchors, best_positives, "block long, k long, score long")
    order = Window.partitionBy("block", "k").orderBy(F.col("score").desc())
    first = first.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives)
    # A list of a block's anchors, so at most as long as the block.
    bounds = first.groupBy("block").agg(F.collect_list("k").alias("window_k"), F.collect_list("score").alias("window_score"))

    def pairs(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[str, list] = {"anchor_id": [], "anchor_uid": [], "down": [], "kind": [], "id": []}
        if len(left) and len(right):
            row = left.to_pylist()[0]
            a, r = Block(row, ""), Block(right.to_pylist()[0], "")
            windows: dict[int, set] = {}
            for k, score in zip(row["window_k"] or (), row["window_score"] or ()):
                windows.setdefault(k, set()).add(score)
            for k, own, same in strips(a, r):
                mine = windows.get(k)
                if not mine:
                    continue
                # The least and the largest integer score inside each window.
                edges = sorted((-(-low * p // 100), high * p // 100) for p in mine)
                other = np.flatnonzero((r.labels != a.labels[k]) & (own >= edges[0][0]) & (own <= max(e[1] for e in edges)))
                other = other[np.argsort(-own[other], kind="stable")]
                falling = -own[other]
                kept: set[int] = set()
                for least, most in edges:
                    at = int(np.searchsorted(falling, -most, side="left"))
                    kept.update(j for j in other[at : at + negatives].tolist() if own[j] >= least)
                near = first_by_score(own, np.flatnonzero(same), positives).tolist()
                for kind, places in ((0, near), (1, sorted(kept))):
                    found["anchor_id"] += [int(a.ids[k])] * len(places)
                    found["anchor_uid"] += [int(a.uids[k])] * len(places)
                    found["down"] += (-own[places]).tolist() if places else []
                    found["kind"] += [kind] * len(places)
                    found["id"] += r.ids[places].tolist() if places else []
        return pa.table(found, schema=pa.schema([("anchor_id", pa.int64()), ("anchor_uid", pa.int64()), ("down", pa.int64()), ("kind", pa.int32()), ("id", pa.int64())]))

    keyed = _in_cells(blocks, anchors.join(bounds, "block", "left"), pairs, "anchor_id long, anchor_uid long, down long, kind int, id long")
    key = ["anchor_id", "anchor_uid", "down", "kind", "id"]
    dealt = keyed.repartition("anchor_id", "anchor_uid").sortWithinPartitions(*key)

    def windows_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, opened = None, []
        for batch in batches:
            out = []
            for anchor, uid, down, kind, other in zip(*(batch.column(c).to_pylist() for c in key)):
                if at != (anchor, uid):
                    at, opened = (anchor, uid), []
                if kind == 0:
                    if len(opened) < positives:
                        opened.append([other, -down, 0])
                    continue
                for window in opened:
                    if window[2] < negatives and low * window[1] <= -100 * down <= high * window[1]:
                        window[2] += 1
                        out.append((anchor, window[0], window[2], other, window[1], -down))
            columns = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
            )

    mined = dealt.mapInArrow(windows_open, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    own = lambda c: F.when(F.col(c) != _LAST, F.col(c)).alias(c)
    return mined.select(own("anchor_id"), own("positive_id"), "rank", own("negative_id"), "positive_score", "negative_score")
