"""Sharding by longest-processing-time scheduling: equal texts stay together, shards get near equal bytes."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from casetrail.session import ship

# A group of at least this fraction of a shard is scheduled on its own, so at most SHARE groups a shard are.
SHARE = 512
# Smaller groups are scheduled in bundles; the count is fixed, so the heap's input is bounded at every size.
BUNDLES = 8192
# Cells per shard in which slots are numbered.
CELLS = 512


def least_loaded(n_shards: int):
    """Longest item first to the least-loaded shard; ties go to the lower item key and the lower shard."""

    def schedule(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["bytes", "big", "item"], ascending=[False, False, True], kind="stable")
        heap = [(0, shard) for shard in range(n_shards)]
        placed = []
        for size in items["bytes"].tolist():
            load, shard = heap[0]
            heapq.heapreplace(heap, (load + size, shard))
            placed.append(shard)
        return pd.DataFrame({"big": items["big"], "item": items["item"], "shard": pd.Series(placed, index=items.index, dtype="int32")})

    return schedule


def shard_by_size(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every row.

    Rows of equal text form a group and get the same shard. A row's size is the UTF-8 length of its
    text plus 1 (null: 1). Groups that reach 1/512 of a shard enter the heap one by one; all smaller
    ones are hashed into 8192 bundles that enter it whole, so the heap sees at most
    ``512 * n_shards + 8192`` items whatever the input, and no shard exceeds another by more than its
    last item, unless one group alone is larger. Slots number a shard's rows from 0 without gaps.

    Null and empty texts are one group. Repeated rows are kept, each with its own slot. Null ids are
    allowed. An empty table gives no rows. Only the id and text columns are read, so other columns
    may have any name. Result: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("__id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("__key"),
    ).withColumn("__bundle", F.pmod("__key", F.lit(BUNDLES)))

    groups = base.groupBy("__key", "__bundle").agg(F.sum("size").alias("bytes"))
    total = groups.agg(F.sum("bytes").alias("total")).scalar()
    judged = groups.withColumn("big", F.col("bytes") * n_shards * SHARE >= total)
    items = (
        judged.withColumn("item", F.when(F.col("big"), F.col("__key")).otherwise(F.col("__bundle")))
        .groupBy("big", "item")
        .agg(F.sum("bytes").alias("bytes"))
    )
    placed = items.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(least_loaded(n_shards), "big boolean, item long, shard int")
    # Both sides below have a bound that does not depend on the input (see the constants).
    alone = placed.where("big").select(F.col("item").alias("__key"), F.col("shard").alias("__alone"))
    bundled = placed.where("NOT big").select(F.col("item").alias("__bundle"), F.col("shard").alias("__bundled"))
    located = (
        base.join(F.broadcast(alone), "__key", "left")
        .join(F.broadcast(bundled), "__bundle", "left")
        .withColumn("shard", F.coalesce("__alone", "__bundled"))
        .withColumn("__cell", F.pmod(F.xxhash64("__id", "__key"), F.lit(CELLS)))
    )
    counts = located.groupBy("shard", "__cell").agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy("shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "__cell", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("shard", "__cell").orderBy(F.col("__id").asc_nulls_last(), "__key")
    numbered = located.withColumn("__row", F.row_number().over(inside))
    return numbered.join(F.broadcast(offsets), ["shard", "__cell"]).select(
        F.col("__id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("__offset") + F.col("__row") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
