"""Order-dependent operators that stay distributed when one group is huge.

A plain ``Window.partitionBy(group)`` sorts each group in one task. That is right for
the many groups of ordinary size, but when one group holds a large share of all rows
its task is the whole job. Groups above ``hot_rows`` are therefore cut along their
sort order into cells, and only per-cell totals cross cells; other groups are one cell
each. If no group is hot, adaptive execution finds the list of hot groups empty and
drops the whole splitting branch.

* ``coarse`` is a monotone bucket of the sort order whose number of values per
  group is bounded by the domain (minutes of a collection, blocks of an id).
* ``fine`` refines a coarse bucket, down to a hash prefix of the tie-breaker where
  many rows may share one instant.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of a group that one task sorts without trouble.
HOT_ROWS = 1_000_000
# Hot groups hold at least this fraction of all rows, which bounds their number at every size.
MOST_HOT = 10_000

_CELL, _GROUP, _HOT = "__cell", "__group", "__hot"


def _hot_groups(df: DataFrame, group: Sequence[str], hot_rows: int) -> DataFrame:
    """``__group`` of the groups above ``hot_rows`` and one ten-thousandth of all rows.

    Fewer than ``MOST_HOT`` groups are, which bounds what is broadcast whatever the input. Keys are
    structs, never null themselves, so rows with null group values are kept.
    """
    counts = df.select(F.struct(*group).alias(_GROUP)).groupBy(_GROUP).agg(F.count(F.lit(1)).alias("__n"))
    least = counts.agg(F.greatest(F.lit(hot_rows), F.coalesce(F.sum("__n"), F.lit(0)) / MOST_HOT)).scalar()
    return counts.filter(F.col("__n") > least).select(_GROUP, F.lit(True).alias(_HOT))


def _keyed(df: DataFrame, group: Sequence[str], cuts: Sequence[Column], hot: DataFrame) -> DataFrame:
    """Adds ``__hot`` and ``__cell``: the group, and for hot groups also the cuts."""
    marked = df.withColumn(_GROUP, F.struct(*group)).join(F.broadcast(hot), _GROUP, "left")
    return marked.withColumn(
        _CELL,
        F.struct(_GROUP, *[F.when(F.col(_HOT), cut).alias(f"cut{i}") for i, cut in enumerate(cuts)]),
    )


def number_rows(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    coarse: Column,
    fine: Sequence[Column] = (),
    name: str = "seq",
    start: int = 1,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Exact consecutive numbers per group in ``order``.

    ``coarse`` then ``fine`` then ``order`` must sort rows as ``order`` does. Rows of ordinary
    groups are shuffled once, on the group, and lie by it in what follows if no group is hot, so
    that sums by group need no further shuffle. Rows of hot groups are shuffled once on the cell: the
    join with the cell offsets and the numbering inside a cell share that partitioning.
    """
    cuts = [coarse, *fine]
    hot = _hot_groups(df, group, hot_rows)
    listed = df.withColumn(_GROUP, F.struct(*group))
    # Dealt before the order is worked out, so that what rows are ordered by is not shuffled with them.
    plain = listed.join(F.broadcast(hot), _GROUP, "left_anti").drop(_GROUP).repartition(*group)
    numbered = plain.withColumn(name, (F.row_number().over(Window.partitionBy(*group).orderBy(*order)) + F.lit(start - 1)).cast("long"))
    keyed = _keyed(listed.drop(_GROUP).join(F.broadcast(hot.drop(_HOT)), F.struct(*group) == F.col(_GROUP), "left_semi"), group, cuts, hot)
    span = F.struct(f"{_CELL}.{_GROUP}", f"{_CELL}.cut0")
    fine_order = [F.col(f"{_CELL}.cut{i}") for i in range(1, len(cuts))]

    cells = keyed.groupBy(_CELL).agg(F.count(F.lit(1)).alias("__n")).withColumn("__span", span)
    earlier = Window.unboundedPreceding, -1
    before_span = Window.partitionBy(f"__span.{_GROUP}").orderBy("__span.cut0").rowsBetween(*earlier)
    spans = (
        cells.groupBy("__span")
        .agg(F.sum("__n").alias("__n"))
        .select("__span", F.coalesce(F.sum("__n").over(before_span), F.lit(0)).alias("__before"))
    )
    inside_span = F.lit(0)
    if fine_order:
        before_cell = Window.partitionBy("__span").orderBy(*fine_order).rowsBetween(*earlier)
        inside_span = F.coalesce(F.sum("__n").over(before_cell), F.lit(0))
    offsets = (
        cells.withColumn("__inside", inside_span)
        .join(spans, "__span")
        .select(_CELL, (F.col("__before") + F.col("__inside")).alias("__offset"))
    )
    position = F.coalesce("__offset", F.lit(0)) + F.row_number().over(Window.partitionBy(_CELL).orderBy(*order))
    cut = keyed.join(offsets, _CELL, "left").withColumn(name, (position + F.lit(start - 1)).cast("long")).select(*df.columns, name)
    return numbered.unionByName(cut)


def held(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same rows by a plan that reads these columns of all rows down to the source, whatever follows.

    Two uses of numbered rows that read different columns or rows shuffle them once each; held alike, they share one shuffle. The
    condition always holds. It reads the columns, and the optimizer moves no filter past the row number in it.
    """
    reads = F.xxhash64(*columns).bitwiseOR(F.lit(1).cast("long")) != 0
    return df.filter(reads & (F.monotonically_increasing_id() >= 0))


def previous_row(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    coarse: Column,
    carry: Sequence[str],
    fine: Sequence[Column] = (),
    name: str = "previous",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Struct of ``carry`` from the row before in the group; null for its first row.

    Inside a cell this is ``lag``; the first row of a later cell takes the last row of
    the nearest earlier cell of its coarse bucket, or else of the nearest earlier bucket,
    found on tables with one row per cell and per bucket.
    """
    cuts = [coarse, *fine]
    keyed = _keyed(df, group, cuts, _hot_groups(df, group, hot_rows))
    row = F.struct(*carry)
    rank = F.struct(*[column.alias(f"o{i}") for i, column in enumerate(order)])
    span = F.struct(f"{_CELL}.{_GROUP}", f"{_CELL}.cut0")
    fine_order = [F.col(f"{_CELL}.cut{i}") for i in range(1, len(cuts))]
    cells = keyed.filter(F.col(_HOT)).groupBy(_CELL).agg(F.max(F.struct(rank.alias("rank"), row.alias("row"))).alias("__last")).withColumn("__span", span)
    before_span = Window.partitionBy(f"__span.{_GROUP}").orderBy("__span.cut0")
    spans = cells.groupBy("__span").agg(F.max("__last").alias("__end")).select("__span", F.lag("__end").over(before_span).alias("__earlier"))
    inside_span = F.lit(None)
    if fine_order:
        inside_span = F.lag("__last").over(Window.partitionBy("__span").orderBy(*fine_order))
    edges = (
        cells.withColumn("__inside", inside_span)
        .join(spans, "__span")
        .select(_CELL, F.coalesce("__inside", "__earlier").getField("row").alias("__edge"))
    )
    inside = F.lag(row).over(Window.partitionBy(_CELL).orderBy(*order))
    return (
        keyed.join(edges, _CELL, "left")
        .withColumn(name, F.coalesce(inside, F.col("__edge")))
        .drop(_CELL, _GROUP, _HOT, "__edge")
    )


def last_value_so_far(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    coarse: Column,
    value: Column,
    fine: Sequence[Column] = (),
    name: str = "last_value",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The last ``value`` that is not null among a row and those before it in its group.

    Inside a cell this is a running ``last``; where a cell has none yet, the last value of the nearest earlier cell that has one
    is carried over the edge, found on tables with one row per cell and per coarse bucket.
    """
    cuts = [coarse, *fine]
    valued = df.withColumn("__value", value)
    keyed = _keyed(valued, group, cuts, _hot_groups(valued, group, hot_rows))
    rank = F.struct(*[column.alias(f"o{i}") for i, column in enumerate(order)])
    span = F.struct(f"{_CELL}.{_GROUP}", f"{_CELL}.cut0")
    fine_order = [F.col(f"{_CELL}.cut{i}") for i in range(1, len(cuts))]
    held = F.max(F.when(F.col("__value").isNotNull(), F.struct(rank.alias("rank"), F.col("__value").alias("value"))))
    cells = keyed.filter(F.col(_HOT)).groupBy(_CELL).agg(held.alias("__last")).withColumn("__span", span)
    earlier = Window.unboundedPreceding, -1

    def carried(column: str, window: Window) -> Column:
        return F.last(column, ignorenulls=True).over(window.rowsBetween(*earlier))

    spans = cells.groupBy("__span").agg(F.max("__last").alias("__end"))
    spans = spans.select("__span", carried("__end", Window.partitionBy(f"__span.{_GROUP}").orderBy("__span.cut0")).alias("__earlier"))
    inside_span = carried("__last", Window.partitionBy("__span").orderBy(*fine_order)) if fine_order else F.lit(None)
    edges = (
        cells.withColumn("__inside", inside_span)
        .join(spans, "__span")
        .select(_CELL, F.coalesce("__inside", "__earlier").getField("value").alias("__edge"))
    )
    so_far = Window.partitionBy(_CELL).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        keyed.join(edges, _CELL, "left")
        .withColumn(name, F.coalesce(F.last("__value", ignorenulls=True).over(so_far), F.col("__edge")))
        .drop(_CELL, _GROUP, _HOT, "__edge", "__value")
    )


def as_of_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    tie: Sequence[str] = (),
    name: str = "found",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Each left row with ``name``: a struct of the last right row of its keys whose time is not after its own.

    Both sides are put on one time axis and sorted once; a left row takes the last right row before it. No row meets more than its
    predecessor, so many versions of one key cost no more than as many keys, and a hot key is cut along the time
    axis, by days and then seconds. At one time right rows come first, among themselves in the order of ``tie``, null first.
    Left rows without a time or before every right row get null; null keys match each other. Right rows without a time are left out.
    """
    columns = left.columns
    time = F.col("__time")
    both = left.select(*keys, F.col(left_time).alias("__time"), F.lit(True).alias("__asks"), F.struct(*[F.col(c) for c in columns]).alias("__left"), F.lit(None).alias("__right"))
    state = right.filter(F.col(right_time).isNotNull()).select(
        *keys, F.col(right_time).alias("__time"), F.lit(False).alias("__asks"), F.lit(None).alias("__left"), F.struct(*[F.col(c) for c in right.columns]).alias("__right")
    )
    order = [time, F.col("__asks"), *[F.col(f"__right.{c}") for c in tie]]
    placed = last_value_so_far(
        both.unionByName(state), keys, order, F.to_date(time), F.col("__right"), [F.date_trunc("second", time)], "__found", hot_rows
    )
    asked = placed.filter("__asks").select("__left.*", F.when(time.isNotNull(), F.col("__found")).alias(name))
    return asked.select(*columns, name)


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row per key; rows equal in ``order`` are ranked by their remaining columns.

    An aggregate, so a hot key is reduced before the shuffle.
    """
    keys = list(keys)
    payload = [c for c in df.columns if c not in keys]
    ranked = F.struct(
        *[column.alias(f"o{i}") for i, column in enumerate(order)], *[F.col(c).alias(f"p_{c}") for c in payload]
    )
    picked = df.groupBy(*keys).agg(F.max(ranked).alias("__row"))
    return picked.select(*keys, *[F.col(f"__row.p_{c}").alias(c) for c in payload]).select(*df.columns)
