"""Points and the intervals that hold them, as an equi-join over cells of many widths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells are 2^36 microseconds (19 hours) wide, or wider by factors of 8 up to 36,000 years.
LEVELS = tuple(range(36, 61, 3))
#: Cells of the lowest level a key's points may lie in for its intervals to be looked through; a key with more keeps them all.
FEW_CELLS = 256


def _level(length: Column) -> Column:
    """The lowest level whose cells are at least as wide as an interval."""
    level = F.lit(LEVELS[-1])
    for candidate in reversed(LEVELS[:-1]):
        level = F.when(length <= F.lit(1 << candidate), F.lit(candidate)).otherwise(level)
    return level


def _cell(micros: Column, level: Column) -> Column:
    """Level and cell in one number."""
    return F.call_function("shiftright", micros, level) * 64 + level


def _gaps(intervals: DataFrame) -> DataFrame:
    """What lies between the first and the last instant of a key and in none of its intervals.

    Intervals that start at one instant are one row first. How far those before a row reach is found in two steps, so that no task
    sorts a key: over the buckets of 19 hours of the key, and over the starts inside a bucket.
    """
    starts = (
        intervals.groupBy("__key", "__first")
        .agg(F.max("__last").alias("__last"))
        .withColumn("__bucket", F.shiftright("__first", LEVELS[0]))
    )
    earlier = Window.unboundedPreceding, -1
    before = F.max("__most").over(Window.partitionBy("__key").orderBy("__bucket").rowsBetween(*earlier))
    inside = F.max("__last").over(Window.partitionBy("__key", "__bucket").orderBy("__first").rowsBetween(*earlier))
    buckets = starts.groupBy("__key", "__bucket").agg(F.max("__last").alias("__most")).select("__key", "__bucket", before.alias("__before"))
    reach = starts.withColumn("__inside", inside).join(buckets, ["__key", "__bucket"]).withColumn("__reach", F.greatest("__inside", "__before"))
    return reach.filter(F.col("__first") > F.col("__reach") + 1).select(
        "__key", (F.col("__reach") + 1).alias("__from"), (F.col("__first") - 1).alias("__to")
    )


def _near(intervals: DataFrame, points: DataFrame, at: Column, key: str) -> DataFrame:
    """The intervals that share a cell of the lowest level with a point of their key.

    Only these can hold a point. What is hashed is a short list for each key, beside which the intervals stream by, so a plan of many windows
    and few items is dropped where it is made. Intervals that are already dealt by their key are not moved for it.
    """
    places = points.select(F.col(key).alias("__near_key"), F.shiftright(at, LEVELS[0]).alias("__place")).filter(
        "__near_key IS NOT NULL AND __place IS NOT NULL"
    )
    found = places.groupBy("__near_key").agg(F.collect_set("__place").alias("__places"))
    few = F.when(F.size("__places") <= FEW_CELLS, F.col("__places")).otherwise(F.array(F.lit(None).cast("long")))
    listed = found.select("__near_key", F.explode(few).alias("__place")).hint("shuffle_hash")
    place, first, last = F.col("__place"), F.shiftright("__first", LEVELS[0]), F.shiftright("__last", LEVELS[0])
    return intervals.join(listed, (F.col("__key") == F.col("__near_key")) & (place.isNull() | place.between(first, last)), "left_semi")


def join_points(points: DataFrame, at: Column, intervals: DataFrame, first: Column, last: Column, key: str) -> DataFrame:
    """Every point with the other columns of each interval of its ``key`` that holds it; one row of nulls where none does.

    ``at``, ``first`` and ``last`` are microseconds, both ends included. An interval lies in at most two cells of the level
    nearest above its length, however long it is, and a point probes one cell for each level that its key uses (nine at most, one or
    two for a plan of like windows). Every interval of a cell is at least an eighth as long as the cell, the lowest level aside, so a
    point meets few that do not hold it. A key's points spread over its cells.

    Intervals without a point near them are left out first, so what is shuffled follows the points and what they meet, not the plan.
    Points outside the whole range of their key, and those without key or time, probe nothing. Gaps inside that range are intervals
    of their own (also where an interval was left out, which no point is in), so a point that probes meets something in exactly the levels
    that hold it and no second pass looks for points without an interval.
    """
    columns = [c for c in intervals.columns if c != key]
    ranged = intervals.select(
        F.col(key).alias("__key"), first.alias("__first"), last.alias("__last"), F.struct(*columns).alias("__found")
    ).filter("__first <= __last AND __key IS NOT NULL")
    ranged = _near(ranged, points, at, key)
    gaps = _gaps(ranged).select(
        "__key", F.col("__from").alias("__first"), F.col("__to").alias("__last"), F.lit(None).cast(ranged.schema["__found"].dataType).alias("__found")
    )
    levelled = ranged.unionByName(gaps).withColumn("__level", _level(F.col("__last") - F.col("__first") + 1))
    spans = levelled.groupBy(F.col("__key").alias("__span_key")).agg(
        F.collect_set("__level").alias("__levels"), F.min("__first").alias("__least"), F.max("__last").alias("__most")
    )
    ends = F.array_distinct(F.array(_cell(F.col("__first"), F.col("__level")), _cell(F.col("__last"), F.col("__level"))))
    cells = levelled.withColumn("__bin", F.explode(ends)).drop("__level")

    asked = points.withColumn("__at", at).join(spans, F.col(key) == F.col("__span_key"), "left")
    inside = F.col("__at").between(F.col("__least"), F.col("__most"))
    probes = F.when(inside, F.transform("__levels", lambda level: _cell(F.col("__at"), level)))
    probing = asked.withColumn("__item_bin", F.explode_outer(probes)).drop("__span_key", "__levels", "__least", "__most")
    held = F.col("__at").between(F.col("__first"), F.col("__last"))
    met = probing.join(cells, (F.col(key) == F.col("__key")) & (F.col("__item_bin") == F.col("__bin")) & held, "left")
    return met.filter("__item_bin IS NULL OR __bin IS NOT NULL").select(*points.columns, *[F.col(f"__found.{c}").alias(c) for c in columns])
