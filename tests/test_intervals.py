"""Interval joins and shards by density against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from casetrail.operators import intervals as intervals_module
from casetrail.operators import shards
from casetrail.operators.density import DensityOptions, daily_density, density_shards, merge_density
from casetrail.operators.intervals import LEVELS, join_points

HOUR = 3_600_000_000
POINTS, INTERVALS = "id long, key string, at long", "key string, job long, first long, last long"


def brute(points, intervals):
    out = []
    for pid, key, at in points:
        jobs = [j for k, j, a, b in intervals if k is not None and k == key and at is not None and a <= at <= b]
        out += [(pid, j) for j in jobs] or [(pid, None)]
    return sorted(out, key=str)


def joined(spark, points, intervals):
    frame = join_points(
        spark.createDataFrame(points, POINTS), F.col("at"), spark.createDataFrame(intervals, INTERVALS), F.col("first"), F.col("last"), "key"
    )
    assert frame.columns == ["id", "key", "at", "job", "first", "last"]
    return sorted(((r.id, r.job) for r in frame.collect()), key=str)


def test_points_meet_the_intervals_that_hold_them(spark):
    rng = random.Random(1)
    intervals = []
    for job in range(120):
        length = int(10 ** rng.uniform(0, 17))  # an instant to three millennia
        first = rng.randint(-(10**15), 2 * 10**15)
        intervals.append((rng.choice(["a", "a", "a", "b", None]), job, first, first + length - 1))
    intervals.append(("a", 999, 10, 9))  # holds nothing
    edges = [v for _, _, a, b in intervals for v in (a - 1, a, b, b + 1)]
    points = [(i, rng.choice(["a", "b", "c", None]), at) for i, at in enumerate(edges)]
    points += [(9000 + i, "a", rng.randint(-(10**15), 2 * 10**15)) for i in range(100)] + [(9999, "a", None)]
    points += points[:5]  # repeated rows stay repeated
    assert joined(spark, points, intervals) == brute(points, intervals)


def test_points_in_gaps_and_without_intervals(spark):
    day = 24 * HOUR
    intervals = [("a", 1, 0, day - 1), ("a", 2, day, 2 * day - 1), ("a", 3, 4000 * day, 4001 * day)]
    points = [(1, "a", 5), (2, "a", day), (3, "a", 3000 * day), (4, "a", -1), (5, "a", 4001 * day), (6, "a", 4001 * day + 1), (7, "z", 5)]
    assert joined(spark, points, intervals) == brute(points, intervals)
    assert joined(spark, points, []) == sorted(((p[0], None) for p in points), key=str) and joined(spark, [], intervals) == []


def test_a_window_has_two_cells_at_most(spark):
    """The plan spreads an interval over an array of two, whatever its length."""
    intervals = spark.createDataFrame([("a", 1, 0, 10**17)], INTERVALS)
    frame = join_points(spark.createDataFrame([], POINTS), F.col("at"), intervals, F.col("first"), F.col("last"), "key")
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and "array_distinct(array(" in plan and len(LEVELS) == 9


def test_only_intervals_near_a_point_are_cut_into_cells(spark):
    """One key has few points, one more cells than are listed, one none; what is dropped changes no row."""
    day = 24 * HOUR
    intervals = [(key, n, n * day, (n + 1) * day - 1) for key in "abc" for n in range(400)] + [("a", 1000, 0, 400 * day)]
    points = [(1, "a", 7 * day), (2, "a", 300 * day + 5), (3, "a", 900 * day)] + [(10 + n, "b", n * day + n) for n in range(intervals_module.FEW_CELLS + 20)]
    ranged = spark.createDataFrame(intervals, "__key string, job long, __first long, __last long")
    near = intervals_module._near(ranged, spark.createDataFrame(points, POINTS), F.col("at"), "key")
    counts = {r["__key"]: r["count"] for r in near.groupBy("__key").count().collect()}
    # Two days with their neighbours in a cell, and the long one.
    assert 3 <= counts["a"] <= 7 and counts["b"] == 400 and "c" not in counts
    assert joined(spark, points, intervals) == brute(points, intervals)


def test_windows_of_a_plan_are_not_shuffled_to_meet_items(spark):
    """Requests are dealt by custodian before they become windows; above the windows the first operator is the join that drops them."""
    requests = spark.createDataFrame(
        [(n, [f"u{n}"], "Email", dt.datetime(2020, 1, 1), dt.datetime(2024, 1, 1)) for n in range(20)],
        "job_id long, custodians array<string>, job_type string, start_date timestamp, end_date timestamp",
    )
    options = [shards.ShardOptions(window_days=3, max_shards_per_custodian=400), shards.ShardOptions()]
    windows = shards.shard_windows(requests, options[0]).unionByName(shards.shard_windows(requests, options[1]))
    items = spark.createDataFrame([(n, f"u{n}", dt.datetime(2021, 5, 1)) for n in range(20)], "id long, custodian string, item_date timestamp")
    found = shards.assign_items(items, windows)
    assert found.count() == 20 and found.filter("shard_index IS NULL").isEmpty()
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    lines = plan.splitlines()
    made = [i for i, line in enumerate(lines) if "Generate explode(sequence(" in line]
    above = [next(line for line in reversed(lines[:i]) if "Exchange" in line or "Join" in line) for i in made]
    assert made and all("LeftSemi" in line for line in above)


def greedy(days, start, end, options):
    """One shard at a time: the longest run of days that fits, its end moved back to the last edge in it."""

    def period(day):
        return day.replace(day=1) if options.align == "month" else day - dt.timedelta(days=day.weekday())

    fits = lambda run: len(run) <= 1 or (sum(d[1] for d in run) <= options.max_items and sum(d[2] for d in run) <= options.max_bytes)
    out, at, rest = [], start, list(days)
    while True:
        n = len(rest)
        while n and not fits(rest[:n]):
            n -= 1
        if n == len(rest):
            return out + [(at, end, sum(d[1] for d in rest), sum(d[2] for d in rest))]
        edge = rest[n][0]
        if options.align:
            # Edges behind the first day that holds something, up to the day that does not fit.
            inside = [p for d in rest[1 : n + 1] if (p := period(d[0])) > rest[0][0]]
            edge = max(inside, default=edge)
        taken = [d for d in rest if d[0] < edge]
        out.append((at, edge, sum(d[1] for d in taken), sum(d[2] for d in taken)))
        at, rest = edge, rest[len(taken) :]


@pytest.mark.parametrize("align", [None, "month", "week"])
def test_shards_follow_density(spark, align):
    rng, base = random.Random(7), dt.datetime(2023, 1, 5)
    options = DensityOptions(20, 5_000, align)
    items, requests, want = [], [], []
    for job in range(25):
        who, start = f"u{job}", base + dt.timedelta(days=rng.randint(0, 20), hours=rng.choice([0, 7]))
        end = start + dt.timedelta(days=rng.randint(1, 300), hours=rng.choice([0, 5]))
        requests.append((job, [who], "Email", start, end))
        days = {}
        for _ in range(rng.choice([0, 1, 40, 200])):
            at = start + dt.timedelta(seconds=rng.randint(0, int((end - start).total_seconds()) - 1))
            at = at if rng.random() < 0.7 else start + dt.timedelta(days=1)  # one busy day
            if at >= end:
                continue
            size = rng.randint(0, 900)
            items.append((who, at, size))
            day = dt.datetime(at.year, at.month, at.day)
            n, b = days.get(day, (0, 0))
            days[day] = (n + 1, b + size)
        want += [(job, *s) for s in greedy([(d, *v) for d, v in sorted(days.items())], start, end, options)]
    made = spark.createDataFrame(items, "custodian string, item_date timestamp, size_bytes long")
    asked = spark.createDataFrame(requests, "job_id long, custodians array<string>, job_type string, start_date timestamp, end_date timestamp")
    halves = [daily_density(made.filter(F.col("size_bytes") % 2 == k)) for k in (0, 1)]
    rows = density_shards(asked, merge_density(*halves), options).collect()
    assert sorted((r.job_id, r.start_date, r.end_date, r.estimated_items, r.estimated_bytes) for r in rows) == sorted(want)
    assert any(r.over_limit for r in rows)


def test_density_of_odd_rows(spark):
    made = spark.createDataFrame(
        [("u", dt.datetime(2024, 1, 1), None), (None, dt.datetime(2024, 1, 1), 5), ("u", None, 5)], "custodian string, item_date timestamp, size_bytes long"
    )
    assert [tuple(r) for r in daily_density(made).collect()] == [("u", dt.date(2024, 1, 1), 1, 0)]
    with pytest.raises(ValueError):
        DensityOptions(align="year")
