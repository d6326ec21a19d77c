"""Ordered operators against brute force, with one group holding most rows."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from casetrail.operators import custody
from casetrail.operators.digests import ordered_digest
from casetrail.operators.ordering import as_of_join, held, latest_by, number_rows, previous_row
from casetrail.sinks import files


@pytest.fixture(scope="module")
def skewed(spark):
    """Most rows in group 1, many at one instant; some rows without a group."""
    rng = random.Random(7)
    data = []
    for i in range(6000):
        group = 1 if rng.random() < 0.7 else rng.choice([2, 3, None])
        second = 0 if rng.random() < 0.4 else rng.randrange(0, 7200)
        data.append((group, second, f"k{i}"))
    frame = spark.createDataFrame(data, "g int, s long, k string").withColumn("ts", F.timestamp_seconds("s"))
    return frame, data


def ordered(data, group):
    keyed = [(s, hashlib.md5(k.encode()).hexdigest(), k) for g, s, k in data if g == group]
    return [k for _, _, k in sorted(keyed)]


@pytest.mark.parametrize("hot_rows", [10, 3000, 1_000_000])
def test_number_rows(skewed, hot_rows):
    frame, data = skewed
    tie = F.md5("k")
    out = number_rows(
        frame, ["g"], [F.col("ts"), tie, F.col("k")], F.date_trunc("minute", "ts"),
        [F.col("ts"), F.substring(tie, 1, 2)], hot_rows=hot_rows,
    )
    got = {(r.g, r.seq): r.k for r in out.collect()}
    assert len(got) == len(data)
    for group in (1, 2, 3, None):
        for position, key in enumerate(ordered(data, group), start=1):
            assert got[group, position] == key


@pytest.mark.parametrize("fine", [False, True])
@pytest.mark.parametrize("hot_rows", [10, 1_000_000])
def test_previous_row(skewed, hot_rows, fine):
    frame, data = skewed
    tie = F.md5("k")
    cuts = [F.col("ts"), F.substring(tie, 1, 1)] if fine else []
    out = previous_row(
        frame, ["g"], [F.col("ts"), tie, F.col("k")], F.date_trunc("hour", "ts"), ["k"], cuts, hot_rows=hot_rows
    )
    got = {(r.g, r.k): (r.previous.k if r.previous else None) for r in out.collect()}
    for group in (1, 2, 3, None):
        last = None
        for key in ordered(data, group):
            assert got[group, key] == last
            last = key


def test_latest_by(skewed):
    frame, data = skewed
    got = {r.g: r.k for r in latest_by(frame, ["g"], [F.col("s")]).collect()}
    for group in (1, 2, 3, None):
        newest = max(s for g, s, _ in data if g == group)
        assert got[group] in {k for g, s, k in data if g == group and s == newest}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def items(spark, data):
    return spark.createDataFrame(
        data, "job_id long, item_id string, collected_date timestamp_ntz, sha256 string, size_bytes long, is_successful boolean"
    ).withColumn("collected_date", F.col("collected_date").cast("timestamp"))


def test_items_hash_of_two(spark):
    import datetime as dt

    day = dt.datetime(2024, 1, 1)
    frame = items(
        spark,
        [
            (1, "b", day + dt.timedelta(hours=1), sha("beta"), 2, True),
            (1, "a", day, sha("alpha"), 1, False),
        ],
    )
    row = custody.items_hash(custody.collection_sequence(frame)).first()
    assert row.items_hash == sha("0cb0309affcf4f994813ec26b8afc7e0b758605a04641de9871e04363de5e6b8")
    assert row.items_hash_scheme == "sha256-chunks-250000"
    totals = custody.manifest_totals(frame).first()
    assert (totals.total_items, totals.failed_items, totals.total_size_bytes) == (2, 1, 2)


def test_empty_job_has_the_empty_digest(spark):
    frame = items(spark, [])
    jobs = spark.createDataFrame(
        [(5, 1, "u", "Email", "GraphApi", None, None)],
        "job_id long, matter_id long, custodian string, job_type string, route string, start_time timestamp, end_time timestamp",
    )
    row = custody.job_manifests(jobs, frame, F.lit("2024-01-01").cast("timestamp")).first()
    assert row.items_hash == hashlib.sha256(b"").hexdigest()
    assert row.total_items == 0


def test_digest_tree_matches_brute_force(spark):
    data = [(1, i, sha(str(i))) for i in range(1, 26)] + [(2, 1, sha("x"))]
    frame = spark.createDataFrame(data, "g int, seq long, h string")
    out = {r.g: r for r in ordered_digest(frame, ["g"], "seq", F.col("h"), chunk_rows=10).collect()}
    chunks = [sha("".join(sha(str(i)) for i in range(a, min(a + 10, 26)))) for a in (1, 11, 21)]
    assert out[1].digest == sha("".join(chunks)) and out[1].digest_scheme == "sha256-chunks-10"
    # One chunk has the same definition as many.
    assert out[2].digest == sha(sha(sha("x"))) and out[2].digest_scheme == "sha256-chunks-10"


@pytest.mark.parametrize("chunk_rows", [5, 6, 7])
def test_every_chunk_has_its_brackets(spark, chunk_rows):
    frame = spark.createDataFrame([(1, i, str(i)) for i in range(1, 7)], "g int, seq long, h string")
    row = ordered_digest(frame, ["g"], "seq", F.col("h"), ",", "[", "]", chunk_rows).first()
    texts = ["[" + ",".join(map(str, range(a, min(a + chunk_rows, 7)))) + "]" for a in range(1, 7, chunk_rows)]
    assert row.digest == sha("".join(map(sha, texts)))


def test_digests_do_not_depend_on_partitioning(spark, small, rows):
    from casetrail.plans import domain

    frame = domain.items(spark, small)
    results = [
        rows(custody.items_hash(custody.collection_sequence(frame.repartition(n), hot_rows=hot)))
        for n, hot in ((1, 1_000_000), (17, 5))
    ]
    assert results[0] == results[1]


@pytest.mark.parametrize("hot_rows", [50, 1_000_000])
def test_as_of_join(spark, hot_rows):
    """One scope with most versions and requests, equal times, long stretches without a version, rows before the first."""
    rng = random.Random(11)
    scope = lambda: "hot" if rng.random() < 0.8 else rng.choice(["a", "b", None])
    at = lambda: rng.choice([0, 3, 3, 86_400 * 9]) + rng.randrange(0, 86_400 * 3, 1800)
    history = [(scope(), at(), k) for k in range(900)] + [("hot", None, 5000), ("b", 0, None), ("b", 0, 7000)]
    asked = [(k, scope(), rng.choice([at(), -5, 86_400 * 20, None])) for k in range(1200)] + [(2000, "nobody", 5)]
    right = spark.createDataFrame(history, "scope string, s long, version long").withColumn("ts", F.timestamp_seconds("s"))
    left = spark.createDataFrame(asked, "request long, scope string, s long").withColumn("at", F.timestamp_seconds("s"))
    found = as_of_join(left, right, ["scope"], "at", "ts", ["version"], hot_rows=hot_rows).select("request", "found.s", "found.version").collect()
    none_first = lambda v: (v is not None, v or 0)
    expected = {}
    for request, key, s in asked:
        past = [(t, none_first(v), v) for name, t, v in history if name == key and t is not None and s is not None and t <= s]
        expected[request] = (max(past)[0], max(past)[2]) if past else (None, None)
    assert {r.request: (r.s, r.version) for r in found} == expected and len(found) == len(asked)


def test_as_of_join_sorts_once(spark):
    side = spark.range(10).selectExpr("id AS k", "timestamp_seconds(id) AS t")
    plan = as_of_join(side, side, ["k"], "t", "t", ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def _final_plan(frame):
    """The plan that ran, with its shuffles."""
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def _some_items(spark):
    rows = [(k % 7 if k % 50 else None, f"i{k}", dt.datetime(2024, 1, 1 + k % 5), f"{k:064x}", k % 3 > 0, k, f"x{k}") for k in range(300)]
    return spark.createDataFrame(rows, "job_id long, item_id string, collected_date timestamp, sha256 string, is_successful boolean, size_bytes long, note string")


def test_digests_of_numbered_rows_need_no_further_shuffle(spark):
    digests = custody.items_hash(custody.collection_sequence(_some_items(spark)))
    plan = _final_plan(digests)
    assert digests.count() == 8
    # One for the rows, and those that look for hot groups.
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and "__group" not in line]
    assert len(moved) == 1 and "__chunk" not in moved[0] and "md5" not in plan.split(moved[0])[1]


def test_held_rows_share_a_shuffle(spark, tmp_path):
    _some_items(spark).write.parquet(str(tmp_path / "items"))
    items = spark.read.parquet(str(tmp_path / "items"))
    jobs = spark.createDataFrame([(k, 1, "c", "Email", "r", None, None) for k in range(9)], "job_id long, matter_id long, custodian string, job_type string, route string, start_time timestamp, end_time timestamp")
    numbered = held(custody.collection_sequence(items), items.columns)
    built = custody.job_manifests(jobs, items, F.lit(dt.datetime(2024, 2, 1)), sequenced=numbered)
    both = built.select("job_id", F.col("items_hash").alias("x")).unionByName(numbered.select("job_id", F.concat("note", F.col("sequence").cast("string")).alias("x")))
    plan = _final_plan(both)
    assert both.count() == 309
    wide = [line for line in plan.splitlines() if "Exchange hashpartitioning(job_id" in line]
    assert any("ReusedExchange" in line and "note" in line for line in plan.splitlines()) and len(wide) == 2
    plain = custody.job_manifests(jobs, items, F.lit(dt.datetime(2024, 2, 1)))
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, built.collect()), key=str)


def test_rows_of_a_large_job_span_places(spark):
    rows = spark.createDataFrame([(job, n) for job, size in ((1, 500), (2, 40), (3, 0), (4, 41)) for n in range(size + 1)], "job_id long, ord long")
    placed = files._placed(rows, "ord", job_rows=40).withColumn("at", F.spark_partition_id()).collect()
    assert sorted((r.job_id, r.ord) for r in placed) == sorted((r.job_id, r.ord) for r in rows.collect())
    spots = {}
    for r in placed:
        spots.setdefault((r.job_id, r["at"]), []).append(r.ord)
    assert all(v == sorted(v) for v in spots.values())
    assert len([k for k in spots if k[0] == 1]) > 1 and len([k for k in spots if k[0] in (2, 3)]) == 2
