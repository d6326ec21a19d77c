"""Shards, checkpoints, routes, metrics and cursors on worked cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from casetrail import schemas
from casetrail.operators import delta, matters, metrics, routing, shards
from casetrail.operators.delta import DeltaOptions
from casetrail.operators.shards import ShardOptions

GIB = 1024**3


def day(text):
    return dt.datetime.fromisoformat(text)


def with_times(frame, *columns):
    for c in columns:
        frame = frame.withColumn(c, F.col(c).cast("timestamp"))
    return frame


def request(spark, start, end, custodians=("u@x",)):
    frame = spark.createDataFrame(
        [(1, list(custodians), "Email", day(start), day(end))],
        "job_id long, custodians array<string>, job_type string, start_date timestamp_ntz, end_date timestamp_ntz",
    )
    return with_times(frame, "start_date", "end_date")


def windows(spark, start, end, **options):
    frame = shards.shard_windows(request(spark, start, end), ShardOptions(**options)).orderBy("start_date")
    short = lambda t: f"{t:%m-%d}"
    return [(r.kind, short(r.start_date), short(r.end_date), r.total_shards) for r in frame.collect()]


def test_windows_clip_at_the_end(spark):
    assert windows(spark, "2024-01-01", "2024-03-05") == [
        ("shard", "01-01", "01-31", 3), ("shard", "01-31", "03-01", 3), ("shard", "03-01", "03-05", 3),
    ]


def test_cap_leaves_a_gap(spark):
    assert windows(spark, "2024-01-01", "2024-03-05", max_shards_per_custodian=2) == [
        ("shard", "01-01", "01-31", 2), ("shard", "01-31", "03-01", 2), ("gap", "03-01", "03-05", 2),
    ]


def test_short_tail_is_a_gap(spark):
    assert windows(spark, "2024-01-01", "2024-01-31T12:00:00") == [
        ("shard", "01-01", "01-31", 1), ("gap", "01-31", "01-31", 1),
    ]


def test_degenerate_ranges(spark):
    assert windows(spark, "2024-01-02", "2024-01-01") == []
    assert windows(spark, "2024-01-01", "2024-01-01T05:00:00") == [("gap", "01-01", "01-01", 0)]
    assert windows(spark, "2024-01-01", "2024-01-11", window_days=2, minimum_days=3) == [("gap", "01-01", "01-11", 0)]
    assert windows(spark, "2024-01-01", "2024-01-31") == [("shard", "01-01", "01-31", 1)]


def test_boundary_item(spark):
    plan = shards.shard_windows(request(spark, "2024-01-01", "2024-03-05"))
    items = with_times(
        spark.createDataFrame(
            [("edge", "u@x", day("2024-01-31")), ("last", "u@x", day("2024-03-05")), ("out", "u@x", day("2024-03-06"))],
            "id string, custodian string, item_date timestamp_ntz",
        ),
        "item_date",
    )
    got = shards.assign_items(items, plan).collect()
    assert sorted((r.id, r.shard_index) for r in got if r.id != "out") == [("edge", 1), ("last", 2)]
    assert [r.shard_index for r in got if r.id == "out"] == [None]
    both = shards.assign_items(items, plan, boundary="inclusive").collect()
    assert sorted(r.shard_index for r in both if r.id == "edge") == [0, 1]


def test_every_covered_item_is_in_exactly_one_shard(spark, small):
    from casetrail.plans import domain

    plan = shards.shard_windows(domain.shard_requests(spark, small), ShardOptions(max_shards_per_custodian=1000))
    items = domain.dated_items(spark, small)
    assigned = shards.assign_items(items, plan)
    assert assigned.count() == items.count()
    assert assigned.filter("shard_index IS NULL").count() == 0


@pytest.mark.parametrize(
    ("custodians", "end", "expected"),
    [
        (2, "2024-04-10", (True, 7, 3, 30.0)),
        (6, "2024-01-11", (True, 2, 0, 10.0)),
        (1, "2024-01-11", (False, 1, 1, 10.0)),
    ],
)
def test_sharding_advice(spark, custodians, end, expected):
    frame = request(spark, "2024-01-01", end, [f"u{i}" for i in range(custodians)])
    r = shards.sharding_recommendation(frame).first()
    assert expected == (r.should_shard, r.recommended_shards, r.recommended_shards_per_custodian, r.recommended_window_days)


def test_sharding_advice_without_custodians(spark):
    r = shards.sharding_recommendation(request(spark, "2024-01-01", "2024-02-01", [])).first()
    assert r.reason == "Request has no custodians" and r.recommended_window_days is None


def checkpoint_rows(spark, data):
    frame = spark.createDataFrame(
        [(i, s, t, day(c), done) for i, s, t, c, done in data],
        "checkpoint_id long, shard_id long, checkpoint_type string, created_date timestamp_ntz, is_completed boolean",
    )
    return with_times(frame, "created_date")


def test_checkpoint_sequence(spark, rows):
    frame = checkpoint_rows(
        spark,
        [
            (1, 1, "a", "2024-01-01", True),
            (2, 1, "a", "2024-01-02", False),
            (3, 1, "a", "2024-01-03", True),
            (4, 2, "a", "2024-01-01", True),
            (5, 2, "a", "2024-01-02", False),
            (6, 2, "b", "2024-01-03", True),
        ],
    )
    (error,) = shards.sequence_errors(frame).collect()
    assert error.error == "Checkpoint sequence error in a: incomplete checkpoint 2 followed by completed 3"
    valid = rows(shards.checkpoint_validation(frame), "shard_id", "is_valid", "error_count")
    assert valid == [(1, False, 1), (2, True, 0)]
    assert rows(shards.resume_set(frame), "checkpoint_id") == [(5,)]
    assert rows(shards.last_checkpoints(frame), "checkpoint_id") == [(3,), (4,), (6,)]


@pytest.mark.parametrize(
    ("used", "items", "job_type", "limit", "expected"),
    [
        (50, 250_000, "Email", 100, ("GraphApi", 0.9, "fits")),
        (90, 250_000, "SharePoint", 100, ("GraphDataConnect", 0.8, "would exceed")),
        (50, 250_000, "Email", 10, ("GraphDataConnect", 0.9, "quota usage exceeds")),
        (95, 250_000, "Email", 100, ("GraphDataConnect", 0.8, "would exceed")),
        (50, 490_000, "Email", 100, ("GraphDataConnect", 0.8, "would exceed")),
    ],
)
def test_routes(spark, used, items, job_type, limit, expected):
    frame = routing.with_estimates(spark.createDataFrame([(job_type,)], "job_type string"))
    options = routing.RouteOptions(max_bytes=limit * GIB)
    r = routing.decide_route(frame, F.lit(used * GIB), F.lit(items), options).first()
    assert (r.route, r.confidence) == expected[:2] and expected[2] in r.reason


def points(spark, data):
    frame = spark.createDataFrame(
        [(m, float(v), day(t)) for m, v, t in data], "metric string, value double, ts timestamp_ntz"
    )
    return with_times(frame, "ts")


NOW = "2024-01-02 00:00:00"


def test_rates_and_peaks(spark, rows):
    now = F.lit(NOW).cast("timestamp")
    frame = points(
        spark,
        [
            ("items_collected", 1, "2024-01-01 23:50:00"),
            ("items_collected", 1, "2024-01-01 23:50:30"),
            ("items_collected", 1, "2024-01-01 23:59:59"),
            ("items_collected", 9, "2024-01-01 10:00:00"),
            ("items_collected", 100, "2023-12-31 23:59:00"),
        ],
    )
    assert rows(metrics.rates(frame, now)) == [("items_collected", pytest.approx(0.2))]
    assert rows(metrics.peak_minute(frame, now)) == [("items_collected", 9.0)]
    kept, expired = metrics.split_retention(frame, now)
    assert (kept.count(), expired.count()) == (4, 1)
    row = metrics.throughput_metrics(frame, now).first()
    assert row.items_per_minute_1h == pytest.approx(0.05) and row.mb_per_minute_15m == 0


def test_status_levels(spark):
    now = F.lit(NOW).cast("timestamp")
    stamp = "2024-01-01 23:59:00"
    healthy = points(spark, [("jobs_started_total", 1, stamp)] * 101 + [("jobs_completed_total", 1, stamp)])
    assert metrics.system_status(healthy, now).first().system_status == "Healthy"
    busy = points(spark, [("jobs_started_total", 1, stamp)] * 101)
    assert metrics.system_status(busy, now).first().system_status == "High Load"
    failing = points(spark, [("server_errors", 151, stamp)])
    assert metrics.system_status(failing, now).first().system_status == "Degraded"
    assert metrics.error_metrics(busy, now).first().retry_success_rate == 1.0
    mixed = points(spark, [("retry_success", 1, stamp)] * 3 + [("retry_failure", 1, stamp)])
    assert metrics.error_metrics(mixed, now).first().retry_success_rate == 0.75


def cursor(spark, *cursors):
    names = schemas.DELTA_CURSOR.fieldNames()
    data = []
    for c in cursors:
        base = {
            "delta_token": "t", "is_active": True, "failure_count": 0, "delta_query_count": 4,
            "last_delta_item_count": 0, "last_delta_size_bytes": 0, "delta_type": "Mail", "custodian": "u",
        }
        data.append(tuple({**base, **c}.get(n) for n in names))
    return spark.createDataFrame(data, schemas.DELTA_CURSOR)


def utc(text):
    return dt.datetime.fromisoformat(text).replace(tzinfo=dt.timezone.utc)


@pytest.mark.parametrize(
    ("fields", "options", "kind", "reason"),
    [
        ({"last_delta_time": utc("2024-01-01")}, {}, "Mail", "Cursor too stale, full resync needed"),
        ({"last_delta_time": utc("2024-01-02")}, {}, "Mail", "Recent baseline available"),
        ({"last_delta_time": utc("2024-01-31"), "failure_count": 4}, {}, "Mail", "Reset to full collection mode"),
        ({"last_delta_time": utc("2024-01-31"), "is_active": False}, {}, "Mail", "No baseline cursor exists"),
        ({"last_delta_time": utc("2024-01-31")}, {"use_delta": False}, "Mail", "Delta disabled globally"),
        ({"last_delta_time": utc("2024-01-31")}, {"enable_mail": False}, "Mail", "Delta disabled for mail"),
        ({}, {"enable_drive": False}, "OneDrive", "Delta disabled for OneDrive"),
        ({}, {}, "Teams", "Delta not supported for type"),
    ],
)
def test_delta_or_full(spark, fields, options, kind, reason):
    requests = spark.createDataFrame([("U", kind)], "custodian string, delta_type string")
    frame = cursor(spark, {"scope_id": "mail:u", "updated_date": utc("2024-01-01"), **fields})
    as_of = F.lit("2024-02-01").cast("timestamp")
    r = delta.delta_or_full(requests, frame, as_of, DeltaOptions(**options)).first()
    assert (r.reason, r.use_delta) == (reason, reason == "Recent baseline available")


def test_cursor_commands(spark):
    old = cursor(
        spark,
        {"scope_id": "mail:live", "custodian": "live"},
        {"scope_id": "mail:off", "custodian": "off", "is_active": False},
        {"scope_id": "mail:gone", "custodian": "gone"},
        {"scope_id": "mail:quiet", "custodian": "quiet"},
    )
    commands = spark.createDataFrame(
        [
            ("live", "Mail", "initialise", "2024-01-01", 1),
            ("off", "Mail", "initialise", "2024-01-01", 1),
            ("gone", "Mail", "reset", "2024-01-01", 1),
            ("new", "Mail", "initialise", "2024-01-01", 7),
            ("never", "Mail", "reset", "2024-01-01", 1),
            ("both", "Mail", "initialise", "2024-01-01", 1),
            ("both", "Mail", "reset", "2024-01-02", 1),
        ],
        "custodian string, delta_type string, action string, ts string, job_id long",
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.custodian: r for r in delta.apply_commands(old, commands).collect()}
    assert set(got) == {"live", "off", "gone", "quiet", "new", "both"}
    assert (got["live"].delta_token, got["live"].is_active) == ("t", True)
    assert (got["off"].delta_token, got["off"].is_active) == ("", True)
    assert (got["gone"].is_active, got["gone"].error_message) == (False, delta.RESET_NOTE)
    assert (got["new"].delta_token, got["new"].job_id, got["new"].is_active) == ("", 7, True)
    assert got["both"].is_active is False and got["quiet"].delta_query_count == 4


def test_children_keep_childless_parents(spark, rows):
    parents = spark.createDataFrame([(1, "a"), (2, "b")], "k int, p string")
    children = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z")], "k int, c string")
    assert rows(matters.with_children(parents, children, "k")) == [(1, "a", "x"), (1, "a", "y"), (2, "b", None)]
    assert rows(matters.child_counts(parents, children, "k", "n")) == [(1, "a", 2), (2, "b", 0)]
