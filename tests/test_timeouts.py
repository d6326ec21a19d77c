"""Job lifecycles with timers: out of order, late, joined, timed out, forgotten."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from casetrail.streaming import lifecycle, timeouts
from casetrail.streaming.timeouts import Session, Timeline

HOUR = 3_600_000_000


def at(hour, minute=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour, minutes=minute)


def event(moment, kind="ItemCollected"):
    done = moment if kind == "JobCompleted" else None
    return Session(None, done, moment, moment, int(kind == "ItemCollected"), 0, 0)


@pytest.mark.parametrize("seed", range(30))
def test_sessions_do_not_depend_on_the_order_of_arrival(seed):
    rng = random.Random(seed)
    timeout = 20
    moments = [rng.randrange(600) for _ in range(rng.randrange(1, 60))]
    line = Timeline([], timeout)
    told = {}
    rest = moments[:]
    rng.shuffle(rest)
    latest = 0
    while rest:
        part, rest = rest[:7], rest[7:]
        latest = max(latest, *part)
        line.add([event(m, "JobCompleted" if m % 50 == 0 else "ItemCollected") for m in part])
        line.tell(latest)
        for state, session in line.changes:
            if state == timeouts.MERGED:
                del told[session.first_event_at]
            else:
                told[session.first_event_at] = (state, session.last_event_at, session.items_collected)
        line.changes.clear()
    expected = {}
    ordered = sorted(moments)
    runs = [[ordered[0]]]
    for moment in ordered[1:]:
        runs[-1].append(moment) if moment - runs[-1][-1] < timeout else runs.append([moment])
    for run in runs:
        done = any(m % 50 == 0 for m in run)
        state = "Completed" if done else "TimedOut" if run[-1] + timeout <= latest else "Open"
        expected[run[0]] = (state, run[-1], sum(m % 50 != 0 for m in run))
    assert told == expected


@pytest.mark.parametrize("seed", range(10))
def test_many_jobs_at_once_follow_the_rules_of_one(seed):
    """Sessions held, told or not, with further runs: the table of all jobs against a time line of each."""
    rng = random.Random(seed)
    timeout, jobs, table, want = 20, range(12), [], set()
    for job in jobs:
        line = Timeline([], timeout)
        line.add([event(rng.randrange(900)) for _ in range(rng.randrange(8))])
        line.tell(rng.randrange(900))
        line.changes.clear()
        more = [event(rng.randrange(900), rng.choice(["ItemCollected", "JobCompleted"])) for _ in range(rng.randrange(8))]
        table += [(job, s) for s in line.sessions + more]
        line.add(more)
        want |= {(job, state, s.first_event_at) for state, s in line.changes}
        want |= {(job, s.told or "", s.first_event_at, s.last_event_at, s.items_collected, s.completed_at) for s in line.sessions}
    rng.shuffle(table)
    rows = [
        (job, timeouts._EVER, timeouts._NEVER if s.completed_at is None else s.completed_at, s.first_event_at, s.last_event_at,
         s.items_collected, s.bytes_collected, s.backoffs, timeouts._TOLD.index(s.told or ""))
        for job, s in table
    ]
    merged, gone = timeouts.merge_sessions(pd.DataFrame(rows, columns=["job_id", *timeouts._NAMES, "told"]), timeout)
    got = {(r.job_id, timeouts.MERGED, r.first_event_at) for r in gone.itertuples()}
    got |= {
        (r.job_id, timeouts._TOLD[r.told], r.first_event_at, r.last_event_at, r.items_collected, None if r.completed_at == timeouts._NEVER else r.completed_at)
        for r in merged.itertuples()
    }
    assert got == want


def test_jobs_share_state_and_timers(spark, tmp_path, rows):
    """State is kept by bucket: more jobs than buckets leave no more keys than there are buckets, and jobs of a bucket do not mix."""
    root, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    n = timeouts.BUCKETS * 4

    def run():
        stream = spark.readStream.schema(schema).parquet(root)
        query = timeouts.run_job_changes(timeouts.job_changes(stream, 60), out, checkpoint)
        query.awaitTermination()
        return max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"])

    schema = _write(spark, root, [(f"j{i}", "ItemCollected", at(1), i) for i in range(n)] + [("late", "JobStarted", at(9), 1)])
    # A value and a timer for each bucket, the timer also in an index by time.
    assert run() <= 3 * timeouts.BUCKETS
    _write(spark, root, [(f"j{i}", "JobCompleted", at(1, 30), None) for i in range(0, n, 2)])
    run()
    found = timeouts.current_sessions(spark.read.parquet(out)).groupBy("state").agg(F.count("*"), F.sum("bytes_collected"))
    evens = sum(range(0, n, 2))
    assert rows(found) == [("Completed", n // 2, evens), ("Open", 1, 0), ("TimedOut", n // 2, sum(range(n)) - evens)]


def test_only_unreachable_sessions_are_forgotten():
    line = Timeline([], 10)
    line.add([event(5), event(30)])
    line.forget(14)
    assert len(line.sessions) == 2
    line.forget(15)
    assert [s.first_event_at for s in line.sessions] == [30]


def _write(spark, root, rows):
    frame = spark.createDataFrame(rows, "job_id string, event_type string, ts timestamp, size_bytes long")
    frame.coalesce(1).write.mode("append").parquet(root)
    return frame.schema


def test_time_outs_are_told_and_taken_back(spark, tmp_path, rows):
    """Job a: two time-outs and a late completion that opens the first again. b: a late event joins two. c: open to the end."""
    root, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(root)
        timeouts.run_job_changes(timeouts.job_changes(stream, 60), out, checkpoint).awaitTermination()

    schema = _write(
        spark, root,
        [("a", "JobStarted", at(1), None), ("a", "ItemCollected", at(1, 30), 5), ("a", "ItemCollected", at(4), None), (None, "JobStarted", at(1), 1),
         ("b", "JobStarted", at(5), 1), ("b", "ItemCollected", at(6, 40), 7), ("c", None, at(9), 1), ("c", "JobStarted", None, 1)],
    )
    run()
    names = ("job_id", "state", "first_event_at", "last_event_at", "items_collected", "bytes_collected")
    first = rows(timeouts.current_sessions(spark.read.parquet(out)), *names)
    assert first == [
        ("a", "TimedOut", at(1), at(1, 30), 1, 5), ("a", "TimedOut", at(4), at(4), 1, 0), ("b", "TimedOut", at(5), at(5), 0, 0),
        ("b", "TimedOut", at(6, 40), at(6, 40), 1, 7), ("c", "Open", at(9), at(9), 0, 0),
    ]
    # A second run goes on from the state that the first one left.
    _write(spark, root, [("a", "JobCompleted", at(2), None), ("b", "ItemCollected", at(5, 50), 2), ("c", "BackoffTriggered", at(9, 10), None)])
    run()
    log = spark.read.parquet(out)
    assert rows(timeouts.current_sessions(log), *names) == [
        ("a", "Completed", at(1), at(2), 1, 5), ("a", "TimedOut", at(4), at(4), 1, 0),
        ("b", "TimedOut", at(5), at(6, 40), 2, 9), ("c", "Open", at(9), at(9, 10), 0, 0),
    ]
    assert rows(log.where("state = 'Merged'"), "job_id", "first_event_at") == [("b", at(6, 40))]
    # Days later: what was open has timed out, what is older than the watermark is not taken, state is gone.
    _write(spark, root, [("d", "JobStarted", at(200), None)])
    run()
    _write(spark, root, [("a", "ItemCollected", at(2, 10), 1), ("d", "JobCompleted", at(200, 5), None)])
    run()
    final = rows(timeouts.current_sessions(spark.read.parquet(out)), *names)
    assert [r[:2] for r in final] == [("a", "Completed"), ("a", "TimedOut"), ("b", "TimedOut"), ("c", "TimedOut"), ("d", "Completed")]


def test_facts_equal_the_batch_operator(spark, tmp_path, rows):
    data = [(f"j{i % 4}", ["JobStarted", "ItemCollected", "BackoffTriggered", "JobCompleted"][i * 7 % 5 % 4], at(0, i * 37 % 1400), i) for i in range(300)]
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = _write(spark, root, data)
    stream = spark.readStream.schema(schema).parquet(root)
    timeouts.run_job_changes(timeouts.job_changes(stream, 10), out, str(tmp_path / "cp")).awaitTermination()
    batch = lifecycle.job_sessions(spark.read.parquet(root), 10)
    names = ["job_id", "started_at", "completed_at", "last_event_at", "items_collected", "bytes_collected", "backoffs"]
    got = timeouts.current_sessions(spark.read.parquet(out)).withColumn("session_start", F.col("first_event_at"))
    assert rows(got, "session_start", *names) == rows(batch, "session_start", *names)


def test_timeouts_below_a_minute_are_refused(spark):
    with pytest.raises(ValueError, match="a minute"):
        timeouts.job_changes(spark.range(1), 0)
