"""Streams whose inputs wait for each other: manifests for their counterpart, datasets for their marker."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from casetrail.sources import landing
from casetrail.sources.storage import list_tree
from casetrail.streaming import landing as ingest_stream
from casetrail.streaming import reconcile
from casetrail.streaming.waiting import Ledger, WaitingRoom

HEADER = "Custodian,ItemId,Path,Size\n"


def manifest(path, *items, at=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(HEADER + "".join(f"u,{i},/p/{i},1\n" for i in items))
    if at is not None:
        os.utime(path, (at, at))


class Arrivals:
    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder
        for name in ("source", "collected"):
            (folder / name).mkdir()

    def source(self, job, *items, **kw):
        manifest(self.folder / "source" / f"u_{job}_source.csv", *items, **kw)

    def collected(self, job, *items, **kw):
        manifest(self.folder / "collected" / f"u_{job}_collected.csv", *items, **kw)

    def run(self, **kw):
        paths = [str(self.folder / n) for n in ("collected", "source", "out", "checkpoint")]
        reconcile.run_reconciliation(self.spark, *paths, **kw).awaitTermination()

    def read(self, name, *columns):
        if not (self.folder / "out" / name).exists():
            return []
        return sorted(tuple(r) for r in self.spark.read.parquet(str(self.folder / "out" / name)).select(*columns).collect())

    def counts(self):
        return self.read("summary", "scope_job_id", "missed_count", "extra_count")

    def rejects(self):
        return self.read("rejects", "scope_job_id", "reason", "detail")


def test_either_side_may_come_first(spark, tmp_path):
    case = Arrivals(spark, tmp_path)
    case.collected("a1", "x", "y")
    case.source("b2", "x", "y")
    case.run()
    assert case.counts() == [] and case.rejects() == []
    case.collected("c3", "x")
    case.source("c3", "x")
    case.run()
    assert case.counts() == [("c3", 0, 0)]
    case.source("a1", "x", "z")
    case.collected("b2", "x")
    case.run()
    assert case.counts() == [("a1", 1, 1), ("b2", 1, 0), ("c3", 0, 0)]
    # A reported job's later manifest changes nothing.
    manifest(tmp_path / "collected" / "v_c3_collected.csv", "q")
    manifest(tmp_path / "source" / "v_c3_source.csv", "q")
    case.run()
    assert len(case.counts()) == 3 and case.rejects() == []


def test_a_bad_manifest_is_set_aside_and_the_others_go_on(spark, tmp_path):
    case = Arrivals(spark, tmp_path)
    for job, items in (("j1", "xy"), ("J2", "xx"), ("j3", "x"), ("j4", "")):
        case.collected(job, *items)
        case.source(job, *("xx" if job == "j3" else items and "x"))
    case.run()
    assert case.counts() == [("j1", 0, 1)]
    assert case.rejects() == [
        ("j2", reconcile.REPEATED_KEY, "collected: x"),
        ("j3", reconcile.REPEATED_KEY, "source: x"),
        ("j4", reconcile.NO_ROWS, case.rejects()[2][2]),
    ]
    case.collected("j5", "x")
    case.source("j5", "x")
    case.run()
    assert [job for job, *_ in case.counts()] == ["j1", "j5"] and len(case.rejects()) == 3


def test_waiting_has_an_end(spark, tmp_path):
    case = Arrivals(spark, tmp_path)
    case.collected("old", "x", at=1_000_000)
    case.collected("new", "x", at=1_000_000 + 7200)
    case.run(max_wait=dt.timedelta(hours=1))
    assert [r[:2] for r in case.rejects()] == [("old", reconcile.NO_SOURCE)]
    case.source("old", "x", at=1_000_000 + 7300)
    case.source("new", "x", at=1_000_000 + 7300)
    case.run(max_wait=dt.timedelta(hours=1))
    assert case.counts() == [("new", 0, 0)]


def test_a_replayed_batch_gives_the_same(spark, tmp_path):
    case = Arrivals(spark, tmp_path)
    case.collected("a", "x")
    case.collected("b", "x", "y")
    case.source("b", "x")
    case.run()
    case.source("a", "z")
    case.run()
    before = case.counts(), case.rejects()
    # The stream forgets that its last batch was done and runs it again.
    last = max((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    for crc in last.parent.glob(f".{last.name}.crc"):
        crc.unlink()
    case.run()
    assert (case.counts(), case.rejects()) == before == ([("a", 1, 1), ("b", 0, 1)], [])


def test_state_is_read_below_the_batch(spark, tmp_path):
    room = WaitingRoom(spark, str(tmp_path / "room"), "path string")
    ledger = Ledger(spark, str(tmp_path / "ledger"), "path string")
    one = lambda x: spark.createDataFrame([(x,)], "path string")
    assert room.load().count() == 0 and ledger.load(5).count() == 0
    for n in range(4):
        room.save(one(f"r{n}"), n)
        ledger.save(one(f"l{n}"), n)
    assert [r.path for r in room.load(3).collect()] == ["r2"] and [r.path for r in room.load().collect()] == ["r3"]
    assert room.versions() == [2, 3]
    assert sorted(r.path for r in ledger.load(2).collect()) == ["l0", "l1"]


def record(k, **more):
    return {"id": f"i{k}", "driveId": "d", "path": f"/p{k}", "name": f"n{k}.txt", "size": 3, "file": {"mimeType": "text/plain"}} | more


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


class Zone:
    def __init__(self, spark, folder):
        self.spark, self.folder, self.root = spark, folder, folder / "zone"
        self.root.mkdir()
        self.content = spark.createDataFrame([("d", f"i{k}", "s", 3, "u") for k in range(50)], "drive string, id string, content_sha256 string, content_length long, storage_uri string")

    def run(self, **kw):
        names = [str(self.folder / n) for n in ("out", "checkpoint")]
        ingest_stream.run_ingest(self.spark, str(self.root), self.content, *names, **kw).awaitTermination()

    def ids(self):
        out = self.folder / "out" / "results"
        return sorted(r.id for r in self.spark.read.parquet(str(out)).select("id").collect()) if out.exists() else []

    def rejects(self):
        out = self.folder / "out" / "rejects"
        return self.spark.read.parquet(str(out)).count() if out.exists() else 0


def test_files_wait_for_their_marker(spark, tmp_path):
    zone = Zone(spark, tmp_path)
    put(zone.root / "run1" / "a" / "b" / "part-0.json", json.dumps(record(1)) + "\n")
    put(zone.root / "run2" / "part-0.json", json.dumps(record(2)) + "\n")
    put(zone.root / "run3" / "part-0.json", json.dumps(record(3)) + "\n")
    put(zone.root / "run3" / "my-dataset.json", json.dumps(record(4)) + "\n")
    put(tmp_path / "_SUCCESS", "")  # above the zone: releases nothing
    zone.run()
    assert zone.ids() == ["i4"]
    put(zone.root / "run1" / "_SUCCESS", "")  # alone: no new file starts a batch
    zone.run()
    assert zone.ids() == ["i1", "i4"]
    zone.run()
    put(zone.root / "run4" / "done.complete", "")  # before its data
    zone.run()
    put(zone.root / "run4" / "x" / "part-1.json", json.dumps(record(5)) + "\n")
    put(zone.root / "run2" / "late.complete", "")
    zone.run()
    assert zone.ids() == ["i1", "i2", "i4", "i5"]


@pytest.mark.parametrize("indent", [None, 2])
def test_both_json_forms_in_the_stream(spark, tmp_path, indent):
    zone = Zone(spark, tmp_path)
    put(zone.root / "r" / "array.json", "﻿\n" + json.dumps([record(k) for k in range(3)], indent=indent))
    put(zone.root / "r" / "lines.json", "".join(json.dumps(record(k)) + "\n" for k in range(3, 6)) + "\nnot json\n")
    put(zone.root / "r" / "_SUCCESS", "")
    zone.run(max_files=1)
    assert zone.ids() == [f"i{k}" for k in range(6)]
    assert zone.rejects() == 1


def test_an_unfinished_look_is_taken_again(spark, tmp_path, monkeypatch):
    zone = Zone(spark, tmp_path)
    put(zone.root / "r" / "part-0.json", json.dumps(record(1)) + "\n")
    zone.run()
    put(zone.root / "r" / "_SUCCESS", "")
    put(zone.root / "r" / "part-1.json", json.dumps(record(2)) + "\n")
    with monkeypatch.context() as m:
        m.setattr(ingest_stream.MarkerGate, "finish", lambda *a: 1 / 0)
        with pytest.raises(Exception):
            zone.run()
    zone.run()
    assert zone.ids() == ["i1", "i2"]


def test_a_batch_done_but_not_recorded_is_not_done_twice(spark, tmp_path):
    zone = Zone(spark, tmp_path)
    put(zone.root / "r" / "_SUCCESS", "")
    put(zone.root / "r" / "part-0.json", json.dumps(record(1)) + "\n")
    zone.run()
    for name in ("0", ".0.crc"):
        (tmp_path / "checkpoint" / "commits" / name).unlink(missing_ok=True)
    zone.run()
    assert zone.ids() == ["i1"]


def test_listing_has_hidden_and_empty_files(spark, tmp_path):
    for name in ("_SUCCESS", ".hidden", "a/b/c/x y.json", "a/b/é+%.complete", "a/_tmp/_SUCCESS"):
        put(tmp_path / name, "")
    (tmp_path / "empty").mkdir()
    found = list_tree(spark, str(tmp_path))
    files = sorted(r.path.removeprefix(f"file:{tmp_path}/") for r in found.filter("NOT is_folder").collect())
    assert files == sorted(["_SUCCESS", ".hidden", "a/b/c/x y.json", "a/b/é+%.complete", "a/_tmp/_SUCCESS"])
    assert found.filter("is_folder").count() == 5 and found.filter(F.col("length") != 0).count() == 0
    assert landing.marker_files(spark, str(tmp_path)).count() == 3
    assert list_tree(spark, str(tmp_path / "nowhere")).count() == 0


def test_a_look_is_one_pass_over_its_files(spark, tmp_path):
    """However many files a look releases, the content is read as often as for one (for the results, and for the cut-off)."""
    zone = Zone(spark, tmp_path)
    reads = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    zone.content = zone.content.mapInArrow(passed, zone.content.schema)
    for k in range(12):
        put(zone.root / "r" / f"u{k % 3}" / f"part-{k}.json", json.dumps(record(k)) + "\n" + json.dumps(record(k + 12)) + "\n")
    put(zone.root / "r" / "_SUCCESS", "")
    zone.run(max_files=2, max_errors=5)
    assert zone.ids() == sorted(f"i{k}" for k in range(24))
    results = spark.read.parquet(str(tmp_path / "out" / "results"))
    assert results.filter("outcome = 'Success' AND record_index IN (0, 1) AND counted").count() == 24
    assert spark.read.parquet(str(tmp_path / "out" / "summary")).filter("successful = 2 AND success").count() == 12
    assert reads.value <= 2 * 50
