"""Streams against their batch operators, replays included."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from casetrail.operators import delta
from casetrail.plans import domain
from casetrail.plans.queries_streams import table_stream
from casetrail.sinks.cursors import CursorStore
from casetrail.sinks.files import write_manifest_csv
from casetrail.streaming import delta as feed
from casetrail.streaming import metrics, reconcile


def test_complete_mode_equals_batch(spark, small, tmp_path, rows):
    stream = table_stream(spark, small, "events").selectExpr("event_type AS metric", "value", "ts")
    out = str(tmp_path / "out")
    metrics.rolling_rates(stream, 15, "5 minutes").writeStream.outputMode("complete").foreachBatch(
        lambda df, i: df.write.mode("overwrite").parquet(out)
    ).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    batch = metrics.rolling_rates(
        domain.table(spark, small, "events").selectExpr("event_type AS metric", "value", "ts"), 15, "5 minutes"
    )
    columns = ["window_start", "metric", "points"]
    assert rows(spark.read.parquet(out), *columns) == rows(batch, *columns)


def test_rates_come_from_panes(spark):
    """Points are summed before windows copy anything; odd slides, late points of a pane and null values included."""
    t = lambda minute, second=0: dt.datetime(2024, 1, 1, 12, minute, second)
    data = [("m", 1.0, t(0)), ("m", 2.0, t(0, 59)), ("m", None, t(7)), ("n", 4.0, t(14, 59)), ("m", 8.0, t(20))]
    points = spark.createDataFrame(data, "metric string, value double, ts timestamp")
    for minutes, slide in ((15, "1 minute"), (15, "10 minutes"), (2, "90 seconds"), (60, "1 hour")):
        direct = points.groupBy(F.window("ts", f"{minutes} minutes", slide).alias("w"), "metric").agg(
            F.sum("value").alias("total"), F.count(F.lit(1)).alias("points"), F.avg("value").alias("average")
        )
        got = metrics.pane_rates(points, minutes, slide).select("window_start", "window_end", "metric", "total", "points", "average")
        want = direct.select("w.start", "w.end", "metric", "total", "points", "average")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    plan = metrics.pane_rates(points)._jdf.queryExecution().optimizedPlan().toString()
    expands = plan.index("Expand")
    assert plan.count("Aggregate [") == 2 and plan.index("Aggregate [") < expands < plan.rindex("Aggregate [")


def test_streamed_windows_come_from_the_stream(spark, tmp_path):
    """Closed windows are written by the stream itself: all that end a day before the newest point."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    base = dt.datetime(2024, 1, 1)
    data = [("m", float(h), base + dt.timedelta(hours=h)) for h in range(72)]
    spark.createDataFrame(data, "metric string, value double, ts timestamp").write.parquet(source)
    stream = spark.readStream.schema("metric string, value double, ts timestamp").parquet(source)
    metrics.pane_rates(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(
        availableNow=True
    ).start().awaitTermination()
    # The watermark is hour 71 less 24: points of hours 0 to 46 are in closed windows only, fifteen each; of hour 47's, none is closed but
    # the window that ends with its first minute would be.
    assert spark.read.parquet(out).filter(F.col("total") < 47).count() == 47 * 15


def test_change_feed_in_several_batches(spark, small, tmp_path, rows):
    """Three files, one per batch; then a replayed batch changes nothing."""
    changes = domain.changes(spark, small)
    source = tmp_path / "feed"
    bounds = ["2024-01-01", "2024-01-10", "2024-01-20", "2024-02-01"]
    for low, high in zip(bounds, bounds[1:]):
        part = changes.filter((F.col("ts") >= low) & (F.col("ts") < high)).coalesce(1)
        part.write.mode("append").parquet(str(source))
    # One change delivered twice.
    changes.filter("version = 5").coalesce(1).write.mode("append").parquet(str(source))
    log = feed.ChangeLog(spark, str(tmp_path / "log"), domain.CHANGE_SCHEMA)
    store = CursorStore(spark, str(tmp_path / "cursors"))
    start = changes.select("scope_id").distinct()
    seed = domain.cursors(spark, small).limit(0)
    named = start.select(
        "scope_id", F.lit("OneDrive").alias("delta_type"), F.lit("u").alias("custodian"), F.lit("").alias("delta_token"),
        F.lit(True).alias("is_active"), F.lit(0).cast("long").alias("delta_query_count"),
    )
    store.save(seed.unionByName(named, allowMissingColumns=True))
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    feed.run_change_feed(stream, log, store, str(tmp_path / "cp")).awaitTermination()
    taken = changes.filter(delta.is_live() | delta.is_deleted())
    expected = rows(delta.apply_changes(changes.limit(0), taken), "item_id", "version", "size_bytes")
    assert rows(log.snapshot(), "item_id", "version", "size_bytes") == expected
    current = store.load()
    newest = changes.groupBy("scope_id").agg(F.max("version").alias("v"))
    # The repeated old change came last and must not set a token back.
    assert current.join(newest, "scope_id").filter(F.col("delta_token").cast("long") == F.col("v")).count() == newest.count()
    assert current.agg(F.max("delta_query_count")).first()[0] >= 3
    # A replay of the first batch writes the state of that batch again, and only that.
    before = rows(store.load(before=3))
    written = log.table.rows([1])
    first = spark.createDataFrame(written.collect(), written.schema)
    log.append(first, 0)
    results = delta.query_results(first)
    touched = store.load(before=2).join(results.select("scope_id"), "scope_id", "left_semi")
    store.append(delta.advance_cursors(touched, results, F.lit(first.agg(F.max("ts")).first()[0])), version=2)
    assert rows(store.load(before=3)) == before
    assert rows(log.snapshot(), "item_id", "version", "size_bytes") == expected
    log.compact(3)
    assert rows(log.snapshot(), "item_id", "version", "size_bytes") == expected


def test_late_points_are_set_aside(spark, tmp_path):
    def batch(*stamps):
        return spark.createDataFrame(
            [("m", 1.0, dt.datetime.fromisoformat(s)) for s in stamps], "metric string, value double, ts timestamp_ntz"
        ).withColumn("ts", F.col("ts").cast("timestamp"))

    kept, late, horizon = (str(tmp_path / n) for n in ("kept", "late", "horizon"))
    write = metrics.retention_sink(kept, late, horizon)
    write(batch("2024-01-01", "2024-01-05"), 0)
    write(batch("2024-01-02", "2024-01-04T12:00:00"), 1)
    write(batch("2024-01-02", "2024-01-04T12:00:00"), 1)
    assert spark.read.parquet(kept).count() == 3
    assert [r.ts.day for r in spark.read.schema("ts timestamp").parquet(f"{late}/batch_id=1").collect()] == [2]


@pytest.mark.parametrize("extra", [0, 1])
def test_reconcile_on_arrival(spark, small, tmp_path, extra):
    source_root, collected_root = tmp_path / "source", tmp_path / "collected"
    source_root.mkdir()
    collected_root.mkdir()
    source = domain.source_manifest(spark, small)
    collected = domain.collected_manifest(spark, small)

    def put(frame, custodian, target):
        folder = tmp_path / f"w-{target.name}"
        write_manifest_csv(frame.filter(F.col("custodian") == custodian).coalesce(1), str(folder))
        (part,) = folder.glob("*.csv")
        target.write_bytes(part.read_bytes())

    for n in range(2 + extra):
        put(source, f"u{n}@x.org", source_root / f"u{n}@x.org_{n}_source.csv")
        put(collected, f"u{n}@x.org", collected_root / f"u{n}@x.org_{n}_collected.csv")
    (collected_root / "nobody_9_collected.csv").write_text("Custodian,Path\nnobody,p\n")
    out = str(tmp_path / "out")
    reconcile.run_reconciliation(
        spark, str(collected_root), str(source_root), out, str(tmp_path / "cp"), max_files=2
    ).awaitTermination()
    got = {r.scope_job_id: r for r in spark.read.parquet(f"{out}/summary").collect()}
    assert set(got) == {str(n) for n in range(2 + extra)}
    assert all(r.source_count > 0 for r in got.values())
    assert sum(r.missed_count + r.extra_count for r in got.values()) > 0
    report = spark.read.option("header", True).csv(f"{out}/reports")
    assert report.filter("Section = 'Summary'").count() == 2 + extra


def test_log_lines_stream_like_a_batch(spark, small, tmp_path, rows):
    from casetrail.plans.queries_files import _log_folder
    from casetrail.sources import logs

    folder = _log_folder(spark, small)
    lines = spark.readStream.text(folder).select("value", F.col("_metadata.file_path").alias("source_file"))
    parsed, _ = logs.parse_log(lines)
    out = str(tmp_path / "parsed")
    (
        parsed.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    batch, _ = logs.read_log(spark, folder)
    columns = ["ts", "category", "name", "correlation_id", "message"]
    assert rows(spark.read.parquet(out), *columns) == rows(batch, *columns)
