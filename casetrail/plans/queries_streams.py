"""Streaming queries over the provided tables.

The table is read as a stream with an ``availableNow`` trigger and the output is read
back. In append mode the watermark closes windows; those still open come from a batch over the tail.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casetrail.operators import delta
from casetrail.operators.ordering import latest_by
from casetrail.plans import domain
from casetrail.plans.catalog import query, stamp
from casetrail.plans.queries_metrics import COUNTERS_SQL
from casetrail.sinks import files
from casetrail.sinks.cursors import CursorStore
from casetrail.streaming import delta as delta_stream
from casetrail.streaming import landing as landing_stream
from casetrail.streaming import lifecycle, metrics, timeouts
from casetrail.streaming import reconcile as reconcile_stream
from casetrail.workspace import list_names, new_folder, remove_folder, rename_file


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = domain.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


class _Streamed:
    """Lets the domain views be applied to a stream in place of a table."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.read = self
        self._spark, self._sf_dir = spark, sf_dir

    def parquet(self, path: str) -> DataFrame:
        return table_stream(self._spark, self._sf_dir, path.rsplit("/", 1)[-1].removesuffix(".parquet"))


def run_append(spark: SparkSession, frame: DataFrame, batch: Callable[[str], DataFrame], end: Column, label: str) -> DataFrame:
    """Run to the end of the input with a transactional file sink; the result, open windows included.

    ``batch`` gives the operator's rows for the windows that are open at a watermark.
    """
    target = new_folder(spark, label)
    started = (
        frame.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", new_folder(spark, f"{label}-checkpoint"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
    marks = [p["eventTime"]["watermark"] for p in started.recentProgress if "watermark" in p["eventTime"]]
    closed = spark.read.schema(frame.schema).parquet(target)
    mark = max(marks, default=None)
    return closed if mark is None else metrics.with_open_windows(closed, batch(mark), end, mark)


def _points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The metric points as a stream and as a table."""
    return domain.metric_points(_Streamed(spark, sf_dir), sf_dir), domain.metric_points(spark, sf_dir)


@query(
    "stream_rolling_rates",
    """SELECT strftime(w, '%Y-%m-%d %H:%M:%S.%f') AS window_start, metric, sum(value) AS total, count(*) AS points,
          round(sum(value) / 15, 6) AS rate_per_minute
        FROM (SELECT metric, value, time_bucket(INTERVAL 5 MINUTE, ts) - to_minutes(CAST(5 * k AS BIGINT)) AS w
          FROM metric_points CROSS JOIN range(3) AS r(k)) GROUP BY w, metric""",
)
def stream_rolling_rates(spark, sf_dir):
    stream, table = _points(spark, sf_dir)
    rates = lambda points: metrics.rolling_rates(points, 15, "5 minutes")
    rows = run_append(spark, rates(stream), lambda mark: rates(metrics.open_tail(table, mark, 15)), F.col("window_end"), "rates")
    return rows.select(
        stamp("window_start").alias("window_start"), "metric", "total", "points",
        F.round("rate_per_minute", 6).alias("rate_per_minute"),
    )


@query(
    "stream_pane_rates",
    """SELECT strftime(w, '%Y-%m-%d %H:%M:%S.%f') AS window_start, metric, sum(value) AS total, count(*) AS points, round(avg(value), 6) AS average
        FROM (SELECT metric, value, date_trunc('minute', ts) - to_minutes(k) AS w FROM metric_points CROSS JOIN range(15) AS r(k)) GROUP BY w, metric""",
)
def stream_pane_rates(spark, sf_dir):
    """The default slide: each point is in fifteen windows."""
    stream, table = _points(spark, sf_dir)
    rows = run_append(
        spark, metrics.pane_rates(stream), lambda mark: metrics.pane_rates(metrics.open_tail(table, mark, 15)), F.col("window_end"), "pane-rates"
    )
    return rows.select(stamp("window_start").alias("window_start"), "metric", "total", "points", F.round("average", 6).alias("average"))


@query(
    "stream_minute_sums",
    """SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S.%f') AS minute, metric, sum(value) AS total FROM metric_points GROUP BY 1, 2""",
)
def stream_minute_sums(spark, sf_dir):
    stream, table = _points(spark, sf_dir)
    end = F.col("minute") + F.expr("INTERVAL 1 MINUTE")
    rows = run_append(spark, metrics.minute_sums(stream), lambda mark: metrics.minute_sums(metrics.open_tail(table, mark, 1)), end, "minutes")
    return rows.select(stamp("minute").alias("minute"), "metric", "total")


@query(
    "stream_hourly_peaks",
    """SELECT strftime(date_trunc('hour', m), '%Y-%m-%d %H:%M:%S.%f') AS hour, metric, max(total) AS peak_minute
        FROM (SELECT date_trunc('minute', ts) AS m, metric, sum(value) AS total FROM metric_points GROUP BY 1, 2) GROUP BY 1, 2""",
)
def stream_hourly_peaks(spark, sf_dir):
    stream, table = _points(spark, sf_dir)
    end = F.col("hour") + F.expr("INTERVAL 1 HOUR")
    rows = run_append(spark, metrics.hourly_peaks(stream), lambda mark: metrics.hourly_peaks(metrics.open_tail(table, mark, 60)), end, "peaks")
    return rows.select(stamp("hour").alias("hour"), "metric", "peak_minute")


_SESSIONS_SQL = """
  SELECT job_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end,
    count(*) FILTER (WHERE event_type = 'ItemCollected') AS items_collected,
    CAST(coalesce(sum(size_bytes) FILTER (WHERE event_type = 'ItemCollected'), 0) AS BIGINT) AS bytes_collected,
    count(*) FILTER (WHERE event_type = 'BackoffTriggered') AS backoffs,
    CASE WHEN count(*) FILTER (WHERE event_type = 'JobCompleted') > 0 THEN 'Completed' ELSE 'TimedOut' END AS state
  FROM (SELECT *, sum(CASE WHEN ts - prev < INTERVAL 6 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY job_id ORDER BY ts) AS s
    FROM (SELECT *, lag(ts) OVER (PARTITION BY job_id ORDER BY ts) AS prev FROM lifecycle)) GROUP BY job_id, s"""
_SESSION_COLUMNS = """job_id, strftime(session_start, '%Y-%m-%d %H:%M:%S.%f') AS session_start,
  strftime(session_end, '%Y-%m-%d %H:%M:%S.%f') AS session_end, items_collected, bytes_collected, backoffs, state"""


def _shown_sessions(rows: DataFrame) -> DataFrame:
    return rows.select(
        "job_id", stamp("session_start").alias("session_start"), stamp("session_end").alias("session_end"),
        "items_collected", "bytes_collected", "backoffs", "state",
    )


@query("job_sessions", f"SELECT {_SESSION_COLUMNS} FROM ({_SESSIONS_SQL})")
def job_sessions(spark, sf_dir):
    return _shown_sessions(lifecycle.job_sessions(domain.lifecycle_events(spark, sf_dir), 360))


@query("stream_job_sessions", f"SELECT {_SESSION_COLUMNS} FROM ({_SESSIONS_SQL})")
def stream_job_sessions(spark, sf_dir):
    stream = lifecycle.job_sessions(domain.lifecycle_events(_Streamed(spark, sf_dir), sf_dir), 360)
    table = lifecycle.job_sessions(domain.lifecycle_events(spark, sf_dir), 360)
    # A session may begin long before the watermark, so the whole table is summed up for the open ones.
    # From the last event, not from the window: a filter on the window would be applied to events before they are merged.
    end = F.col("last_event_at") + F.expr("INTERVAL 6 HOURS")
    return _shown_sessions(run_append(spark, stream, lambda mark: table, end, "sessions"))


@query(
    "stream_job_timeouts",
    """WITH gaps AS (SELECT *, lag(ts) OVER (PARTITION BY job_id ORDER BY ts) AS prev FROM lifecycle),
         runs AS (SELECT *, sum(CASE WHEN ts - prev < INTERVAL 6 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY job_id ORDER BY ts) AS s FROM gaps)
       SELECT job_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_event_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_event_at,
         count(*) FILTER (WHERE event_type = 'ItemCollected') AS items_collected,
         CAST(coalesce(sum(size_bytes) FILTER (WHERE event_type = 'ItemCollected'), 0) AS BIGINT) AS bytes_collected,
         count(*) FILTER (WHERE event_type = 'BackoffTriggered') AS backoffs,
         CASE WHEN count(*) FILTER (WHERE event_type = 'JobCompleted') > 0 THEN 'Completed'
           WHEN max(ts) + INTERVAL 6 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) FROM lifecycle) THEN 'TimedOut' ELSE 'Open' END AS state
       FROM runs GROUP BY job_id, s""",
)
def stream_job_timeouts(spark, sf_dir):
    """Events arrive in four batches, each up to twenty hours late, so sessions time out, open again and are joined."""
    events = domain.lifecycle_events(spark, sf_dir).select("event_id", "job_id", "event_type", "ts", "size_bytes")
    arrival = F.col("ts") + F.make_dt_interval(secs=F.col("event_id") * 7919 % 72_000)
    day = F.greatest(F.least(F.datediff(arrival, F.lit(domain.EVENTS_FROM)), F.lit(31)), F.lit(0))
    root, output, checkpoint = (new_folder(spark, name) for name in ("late-events", "job-changes", "job-changes-checkpoint"))
    for number in range(4):
        events.where(F.floor(day / 8) == number).drop("event_id").write.mode("append").parquet(root)
        stream = spark.readStream.schema(events.drop("event_id").schema).parquet(root)
        timeouts.run_job_changes(timeouts.job_changes(stream, 360), output, checkpoint).awaitTermination()
    return timeouts.current_sessions(spark.read.parquet(output)).select(
        "job_id", stamp("first_event_at").alias("first_event_at"), stamp("last_event_at").alias("last_event_at"),
        "items_collected", "bytes_collected", "backoffs", "state",
    )


def _manifest_files(spark: SparkSession, sf_dir: str, repeat_job: str | None = None) -> dict[str, list[tuple[str, str]]]:
    """Per side, a manifest file for each custodian and job in a folder of its own: (path, name to land under)."""
    found = {}
    for side, rows in (("source", domain.source_manifest(spark, sf_dir)), ("collected", domain.collected_manifest(spark, sf_dir))):
        if side == "collected" and repeat_job:
            rows = rows.unionByName(rows.filter(F.col("job_id") == repeat_job))
        folder = new_folder(spark, f"{side}-parts")
        # A file for each custodian and job, which are dealt to as many tasks.
        files.write_manifest_csv(rows.withColumn("owner", F.col("custodian")).repartition("owner", "job_id"), folder, ["owner", "job_id"])
        found[side] = []
        for path in list_names(spark, f"{folder}/owner=*/job_id=*/*.csv"):
            custodian, job = path.split("owner=")[1].split("/")[0], path.split("job_id=")[1].split("/")[0]
            found[side].append((path, f"{unquote(custodian)}_{job}_{side}.csv"))
    return found


def _land(spark: SparkSession, manifests: list[tuple[str, str]], folder: str) -> None:
    for path, name in manifests:
        rename_file(spark, path, f"{folder}/{name}")


_COUNTED = ("source_count", "collected_count", "missed_count", "extra_count")


@query(
    "stream_reconcile",
    """SELECT job_id AS scope_job_id, source_count, collected_count, missed_count, extra_count FROM recon_counts""",
)
def stream_reconcile(spark, sf_dir):
    """Manifests of each custodian arrive as files, in three batches; a second run finds all reported."""
    landed = _manifest_files(spark, sf_dir)
    sides = {side: new_folder(spark, side) for side in landed}
    for side, manifests in landed.items():
        _land(spark, manifests, sides[side])
    output, checkpoint = new_folder(spark, "reconciled"), new_folder(spark, "reconcile-checkpoint")
    for _ in range(2):
        reconcile_stream.run_reconciliation(spark, sides["collected"], sides["source"], output, checkpoint, max_files=3).awaitTermination()
    return spark.read.parquet(f"{output}/summary").select("scope_job_id", *_COUNTED)


@query(
    "stream_reconcile_waiting",
    """SELECT job_id AS scope_job_id, CASE WHEN job_id = 'job-2' THEN 'repeated key' ELSE 'reported' END AS outcome,
         CASE WHEN job_id <> 'job-2' THEN source_count END AS source_count, CASE WHEN job_id <> 'job-2' THEN collected_count END AS collected_count,
         CASE WHEN job_id <> 'job-2' THEN missed_count END AS missed_count, CASE WHEN job_id <> 'job-2' THEN extra_count END AS extra_count
       FROM recon_counts""",
)
def stream_reconcile_waiting(spark, sf_dir):
    """The two manifests of a job land in different runs, in either order; one job repeats its keys and is set aside."""
    landed = {side: sorted(manifests, key=lambda m: m[1]) for side, manifests in _manifest_files(spark, sf_dir, "job-2").items()}
    sides = {side: new_folder(spark, side) for side in landed}
    output, checkpoint = new_folder(spark, "reconciled"), new_folder(spark, "reconcile-checkpoint")
    for odd in range(2):
        # Every second job's source comes a run after what was collected, and the others' the other way round.
        _land(spark, landed["collected"][odd::2], sides["collected"])
        _land(spark, landed["source"][1 - odd :: 2], sides["source"])
        reconcile_stream.run_reconciliation(spark, sides["collected"], sides["source"], output, checkpoint, max_files=2).awaitTermination()
    reported = spark.read.parquet(f"{output}/summary").select("scope_job_id", F.lit("reported").alias("outcome"), *_COUNTED)
    rejected = spark.read.parquet(f"{output}/rejects").select("scope_job_id", F.col("reason").alias("outcome"))
    return reported.unionByName(rejected, allowMissingColumns=True)


@query(
    "stream_retention",
    """WITH p AS (SELECT metric, value, ts, epoch_us(ts) % 3 AS k FROM metric_points),
         h AS (SELECT k, max(ts) AS newest FROM p GROUP BY 1),
         seen AS (SELECT a.k, max(b.newest) AS horizon FROM h a LEFT JOIN h b ON b.k < a.k GROUP BY 1)
       SELECT CASE WHEN horizon IS NULL OR ts >= horizon - INTERVAL 24 HOUR THEN 'kept' ELSE 'late' END AS destination,
         metric, count(*) AS points FROM p JOIN seen ON p.k = seen.k GROUP BY 1, 2""",
)
def stream_retention(spark, sf_dir):
    """Points in three batches; after the first, most are older than the retention."""
    points = domain.metric_points(spark, sf_dir)
    root = new_folder(spark, "points")
    for number in range(3):
        points.filter(F.unix_micros("ts") % 3 == number).coalesce(1).write.mode("append").parquet(root)
    kept, late, horizon = (new_folder(spark, name) for name in ("kept", "late", "horizon"))
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(root)
    (
        stream.writeStream.foreachBatch(metrics.retention_sink(kept, late, horizon))
        .option("checkpointLocation", new_folder(spark, "retention-checkpoint"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    both = [spark.read.schema(points.schema).parquet(p).withColumn("destination", F.lit(n)) for n, p in (("kept", kept), ("late", late))]
    return both[0].unionByName(both[1]).groupBy("destination", "metric").agg(F.count(F.lit(1)).alias("points"))


_LIVE = "NOT deleted AND (delta_type = 'Mail' OR (NOT is_folder AND is_file))"


def _run_feed(spark, sf_dir, base=None):
    """The change log as three batches, the later ones full of changes older than what came before."""
    changes = domain.changes(spark, sf_dir)
    root = new_folder(spark, "feed")
    for number in range(3):
        changes.filter(F.col("version") % 3 == number).coalesce(1).write.mode("append").parquet(root)
    log = delta_stream.ChangeLog(spark, new_folder(spark, "change-log"), domain.CHANGE_SCHEMA)
    if base is not None:
        log.start(base)
    store = CursorStore(spark, new_folder(spark, "feed-cursors"))
    known = changes.filter("delta_type = 'OneDrive'").select("scope_id").distinct()
    store.save(
        domain.cursors(spark, sf_dir).limit(0).unionByName(
            known.select(
                "scope_id", F.lit("OneDrive").alias("delta_type"), F.lit("").alias("delta_token"), F.lit(True).alias("is_active"),
                F.lit(0).cast("long").alias("delta_query_count"), F.lit(0).cast("long").alias("last_delta_item_count"),
            ),
            allowMissingColumns=True,
        )
    )
    feed = spark.readStream.schema(domain.CHANGE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(root)
    delta_stream.run_change_feed(feed, log, store, new_folder(spark, "feed-checkpoint")).awaitTermination()
    return log, store


@query(
    "stream_delta_apply",
    f"""SELECT item_id, version, size_bytes, scope_id FROM (SELECT * FROM changes WHERE deleted OR {_LIVE}
         QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY version DESC) = 1) WHERE NOT deleted""",
)
def stream_delta_apply(spark, sf_dir):
    before = domain.changes(spark, sf_dir).filter(F.col("ts") < domain.instant(domain.BASE_UNTIL))
    base = latest_by(before.filter(delta.is_live() | delta.is_deleted()), ["item_id"], [F.col("version")]).filter("NOT deleted")
    log, _ = _run_feed(spark, sf_dir, base)
    return log.snapshot().select("item_id", "version", "size_bytes", "scope_id")


@query(
    "stream_delta_compacted",
    f"""SELECT item_id, version, size_bytes, scope_id FROM (SELECT * FROM changes WHERE deleted OR {_LIVE}
         QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY version DESC) = 1) WHERE NOT deleted""",
)
def stream_delta_compacted(spark, sf_dir):
    """A new snapshot between rounds of changes; what comes after it holds older versions and items that it knows as deleted."""
    changes = domain.changes(spark, sf_dir)
    log = delta_stream.ChangeLog(spark, new_folder(spark, "layers"), domain.CHANGE_SCHEMA)
    for number in range(3):
        log.append(changes.filter(F.col("version") % 3 == 2 - number), number)
        if number < 2:
            log.compact(number)
    return log.snapshot().select("item_id", "version", "size_bytes", "scope_id")


@query(
    "stream_delta_cursors",
    f"""WITH c AS (SELECT *, version % 3 AS k, {_LIVE} AS live FROM changes
           QUALIFY row_number() OVER (PARTITION BY version % 3, item_id, deleted OR ({_LIVE}) ORDER BY version DESC) = 1),
         r AS (SELECT scope_id, k, count(*) FILTER (WHERE live) AS n, coalesce(sum(size_bytes) FILTER (WHERE live), 0) AS b, max(version) AS v FROM c GROUP BY 1, 2),
         s AS (SELECT scope_id, max(v) AS v, count(*) AS q, arg_max(n, k) AS n, arg_max(b, k) AS b FROM r GROUP BY 1)
       SELECT scope_id, CAST(v AS VARCHAR) AS delta_token, q AS delta_query_count, n AS last_delta_item_count, CAST(b AS BIGINT) AS last_delta_size_bytes
       FROM s WHERE scope_id IN (SELECT scope_id FROM changes WHERE delta_type = 'OneDrive')""",
)
def stream_delta_cursors(spark, sf_dir):
    _, store = _run_feed(spark, sf_dir)
    return store.load().select("scope_id", "delta_token", "delta_query_count", "last_delta_item_count", "last_delta_size_bytes")


def _ingested(spark: SparkSession, output: str) -> DataFrame:
    results = spark.read.parquet(f"{output}/results").withColumn("custodian", F.regexp_replace("custodian", "^[a-z]+=", ""))
    return results.groupBy("custodian", "outcome").agg(F.count(F.lit(1)).alias("record_count"), F.sum("bytes_fetched").alias("total_bytes"))


@query(
    "stream_ingest",
    """SELECT custodian, outcome, count(*) AS record_count, CAST(sum(bytes_fetched) AS BIGINT) AS total_bytes FROM fetched GROUP BY 1, 2""",
)
def stream_ingest(spark, sf_dir):
    """Datasets written by a finished job, whose marker stands above them all."""
    root = new_folder(spark, "landing")
    domain.file_records(spark, sf_dir).drop("doc_id", "dataset").write.partitionBy("matter", "custodian").json(root)
    output = new_folder(spark, "ingest")
    landing_stream.run_ingest(
        spark, root, domain.landed_content(spark, sf_dir), output, new_folder(spark, "ingest-checkpoint"), max_errors=1 << 30
    ).awaitTermination()
    return _ingested(spark, output)


@query(
    "stream_ingest_markers",
    """SELECT custodian, outcome, count(*) AS record_count, CAST(sum(bytes_fetched) AS BIGINT) AS total_bytes
       FROM fetched WHERE matter <> 'fr' GROUP BY 1, 2""",
)
def stream_ingest_markers(spark, sf_dir):
    """Markers before, with and after their data; datasets of one matter never get one, those of another are arrays."""
    records = domain.file_records(spark, sf_dir).drop("doc_id", "dataset")
    output, checkpoint, root = new_folder(spark, "ingest"), new_folder(spark, "ingest-checkpoint"), new_folder(spark, "landing")
    waiting = []
    for matter in ("en", "de", "fr", "es"):
        mine = records.filter(F.col("matter") == matter)
        if matter == "es":
            value = F.struct(*[c for c in mine.columns if c not in ("matter", "custodian")])
            mine = mine.select("matter", "custodian", F.to_json(value).alias("value")).groupBy("matter", "custodian")
            lines = F.concat(F.lit("[\n"), F.array_join(F.collect_list("value"), ",\n"), F.lit("\n]"))
            writer = mine.agg(lines.alias("value")).repartition("matter", "custodian").write.partitionBy("matter", "custodian")
            writer.mode("append").option("lineSep", "\n").format("text").save(f"{root}/{matter}-text")
            for path in list_names(spark, f"{root}/{matter}-text/matter=*/custodian=*/part-*"):
                rename_file(spark, path, path.replace(f"{matter}-text", f"{matter}-run").removesuffix(".txt") + ".json")
            remove_folder(spark, f"{root}/{matter}-text")
        else:
            mine.write.partitionBy("matter", "custodian").json(f"{root}/{matter}-run")
            if matter != "en":
                waiting.append(f"{root}/{matter}-run/_SUCCESS")
    for path in waiting:
        remove_folder(spark, path)
    content = domain.landed_content(spark, sf_dir)
    for late in ((), ("de", "es"), ()):
        for matter in late:
            # A marker alone, without a new file: no batch of the stream starts for it.
            spark.range(1).write.parquet(f"{root}/{matter}-marker")
            rename_file(spark, f"{root}/{matter}-marker/_SUCCESS", f"{root}/{matter}-run/_SUCCESS")
        landing_stream.run_ingest(spark, root, content, output, checkpoint, max_errors=1 << 30, max_files=5).awaitTermination()
    return _ingested(spark, output)


@query("stream_event_counters", COUNTERS_SQL)
def stream_event_counters(spark, sf_dir):
    target = new_folder(spark, "counters")
    events = domain.lifecycle_events(_Streamed(spark, sf_dir), sf_dir)
    metrics.run_counters(events, target, new_folder(spark, "counters-checkpoint")).awaitTermination()
    return metrics.latest_batch(spark.read.parquet(target))
