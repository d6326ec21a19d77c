"""Job lifecycles that are told as they change: timers find time-outs, late events reopen them.

``lifecycle.job_sessions`` gives a session once, when the watermark has passed it, so a
time-out is known as late as an event may come. Here the state of a job is its sessions that
can still change. A timer tells a time-out as soon as the stream's latest event is past it; an
event that comes late, but not later than the watermark allows, opens the session again or joins
two; a second timer forgets a session once nothing can change it any more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.ipc  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from casetrail.operators.ordering import latest_by
from casetrail.session import ship
from casetrail.streaming.lifecycle import per_row

# Facts of a session that are added up or narrowed; times are in microseconds.
_FACTS = "started_at bigint, completed_at bigint, first_event_at bigint, last_event_at bigint, items_collected bigint, bytes_collected bigint, backoffs bigint"
#: The sessions of a bucket of jobs as an Arrow stream, the last revision it gave out, and the time of its timer.
STATE_SCHEMA = "sessions binary, revision bigint, due bigint"
#: Buckets that jobs are dealt to by hash, fixed for the life of a stream, as the partitions of its state are.
BUCKETS = 512
CHANGE_SCHEMA = f"job_id {{key}}, revision bigint, state string, {_FACTS}"
#: A session that became part of another, or whose first event turned out to be earlier.
MERGED = "Merged"
#: States as they are numbered in the sessions held; nothing was told yet at 0.
_TOLD = ("", "Open", "Completed", "TimedOut", MERGED)
# Times that are not there, as what leaves a minimum or a maximum alone.
_EVER, _NEVER = np.iinfo(np.int64).max, np.iinfo(np.int64).min
_MISSING = {"started_at": _EVER, "completed_at": _NEVER}
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Session:
    """A run of a job's events; ``told`` is the state that was given out last, if any."""

    started_at: int | None
    completed_at: int | None
    first_event_at: int
    last_event_at: int
    items_collected: int
    bytes_collected: int
    backoffs: int
    told: str | None = None

    def joined(self, later: Session) -> Session:
        """Both as one, not yet told."""
        starts = [t for t in (self.started_at, later.started_at) if t is not None]
        ends = [t for t in (self.completed_at, later.completed_at) if t is not None]
        return Session(
            min(starts, default=None),
            max(ends, default=None),
            min(self.first_event_at, later.first_event_at),
            max(self.last_event_at, later.last_event_at),
            self.items_collected + later.items_collected,
            self.bytes_collected + later.bytes_collected,
            self.backoffs + later.backoffs,
        )

    def state_at(self, latest: int, timeout: int) -> str:
        """The state when the stream's latest event is at ``latest``."""
        if self.completed_at is not None:
            return "Completed"
        return "TimedOut" if self.last_event_at + timeout <= latest else "Open"


@dataclass
class Timeline:
    """The sessions of one job that can still change, in order, and what has changed in this round.

    The rules, session by session; the stream follows them for many jobs at once (``merge_sessions``, ``_Lifecycle``).
    """

    sessions: list[Session]
    timeout: int
    changes: list[tuple[str, Session]] = field(default_factory=list)

    def add(self, spans: list[Session]) -> None:
        """Merge further runs of events in; those at most a timeout apart are one session."""
        before = {s.first_event_at for s in self.sessions if s.told}
        merged: list[Session] = []
        for span in sorted(self.sessions + spans, key=lambda s: (s.first_event_at, s.last_event_at)):
            if merged and span.first_event_at - merged[-1].last_event_at < self.timeout:
                merged[-1] = merged[-1].joined(span)
            else:
                merged.append(span)
        gone = before - {s.first_event_at for s in merged}
        self.changes += [(MERGED, s) for s in self.sessions if s.first_event_at in gone]
        self.sessions = merged

    def tell(self, latest: int) -> None:
        """Note every session whose state or facts were not told yet."""
        for place, session in enumerate(self.sessions):
            state = session.state_at(latest, self.timeout)
            if state != session.told:
                self.sessions[place] = replace(session, told=state)
                self.changes.append((state, self.sessions[place]))

    def forget(self, watermark: int) -> None:
        """Drop sessions that no event at or after the watermark can reach."""
        self.sessions = [s for s in self.sessions if s.last_event_at + self.timeout > watermark]


def merge_sessions(rows: pd.DataFrame, timeout: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """``Timeline.add`` for many jobs at once: their sessions after merging, and those told before that are gone.

    ``rows`` has the sessions held and further runs of events, in any order, as ``_HELD`` columns.
    """
    n = len(rows)
    if not n:
        return rows, rows
    job = pd.factorize(rows["job_id"])[0]
    order = np.lexsort((rows["last_event_at"], rows["first_event_at"], job))
    rows, job = rows.iloc[order], job[order]
    first, last, told = (rows[c].to_numpy() for c in ("first_event_at", "last_event_at", "told"))
    reach = pd.Series(last).groupby(job).cummax().to_numpy()
    begins = np.ones(n, bool)
    begins[1:] = (job[1:] != job[:-1]) | (first[1:] - reach[:-1] >= timeout)
    at = np.flatnonzero(begins)
    size = np.diff(np.append(at, n))
    merged = {"job_id": rows["job_id"].to_numpy()[at]}
    for name, fold in _FOLDS.items():
        merged[name] = fold.reduceat(rows[name].to_numpy(), at)
    merged["told"] = np.where(size == 1, told[at], 0).astype(np.int8)
    return pd.DataFrame(merged), rows[(told > 0) & (first != np.repeat(first[at], size))]


class _Lifecycle(StatefulProcessor):
    """The sessions of a bucket of jobs. Buckets have one value of state and one timer each, so calls into Spark do not grow with jobs or sessions."""

    def __init__(self, timeout: int, delay: int) -> None:
        self._timeout, self._delay = timeout, delay

    def init(self, handle) -> None:
        self._handle = handle
        self._state = handle.getValueState("bucket", STATE_SCHEMA)

    def _step(self, watermark_ms: int, spans: list[pd.DataFrame], fired: int | None = None) -> Iterator[pd.DataFrame]:
        held, revision, due = self._state.get() or (None, 0, None)
        if held is not None:
            spans = [pa.ipc.open_stream(bytes(held)).read_pandas(), *spans]
        if not spans:
            return
        sessions, gone = merge_sessions(pd.concat(spans, ignore_index=True), self._timeout)
        # The stream's latest event is as far above the watermark as events may be late; there is no watermark at first.
        watermark = watermark_ms * 1000
        latest = watermark + self._delay if watermark > 0 else 0
        end = sessions["last_event_at"].to_numpy() + self._timeout
        ended = np.where(end <= latest, _TOLD.index("TimedOut"), _TOLD.index("Open"))
        state = np.where(sessions["completed_at"].to_numpy() != _NEVER, _TOLD.index("Completed"), ended).astype(np.int8)
        changed = sessions["told"].to_numpy() != state
        sessions["told"] = state
        changes = [gone.assign(told=_TOLD.index(MERGED)), sessions[changed]]
        # No event at or after the watermark can reach the others any more.
        kept = end > watermark
        sessions = sessions[kept]
        told = sum(map(len, changes))
        soonest = None
        if len(sessions):
            opened = state[kept] == _TOLD.index("Open")
            times = np.where(opened, np.maximum(end[kept] - self._delay, 1000), end[kept])
            # Rounded up, so that the time is past when the timer fires.
            soonest = int(-(-times.min() // 1000))
        if due is not None and due not in (soonest, fired):
            self._handle.deleteTimer(due)
        if soonest is not None and (soonest != due or due == fired):
            self._handle.registerTimer(soonest)
        self._state.update((_packed(sessions) if len(sessions) else None, revision + told, soonest))
        if told:
            yield _told_rows(pd.concat(changes, ignore_index=True), revision)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        spans: list[pd.DataFrame] = []
        for frame in rows:
            # Minutes of several tasks may overlap; each batch of rows is merged at once, so busy jobs stay small.
            found = frame[["job_id", *_NAMES]].assign(told=np.int8(0))
            for name in _NAMES:
                # Columns with missing values come as floats, which cannot hold the marks themselves.
                found[name] = np.where(found[name].isna(), _MISSING.get(name, 0), found[name].fillna(0).astype("int64"))
            spans = [merge_sessions(pd.concat([*spans, found], ignore_index=True), self._timeout)[0]]
        yield from self._step(timerValues.getCurrentWatermarkInMs(), spans)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._step(timerValues.getCurrentWatermarkInMs(), [], expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def _packed(sessions: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(sessions, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _told_rows(changes: pd.DataFrame, revision: int) -> pd.DataFrame:
    shown = {"job_id": changes["job_id"], "revision": np.arange(revision + 1, revision + 1 + len(changes)), "state": np.array(_TOLD, object)[changes["told"]]}
    for name in _NAMES:
        values = changes[name].to_numpy()
        shown[name] = pd.arrays.IntegerArray(values, values == _MISSING[name]) if name in _MISSING else values
    return pd.DataFrame(shown)


_NAMES = tuple(part.split()[0] for part in _FACTS.split(", "))
#: How facts of runs that become one session are put together.
_FOLDS = {"started_at": np.minimum, "completed_at": np.maximum, "first_event_at": np.minimum, "last_event_at": np.maximum}
_FOLDS |= {name: np.add for name in _NAMES if name not in _FOLDS}


def _by_minute(key: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Sums events of one job and minute within a batch of rows, so that a busy job is small before the shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            minute = frame["last_event_at"] // 60_000_000
            grouped = frame.groupby([frame[key], minute], sort=False, dropna=False)
            parts = {
                "started_at": grouped["started_at"].min(),
                "completed_at": grouped["completed_at"].max(),
                "first_event_at": grouped["first_event_at"].min(),
                "last_event_at": grouped["last_event_at"].max(),
                "items_collected": grouped["items_collected"].sum(),
                "bytes_collected": grouped["bytes_collected"].sum(),
                "backoffs": grouped["backoffs"].sum(),
            }
            summed = pd.DataFrame(parts).reset_index(level=0)
            yield summed.astype({"started_at": "Int64", "completed_at": "Int64"})

    return run


def _micros(interval_minutes: int) -> int:
    return interval_minutes * 60_000_000


def job_changes(events: DataFrame, timeout_minutes: int = 30, late_minutes: int = 24 * 60) -> DataFrame:
    """Every change of a session of a job: a row with its facts so far, its state and a rising ``revision``.

    ``events`` is a stream with ``job_id``, ``event_type``, ``ts`` and ``size_bytes``; rows without a job or
    a time are left out. States are ``Open``, ``Completed``, ``TimedOut`` and ``Merged``, by which a session
    told before is taken back. Events of one minute are late only if all of them are. The timeout is at
    least a minute. Jobs are dealt to ``BUCKETS`` buckets, each worked on as one table, so that Python and the state store are
    called for buckets, not for jobs; a bucket's sessions that can still change must fit into a task. Revisions rise with every change of the bucket.
    """
    if timeout_minutes < 1:
        raise ValueError("a timeout is at least a minute")
    ship(events.sparkSession)
    key_type = events.schema["job_id"].dataType.simpleString()
    timed = events.where("job_id IS NOT NULL AND ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp"))
    facts = timed.select("job_id", *per_row())
    spans = facts.mapInPandas(_by_minute("job_id"), f"job_id {key_type}, {_FACTS}")
    bucket = F.pmod(F.xxhash64("job_id"), F.lit(BUCKETS)).cast("int")
    marked = spans.withColumns({"at": F.timestamp_micros("last_event_at"), "bucket": bucket}).withWatermark("at", f"{late_minutes} minutes")
    processor = _Lifecycle(_micros(timeout_minutes), _micros(late_minutes))
    changes = marked.groupBy("bucket").transformWithStateInPandas(
        processor, CHANGE_SCHEMA.format(key=key_type), outputMode="Append", timeMode="EventTime"
    )
    moments = [c for c in _NAMES if c.endswith("_at")]
    return changes.withColumns({c: F.timestamp_micros(c) for c in moments})


def run_job_changes(changes: DataFrame, output: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append the changes to ``output``; each is written once, also after a failure."""
    spark = changes.sparkSession
    before = spark.conf.get(_PROVIDER)
    # Timers need this store; a query keeps the store that it was started with.
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        writer = changes.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint)
        return writer.outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set(_PROVIDER, before)


def current_sessions(changes: DataFrame) -> DataFrame:
    """The sessions as last told; a session is known by its job and its first event."""
    latest = latest_by(changes, ["job_id", "first_event_at"], [F.col("revision")])
    return latest.where(F.col("state") != MERGED).drop("revision")
