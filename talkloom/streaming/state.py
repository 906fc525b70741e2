"""Keyed state over streams: changed snapshots and new log lines of calls, expiring leases, runs without progress, latest events.

All four are state per key in ``transformWithState``, so they survive a restart
from their checkpoint and spread over the cluster by key.  ``session`` gives a
session with the state store they need; the caller's settings stay as they are.

Each processor works through the rows of a key in the order of ``seq`` or of
their time, whatever order a batch brings them in; a batch never brings rows that
are older than those of the batches before (``Recent`` takes any order).  Timers
run by the clock of the machine or, with ``by="eventTime"``, by the watermark,
which makes them repeatable; a row that is later than a deadline finds it passed
even where its timer has not yet fired.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from talkloom.streaming.progress import TERMINAL

#: The error of a lease that ran out, exit codes and reasons of runs that are stopped.
LEASE_EXPIRED = "Previous worker lease expired"
HARD, IDLE = (124, "hard_timeout"), (125, "idle_timeout")
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session(spark: SparkSession) -> SparkSession:
    """A session of its own whose streams keep state in RocksDB."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    return own


def _named(schema: str) -> Row:
    """Makes rows of a schema from their values."""
    return Row(*(c.split()[0] for c in schema.split(", ")))


def _timed(rows: DataFrame, time: str, by: str, delay: str, *others: str) -> DataFrame:
    """Adds the milliseconds of ``time`` and of ``others``, and a watermark where timers need it."""
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    rows = rows.withColumn(time, F.col(time).cast("timestamp")).withColumns({f"{c}_ms": ms(c) for c in (time, *others)})
    return rows.withWatermark(time, delay) if by == "eventTime" else rows


# ---- snapshots and lines of calls ----

CHANGES = "call_id long, run_id long, event string, event_id string, snapshot string, line long, stage string, state string, message string"


def snapshots(rows: DataFrame, public: list[str]) -> DataFrame:
    """Input rows of ``changed`` from states of calls with call_id, seq, run_id (null without a run), job_status: their ``public`` columns as one text."""
    body = F.to_json(F.struct(*sorted(public)), {"ignoreNullFields": "false"})
    return rows.select("call_id", "seq", "run_id", "job_status", body.alias("snapshot"), *(F.lit(None).cast(t).alias(c) for c, t in (("line", "long"), ("stage", "string"), ("state", "string"), ("message", "string"))))


def lines(rows: DataFrame) -> DataFrame:
    """Input rows of ``changed`` from described lines with call_id, seq, run_id, line, stage, state, message; the stage of lines without news is null, lines without a run or number are left out."""
    return rows.where("run_id IS NOT NULL AND line IS NOT NULL").select("call_id", "seq", "run_id", *(F.lit(None).cast("string").alias(c) for c in ("job_status", "snapshot")), "line", "stage", "state", "message")


class Changed(StatefulProcessor):
    """State of a call: run, digest of the last snapshot, last line read; lines of runs that no snapshot has shown yet."""

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "run long, digest string, line long")
        self.waiting = handle.getListState("waiting", "run long, line long, stage string, state string, message string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seen = self.seen.get() if self.seen.exists() else None
        waiting = [tuple(w) for w in self.waiting.get()] if self.waiting.exists() else []
        had = bool(waiting)
        out: list[tuple] = []
        for r in sorted(rows, key=lambda r: r.seq):
            if r.snapshot is None:
                waiting.append((r.run_id, r.line, r.stage, r.state, r.message))
            else:
                digest = hashlib.sha256(r.snapshot.encode()).hexdigest()
                run, last, line = seen or (None, None, 0)
                if digest != last:
                    out.append((r.run_id, "snapshot", f"snapshot-{r.run_id or 0}", r.snapshot, None, None, None, None))
                seen = (r.run_id, digest, line if run == r.run_id else 0)
            if seen is not None:
                run, digest, line = seen
                for _, n, stage, state, message in sorted((w for w in waiting if w[0] == run), key=lambda w: w[1]):
                    if n > line and stage is not None:
                        out.append((run, "progress", f"run-{run or 0}-line-{n}", None, n, stage, state, message))
                    line = max(line, n)
                seen = (run, digest, line)
                waiting = [w for w in waiting if run is None or w[0] > run]
            if r.snapshot is not None and r.job_status in TERMINAL:
                out.append((r.run_id, "done", f"done-{r.run_id or 0}", r.snapshot, None, None, None, None))
                seen, waiting = None, []
        self.seen.update(seen) if seen else self.seen.clear()
        if waiting:
            self.waiting.put(waiting)
        elif had:
            self.waiting.clear()
        for x in out:
            yield _named(CHANGES)(key[0], *x)

    def close(self) -> None:
        pass


def changed(rows: DataFrame) -> DataFrame:
    """What a viewer of each call is told, for a stream of ``snapshots`` and ``lines`` (rows without call or seq are left out).

    A snapshot if its text differs from the one before, a line with news if its number is above all read of its run,
    which starts anew with a new run, and done with a terminal status, after which nothing of the call is kept.  Lines
    of a run wait for the first snapshot with that run; lines of earlier runs are dropped.
    """
    return rows.where("call_id IS NOT NULL AND seq IS NOT NULL").groupBy("call_id").transformWithState(Changed(), CHANGES, "append", "none")


def changed_in(rows: DataFrame) -> DataFrame:
    """The same for a finished table, by windows."""
    rows = rows.where("call_id IS NOT NULL AND seq IS NOT NULL")
    before = Window.partitionBy("call_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    x = rows.withColumn("is_snapshot", F.col("snapshot").isNotNull()).withColumn("ends", F.col("is_snapshot") & F.coalesce(F.col("job_status").isin(*TERMINAL), F.lit(False)))
    x = x.withColumn("part", F.coalesce(F.sum(F.col("ends").cast("long")).over(before), F.lit(0)))
    shown = x.where("is_snapshot").withColumn("last", F.lag("snapshot").over(Window.partitionBy("call_id", "part").orderBy("seq")))
    null = lambda t: F.lit(None).cast(t)
    tell = lambda df, event: df.select("call_id", "run_id", F.lit(event).alias("event"), F.concat(F.lit(event + "-"), F.coalesce("run_id", F.lit(0))).alias("event_id"), "snapshot", null("long").alias("line"), *(null("string").alias(c) for c in ("stage", "state", "message")))
    runs = shown.groupBy("call_id", "part", "run_id").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    later = Window.partitionBy("call_id", "part").orderBy("first_seq")
    runs = runs.withColumn("until", F.lead("first_seq").over(later))
    r = runs.select(*(F.col(c).alias("r_" + c) for c in ("call_id", "part", "run_id", "until")))
    said = x.where(~F.col("is_snapshot")).join(r, (F.col("call_id") == F.col("r_call_id")) & (F.col("part") == F.col("r_part")) & F.col("run_id").eqNullSafe(F.col("r_run_id")))
    said = said.where(F.col("r_until").isNull() | (F.col("seq") < F.col("r_until")))
    first = Window.partitionBy("call_id", "part", "run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    said = said.withColumn("above", F.coalesce(F.max("line").over(first), F.lit(0))).where((F.col("line") > F.col("above")) & F.col("stage").isNotNull())
    said = said.select("call_id", "run_id", F.lit("progress").alias("event"), F.concat(F.lit("run-"), F.coalesce("run_id", F.lit(0)), F.lit("-line-"), "line").alias("event_id"), null("string").alias("snapshot"), "line", "stage", "state", "message")
    return tell(shown.where(~F.col("snapshot").eqNullSafe(F.col("last"))), "snapshot").unionAll(said).unionAll(tell(shown.where("ends"), "done"))


# ---- timers ----


class _Timed(StatefulProcessor):
    """One deadline a key at most; ``by`` names the clock."""

    def __init__(self, by: str):
        self.by = by

    def now(self, timerValues) -> int:
        return timerValues.getCurrentWatermarkInMs() if self.by == "eventTime" else timerValues.getCurrentProcessingTimeInMs()

    def wake(self, at: int | None) -> None:
        """The key's one timer, just after ``at``; none without a time."""
        for old in [*self.handle.listTimers()]:
            if at is None or old != at + 1:
                self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(at + 1)

    def close(self) -> None:
        pass


_EXPIRED = "job_id long, claimed_by string, status string, last_error string, until long"


class Leases(_Timed):
    """State of a job: who holds it, and until when."""

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "claimed_by string, until long")

    def _lost(self, key, held) -> Row:
        return _named(_EXPIRED)(key[0], held[0], "pending", LEASE_EXPIRED, held[1])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = tuple(self.held.get()) if self.held.exists() else None
        for r in sorted(rows, key=lambda r: (r.at_ms, r.seq)):
            if held and held[1] < r.at_ms:
                yield self._lost(key, held)
            held = (r.claimed_by, r.lease_expires_at_ms) if r.status == "running" and r.lease_expires_at_ms is not None else None
        if held and self.by != "eventTime" and held[1] < self.now(timerValues):
            yield self._lost(key, held)
            held = None
        self.held.update(held) if held else self.held.clear()
        self.wake(held[1] if held else None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = tuple(self.held.get()) if self.held.exists() else None
        if held and held[1] < expiredTimerInfo.getExpiryTimeInMs():
            self.held.clear()
            yield self._lost(key, held)


def expired_leases(claims: DataFrame, by: str = "processingTime", delay: str = "0 seconds") -> DataFrame:
    """Each lease that ran out, once, for a stream of states of jobs: job_id, seq, status, claimed_by, lease_expires_at, at.

    A running state starts or renews the lease, any other ends it; a running state without a time never expires.  Null
    job ids and states without a time of their own (``at``) are left out.
    """
    claims = _timed(claims.where(F.col("job_id").isNotNull() & F.col("at").isNotNull()), "at", by, delay, "lease_expires_at")
    lost = claims.groupBy("job_id").transformWithState(Leases(by), _EXPIRED, "append", by)
    return lost.select("job_id", "claimed_by", "status", "last_error", F.timestamp_millis("until").alias("expired_at"))


_STOPPED = "run_id long, exit_code int, reason string, at long"


class Watch(_Timed):
    """State of a run: start, last growth and size of its logs, all in milliseconds and bytes."""

    def __init__(self, hard_seconds: float, idle_seconds: float, by: str, forget_seconds: float):
        super().__init__(by)
        self.hard, self.idle, self.forget = (int(s * 1000) for s in (hard_seconds, idle_seconds, forget_seconds))

    def init(self, handle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "started long, active long, size long, ended boolean")

    def deadline(self, run) -> tuple[int, tuple[int, str]]:
        """The earlier limit, and what it does; of equal ones the hard one."""
        return min((run[0] + self.hard, HARD), (run[1] + self.idle, IDLE))

    def _stop(self, key, run) -> Row:
        at, (code, reason) = self.deadline(run)
        return _named(_STOPPED)(key[0], code, reason, at)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        run = tuple(self.run.get()) if self.run.exists() else None
        for r in sorted(rows, key=lambda r: (r.at_ms, r.seq)):
            if run and run[3]:
                break
            if run and self.deadline(run)[0] < r.at_ms:
                yield self._stop(key, run)
                run = (*run[:3], True)
                break
            size = r.size or 0
            run = (r.at_ms, r.at_ms, size, False) if run is None else (run[0], r.at_ms if size != run[2] else run[1], size, False)
            if r.exit_code is not None:
                run = (*run[:3], True)
        if not run[3] and self.by != "eventTime" and self.deadline(run)[0] < self.now(timerValues):
            yield self._stop(key, run)
            run = (*run[:3], True)
        self._keep(run)

    def _keep(self, run) -> None:
        """An ended run is remembered for a while, so that its late rows don't start it again."""
        self.run.update(run)
        self.wake(self.deadline(run)[0] + (self.forget if run[3] else 0))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        run = tuple(self.run.get()) if self.run.exists() else None
        if run and run[3]:
            self.run.clear()
        elif run and self.deadline(run)[0] < expiredTimerInfo.getExpiryTimeInMs():
            self._keep((*run[:3], True))
            yield self._stop(key, run)


def stopped_runs(growth: DataFrame, hard_seconds: float = 600, idle_seconds: float = 120, by: str = "processingTime", delay: str = "0 seconds", forget_seconds: float = 86400) -> DataFrame:
    """Runs to stop, each once, for a stream of run_id, seq, at, size (bytes of its logs), exit_code (null while it runs).

    A run starts with its first row.  It is stopped ``hard_seconds`` after that, or ``idle_seconds`` after its size last
    changed, whichever is first, unless it has ended by then; ``forget_seconds`` later its state goes.  Null run ids and
    rows without a time are left out.
    """
    growth = _timed(growth.where(F.col("run_id").isNotNull() & F.col("at").isNotNull()), "at", by, delay)
    stopped = growth.groupBy("run_id").transformWithState(Watch(hard_seconds, idle_seconds, by, forget_seconds), _STOPPED, "append", by)
    return stopped.withColumn("at", F.timestamp_millis("at"))


# ---- latest events ----

RECENT = "run_id long, events array<struct<line:long,stage:string,state:string,message:string>>"


class Recent(StatefulProcessor):
    """State of a run: its last events, at most ``keep``, with the time of the newest row in milliseconds."""

    def __init__(self, keep: int, forget_ms: int):
        self.keep, self.forget = keep, forget_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "line long, stage string, state string, message string")
        self.newest = handle.getValueState("newest", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = [tuple(e) for e in self.events.get()] if self.events.exists() else []
        before = list(held)
        newest = self.newest.get()[0] if self.newest.exists() else 0
        known = {(e[0], e[1], e[3]): e for e in held}
        for r in rows:
            newest = max(newest, r.timestamp_ms)
            name = (r.line, r.stage or "", r.message or "")
            e = (r.line, r.stage or "", r.state or "", r.message or "")
            known[name] = min(known.get(name, e), e)
            if len(known) >= 2 * self.keep + 1000:
                known = self._last(known)
        held = sorted(self._last(known).values())
        if held != before:
            self.events.put(held)
            yield Row(run_id=key[0], events=[Row(line=e[0], stage=e[1], state=e[2], message=e[3]) for e in held])
        self.newest.update((newest,))
        for old in [*self.handle.listTimers()]:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(newest + self.forget + 1)

    def _last(self, known: dict) -> dict:
        return dict(sorted(known.items())[-self.keep :])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.events.clear()
        self.newest.clear()
        return iter(())

    def close(self) -> None:
        pass


def recent_events(events: DataFrame, keep: int = 200, delay: str = "10 minutes", forget_seconds: int = 86400) -> DataFrame:
    """The last ``keep`` different events of each run after every batch that changes them, for a stream of run_id, line, stage, state, message, timestamp.

    Events are told apart by line, stage and message and ordered so; of one event with several states the smallest stays.
    Rows may come in any order, repeated, and late by ``delay``.  The state of a run holds ``keep`` events and goes when
    the watermark is ``forget_seconds`` past its newest one.  Rows without a run, line or timestamp are left out; a null
    stage, state or message is empty.
    """
    events = events.where(F.col("run_id").isNotNull() & F.col("line").isNotNull() & F.col("timestamp").isNotNull())
    return _timed(events, "timestamp", "eventTime", delay).groupBy("run_id").transformWithState(Recent(keep, forget_seconds * 1000), RECENT, "update", "eventTime")


def recent_events_in(events: DataFrame, keep: int = 200) -> DataFrame:
    """The same for a finished table: run_id, line, stage, state, message."""
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("stage", "state", "message")]
    x = events.where(F.col("run_id").isNotNull() & F.col("line").isNotNull() & F.col("timestamp").isNotNull()).select("run_id", "line", *text)
    x = x.groupBy("run_id", "line", "stage", "message").agg(F.min("state").alias("state"))
    newest = Window.partitionBy("run_id").orderBy(F.desc("line"), F.desc("stage"), F.desc("message"))
    return x.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= keep).select("run_id", "line", "stage", "state", "message")

