"""State over streams: restarts, manual clocks, shuffled and late rows, against plain Python."""

import datetime
import random
import time
from types import SimpleNamespace as Obj

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from talkloom.plans import streams
from talkloom.streaming import state

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


class Handle:
    """State of one key in memory, with its timers."""

    def __init__(self):
        self.timers, self.kept = set(), {}

    def getValueState(self, name, schema):
        return Obj(exists=lambda: name in self.kept, get=lambda: self.kept[name], update=lambda v: self.kept.__setitem__(name, v), clear=lambda: self.kept.pop(name, None))

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def listTimers(self):
        return iter(self.timers)


class Clock:
    """Runs a processor of one key by hand: rows and the passing of time."""

    def __init__(self, processor):
        self.p, self.handle, self.now, self.out = processor, Handle(), 0, []
        processor.init(self.handle)

    def _time(self):
        return Obj(getCurrentProcessingTimeInMs=lambda: self.now, getCurrentWatermarkInMs=lambda: self.now)

    def rows(self, *rows):
        self.out += self.p.handleInputRows((1,), iter(rows), self._time())

    def to(self, now):
        self.now = now
        for at in sorted(t for t in self.handle.timers if t <= now):
            self.handle.timers.remove(at)
            self.out += self.p.handleExpiredTimer((1,), self._time(), Obj(getExpiryTimeInMs=lambda at=at: at))


def claim(at, until, status="running", who="w"):
    return Row(at_ms=at, seq=at, status=status, claimed_by=who, lease_expires_at_ms=until)


def test_leases_by_a_manual_clock():
    c = Clock(state.Leases("processingTime"))
    c.rows(claim(0, 7200))
    c.to(7200)
    assert c.out == []  # not yet past
    c.to(7201)
    assert [(r.job_id, r.claimed_by, r.status, r.last_error, r.until) for r in c.out] == [(1, "w", "pending", state.LEASE_EXPIRED, 7200)]
    c.to(99_999)
    assert len(c.out) == 1 and not c.handle.timers and not c.handle.kept  # once
    c.rows(claim(100_000, 107_000))
    c.to(106_000)
    c.rows(claim(106_000, 113_000))  # renewed
    c.to(112_000)
    assert len(c.out) == 1 and c.handle.timers == {113_001}
    c.rows(claim(112_500, None, "completed"))
    c.to(999_999)
    assert len(c.out) == 1 and not c.handle.timers  # finished
    c.rows(claim(0, 10), claim(20, 30, who="v"), claim(5, 8, who="u"))  # in one batch, all long past
    assert [(r.claimed_by, r.until) for r in c.out[1:]] == [("u", 8), ("v", 30)] and not c.handle.kept
    c.rows(claim(0, None))
    assert not c.handle.kept and not c.handle.timers  # never expires


def grown(at, size, code=None):
    return Row(at_ms=at, seq=at, size=size, exit_code=code)


def test_runs_are_stopped_by_a_manual_clock():
    watch = lambda: Clock(state.Watch(10, 2, "processingTime", 60))
    idle = watch()
    idle.rows(grown(0, 5))
    idle.to(1500)
    idle.rows(grown(1500, 6))
    idle.to(3000)
    idle.rows(grown(3000, 6))  # no growth
    idle.to(3500)
    assert idle.out == []
    idle.to(3501)
    assert [tuple(r) for r in idle.out] == [(1, 125, "idle_timeout", 3500)]
    idle.to(4000)
    idle.rows(grown(4000, 9))
    idle.to(63_501)
    assert len(idle.out) == 1 and not idle.handle.kept and not idle.handle.timers  # forgotten
    hard = watch()
    for at in range(0, 10_001, 1000):
        hard.to(at)
        hard.rows(grown(at, at))
    hard.to(10_001)
    assert [tuple(r) for r in hard.out] == [(1, 124, "hard_timeout", 10_000)]
    ended = watch()
    ended.rows(grown(0, 1), grown(1, 2, code=0))
    ended.to(50_000)
    ended.rows(grown(60_000, 3))
    assert ended.out == []
    both = Clock(state.Watch(2, 2, "processingTime", 60))
    both.rows(grown(0, None))
    both.to(2001)
    assert [r.exit_code for r in both.out] == [124]
    late = watch()
    late.rows(grown(0, 1), grown(5000, 2))  # the deadline lies between rows of one batch
    assert [tuple(r) for r in late.out] == [(1, 125, "idle_timeout", 2000)]


def test_leases_expire_by_the_clock_of_a_stream(spark, tmp_path):
    """Timers run though no rows come."""
    own, src = state.session(spark), str(tmp_path / "in")
    now = datetime.datetime.now(datetime.UTC)
    rows = [(1, 1, "running", "a", now + datetime.timedelta(seconds=1), now), (2, 2, "running", "b", now + datetime.timedelta(hours=1), now), (3, 3, "failed", "c", None, now), (None, 4, "running", "d", now, now)]
    df = spark.createDataFrame(rows, "job_id long, seq long, status string, claimed_by string, lease_expires_at timestamp, at timestamp")
    df.write.parquet(src)
    lost = state.expired_leases(own.readStream.schema(df.schema).parquet(src))
    q = lost.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(processingTime="300 milliseconds").start()
    got, until = [], time.time() + 90
    while time.time() < until and not got:
        time.sleep(1)
        got = spark.read.schema(lost.schema).parquet(str(tmp_path / "out")).collect() if (tmp_path / "out" / "_spark_metadata").exists() else []
    time.sleep(2)
    q.stop()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.job_id, r.claimed_by, r.last_error) for r in got] == [(1, "a", state.LEASE_EXPIRED)]


def told(rows):
    """What viewers are told, by plain Python: a poll after every row."""
    out, seen, unread = [], {}, {}
    for r in sorted(rows, key=lambda r: r.seq):
        c = r.call_id
        if r.snapshot is None:
            unread.setdefault(c, []).append(r)
        else:
            if c not in seen or seen[c][1] != r.snapshot:
                out.append((c, r.run_id, "snapshot", f"snapshot-{r.run_id or 0}", r.snapshot, None, None, None, None))
            seen[c] = (r.run_id, r.snapshot, seen[c][2] if c in seen and seen[c][0] == r.run_id else 0)
        if c in seen:
            run, body, line = seen[c]
            for x in sorted((x for x in unread.get(c, ()) if x.run_id == run), key=lambda x: x.line):
                if x.line > line and x.stage:
                    out.append((c, run, "progress", f"run-{run}-line-{x.line}", None, x.line, x.stage, x.state, x.message))
                line = max(line, x.line)
            seen[c] = (run, body, line)
            unread[c] = [x for x in unread.get(c, ()) if run is None or x.run_id > run]
        if r.snapshot is not None and r.job_status in ("completed", "failed", "skipped"):
            out.append((c, r.run_id, "done", f"done-{r.run_id or 0}", r.snapshot, None, None, None, None))
            seen.pop(c), unread.pop(c, None)
    return sorted(map(str, out))


@pytest.fixture(scope="module")
def log(spark):
    """States and lines of 12 calls: runs that follow each other, lines ahead of their run, repeated and without news."""
    rng, rows, run, line = random.Random(4), [], {}, {}
    for seq in range(900):
        c = rng.randrange(12)
        run.setdefault(c, None)
        if rng.random() < 0.35:
            if run[c] is None or rng.random() < 0.2:
                run[c] = (run[c] or 10 * c) + rng.choice([0, 1])
            rows.append((c, seq, None if rng.random() < 0.1 and run[c] == 10 * c else run[c], rng.choice(["running", "running", "running", "pending", "failed"]), rng.randrange(2), None, None, None, None))
        elif run[c] is not None:
            r = run[c] + rng.choice([0, 0, 0, 1, -1])
            line[r] = line.get(r, 0) + rng.choice([0, 1, 1, 2])
            rows.append((c, seq, r, None, None, line[r], rng.choice(["whisper", None, "review"]), "active", f"m{rng.randrange(3)}"))
    df = spark.createDataFrame(rows, "call_id long, seq long, run_id long, job_status string, attempts long, line long, stage string, state string, message string")
    return state.snapshots(df.where("job_status IS NOT NULL"), ["run_id", "job_status", "attempts"]).unionByName(state.lines(df.where("job_status IS NULL")))


def test_changes_survive_a_restart(spark, log, tmp_path):
    """A stream over growing files is stopped in its work and started again from its checkpoint: each change once."""
    own, src, out = state.session(spark), str(tmp_path / "in"), str(tmp_path / "out")
    rows = log.collect()
    for k in range(6):
        log.where(F.floor(F.col("seq") / 150) == k).orderBy(F.rand(k)).coalesce(1).write.mode("append").parquet(src)
        if k == 1 or k == 3:
            source = own.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(src)
            q = state.changed(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", out).trigger(processingTime="100 milliseconds").start()
            until = time.time() + 90
            while time.time() < until and (q.lastProgress is None or not q.lastProgress["sources"][0]["numInputRows"]):
                time.sleep(0.2)
            q.stop()  # wherever it is
    source = own.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(src)
    state.changed(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", out).trigger(availableNow=True).start().awaitTermination()
    want = told(rows)
    got = sorted(str(tuple(r)) for r in spark.read.parquet(out).collect())
    assert got == want and {e for e in ("snapshot", "progress", "done") if any(f"'{e}'" in w for w in want)} == {"snapshot", "progress", "done"}


def test_changes_of_a_table(log):
    """The windows of a finished table; run ids of a call grow, as the stream of them does."""
    rows = log.where("run_id IS NOT NULL")
    assert sorted(str(tuple(r)) for r in state.changed_in(rows).collect()) == told(rows.collect())
    assert state.changed_in(log.where("false")).count() == 0


def test_recent_events_in_any_order(spark, tmp_path):
    """Shuffled, repeated and late rows: rows older than the watermark go, of the others the last 20 stay."""
    rng = random.Random(5)
    rows = [(run, line, rng.choice(["a", "b", None]), rng.choice(["active", "failed"]), rng.choice(["m", "", None]), START + datetime.timedelta(seconds=line)) for run in (1, 2) for line in range(300)]
    rows += rng.sample(rows, 150) + [(None, 1, "a", "b", "c", START), (1, None, "a", "b", "c", START), (1, 5, "a", "b", "c", None), (3, 7, "x", "y", "z", START)]
    rng.shuffle(rows)
    schema = "run_id long, line long, stage string, state string, message string, timestamp timestamp"
    own, src = state.session(spark), str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame(rows[k::3], schema).coalesce(1).write.mode("append").parquet(src)
    far = START + datetime.timedelta(hours=2)
    spark.createDataFrame([(1, 400, "a", "b", "c", far), (2, 401, "a", "b", "c", far)], schema).coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame([(4, 1, "x", "y", "z", far)], schema).coalesce(1).write.mode("append").parquet(src)  # rows are late from the batch after the next on
    spark.createDataFrame([(1, 399, "late", "b", "c", START), (1, 402, "in time", "b", "c", far - datetime.timedelta(minutes=9))], schema).coalesce(1).write.mode("append").parquet(src)
    source = own.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    write = lambda batch, n: batch.withColumn("n", F.lit(n)).write.mode("overwrite").parquet(str(tmp_path / "out" / str(n)))
    state.recent_events(source, keep=20, forget_seconds=60).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    got = {}
    for r in sorted(spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out")).collect(), key=lambda r: r.n):
        got[r.run_id] = [tuple(e) for e in r.events]
    kept = [*rows, (4, 1, "x", "y", "z", far), (1, 400, "a", "b", "c", far), (2, 401, "a", "b", "c", far), (1, 402, "in time", "b", "c", far)]
    want = {}
    for run, line, stage, what, message, at in kept:
        if None not in (run, line, at):
            name = (line, stage or "", message or "")
            of = want.setdefault(run, {})
            of[name] = min(of.get(name, what), what)
    want = {run: sorted((n[0], n[1], s, n[2]) for n, s in of.items())[-20:] for run, of in want.items()}
    assert got == want
    batch = {}
    for r in state.recent_events_in(spark.createDataFrame(kept, schema), 20).collect():
        batch.setdefault(r.run_id, []).append((r.line, r.stage, r.state, r.message))
    assert {k: sorted(v) for k, v in batch.items()} == want


def test_streams_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    for q in (streams.progress_changes, streams.expired_leases, streams.stopped_runs, streams.recent_events):
        assert q(spark, str(tmp_path)).count() == 0


def test_timers_of_events_whose_ids_disagree_with_their_times(spark, tmp_path):
    import duckdb

    from talkloom.plans.queries import ORACLES

    kinds = ("view", "error", "click", "signup")
    rows = [(copy * 300 + k, START.replace(tzinfo=None) + datetime.timedelta(hours=2 * k, milliseconds=copy), copy * 10 + k % 7, kinds[(k // 5 + copy) % 4], float(k * 13 % 40), "{}") for copy in range(3) for k in range(300)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for q in (streams.expired_leases, streams.stopped_runs):
        got = q(spark, str(tmp_path))
        want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[q.__name__]})").fetchall()
        assert want and sorted(map(tuple, got.collect())) == sorted(want)
