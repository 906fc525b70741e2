"""Streaming queries: the stand-in rows arrive in appends of files, a batch each, and the streams keep their state between them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.plans.queries import query
from talkloom.sources import scratch
from talkloom.streaming import state
from talkloom.streaming.progress import COMMANDS, DONE_SUFFIX, FAILED_SUFFIX, FINALIZE, OTHER, described

#: Appends in which the rows of a stand-in arrive, in the order of their time.
APPENDS = 3


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").where("event_id IS NOT NULL AND ts IS NOT NULL AND user_id IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp"))


def streamed(spark: SparkSession, rows: DataFrame, order: str | Column, operator: Callable[[DataFrame], DataFrame], last: str | None = None) -> DataFrame:
    """What ``operator`` makes of rows that arrive in the order of ``order``; with ``last`` only the last batch of each of its values.

    The stream stops after each append and goes on from its checkpoint, so that an append is a batch whatever its number
    of files.  Where timers go by the watermark, ``order`` has to be their time: rows behind it are dropped.
    """
    own = state.session(spark)
    order = F.col(order) if isinstance(order, str) else order
    with scratch.folder(spark) as at:
        edges = rows.select(F.percentile_approx(order, [k / APPENDS for k in range(1, APPENDS)])).first()[0] or []
        number = sum(((order > e).cast("int") for e in edges), F.lit(0))
        rows = scratch.kept(rows.withColumn("append", number))

        def write(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/out/{number}")

        for k in range(APPENDS):
            rows.where(F.col("append") == k).drop("append").write.mode("append").parquet(f"{at}/in")
            source = own.readStream.schema(rows.drop("append").schema).parquet(f"{at}/in")
            run = operator(source).writeStream.foreachBatch(write).outputMode("update" if last else "append").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
            run.awaitTermination()
        out = spark.read.option("recursiveFileLookup", "true").parquet(f"{at}/out")
        if last:
            out = out.join(out.groupBy(last).agg(F.max("batch").alias("batch")), [last, "batch"])
        return scratch.kept(out.drop("batch"))


_E = "e AS (SELECT * REPLACE (CAST(ts AS TIMESTAMP) AS ts) FROM events WHERE event_id IS NOT NULL AND ts IS NOT NULL AND user_id IS NOT NULL)"


# ---- snapshots and lines ----


def call_log(spark: SparkSession, d: str) -> DataFrame:
    """Input rows of ``state.changed``: every third event is a state of its call, the others are lines, of the run of twelve hours later."""
    e = _events(spark, d)
    run = lambda ts: F.col("user_id") * 100 + F.floor(F.datediff(ts, F.lit("2024-01-01")) / 7)
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "completed").otherwise("running")
    states = e.where("event_id % 3 = 0").select(F.col("user_id").alias("call_id"), F.col("event_id").alias("seq"), run(F.col("ts")).alias("run_id"), status.alias("job_status"), F.floor(F.col("value") / 20).alias("attempts"))
    said = e.where("event_id % 3 > 0").select(
        F.col("user_id").alias("call_id"), F.col("event_id").alias("seq"), run(F.col("ts") + F.expr("INTERVAL 12 HOURS")).alias("run_id"), F.floor(F.col("event_id") / 500).alias("line"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("stage"), F.lit("active").alias("state"), F.col("props").alias("message"),
    )
    return state.snapshots(states, ["attempts", "job_status", "run_id"]).unionByName(state.lines(said))


_LOG = f"""{_E},
x AS (
  SELECT user_id AS call_id, event_id AS seq, event_id % 3 = 0 AS shown, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'completed' ELSE 'running' END AS status,
    user_id * 100 + date_diff('day', DATE '2024-01-01', CAST(ts + CASE WHEN event_id % 3 = 0 THEN INTERVAL 0 HOUR ELSE INTERVAL 12 HOUR END AS DATE)) // 7 AS run_id,
    CAST(floor(value / 20) AS BIGINT) AS attempts, event_id // 500 AS line, CASE WHEN event_type <> 'view' THEN event_type END AS stage, props
  FROM e),
y AS (
  SELECT *, coalesce(sum(CAST(shown AND status <> 'running' AS INT)) OVER (PARTITION BY call_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part,
    '{{"attempts":' || attempts || ',"job_status":"' || status || '","run_id":' || run_id || '}}' AS body
  FROM x),
states AS (
  SELECT *, lag(body) OVER (PARTITION BY call_id, part ORDER BY seq) AS last FROM y WHERE shown),
runs AS (
  SELECT *, lead(first_seq) OVER (PARTITION BY call_id, part ORDER BY first_seq) AS until FROM (SELECT call_id, part, run_id, min(seq) AS first_seq FROM states GROUP BY ALL)),
said AS (
  SELECT y.*, coalesce(max(line) OVER (PARTITION BY call_id, part, run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above
  FROM y JOIN runs USING (call_id, part, run_id) WHERE NOT shown AND (until IS NULL OR seq < until))"""


@query(f"""WITH {_LOG}
SELECT call_id, run_id, 'snapshot' AS event, 'snapshot-' || run_id AS event_id, body AS snapshot, NULL AS line, NULL AS stage, NULL AS state, NULL AS message FROM states WHERE body IS DISTINCT FROM last
UNION ALL
SELECT call_id, run_id, 'done', 'done-' || run_id, body, NULL, NULL, NULL, NULL FROM states WHERE status <> 'running'
UNION ALL
SELECT call_id, run_id, 'progress', 'run-' || run_id || '-line-' || line, NULL, line, stage, 'active', props FROM said WHERE line > above AND stage IS NOT NULL""")
def progress_changes(spark, d):
    """What viewers of all calls are told, by a stream with state per call."""
    return streamed(spark, call_log(spark, d), "seq", state.changed)


# ---- leases and runs ----


@query(f"""WITH {_E},
x AS (
  SELECT user_id AS job_id, event_type <> 'error' AS running, 'w' || event_id % 3 AS claimed_by, epoch_us(ts) // 1000 AS t, epoch_us(ts + to_microseconds(CAST(floor(value * 3600) AS BIGINT) * 1000000)) // 1000 AS until,
    lead(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS next, max(epoch_us(ts) // 1000) OVER () AS mark
  FROM e)
SELECT job_id, claimed_by, 'pending' AS status, '{state.LEASE_EXPIRED}' AS last_error, until AS expired_ms
FROM x WHERE running AND until < coalesce(next, mark - 1)""")
def expired_leases(spark, d):
    """Leases of all jobs that run out before they are renewed, by timers on the watermark."""
    e = _events(spark, d)
    until = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.floor(F.col("value") * 3600).cast("decimal(18,6)"))
    claims = e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "failed").otherwise("running").alias("status"), F.concat(F.lit("w"), F.col("event_id") % 3).alias("claimed_by"), until.alias("lease_expires_at"), F.col("ts").alias("at"))
    out = streamed(spark, claims, F.unix_millis("at"), lambda s: state.expired_leases(s, by="eventTime"))
    return out.select("job_id", "claimed_by", "status", "last_error", F.unix_millis("expired_at").alias("expired_ms"))


@query(f"""WITH {_E},
x AS (
  SELECT user_id * 100 + date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 5 AS run_id, event_id AS seq, epoch_us(ts) // 1000 AS t, CAST(floor(value / 8) AS BIGINT) AS size, event_type = 'error' AS ended, max(epoch_us(ts) // 1000) OVER () AS mark FROM e),
y AS (
  SELECT *, min(t) OVER w AS started, lag(size) OVER w IS DISTINCT FROM size AS grew, lead(t) OVER w AS next FROM x WINDOW w AS (PARTITION BY run_id ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
z AS (
  SELECT *, max(CASE WHEN grew THEN t END) OVER w AS active, bool_or(ended) OVER w AS done FROM y WINDOW w AS (PARTITION BY run_id ORDER BY t, seq)),
s AS (
  SELECT *, least(started + 172800000, active + 57600000) AS due, started + 172800000 <= active + 57600000 AS hard FROM z)
SELECT run_id, CAST(CASE WHEN hard THEN 124 ELSE 125 END AS INTEGER) AS exit_code, CASE WHEN hard THEN 'hard_timeout' ELSE 'idle_timeout' END AS reason, due AS stopped_ms
FROM s WHERE due < coalesce(next, mark - 1) AND NOT done QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY t, seq) = 1""")
def stopped_runs(spark, d):
    """Runs of all calls to stop two days after their start or sixteen hours without growth, by timers on the watermark."""
    e = _events(spark, d)
    growth = e.select(
        (F.col("user_id") * 100 + F.floor(F.datediff("ts", F.lit("2024-01-01")) / 5)).alias("run_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"),
        F.floor(F.col("value") / 8).alias("size"), F.when(F.col("event_type") == "error", 1).alias("exit_code"),
    )
    out = streamed(spark, growth, F.unix_millis("at"), lambda s: state.stopped_runs(s, 172800, 57600, by="eventTime", forget_seconds=5 * 86400))
    return out.select("run_id", "exit_code", "reason", F.unix_millis("at").alias("stopped_ms"))


# ---- latest events ----


@query(f"""WITH {_E},
x AS (
  SELECT user_id % 10 AS run_id, event_id // 3 AS line, event_type AS stage, min('s' || event_id % 2) AS state, 'm' || event_id % 3 // 2 AS message FROM e GROUP BY ALL)
SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY line DESC, stage DESC, message DESC) <= 200""")
def recent_events(spark, d):
    """The last 200 different events of each run (the limit is the feature)."""
    e = _events(spark, d)
    said = e.select((F.col("user_id") % 10).alias("run_id"), F.floor(F.col("event_id") / 3).alias("line"), F.col("event_type").alias("stage"), F.concat(F.lit("s"), F.col("event_id") % 2).alias("state"), F.concat(F.lit("m"), F.floor(F.col("event_id") % 3 / 2)).alias("message"), F.col("ts").alias("timestamp"), F.col("event_id").alias("seq"))
    last = streamed(spark, said, F.unix_millis("timestamp"), state.recent_events, last="run_id")
    return last.select("run_id", F.explode("events").alias("e")).select("run_id", "e.*")


# ---- commands ----

_COMMANDS = ("python Prepare_Audio.py x", "python transcribe_audio.py --model x", "run mlx_whisper large-v3-4bit", "ffprobe a.mp3", "cd x; file a.mp3", "python -m venv x", "cat SKILL.md", "sed -i s/a/b/ call.md", "git status")
_STAGE_OF = (COMMANDS[0][1:], COMMANDS[2][1:], COMMANDS[1][1:], COMMANDS[3][1:], COMMANDS[3][1:], COMMANDS[4][1:], COMMANDS[5][1:], FINALIZE, OTHER)


@query(
    f"""WITH {_E}, c(k, stage, label) AS (VALUES {", ".join(f"({k}, '{s}', '{label}')" for k, (s, label) in enumerate(_STAGE_OF))}),
x AS (SELECT event_id, event_id % 2 = 0 AS started, event_id % 10 = 3 OR event_id % 14 = 5 AS failed, stage, label, props FROM e JOIN c ON k = event_id % {len(_COMMANDS)})
SELECT event_id, stage, CASE WHEN started THEN 'active' WHEN failed THEN 'failed' ELSE 'completed' END AS state,
  CASE WHEN started THEN label WHEN failed THEN label || '{FAILED_SUFFIX}: ' || props || '…' ELSE label || '{DONE_SUFFIX}' END AS message FROM x"""
)
def command_events(spark, d):
    """Stage, state and message of the commands that runs have started and completed, some of which failed."""
    e, k = _events(spark, d), F.col("event_id")
    command = F.element_at(F.array(*(F.lit(c) for c in _COMMANDS)), (k % len(_COMMANDS) + 1).cast("int"))
    failed = (k % 10 == 3) | (k % 14 == 5)
    output = F.concat(F.lit(" "), F.col("props"), F.lit("…\n"))
    item = F.struct(F.lit("command_execution").alias("type"), F.when(k % 10 == 3, "failed").otherwise("completed").alias("status"), command.alias("command"), F.when((k % 14 == 5) & (k % 10 != 3), 2).otherwise(0).alias("exit_code"), F.when(failed, output).alias("aggregated_output"))
    body = F.to_json(F.struct(F.when(k % 2 == 0, "item.started").otherwise("item.completed").alias("type"), item.alias("item")))
    return described(e.select("event_id", body.alias("value")), "value", "event_id").drop("timestamp")
