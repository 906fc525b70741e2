"""Progress of running calls from append-only JSON lines.

``describe`` turns an event into a stage, a state and a message and is the same
expression for batch and streams.  ``follow`` reads new lines of a folder; a
line that is still being written is read again when it is complete, because
the file source takes whole files: writers append by adding files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.functions.text import compact
from talkloom.schemas import EVENT

#: Fixed values: (stage, label) of commands by what they mention, in order of precedence.
COMMANDS = (
    (("prepare_audio.py",), "prepare_audio", "آماده‌سازی، اندازه‌گیری و تقویت صدا"),
    (("large-v3-4bit",), "whisper_review", "اجرای گذر بازبینی Whisper"),
    (("transcribe_audio.py", "mlx_whisper"), "whisper", "اجرای تشخیص گفتار Whisper"),
    (("ffprobe", "afinfo"), "inspect_audio", "بررسی مشخصات و سلامت فایل صوتی"),
    (("pip install", "venv"), "runtime", "آماده‌سازی ابزارهای پردازش محلی"),
    (("skill.md",), "instructions", "بارگذاری دستورالعمل تبدیل تماس"),
)
FINALIZE = ("finalize", "ساخت و کنترل فایل Markdown نهایی")
OTHER = ("processing", "اجرای یکی از مراحل پردازش")
STARTED = "پردازش شروع شد"
TURN_STARTED = "فرآیند بررسی و تبدیل تماس آغاز شد"
TURN_FAILED = "پردازش با خطا روبه‌رو شد"
TURN_DONE = "این مرحله پایان یافت؛ پردازش ادامه دارد"
STAGE_MESSAGE = "پردازش محلی"
REVIEW_MESSAGE = "پاسخ ساخت‌یافتهٔ بازبینی دریافت شد؛ در حال اعتبارسنجی و ثبت نتیجه"
ROLES_MESSAGE = "نقش‌های پیشنهادی دریافت شد؛ در حال بررسی شواهد هر گوینده"
FAILED_SUFFIX = " ناموفق بود"
DONE_SUFFIX = " انجام شد"
TERMINAL = ("completed", "failed", "skipped")


def _mentions(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out |= F.contains(text, F.lit(w))
    return out


def command_stage(command: Column) -> Column:
    """Struct (stage, label) of a command line."""
    c = F.lower(F.coalesce(command, F.lit("")))
    pair = lambda stage, label: F.struct(F.lit(stage).alias("stage"), F.lit(label).alias("label"))
    decoder = _mentions(c, COMMANDS[2][0])
    rules = [
        (_mentions(c, COMMANDS[0][0]), COMMANDS[0][1:]),
        (decoder & _mentions(c, COMMANDS[1][0]), COMMANDS[1][1:]),
        (decoder, COMMANDS[2][1:]),
        (_mentions(c, COMMANDS[3][0]) | c.rlike(r"(^|[ ;])file "), COMMANDS[3][1:]),
        (_mentions(c, COMMANDS[4][0]), COMMANDS[4][1:]),
        (_mentions(c, COMMANDS[5][0]), COMMANDS[5][1:]),
        (F.contains(c, F.lit(".md")) & _mentions(c, ("write", "sed", "test", "ls")), FINALIZE),
    ]
    out = pair(*OTHER)
    for cond, value in reversed(rules):
        out = F.when(cond, pair(*value)).otherwise(out)
    return out


def describe(event: Column, stage_type: str = "talkloom.stage") -> Column:
    """Struct (stage, state, message) of an event, null for events without news.  ``stage_type`` names own stage events."""
    kind, item = event["type"], event["item"]
    say = lambda stage, state, message: F.struct(stage.alias("stage"), state.alias("state"), message.alias("message"))
    fixed = lambda stage, state, message: say(F.lit(stage), F.lit(state), F.lit(message))
    given = lambda c, default: F.when(c == "", F.lit(default)).otherwise(c)
    cmd = command_stage(item["command"])
    failed = (F.coalesce(item["status"], F.lit("")) == "failed") | (F.coalesce(item["exit_code"], F.lit(0)) != 0)
    output = compact(item["aggregated_output"], 180)
    detail = F.concat(cmd["label"], F.lit(FAILED_SUFFIX), F.when(output != "", F.concat(F.lit(": "), output)).otherwise(F.lit("")))
    answer = F.try_parse_json(item["text"])
    has = lambda path: F.coalesce(F.startswith(F.schema_of_variant(F.try_variant_get(answer, path, "variant")), F.lit("ARRAY")), F.lit(False))
    is_message = F.coalesce(item["type"] == "agent_message", F.lit(False))
    is_command = F.coalesce(item["type"] == "command_execution", F.lit(False))
    return (
        F.when(kind == stage_type, say(given(compact(event["stage"], 80), "processing"), given(compact(event["state"], 40), "active"), given(compact(event["message"]), STAGE_MESSAGE)))
        .when(kind == "thread.started", fixed("starting", "completed", STARTED))
        .when(kind == "turn.started", fixed("starting", "active", TURN_STARTED))
        .when(kind.isin("turn.failed", "error"), say(F.lit("error"), F.lit("failed"), compact(F.coalesce(F.nullif(event["message"], F.lit("")), F.nullif(event["error"], F.lit("")), F.lit(TURN_FAILED)))))
        .when(kind == "turn.completed", fixed("finalize", "completed", TURN_DONE))
        .when(is_message & has("$.segments"), fixed("finalize", "active", REVIEW_MESSAGE))
        .when(is_message & has("$.roles"), fixed("speaker_roles", "active", ROLES_MESSAGE))
        .when(is_message & (compact(item["text"]) != ""), say(F.lit("review"), F.lit("active"), compact(item["text"])))
        .when(is_command & (kind == "item.started"), say(cmd["stage"], F.lit("active"), cmd["label"]))
        .when(is_command & (kind == "item.completed") & failed, say(cmd["stage"], F.lit("failed"), detail))
        .when(is_command & (kind == "item.completed"), say(cmd["stage"], F.lit("completed"), F.concat(cmd["label"], F.lit(DONE_SUFFIX))))
    )


def described(lines: DataFrame, value: str = "value", *keep: str) -> DataFrame:
    """Rows with news of a table of JSON lines; lines that aren't JSON objects are left out."""
    e = lines.withColumn("_e", F.from_json(value, EVENT)).withColumn("_d", describe(F.col("_e"))).where(F.col("_d").isNotNull())
    return e.select(*keep, "_d.stage", "_d.state", "_d.message", F.to_timestamp(F.col("_e.timestamp")).alias("timestamp"))


def follow(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of described events with the file they come from."""
    lines = spark.readStream.format("text").load(folder).withColumn("path", F.col("_metadata.file_path"))
    return described(lines, "value", "path")


def fresh(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A stream without repeated events: each (path, stage, state, message) once within the watermark."""
    return events.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["path", "stage", "state", "message"])


def activity(events: DataFrame, idle: str = "120 seconds", delay: str = "10 minutes") -> DataFrame:
    """Sessions of a run's log with gaps below ``idle``; a closed session is an idle run."""
    return events.withWatermark("timestamp", delay).groupBy("path", F.session_window("timestamp", idle)).agg(F.count("*").alias("events"), F.max_by("state", "timestamp").alias("last_state"))


def latest(events: DataFrame) -> DataFrame:
    """Last state of each run so far, and whether it ended."""
    return events.groupBy("path").agg(F.max(F.struct("timestamp", "stage", "state", "message")).alias("m")).select("path", "m.*", F.col("m.state").isin(*TERMINAL).alias("done"))


def changes(previous: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Rows of the current snapshot that differ from the previous one."""
    mark = lambda df: F.sha2(F.to_json(F.struct(*(c for c in sorted(df.columns) if c != key))), 256)
    old = previous.select(F.col(key).alias("_k"), mark(previous).alias("_m"))
    return current.withColumn("_n", mark(current)).join(old, (F.col(key) == F.col("_k")) & (F.col("_m") == F.col("_n")), "left_anti").drop("_n")


def tail(lines: DataFrame, after: int = 0, maximum: int = 40) -> DataFrame:
    """Described events of one numbered log after a line, the last ``maximum``; (line, value) in."""
    x = lines.where(F.col("line") > after)
    return described(x, "value", "line").orderBy(F.desc("line")).limit(maximum).orderBy("line")
