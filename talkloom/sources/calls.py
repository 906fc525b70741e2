"""Scans: recordings and their sidecar documents, and the inventory built from them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from talkloom import constants as C
from talkloom.functions import containers
from talkloom.functions import text as T
from talkloom.operators import revisions, store
from talkloom.sources.scratch import kept

_NAME = r"(?i)^(external|internal|out)-([^-]+)-([^-]+)-(\d{8})-(\d{6})-(.+)\.(?:" + "|".join(C.AUDIO_SUFFIXES) + ")$"


def parse_filename(name: Column | str) -> Column:
    """Struct (direction, agent_extension, remote_number, call_id, recorded_at); nulls where the name has another form."""
    n = F.col(name) if isinstance(name, str) else name
    part = lambda i: F.regexp_extract(n, _NAME, i)
    ok, kind = n.rlike(_NAME), F.lower(part(1))
    out = kind == "out"
    return F.struct(
        F.when(ok, F.when(kind == "external", "inbound").when(out, "outbound").otherwise("internal")).alias("direction"),
        F.when(ok, F.when(out, part(3)).otherwise(part(2))).alias("agent_extension"),
        F.when(ok, F.when(out, part(2)).otherwise(part(3))).alias("remote_number"),
        F.when(ok, part(6)).alias("call_id"),
        F.when(ok, F.try_to_timestamp(F.concat(part(4), part(5)), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")).alias("recorded_at"),
    )


def stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def collisions(paths: DataFrame, path: str = "absolute_path") -> DataFrame:
    """Paths whose transcript would have the name of another's: adds the sorted group."""
    w = Window.partitionBy(stem(F.col(path)))
    return paths.withColumn("_n", F.count("*").over(w)).where("_n > 1").withColumn("group", F.array_sort(F.collect_list(path).over(w))).drop("_n")


_PROBE = StructType([StructField("duration_seconds", DoubleType()), StructField("codec", StringType()), StructField("bitrate", LongType()), StructField("sample_rate", LongType()), StructField("channels", LongType()), StructField("metadata_error", StringType())])


@F.arrow_udf(_PROBE)
def _probed(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    from pyspark.sql.pandas.types import to_arrow_type

    for columns in batches:
        yield pa.array([containers.described(*(x.as_py() for x in row)) for row in zip(*columns, strict=True)], to_arrow_type(_PROBE))


def _number(content: Column, at: Column, n: int) -> Column:
    """n bytes from a place on (0-based) as a number; null where the content is shorter."""
    part = F.substring(content, at.cast("int") + 1, F.lit(n))
    return F.when(F.octet_length(part) == n, F.conv(F.hex(part), 16, 10).try_cast("long"))


def movie_box(content: Column) -> Column:
    """Place of the movie box of an MP4, which can stand before or after the samples: box by box, no bytes but their heads are read.  Null if there is none among the first 32 boxes."""

    def after(state: Column, _: Column) -> Column:
        at = state["at"]
        short = _number(content, at, 4)
        size = F.when(short == 1, _number(content, at + 8, 8)).when(short == 0, F.octet_length(content) - at).otherwise(short)
        here = F.substring(content, (at + 5).cast("int"), F.lit(4)) == F.lit(b"moov")
        ends = state["done"] | here | F.coalesce(size < 8, F.lit(True)) | (at + F.coalesce(size, F.lit(0)) >= F.octet_length(content))
        return F.struct(F.when(ends, at).otherwise(at + size).alias("at"), (state["found"] | (~state["done"] & here)).alias("found"), ends.alias("done"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(False).alias("found"), F.lit(False).alias("done"))
    is_mp4 = F.substring(content, F.lit(5), F.lit(4)) == F.lit(b"ftyp")
    return F.when(is_mp4, F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, after, lambda s: F.when(s["found"], s["at"])))


def tag_bytes(content: Column) -> Column:
    """Bytes of a leading ID3 tag, 0 without one."""
    seven = lambda k: _number(content, F.lit(6 + k), 1).bitwiseAND(127) * (1 << 7 * (3 - k))
    size = seven(0) + seven(1) + seven(2) + seven(3) + 10 + F.when(_number(content, F.lit(5), 1).bitwiseAND(16) > 0, 10).otherwise(0)
    return F.when(F.substring(content, F.lit(1), F.lit(3)) == F.lit(b"ID3"), F.coalesce(size, F.lit(0))).otherwise(F.lit(0)).cast("long")


def probe(content: Column, suffix: Column) -> Column:
    """Header columns of a recording, or the reason it can't be read; Python gets the bytes that matter only."""
    before, at = tag_bytes(content), movie_box(content)
    size = F.coalesce(F.octet_length(content), F.lit(0)).cast("long")
    head = F.substring(content, (before + 1).cast("int"), F.lit(containers.HEAD))
    tail = F.when(F.substring(head, F.lit(1), F.lit(4)) == F.lit(b"OggS"), F.substring(content, F.greatest(size - containers.TAIL + 1, F.lit(1)).cast("int"), F.lit(containers.TAIL)))
    movie = F.when(at.isNotNull(), F.substring(content, (at + 1).cast("int"), F.lit(containers.MOVIE)))
    return _probed(head, tail, movie, size, before, suffix)


def _files(spark: SparkSession, root: str, suffixes: tuple[str, ...]) -> DataFrame:
    """Files below a folder by suffix, case apart: others are listed, not read."""
    anycase = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes]
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(anycase) + "}").load(root)


def discover(spark: SparkSession, root: str, skip: str = ".talkloom") -> DataFrame:
    """Recordings below a folder, suffix case apart, without the workspace folder."""
    return _files(spark, root, C.AUDIO_SUFFIXES).where(~F.contains("path", F.lit(f"/{skip}/")))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Inventory rows of a folder: metadata, content hash and header fields of every recording.

    Colliding recordings are marked; the store leaves them out and counts them.
    """
    f = discover(spark, root)
    name = F.element_at(F.split("path", "/"), -1)
    base = root.rstrip("/")
    x = f.select(
        F.col("path").alias("absolute_path"),
        F.regexp_replace(F.substring_index("path", base + "/", -1), "^/", "").alias("relative_path"),
        name.alias("filename"),
        parse_filename(name).alias("n"),
        F.col("length").alias("size_bytes"),
        (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"),
        F.sha2("content", 256).alias("content_sha256"),
        probe(F.col("content"), F.lower(F.element_at(F.split("path", r"\."), -1))).alias("p"),
    )
    collides = F.count("*").over(Window.partitionBy(stem(F.col("absolute_path")))) > 1
    return x.select("absolute_path", "relative_path", "filename", "n.*", "size_bytes", "mtime_ns", "content_sha256", "p.*", collides.alias("collision"))


def scan_counters(scanned: DataFrame, known: DataFrame) -> DataFrame:
    """Six counters of a scan.  A colliding recording counts as discovered, as an error and as skipped, and isn't stored."""
    k = known.select(F.col("absolute_path").alias("_p"), F.col("content_sha256").alias("_h"))
    x = scanned.join(k, F.col("absolute_path") == F.col("_p"), "left")
    stored = ~F.col("collision")
    return x.agg(
        F.count("*").alias("discovered"),
        F.count_if(stored & F.col("_p").isNull()).alias("created"),
        F.count_if(stored & F.col("_p").isNotNull() & (F.col("_h") != F.col("content_sha256"))).alias("changed"),
        F.count_if(F.col("collision") | F.col("metadata_error").isNotNull()).alias("metadata_errors"),
        F.count_if(F.col("collision") | F.coalesce(F.col("duration_seconds") < C.SHORTEST_CALL, F.lit(False))).alias("skipped"),
        F.count_if("collision").alias("collisions"),
    )


def apply_scan(tables: revisions.Tables, scanned: DataFrame, documents: DataFrame, now: Column, max_attempts: int = 3) -> tuple[revisions.Tables, DataFrame]:
    """A scan in one: collisions left out, calls and jobs updated, documents beside recordings imported; and its six counters.

    scanned: rows of ``scan``; documents: (absolute_path, content) of ``sidecars``.  A colliding recording counts as
    discovered, as an error and as skipped, and isn't stored.  New calls and calls with other content count as changed.
    Documents of short calls, and of known calls whose recording changed, are not imported.  A repeated path is an error.
    """
    once = F.when(F.count("*").over(Window.partitionBy("absolute_path")) > 1, F.raise_error(F.concat(F.lit("scanned twice: "), F.col("absolute_path"))).cast("boolean")).otherwise(True)
    scanned = scanned.withColumn("_once", once).where("_once").drop("_once")
    known = tables["audio_files"].select("absolute_path", F.col("content_sha256").alias("_old"), F.lit(True).alias("_known"))
    scanned = kept(scanned)
    seen = scanned.join(known, "absolute_path", "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    seen = seen.withColumns({"_changed": ~F.col("collision") & ~(F.col("_known") & F.col("_old").eqNullSafe(F.col("content_sha256"))), "_short": store.is_short(F.col("duration_seconds"))})
    calls, jobs, transcripts = store.upsert_calls(tables["audio_files"], tables["jobs"], tables["transcripts"], scanned.where("NOT collision").drop("collision"), now, max_attempts)
    calls, jobs, transcripts = kept(calls), kept(jobs), kept(transcripts)  # each is read several times from here on
    stored = tables | {"audio_files": calls, "jobs": jobs, "transcripts": transcripts}
    beside = seen.where("NOT collision AND NOT _short AND NOT (_changed AND _known)").select("absolute_path").join(documents, "absolute_path").join(calls.select("absolute_path", F.col("id").alias("audio_file_id")), "absolute_path")
    out, imported = revisions.import_markdown(stored, beside.select("audio_file_id", "content"), now)
    counted = seen.agg(
        F.count("*").alias("discovered"),
        F.count_if("_changed").alias("changed"),
        F.count_if(F.col("collision") | F.col("metadata_error").isNotNull()).alias("metadata_errors"),
        F.count_if(F.col("collision") | F.col("_short")).alias("skipped"),
        F.count_if("collision").alias("collisions"),
    )
    return out, counted.join(F.broadcast(imported.withColumnRenamed("imported", "imported_markdown")))  # one row each


def sidecars(spark: SparkSession, root: str, scanned: DataFrame) -> DataFrame:
    """Non-blank Markdown beside recordings: (absolute_path, content)."""
    md = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    md = md.select(stem(F.col("path")).alias("_s"), F.make_valid_utf8(F.col("content").cast("string")).alias("content")).where(T.collapse("content") != "")
    return scanned.where("not collision").select("absolute_path", stem(F.col("absolute_path")).alias("_s")).join(md, "_s").select("absolute_path", "content")


def scan_into(spark: SparkSession, root: str, tables: revisions.Tables, now: Column, max_attempts: int = 3) -> tuple[revisions.Tables, DataFrame]:
    """Scans a folder into the tables; the counters in one row."""
    scanned = scan(spark, root)
    return apply_scan(tables, scanned, sidecars(spark, root, scanned), now, max_attempts)


def run_documents(spark: SparkSession, root: str) -> DataFrame:
    """JSON files of run folders as variants; invalid JSON is kept as {invalid_json, original}."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(root).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    bad = F.to_json(F.struct(F.lit(True).alias("invalid_json"), F.col("text").alias("original")))
    return raw.select("path", F.coalesce(F.try_parse_json("text"), F.parse_json(bad)).alias("document"), F.try_parse_json("text").isNull().alias("invalid"))


def snapshots(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Frozen references, each call once, of the wanted split; else an error."""
    df = spark.read.schema("schema_version int, split string, audio_id long, audio_sha256 string, duration_seconds double, reference struct<transcript_id:long,version:long,content:string>, baseline struct<transcript_id:long,version:long,content:string>").json(path)
    check = df.agg((F.count("*") == F.count_distinct("audio_id")).alias("u"), F.coalesce(F.every(F.col("schema_version") == 1), F.lit(True)).alias("v"), F.coalesce(F.every(F.col("split") == split), F.lit(True)).alias("s") if split else F.lit(True).alias("s")).first()
    if not (check["u"] and check["v"] and check["s"]):
        raise ValueError("snapshots must be of one schema and split, and of different calls")
    return df
