"""Content-addressed WARC archive.

``archive`` writes two Parquet tables: ``payloads`` has each distinct payload
once under its SHA-256, ``records`` has the exact header block of every WARC 1.1
record with that digest.  ``restore`` joins them, checks every payload against
its SHA-256 and the record's SHA-1, and yields the records byte for byte.

A record is a ``response`` whose block is an HTTP header and the payload, or a
``revisit`` whose block is the HTTP header alone.  Records with equal payloads
of at least ``min_bytes`` are one response, that with the largest id, and
revisits that refer to it.  Payloads below ``min_bytes`` are always responses.

Payloads are grouped by digest with a partial aggregate, so a payload shared by
a third of all records makes no large group, and are moved once: the table is
bucketed by digest as it comes out of that exchange, and the join that rebuilds
the records moves headers only.

A null payload is empty.  Repeated rows (same id, same payload) are records of
their own with equal fields but the record id, so each of them is a response
where that id is the largest; a revisit refers to the last of them.  A null id
sorts below all others and is written as an empty id; an id that is no whole
number raises an error.  The URL may be null or hold line breaks (they become
spaces).  An empty table gives an empty archive.  Other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.llm._spark import cut, packed_id

CRLF = "\r\n"
_PREFIX = "urn:talkloom:page:"
#: Fixed value: the profile of revisits of equal payloads.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def _record_id(key: Column, row: Column) -> Column:
    return F.concat(F.lit(f"<{_PREFIX}"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), row.cast("string"), F.lit(">"))


def _header(revisit: Column, date: str) -> Column:
    """The header block of a record, up to and with the empty line, and the HTTP header that starts its block."""
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), F.col("n").cast("string"), F.lit(CRLF * 2))
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("n"))
    refers = F.concat(_field("WARC-Profile", F.lit(_PROFILE)), _field("WARC-Refers-To", _record_id(F.col("top.id"), F.col("top.row"))))
    text = F.concat(
        F.lit("WARC/1.1" + CRLF),
        _field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _field("WARC-Record-ID", _record_id(F.col("id"), F.col("row"))),
        _field("WARC-Date", F.lit(date)),
        F.when(F.col("url").isNotNull(), _field("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " "))).otherwise(F.lit("")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, refers).otherwise(F.lit("")),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", length.cast("string")),
        F.lit(CRLF),
        http,
    )
    return F.encode(text, "utf-8")


def _bucketed(spark: SparkSession, path: str, buckets: int) -> str:
    """The payload table of an archive under a name of this session, with its bucketing."""
    name = f"talkloom_warc_{hashlib.md5(path.encode()).hexdigest()}"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (sha256 STRING, payload BINARY) USING parquet OPTIONS (path '{path}/payloads', compression 'zstd') CLUSTERED BY (sha256) INTO {buckets} BUCKETS")
    return name


def archive(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 1000, date: datetime | None = None) -> None:
    """Writes the archive of df under ``path``, a new folder that all executors share; ``date`` (now by default) is that of all its records."""
    spark = df.sparkSession
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "utf-8")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("sha256"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n"))
    heads = cut(rows.drop("payload").withColumn("row", F.monotonically_increasing_id()))
    copied = heads.where(F.col("n") >= min_bytes).groupBy("sha256").agg(F.max(F.struct(packed_id("id").alias("key"), "id", "row")).alias("top"), F.count("*").alias("copies")).where("copies > 1")
    joined = heads.join(copied.drop("copies"), "sha256", "left")
    revisit = F.col("top").isNotNull() & ~F.col("id").eqNullSafe(F.col("top.id"))
    stamp = (date or datetime.now(UTC)).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    joined.select("sha256", _header(revisit, stamp).alias("header")).write.parquet(f"{path}/records")
    # as many buckets as the exchange has partitions: each of its tasks writes whole buckets
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.groupBy("sha256").agg(F.first("payload").alias("payload")).write.insertInto(_bucketed(spark, path, buckets))
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{path}/layout")


def restore(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive: header, payload (full, for revisits too), sha1 of the payload, record (exact WARC bytes).

    A payload that doesn't have its digests, or a record without its payload, raises an error.
    """
    buckets = spark.read.parquet(f"{path}/layout").first()["buckets"]
    records, payloads = spark.read.parquet(f"{path}/records"), spark.table(_bucketed(spark, path, buckets))
    sound = F.sha2("payload", 256) == F.col("sha256")
    held = payloads.select("sha256", "payload", F.when(sound, F.sha1("payload")).alias("sha1"))
    r = records.join(held, "sha256", "left")
    bad = F.col("sha1").isNull() | (F.concat(F.lit("sha1:"), F.col("sha1")) != field("WARC-Payload-Digest"))
    r = r.withColumn("sha1", F.when(bad, F.raise_error(F.concat(F.lit("no payload that matches digest "), F.col("sha256"))).cast("string")).otherwise(F.col("sha1")))
    block = F.when(field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return r.select("header", "payload", "sha1", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"))


def field(name: str, header: str = "header") -> Column:
    """A field of a record's WARC header, null where it is missing."""
    found = F.regexp_extract(F.split_part(F.col(header).cast("string"), F.lit(CRLF * 2), F.lit(1)), rf"\r\n{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def index(spark: SparkSession, path: str) -> DataFrame:
    """What the rebuilt records of an archive say; a record whose block has not the length it names raises an error."""
    r = restore(spark, path).withColumn("head", F.split_part(F.col("header").cast("string"), F.lit(CRLF * 2), F.lit(1)))
    r = r.withColumn("block", F.octet_length("record") - F.octet_length("head") - 8)
    number = lambda name: F.regexp_extract(field(name), r":(-?\d+):\d+>$", 1).try_cast("long")
    whole = F.when(F.col("block") == field("Content-Length").cast("long"), F.octet_length("payload").cast("long"))
    return r.select(
        number("WARC-Record-ID").alias("page_id"),
        F.coalesce(whole, F.raise_error(F.lit("a record is cut short")).cast("long")).alias("payload_bytes"),
        F.col("sha1").alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"),
    )


def shared_path(spark: SparkSession) -> str:
    """A new folder beside the checkpoints."""
    cut(spark.range(0))
    return f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"
