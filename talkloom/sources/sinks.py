"""Writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, StructType

from talkloom.functions.text import finite


def finite_column(c: Column, kind: DataType) -> Column:
    """A column with null instead of NaN and infinities at any depth."""
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(finite(c), c)
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*(finite_column(c[f.name], f.dataType).alias(f.name) for f in kind)))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: finite_column(x, kind.elementType))
    return c


def finite_rows(df: DataFrame) -> DataFrame:
    return df.select(*(finite_column(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Strict JSON lines: no NaN, no infinities."""
    finite_rows(df).write.mode(mode).json(path)


def freeze(df: DataFrame, path: str) -> None:
    """Immutable reference snapshots; an existing folder is an error."""
    write_json(df, path)


def publish_snapshot(tables: dict[str, DataFrame], path: str, version: int) -> str:
    """Writes a new version of the tables beside the old ones; readers move to it when its folder is complete."""
    where = f"{path}/v{version:08d}"
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{where}/{name}")
    return where


def publishable(published: DataFrame, base: DataFrame, on_disk: DataFrame, key: str = "audio_file_id") -> DataFrame:
    """Documents whose file is still the current or the base version: (key, content); others were edited outside.

    published: (key, content); base: (key, content_hash) allowed; on_disk: (key, content_hash).
    """
    allowed = base.select(key, "content_hash").distinct()
    edited = on_disk.join(allowed, [key, "content_hash"], "left_anti").select(key).distinct()
    return published.join(edited, key, "left_anti")


def byte_range(content: Column, first: int, last: int | None = None) -> Column:
    """Bytes first..last (inclusive) of a binary column."""
    return F.substring(content, first + 1, (last - first + 1) if last is not None else 2**31 - 1)


def word_review_table(words: DataFrame, keys: list[str]) -> DataFrame:
    """A Markdown table of aligned words per key, cells escaped.  words: (keys, segment_id, text, start, end, score, accepted)."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("—")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", esc(F.col("segment_id")), esc(F.col("text")), esc(F.round("start", 2)), esc(F.round("end", 2)), esc(F.round("score", 3)), F.when(F.col("accepted"), "yes").otherwise("no")), F.lit(" |"))
    rows = words.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "segment_id", line.alias("l")))), lambda x: x["l"]).alias("l"))
    head = "| segment | word | start | end | score | accepted |\n| --- | --- | --- | --- | --- | --- |\n"
    return rows.select(*keys, F.concat(F.lit(head), F.array_join("l", "\n")).alias("content"))
