"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

A source's share of all words follows its weight, but no source gives more than
``max_epochs`` times its own size; what it can't give is shared again by weight
among the others.  With b = cap / weight sorted upwards, the sources below the
water level are at their cap and the others get level x weight, which is solved
with two prefix sums over the (few) sources.

A source's target is taken as complete epochs first.  The rest is selected by
exponential keys -ln(u) / quality, u a hash of the document: in the order of the
keys, documents are taken while the running sum of words stays within the rest,
and the document at the boundary gives the words that are missing.  The running
sum is not one sort per source: keys fall into ``BINS`` bins, sizes are summed
by bin before the shuffle, a prefix sum over bins finds the boundary bin, and
only that bin's documents are sorted.  A source with most of the rows is
therefore spread over all tasks.  The targets are broadcast where there are at
most ``BROADCAST_SOURCES`` sources, else joined by a shuffle.

Null and empty texts have size 0 and are taken 0 times; a null source comes
last in the order of sources.  Repeated rows with different ids differ in key;
fully equal rows are interchangeable.  A null id hashes like a constant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.llm._spark import cut

BINS = 4096
BROADCAST_SOURCES = 100_000
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def quality_weight(text: str) -> Column:
    """Letters per character, between 0.1 and 1, in steps of 0.01; 0.1 for empty texts."""
    letters = F.length(F.regexp_replace(F.col(text), r"[^\p{L}]+", ""))
    return F.coalesce(F.greatest(F.lit(0.1), F.floor(F.try_divide(100 * letters, F.length(text))) / 100.0), F.lit(0.1))


def uniform(id_col: str, seed: int) -> Column:
    """52 hash bits of the id as a number strictly between 0 and 1."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """sizes: (source, source_size), one row per source.  Adds weight and target."""
    everything = Window.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    x = ranked.select("source", "source_size", weight.alias("weight"), (F.lit(max_epochs) * F.col("source_size")).alias("cap"))
    up = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    x = x.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("capped"),
        F.sum("weight").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("free"),
    )
    # the level if every source before this one is at its cap; this one is below its cap there or at it
    x = x.withColumn("level", (F.col("total") - F.col("capped")) / F.col("free")).withColumn("under", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.max(F.when(F.col("under"), F.struct(-F.col("capped"), F.col("level")))).over(everything)
    return x.withColumn("water", level).select("source", "source_size", "weight", F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least(F.col("cap").cast("double"), F.col("water.level") * F.col("weight"))).cast("double").alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 17, quality: Column | None = None) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, taken (words)."""
    w = F.col("w")
    docs = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), (quality_weight(text_col) if quality is None else quality).alias("w"))
    keyed = docs.select("id", "source", "size", (-F.log(uniform("id", seed)) / w).alias("key"))
    keyed = cut(keyed.withColumn("bin", F.least(F.lit(BINS - 1), F.floor(BINS * (1 - F.exp(-F.col("key"))))).cast("int")))
    bins = cut(keyed.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")))
    goals = targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, max_epochs)
    goals = goals.select("*", F.least(F.lit(max_epochs), F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double")))).cast("long").alias("epochs"))
    goals = goals.withColumn("epochs", F.coalesce("epochs", F.lit(0))).withColumn("rest", F.greatest(F.lit(0), F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")))
    goals = cut(goals)
    g = goals.withColumnRenamed("source", "g_source")
    edges = bins.select(F.col("source").alias("b_source"), "bin", "bin_size", (F.sum("bin_size").over(Window.partitionBy("source").orderBy("bin")) - F.col("bin_size")).alias("before"))
    edges = edges.join(g, F.col("b_source").eqNullSafe(F.col("g_source")))
    edges = edges.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("bin_size") >= F.col("rest"))).select(F.col("b_source").alias("e_source"), F.col("bin").alias("e_bin"), "before")
    small = g.join(edges, F.col("g_source").eqNullSafe(F.col("e_source")), "left").select("g_source", "source_size", "target", "epochs", "rest", "e_bin", "before")
    small = F.broadcast(small) if goals.count() <= BROADCAST_SOURCES else small  # one row a source
    x = keyed.join(small, keyed["source"].eqNullSafe(F.col("g_source")))
    plain = F.when((F.col("rest") > 0) & (F.col("e_bin").isNull() | (F.col("bin") < F.col("e_bin"))), F.col("size")).otherwise(F.lit(0))
    cols = ["id", "source", "size", "source_size", "target"]
    inner = x.where(~F.coalesce(F.col("bin") == F.col("e_bin"), F.lit(False))).select(*cols, (F.col("epochs") * F.col("size") + plain).alias("taken"))
    order = Window.partitionBy("source").orderBy("key", F.col("id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = x.where(F.col("bin") == F.col("e_bin")).withColumn("done", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    edge = edge.select(*cols, (F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("done")))).alias("taken"))
    return inner.unionAll(edge).withColumnRenamed("id", id_col)


#: The same result with one window per source.
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    coalesce(greatest(0.1, floor(100 * length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) / nullif(length(text), 0)) / 100.0), 0.1) AS w,
    (CAST(CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight
  FROM d GROUP BY source),
c AS (
  SELECT *, 3 * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total,
    CAST(coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS capped,
    sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM s),
l AS (SELECT arg_min((total - capped) / free, capped) AS level FROM c WHERE (total - capped) / free * weight <= cap),
t AS (
  SELECT c.source, c.source_size, CASE WHEN level IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), level * weight) END AS target FROM c, l),
g AS (
  SELECT *, CAST(coalesce(least(3, floor(target / nullif(source_size, 0))), 0) AS BIGINT) AS epochs FROM t),
r AS (
  SELECT d.*, g.source_size, g.target, g.epochs, greatest(0, CAST(round(g.target - g.epochs * g.source_size) AS BIGINT)) AS rest,
    CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY -ln(u) / w, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS done
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - done)) AS BIGINT) AS taken FROM r
"""
