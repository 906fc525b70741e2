"""Connected components of an edge table, without collecting edges anywhere.

Alternating large-star and small-star steps (Kiveris et al., 2014): every step
is a partial ``min`` per node and a join that adaptive execution can split, so
a node with very many edges makes no large group.  Lineage is cut at each turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.llm._spark import cut


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return r["n"], r["h"] or 0


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b) longs.  Returns (node, root) for every node of an edge; root is the smallest node of its component."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = cut(e)
    state = _state(e)
    while state[0]:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = large.join(least, F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionAll(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct())
        now = _state(e)
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select("v", "v").distinct().toDF("node", "root"))


def forest_roots(parents: DataFrame) -> DataFrame:
    """parents: (node, parent), one row a node, parents smaller than their nodes.  Returns (node, root) by pointer jumping."""
    p = cut(parents)
    while True:
        up = p.select(F.col("node").alias("via"), F.col("parent").alias("over"))
        jumped = p.join(up, F.col("parent") == F.col("via"), "left")
        p = cut(jumped.select("node", F.coalesce("over", "parent").alias("parent"), F.col("over").isNotNull().alias("moved")))
        moved = p.where("moved").limit(1).count()
        p = p.select("node", "parent")
        if not moved:
            return p.select("node", F.col("parent").alias("root"))
