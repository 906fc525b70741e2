"""Centroid clustering of integer vectors: float32 screening with rigorous rounding-error intervals.

Components become integers floor(scale * x).  Each round assigns every vector
to its nearest centroid (squared Euclidean distance, ties to the smaller
number) and replaces every centroid that has vectors by the floor of their
mean; all sums are exact.

``nearest`` multiplies a block of vectors with all centroids in float32.  A
product of n terms, in any order of summation, is off by at most
gamma(n + 2) * |x| * |c|, the two rounding steps of the operands included
(Higham, 2002), so every distance has an interval.  Centroids whose interval
overlaps the lowest one are computed again in exact integers; a lone one is
certain.  The reported distance is always the exact integer.

A round is one pass over the table: tasks send the sums of their vectors, k
rows each, which are added in two steps (by a salt, then by centroid) so that
many tasks don't meet in k.  The driver holds k centroids.  The table is read
rounds + 2 times and never shuffled; the last pass is kept as (id, cluster,
distance).  A vector that a third of the rows share is only counted often.

Vectors with another number of components, null or not finite ones, and null
vectors are left out.  Repeated rows and ids count as often as they occur; the
first centroids are the vectors with the smallest hash of ``seed:id`` (a null
id hashes as an empty text), of equal hashes the smaller vector.  With fewer
than k vectors there are fewer centroids; without vectors the result is empty.
A component whose integer is so large that squared distances pass a long
(2**27.5 for 64 components) raises an error.  Other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.llm._spark import cut

_BLOCK = 2048
_UNIT = 2.0**-24
_SALTS = 64


def usable(column: Column, dim: int) -> Column:
    """Is it a vector of ``dim`` components, all of them finite numbers?"""
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(column) == dim) & F.forall(column, lambda x: sound(x.cast("double"))), F.lit(False))


def largest(dim: int) -> int:
    """The largest component whose squared distances fit in 64 bits."""
    return math.isqrt((2**63 - 1) // dim) // 2


def integers(vectors: pa.ListArray, dim: int, scale: float) -> np.ndarray:
    """(rows, dim) exact integers floor(scale * x) of vectors that are ``usable``."""
    x = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, dim)
    if x.size and np.abs(x).max() > largest(dim):
        raise ValueError("a component is too large for exact distances")
    return x.astype(np.int64)


def intervals(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of |c|^2 - 2 x.c, which orders the centroids c as the distances from each row of x do."""
    n = x.shape[1] + 2
    gamma = n * _UNIT / (1 - n * _UNIT)
    product = (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    length = lambda v: np.sqrt((v.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
    square = (c * c).sum(axis=1).astype(np.float64)
    mid = square - 2 * product
    half = 2 * gamma * np.outer(length(x), length(c)) + 2.0**-48 * (square + 2 * np.abs(product))
    return mid - half, mid + half


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and exact squared distance of every row of x."""
    cluster = np.zeros(len(x), dtype=np.int32)
    distance = np.zeros(len(x), dtype=np.int64)
    for at in range(0, len(x), _BLOCK):
        block = x[at : at + _BLOCK]
        low, high = intervals(block, c)
        near = low <= high.min(axis=1, keepdims=True)
        best = near.argmax(axis=1)
        unsure = near.sum(axis=1) > 1
        if unsure.any():
            of, number = np.nonzero(near & unsure[:, None])
            exact = ((block[of] - c[number]) ** 2).sum(axis=1)
            order = np.lexsort((number, exact, of))
            rows, first = np.unique(of[order], return_index=True)
            best[rows] = number[order][first]
        cluster[at : at + _BLOCK] = best
        distance[at : at + _BLOCK] = ((block - c[best]) ** 2).sum(axis=1)
    return cluster, distance


def _first(vectors: DataFrame, k: int, scale: float, seed: int) -> np.ndarray:
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(name.alias("name"), F.col("v").cast("array<double>").alias("v")).orderBy("name", "v").limit(k).collect()
    return np.array([[math.floor(scale * x) for x in r["v"]] for r in rows], dtype=np.int64)


def _sums(vectors: DataFrame, centroids: np.ndarray, scale: float) -> dict[int, tuple[int, list[int]]]:
    """Count and exact componentwise sum of the vectors nearest to each centroid that has any."""
    k, dim = centroids.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, dtype=np.int64), np.zeros((k, dim), dtype=np.int64)
        for batch in batches:
            x = integers(batch.column("v"), dim, scale)
            cluster, _ = nearest(x, centroids)
            for j in np.unique(cluster).tolist():
                mine = x[cluster == j]
                n[j] += len(mine)
                total[j] += mine.sum(axis=0)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(n[held]), pa.array(total[held].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = vectors.select("v").mapInArrow(partial, "cluster int, n long, total array<long>")
    each = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"t{i}") for i in range(dim)]
    salted = parts.groupBy("cluster", F.pmod(F.spark_partition_id(), F.lit(_SALTS)).alias("salt")).agg(F.sum("n").alias("n"), *each)
    rows = salted.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(f"t{i}").alias(f"t{i}") for i in range(dim))).collect()
    return {r["cluster"]: (r["n"], [int(r[f"t{i}"]) for i in range(dim)]) for r in rows}


def fit(vectors: DataFrame, k: int = 16, dim: int = 64, scale: float = 64, rounds: int = 3, seed: int = 1) -> np.ndarray:
    """vectors: (id, v), all of them ``usable``.  The centroids after ``rounds`` rounds, in the order of their numbers."""
    centroids = _first(vectors, k, scale, seed)
    for _ in range(rounds if len(centroids) else 0):
        for number, (n, total) in _sums(vectors, centroids, scale).items():
            centroids[number] = [t // n for t in total]
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray, scale: float = 64) -> DataFrame:
    """(id, cluster, distance) of every vector of (id, v)."""
    kind = vectors.schema["id"].dataType.simpleString()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = nearest(integers(batch.column("v"), centroids.shape[1], scale), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cluster), pa.array(distance)], names=["id", "cluster", "distance"])

    return vectors.mapInArrow(label, f"id {kind}, cluster int, distance long")


def cluster(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 16, dim: int = 64, scale: float = 64, rounds: int = 3, seed: int = 1) -> DataFrame:
    """One row per usable vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = df.sparkSession
    vectors = df.where(usable(F.col(vec_col), dim)).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    centroids = fit(vectors, k, dim, scale, rounds, seed)
    if not len(centroids):
        centroids = np.zeros((1, dim), dtype=np.int64)
    labelled = cut(assign(vectors, centroids, scale))
    sums = {r["cluster"]: int(r["s"]) for r in labelled.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    name = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    facts = spark.createDataFrame([(j, s, sum(sums.values()), name(centroids[j])) for j, s in sums.items()], "of int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = labelled.join(F.broadcast(facts), F.col("cluster") == F.col("of"))  # at most k rows
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(table: str = "embeddings", k: int = 16, rounds: int = 3) -> str:
    """DuckDB SQL of ``cluster`` over a table with vec_id and embedding."""
    steps = [
        f"""v AS (
  SELECT row_number() OVER () AS row, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM {table}
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64)""",
        f"""c0 AS (
  SELECT row_number() OVER (ORDER BY name, q) - 1 AS n, q FROM (
    SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS name, q FROM v) ORDER BY name, q LIMIT {k})""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (
  SELECT row, vec_id, v.q, min(row(list_sum([CAST((p - c.q[i]) * (p - c.q[i]) AS BIGINT) FOR p, i IN v.q]), n)) AS best FROM v, c{r} c GROUP BY 1, 2, 3)""")
        if r < rounds:
            steps.append(f"""m{r} AS (
  SELECT n, list(mean ORDER BY i) AS q FROM (
    SELECT n, i, (s - ((s % cnt) + cnt) % cnt) // cnt AS mean FROM (
      SELECT best[2] AS n, i, CAST(sum(q[i]) AS BIGINT) AS s, count(*) AS cnt FROM a{r}, range(1, 65) t(i) GROUP BY 1, 2)) GROUP BY 1),
c{r + 1} AS (
  SELECT c.n, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN m{r} m ON c.n = m.n)""")
    return f"""
WITH {", ".join(steps)}
SELECT vec_id, CAST(best[2] AS INTEGER) AS cluster, CAST(best[1] AS BIGINT) AS distance,
  CAST(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia, CAST(sum(best[1]) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string([CAST(x AS VARCHAR) FOR x IN c.q], ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.n = best[2]
"""
