"""Centroid clustering by a progressive search over Walsh-Hadamard coefficients.

Vectors of integers and centroids go through the Walsh-Hadamard transform, which is exact on integers and keeps squared
distances up to the factor ``dim``. Its coefficients are taken coarse to fine, by number of sign changes, in blocks that
double. After each block a centroid's partial sum of squared differences bounds its distance from below, and the energy
that both sides have left bounds it from above, since (a - b)^2 <= 2 a^2 + 2 b^2. A centroid whose lower bound exceeds the least
upper bound is strictly worse and leaves; ties never leave. What is left is finished over all coefficients.

Every round is one job: tasks assign their vectors and send one partial sum for each cluster and component; the driver
holds k x dim sums, whatever the size of the table. Floors of the exact means are the next centroids.

Integers are exact: in 64 bits while no sum can exceed them (components below 2^24 at 64 of them), else as Python's integers.

Defined cases: vectors that are null, not of length ``dim``, or hold null, non-finite or components whose integer needs more
than 64 bits take no part, nor do rows with a null id; rows that repeat an id count each, and start in the order of
their components; with fewer than k vectors there are fewer centroids; an empty table gives an empty table; a distance
or inertia beyond 64 bits is null. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import table
from plumbline.registry import query


def small(dim: int) -> int:
    """Components below this bound keep all sums, up to dim^2 * (2 * bound)^2, within 64 bits."""
    return 1 << (61 - 2 * (dim.bit_length() - 1)) // 2


def walsh(dim: int) -> np.ndarray:
    """The Hadamard matrix, rows ordered by their number of sign changes."""
    if dim < 1 or dim & dim - 1:
        raise ValueError("the dimension must be a power of two")
    matrix = np.ones((1, 1), np.int64)
    while len(matrix) < dim:
        matrix = np.block([[matrix, matrix], [matrix, -matrix]])
    return matrix[np.argsort((np.diff(matrix, axis=1) != 0).sum(1), kind="stable")]


def transformed(vectors: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Coefficients of integer rows, exactly: sums of 64-bit integers within the bound, else of Python's integers."""
    if vectors.dtype == object:
        return vectors.dot(matrix.T.astype(object))
    # products of doubles, all sums of which are integers far below 2^53
    return (vectors.astype(np.float64) @ matrix.T.astype(np.float64)).astype(np.int64)


def _tails(coefficients: np.ndarray, edges: list[int]) -> np.ndarray:
    """Energy of each row from each edge on."""
    squares = coefficients * coefficients
    return np.stack([squares[:, e:].sum(1) for e in edges], 1)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For integer rows their nearest centroid, ties to the smaller number, and the squared distance."""
    n, dim = vectors.shape
    large = max((int(abs(a).max()) for a in (vectors, centroids) if a.size), default=0) >= small(dim)
    kind = object if large else np.int64
    matrix = walsh(dim)
    x, c = (transformed(a.astype(kind), matrix) for a in (vectors, centroids))
    edges = [0, *(1 << b for b in range(dim.bit_length()))]
    rest_x, rest_c = _tails(x, edges), _tails(c, edges)
    partial = np.zeros((n, len(c)), kind)
    alive = np.ones((n, len(c)), bool)
    for level, (start, end) in enumerate(zip(edges, edges[1:], strict=False), 1):
        for j in range(len(c)):
            rows = np.flatnonzero(alive[:, j])
            difference = x[rows, start:end] - c[j, start:end]
            partial[rows, j] += (difference * difference).sum(1)
        upper = partial + 2 * (rest_x[:, level, None] + rest_c[None, :, level])
        # a centroid that left cannot hold the least upper bound: that of the one which beat it only falls
        bound = np.where(alive, upper, upper.max(initial=0) + 1).min(1)
        alive &= partial <= bound[:, None]
    best = np.where(alive, partial, partial.max(initial=0) + 1).argmin(1)
    return best, partial[np.arange(n), best] // dim


def _rows(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def integer_vectors(vectors: DataFrame, scale: int = 1024, dim: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(scale * component) of the usable rows."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).where("vec_id IS NOT NULL")
    rows = rows.where(F.size("v") == dim)
    scaled = F.transform("v", lambda x: x * F.lit(float(scale)))
    rows = rows.select("vec_id", scaled.alias("v"))
    # null, NaN and infinite components fail the comparison as well
    fits = F.forall("v", lambda x: F.coalesce((x >= F.lit(-(2.0**63))) & (x < F.lit(2.0**63)), F.lit(False)))
    return rows.where(fits).select("vec_id", F.transform("v", lambda x: F.floor(x).cast("long")).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest sha256 of ``seed:vec_id``, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r["v"] for r in vectors.select(key.alias("h"), "v").orderBy("h", "v").limit(k).collect()]


def next_centroids(vectors: DataFrame, centroids: list[list[int]], dim: int) -> list[list[int]]:
    """Floors of the exact means of the vectors nearest to each centroid; a centroid without vectors stays."""
    fixed = np.array(centroids, dtype=np.int64)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(fixed), dim + 1), object)
        for batch in batches:
            v = _rows(batch, dim)
            if not len(v):
                continue
            best, _ = nearest(v, fixed)
            exact = v if abs(v).max() < small(dim) else v.astype(object)
            for j in range(len(fixed)):
                mine = exact[best == j]
                total[j] += np.r_[mine.sum(0), len(mine)] if len(mine) else 0
        j, c = np.nonzero(np.repeat(total[:, -1:] != 0, dim + 1, 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(j, pa.int32()), pa.array(c, pa.int32()), pa.array([Decimal(int(t)) for t in total[j, c]], pa.decimal128(38, 0))], ["cluster", "component", "part"])

    parts = vectors.select("v").mapInArrow(sums, "cluster int, component int, part decimal(38,0)").groupBy("cluster", "component").agg(F.sum("part").alias("part"))
    total: dict[int, dict[int, int]] = {}
    for r in parts.collect():
        total.setdefault(r["cluster"], {})[r["component"]] = int(r["part"])
    return [[total[j][c] // total[j][dim] for c in range(dim)] if j in total else list(old) for j, old in enumerate(centroids)]


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, scale: int = 1024, dim: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Rows (vec_id, cluster, distance, centroid array<long>) after ``rounds`` rounds, one for each usable row."""
    v = integer_vectors(vectors, scale, dim, vec_id, embedding)
    centroids = first_centroids(v, k, seed)
    for _ in range(rounds if centroids else 0):
        centroids = next_centroids(v, centroids, dim)
    fixed = np.array(centroids, dtype=np.int64).reshape(-1, dim)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(fixed):
                best, distance = nearest(_rows(batch, dim), fixed)
                distance = pa.array([int(d) if d < 1 << 63 else None for d in distance], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best, pa.int32()), distance], ["vec_id", "cluster", "distance"])

    id_type = v.schema["vec_id"].dataType.simpleString()
    found = v.mapInArrow(assign, f"vec_id {id_type}, cluster int, distance long")
    shapes = F.create_map(*[F.lit(x) for j, c in enumerate(centroids) for x in (j, c)]) if centroids else F.lit(None).cast("map<int,array<bigint>>")
    return found.withColumn("centroid", shapes[F.col("cluster")].cast("array<bigint>"))


def with_inertia(assigned: DataFrame) -> DataFrame:
    """The rows with ``cluster_inertia`` and ``inertia``, the distances summed over the cluster and over all."""
    total = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)"))).alias("total")
    # one row for each cluster and one for all
    totals = {r["cluster"]: r["total"] for r in assigned.rollup("cluster").agg(total).collect()}
    fits = {j: int(t) if t is not None and t < 1 << 63 else None for j, t in totals.items()}
    own = F.lit(None).cast("long")
    for j, t in fits.items():
        if j is not None:
            own = F.when(F.col("cluster") == j, F.lit(t).cast("long")).otherwise(own)
    return assigned.select("*", own.alias("cluster_inertia"), F.lit(fits.get(None)).cast("long").alias("inertia"))


SQL = """
WITH RECURSIVE kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
components AS (SELECT vec_id, v, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM kept),
steps AS (
  SELECT 0 AS round, list(v ORDER BY h, v) AS cs FROM (SELECT v, sha256('3:' || vec_id) AS h FROM kept ORDER BY h, v LIMIT 8)
  UNION ALL
  SELECT round + 1, list(c ORDER BY j) FROM (
    SELECT round, j, list(m ORDER BY d) AS c FROM (
      SELECT e.round, e.j, e.d, coalesce(((s.total - ((s.total % s.n) + s.n) % s.n) // s.n), e.x) AS m
      FROM (SELECT round, j, generate_subscripts(cs[j], 1) AS d, unnest(cs[j]) AS x FROM (SELECT round, cs, unnest(range(1, len(cs) + 1)) AS j FROM steps WHERE round < 10)) e
      LEFT JOIN (
        SELECT near AS j, d, CAST(sum(x) AS BIGINT) AS total, count(*) AS n FROM (
          SELECT list_position(ds, list_min(ds)) AS near, d, x FROM (
            SELECT p.d, p.x, list_transform(t.cs, lambda c: list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, c) + list_inner_product(c, c)) AS ds
            FROM components p, (SELECT cs FROM steps WHERE round < 10) t)) GROUP BY near, d) s ON e.j = s.j AND e.d = s.d)
    GROUP BY round, j) GROUP BY round),
placed AS (
  SELECT vec_id, cs, list_position(ds, list_min(ds)) AS j, CAST(list_min(ds) AS BIGINT) AS distance FROM (
    SELECT vec_id, cs, list_transform(cs, lambda c: list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c)) AS ds
    FROM kept, (SELECT cs FROM steps WHERE round = 10)))
SELECT vec_id, CAST(j - 1 AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(cs[j], ',')) AS centroid_sha256
FROM placed
"""


@query("op12_centroid_clusters", SQL)
def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_inertia(cluster(table(spark, sf_dir, "embeddings")))
    text = F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(text, 256).alias("centroid_sha256"))
