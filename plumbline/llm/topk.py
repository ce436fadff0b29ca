"""Exact top-k search by tiled matrix products.

Each task packs its vectors into shards, matrices of at most ``tile_rows`` rows. Query tiles and shards are dealt over
a grid whose cells hold a few of each, so a cell's work is bounded whatever the size of the table. A cell multiplies
tile by tile, keeps the k best of each product row (with ties to the smaller id) and merges them with what it had; the
remaining per-query lists are merged by rank, first in each task and then in each query.

Components are turned into floor(scale * x). Products are exact: in doubles while every sum stays below 2^53, else in
64-bit integers, else in Python's integers, limited to 64 bits.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows with a
null id; only vectors of the same length are compared; a query never meets rows of its own id; rows that repeat an id
are candidates each, and queries that repeat an id are answered together; with fewer than k candidates all are
returned; an empty table gives an empty table. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import table
from plumbline.registry import query

TILES_PER_CELL = 8


def whole_vectors(vectors: DataFrame, vec_id: str, vector: str, scale: float) -> DataFrame:
    """Rows (vec_id, v) with integer components, without those that take no part."""
    wide = F.col(vector).cast("array<double>")
    usable = F.col(vec_id).isNotNull() & (F.size(wide) > 0) & ~F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.coalesce(usable, F.lit(False))).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.transform(wide, lambda x: F.floor(x * scale)).alias("v"))


def packed(rows: DataFrame, tile_rows: int) -> DataFrame:
    """Rows (dim, kind, ids, data): matrices in the smallest integer kind that holds them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            lists = batch.column("v")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            at = np.r_[0, np.cumsum(sizes)]
            out = []
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                for part in np.array_split(own, max(1, math.ceil(len(own) / tile_rows))):
                    data = flat[at[part][:, None] + np.arange(dim)]
                    top = max(int(data.max()), -int(data.min()))
                    kind = "int16" if top < 2**15 else "int32" if top < 2**31 else "int64"
                    out.append((int(dim), kind, ids[part].tobytes(), data.astype(kind).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.string(), pa.binary(), pa.binary()), strict=True)] if out else
                [pa.array([], t) for t in (pa.int32(), pa.string(), pa.binary(), pa.binary())], ["dim", "kind", "ids", "data"])

    return rows.mapInArrow(pack, "dim int, kind string, ids binary, data binary")


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exactly."""
    most = a.shape[1] * max(abs(int(a.max())), abs(int(a.min()))) * max(abs(int(b.max())), abs(int(b.min())))
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return np.clip(a.astype(object) @ b.astype(object).T, -(2**63), 2**63 - 1).astype(np.int64)


def select(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best entries of each row: higher scores first, then smaller ids."""
    order = np.lexsort((ids, ~scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.array([], int)
    rank = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
    return rows[rank < k], ids[rank < k], scores[rank < k]


def tile_best(query_ids: np.ndarray, shard_ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Partial selection in one tile: (query row, vec id, score), without a query's own rows."""
    other = query_ids[:, None] != shard_ids[None, :]
    if scores.shape[1] > k:
        # up to all of its own id may be ahead, so the bound is taken over the others
        ranked = np.where(other, scores, np.iinfo(np.int64).min)
        other &= scores >= np.partition(ranked, scores.shape[1] - k, axis=1)[:, [scores.shape[1] - k]]
    rows, cols = np.nonzero(other)
    return select(rows, shard_ids[cols], scores[rows, cols], k)


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: float = 256.0, vec_id: str = "vec_id", vector: str = "embedding", tile_rows: int = 1024) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k best rows for each row where ``queries`` holds.

    ``queries`` is a condition on the column ``vec_id``. ``tile_rows`` only sizes the tiles.
    """
    rows = whole_vectors(vectors, vec_id, vector, scale)
    asked = rows.where(queries)
    cells = [max(1, math.ceil(n / (tile_rows * TILES_PER_CELL))) for n in (rows.count(), asked.count())]
    cells[0] = max(cells[0], rows.sparkSession.sparkContext.defaultParallelism)
    place = F.xxhash64("ids", "data")
    shards = packed(rows, tile_rows).withColumn("i", F.pmod(place, F.lit(cells[0])))
    shards = shards.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells[1] - 1).cast("long"))))
    tiles = packed(asked.repartition(cells[1]), tile_rows).withColumn("j", F.pmod(place, F.lit(cells[1])))
    tiles = tiles.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells[0] - 1).cast("long"))))
    grid = shards.join(tiles.select("i", "j", "dim", F.col("kind").alias("q_kind"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data")), ["i", "j", "dim"])
    grid = grid.select("i", "j", "dim", "kind", "ids", "data", "q_kind", "q_ids", "q_data")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, list] = defaultdict(list)

        def merged(parts: list, ids: np.ndarray) -> tuple:
            return select(*(np.concatenate(c) for c in zip(*parts, strict=True)), k)

        def batch_of(held: dict) -> pa.RecordBatch:
            found = [(np.frombuffer(q, np.int64)[r], i, s) for (q, _), parts in held.items() for r, i, s in [merged(parts, q)]]
            cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.array([], np.int64)] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

        for batch in batches:
            for r in batch.to_pylist():
                ids, q_ids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["q_ids"], np.int64)
                data = np.frombuffer(r["data"], r["kind"]).reshape(len(ids), r["dim"])
                q_data = np.frombuffer(r["q_data"], r["q_kind"]).reshape(len(q_ids), r["dim"])
                parts = best[(r["q_ids"], r["q_data"])]
                parts.append(tile_best(q_ids, ids, product(q_data, data), k))
                if len(parts) == 8:
                    parts[:] = [merged(parts, q_ids)]
            if len(best) > 4 * TILES_PER_CELL:
                yield batch_of(best)
                best.clear()
        yield batch_of(best)

    found = grid.mapInArrow(multiply, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op4_exact_topk", SQL)
def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(50)) == 0)
