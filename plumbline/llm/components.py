"""Connected components by alternating large-star and small-star, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import removed, spread_join, written


def with_least(edges: DataFrame, key: str) -> DataFrame:
    """The edges with ``least``, the smallest of ``key`` and its neighbours."""
    other = "b" if key == "a" else "a"
    least = edges.groupBy(key).agg(F.least(F.min(other), F.col(key)).alias("least"))
    return spread_join(edges, least, [key])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (id, component) of all nodes that have an edge to another node; ``component`` is the smallest node reached.

    A hub may hold a third of all edges: its minimum is taken per task first, and the join that hands it back can be
    split. Every round is a written table, so a lost executor costs no earlier round; the
    round before it is removed then. Null ends are left out.
    """
    ends = [F.col(a), F.col(b)]
    edges = edges.where(F.col(a) != F.col(b)).select(F.greatest(*ends).alias("a"), F.least(*ends).alias("b")).distinct()
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        last, edges = edges, with_least(both, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        small = with_least(edges, "a")
        edges = small.select("a", F.col("least").alias("b")).unionByName(small.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")))
        edges = written(edges.distinct(), "stars")
        if before is not None:
            removed(last)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        before = state
