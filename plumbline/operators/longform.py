"""Long form of numeric columns, and exact ranks over it without one task per column.

``counts`` frames hold one row per (column, value): a hot value is one row, whatever
its share of the data. Running totals are taken inside value buckets and shifted by
the totals of the buckets before, so no task sees a whole column.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BUCKETS = 1024
EVERY = "*"  # edges under this name serve every column


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """Numeric columns by type; the others take no part in scoring."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def dropped_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    kept = set(numeric_columns(df, exclude)) | set(exclude)
    return [c for c in df.columns if c not in kept]


def scrub(c: Column) -> Column:
    """NaN to 0, infinities to plus or minus 1e10."""
    c = c.cast("double")
    return (
        F.when(F.isnan(c), F.lit(0.0))
        .when(c == F.lit(float("inf")), F.lit(1e10))
        .when(c == F.lit(float("-inf")), F.lit(-1e10))
        .otherwise(c)
    )


def to_long(df: DataFrame, cols: list[str], ids: list[str] | None = None, clean: bool = True, nulls: bool = False) -> DataFrame:
    """``(ids…, col, val)`` with one row per cell; nulls are dropped per column, not per row, unless kept."""
    ids = ids or []
    cell = scrub if clean else (lambda c: c.cast("double"))
    wide = df.select(*ids, *[cell(F.col(c)).alias(c) for c in cols])
    # a generator rather than an unpivot: plans over it compare equal, so their shuffles are reused
    cells = wide.select(*ids, F.inline(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("val")) for c in cols])))
    return cells if nulls else cells.filter(F.col("val").isNotNull())


def value_counts(long: DataFrame, **weights: Column) -> DataFrame:
    """One row per (col, val); each keyword names a counter and the rows it counts."""
    if not weights:
        return long.groupBy("col", "val").agg(F.count("*").alias("n"))
    return long.groupBy("col", "val").agg(*[F.sum(F.when(w, 1).otherwise(0).cast("bigint")).alias(name) for name, w in weights.items()])


def default_buckets(df: DataFrame) -> int:
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(2, min(MAX_BUCKETS, wanted))


EDGE_SHARE = 0.05


def bucket_edges(df: DataFrame, cols: list[str], buckets: int | None = None) -> dict[str, list[float]]:
    """Split points per column from a mergeable quantile sketch: one small row on the driver.

    Like the bounds of a range partitioning they come from a sample and only balance the work;
    every row is placed and every result is the same for any edges.
    """
    buckets = buckets or default_buckets(df)
    shares = [i / buckets for i in range(1, buckets)]
    some = df.select(*[scrub(F.col(c)).alias(f"v{i}") for i, c in enumerate(cols)]).sample(EDGE_SHARE, 7)
    row = some.agg(*[F.percentile_approx(f"v{i}", shares, max(100, 5 * buckets)).alias(f"e{i}") for i in range(len(cols))]).first()
    return {c: sorted(set(row[f"e{i}"] or [])) for i, c in enumerate(cols)}


def with_bucket(df: DataFrame, edges: dict[str, list[float]], out: str = "bucket") -> DataFrame:
    """Add the value bucket of each (col, val): first among every n-th edge, then among the n edges there."""
    step = {c: max(1, math.isqrt(len(e))) for c, e in edges.items()}
    table = {"edges": edges, "coarse": {c: e[step[c] - 1 :: step[c]] for c, e in edges.items()}, "step": step}
    # one constant of at most columns x MAX_BUCKETS numbers, folded before the tasks start
    held = F.from_json(F.lit(json.dumps(table)), "edges map<string,array<double>>, coarse map<string,array<double>>, step map<string,int>")
    key = F.lit(EVERY) if set(edges) == {EVERY} else F.col("col")
    of = lambda name: F.element_at(held[name], key)
    below = lambda arr: F.size(F.filter(arr, lambda x: x < F.col("val")))
    first = df.withColumn("_first", F.coalesce(below(of("coarse")) * of("step"), F.lit(0)))
    fine = below(F.slice(of("edges"), F.col("_first") + 1, of("step")))
    # never null, so that joins on it push no null test down to where rows are not yet counted
    return first.withColumn(out, F.coalesce(F.col("_first") + fine, F.lit(0))).drop("_first")


def running_counts(counts: DataFrame, names: list[str], edges: dict[str, list[float]]) -> DataFrame:
    """Add, per (col, val) in value order, ``cum_<name>`` (inclusive), ``tot_<name>`` and ``next_val``."""
    placed = with_bucket(counts, edges)
    before = Window.partitionBy("col").orderBy("bucket")
    whole = Window.partitionBy("col")
    totals = placed.groupBy("col", "bucket").agg(
        *[F.sum(n).alias(f"b_{n}") for n in names], F.min("val").alias("b_min")
    )
    # one row per column and bucket: at most columns x MAX_BUCKETS rows
    offsets = totals.select(
        "col",
        "bucket",
        F.lead("b_min").over(before).alias("next_min"),
        *[(F.sum(f"b_{n}").over(before) - F.col(f"b_{n}")).alias(f"off_{n}") for n in names],
        *[F.sum(f"b_{n}").over(whole).alias(f"tot_{n}") for n in names],
    )
    inside = Window.partitionBy("col", "bucket").orderBy("val")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = placed.select(
        "col",
        "bucket",
        "val",
        *names,
        F.lead("val").over(inside).alias("next_in"),
        *[F.sum(n).over(upto).alias(f"in_{n}") for n in names],
    ).join(F.broadcast(offsets), ["col", "bucket"])
    return ranked.select(
        "col",
        "val",
        *names,
        F.coalesce("next_in", "next_min").alias("next_val"),
        *[(F.col(f"in_{n}") + F.col(f"off_{n}")).alias(f"cum_{n}") for n in names],
        *[F.col(f"tot_{n}").alias(f"tot_{n}") for n in names],
    )


def quantiles(ranked: DataFrame, shares: dict[str, float], name: str = "n", *more: Column) -> DataFrame:
    """Linear-interpolated quantiles per column from running counts, one row per column; ``more`` aggregates ride along."""
    cum, n, tot = F.col(f"cum_{name}"), F.col(name), F.col(f"tot_{name}")
    out = []
    for alias, q in shares.items():
        h = F.lit(q) * (tot - 1)
        lo, hi = F.floor(h), F.ceil(h)
        at = lambda pos: F.max(F.when((cum - n <= pos) & (pos < cum), F.col("val")))
        part = F.max(h - lo)
        out.append((at(lo) + (at(hi) - at(lo)) * part).alias(alias))
    return ranked.groupBy("col").agg(*out, *more)
