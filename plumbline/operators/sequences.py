"""Ordered computations inside groups that do not need a whole group in one task.

Rows go to buckets by the order key (edges from one sketch, equal keys share a bucket). Each
bucket is scanned on its own; what earlier buckets of the group carry over comes from a
table with one row per group and bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.longform import bucket_edges, with_bucket


def place(df: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """Add ``_b``, the bucket of the numeric or timestamp ``key``."""
    kind = df.schema[key].dataType
    number = F.col(key).cast("double") if isinstance(kind, T.NumericType) else F.unix_micros(F.col(key).cast("timestamp")).cast("double")
    keyed = df.withColumn("_k", number)
    edges = bucket_edges(keyed, ["_k"], buckets)
    named = keyed.withColumnsRenamed({c: f"__{c}" for c in ("col", "val") if c in df.columns})
    out = with_bucket(named.withColumn("col", F.lit("_k")).withColumn("val", F.col("_k")), edges, "_b").drop("col", "val", "_k")
    return out.withColumnsRenamed({f"__{c}": c for c in ("col", "val") if c in df.columns})


def carry(
    df: DataFrame,
    by: list[str],
    order: list[str],
    lags: dict[str, str] | None = None,
    sums: dict[str, str] | None = None,
    mins: dict[str, str] | None = None,
    lasts: dict[str, str] | None = None,
    index: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Add running results per ``by`` group in ``order`` (the first order column makes the buckets).

    ``lags``/``sums``/``mins``/``lasts`` map an output name to a column: the value before, the inclusive
    running sum and minimum, and the latest non-null value up to and including the row.
    ``index`` names a 0-based position.
    """
    lags, sums, mins, lasts = lags or {}, dict(sums or {}), mins or {}, lasts or {}
    placed = place(df, order[0], buckets)
    if index:
        placed = placed.withColumn("_one", F.lit(1).cast("bigint"))
        sums["_index"] = "_one"
    inside = Window.partitionBy(*by, "_b").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local: dict[str, Column] = {}
    state: list[Column] = []
    last_in_order = F.struct(*order)
    for out, c in lags.items():
        local[f"in_{out}"] = F.lag(c).over(inside)
        state.append(F.max_by(c, last_in_order).alias(f"st_{out}"))
    for out, c in sums.items():
        local[f"in_{out}"] = F.sum(c).over(upto)
        state.append(F.sum(c).alias(f"st_{out}"))
    for out, c in mins.items():
        local[f"in_{out}"] = F.min(c).over(upto)
        state.append(F.min(c).alias(f"st_{out}"))
    for out, c in lasts.items():
        local[f"in_{out}"] = F.last(c, ignorenulls=True).over(upto)
        state.append(F.max_by(c, F.when(F.col(c).isNotNull(), last_in_order)).alias(f"st_{out}"))
    scanned = placed.select("*", *[v.alias(k) for k, v in local.items()], (F.row_number().over(inside) == 1).alias("_first"))

    per_bucket = placed.groupBy(*by, "_b").agg(*state)
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ahead = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = []
    for out in lags:
        carried.append(F.lag(f"st_{out}").over(group.orderBy("_b")).alias(f"ca_{out}"))
    for out in sums:
        carried.append(F.sum(f"st_{out}").over(ahead).alias(f"ca_{out}"))
    for out in mins:
        carried.append(F.min(f"st_{out}").over(ahead).alias(f"ca_{out}"))
    for out in lasts:
        carried.append(F.last(f"st_{out}", ignorenulls=True).over(ahead).alias(f"ca_{out}"))
    table = per_bucket.select(*by, "_b", *carried)

    joined = scanned.join(table, [*by, "_b"])
    results = []
    for out in lags:
        results.append(F.when(F.col("_first"), F.col(f"ca_{out}")).otherwise(F.col(f"in_{out}")).alias(out))
    for out in sums:
        total = F.coalesce(f"in_{out}", F.lit(0)) + F.coalesce(f"ca_{out}", F.lit(0))
        results.append((total - 1).alias(index) if out == "_index" else total.alias(out))
    for out in mins:
        results.append(F.least(f"in_{out}", f"ca_{out}").alias(out))
    for out in lasts:
        results.append(F.coalesce(f"in_{out}", f"ca_{out}").alias(out))
    return joined.select(*df.columns, *results)


def positions(df: DataFrame, by: list[str], order: list[str], out: str = "pos", buckets: int | None = None) -> DataFrame:
    """Dense 0-based position per group."""
    return carry(df, by, order, index=out, buckets=buckets)


def islands(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """Runs of consecutive whole-number keys as ``(by…, start, end, size)``."""
    spotted = positions(df.select(*by, key).distinct(), by, [key], "_pos").withColumn("_gap", F.col(key) - F.col("_pos"))
    return spotted.groupBy(*by, "_gap").agg(
        F.min(key).alias("start_index"), F.max(key).alias("end_index"), F.count("*").alias("size")
    ).drop("_gap")
