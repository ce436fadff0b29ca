"""Stratified samples, strata choice and adaptive bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.column_stats import profile
from plumbline.operators.longform import bucket_edges, numeric_columns, quantiles, running_counts, to_long, value_counts
from plumbline.operators.sequences import positions


def strata_candidates(df: DataFrame) -> DataFrame:
    """Columns fit for strata by their number of values: text 2 to 100, numbers up to 50; nearest to ten first."""
    numeric = set(numeric_columns(df))
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    p = profile(df.select(*[c for c in df.columns if c in numeric or c in text])).select("col", "unique_count")
    is_number = F.col("col").isin(*numeric) if numeric else F.lit(False)
    fits = F.when(is_number, F.col("unique_count") <= 50).otherwise(F.col("unique_count").between(2, 100))
    return p.filter(fits).withColumn("distance", F.abs(F.col("unique_count") - 10))


def auto_strata(df: DataFrame, most: int = 3) -> DataFrame:
    return strata_candidates(df).orderBy("distance", "col").limit(most)


def hash_number(row_id: str) -> Column:
    """A whole number below 2^52 without pattern, the same in every engine."""
    return F.conv(F.substring(F.md5(F.col(row_id).cast("string")), 1, 13), 16, 10).cast("bigint")


def random_share(df: DataFrame, row_id: str, share: float) -> DataFrame:
    """About this share of the rows, chosen by a hash of their key; it grows with the input."""
    return df.filter(hash_number(row_id) < share * 2**52)


def stratified_sample(df: DataFrame, strata: list[str], row_id: str, target: int, total: int | None = None) -> DataFrame:
    """The same share of every stratum, exact to a row, in hash order; lone rows stay; cut to the target.

    Places inside a stratum come from bucketed counting, so a stratum may hold any share of the rows.
    """
    total = df.count() if total is None else total
    share = min(1.0, target / max(1, total))
    sizes = df.groupBy(*strata).agg(F.count("*").alias("_n"))
    placed = positions(df.withColumn("_h", hash_number(row_id)), strata, ["_h", row_id], "_pos").join(sizes, strata)
    quota = F.when(F.col("_n") > 1, F.floor(F.col("_n") * share + 0.5)).otherwise(1)
    kept = placed.filter(F.col("_pos") < quota)
    over = positions(kept, [], ["_h", row_id], "_all").filter(F.col("_all") < target)
    return over.select(*df.columns)


def sample_info(df: DataFrame, sample: DataFrame, strata: list[str]) -> DataFrame:
    """One row: sizes, share and number of strata."""
    cut = sample.groupBy(*strata).agg(F.count("*").alias("n")).agg(F.sum("n").alias("sample_size"), F.count("*").alias("n_strata"))
    return cut.withColumn("original_size", df.agg(F.count("*")).scalar()).withColumn("sample_fraction", F.try_divide(F.col("sample_size"), F.col("original_size")))


def adaptive_bins(df: DataFrame, cols: list[str], bins: int = 50) -> DataFrame:
    """``(col, edge_no, edge)``: quantile edges of numeric columns, distinct values of the others."""
    numeric = [c for c in cols if c in numeric_columns(df)]
    out = None
    if numeric:
        ranked = running_counts(value_counts(to_long(df, numeric)), ["n"], bucket_edges(df, numeric))
        q = quantiles(ranked, {f"e{i}": i / (bins - 1) for i in range(bins)})
        edges = F.array(*[F.col(f"e{i}") for i in range(bins)])
        out = q.select("col", F.posexplode(edges).alias("edge_no", "edge")).withColumn("edge", F.col("edge").cast("string"))
    for c in (c for c in cols if c not in numeric):
        values = df.select(F.lit(c).alias("col"), F.lit(None).cast("int").alias("edge_no"), F.col(c).cast("string").alias("edge")).distinct()
        out = values if out is None else out.unionByName(values)
    return out
