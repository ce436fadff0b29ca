"""Column statistics, diversity scores and dataset profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.longform import (
    bucket_edges,
    numeric_columns,
    quantiles,
    running_counts,
    scrub,
    to_long,
    value_counts,
)

# Quantiles reported per column.
QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}
TARGET_SAMPLE_SIZE = 1_000_000


def sample_skew(g1: Column, n: Column) -> Column:
    """Bias-corrected skewness from the population one; 0 for constant columns."""
    n = n.cast("double")
    return F.coalesce(F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2)), F.lit(0.0))


def sample_kurtosis(g2: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis from the population one; 0 for constant columns."""
    n = n.cast("double")
    return F.coalesce(F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)), F.lit(0.0))


def moments(long: DataFrame) -> DataFrame:
    """One pass over the long form, nulls kept so that they can be counted."""
    n = F.count("val")
    return long.groupBy("col").agg(
        F.count("*").alias("rows"),
        (F.count("*") - n).alias("nulls"),
        n.alias("count"),
        F.avg("val").alias("mean"),
        F.coalesce(F.stddev_samp("val"), F.lit(0.0)).alias("std"),
        F.min("val").alias("min"),
        F.max("val").alias("max"),
        sample_skew(F.skewness("val"), n).alias("skew"),
        sample_kurtosis(F.kurtosis("val"), n).alias("kurtosis"),
    )


def null_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(col, rows, nulls)``: one pass over the table."""
    one = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return one.unpivot(["rows"], cols, "col", "nulls")


def column_stats(df: DataFrame, cols: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Exact statistics, one row per numeric column; quantiles and distinct counts by ranked value counts."""
    cols = cols or numeric_columns(df)
    ranked = running_counts(value_counts(to_long(df, cols)), ["n"], bucket_edges(df, cols, buckets))
    exact = quantiles(ranked, QUARTILES, "n", F.count("*").alias("distinct"))
    return moments(to_long(df, cols, nulls=True)).join(exact, "col", "left")


def mergeable_stats(df: DataFrame, cols: list[str] | None = None, accuracy: int = 10000) -> DataFrame:
    """Statistics from mergeable sums only, with sketched quantiles: one pass, one row per column."""
    cols = cols or numeric_columns(df)
    v = F.col("val")
    sums = to_long(df, cols).groupBy("col").agg(
        F.count("*").alias("count"),
        F.sum(v).alias("sum"),
        F.stddev_pop(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.percentile_approx(v, list(QUARTILES.values()), accuracy).alias("q"),
    )
    return sums.select(
        "col", "count", "sum", (F.col("sum") / F.col("count")).alias("mean"), "std", "min", "max",
        *[F.col("q")[i].alias(name) for i, name in enumerate(QUARTILES)],
    )


def spread_score(mean: Column, std: Column) -> Column:
    return F.when(mean == 0, 50.0).otherwise(F.least(F.lit(100.0), F.abs(F.try_divide(std, mean)) * 50))


def uniqueness_score(distinct: Column, count: Column) -> Column:
    return F.coalesce(F.least(F.lit(100.0), F.try_divide(distinct, count) * 100), F.lit(0.0))


def balance_score(q25: Column, median: Column, q75: Column) -> Column:
    lopsided = F.abs((median - q25) - (q75 - median))
    symmetric = 1 - F.try_divide(lopsided, q75 - q25)
    return F.when(q75 == q25, 50.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), symmetric * 100)))


def outlier_flag(s: dict[str, Column]) -> Column:
    """5.0 if the extremes leave the 1.5 IQR fences, else 0."""
    iqr = s["q75"] - s["q25"]
    outside = (s["min"] < s["q25"] - 1.5 * iqr) | (s["max"] > s["q75"] + 1.5 * iqr)
    return F.when(iqr == 0, 0.0).when(outside, 5.0).otherwise(0.0)


def diversity_columns(stats: DataFrame) -> DataFrame:
    """Spread, uniqueness, balance and their mean; skew magnitude and outlier flag."""
    c = F.col
    return (
        stats.withColumn("spread", spread_score(c("mean"), c("std")))
        .withColumn("uniqueness", uniqueness_score(c("distinct"), c("count")))
        .withColumn("balance", balance_score(c("q25"), c("median"), c("q75")))
        .withColumn("diversity", (c("spread") + c("uniqueness") + c("balance")) / 3)
        .withColumn("skew_factor", F.abs(c("skew")))
        .withColumn("outlier_pct", outlier_flag({k: c(k) for k in ("min", "max", "q25", "q75")}))
    )


def sample_quality(rows: Column, coverage: Column, target: int) -> Column:
    size = F.least(F.lit(1.0), rows / F.lit(target)) * 100
    return size * 0.6 + F.coalesce(coverage, F.lit(50.0)) * 0.4


def diversity_summary(scored: DataFrame, target: int = TARGET_SAMPLE_SIZE) -> DataFrame:
    """One row: mean column diversity, sample quality and the overall score."""
    covered = F.avg(F.when(F.col("mean") != 0, F.least(F.lit(100.0), F.try_divide(F.col("std"), F.abs("mean")) * 50)))
    one = scored.agg(
        F.count("*").alias("columns"),
        F.max("rows").alias("rows"),
        F.avg("diversity").alias("mean_diversity"),
        covered.alias("coverage"),
    )
    quality = sample_quality(F.col("rows"), F.col("coverage"), target)
    return one.withColumn("sample_quality", quality).withColumn(
        "overall", F.coalesce(F.col("mean_diversity") * 0.7 + F.col("sample_quality") * 0.3, F.lit(0.0))
    )


def diversity_advice(scored: DataFrame, summary: DataFrame) -> DataFrame:
    """One row per rule that fires: ``(subject, rule, measure)``; a single ``ok`` row if none does."""
    rules = F.array(
        F.when(F.col("diversity") < 30, F.struct(F.lit("low_diversity").alias("rule"), F.col("diversity").alias("measure"))),
        F.when(F.col("skew_factor") > 2, F.struct(F.lit("high_skew").alias("rule"), F.col("skew_factor").alias("measure"))),
        F.when(F.col("outlier_pct") > 10, F.struct(F.lit("many_outliers").alias("rule"), F.col("outlier_pct").alias("measure"))),
    )
    per_column = scored.select(F.col("col").alias("subject"), F.inline(F.filter(rules, lambda r: r.isNotNull())))
    sample = summary.filter(F.col("sample_quality") < 60).select(
        F.lit("sample").alias("subject"), F.lit("low_sample_quality").alias("rule"), F.col("sample_quality").alias("measure")
    )
    fired = per_column.unionByName(sample)
    # the advice table has at most three rows per column and one for the sample
    none = fired.agg(F.count("*").alias("n")).filter("n = 0").select(
        F.lit("dataset").alias("subject"), F.lit("ok").alias("rule"), F.lit(None).cast("double").alias("measure")
    )
    return fired.unionByName(none)


def outlier_percent(df: DataFrame, stats: DataFrame, cols: list[str]) -> DataFrame:
    """Exact share of values outside the 1.5 IQR fences (one stats row per column is broadcast)."""
    fences = stats.select("col", (F.col("q25") - 1.5 * (F.col("q75") - F.col("q25"))).alias("lo"),
                          (F.col("q75") + 1.5 * (F.col("q75") - F.col("q25"))).alias("hi"))
    outside = F.count_if((F.col("val") < F.col("lo")) | (F.col("val") > F.col("hi")))
    return to_long(df, cols).join(F.broadcast(fences), "col").groupBy("col").agg(
        outside.alias("outliers"), (outside * 100.0 / F.count("*")).alias("outlier_percent")
    )


def profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """Every column, whatever its type: nulls, distinct values, extremes, mean and deviation."""
    numeric = set(numeric_columns(df))
    distinct = (lambda c: F.approx_count_distinct(c)) if approx else None
    text = [F.struct(F.lit(f.name).alias("col"), F.lit(f.dataType.simpleString()).alias("data_type"), F.col(f.name).cast("string").alias("txt"),
                     (F.col(f.name).cast("double") if f.name in numeric else F.lit(None).cast("double")).alias("val"))
            for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    cells = df.select(F.inline(F.array(*text)))
    numbers = [
        F.min("val").alias("min_value"), F.max("val").alias("max_value"),
        F.avg("val").alias("mean_value"), F.stddev_samp("val").alias("std_dev"),
    ]
    if distinct is not None:
        base = cells.groupBy("col", "data_type").agg(
            F.count("*").alias("rows"), F.count_if(F.col("txt").isNull()).alias("null_count"), distinct("txt").alias("unique_count"), *numbers)
    else:
        # values meet by a 128-bit hash, so long texts are not shuffled and a hot value is one row before the count
        n = F.count("*")
        named = cells.filter(F.col("txt").isNotNull()).select("col", F.xxhash64("txt").alias("h1"), F.xxhash64(F.lit(1), F.col("txt")).alias("h2"))
        uniques = named.distinct().groupBy("col").agg(n.alias("unique_count"))
        base = cells.groupBy("col", "data_type").agg(n.alias("rows"), F.count_if(F.col("txt").isNull()).alias("null_count"), *numbers)
        base = base.join(uniques, "col", "left").na.fill(0, ["unique_count"])
    return base.withColumn("null_rate", F.try_divide(F.col("null_count"), F.col("rows"))).withColumn(
        "unique_rate", F.try_divide(F.col("unique_count"), F.col("rows"))
    )


def quality_report(df: DataFrame, stats: DataFrame, cols: list[str]) -> DataFrame:
    """One row: completeness, uniqueness, validity, duplicate rows, outliers and a 0-100 score."""
    names = df.columns
    filled = reduce(lambda a, b: a + b, [F.when(F.col(c).isNull(), 0).otherwise(1) for c in names])
    valid = reduce(lambda a, b: a + b, [F.when(F.isnan(F.col(c).cast("double")), 0).otherwise(1) for c in cols])
    row = F.xxhash64(*names), F.sha2(F.to_json(F.struct(*names)), 256)
    # equal rows meet after a map-side count; a hot row is one key with one counter
    per_row = df.select(filled.alias("filled"), valid.alias("valid"), row[0].alias("h"), row[1].alias("s")).groupBy("h", "s").agg(
        F.count("*").alias("n"), F.sum("filled").alias("filled"), F.sum("valid").alias("valid"))
    whole = per_row.agg(F.sum("n").alias("rows"), F.count("*").alias("distinct_rows"), F.sum("filled").alias("filled"), F.sum("valid").alias("valid"))
    both = whole.withColumn("outlier_count", outlier_percent(df, stats, cols).agg(F.sum("outliers")).scalar())
    rows = F.col("rows")
    return both.select(
        rows,
        (rows - F.col("distinct_rows")).alias("duplicate_rows"),
        F.coalesce("outlier_count", F.lit(0)).alias("outlier_count"),
        F.try_divide(F.col("filled"), rows * len(names)).alias("completeness"),
        F.try_divide(F.col("distinct_rows"), rows).alias("uniqueness"),
        F.try_divide(F.col("valid"), rows * max(1, len(cols))).alias("validity"),
    ).withColumn("quality_score", (F.col("completeness") + F.col("uniqueness") + F.col("validity")) / 3 * 100)


# ---------------------------------------------------------------- correlations

WIDE_LIMIT = 12


def correlations(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """Pearson r of every column pair: ``(by…, i, j, col_i, col_j, r)``, i < j, constant columns give 0.

    A pair uses the rows in which both cells are filled. Few columns: one aggregate with a built-in per pair. Many:
    partial cross-product sums per task. Both follow the same rule.
    """
    by = by or []
    if len(cols) > WIDE_LIMIT:
        return gram_correlations(df, cols, by)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    clean = df.select(*by, *[scrub_null(c) for c in cols])
    aggs = []
    for i, j in pairs:
        a, b = F.col(cols[i]), F.col(cols[j])
        both = a.isNotNull() & b.isNotNull()
        aggs.append(F.struct(
            F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(cols[i]).alias("col_i"), F.lit(cols[j]).alias("col_j"),
            pearson(F.covar_samp(a, b), F.stddev_samp(F.when(both, a)), F.stddev_samp(F.when(both, b))).alias("r")))
    grouped = clean.groupBy(*by) if by else clean.groupBy()
    return grouped.agg(F.array(*aggs).alias("pairs")).select(*by, F.inline("pairs"))


def scrub_null(c: str) -> Column:
    return scrub(F.col(c)).alias(c)


def pearson(cov: Column, sd_a: Column, sd_b: Column) -> Column:
    flat = (sd_a <= 1e-12) | (sd_b <= 1e-12)
    return F.coalesce(F.when(flat, 0.0).otherwise(F.try_divide(cov, sd_a * sd_b)), F.lit(0.0))


def gram_sums(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """``(g, i, j, n, si, sj, sii, sjj, sij)`` for i <= j over the rows in which both cells are filled.

    Every task sends one row of sums per pair, rows meet by pair. Cells are shifted by the column mean first, so that
    large means do not cost digits.
    """
    import numpy as np
    import pandas as pd

    means = df.agg(*[F.avg(scrub_null(c)).alias(c) for c in cols]).first()  # one value per column
    shifted = df.select(
        F.concat_ws("\u0001", *by).alias("g") if by else F.lit("").alias("g"),
        *[(scrub_null(c) - F.lit(means[c] or 0.0)).alias(f"c{i}") for i, c in enumerate(cols)],
    )
    upper = np.triu_indices(len(cols))

    def partial(batches):
        sums: dict[str, list] = {}
        for pdf in batches:
            for g, part in pdf.groupby("g"):
                raw = part.drop(columns="g").to_numpy(dtype=float)
                there = (~np.isnan(raw)).astype(float)
                x = np.nan_to_num(raw)
                square = (x * x).T @ there
                own = x.T @ there
                new = [there.T @ there, own, own.T, square, square.T, x.T @ x]
                old = sums.get(g)
                sums[g] = new if old is None else [a + b for a, b in zip(old, new)]
        for g, parts in sums.items():
            yield pd.DataFrame({"g": g, "i": upper[0], "j": upper[1], **{k: m[upper] for k, m in zip(PAIR_SUMS, parts)}})

    sums = shifted.mapInPandas(partial, "g string, i int, j int, " + ", ".join(f"{c} double" for c in PAIR_SUMS))
    return sums.groupBy("g", "i", "j").agg(*[F.sum(c).alias(c) for c in PAIR_SUMS])


PAIR_SUMS = ["n", "si", "sj", "sii", "sjj", "sij"]


def gram_covariances(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """``(g, i, j, n, cov, sd_i, sd_j)``: all three over the rows in which both cells are filled."""
    total = gram_sums(df, cols, by)
    spread = lambda a, b, ab: F.try_divide(F.col(ab) - F.try_divide(F.col(a) * F.col(b), F.col("n")), F.col("n") - 1)
    sd = lambda a, aa: F.sqrt(F.greatest(spread(a, a, aa), F.lit(0.0)))
    return total.select("g", "i", "j", "n", spread("si", "sj", "sij").alias("cov"), sd("si", "sii").alias("sd_i"), sd("sj", "sjj").alias("sd_j"))


def gram_correlations(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    names = F.array(*[F.lit(c) for c in cols])
    return gram_covariances(df, cols, by).filter("i < j").select(
        *[F.split("g", "\u0001")[n].alias(b) for n, b in enumerate(by)], "i", "j",
        names[F.col("i")].alias("col_i"), names[F.col("j")].alias("col_j"), pearson(F.col("cov"), F.col("sd_i"), F.col("sd_j")).alias("r"))
