"""Which rows and features carry the damage."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.longform import scrub, to_long
from plumbline.operators.sequences import islands, positions
from plumbline.streaming.run import shared_folder

NEIGHBOURS = 20
THRESHOLD = 0.8


@dataclass(frozen=True)
class Shape:
    """Rows, means, deviations and the precision matrix of the features: columns squared numbers from one aggregate."""

    rows: int
    mean: np.ndarray
    deviation: np.ndarray
    precision: np.ndarray


def shape(df: DataFrame, cols: list[str]) -> Shape:
    """Pairs use the rows in which both cells are filled, means those of their column."""
    d = len(cols)
    x = [scrub(F.col(c)) for c in cols]
    one = df.agg(
        F.count("*").alias("n"), *[F.avg(v).alias(f"m{i}") for i, v in enumerate(x)],
        *[F.covar_samp(x[i], x[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]).first()
    cov = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            cov[i, j] = cov[j, i] = one[f"c{i}_{j}"] or 0.0
    try:
        precision = np.linalg.inv(cov + 1e-6 * np.eye(d))
    except np.linalg.LinAlgError:
        precision = np.eye(d)
    return Shape(one["n"], np.array([one[f"m{i}"] or 0.0 for i in range(d)]), np.sqrt(np.clip(np.diag(cov), 0, None)), precision)


def _filled(cols: list[str], form: Shape) -> list[Column]:
    """The features; a null cell takes its column's mean, and so counts as neither near nor far."""
    return [F.coalesce(scrub(F.col(c)), F.lit(float(m))) for c, m in zip(cols, form.mean)]


def divided_by_max(df: DataFrame, *cols: str) -> DataFrame:
    """Divide columns by their largest values: one aggregate for all of them, a scalar subquery."""
    most = df.agg(F.struct(*[F.max(c).alias(c) for c in cols]).alias("most")).scalar()
    scaled = df.withColumn("_max", most)
    return scaled.withColumns({c: F.when(F.col("_max")[c] > 0, F.col(c) / F.col("_max")[c]).otherwise(F.col(c)) for c in cols}).drop("_max")


def raw_outlier(cols: list[str], form: Shape) -> Column:
    """Distance from the mean in the metric of the covariances."""
    z = F.array(*[c - F.lit(float(m)) for c, m in zip(_filled(cols, form), form.mean)])
    rows = [F.aggregate(F.zip_with(z, F.array(*[F.lit(float(p)) for p in line]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for line in form.precision]
    square = F.aggregate(F.zip_with(z, F.array(*rows), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(square, F.lit(0.0)))


def raw_anomaly(cols: list[str], form: Shape) -> Column:
    """The largest absolute z-score over the features."""
    z = [F.abs((x - F.lit(float(m))) / F.lit(float(s) + 1e-6)) for x, m, s in zip(_filled(cols, form), form.mean, form.deviation)]
    return F.greatest(*z) if len(z) > 1 else z[0]


def mahalanobis(df: DataFrame, cols: list[str], row_id: str) -> DataFrame:
    """``(row_id, outlier)``."""
    return divided_by_max(df.select(row_id, raw_outlier(cols, shape(df, cols)).alias("outlier")), "outlier")


def hashed_order(row_id: str) -> list[Column]:
    """An order without pattern that every engine reproduces."""
    return [F.sha2(F.col(row_id).cast("string"), 256), F.col(row_id)]


def reference_sample(df: DataFrame, cols: list[str], row_id: str, size: int, form: Shape | None = None) -> np.ndarray:
    """At most ``size`` rows in hash order: a top-k plan, ``size`` rows on the driver."""
    form = form or shape(df, cols)
    rows = df.select(row_id, *[c.alias(f"x{i}") for i, c in enumerate(_filled(cols, form))]).orderBy(*hashed_order(row_id)).limit(size)
    return rows.drop(row_id).toPandas().to_numpy(dtype=float)


def neighbour_distance(df: DataFrame, cols: list[str], row_id: str, sample: np.ndarray, k: int, form: Shape | None = None, keep: dict[str, Column] | None = None) -> DataFrame:
    """``(row_id, distance)`` and the doubles of ``keep``: mean distance to the k nearest sample rows.

    The sample has a fixed size, so rows cost the same.
    """
    form = form or shape(df, cols)
    norms, kept = (sample * sample).sum(1), list(keep or {})

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[[f"x{i}" for i in range(len(cols))]].to_numpy(dtype=float)
            out = np.empty(len(x))
            for start in range(0, len(x), 2048):
                part = x[start : start + 2048]
                sq = np.clip((part * part).sum(1)[:, None] + norms[None, :] - 2 * part @ sample.T, 0, None)
                near = np.argpartition(sq, k - 1, axis=1)[:, :k]
                # the k nearest again by differences, which loses no digits
                out[start : start + 2048] = np.sqrt(((part[:, None, :] - sample[near]) ** 2).sum(2)).mean(1)
            yield pdf[[row_id]].assign(distance=out, **{c: pdf[c] for c in kept})

    wide = df.select(row_id, *[c.alias(f"x{i}") for i, c in enumerate(_filled(cols, form))], *[c.alias(n) for n, c in (keep or {}).items()])
    extra = "".join(f", {c} double" for c in kept)
    return wide.mapInPandas(kernel, f"{row_id} {df.schema[row_id].dataType.simpleString()}, distance double{extra}")


def sparseness() -> Column:
    """Sparse surroundings score high."""
    local = 1 / (F.col("distance") + 1e-6)
    return 1 / (local + 1e-6)


def neighbours_of(df: DataFrame, cols: list[str], row_id: str, sample_rows: int, keep: bool) -> DataFrame:
    form = shape(df, cols)
    sample = reference_sample(df, cols, row_id, sample_rows, form)
    k = max(1, min(NEIGHBOURS, form.rows // 10, len(sample)))
    more = {"outlier": raw_outlier(cols, form), "anomaly": raw_anomaly(cols, form)} if keep else None
    return neighbour_distance(df, cols, row_id, sample, k, form, more)


def density(df: DataFrame, cols: list[str], row_id: str, sample_rows: int) -> DataFrame:
    """``(row_id, density)`` of all rows, judged against ``sample_rows`` rows in hash order."""
    near = neighbours_of(df, cols, row_id, sample_rows, keep=False)
    return divided_by_max(near.select(row_id, sparseness().alias("density")), "density")


def feature_anomaly(df: DataFrame, cols: list[str], row_id: str) -> DataFrame:
    """``(row_id, anomaly)``."""
    return divided_by_max(df.select(row_id, raw_anomaly(cols, shape(df, cols)).alias("anomaly")), "anomaly")


def impact(df: DataFrame, cols: list[str], row_id: str, sample_rows: int) -> DataFrame:
    """``(row_id, outlier, density, anomaly, impact)`` of all rows: one projection and one aggregate for the three maxima.

    The neighbours are the dear part and both the maxima and the rows need them, so the four columns are written once, to the shared
    folder.
    """
    raw = neighbours_of(df, cols, row_id, sample_rows, keep=True).select(row_id, "outlier", sparseness().alias("density"), "anomaly")
    path = shared_folder(df.sparkSession)
    raw.write.parquet(path)
    raw = df.sparkSession.read.schema(raw.schema).parquet(path)
    parts = divided_by_max(raw, "outlier", "density", "anomaly")
    return parts.withColumn("impact", F.col("outlier") * 0.4 + F.col("density") * 0.3 + F.col("anomaly") * 0.3)


def gradient_impact(norms: DataFrame) -> DataFrame:
    """``(row_id, impact)`` from a table of gradient norms per row."""
    return divided_by_max(norms.withColumnRenamed("grad_norm", "impact"), "impact")


def top_rows(scored: DataFrame, row_id: str, k: int) -> DataFrame:
    return scored.orderBy(F.col("impact").desc(), row_id).limit(k)


def problem_summary(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row: problem rows, their share and the advice band."""
    one = scored.agg(F.count("*").alias("rows"), F.count_if(F.col("impact") > threshold).alias("problems"))
    pct = F.coalesce(F.try_divide(F.col("problems") * 100.0, F.col("rows")), F.lit(0.0))
    return one.withColumn("percent", pct).withColumn(
        "advice", F.when(pct > 20, "critical").when(pct > 10, "warning").when(pct > 5, "caution").otherwise("acceptable"))


def feature_attribution(df: DataFrame, cols: list[str], dims: DataFrame, key: str) -> DataFrame:
    """Variance share of each feature for every failing dimension."""
    var = to_long(df, cols).groupBy("col").agg(F.var_pop("val").alias("variance"))
    shares = divided_by_max(var, "variance").withColumnRenamed("variance", "attribution")
    table = F.collect_list(F.struct("col", "attribution"))
    features = shares.agg(table).scalar()  # one entry per feature
    return dims.filter(F.col("score") < 65).select(key, "dim_name", features.alias("features")).select(key, "dim_name", F.inline("features"))


def problem_regions(scored: DataFrame, row_id: str, threshold: float) -> DataFrame:
    """Runs of neighbouring problem rows, by position in row order."""
    placed = positions(scored.select(row_id, "impact"), [], [row_id], "row_index")
    return islands(placed.filter(F.col("impact") > threshold), [], "row_index")
