"""Comparisons that fit a model: effective dimension and the classifier two-sample test."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.column_stats import WIDE_LIMIT, gram_covariances
from plumbline.operators.longform import scrub


def covariances(df: DataFrame, cols: list[str], by: str | None = None) -> dict[str, np.ndarray]:
    """Covariance matrix per group from one aggregate; only columns squared numbers reach the driver.

    A pair uses the rows in which both cells are filled, whatever the number of columns.
    """
    d = len(cols)
    if d > WIDE_LIMIT:
        out = {}
        for r in gram_covariances(df, cols, [by] if by else []).collect():
            m = out.setdefault(r["g"], np.zeros((d, d)))
            m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["cov"] or 0.0
        return out
    clean = df.select(*([by] if by else []), *[scrub(F.col(c)).alias(c) for c in cols])
    aggs = [F.covar_samp(cols[i], cols[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]
    out = {}
    for row in (clean.groupBy(by) if by else clean.groupBy()).agg(*aggs).collect():
        m = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                m[i, j] = m[j, i] = row[f"c{i}_{j}"] or 0.0
        out[row[by] if by else ""] = m
    return out


def effective_dimension(cov: np.ndarray, share: float = 0.9) -> int:
    """Components needed to exceed the share of variance; 1 if there is no variance."""
    values = np.clip(np.linalg.eigvalsh(cov)[::-1], 0, None)
    return components_needed(values, values.sum(), share)


def components_needed(values: np.ndarray, whole: float, share: float = 0.9) -> int:
    """How many of the falling variances exceed the share of the whole; all of them if they do not reach it, 1 without variance."""
    if whole <= 0:
        return 1
    over = np.flatnonzero(np.cumsum(values) / whole > share)
    return int(over[0]) + 1 if len(over) else max(1, len(values))


def spectra(df: DataFrame, cols: list[str], by: str, components: int = 64, rounds: int = 2, seed: int = 42) -> dict[str, tuple[np.ndarray, float]]:
    """Largest variances along principal components per side, falling, and the total variance.

    Up to ``components`` columns they are all and exact. Beyond, a randomised range finder: ``rounds`` passes multiply the
    centred rows with a thin matrix and their transpose with the result, one more takes the variances inside the range
    found. Tasks send ``columns`` x ``components`` sums, which are added up by Spark; no matrix of columns squared is
    ever formed. A null cell stands at its column's mean.
    """
    d = len(cols)
    thin = min(d, components)
    if thin == d:
        # few columns come as numbers, which reach Python faster than an array a row
        clean = df.select(F.col(by).alias("g"), *[scrub(F.col(c)).alias(f"x{i}") for i, c in enumerate(cols)])
        matrix = lambda f: f[[f"x{i}" for i in range(d)]].to_numpy(float)
    else:
        # one array column: a plan of thousands of columns costs more than the rows
        cells = F.transform(F.array(*[F.col(c).cast("double") for c in cols]), scrub)
        clean = df.select(F.col(by).alias("g"), cells.alias("x"))
        matrix = lambda f: np.vstack(f["x"].to_list()).astype(float)

    def summed(product: Callable[[str, np.ndarray], np.ndarray], rows: int, width: int) -> dict[str, np.ndarray]:
        """Per side the sum over tasks of a matrix of ``rows`` x ``width``, a product of its cells."""

        def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[str, np.ndarray] = {}
            for f in frames:
                for g, part in f.groupby("g"):
                    new = product(g, matrix(part))
                    sums[g] = new if g not in sums else sums[g] + new
            for g, m in sums.items():
                at = np.indices(m.shape).reshape(2, -1)
                yield pd.DataFrame({"g": g, "i": at[0], "j": at[1], "v": m.ravel()})

        out: dict[str, np.ndarray] = {}
        for r in clean.mapInPandas(partial, "g string, i int, j int, v double").groupBy("g", "i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
            out.setdefault(r["g"], np.zeros((rows, width)))[r["i"], r["j"]] = r["v"]
        return out

    counted = summed(lambda g, x: np.stack([np.nansum(x, 0), (~np.isnan(x)).sum(0), np.full(d, len(x))], 1), d, 3)
    size = {g: int(m[0, 2]) for g, m in counted.items()}
    mean = {g: m[:, 0] / np.maximum(m[:, 1], 1) for g, m in counted.items()}
    start = np.eye(d) if thin == d else np.linalg.qr(np.random.default_rng(seed).normal(size=(d, thin)))[0]
    base = {g: start for g in size}

    def centred(g: str, x: np.ndarray) -> np.ndarray:
        return np.nan_to_num(x - mean[g])

    for _ in range(rounds if thin < d else 0):
        base = {g: np.linalg.qr(m)[0] for g, m in summed(lambda g, x: centred(g, x).T @ (centred(g, x) @ base[g]), d, thin).items()}

    def inside(g: str, x: np.ndarray) -> np.ndarray:
        x = centred(g, x)
        y = x @ base[g]
        last = np.zeros((thin, 1))
        last[0] = (x * x).sum()
        return np.hstack([y.T @ y, last])

    out = {}
    for g, m in summed(inside, thin, thin + 1).items():
        free = max(size[g] - 1, 1)
        out[g] = np.clip(np.linalg.eigvalsh(m[:, :thin] / free)[::-1], 0, None), float(m[0, thin] / free)
    return out


def dimension_metrics(found: dict[str, tuple[np.ndarray, float]]) -> dict[str, float]:
    ratio = components_needed(*found["synthetic"]) / (components_needed(*found["original"]) + 1e-10)
    return {"dimensionality_ratio": ratio, "dimensionality_preservation": 100 * float(np.exp(-abs(ratio - 1)))}


def dimension_rows(spark, found: dict[str, tuple[np.ndarray, float]]) -> DataFrame:
    """``(side, dimension, share, ratio, score)``: components needed per side, the variance they hold, and how the sides compare."""
    m = dimension_metrics(found)
    rows = []
    for side, (values, whole) in sorted(found.items()):
        n = components_needed(values, whole)
        rows.append((side, n, float(values[:n].sum() / whole) if whole > 0 else 0.0, m["dimensionality_ratio"], m["dimensionality_preservation"]))
    return spark.createDataFrame(rows, "side string, dimension int, share double, ratio double, score double")


def explained_variance(spark, cov: dict[str, np.ndarray]) -> DataFrame:
    """``(side, component, share, cumulative)``, one row per component."""
    rows = []
    for side, m in sorted(cov.items()):
        values = np.clip(np.linalg.eigvalsh(m)[::-1], 0, None)
        share = values / max(values.sum(), 1e-300)
        rows += [(side, i, float(s), float(c)) for i, (s, c) in enumerate(zip(share, np.cumsum(share)))]
    return spark.createDataFrame(rows, "side string, component int, share double, cumulative double")


def classifier_test(pair: DataFrame, cols: list[str], trees: int = 10, depth: int = 5, seed: int = 42) -> DataFrame:
    """One row: can a small forest tell the sides apart? All rows take part; weights balance the sides."""
    n = {r["side"]: r["count"] for r in pair.groupBy("side").count().collect()}  # two rows
    small = min(n.values())
    weight = F.lit(1.0)
    for side, size in n.items():
        weight = F.when(F.col("side") == side, small / size).otherwise(weight)
    features = [F.coalesce(scrub(F.col(c)), F.lit(0.0)).alias(c) for c in cols]
    # the split depends on the row's content only, so a recomputed partition splits the same way
    part = F.pmod(F.xxhash64(F.lit(seed), F.col("side"), *[F.col(c) for c in cols]), F.lit(10))
    rows = pair.select((F.col("side") == "original").cast("double").alias("label"), weight.alias("w"), part.alias("part"), *features)
    table = VectorAssembler(inputCols=cols, outputCol="features").transform(rows)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, weightCol="w").fit(table.filter("part < 7"))
    right = F.when(F.col("prediction") == F.col("label"), F.col("w")).otherwise(0.0)
    train = F.col("part") < 7
    acc = lambda test: F.sum(F.when(test, right)) / F.sum(F.when(test, F.col("w")))
    one = model.transform(table).agg(acc(train).alias("train_accuracy"), acc(~train).alias("test_accuracy"))
    gap = F.abs(F.col("train_accuracy") - F.col("test_accuracy"))
    return one.select(
        "train_accuracy", "test_accuracy",
        ((1 - (F.col("test_accuracy") - 0.5) * 2) * 100).alias("indistinguishability_score"),
        gap.alias("generalization_gap"), (100 * (1 - F.least(F.lit(1.0), gap * 10))).alias("gap_score"))
