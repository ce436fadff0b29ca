"""Jobs that fit or measure several things over the same rows: how often they read them, and what comes out."""

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators import learned, runs


def test_ladder_reads_once_a_variant_and_once_to_judge(spark):
    reads = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            reads.add(len(f))
            yield f

    rows = spark.createDataFrame([(float(i % 13), float(i % 7), float(i % 13 * 3 + i % 5)) for i in range(300)], "a double, b double, y double")
    out = {(r["capacity"], r["variant"]): r for r in runs.capacity_ladder(rows.mapInPandas(counted, rows.schema), ["a", "b"], "y", [1, 3], 2).collect()}
    assert set(out) == {(1, 0), (1, 1), (3, 0), (3, 1)} and reads.value == 3 * 300
    assert out[3, 0]["train_loss"] < out[1, 0]["train_loss"] and all(r["test_loss"] > 0 for r in out.values())
    alone = runs.capacity_ladder(rows, ["a", "b"], "y", [1], 1).collect()
    assert np.isnan(alone[0]["test_loss"]) and alone[0]["train_loss"] > 0


def test_spectra_of_few_columns(spark):
    """The variances numpy finds, with null cells at their column's mean, and columns that come as numbers, not as arrays."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 3)) @ rng.normal(size=(3, 3))
    cells = [[None if (i + j) % 17 == 0 else float(v) for j, v in enumerate(r)] for i, r in enumerate(x)]
    df = spark.createDataFrame([("original" if i % 3 else "synthetic", *r) for i, r in enumerate(cells)], "side string, a double, b double, c double")
    found = learned.spectra(df.withColumn("a", F.col("a")), ["a", "b", "c"], "side")
    for side in ("original", "synthetic"):
        m = np.array([[np.nan if v is None else v for v in r] for i, r in enumerate(cells) if (side == "original") == bool(i % 3)])
        m = np.nan_to_num(m - np.nanmean(m, 0))
        want = np.linalg.eigvalsh(m.T @ m / (len(m) - 1))[::-1]
        assert np.allclose(found[side][0], want) and np.isclose(found[side][1], want.sum())
