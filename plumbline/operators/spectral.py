"""Spectra of row-ordered numeric columns, averaged over blocks of a fixed length."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.longform import to_long
from plumbline.operators.sequences import positions


def blocks(pair: DataFrame, cols: list[str], row_id: str, block: int) -> DataFrame:
    """``(col, block, side, t, val)``: each side in row order in blocks of ``block`` rows. Null cells keep their place as 0."""
    placed = positions(pair.select("side", row_id, *cols), ["side"], [row_id], "pos")
    return to_long(placed, cols, ["side", "pos"], nulls=True).select(
        "col", F.floor(F.col("pos") / block).alias("block"), "side", (F.col("pos") % block).cast("int").alias("t"), F.coalesce("val", F.lit(0.0)).alias("val"))


def power_bins(blocked: DataFrame, block: int) -> DataFrame:
    """Power per (col, block, side, frequency) and the rows of the block; a short last block is filled up with zeros."""

    def kernel(key, pdf: pd.DataFrame) -> pd.DataFrame:
        values = np.zeros(block)
        values[pdf["t"].to_numpy()] = pdf["val"].to_numpy()
        psd = np.abs(np.fft.rfft(values)) ** 2
        return pd.DataFrame({"col": key[0], "block": key[1], "side": key[2], "k": np.arange(len(psd)), "psd": psd, "rows": len(pdf)})

    return blocked.groupBy("col", "block", "side").applyInPandas(kernel, "col string, block long, side string, k long, psd double, rows long")


def compare_spectra(bins: DataFrame) -> DataFrame:
    """Per column: summed difference of the mean spectra, bins, matching peak and both entropies.

    A side's mean weights its blocks by their rows, so both sides may have any length.
    """
    mean = lambda side: F.sum(F.when(F.col("side") == side, F.col("psd") * F.col("rows"))) / F.sum(F.when(F.col("side") == side, F.col("rows")))
    s, o = F.col("s"), F.col("o")
    both = bins.groupBy("col", "k").agg(mean("synthetic").alias("s"), mean("original").alias("o")).filter(s.isNotNull() & o.isNotNull())
    whole = both.groupBy("col").agg(F.sum("s").alias("all_s"), F.sum("o").alias("all_o"))  # one row per column
    entropy = lambda x, total: -F.sum(x / F.greatest(total, F.lit(1e-12)) * F.ln(x / F.greatest(total, F.lit(1e-12)) + 1e-8))
    peak = lambda x: F.max_by(F.col("k"), F.struct(x, -F.col("k")))
    return both.join(whole, "col").groupBy("col").agg(
        F.count("*").alias("bins"), F.sum(F.abs(s - o)).alias("distance"), (peak(s) == peak(o)).alias("peak_match"),
        entropy(s, F.col("all_s")).alias("h_syn"), entropy(o, F.col("all_o")).alias("h_orig"))


def spectral_metrics(compared: DataFrame) -> DataFrame:
    """One row: distance and similarity, dominant frequency match, entropy ratio and score."""
    one = compared.agg(
        (F.sum("distance") / F.sum("bins")).alias("spectral_distance"),
        (F.avg(F.col("peak_match").cast("double")) * 100).alias("dominant_frequency_match"),
        F.avg("h_syn").alias("h_syn"), F.avg("h_orig").alias("h_orig"))
    ratio = F.col("h_syn") / (F.col("h_orig") + 1e-10)
    return one.select(
        "spectral_distance", (100 * F.exp(-F.col("spectral_distance") / 1000)).alias("spectral_similarity"),
        "dominant_frequency_match", ratio.alias("spectral_entropy_ratio"), (100 * F.exp(-F.abs(ratio - 1))).alias("spectral_entropy_score"))
