"""Fix jobs on tables: outliers dropped or clipped, smoothing, rebalancing, mixing; and the personal-data count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.longform import scrub
from plumbline.operators.sampling import hash_number
from plumbline.operators.sequences import positions

# How many deviations are dropped and clipped, the share that is rare, synthetic to real when mixing.
DROP_SIGMA, CLIP_SIGMA = 5.0, 3.0
RARE_SHARE, RARE_REPEATS = 0.01, 2
SYNTHETIC_SHARE = 0.3
PATTERNS = {
    "emails": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z][A-Za-z]+",
    "phones": r"\+[0-9][0-9 ().-]{6,}[0-9]",
    "social_numbers": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}


def personal_data(df: DataFrame, key: str, text: str) -> DataFrame:
    """Counts per row and whether there is any; a null text has none."""
    counts = [F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0)).cast("bigint").alias(n) for n, p in PATTERNS.items()]
    return df.select(key, *counts).withColumn("flagged", reduce(lambda a, b: a + b, [F.col(n) for n in PATTERNS]) > 0)


def _limits(df: DataFrame, cols: list[str]) -> DataFrame:
    """The frame with ``_s``, means and deviations of the columns from one aggregate, as a scalar subquery."""
    stats = [F.struct(F.avg(scrub(F.col(c))).alias("m"), F.stddev_samp(scrub(F.col(c))).alias("s")).alias(c) for c in cols]
    return df.withColumn("_s", df.agg(F.struct(*stats).alias("_s")).scalar())


def without_outliers(df: DataFrame, cols: list[str], sigma: float = DROP_SIGMA) -> DataFrame:
    """Rows that lie within ``sigma`` deviations in every column; null cells are no outliers."""
    near = lambda c: F.coalesce(F.abs(scrub(F.col(c)) - F.col("_s")[c]["m"]) <= sigma * F.col("_s")[c]["s"], F.lit(True))
    return _limits(df, cols).filter(reduce(lambda a, b: a & b, [near(c) for c in cols])).drop("_s")


def clipped(df: DataFrame, cols: list[str], sigma: float = CLIP_SIGMA) -> DataFrame:
    """The columns limited to ``sigma`` deviations around their means; nulls stay null."""
    def limit(c: str) -> Column:
        m, s = F.col("_s")[c]["m"], F.coalesce(F.col("_s")[c]["s"], F.lit(0.0))
        return F.when(F.col(c).isNotNull(), F.least(F.greatest(scrub(F.col(c)), m - sigma * s), m + sigma * s))

    return _limits(df, cols).withColumns({c: limit(c) for c in cols}).drop("_s")


def smoothed(df: DataFrame, by: list[str], order: list[str], value: str, reach: int = 3) -> DataFrame:
    """``(by…, pos, value, smooth)``: mean of up to ``reach`` rows on either side.

    Every row is handed to the places it counts for and summed there, so a series of any length is spread over tasks.
    """
    placed = positions(df.select(*dict.fromkeys([*by, *order, value])), by, order, "pos")
    step = F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("_step")
    spread = placed.select(*by, "pos", F.col(value).alias("_v"), step).withColumn("_at", F.col("pos") + F.col("_step"))
    own = F.max(F.when(F.col("_step") == 0, F.col("_v")))
    out = spread.groupBy(*by, F.col("_at").alias("pos")).agg(own.alias(value), F.avg("_v").alias("smooth"), F.count_if(F.col("_step") == 0).alias("_own"))
    return out.filter("_own > 0").drop("_own")


def rebalanced(df: DataFrame, label: str, key: str) -> DataFrame:
    """Rows with ``copy``: rows of rare labels ``RARE_REPEATS`` times, others once (one row per label is joined)."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    times = F.when(F.col("_n") < RARE_SHARE * F.col("_all"), RARE_REPEATS).otherwise(1)
    repeats = sizes.withColumn("_all", df.agg(F.count("*")).scalar()).select(F.col(label).alias("_label"), times.alias("_times"))
    joined = df.join(repeats, F.col(label).eqNullSafe(F.col("_label")))
    return joined.select(key, label, F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("copy"))


def mixed(pair: DataFrame, key: str, share: float = SYNTHETIC_SHARE) -> DataFrame:
    """Both sides in hash order, cut so that ``share`` of the rows is synthetic and as many rows as possible are kept."""
    sizes = pair.groupBy("side").agg(F.count("*").alias("n")).agg(
        F.coalesce(F.max(F.when(F.col("side") == "synthetic", F.col("n"))), F.lit(0)).alias("syn"),
        F.coalesce(F.max(F.when(F.col("side") == "original", F.col("n"))), F.lit(0)).alias("orig"))
    whole = sizes.select(F.least(F.col("syn") / share, F.col("orig") / (1 - share))).scalar()
    placed = positions(pair.select("side", key).withColumn("_h", hash_number(key)), ["side"], ["_h", key], "_pos")
    quota = F.when(F.col("side") == "synthetic", share).otherwise(1 - share) * whole
    return placed.filter(F.col("_pos") < F.floor(quota + 1e-9)).select("side", key)
