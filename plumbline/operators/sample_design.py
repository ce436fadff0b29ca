"""A sample of exact size by design: quotas over clusters and periods, repeated rare rows, outliers.

Every row of a rare cluster is taken, several times; the most outlying rows are taken once; what is left of the
target is dealt to clusters x periods in proportion to their rows, with at least one row each as long as the target
allows it, by the largest remainder. Inside a stratum rows follow a hash of their id, so the sample is the same
however the input is dealt to tasks. Places come from bucketed counting, so a stratum or a score may hold any share of the rows.

Defined cases: null clusters and null periods are strata of their own; a null score is not outlying; an empty table
gives an empty sample for the target 0; a target that the fixed rows exceed, or that the rows cannot fill, raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.sampling import hash_number
from plumbline.operators.sequences import positions


def _text(c: Column) -> Column:
    """A join key that keeps null apart from every text."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def stratum_quotas(strata: DataFrame, wanted: int) -> DataFrame:
    """``(…, n, quota)`` for strata ``(_c, _p, n)``: proportional, one at least if there are enough, by largest remainder."""
    rows, count = strata.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()  # one row
    least = 1 if wanted >= count else 0
    dealt, over = wanted - least * count, rows - least * count
    # decimals, since the product of two row counts may not fit in 64 bits
    product = F.lit(dealt).cast("decimal(19,0)") * (F.col("n") - least).cast("decimal(19,0)")
    whole = F.expr("CAST(_x AS DECIMAL(38,0)) div _over").cast("bigint")
    parts = strata.withColumn("_x", product).withColumn("_over", F.lit(max(over, 1)).cast("decimal(19,0)"))
    parts = parts.withColumn("_whole", whole).withColumn("_rest", -(F.col("_x") - F.col("_whole") * F.col("_over")).cast("decimal(38,0)"))
    left = dealt - (parts.agg(F.sum("_whole")).first()[0] or 0)
    placed = positions(parts, [], ["_rest", "_c", "_p"], "_place")
    return placed.withColumn("quota", least + F.col("_whole") + (F.col("_place") < left).cast("int")).drop("_x", "_over", "_whole", "_rest", "_place")


def designed_sample(
    df: DataFrame, cluster: str, period: str, score: str, row_id: str, target: int,
    rare_share: float = 0.01, repeats: tuple[int, int] = (2, 5), outlier_share: float = 0.001,
) -> DataFrame:
    """``df``'s columns with ``reason`` (rare, outlier, quota) and ``copy`` from 1: exactly ``target`` rows.

    A cluster with less than ``rare_share`` of the rows is rare; the rarer, the more often its rows are repeated, within
    ``repeats``. ``score`` is 0 or more; the ``outlier_share`` of all rows with the highest ones are outliers.
    """
    rows = df.withColumn("_c", _text(F.col(cluster))).withColumn("_p", _text(F.col(period))).withColumn("_h", hash_number(row_id))
    sizes = rows.groupBy("_c").agg(F.count("*").alias("_n"))
    total = df.count()
    bound = rare_share * total
    times = F.least(F.lit(repeats[1]), F.greatest(F.lit(repeats[0]), F.floor(F.lit(bound) / F.col("_n"))))
    clusters = sizes.select("_c", F.when(F.col("_n") < bound, times).otherwise(0).cast("int").alias("_times"))
    n_outliers = int(-(-total * outlier_share // 1))
    marked = positions(rows.withColumn("_s", -F.coalesce(F.col(score), F.lit(0.0))), [], ["_s", row_id], "_rank").join(clusters, "_c")
    marked = marked.withColumn("reason", F.when(F.col("_times") > 0, "rare").when(F.col("_rank") < n_outliers, "outlier").otherwise("quota"))

    counts = marked.groupBy("_c", "_p", "reason").agg(F.count("*").alias("n"), F.sum(F.greatest("_times", F.lit(1))).alias("copies"))
    strata = counts.where("reason = 'quota'").select("_c", "_p", "n")
    fixed, free = counts.agg(  # one row
        F.coalesce(F.sum(F.when(F.col("reason") != "quota", F.col("copies"))), F.lit(0)),
        F.coalesce(F.sum(F.when(F.col("reason") == "quota", F.col("n"))), F.lit(0))).first()
    if not 0 <= target - fixed <= free:
        raise ValueError(f"{target} rows cannot be drawn: {fixed} are fixed and {free} are free")
    quotas = stratum_quotas(strata, target - fixed).select("_c", "_p", "quota")
    drawn = positions(marked.where("reason = 'quota'"), ["_c", "_p"], ["_h", row_id], "_pos").join(quotas, ["_c", "_p"])
    taken = marked.where("reason <> 'quota'").unionByName(drawn.where("_pos < quota").select(marked.columns))
    return taken.select(*df.columns, "reason", F.explode(F.sequence(F.lit(1), F.greatest("_times", F.lit(1)))).alias("copy"))
