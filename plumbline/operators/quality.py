"""Dataset health measures: duplicates, drift, regional outliers, stability, concentration, artefacts."""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators import collapse as cd
from plumbline.operators.column_stats import correlations
from plumbline.operators.longform import bucket_edges, running_counts, scrub, to_long, value_counts
from plumbline.operators.sequences import positions


def duplicate_share(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row: rows, repeated rows and their share. Equal rows meet as one counter per key."""
    cols = cols or df.columns
    per = df.groupBy(F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256).alias("h")).agg(F.count("*").alias("n"))
    one = per.agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("duplicates"), F.max("n").alias("largest_group"))
    return one.withColumn("share", F.try_divide(F.col("duplicates"), F.col("rows")))


def repeated_entities(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def split_by_time(df: DataFrame, time: str) -> DataFrame:
    """Early half as original, late half as synthetic, at the middle of the covered days."""
    day = F.unix_date(F.col(time).cast("date"))
    middle = df.agg((F.min(day) + F.max(day)) / 2).scalar()
    return df.withColumn("side", F.when(day <= middle, "original").otherwise("synthetic"))


def drift(df: DataFrame, time: str, cols: list[str]) -> DataFrame:
    """KS distance between the early and the late half per column."""
    halves = split_by_time(df.select(time, *cols), time)
    return cd.rank_metrics(cd.rank_table(halves, cols)).select("col", "ks")


def z_scores(df: DataFrame, cols: list[str], ids: list[str]) -> DataFrame:
    """Long form with each value's z-score (one statistics row per column is broadcast)."""
    s = to_long(df, cols).groupBy("col").agg(F.avg("val").alias("m"), F.stddev_samp("val").alias("sd"))
    return to_long(df, cols, ids).join(F.broadcast(s), "col").withColumn("z", F.coalesce(F.try_divide(F.col("val") - F.col("m"), F.col("sd")), F.lit(0.0))).drop("m", "sd")


def z_outliers(df: DataFrame, cols: list[str], row_id: str, limit: float = 3.0) -> DataFrame:
    return z_scores(df, cols, [row_id]).filter(F.abs("z") > limit).select(row_id, "col", "val", "z")


def outlier_regions(df: DataFrame, cols: list[str], row_id: str, size: int, limit: float = 3.0) -> DataFrame:
    """Share of rows with an outlying value per region of neighbouring rows, flagged above ten percent."""
    x = {c: scrub(F.col(c)) for c in cols}
    whole = df.agg(F.struct(*[F.struct(F.avg(v).alias("m"), F.stddev_samp(v).alias("s")).alias(c) for c, v in x.items()])).scalar()
    z = [F.coalesce(F.abs(F.try_divide(v - F.col("_s")[c]["m"], F.col("_s")[c]["s"])), F.lit(0.0)) for c, v in x.items()]
    # every row keeps its place, also one whose cells are all null
    odd = df.withColumn("_s", whole).select(row_id, (F.greatest(*z) if len(z) > 1 else z[0]).alias("z"))
    placed = positions(odd, [], [row_id], "pos")
    per = placed.groupBy(F.floor(F.col("pos") / size).alias("region")).agg(
        F.count("*").alias("rows"), F.count_if(F.col("z") > limit).alias("outliers"))
    share = F.col("outliers") / F.col("rows")
    return per.withColumn("share", share).withColumn("noisy", share > 0.1)


def correlation_spread(df: DataFrame, cols: list[str], subset: str) -> DataFrame:
    """Largest difference of a pair's correlation between subsets."""
    r = correlations(df, cols, [subset])
    return r.groupBy("i", "j").agg(F.min("r").alias("lowest"), F.max("r").alias("highest")).withColumn("spread", F.col("highest") - F.col("lowest"))


def perfect_pairs(df: DataFrame, cols: list[str], limit: float = 0.999) -> DataFrame:
    return correlations(df, cols).filter(F.abs("r") > limit)


def uniform_columns(pair: DataFrame, cols: list[str], closeness: float = 0.99) -> DataFrame:
    """Entropy of the synthetic side against that of a flat histogram."""
    h = cd.entropies(cd.joint_bins(cd.cells(pair, cols))).select("col", "h_syn")
    flat = math.log(cd.FIDELITY_BINS)
    return h.withColumn("flatness", F.col("h_syn") / flat).withColumn("suspicious", F.col("h_syn") / flat > closeness)


def concentration(df: DataFrame, cols: list[str], top: int = 4) -> DataFrame:
    """Entropy, Gini coefficient and share of the largest values, per column, from value counts.

    The Gini coefficient orders values by count, so it works on counts of counts: far fewer rows than values.
    """
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("v")) for c in cols]))).filter("v IS NOT NULL")
    per_value = cells.groupBy("col", "v").agg(F.count("*").alias("n"))
    sizes = per_value.groupBy("col", F.col("n").cast("double").alias("val")).agg(F.count("*").alias("k"))
    totals = sizes.groupBy("col").agg(F.sum(F.col("k") * F.col("val")).alias("rows"), F.sum("k").alias("values"))
    # ranks of equal counts are averaged: position sums follow from running totals over count sizes
    from pyspark.sql import Window

    w = Window.partitionBy("col").orderBy("val")  # one row per distinct count size
    ranked = sizes.join(totals, "col").withColumn("upto", F.sum("k").over(w))
    rank_sum = F.col("k") * (F.col("upto") - (F.col("k") - 1) / 2)
    p = F.col("val") / F.col("rows")
    above = F.col("values") - F.col("upto")
    taken = F.greatest(F.lit(0), F.least(F.col("k"), F.lit(top) - above))
    return ranked.groupBy("col").agg(
        F.max("values").alias("values"),
        (-F.sum(F.col("k") * p * F.ln(p))).alias("entropy"),
        (2 * F.sum(rank_sum * F.col("val")) / (F.max("values") * F.max("rows")) - (F.max("values") + 1) / F.max("values")).alias("gini"),
        F.sum(taken * p).alias("top_share"))


def rare_patterns(df: DataFrame, combo: list[str], limit: float = 0.01) -> DataFrame:
    """Combinations below a share of all rows."""
    per = df.groupBy(*combo).agg(F.count("*").alias("n"))
    return per.withColumn("share", F.col("n") / df.agg(F.count("*")).scalar()).filter(F.col("share") < limit)


def rare_recall(pair: DataFrame, combo: list[str], limit: float = 0.01) -> DataFrame:
    """Share of the original's rare combinations that the synthetic side still has."""
    rare = rare_patterns(pair.filter(F.col("side") == "original"), combo, limit).select(*combo)
    kept = pair.filter(F.col("side") == "synthetic").select(*combo).distinct().withColumn("hit", F.lit(1))
    return rare.join(kept, combo, "left").agg(F.count("*").alias("rare"), F.count("hit").alias("kept")).withColumn("recall", F.try_divide(F.col("kept"), F.col("rare")))


def cluster_report(df: DataFrame, cols: list[str], k: int = 8, seed: int = 42) -> DataFrame:
    """Size, centre, mean distance and density per cluster, with the silhouette of the whole."""
    table = VectorAssembler(inputCols=cols, outputCol="features").transform(df.select(*[F.coalesce(scrub(F.col(c)), F.lit(0.0)).alias(c) for c in cols]))
    model = KMeans(k=k, seed=seed, maxIter=20).fit(table)
    placed = model.transform(table)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    gap = F.sqrt(F.aggregate(F.zip_with(vector_to_array("features"), centres[F.col("prediction")], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    silhouette = ClusteringEvaluator().evaluate(placed)
    return placed.groupBy(F.col("prediction").alias("cluster_id")).agg(F.count("*").alias("size"), F.avg(gap).alias("radius")).select(
        "cluster_id", "size", centres[F.col("cluster_id")].alias("centroid"), "radius", (F.col("size") / (F.col("radius") + 1e-10)).alias("density"), F.lit(silhouette).alias("silhouette"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation of two columns. Equal pairs are counted first; each value's midrank is joined once."""
    ranked = running_counts(value_counts(to_long(df, [a, b])), ["n"], bucket_edges(df, [a, b]))
    mid = ranked.select("col", "val", (F.col("cum_n") - (F.col("n") - 1) / 2).alias("r"))
    pairs = df.select(scrub(F.col(a)).alias("a"), scrub(F.col(b)).alias("b")).groupBy("a", "b").agg(F.count("*").alias("w")).filter("a IS NOT NULL AND b IS NOT NULL")
    ra = mid.filter(F.col("col") == a).select(F.col("val").alias("a"), F.col("r").alias("ra"))
    rb = mid.filter(F.col("col") == b).select(F.col("val").alias("b"), F.col("r").alias("rb"))
    both = pairs.join(ra, "a").join(rb, "b")
    w, x, y = F.col("w").cast("double"), F.col("ra"), F.col("rb")
    s = both.agg(F.sum(w).alias("n"), (F.sum(w * x) / F.sum(w)).alias("mx"), (F.sum(w * y) / F.sum(w)).alias("my"), F.sum(w * x * y).alias("xy"), F.sum(w * x * x).alias("xx"), F.sum(w * y * y).alias("yy"))
    cov = F.col("xy") / F.col("n") - F.col("mx") * F.col("my")
    vx, vy = F.col("xx") / F.col("n") - F.col("mx") ** 2, F.col("yy") / F.col("n") - F.col("my") ** 2
    return s.select(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.coalesce(F.try_divide(cov, F.sqrt(vx * vy)), F.lit(0.0)).alias("rho"))


def daily(df: DataFrame, time: str, value: str) -> DataFrame:
    return df.groupBy(F.unix_date(F.col(time).cast("date")).alias("day")).agg(F.avg(value).alias("v"))


def autocorrelation(days: DataFrame, lags: list[int]) -> DataFrame:
    """Correlation of daily means with those some days later; one row per day meets one row per lag."""
    later = days.select(F.col("day").alias("d2"), F.col("v").alias("v2"))
    shifted = days.select("*", F.explode(F.array(*[F.lit(i) for i in lags])).alias("lag")).withColumn("d2", F.col("day") + F.col("lag"))
    both = shifted.join(later, "d2")
    return both.groupBy("lag").agg(F.count("*").alias("days"), F.coalesce(F.try_divide(F.covar_samp("v", "v2"), F.stddev_samp("v") * F.stddev_samp("v2")), F.lit(0.0)).alias("autocorrelation"))


def trend(days: DataFrame) -> DataFrame:
    return days.agg(F.count("*").alias("days"), F.regr_slope("v", F.col("day").cast("double")).alias("slope"), F.regr_r2("v", F.col("day").cast("double")).alias("r2"))


def column_classes(df: DataFrame, most: int = 100) -> DataFrame:
    """Class of every column and the share of its texts that do not parse as numbers or dates."""
    text = F.struct
    items = [text(F.lit(f.name).alias("col"), F.lit(f.dataType.simpleString()).alias("data_type"), F.col(f.name).cast("string").alias("v")) for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    cells = df.select(F.inline(F.array(*items)))
    per_value = cells.groupBy("col", "data_type", "v").agg(F.count("*").alias("n"))
    number = F.expr("try_cast(v AS DOUBLE)").isNotNull()
    date = F.expr("try_cast(v AS TIMESTAMP)").isNotNull()
    held = F.col("v").isNotNull()
    one = per_value.groupBy("col", "data_type").agg(
        F.sum(F.when(held, F.col("n"))).alias("filled"), F.count("v").alias("values"),
        F.sum(F.when(held & number, F.col("n")).otherwise(0)).alias("numbers"), F.sum(F.when(held & date & ~number, F.col("n")).otherwise(0)).alias("dates"))
    share = lambda c: F.try_divide(F.col(c), F.col("filled"))
    kind = (
        F.when(F.col("data_type").isin("timestamp", "timestamp_ntz", "date") | (share("dates") > 0.95), "datetime")
        .when(~F.col("data_type").isin("string", "boolean") | (share("numbers") > 0.95), "numeric")
        .when(F.col("values") <= most, "categorical").otherwise("text"))
    return one.select("col", "data_type", kind.alias("class"), "values", share("numbers").alias("number_share"))


def malformed(df: DataFrame, casts: dict[str, str]) -> DataFrame:
    """Rows per column that hold a text which does not convert to the expected type."""
    bad = [F.count_if(F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` AS {t})").isNull()).alias(c) for c, t in casts.items()]
    return df.agg(*bad).unpivot([], list(casts), "col", "malformed")


def null_patterns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows per combination of missing columns."""
    mask = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in cols])
    return df.groupBy(mask.alias("mask")).agg(F.count("*").alias("n"))


# Type of collapse by the dimension that failed.
COLLAPSE_TYPES = {
    "distribution_fidelity": "A",
    "correlation_preservation": "B",
    "statistical_consistency": "C",
    "entropy_stability": "D",
    "spectral_coherence": "E",
}


def collapse_types(dims: DataFrame, key: str) -> DataFrame:
    kind = F.lit(None).cast("string")
    for name, t in COLLAPSE_TYPES.items():
        kind = F.when(F.col("dim_name") == name, t).otherwise(kind)
    failed = dims.filter(F.col("score") < F.col("threshold")).select(key, kind.alias("collapse_type")).filter("collapse_type IS NOT NULL")
    return failed.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("collapse_type")), "").alias("types"))  # at most five


def root_causes(counts: DataFrame) -> DataFrame:
    """``(cause, n)`` to shares of all findings."""
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("cause", "n", F.coalesce(F.try_divide(F.col("n") * 100.0, total), F.lit(0.0)).alias("percentage"))


def ablation(scored: DataFrame, region: str, value: str) -> DataFrame:
    """Mean without each region against the mean of all, from one sum per region."""
    per = scored.groupBy(region).agg(F.count(value).alias("n"), F.sum(value).alias("s"))
    both = per.select("*", scored.agg(F.count(value)).scalar().alias("tn"), scored.agg(F.sum(value)).scalar().alias("ts"))
    before, after = F.col("ts") / F.col("tn"), F.try_divide(F.col("ts") - F.col("s"), F.col("tn") - F.col("n"))
    return both.select(region, before.alias("before"), after.alias("after"), (before - after).alias("improvement"))


def fix_priority(improvement: Column) -> Column:
    return F.when(improvement > 20, 1).when(improvement >= 10, 2).when(improvement >= 5, 3).otherwise(4)


def separability(vectors: DataFrame) -> DataFrame:
    """Mean cosine inside and across labels from ``(label, unit vector)``.

    The sum of all dot products in a set is the squared length of its vector sum, so no pair is formed.
    """
    cells = vectors.select("label", F.posexplode("vector").alias("i", "x"))
    sums = cells.groupBy("label", "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    per = sums.groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("all"), F.sum("q").alias("self"), F.max("n").alias("n"))
    whole = sums.groupBy("i").agg(F.sum("s").alias("s")).agg(F.sum(F.col("s") * F.col("s"))).scalar()
    one = per.agg(F.sum(F.col("all") - F.col("self")).alias("inside"), F.sum(F.col("n") * (F.col("n") - 1)).alias("inside_pairs"),
                  F.sum("all").alias("blocks"), F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("n")).alias("block_pairs"))
    both = one.withColumn("everything", whole)
    return both.select(F.try_divide(F.col("inside"), F.col("inside_pairs")).alias("within"),
                       F.try_divide(F.col("everything") - F.col("blocks"), F.col("rows") * F.col("rows") - F.col("block_pairs")).alias("across")).withColumn(
        "separation", F.col("within") - F.col("across"))


def spikes(points: DataFrame, run: str, value: str, limit: float = 3.0) -> DataFrame:
    """Points more than three deviations above their run's mean; statistics first, then one join."""
    s = points.groupBy(run).agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("sd"))
    return points.join(s, run).filter(F.col(value) > F.col("m") + limit * F.col("sd")).drop("m", "sd")
