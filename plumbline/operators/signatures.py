"""The library of earlier failure patterns: features, match judgement and upkeep."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.search import stored
from plumbline.operators.sequences import positions
from plumbline.roles import DIMENSIONS

RAW_SIZE = 128
# Statistics in feature order; a missing one takes eight empty slots.
STATISTICS = ["mean", "std", "min", "max", "median", "q25", "q75"]
FAILING = 65.0


def raw_features(scores: Column, stats: Column) -> Column:
    """128 numbers from maps of dimension scores and statistics.

    The names are read from arrays, one short expression for all of them: written out, they make a method too long for the JVM to compile.
    """
    names = lambda of: F.array(*[F.lit(x) for x in of])
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    marks = F.transform(names(DIMENSIONS), lambda d: F.coalesce(F.try_element_at(scores, d), F.lit(50.0)) / 100)
    numbers = F.flatten(F.transform(names(STATISTICS), lambda s: F.when(F.try_element_at(stats, s).isNull(), zeros(8)).otherwise(F.array(F.try_element_at(stats, s)))))
    shapes = F.transform(names(["skewness", "kurtosis"]), lambda s: F.coalesce(F.try_element_at(stats, s), F.lit(0.0)))
    return F.slice(F.concat(marks, numbers, shapes, zeros(RAW_SIZE)), 1, RAW_SIZE)


def scores_by_name(dims: DataFrame, key: str) -> DataFrame:
    """``(key, scores)``: a map of the dimension scores per key. Numbers are added up before the shuffle; a dimension's score is its highest."""
    one = dims.groupBy(key).agg(*[F.max(F.when(F.col("dim_name") == d, F.col("score"))).alias(d) for d in DIMENSIONS])
    return one.select(key, F.create_map(*[x for d in DIMENSIONS for x in (F.lit(d), F.col(d))]).alias("scores"))


def filled_slots(raw: Column) -> Column:
    """``(slot, value)`` of the numbers that are not zero, so that no row is made of the empty slots."""
    return F.inline(F.filter(F.transform(raw, lambda x, i: F.struct(i.alias("slot"), x.alias("value"))), lambda s: s["value"] != 0))


def fingerprint(long: DataFrame) -> DataFrame:
    """Mean, deviation and extremes of a whole table, all columns together."""
    v = F.col("val")
    return long.agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))


def learned_embedding(df: DataFrame, features: str, size: int = 16) -> DataFrame:
    """Scaled principal components of the raw features, fitted on the library itself.

    Means, components and the result each read all rows, so the features are written once.
    """
    vec = stored(df).withColumn("_raw", array_to_vector(features))
    pipe = Pipeline(stages=[StandardScaler(withMean=True, inputCol="_raw", outputCol="_scaled"), PCA(k=size, inputCol="_scaled", outputCol="_pca")])
    return pipe.fit(vec).transform(vec).withColumn("vector", vector_to_array("_pca")).drop("_raw", "_scaled", "_pca")


def alignment(matches: DataFrame, past: DataFrame, now: DataFrame) -> DataFrame:
    """Adds ``alignment``: agreement of pass and fail on common dimensions, 0.5 if there are none.

    ``past`` is ``(match_id, dim_name, score)``, ``now`` is ``(query_id, dim_name, score)``; a pair meets on at most eight dimensions.
    The matches are read once, since a search stands behind them.
    """
    p = past.select("match_id", "dim_name", F.col("score").alias("past"))
    n = now.select("query_id", "dim_name", F.col("score").alias("now"), F.lit(True).alias("met"))
    both = matches.join(p, "match_id", "left").join(n, ["query_id", "dim_name"], "left")
    bad = lambda c: F.col(c) < FAILING
    agree = F.when(bad("past") & bad("now"), 1.0).when(~bad("past") & ~bad("now"), 0.8).otherwise(0.3)
    return both.groupBy(*matches.columns).agg(F.coalesce(F.avg(F.when(F.col("met"), agree)), F.lit(0.5)).alias("alignment"))


def confidence(similarity: Column, accuracy: Column, usage: Column, aligned: Column) -> Column:
    acc = F.when(accuracy > 0, accuracy * 100).otherwise(80.0)
    used = 70 + F.least(F.lit(1.0), usage / 10.0) * 30
    return F.least(F.lit(100.0), 0.4 * similarity * 100 + 0.3 * acc + 0.15 * used + 0.15 * aligned * 100)


def uncertainty(similarity: Column, usage: Column, anomaly: Column) -> Column:
    return F.least(F.lit(100.0), (1 - similarity) * 50 + F.greatest(F.lit(0), 30 - usage * 3) + anomaly * 20)


def risk_level(score: Column, conf: Column) -> Column:
    return (
        F.when((score < 30) & (conf > 70), "CRITICAL").when((score < 50) & (conf > 60), "HIGH").when((score < 65) & (conf > 50), "MEDIUM").otherwise("LOW")
    )


def match_dimensions(matches: DataFrame, past: DataFrame, now: DataFrame) -> DataFrame:
    """One row per match and dimension of the pattern: both scores, their distance, and whether they agree."""
    p = past.select("match_id", "dim_name", F.col("score").alias("past"))
    n = now.select("query_id", "dim_name", F.col("score").alias("now"))
    out = matches.join(p, "match_id").join(n, ["query_id", "dim_name"], "left").withColumn("now", F.coalesce("now", F.lit(75.0)))
    return out.withColumn("difference", F.abs(F.col("past") - F.col("now"))).withColumn("agrees", F.col("difference") < 15)


def explain(dims: DataFrame) -> DataFrame:
    """Per match: agreeing and differing dimensions and the insights they give (at most eight each)."""
    w = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("dim_name"))))
    one = dims.groupBy("query_id", "match_id").agg(
        w(F.col("agrees")).alias("matching"), w(~F.col("agrees")).alias("mismatching"),
        F.max("collapse_score").alias("collapse_score"), F.max("usage_count").alias("usage_count"))
    notes = F.array(
        F.when(F.size("matching") > 4, "strong match"), F.when(F.col("collapse_score") < 50, "severe collapse"), F.when(F.col("usage_count") > 5, "well validated"))
    return one.withColumn("insights", F.filter(notes, lambda x: x.isNotNull())).drop("collapse_score", "usage_count")


def history_advice(dims: DataFrame) -> DataFrame:
    """The three dimensions that failed worst in the pattern, against the current score."""
    w = Window.partitionBy("query_id", "match_id").orderBy("past", "dim_name")
    worst = dims.filter(F.col("past") < FAILING).withColumn("place", F.row_number().over(w)).filter("place <= 3")
    return worst.select("query_id", "match_id", "place", "dim_name", F.when(F.col("now") < FAILING, "attend").otherwise("monitor").alias("advice"))


def feedback_average(feedback: DataFrame, key: str, order: list[str], start: float = 0.0, alpha: float = 0.1) -> DataFrame:
    """Exponential average per key with the number of uses, as a weighted sum by age.

    The average of n values is the start times (1-a)^n plus every value times a(1-a)^age, so a key of
    any size is summed in parallel.
    """
    n = feedback.groupBy(key).agg(F.count("*").alias("usage_count"))
    placed = positions(feedback, [key], order).join(n, key)
    weight = alpha * F.pow(F.lit(1 - alpha), (F.col("usage_count") - 1 - F.col("pos")).cast("double"))
    return placed.groupBy(key).agg(F.max("usage_count").alias("usage_count"), F.sum(F.col("feedback") * weight).alias("s")).select(
        key, "usage_count", (F.col("s") + start * F.pow(F.lit(1 - alpha), F.col("usage_count").cast("double"))).alias("accuracy"))


def clusters(library: DataFrame, key: str, k: int | None = None, seed: int = 42) -> DataFrame:
    """Cluster and distance to its centre per pattern."""
    if k is None:
        k = max(2, min(10, library.count() // 10))
    vec = library.select(key, "vector", array_to_vector("vector").alias("features"))
    model = KMeans(k=k, maxIter=20, seed=seed, predictionCol="cluster_id").fit(vec)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])  # at most ten rows
    gap = F.sqrt(F.aggregate(F.zip_with("vector", centres[F.col("cluster_id")], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    return model.transform(vec).select(key, "cluster_id", gap.alias("anomaly_score"))


def window_means(series: DataFrame, key: str, order: list[str], value: str, width: int = 10) -> DataFrame:
    """Means of whole windows per key; shorter series stay as they are."""
    n = series.groupBy(key).agg(F.count("*").alias("n"))
    placed = positions(series, [key], order).join(n, key)
    slot = F.when(F.col("n") < width, F.col("pos")).otherwise(F.floor(F.col("pos") / width))
    whole = (F.col("n") < width) | (slot < F.floor(F.col("n") / width))
    return placed.withColumn("window", slot).filter(whole).groupBy(key, "window").agg(F.avg(value).alias("mean"))


def library_statistics(library: DataFrame) -> DataFrame:
    """One row over the whole library. Scores are counted by value first, so the exact median sees one row a value."""
    s = F.col("collapse_score")
    one = library.agg(
        F.count("*").alias("signatures"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), F.min(s).alias("min"), F.max(s).alias("max"),
        F.avg(F.when(s < FAILING, 1.0).otherwise(0.0)).alias("collapse_rate"))
    per = library.groupBy("cluster_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("clusters"), F.avg("n").alias("mean_cluster_size"))
    median = library.groupBy(s.alias("s")).agg(F.count("*").alias("n")).agg(F.percentile("s", F.lit(0.5), F.col("n")))
    both = one.withColumn("per", per.select(F.struct("clusters", "mean_cluster_size")).scalar()).withColumn("median", median.scalar())
    return both.select(*one.columns, "median", "per.clusters", "per.mean_cluster_size")


def prescreen(matches: DataFrame, datasets: DataFrame) -> DataFrame:
    """Risk from the nearest pattern alone: none 10, above 0.9 85 and stop, else the similarity in percent."""
    best = matches.groupBy("query_id").agg(F.max("similarity").alias("similarity"))
    out = datasets.join(best, "query_id", "left")
    sim = F.col("similarity")
    risk = F.when(sim.isNull(), 10).when(sim > 0.9, 85).otherwise((sim * 100).cast("int"))
    return out.select("query_id", risk.alias("risk"), F.coalesce(risk < 70, F.lit(True)).alias("proceed"))


def prescreen_by_count(matches: DataFrame, datasets: DataFrame) -> DataFrame:
    """Risk from the number of patterns: none 25, else ten each up to 50."""
    n = matches.groupBy("query_id").agg(F.count("*").alias("n"))
    risk = F.when(F.col("n").isNull(), 25).otherwise(F.least(F.lit(50), F.col("n") * 10))
    return datasets.join(n, "query_id", "left").select("query_id", risk.cast("int").alias("risk"), (risk < 75).alias("proceed"))
