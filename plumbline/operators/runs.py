"""Analytics over training-run result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.sequences import carry


def cascade_summary(results: DataFrame) -> DataFrame:
    """Per validation: models, total time, mean and best metric, and the model that reached it."""
    return results.groupBy("validation_id").agg(
        F.count("*").alias("models"),
        F.sum("seconds").alias("total_time"),
        F.avg("metric").alias("mean_metric"),
        F.max("metric").alias("best_metric"),
        F.max_by("model_id", F.struct("metric", "model_id")).alias("best_model"),
    )


# ---------------------------------------------------------------- gradients and loss curves


def gradient_health(norms: DataFrame) -> DataFrame:
    """Per run from ``(run, norm)``: mean and deviation of norms, vanishing and exploding checks, score."""
    mean = F.col("mean_gradient_norm")
    return (
        norms.groupBy("run")
        .agg(F.avg("norm").alias("mean_gradient_norm"), F.stddev_pop("norm").alias("std_gradient_norm"))
        .withColumn("vanishing_check", F.when(mean > 1e-5, 100.0).otherwise(50.0))
        .withColumn("exploding_check", F.when(mean < 100, 100.0).otherwise(50.0))
        .withColumn("score", (F.col("vanishing_check") + F.col("exploding_check")) / 2)
    )


def gradient_stats(norms: DataFrame) -> DataFrame:
    """Per run: total norm, largest and smallest entry and their distance."""
    return norms.groupBy("run").agg(
        F.sqrt(F.sum(F.col("norm") * F.col("norm"))).alias("total_norm"), F.max("norm").alias("max_grad"), F.min("norm").alias("min_grad")
    ).withColumn("grad_range", F.col("max_grad") - F.col("min_grad"))


def loss_diffs(curves: DataFrame) -> DataFrame:
    """``(run, step, loss)`` plus the change against the step before and the position; long runs are split by step."""
    out = carry(curves, ["run"], ["step"], lags={"before": "loss"}, index="pos")
    return out.withColumn("diff", F.col("loss") - F.col("before")).drop("before")


def loss_landscape(curves: DataFrame, least: int = 10) -> DataFrame:
    """Per run of at least ``least`` points: decrease, smoothness, stability of the last tenth, score."""
    sized = curves.groupBy("run").agg(F.count("*").alias("n"), F.min_by("loss", "step").alias("first"), F.max_by("loss", "step").alias("last"))
    seq = loss_diffs(curves).join(sized, "run").filter(F.col("n") >= least)
    tail = F.when(F.col("pos") >= F.col("n") - F.ceil(F.col("n") / 10), F.col("loss"))
    one = seq.groupBy("run").agg(
        F.max(F.col("first") - F.col("last")).alias("loss_decrease"),
        F.stddev_pop("diff").alias("sd"), F.avg(F.abs("diff")).alias("step_size"),
        F.stddev_pop(tail).alias("tail_sd"), F.avg(tail).alias("tail_mean"))
    c = F.col
    return one.select(
        "run", "loss_decrease", F.least(F.lit(100.0), c("loss_decrease") * 100).alias("decrease_score"),
        (100 * (1 - F.least(F.lit(1.0), c("sd") / (c("step_size") + 1e-8)))).alias("loss_smoothness"),
        F.least(F.lit(100.0), 100 * (1 - F.try_divide(c("tail_sd"), c("tail_mean") + 1e-8))).alias("convergence_stability"),
    ).withColumn("score", c("decrease_score") * 0.4 + c("loss_smoothness") * 0.3 + c("convergence_stability") * 0.3)


def patience(curves: DataFrame, wait: int = 3) -> DataFrame:
    """Per run: best loss, its step, and the first step at which nothing improved for ``wait`` steps.

    Training would have stopped there, so later points do not count as best.
    """
    ran = carry(curves, ["run"], ["step"], mins={"best_so_far": "loss"}, index="pos")
    # a stretch is the time one value stayed the best; it starts where that value was reached
    stretches = ran.groupBy("run", "best_so_far").agg(F.min("pos").alias("since"), F.max("pos").alias("until"))
    stopped = F.min(F.when(F.col("until") - F.col("since") >= wait, F.col("since") + wait))
    stops = stretches.groupBy("run").agg(stopped.alias("early_stop_epoch"))
    seen = stretches.join(stops, "run").filter(F.col("early_stop_epoch").isNull() | (F.col("since") <= F.col("early_stop_epoch")))
    return seen.groupBy("run").agg(
        F.min("best_so_far").alias("best_loss"), F.max("since").alias("convergence_epoch"), F.max("early_stop_epoch").alias("early_stop_epoch"))


# ---------------------------------------------------------------- models of one cascade

# Collapse is signalled by loss variance, output entropy or frequency concentration.
LOSS_VARIANCE_LIMIT = 1.0
ENTROPY_LIMIT = 2.0
CONCENTRATION_LIMIT = 100.0


def tail_variance(curves: DataFrame, points: int = 5) -> DataFrame:
    """``(run, points, tail_variance)`` over the last points of each curve."""
    sized = curves.groupBy("run").agg(F.count("*").alias("points"))
    tail = carry(curves, ["run"], ["step"], index="pos").join(sized, "run").filter(F.col("pos") >= F.col("points") - points)
    return tail.groupBy("run").agg(F.max("points").alias("points"), F.var_pop("loss").alias("tail_variance"))


def collapse_signals(curves: DataFrame, spectra: DataFrame) -> DataFrame:
    """Per run: which of the three signals fired. ``spectra`` is ``(run, spectral_entropy, frequency_concentration)``."""
    both = tail_variance(curves).join(spectra, "run")
    loss = (F.col("points") > 3) & (F.col("tail_variance") > LOSS_VARIANCE_LIMIT)
    entropy, peak = F.col("spectral_entropy") < ENTROPY_LIMIT, F.col("frequency_concentration") > CONCENTRATION_LIMIT
    return both.select("run", "tail_variance", (loss | entropy | peak).alias("collapsed"))


def output_spectra(outputs: DataFrame) -> DataFrame:
    """Per run from ``(run, output array)``: energy, softmax entropy, frequency concentration and variance.

    Every row is reduced to a few sums on its own; runs of any size then meet in an ordinary aggregate.
    """
    import numpy as np
    import pandas as pd

    def peaks(batches):
        for pdf in batches:
            power = [np.abs(np.fft.rfft(np.asarray(v, dtype=float))) ** 2 for v in pdf["output"]]
            yield pd.DataFrame({"run": pdf["run"], "output": pdf["output"], "peak": [p.max() for p in power], "power": [p.sum() for p in power], "bins": [len(p) for p in power]})

    kind = outputs.schema["run"].dataType.simpleString()
    rows = outputs.mapInPandas(peaks, f"run {kind}, output array<double>, peak double, power double, bins long")
    total = lambda f: F.aggregate("output", F.lit(0.0), lambda s, x: s + f(x))
    z = total(F.exp)
    entropy = -F.aggregate(F.transform("output", lambda x: F.exp(x)), F.lit(0.0), lambda s, e: s + e / F.col("z") * F.ln(e / F.col("z") + 1e-10))
    per_row = rows.withColumn("z", z).select(
        "run", "peak", "power", "bins", entropy.alias("entropy"), total(lambda x: x).alias("s"), total(lambda x: x * x).alias("q"), F.size("output").alias("n"))
    n, s, q = F.sum("n"), F.sum("s"), F.sum("q")
    return per_row.groupBy("run").agg(
        (q / n).alias("spectral_energy"), F.avg("entropy").alias("spectral_entropy"),
        (F.max("peak") / (F.sum("power") / F.sum("bins"))).alias("frequency_concentration"),
        F.try_divide(q - s * s / n, n - 1).alias("representation_variance"))


def progress(models: DataFrame) -> DataFrame:
    """Per validation from ``(validation_id, done, seconds)``: percent done and seconds left at the mean pace."""
    one = models.groupBy("validation_id").agg(
        F.count("*").alias("models"), F.count_if(F.col("done")).alias("finished"), F.avg(F.when(F.col("done"), F.col("seconds"))).alias("pace"))
    return one.select(
        "validation_id", "models", "finished", (F.col("finished") * 100.0 / F.col("models")).alias("percent"),
        ((F.col("models") - F.col("finished")) * F.col("pace")).alias("seconds_left"))


# Weight of a model's vote by its tier.
TIER_WEIGHTS = {1: 1.0, 2: 2.0, 3: 3.0}


def consensus(models: DataFrame) -> DataFrame:
    """Weighted share of collapsed models per validation; above 70 percent is high risk, with bands at 20 and 50."""
    weight = F.lit(1.0)
    for tier, w in TIER_WEIGHTS.items():
        weight = F.when(F.col("tier") == tier, w).otherwise(weight)
    share = F.sum(F.when(F.col("collapsed"), weight).otherwise(0.0)) / F.sum(weight) * 100
    one = models.groupBy("validation_id").agg(share.alias("consensus"))
    return one.withColumn("high_risk", F.col("consensus") > 70).withColumn(
        "band", F.when(F.col("consensus") < 20, "low").when(F.col("consensus") < 50, "medium").otherwise("high"))


def scaling_law(points: DataFrame, by: str, floors: int = 10) -> DataFrame:
    """Per group: A, B, C and fit of ``loss = A * size^B + C``.

    Every point enters once per trial floor C (a share of the group's smallest loss); the floor with the best
    log-log fit wins. Regressions are partial sums, so a group may have any size.
    """
    least = points.groupBy(by).agg(F.min("loss").alias("least"))
    shares = F.explode(F.array(*[F.lit(i / floors) for i in range(floors)]))
    y = F.ln(F.col("loss") - F.col("least") * F.col("share"))
    x = F.ln("size")
    fits = (
        points.join(least, by).select("*", shares.alias("share")).filter(F.col("loss") > F.col("least") * F.col("share"))
        .select(by, "share", "least", x.alias("x"), y.alias("y")).groupBy(by, "share")
        .agg(F.max("least").alias("least"), F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("ln_a"), F.regr_r2("y", "x").alias("r2"))
    )
    best = fits.filter("r2 IS NOT NULL").groupBy(by).agg(F.max_by(F.struct("share", "least", "b", "ln_a", "r2"), F.struct("r2", -F.col("share"))).alias("f"))
    return best.select(by, F.exp("f.ln_a").alias("a"), F.col("f.b").alias("b"), (F.col("f.share") * F.col("f.least")).alias("c"), F.col("f.r2").alias("r2"))


def extrapolate(laws: DataFrame, by: str, sizes: list[float]) -> DataFrame:
    at = F.explode(F.array(*[F.lit(float(s)) for s in sizes]))
    return laws.select("*", at.alias("size")).select(by, "size", (F.col("a") * F.pow("size", F.col("b")) + F.col("c")).alias("predicted"))


def prediction_error(predicted: DataFrame, actual: DataFrame, key: str, by: str) -> DataFrame:
    """Mean absolute error and bias of predictions against outcomes, per group."""
    both = predicted.join(actual, key)
    diff = F.col("predicted") - F.col("actual")
    return both.groupBy(by).agg(F.count("*").alias("n"), F.avg(F.abs(diff)).alias("mae"), F.avg(diff).alias("bias"))


def capacity_ladder(df: DataFrame, features: list[str], label: str, depths: list[int], variants: int, seed: int = 42) -> DataFrame:
    """The same data, models of growing capacity, several subsamples each: one metrics row per model.

    Subsamples are disjoint hash parts, so every row trains one variant and tests the others.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    part = F.pmod(F.xxhash64(F.lit(seed), *features, label), F.lit(variants))
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(df.select(*features, F.col(label).alias("label"), part.alias("part")))
    models = []
    judged = rows
    for v in range(variants):  # a grid of a few models, each fit a distributed job
        # a fit reads its rows several times, so they stay on the executors until all depths are done; a lost part is computed again
        mine = rows.filter(F.col("part") == v).select("features", "label").persist()
        for depth in depths:
            model = DecisionTreeRegressor(maxDepth=depth, labelCol="label", predictionCol=f"p{len(models)}", seed=seed).fit(mine)
            models.append((depth, v, model.numNodes))
            judged = model.transform(judged)
        mine.unpersist()
    # all models are judged in one scan
    loss = lambda i, mine: F.sqrt(F.avg(F.when(mine, F.pow(F.col("label") - F.col(f"p{i}"), 2))))
    one = judged.agg(*[loss(i, (F.col("part") == v) == F.lit(train)).alias(f"{name}{i}") for i, (_, v, _) in enumerate(models) for name, train in (("train", True), ("test", False))]).first()
    number = lambda x: float("nan") if x is None else x
    out = [(*m, number(one[f"train{i}"]), number(one[f"test{i}"])) for i, m in enumerate(models)]
    return df.sparkSession.createDataFrame(out, "capacity int, variant int, nodes int, train_loss double, test_loss double")
