"""The eight-dimension collapse scorecard of two tables."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from plumbline import roles
from plumbline.operators import collapse as cd
from plumbline.operators import learned, runs, spectral


def distribution_of(per_col: DataFrame) -> DataFrame:
    one = per_col.agg(
        (F.avg("ks_similarity") * 100).alias("ks_similarity"),
        (F.avg("w1_similarity") * 100).alias("wasserstein_similarity"),
        (100 * F.exp(-F.avg("mean_diff"))).alias("mean_match"),
        (100 * F.exp(-F.avg("std_diff"))).alias("std_match"),
        (F.avg("intersection") * 100).alias("histogram_intersection"),
        (100 * F.exp(-F.avg("kl"))).alias("kl_similarity"),
    )
    return one.withColumn("score", cd.weighted("distribution_fidelity"))


def distribution_fidelity(pair: DataFrame, cols: list[str]) -> DataFrame:
    """One row of metrics and the weighted score."""
    return distribution_of(cd.per_column(pair, cols))


def correlation_preservation(pair: DataFrame, cols: list[str]) -> DataFrame:
    m = cd.correlation_metrics(cd.correlation_pairs(pair, cols), cd.moment_match(pair, cols), len(cols))
    return m.withColumn("score", cd.weighted("correlation_preservation"))


def entropy_of(entropies: DataFrame, info: float, dims: dict[str, float]) -> DataFrame:
    one = entropies.agg(F.avg("ratio").alias("entropy_ratio"))
    return one.select(
        "entropy_ratio", (100 * F.exp(-F.abs(F.col("entropy_ratio") - 1))).alias("entropy_stability"), F.lit(info).alias("mutual_information"),
        *[F.lit(v).alias(k) for k, v in dims.items()]).withColumn("score", cd.weighted("entropy_stability"))


def information_score(pair: DataFrame, cols: list[str]) -> float:
    """Mean over the features; 85 if there is nothing to compare."""
    mean = cd.mutual_information(pair, cols).agg(F.avg("mi_score").alias("m")).first()["m"] if len(cols) > 1 else None
    return 85.0 if mean is None else mean


def entropy_stability(pair: DataFrame, cols: list[str]) -> DataFrame:
    ratios = cd.entropies(cd.joint_bins(cd.cells(pair, cols)))
    return entropy_of(ratios, information_score(pair, cols), learned.dimension_metrics(learned.spectra(pair, cols, "side")))


def consistency_of(per_col: DataFrame) -> DataFrame:
    one = cd.with_p_values(cd.with_chi_p(per_col)).agg(
        (F.avg("chi_p") * 100).alias("chi2_consistency"), F.avg("ad_score").alias("anderson_darling_score"), (F.avg("mw_p") * 100).alias("mann_whitney_pvalue"))
    return one.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), cd.weighted("statistical_consistency"))))


def statistical_consistency(pair: DataFrame, cols: list[str]) -> DataFrame:
    counts = cd.counted_cells(pair, cols)
    ranks = cd.rank_metrics(cd.rank_table(pair, cols)).select("col", "ad_score", "z")
    return consistency_of(ranks.join(cd.chi_square(cd.joint_bins(counts)), "col"))


def spectral_coherence(series: DataFrame, cols: list[str], row_id: str, block: int) -> DataFrame:
    m = spectral.spectral_metrics(spectral.compare_spectra(spectral.power_bins(spectral.blocks(series, cols, row_id, block), block)))
    return m.withColumn("score", cd.weighted("spectral_coherence"))


def generalization_gap(pair: DataFrame, cols: list[str]) -> DataFrame:
    return learned.classifier_test(pair, cols).withColumn("score", cd.weighted("generalization_gap"))


def gradient_dimension(norms: DataFrame) -> DataFrame:
    """Health of all gradients together."""
    return runs.gradient_health(norms.withColumn("run", F.lit(0))).drop("run")


def loss_dimension(curve: DataFrame) -> DataFrame:
    return runs.loss_landscape(curve.withColumn("run", F.lit(0))).drop("run")


#: Up to so many column pairs come to the driver as one small table; more stay distributed.
MOST_PAIRS = 4096
DIMENSION_ROW = "dim_name string, score double, metrics map<string,double>"


def as_row(name: str, one: Row) -> tuple[str, float, dict[str, float]]:
    """Metrics stay as they are; a dimension's score is kept within 0 and 100, so that one cannot swamp the mean."""
    metrics = {k: None if v is None else float(v) for k, v in one.asDict().items() if k != "score"}
    return name, min(100.0, max(0.0, float(one["score"]))), metrics


def scorecard(
    pair: DataFrame,
    cols: list[str],
    series: tuple[DataFrame, list[str], str, int] | None = None,
    gradients: DataFrame | None = None,
    losses: DataFrame | None = None,
    extra: dict[str, tuple[float, Callable[[DataFrame, list[str]], DataFrame]]] | None = None,
) -> DataFrame:
    """Eight dimension rows, those of ``extra``, and an ``overall`` row.

    ``extra`` names further dimensions: a pass mark and a function from the pair to one row of metrics with a ``score``.

    The dimensions are independent Spark jobs, submitted together so that they share the cluster; each
    brings one row of numbers back. ``series`` is a pair with its columns, row order and block length for the spectral
    dimension; without it, gradients or losses the dimension is neutral.
    """
    spark = pair.sparkSession

    def columns() -> DataFrame:
        table = cd.per_column(pair, cols)
        return spark.createDataFrame(table.collect(), table.schema)  # one row per column

    def pairs_of_columns() -> DataFrame:
        found = cd.correlation_pairs(pair, cols)
        if len(cols) * (len(cols) - 1) // 2 > MOST_PAIRS:
            return found.persist()  # stays on the executors; a lost part is computed again
        return spark.createDataFrame([tuple(r) for r in found.collect()], "i int, j int, r_syn double, r_orig double")

    work: dict[str, Callable[[], Any]] = {
        "columns": columns,
        "spectra": lambda: learned.spectra(pair, cols, "side"),
        "pairs": pairs_of_columns,
        "information": lambda: information_score(pair, cols),
        "generalization_gap": lambda: generalization_gap(pair, cols).first(),
    }
    if series is not None:
        work["spectral_coherence"] = lambda: spectral_coherence(*series).first()
    if gradients is not None:
        work["gradient_health"] = lambda: gradient_dimension(gradients).first()
    if losses is not None:
        work["loss_landscape"] = lambda: loss_dimension(losses).first()
    for name, (_, measure) in (extra or {}).items():
        work[name] = lambda measure=measure: measure(pair, cols).first()
    with ThreadPoolExecutor(len(work)) as pool:
        running = {name: pool.submit(inheritable_thread_target(spark)(job)) for name, job in work.items()}
        done = {name: job.result() for name, job in running.items()}

    per_col, found_spectra = done.pop("columns"), done.pop("spectra")
    pairs = done.pop("pairs")
    done["distribution_fidelity"] = distribution_of(per_col).first()
    done["statistical_consistency"] = consistency_of(per_col).first()
    done["entropy_stability"] = entropy_of(per_col, done.pop("information"), learned.dimension_metrics(found_spectra)).first()
    done["correlation_preservation"] = cd.correlation_metrics(pairs, per_col, len(cols)).withColumn("score", cd.weighted("correlation_preservation")).first()
    pairs.unpersist()
    found = spark.createDataFrame([as_row(name, one) for name, one in done.items() if one is not None], DIMENSION_ROW)
    found = found.withColumn("validation_id", F.lit(0))
    marks = {name: mark for name, (mark, _) in (extra or {}).items()}
    dims = cd.judged(cd.with_neutral(found.select("validation_id", "dim_name", "score"), "validation_id", marks))
    dims = dims.join(found.select("dim_name", "metrics"), "dim_name", "left")
    out = dims.select("dim_name", "score", "threshold", "passed", "severity", F.coalesce("metrics", F.create_map().cast("map<string,double>")).alias("metrics"))
    # the mean of eight rows
    whole = cd.overall(dims, "validation_id").select(
        F.lit("overall").alias("dim_name"), F.col("overall_score").alias("score"), F.lit(cd.OVERALL_THRESHOLD).alias("threshold"),
        (~F.col("collapse_detected")).alias("passed"), cd.api_severity(F.col("overall_score")).alias("severity"),
        F.create_map(F.lit("confidence"), F.col("confidence")).alias("metrics"))
    return out.unionByName(whole)


def line_item_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = roles.pair(spark, sf_dir)
    series = (roles.order_series(spark, sf_dir), ["total", "season"], "row_id", 256)
    gradients = roles.table(spark, sf_dir, "lineitem").select((F.col("l_quantity") * 4).alias("norm"))
    # the monthly mean price stands for a loss curve: one point a month, as steady as a loss after its first epochs
    losses = roles.table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyyMM").cast("long").alias("step")).agg(
        (F.avg("o_totalprice") / 100000).alias("loss"))
    return scorecard(pair, roles.FEATURES, series, gradients, losses)
