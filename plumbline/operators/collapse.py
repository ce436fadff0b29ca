"""Two-sample comparison of a synthetic table with its original.

``pair`` frames carry a ``side`` column (``original``/``synthetic``) next to the features.
``cells`` frames are ``(col, val, n_syn, n_orig)``: either one row per value (counted) or per
input cell; every histogram works on both. Rank statistics work on counted cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.tails import chi_square_p, normal_two_sided
from plumbline.operators.column_stats import correlations
from plumbline.operators.longform import bucket_edges, numeric_columns, running_counts, scrub, to_long, value_counts
from plumbline.operators.sequences import positions

EPS = 1e-10
# Bins of the histograms.
FIDELITY_BINS = 50
CHI_BINS = 20
MI_BINS = 20


def align(synthetic: DataFrame, original: DataFrame, cap: int | None = None) -> tuple[DataFrame, list[str]]:
    """Both sides in one frame, features matched by position and cut to the shorter list."""
    syn, orig = numeric_columns(synthetic), numeric_columns(original)
    k = min(len(syn), len(orig), cap or len(orig))
    a = synthetic.select(F.lit("synthetic").alias("side"), *[F.col(s).cast("double").alias(o) for s, o in zip(syn[:k], orig[:k])])
    b = original.select(F.lit("original").alias("side"), *[F.col(o).cast("double").alias(o) for o in orig[:k]])
    return a.unionByName(b), orig[:k]


def is_syn() -> Column:
    return F.col("side") == "synthetic"


def is_orig() -> Column:
    return F.col("side") == "original"


def cells(pair: DataFrame, cols: list[str]) -> DataFrame:
    return to_long(pair, cols, ["side"]).select("col", "val", is_syn().cast("bigint").alias("n_syn"), is_orig().cast("bigint").alias("n_orig"))


def counted_cells(pair: DataFrame, cols: list[str]) -> DataFrame:
    return value_counts(to_long(pair, cols, ["side"]), n_syn=is_syn(), n_orig=is_orig())


def rank_table(pair: DataFrame, cols: list[str], buckets: int | None = None) -> DataFrame:
    return running_counts(counted_cells(pair, cols), ["n_syn", "n_orig"], bucket_edges(pair, cols, buckets))


# ---------------------------------------------------------------- rank statistics


SHIFT = 10  # terms taken one by one before the series, which then is good to 12 digits


def harmonic(n: Column) -> Column:
    """Sum of 1/i for i below n, by the series of the digamma function at n + SHIFT."""
    m = n - 1.0
    x = m + float(SHIFT)
    series = F.ln(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)
    return series - sum((1 / (m + float(i)) for i in range(1, SHIFT + 1)), F.lit(0.0))


def harmonic_pairs(n: Column, h: Column | None = None) -> Column:
    """The double sum of 1/((n-i) j) over 1 <= i < j < n, which is the sum of 1/i^2 less 2/n times the sum of 1/i, i < n."""
    m = n - 1.0
    x = m + float(SHIFT + 1)
    trigamma = 1 / x + 1 / (2 * x**2) + 1 / (6 * x**3) - 1 / (30 * x**5) + 1 / (42 * x**7) - 1 / (30 * x**9)
    squares = math.pi**2 / 6 - trigamma - sum((1 / (m + float(i)) ** 2 for i in range(1, SHIFT + 1)), F.lit(0.0))
    return squares - 2 * (harmonic(n) if h is None else h) / n


def rank_metrics(ranked: DataFrame) -> DataFrame:
    """Per column: KS, Wasserstein, Mann-Whitney and Anderson-Darling from one scan of the running counts."""
    c = F.col
    n1, n2 = c("tot_n_syn").cast("double"), c("tot_n_orig").cast("double")
    total = n1 + n2
    gap = F.abs(F.try_divide(c("cum_n_syn"), n1) - F.try_divide(c("cum_n_orig"), n2))
    t = (c("n_syn") + c("n_orig")).cast("double")
    below = (c("cum_n_syn") + c("cum_n_orig")).cast("double") - t
    mid = below + t / 2
    denom = mid * (total - mid) - total * t / 4
    term = lambda cum, own, size: F.try_divide(t / total * F.pow(total * (cum - own / 2) - size * mid, 2), denom)
    raw = ranked.groupBy("col").agg(
        F.max(n1).alias("n1"),
        F.max(n2).alias("n2"),
        F.max(gap).alias("ks"),
        F.coalesce(F.sum(gap * (c("next_val") - c("val"))), F.lit(0.0)).alias("w1"),
        (F.max(F.when(c("n_orig") > 0, c("val"))) - F.min(F.when(c("n_orig") > 0, c("val")))).alias("orig_range"),
        F.sum(c("n_syn") * (below + (t + 1) / 2)).alias("rank_sum"),
        F.sum(t * t * t - t).alias("ties"),
        F.count("*").alias("values"),
        F.sum(F.when(denom > 0, term(c("cum_n_syn").cast("double"), c("n_syn"), n1))).alias("a_syn"),
        F.sum(F.when(denom > 0, term(c("cum_n_orig").cast("double"), c("n_orig"), n2))).alias("a_orig"),
    )
    n1, n2, total = c("n1"), c("n2"), c("n1") + c("n2")
    # columns of their own, since the deviation uses both sums many times
    raw = raw.withColumn("_h", harmonic(total)).withColumn("_g", harmonic_pairs(total, c("_h")))
    u1 = c("rank_sum") - n1 * (n1 + 1) / 2
    u = F.greatest(u1, n1 * n2 - u1)
    spread = F.sqrt(n1 * n2 / 12 * ((total + 1) - c("ties") / (total * (total - 1))))
    z = F.try_divide(u - n1 * n2 / 2 - 0.5, spread)
    a2 = (total - 1) / total * (c("a_syn") / n1 + c("a_orig") / n2)
    return (
        raw.withColumn("w1_similarity", 1 - F.least(F.lit(1.0), c("w1") / (c("orig_range") + 1e-8)))
        .withColumn("u", u)
        .withColumn("z", z)
        .withColumn("a2", a2)
        .withColumn("ad", F.when(c("values") > 1, F.try_divide(c("a2") - 1, ad_sigma(total))))
        .withColumn("ad_score", F.coalesce(100 * F.exp(-c("ad") / 10), F.lit(50.0)))
        .withColumn("ks_similarity", 1 - c("ks"))
        .drop("a_syn", "a_orig", "rank_sum", "_h", "_g")
    )


def ad_sigma(total: Column) -> Column:
    """Standard deviation of the two-sample statistic (Scholz and Stephens, 1987) from both sizes and their harmonic sums ``_h`` and ``_g``."""
    n1, n2 = F.col("n1"), F.col("n2")
    inv = 1 / n1 + 1 / n2
    h, g = F.col("_h"), F.col("_g")
    k = 2.0
    a = (4 * g - 6) * (k - 1) + (10 - 6 * g) * inv
    b = (2 * g - 4) * k * k + 8 * h * k + (2 * g - 14 * h - 4) * inv - 8 * h + 4 * g - 6
    c = (6 * h + 2 * g - 2) * k * k + (4 * h - 4 * g + 6) * k + (2 * h - 6) * inv + 4 * h
    d = (2 * h + 6) * k * k - 4 * h * k
    n = total
    poly = ((a * n + b) * n + c) * n + d
    return F.sqrt(F.greatest(F.try_divide(poly, (n - 1) * (n - 2) * (n - 3)), F.lit(0.0)))


def with_p_values(metrics: DataFrame) -> DataFrame:
    """Mann-Whitney p-value; identical pooled values give 1."""
    return metrics.withColumn("mw_p", F.coalesce(normal_two_sided(F.col("z")), F.lit(1.0)))


# ---------------------------------------------------------------- histograms


def ranges(cell: DataFrame) -> DataFrame:
    """Extremes of both sides, one row per column."""
    v, syn, orig = F.col("val"), F.col("n_syn") > 0, F.col("n_orig") > 0
    return cell.groupBy("col").agg(
        F.min(F.when(syn, v)).alias("lo_syn"), F.max(F.when(syn, v)).alias("hi_syn"),
        F.min(F.when(orig, v)).alias("lo_orig"), F.max(F.when(orig, v)).alias("hi_orig"),
    )


def bin_index(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin with a closed last edge; null outside the range; a flat range is widened by half."""
    flat = lo == hi
    a, b = F.when(flat, lo - 0.5).otherwise(lo), F.when(flat, hi + 0.5).otherwise(hi)
    i = F.least(F.floor((x - a) / (b - a) * bins).cast("int"), F.lit(bins - 1))
    return F.when((x >= a) & (x <= b), i)


def joint_bins(cell: DataFrame) -> DataFrame:
    """All histograms in one pass: counts per column and combination of bins (a few hundred rows per column).

    ``b_fid``: 50 bins on the synthetic range. ``b_own_*``/``b_chi_*``: 50 and 20 bins on each side's own range.
    """
    v = F.col("val")
    lo_s, hi_s, lo_o, hi_o = (F.col(c) for c in ("lo_syn", "hi_syn", "lo_orig", "hi_orig"))
    r = ranges(cell)  # one row per column
    return (
        cell.join(F.broadcast(r), "col")
        .groupBy(
            "col",
            bin_index(v, lo_s, hi_s, FIDELITY_BINS).alias("b_fid"),
            bin_index(v, lo_o, hi_o, FIDELITY_BINS).alias("b_own_orig"),
            bin_index(v, lo_s, hi_s, CHI_BINS).alias("b_chi_syn"),
            bin_index(v, lo_o, hi_o, CHI_BINS).alias("b_chi_orig"),
        )
        .agg(F.sum("n_syn").alias("n_syn"), F.sum("n_orig").alias("n_orig"))
    )


def totals_per_column(binned: DataFrame, *names: str) -> DataFrame:
    w = Window.partitionBy("col")
    return binned.select("*", *[F.sum(n).over(w).alias(f"tot_{n}") for n in names], F.count("*").over(w).alias("filled"))


def fidelity_bins(joint: DataFrame) -> DataFrame:
    return joint.filter("b_fid IS NOT NULL").groupBy("col", F.col("b_fid").alias("bin")).agg(
        F.sum("n_syn").alias("n_syn"), F.sum("n_orig").alias("n_orig"))


def intersection_and_kl(bins: DataFrame, n_bins: int = FIDELITY_BINS) -> DataFrame:
    """Histogram intersection, KL and Jensen-Shannon divergence. Bins without rows enter in closed form."""
    t = totals_per_column(bins, "n_syn", "n_orig")
    p = F.col("n_syn") / (F.col("tot_n_syn") + EPS)
    q = F.col("n_orig") / (F.col("tot_n_orig") + EPS)
    sum_p = F.col("tot_n_syn") / (F.col("tot_n_syn") + EPS) + n_bins * EPS
    sum_q = F.col("tot_n_orig") / (F.col("tot_n_orig") + EPS) + n_bins * EPS
    pn, qn = (p + EPS) / sum_p, (q + EPS) / sum_q
    m = (pn + qn) / 2
    js = (pn * F.ln(pn / m) + qn * F.ln(qn / m)) / 2
    empty = n_bins - F.max("filled")
    pe, qe = EPS / F.max(sum_p), EPS / F.max(sum_q)
    return t.groupBy("col").agg(
        F.sum(F.least(p, q)).alias("intersection"),
        (F.sum(pn * F.ln(pn / qn)) + empty * pe * F.ln(pe / qe)).alias("kl"),
        F.sum(js).alias("js"),
    )


def entropy_of(n: Column, total: Column, n_bins: int) -> Column:
    """Aggregate: entropy of bin counts with a tiny mass in every bin, empty ones included."""
    p = (n + EPS) / (total + n_bins * EPS)
    pe = EPS / (F.max(total) + n_bins * EPS)
    return -(F.sum(p * F.ln(p)) + (n_bins - F.count("*")) * pe * F.ln(pe))


def entropies(joint: DataFrame, n_bins: int = FIDELITY_BINS) -> DataFrame:
    """Entropy of each side on its own range and their ratio, per column."""
    parts = []
    for name, b in (("n_syn", "b_fid"), ("n_orig", "b_own_orig")):
        per = joint.filter(F.col(name) > 0).groupBy("col", F.col(b).alias("bin")).agg(F.sum(name).alias("n"))
        total = F.sum("n").over(Window.partitionBy("col"))
        parts.append(per.withColumn("total", total).groupBy("col").agg(entropy_of(F.col("n"), F.col("total"), n_bins).alias(f"h_{name[2:]}")))
    return parts[0].join(parts[1], "col").withColumn("ratio", F.col("h_syn") / (F.col("h_orig") + EPS))


def chi_square(joint: DataFrame, n_bins: int = CHI_BINS) -> DataFrame:
    """Chi-square of both sides' own-range bins matched by position; expected counts scaled to the observed total."""
    side = lambda n, b: joint.filter(F.col(n) > 0).groupBy("col", F.col(b).alias("bin")).agg(F.sum(n).alias(n))
    both = side("n_syn", "b_chi_syn").join(side("n_orig", "b_chi_orig"), ["col", "bin"], "full_outer").na.fill(0, ["n_syn", "n_orig"])
    t = totals_per_column(both, "n_syn", "n_orig")
    scale = (F.col("tot_n_syn") + n_bins) / (F.col("tot_n_orig") + n_bins)
    expected = (F.col("n_orig") + 1) * scale
    empty = (n_bins - F.max("filled")) * F.pow(1 - F.max(scale), 2) / F.max(scale)
    return t.groupBy("col").agg((F.sum(F.pow(F.col("n_syn") + 1 - expected, 2) / expected) + empty).alias("chi2"))


def with_chi_p(stat: DataFrame, n_bins: int = CHI_BINS) -> DataFrame:
    return stat.withColumn("chi_p", chi_square_p(F.col("chi2"), F.lit(n_bins - 1)))


# ---------------------------------------------------------------- moments, correlations, information


def moment_match(pair: DataFrame, cols: list[str]) -> DataFrame:
    """Absolute differences of mean and deviation per column."""
    v = F.col("val")
    m = to_long(pair, cols, ["side"]).groupBy("col").agg(
        F.avg(F.when(is_syn(), v)).alias("mean_syn"), F.avg(F.when(is_orig(), v)).alias("mean_orig"),
        F.stddev_samp(F.when(is_syn(), v)).alias("std_syn"), F.stddev_samp(F.when(is_orig(), v)).alias("std_orig"))
    return m.withColumn("mean_diff", F.abs(F.col("mean_syn") - F.col("mean_orig"))).withColumn(
        "std_diff", F.abs(F.col("std_syn") - F.col("std_orig")))


def correlation_pairs(pair: DataFrame, cols: list[str]) -> DataFrame:
    """``(i, j, r_syn, r_orig)`` for i < j: at most columns squared rows."""
    r = correlations(pair, cols, ["side"])
    return r.groupBy("i", "j").agg(F.max(F.when(is_syn(), F.col("r"))).alias("r_syn"), F.max(F.when(is_orig(), F.col("r"))).alias("r_orig"))


def per_column(pair: DataFrame, cols: list[str], buckets: int | None = None) -> DataFrame:
    """All measures that compare column with column, one row each.

    Value counts are shuffled once and feed the ranks and all histograms of this plan.
    """
    counts = counted_cells(pair, cols)
    ranked = running_counts(counts, ["n_syn", "n_orig"], bucket_edges(pair, cols, buckets))
    joint = joint_bins(counts)
    return (
        rank_metrics(ranked)
        .join(intersection_and_kl(fidelity_bins(joint)), "col")
        .join(entropies(joint), "col")
        .join(chi_square(joint), "col")
        .join(moment_match(pair, cols), "col")
    )


def correlation_metrics(pairs: DataFrame, moments: DataFrame, n_cols: int) -> DataFrame:
    """One row: Frobenius similarity, correlation of correlations, top pairs kept."""
    n_pairs = n_cols * (n_cols - 1) // 2
    a, b = F.col("r_syn"), F.col("r_orig")
    live = lambda s: F.when(F.col(s) > 1e-12, 1.0).otherwise(0.0)
    diag = moments.agg(F.struct(F.sum(F.pow(live("std_syn") - live("std_orig"), 2)).alias("d2"), F.sum(live("std_orig")).alias("o2"))).scalar()
    flat = (F.stddev_pop(a) < 1e-9) | (F.stddev_pop(b) < 1e-9)
    r = F.coalesce(F.when(flat, 0.0).otherwise(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))), F.lit(0.0))
    whole = pairs.agg(F.coalesce(F.sum(F.pow(a - b, 2)), F.lit(0.0)).alias("p2"), F.coalesce(F.sum(b * b), F.lit(0.0)).alias("q2"), r.alias("r"))
    k = min(n_pairs, max(10, n_pairs // 10))
    kept = top_pairs_kept(pairs, k).scalar() if n_pairs > 10 else None
    one = whole.withColumn("diag", diag)
    distance = F.sqrt(2 * F.col("p2") + F.col("diag.d2"))
    norm = F.sqrt(2 * F.col("q2") + F.col("diag.o2"))
    return one.select(
        (100 * (1 - F.least(F.lit(1.0), distance / (norm + 1e-8)))).alias("frobenius_similarity"),
        (F.lit(100.0) if n_pairs <= 1 else (F.col("r") + 1) / 2 * 100).alias("correlation_of_correlations"),
        (F.lit(100.0) if kept is None else kept * 100.0 / k).alias("top_correlations_preserved"),
    )


def top_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """Whether a pair is among the k strongest on each side; ties go to the lower pair.

    Places are counted in buckets of strength, so the pairs of a wide table stay spread over tasks.
    """
    out = pairs.select("i", "j", "r_syn", "r_orig", (-F.abs("r_syn")).alias("_syn"), (-F.abs("r_orig")).alias("_orig"))
    for side in ("syn", "orig"):
        out = positions(out, [], [f"_{side}", "i", "j"], f"_at_{side}")
    return out.select("i", "j", "r_syn", "r_orig", *[(F.col(f"_at_{side}") < k).alias(f"in_{side}") for side in ("syn", "orig")])


def top_pairs_kept(pairs: DataFrame, k: int) -> DataFrame:
    return top_pairs(pairs, k).agg(F.count_if(F.col("in_syn") & F.col("in_orig")).alias("kept"))


def mutual_information(pair: DataFrame, cols: list[str], bins: int = MI_BINS) -> DataFrame:
    """Binned mutual information of each feature with the next, per side, over all rows.

    The pair counts are one aggregate of at most columns x bins squared rows per side.
    """
    n = len(cols)
    clean = pair.select("side", *[F.coalesce(scrub(F.col(c)), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(cols)])
    lim = clean.groupBy("side").agg(*[f(f"x{i}").alias(f"{t}{i}") for i in range(n) for t, f in (("lo", F.min), ("hi", F.max))])
    placed = clean.join(F.broadcast(lim), "side").select(  # two rows
        "side", *[bin_index(F.col(f"x{i}"), F.col(f"lo{i}"), F.col(f"hi{i}"), bins).alias(f"b{i}") for i in range(n)])
    hits = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"b{i}").alias("bi"), F.col(f"b{(i + 1) % n}").alias("bj")) for i in range(n)])
    joint = placed.select("side", F.inline(hits)).groupBy("side", "i", "bi", "bj").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("side", "i")
    rows, cols_ = Window.partitionBy("side", "i", "bi"), Window.partitionBy("side", "i", "bj")
    t = joint.select("side", "i", F.col("n").cast("double").alias("n"), F.sum("n").over(whole).alias("t"), F.sum("n").over(rows).alias("a"), F.sum("n").over(cols_).alias("b"))
    info = t.groupBy("side", "i").agg(F.greatest(F.lit(0.0), F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("a").cast("double") * F.col("b"))))).alias("mi"))
    both = info.groupBy("i").agg(F.max(F.when(is_syn(), F.col("mi"))).alias("mi_syn"), F.max(F.when(is_orig(), F.col("mi"))).alias("mi_orig"))
    score = F.when(F.col("mi_orig") > 1e-6, 100 * F.exp(-F.abs(F.col("mi_syn") / (F.col("mi_orig") + EPS) - 1))).otherwise(100.0)
    return both.withColumn("mi_score", score)


# ---------------------------------------------------------------- verdict rules


def severity(score: Column, threshold: Column) -> Column:
    return F.when(score >= threshold, "ok").when(score >= threshold * 0.8, "warning").otherwise("critical")


def api_severity(score: Column) -> Column:
    return F.when(score >= 80, "low").when(score >= 60, "medium").otherwise("high")


# Pass marks per dimension and the mark for the mean of all eight.
THRESHOLDS = {
    "distribution_fidelity": 70.0,
    "correlation_preservation": 70.0,
    "entropy_stability": 65.0,
    "gradient_health": 60.0,
    "loss_landscape": 65.0,
    "spectral_coherence": 70.0,
    "generalization_gap": 75.0,
    "statistical_consistency": 70.0,
}
OVERALL_THRESHOLD = 65.0
# Weights of the metrics inside each dimension.
WEIGHTS = {
    "distribution_fidelity": {"ks_similarity": 0.20, "wasserstein_similarity": 0.20, "mean_match": 0.15, "std_match": 0.15,
                              "histogram_intersection": 0.15, "kl_similarity": 0.15},
    "correlation_preservation": {"frobenius_similarity": 0.4, "correlation_of_correlations": 0.4, "top_correlations_preserved": 0.2},
    "entropy_stability": {"entropy_stability": 0.5, "mutual_information": 0.2, "dimensionality_preservation": 0.3},
    "gradient_health": {"vanishing_check": 0.5, "exploding_check": 0.5},
    "loss_landscape": {"decrease_score": 0.4, "loss_smoothness": 0.3, "convergence_stability": 0.3},
    "spectral_coherence": {"spectral_similarity": 0.4, "dominant_frequency_match": 0.3, "spectral_entropy_score": 0.3},
    "generalization_gap": {"indistinguishability_score": 0.7, "gap_score": 0.3},
    "statistical_consistency": {"chi2_consistency": 0.35, "anderson_darling_score": 0.35, "mann_whitney_pvalue": 0.30},
}


def weighted(dimension: str) -> Column:
    """Score of a dimension from columns named like its metrics."""
    total = F.lit(0.0)
    for metric, w in WEIGHTS[dimension].items():
        total = total + F.col(metric) * w
    return total


def with_neutral(dims: DataFrame, key: str, more: dict[str, float] | None = None) -> DataFrame:
    """Every key gets all eight dimensions and those of ``more``; a missing one scores exactly its threshold.

    Rows that are there stay where they are. Only one row per key is shuffled, which tells the dimensions it has.
    """
    marks = THRESHOLDS | (more or {})
    has = dims.groupBy(key).agg(*[F.coalesce(F.bool_or((F.col("dim_name") == d) & F.col(key).isNotNull()), F.lit(False)).alias(f"has_{i}") for i, d in enumerate(marks)])
    lacks = F.array(*[F.struct(F.lit(d).alias("dim_name"), F.lit(float(t)).alias("threshold"), (~F.col(f"has_{i}")).alias("lacks")) for i, (d, t) in enumerate(marks.items())])
    missing = has.select(key, F.inline(F.filter(lacks, lambda x: x["lacks"]))).select(key, "dim_name", "threshold", F.col("threshold").alias("score"), F.lit(True).alias("neutral"))
    threshold = F.coalesce(*[F.when(F.col("dim_name") == d, float(t)) for d, t in marks.items()])
    given = dims.filter(F.col(key).isNotNull() & F.col("dim_name").isin(*marks)).select(
        key, "dim_name", threshold.alias("threshold"), F.coalesce("score", threshold).alias("score"), F.col("score").isNull().alias("neutral"))
    return given.unionByName(missing)


def judged(dims: DataFrame) -> DataFrame:
    return dims.withColumn("passed", F.col("score") >= F.col("threshold")).withColumn("severity", severity(F.col("score"), F.col("threshold")))


def overall(dims: DataFrame, key: str) -> DataFrame:
    """Mean of the dimensions, verdict and confidence per key."""
    agg = dims.groupBy(key).agg(F.avg("score").alias("overall_score"), F.var_pop("score").alias("variance"))
    return agg.select(
        key, "overall_score", (F.col("overall_score") < OVERALL_THRESHOLD).alias("collapse_detected"),
        F.least(F.lit(100.0), 100 * F.exp(-F.col("variance") / 1000)).alias("confidence"))


def warnings(dims: DataFrame, key: str, more: dict[str, float] | None = None) -> DataFrame:
    """Sorted warning texts per key, for the eight dimensions and those of ``more``.

    One aggregate of a number per text and the mean, so that rows are added up before they are shuffled and no list is collected.
    """
    texts = sorted((f"{word.upper()}: {d}", word, d) for d in THRESHOLDS | (more or {}) for word in ("warning", "critical"))
    counts = [F.count_if((F.col("severity") == word) & (F.col("dim_name") == d)).alias(f"n_{i}") for i, (_, word, d) in enumerate(texts)]
    one = dims.groupBy(key).agg((F.avg("score") < OVERALL_THRESHOLD).alias("collapse_detected"), *counts)
    lead = F.array_repeat(F.lit("COLLAPSE DETECTED"), F.coalesce(F.col("collapse_detected"), F.lit(False)).cast("int"))
    every = F.flatten(F.array(lead, *[F.array_repeat(F.lit(text), F.col(f"n_{i}").cast("int")) for i, (text, _, _) in enumerate(texts)]))
    return one.select(key, every.alias("warnings")).withColumn("warnings", F.when(F.size("warnings") == 0, F.array(F.lit("ALL PASSED"))).otherwise(F.col("warnings")))


# Training scales and the share of the score kept at each.
SCALES = {"10x": 0.95, "100x": 0.9025}


def at_scale(dims: DataFrame, key: str) -> DataFrame:
    steps = F.array(*[F.struct(F.lit(n).alias("scale"), F.lit(f).alias("factor")) for n, f in SCALES.items()])
    return dims.select(key, "dim_name", "score", F.inline(steps)).select(key, "dim_name", "scale", (F.col("score") * F.col("factor")).alias("predicted"))


def input_gate(df: DataFrame, cols: list[str], min_rows: int = 2, min_cols: int = 1, max_rows: int | None = None) -> DataFrame:
    """One verdict row: cell counts, NaN and infinity shares, and the first rule broken."""
    n = len(cols)
    count_all = lambda test: sum((F.count_if(test(F.col(c).cast("double"))) for c in cols), F.lit(0))
    inf = lambda c: F.abs(c) == float("inf")
    one = df.agg(F.count("*").alias("rows"), count_all(lambda c: F.coalesce(F.isnan(c), F.lit(False)) | c.isNull()).alias("nan_cells"), count_all(inf).alias("inf_cells"))
    size = F.col("rows") * n
    broken = (
        F.when((F.col("rows") == 0) | F.lit(n == 0), "empty")
        .when(F.try_divide(F.col("nan_cells"), size) > 0.5, "too_many_nan")
        .when(F.try_divide(F.col("inf_cells"), size) > 0.1, "too_many_inf")
        .when(F.col("rows") < min_rows, "too_few_rows")
        .when(F.lit(n < min_cols), "too_few_columns")
        .when(F.lit(max_rows is not None) & (F.col("rows") > F.lit(max_rows or 0)), "too_many_rows")
        .otherwise("ok")
    )
    return one.withColumn("columns", F.lit(n)).withColumn("verdict", broken)


def require_valid(df: DataFrame, cols: list[str], **limits) -> None:
    verdict = input_gate(df, cols, **limits).first()["verdict"]
    if verdict != "ok":
        raise ValueError(f"input rejected: {verdict}")


# ---------------------------------------------------------------- stability over bins


def side_histograms(pair: DataFrame, cols: list[str], bins: int) -> DataFrame:
    """``(col, expected, actual)``: counts per bin on the original's range, values outside in the end bins.

    Counted per bin before the arrays are built, so an array is made of ``bins`` rows at most.
    """
    cell = cells(pair, cols)
    limits = cell.groupBy("col").agg(F.min(F.when(F.col("n_orig") > 0, F.col("val"))).alias("lo"), F.max(F.when(F.col("n_orig") > 0, F.col("val"))).alias("hi"))
    width = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1.0))
    place = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("val") - F.col("lo")) / width * bins).cast("int")))
    counts = cell.join(F.broadcast(limits), "col").groupBy("col", place.alias("bin")).agg(F.sum("n_orig").alias("o"), F.sum("n_syn").alias("s"))  # one row per column
    table = F.map_from_entries(F.collect_list(F.struct("bin", F.struct("o", "s").alias("n"))))
    slots = F.sequence(F.lit(0), F.lit(bins - 1))
    read = lambda name: F.transform(slots, lambda i: F.coalesce(F.col("t")[i][name], F.lit(0)).cast("bigint"))
    return counts.groupBy("col").agg(table.alias("t")).select("col", read("o").alias("expected"), read("s").alias("actual"))
