"""Two-sample queries: finished line items as the original, open ones as the synthetic side."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import roles
from plumbline.functions import sql_names
from plumbline.operators import collapse as cd
from plumbline.operators import learned, runs, spectral
from plumbline.operators import longform as lf
from plumbline.operators.longform import to_long
from plumbline.operators.sequences import positions
from plumbline.plans.oracle_parts import DIMS, FEATURES, LONG, SERIES, with_
from plumbline.plans.profile import corr_sql, rounded
from plumbline.registry import query

RANKS = """vc AS (SELECT col, val, count(*) FILTER (side = 'synthetic') AS ns, count(*) FILTER (side = 'original') AS no FROM long GROUP BY col, val),
ranks AS (SELECT *, CAST(sum(ns) OVER w AS DOUBLE) AS cs, CAST(sum(no) OVER w AS DOUBLE) AS co, CAST(sum(ns) OVER p AS DOUBLE) AS n1, CAST(sum(no) OVER p AS DOUBLE) AS n2,
  lead(val) OVER (PARTITION BY col ORDER BY val) AS nv, CAST(ns + no AS DOUBLE) AS t
  FROM vc WINDOW w AS (PARTITION BY col ORDER BY val), p AS (PARTITION BY col)),
rank_metrics AS (SELECT col, max(abs(cs / n1 - co / n2)) AS ks, sum(abs(cs / n1 - co / n2) * (nv - val)) AS w1,
  max(CASE WHEN no > 0 THEN val END) - min(CASE WHEN no > 0 THEN val END) AS orig_range FROM ranks GROUP BY col)"""

BINS = """lim AS (SELECT col, min(val) FILTER (side = 'synthetic') AS lo, max(val) FILTER (side = 'synthetic') AS hi,
  min(val) FILTER (side = 'original') AS lo_o, max(val) FILTER (side = 'original') AS hi_o FROM long GROUP BY col),
fid AS (SELECT col, least(CAST(floor((val - lo) / (hi - lo) * 50) AS INTEGER), 49) AS bin, count(*) FILTER (side = 'synthetic') AS ns, count(*) FILTER (side = 'original') AS no
  FROM long JOIN lim USING (col) WHERE val >= lo AND val <= hi GROUP BY col, 2),
grid AS (SELECT col, bin, coalesce(ns, 0) AS ns, coalesce(no, 0) AS no FROM (SELECT col, unnest(range(50)) AS bin FROM lim) LEFT JOIN fid USING (col, bin)),
pq AS (SELECT col, bin, ns / (sum(ns) OVER (PARTITION BY col) + 1e-10) AS p, no / (sum(no) OVER (PARTITION BY col) + 1e-10) AS q FROM grid),
pqn AS (SELECT col, bin, p, q, (p + 1e-10) / sum(p + 1e-10) OVER (PARTITION BY col) AS pn, (q + 1e-10) / sum(q + 1e-10) OVER (PARTITION BY col) AS qn FROM pq),
divergence AS (SELECT col, sum(least(p, q)) AS intersection, sum(pn * ln(pn / qn)) AS kl FROM pqn GROUP BY col)"""

MOMENTS = """moments AS (SELECT col, abs(avg(val) FILTER (side = 'synthetic') - avg(val) FILTER (side = 'original')) AS mean_diff,
  abs(stddev_samp(val) FILTER (side = 'synthetic') - stddev_samp(val) FILTER (side = 'original')) AS std_diff FROM long GROUP BY col)"""

OWN = """own AS (SELECT col, side, least(CAST(floor((val - lo) / (hi - lo) * {n}) AS INTEGER), {n} - 1) AS bin, count(*) AS n FROM (
  SELECT *, min(val) OVER (PARTITION BY col, side) AS lo, max(val) OVER (PARTITION BY col, side) AS hi FROM long) GROUP BY col, side, 3),
own_grid AS (SELECT col, side, bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT col, side FROM own) CROSS JOIN (SELECT unnest(range({n})) AS bin) LEFT JOIN own USING (col, side, bin))"""


@query("cd_01_ks", with_(LONG, RANKS) + "SELECT col, round(ks, 6) AS ks, round(1 - ks, 6) AS ks_similarity FROM rank_metrics")
def cd_01(spark, sf):
    return rounded(cd.rank_metrics(cd.rank_table(roles.pair(spark, sf), FEATURES)).select("col", "ks", "ks_similarity"))


@query("cd_02_wasserstein", with_(LONG, RANKS) + "SELECT col, round(w1, 6) AS w1, round(1 - least(1.0, w1 / (orig_range + 1e-8)), 6) AS w1_similarity FROM rank_metrics")
def cd_02(spark, sf):
    return rounded(cd.rank_metrics(cd.rank_table(roles.pair(spark, sf), FEATURES)).select("col", "w1", "w1_similarity"))


@query("cd_03_moment_match", with_(LONG, MOMENTS) + "SELECT col, round(mean_diff, 6) AS mean_diff, round(std_diff, 6) AS std_diff FROM moments")
def cd_03(spark, sf):
    return rounded(cd.moment_match(roles.pair(spark, sf), FEATURES).select("col", "mean_diff", "std_diff"))


@query("cd_04_histogram_intersection", with_(LONG, BINS) + "SELECT col, round(intersection, 6) AS intersection FROM divergence")
def cd_04(spark, sf):
    j = cd.joint_bins(cd.cells(roles.pair(spark, sf), FEATURES))
    return rounded(cd.intersection_and_kl(cd.fidelity_bins(j)).select("col", "intersection"))


@query("cd_05_kl_divergence", with_(LONG, BINS) + "SELECT col, round(kl, 6) AS kl, round(100 * exp(-kl), 6) AS kl_similarity FROM divergence")
def cd_05(spark, sf):
    j = cd.joint_bins(cd.cells(roles.pair(spark, sf), FEATURES))
    kl = cd.intersection_and_kl(cd.fidelity_bins(j)).select("col", "kl")
    return rounded(kl.withColumn("kl_similarity", 100 * F.exp(-F.col("kl"))))


@query("smp_05_histogram", with_(LONG, BINS) + "SELECT col, bin, ns AS n_syn, no AS n_orig FROM fid")
def smp_05(spark, sf):
    return cd.fidelity_bins(cd.joint_bins(cd.cells(roles.pair(spark, sf), FEATURES)))


@query("cd_06_distribution_fidelity", with_(LONG, RANKS, BINS, MOMENTS) + """
SELECT round(ks, 6) AS ks_similarity, round(w, 6) AS wasserstein_similarity, round(mm, 6) AS mean_match, round(sm, 6) AS std_match,
  round(hi, 6) AS histogram_intersection, round(kl, 6) AS kl_similarity,
  round(ks * 0.2 + w * 0.2 + mm * 0.15 + sm * 0.15 + hi * 0.15 + kl * 0.15, 6) AS score FROM (
  SELECT avg(1 - ks) * 100 AS ks, avg(1 - least(1.0, w1 / (orig_range + 1e-8))) * 100 AS w, 100 * exp(-avg(mean_diff)) AS mm, 100 * exp(-avg(std_diff)) AS sm,
    avg(intersection) * 100 AS hi, 100 * exp(-avg(kl)) AS kl FROM rank_metrics JOIN divergence USING (col) JOIN moments USING (col))""")
def cd_06(spark, sf):
    from plumbline.plans.scorecard import distribution_fidelity

    return rounded(distribution_fidelity(roles.pair(spark, sf), FEATURES))


CORR = f"""cp AS (SELECT i, j, max(r) FILTER (side = 'synthetic') AS r_syn, max(r) FILTER (side = 'original') AS r_orig FROM (
  {corr_sql('lineitem', "CASE WHEN l_linestatus = 'F' THEN 'original' ELSE 'synthetic' END")}) GROUP BY i, j)"""


@query("cd_07_correlation_preservation", with_(CORR) + """
SELECT round(f, 6) AS frobenius_similarity, round((r + 1) / 2 * 100, 6) AS correlation_of_correlations, 100.0::DOUBLE AS top_correlations_preserved,
  round(f * 0.4 + (r + 1) / 2 * 100 * 0.4 + 100.0 * 0.2, 6) AS score FROM (
  SELECT 100 * (1 - least(1.0, sqrt(2 * sum((r_syn - r_orig) ** 2)) / (sqrt(2 * sum(r_orig * r_orig) + 4) + 1e-8))) AS f, corr(r_syn, r_orig) AS r FROM cp)""")
def cd_07(spark, sf):
    from plumbline.plans.scorecard import correlation_preservation

    return rounded(correlation_preservation(roles.pair(spark, sf), FEATURES))


@query("cd_09_top_pairs", with_(CORR) + """
SELECT i, j, rs <= 3 AS in_syn, ro <= 3 AS in_orig FROM (SELECT i, j, row_number() OVER (ORDER BY abs(r_syn) DESC, i, j) AS rs, row_number() OVER (ORDER BY abs(r_orig) DESC, i, j) AS ro FROM cp)""")
def cd_09(spark, sf):
    return cd.top_pairs(cd.correlation_pairs(roles.pair(spark, sf), FEATURES), 3).select("i", "j", "in_syn", "in_orig")


@query("jon_12_top_pair_overlap", with_(CORR) + """
SELECT count(*) AS kept FROM (SELECT row_number() OVER (ORDER BY abs(r_syn) DESC, i, j) AS rs, row_number() OVER (ORDER BY abs(r_orig) DESC, i, j) AS ro FROM cp) WHERE rs <= 3 AND ro <= 3""")
def jon_12(spark, sf):
    return cd.top_pairs_kept(cd.correlation_pairs(roles.pair(spark, sf), FEATURES), 3)


@query("cd_11_entropy_ratio", with_(LONG, OWN.format(n=50)) + """
SELECT col, round(max(h) FILTER (side = 'synthetic'), 6) AS h_syn, round(max(h) FILTER (side = 'original'), 6) AS h_orig,
  round(max(h) FILTER (side = 'synthetic') / (max(h) FILTER (side = 'original') + 1e-10), 6) AS ratio FROM (
  SELECT col, side, -sum(p * ln(p)) AS h FROM (SELECT col, side, (n + 1e-10) / sum(n + 1e-10) OVER (PARTITION BY col, side) AS p FROM own_grid) GROUP BY col, side) GROUP BY col""")
def cd_11(spark, sf):
    return rounded(cd.entropies(cd.joint_bins(cd.cells(roles.pair(spark, sf), FEATURES))))


def _mi_sql() -> str:
    side = "CASE WHEN l_linestatus = 'F' THEN 'original' ELSE 'synthetic' END"
    binned = ", ".join(
        f"least(CAST(floor(({c} - min({c}) OVER s) / (max({c}) OVER s - min({c}) OVER s) * 20) AS INTEGER), 19) AS b{i}" for i, c in enumerate(FEATURES))
    pairs = " UNION ALL ".join(f"SELECT side, {i} AS i, b{i} AS bi, b{(i + 1) % 4} AS bj FROM b" for i in range(4))
    return f"""WITH b AS (SELECT {side} AS side, {binned} FROM lineitem WINDOW s AS (PARTITION BY {side})),
j AS (SELECT side, i, bi, bj, CAST(count(*) AS DOUBLE) AS n FROM ({pairs}) GROUP BY ALL),
m AS (SELECT side, i, sum(n / t * ln(n * t / (a * b))) AS mi FROM (SELECT side, i, n, sum(n) OVER (PARTITION BY side, i) AS t,
  sum(n) OVER (PARTITION BY side, i, bi) AS a, sum(n) OVER (PARTITION BY side, i, bj) AS b FROM j) GROUP BY side, i)
SELECT i, round(s, 6) AS mi_syn, round(o, 6) AS mi_orig, round(CASE WHEN o > 1e-6 THEN 100 * exp(-abs(s / (o + 1e-10) - 1)) ELSE 100.0 END, 6) AS mi_score
FROM (SELECT i, max(mi) FILTER (side = 'synthetic') AS s, max(mi) FILTER (side = 'original') AS o FROM m GROUP BY i)"""


@query("cd_12_mutual_information", _mi_sql())
def cd_12(spark, sf):
    return rounded(cd.mutual_information(roles.pair(spark, sf), FEATURES))


@query("cd_13_explained_variance")
def cd_13_variance(spark, sf):
    cov = learned.covariances(roles.pair(spark, sf), FEATURES, "side")
    return learned.explained_variance(spark, cov)


@query("cd_13_effective_dimension")
def cd_13(spark, sf):
    return learned.dimension_rows(spark, learned.spectra(roles.pair(spark, sf), FEATURES, "side"))


@query("cd_14_entropy_stability")
def cd_14(spark, sf):
    from plumbline.plans.scorecard import entropy_stability

    return entropy_stability(roles.pair(spark, sf), FEATURES)


@query("cd_15_gradient_health", """
SELECT run, round(m, 6) AS mean_gradient_norm, round(s, 6) AS std_gradient_norm, CASE WHEN m > 1e-5 THEN 100.0 ELSE 50.0 END::DOUBLE AS vanishing_check,
  CASE WHEN m < 100 THEN 100.0 ELSE 50.0 END::DOUBLE AS exploding_check, ((CASE WHEN m > 1e-5 THEN 100.0 ELSE 50.0 END + CASE WHEN m < 100 THEN 100.0 ELSE 50.0 END) / 2)::DOUBLE AS score
FROM (SELECT l_suppkey AS run, avg(l_quantity * 4) AS m, stddev_pop(l_quantity * 4) AS s FROM lineitem GROUP BY l_suppkey)""")
def cd_15(spark, sf):
    n = roles.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("run"), (F.col("l_quantity") * 4).alias("norm"))
    return rounded(runs.gradient_health(n))


def curves(spark, sf):
    return roles.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("step"), (F.col("o_totalprice") / 1000).alias("loss"))


CURVES = "curves AS (SELECT o_custkey AS run, o_orderkey AS step, o_totalprice / 1000 AS loss FROM orders)"


@query("cd_16_loss_landscape", with_(CURVES) + """
SELECT run, round(d, 6) AS loss_decrease, round(least(100.0, d * 100), 6) AS decrease_score, round(sm, 6) AS loss_smoothness, round(st, 6) AS convergence_stability,
  round(least(100.0, d * 100) * 0.4 + sm * 0.3 + st * 0.3, 6) AS score FROM (
  SELECT run, arg_min(loss, step) - arg_max(loss, step) AS d, 100 * (1 - least(1.0, stddev_pop(diff) / (avg(abs(diff)) + 1e-8))) AS sm,
    least(100.0, 100 * (1 - stddev_pop(loss) FILTER (pos >= n - ceil(n / 10)) / (avg(loss) FILTER (pos >= n - ceil(n / 10)) + 1e-8))) AS st
  FROM (SELECT *, loss - lag(loss) OVER (PARTITION BY run ORDER BY step) AS diff, row_number() OVER (PARTITION BY run ORDER BY step) - 1 AS pos, count(*) OVER (PARTITION BY run) AS n FROM curves)
  WHERE n >= 10 GROUP BY run)""")
def cd_16(spark, sf):
    return rounded(runs.loss_landscape(curves(spark, sf)))


@query("win_01_difference_to_previous", with_(CURVES) + "SELECT run, step, row_number() OVER (PARTITION BY run ORDER BY step) - 1 AS pos, round(loss - lag(loss) OVER (PARTITION BY run ORDER BY step), 6) AS diff FROM curves")
def win_01(spark, sf):
    return rounded(runs.loss_diffs(curves(spark, sf)).select("run", "step", "pos", "diff"))


@query("win_02_first_minus_last", with_(CURVES) + "SELECT run, round(arg_min(loss, step) - arg_max(loss, step), 6) AS decrease FROM curves GROUP BY run")
def win_02(spark, sf):
    return rounded(curves(spark, sf).groupBy("run").agg((F.min_by("loss", "step") - F.max_by("loss", "step")).alias("decrease")))


@query("win_03_tail_frame", with_(CURVES) + """
SELECT run, count(*) AS points, round(avg(loss), 8) AS tail_mean FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS back FROM curves) WHERE back <= 5 GROUP BY run""")
def win_03(spark, sf):
    c = curves(spark, sf)
    placed = positions(c, ["run"], ["step"]).join(c.groupBy("run").agg(F.count("*").alias("n")), "run").filter("pos >= n - 5")
    return placed.groupBy("run").agg(F.count("*").alias("points"), F.round(F.avg("loss"), 8).alias("tail_mean"))


@query("win_06_running_distribution", with_(LONG, RANKS) + "SELECT col, val, CAST(cs AS BIGINT) AS cum_n_syn, CAST(co AS BIGINT) AS cum_n_orig, cs + co - t + (t + 1) / 2 AS midrank FROM ranks")
def win_06(spark, sf):
    r = cd.rank_table(roles.pair(spark, sf), FEATURES)
    t = F.col("n_syn") + F.col("n_orig")
    return r.select("col", "val", "cum_n_syn", "cum_n_orig", (F.col("cum_n_syn") + F.col("cum_n_orig") - t + (t + 1) / 2).alias("midrank"))


SPECTRUM = """, placed AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY row_id) - 1 AS pos FROM series),
cells AS (SELECT 'total' AS col, side, pos // 256 AS block, pos % 256 AS t, total AS val FROM placed UNION ALL SELECT 'season', side, pos // 256, pos % 256, season FROM placed),
psd AS (SELECT col, block, side, k, count(*) AS rows, sum(val * cos(2 * pi() * k * t / 256)) ** 2 + sum(val * sin(2 * pi() * k * t / 256)) ** 2 AS psd
  FROM cells, (SELECT unnest(range(129)) AS k) GROUP BY col, block, side, k)"""
COMPARED = SPECTRUM + """,
sides AS (SELECT col, k, sum(psd * rows) FILTER (side = 'synthetic') / sum(rows) FILTER (side = 'synthetic') AS s,
  sum(psd * rows) FILTER (side = 'original') / sum(rows) FILTER (side = 'original') AS o FROM psd GROUP BY col, k),
shares AS (SELECT *, s / sum(s) OVER (PARTITION BY col) AS ps, o / sum(o) OVER (PARTITION BY col) AS po FROM sides),
compared AS (SELECT col, count(*) AS bins, sum(abs(s - o)) AS distance, arg_max(k, s) = arg_max(k, o) AS peak_match,
  -sum(ps * ln(ps + 1e-8)) AS h_syn, -sum(po * ln(po + 1e-8)) AS h_orig FROM shares GROUP BY col)"""
BLOCK = 256


def spectral_bins(spark, sf):
    return spectral.power_bins(spectral.blocks(roles.order_series(spark, sf), ["total", "season"], "row_id", BLOCK), BLOCK)


@query("cd_17_power_spectrum", "WITH " + SERIES + SPECTRUM + "SELECT col, CAST(block AS BIGINT) AS block, side, k, round(psd, 4) AS psd, rows FROM psd")
def cd_17(spark, sf):
    return spectral_bins(spark, sf).withColumn("psd", F.round("psd", 4))


@query("cd_18_spectral_blocks", "WITH " + SERIES + COMPARED + "SELECT col, bins, round(distance, 4) AS distance, peak_match, round(h_syn, 6) AS h_syn, round(h_orig, 6) AS h_orig FROM compared")
def cd_18(spark, sf):
    b = spectral.compare_spectra(spectral_bins(spark, sf))
    return b.withColumns({"distance": F.round("distance", 4), "h_syn": F.round("h_syn", 6), "h_orig": F.round("h_orig", 6)})


@query("cd_20_spectral_coherence", "WITH " + SERIES + COMPARED + """,
one AS (SELECT sum(distance) / sum(bins) AS d, avg(CAST(peak_match AS INTEGER)) * 100 AS p, avg(h_syn) / (avg(h_orig) + 1e-10) AS r FROM compared),
m AS (SELECT d, 100 * exp(-d / 1000) AS si, p, r, 100 * exp(-abs(r - 1)) AS e FROM one)
SELECT round(d, 5) AS spectral_distance, round(si, 6) AS spectral_similarity, round(p, 6) AS dominant_frequency_match, round(r, 6) AS spectral_entropy_ratio,
  round(e, 6) AS spectral_entropy_score, round(si * 0.4 + p * 0.3 + e * 0.3, 6) AS score FROM m""")
def cd_20(spark, sf):
    m = spectral.spectral_metrics(spectral.compare_spectra(spectral_bins(spark, sf))).withColumn("score", cd.weighted("spectral_coherence"))
    return m.select(F.round("spectral_distance", 5).alias("spectral_distance"), *[F.round(c, 6).alias(c) for c in m.columns if c != "spectral_distance"])


@query("cd_21_classifier_test")
def cd_21(spark, sf):
    t = learned.classifier_test(roles.pair(spark, sf), FEATURES)
    return t.withColumn("score", cd.weighted("generalization_gap"))


@query("cd_22_chi_square", with_(LONG, OWN.format(n=20)) + """
SELECT col, round(sum((s + 1 - (o + 1) * f) ** 2 / ((o + 1) * f)), 6) AS chi2 FROM (
  SELECT *, (sum(s) OVER (PARTITION BY col) + 20) / (sum(o) OVER (PARTITION BY col) + 20) AS f FROM (
    SELECT col, bin, max(n) FILTER (side = 'synthetic') AS s, max(n) FILTER (side = 'original') AS o FROM own_grid GROUP BY col, bin)) GROUP BY col""")
def cd_22(spark, sf):
    return rounded(cd.chi_square(cd.joint_bins(cd.cells(roles.pair(spark, sf), FEATURES))))


@query("cd_22_chi_square_p")
def cd_22_p(spark, sf):
    return cd.with_chi_p(cd.chi_square(cd.joint_bins(cd.cells(roles.pair(spark, sf), FEATURES))))


@query("cd_23_anderson_darling", with_(LONG, RANKS) + """
SELECT col, round(max(n1 + n2 - 1) / max(n1 + n2) * (sum(t / (n1 + n2) * ((n1 + n2) * (cs - ns / 2) - n1 * m) ** 2 / d) / max(n1)
  + sum(t / (n1 + n2) * ((n1 + n2) * (co - no / 2) - n2 * m) ** 2 / d) / max(n2)), 6) AS a2
FROM (SELECT *, cs + co - t / 2 AS m, (cs + co - t / 2) * (n1 + n2 - (cs + co - t / 2)) - (n1 + n2) * t / 4 AS d FROM ranks) WHERE d > 0 GROUP BY col""")
def cd_23(spark, sf):
    return rounded(cd.rank_metrics(cd.rank_table(roles.pair(spark, sf), FEATURES)).select("col", "a2"))


@query("cd_24_mann_whitney", with_(LONG, RANKS) + """
SELECT col, greatest(u1, n1 * n2 - u1) AS u, round((greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))), 6) AS z FROM (
  SELECT col, max(n1) AS n1, max(n2) AS n2, sum(ns * (cs + co - t + (t + 1) / 2)) - max(n1) * (max(n1) + 1) / 2 AS u1, sum(t * t * t - t) AS ties FROM ranks GROUP BY col)""")
def cd_24(spark, sf):
    return cd.rank_metrics(cd.rank_table(roles.pair(spark, sf), FEATURES)).select("col", "u", F.round("z", 6).alias("z"))


@query("cd_25_statistical_consistency")
def cd_25(spark, sf):
    from plumbline.plans.scorecard import statistical_consistency

    return statistical_consistency(roles.pair(spark, sf), FEATURES)


# ---------------------------------------------------------------- verdicts over many validations

NEUTRAL = DIMS + """, thresholds(dim_name, threshold) AS (VALUES ('distribution_fidelity', 70.0::DOUBLE), ('correlation_preservation', 70.0), ('entropy_stability', 65.0),
  ('gradient_health', 60.0), ('loss_landscape', 65.0), ('spectral_coherence', 70.0), ('generalization_gap', 75.0), ('statistical_consistency', 70.0)),
given AS (SELECT validation_id, dim_name, score FROM dims WHERE priority < 4 OR dim_name NOT IN ('gradient_health', 'loss_landscape')),
full_dims AS (SELECT v.validation_id, t.dim_name, t.threshold, coalesce(g.score, t.threshold) AS score, g.score IS NULL AS neutral
  FROM (SELECT DISTINCT validation_id FROM given) v, thresholds t LEFT JOIN given g ON g.validation_id = v.validation_id AND g.dim_name = t.dim_name),
judged AS (SELECT *, score >= threshold AS passed, CASE WHEN score >= threshold THEN 'ok' WHEN score >= threshold * 0.8 THEN 'warning' ELSE 'critical' END AS severity FROM full_dims)"""


def judged_dims(spark, sf):
    """Low-priority runs come without training data, so two dimensions are neutral there."""
    d = roles.validation_dimensions(spark, sf)
    given = d.filter((F.col("priority") < 4) | ~F.col("dim_name").isin("gradient_health", "loss_landscape"))
    return cd.judged(cd.with_neutral(given, "validation_id"))


@query("cd_26_severity", with_(NEUTRAL) + "SELECT validation_id, dim_name, threshold, score, passed, severity, neutral FROM judged")
def cd_26(spark, sf):
    return judged_dims(spark, sf)


OVERALL = """, verdicts AS (SELECT validation_id, avg(score) AS overall_score, avg(score) < 65 AS collapse_detected, least(100.0, 100 * exp(-var_pop(score) / 1000)) AS confidence
  FROM judged GROUP BY validation_id)"""


@query("cd_27_overall", with_(NEUTRAL) + OVERALL + " SELECT validation_id, round(overall_score, 6) AS overall_score, collapse_detected, round(confidence, 6) AS confidence FROM verdicts")
def cd_27(spark, sf):
    return rounded(cd.overall(judged_dims(spark, sf), "validation_id"))


@query("cd_28_warnings", with_(NEUTRAL) + OVERALL + """
SELECT validation_id, CASE WHEN len(w) = 0 THEN ['ALL PASSED'] ELSE w END AS warnings FROM (
  SELECT validation_id, list_concat(CASE WHEN any_value(collapse_detected) THEN ['COLLAPSE DETECTED'] ELSE [] END,
    coalesce(list(upper(severity) || ': ' || dim_name ORDER BY upper(severity) || ': ' || dim_name) FILTER (severity <> 'ok'), [])) AS w
  FROM judged JOIN verdicts USING (validation_id) GROUP BY validation_id)""")
def cd_28(spark, sf):
    return cd.warnings(judged_dims(spark, sf), "validation_id")


@query("cd_29_at_scale", with_(NEUTRAL) + """
SELECT validation_id, dim_name, scale, round(score * factor, 6) AS predicted FROM judged, (VALUES ('10x', 0.95::DOUBLE), ('100x', 0.9025)) s(scale, factor)""")
def cd_29(spark, sf):
    return rounded(cd.at_scale(judged_dims(spark, sf), "validation_id"))


@query("cd_31_api_severity", with_(NEUTRAL) + OVERALL + " SELECT validation_id, CASE WHEN overall_score >= 80 THEN 'low' WHEN overall_score >= 60 THEN 'medium' ELSE 'high' END AS severity FROM verdicts")
def cd_31(spark, sf):
    return cd.overall(judged_dims(spark, sf), "validation_id").select("validation_id", cd.api_severity(F.col("overall_score")).alias("severity"))


@query("flt_01_input_gate", """
SELECT count(*) AS rows, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS nan_cells, CAST(sum(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS inf_cells, 2 AS columns,
  CASE WHEN sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) / (count(*) * 2) > 0.5 THEN 'too_many_nan'
       WHEN sum(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) / (count(*) * 2) > 0.1 THEN 'too_many_inf' ELSE 'ok' END AS verdict FROM orders""")
def flt_01(spark, sf):
    p = F.col("o_orderpriority")
    dirty = F.when(p == "1-URGENT", float("nan")).when(p == "2-HIGH", float("inf")).otherwise(F.col("o_totalprice"))
    return cd.input_gate(roles.table(spark, sf, "orders").select(dirty.alias("a"), "o_totalprice"), ["a", "o_totalprice"])


@query("prj_04_aligned_columns", """
SELECT 'synthetic' AS side, count(*) AS rows, round(avg(o_orderkey), 6) AS l_orderkey, round(avg(o_custkey), 6) AS l_partkey, round(avg(o_totalprice), 6) AS l_suppkey FROM orders
UNION ALL SELECT 'original', count(*), round(avg(l_orderkey), 6), round(avg(l_partkey), 6), round(avg(l_suppkey), 6) FROM lineitem""")
def prj_04(spark, sf):
    both, cols = cd.align(roles.table(spark, sf, "orders"), roles.table(spark, sf, "lineitem"))
    return both.groupBy("side").agg(F.count("*").alias("rows"), *[F.round(F.avg(c), 6).alias(c) for c in cols])


@query("udf_03_expanded_bins", with_(LONG) + """, lim AS (SELECT col, min(val) AS lo, max(val) AS hi FROM long GROUP BY col),
b AS (SELECT col, lo, hi, least(9, CAST(floor((val - lo) / (hi - lo) * 10) AS INTEGER)) AS bin, count(*) AS n FROM long JOIN lim USING (col) GROUP BY ALL)
SELECT l.col, i AS bin, round(l.lo + (l.hi - l.lo) * i / 10, 6) AS low, round(l.lo + (l.hi - l.lo) * (i + 1) / 10, 6) AS high, coalesce(n, 0) AS n
FROM lim l CROSS JOIN (SELECT unnest(range(10)) AS i) LEFT JOIN b ON b.col = l.col AND b.bin = i""")
def udf_03_bins(spark, sf):
    """One row per bin from a column's packed counts, through the table function as a SQL user calls it."""
    sql_names.register(spark)
    long = to_long(roles.pair(spark, sf), FEATURES)
    limits = long.groupBy("col").agg(F.min("val").alias("lo"), F.max("val").alias("hi"))
    # one row per column; a join by column would put each of them into one task
    bins = long.join(F.broadcast(limits), "col").select("col", "lo", "hi", cd.bin_index(F.col("val"), F.col("lo"), F.col("hi"), 10).alias("bin"))
    counts = F.array(*[F.count_if(F.col("bin") == i) for i in range(10)])
    packed = bins.groupBy("col", "lo", "hi").agg(counts.alias("counts"))
    packed.createOrReplaceTempView("packed_bins")
    return spark.sql("""
        SELECT col, e.bin, round(e.low, 6) AS low, round(e.high, 6) AS high, e.n
        FROM packed_bins, LATERAL expand_bins(counts, lo, hi) e""")


@query("cd_32_scorecard")
def cd_32(spark, sf):
    from plumbline.plans.scorecard import line_item_scorecard

    return line_item_scorecard(spark, sf)


@query("udf_03_stability_index", with_(LONG) + """, lim AS (SELECT col, min(val) FILTER (side = 'original') AS lo, max(val) FILTER (side = 'original') AS hi FROM long GROUP BY col),
b AS (SELECT col, greatest(0, least(9, CAST(floor((val - lo) / (hi - lo) * 10) AS INTEGER))) AS bin, count(*) FILTER (side = 'original') AS o, count(*) FILTER (side = 'synthetic') AS s FROM long JOIN lim USING (col) GROUP BY ALL),
g AS (SELECT l.col, i, coalesce(o, 0) AS o, coalesce(s, 0) AS s FROM lim l CROSS JOIN (SELECT unnest(range(10)) AS i) LEFT JOIN b ON b.col = l.col AND b.bin = i),
p AS (SELECT col, i, greatest(o / sum(o) OVER (PARTITION BY col), 1e-6) AS q, greatest(s / sum(s) OVER (PARTITION BY col), 1e-6) AS p,
  abs(sum(o) OVER (PARTITION BY col ORDER BY i) / sum(o) OVER (PARTITION BY col) - sum(s) OVER (PARTITION BY col ORDER BY i) / sum(s) OVER (PARTITION BY col)) AS gap FROM g)
SELECT col, round(sum((p - q) * ln(p / q)), 8) AS psi, round(max(gap), 8) AS binned_ks FROM p GROUP BY col""")
def udf_03(spark, sf):
    """Through the SQL names, as a user of a SQL session would call them."""
    sql_names.register(spark)
    h = cd.side_histograms(roles.pair(spark, sf), FEATURES, 10)
    return h.select("col", F.expr("round(psi(expected, actual), 8)").alias("psi"), F.expr("round(ks_of_counts(expected, actual), 8)").alias("binned_ks"))
