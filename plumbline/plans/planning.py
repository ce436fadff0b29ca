"""Fix plans for every validation, and analytics over model results."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import roles
from plumbline.operators import planning as pl
from plumbline.operators import runs
from plumbline.plans.collapse import CURVES, curves
from plumbline.plans.oracle_parts import DIMS, with_
from plumbline.plans.profile import rounded
from plumbline.registry import query

RUNS = DIMS + """, plan_runs AS (SELECT validation_id, collapse_score, floor(dayofyear(created_at) / 366 * 100) AS diversity_score, CAST(priority * 6 - 4 AS DOUBLE) AS problem_percent FROM validations),
templates(dim_name, title, category, base_impact, effort_hours, dollar_cost) AS (VALUES ('distribution_fidelity', 'Advanced Data Augmentation', 'data_augmentation', 15.0::DOUBLE, 12.0::DOUBLE, 300.0::DOUBLE),
  ('correlation_preservation', 'Copula-Based Generation', 'feature_engineering', 12.0, 16.0, 400.0)),
pool AS (
  SELECT validation_id, substr(dim_name, 1, 4) || '_' || substr(title, 1, 4) AS rec_id, CASE WHEN score < 50 THEN 2 ELSE 3 END AS priority, base_impact * (1 + (65 - score) / 100) AS impact,
    effort_hours, dollar_cost, 5.0::DOUBLE AS gpu_hours, 0.85::DOUBLE AS feasibility, 0.5::DOUBLE AS complexity, 0.3::DOUBLE AS novelty, effort_hours / 8 AS days
  FROM dims JOIN templates USING (dim_name) WHERE score < 65
  UNION ALL SELECT validation_id, 'loc_001', CASE WHEN problem_percent > 20 THEN 1 ELSE 2 END, least(30.0, problem_percent * 1.5), 2.0, 50.0, 0.5, 1.0, 0.1, 0.1, 0.5 FROM plan_runs WHERE problem_percent > 5
  UNION ALL SELECT validation_id, 'crit_001', 1, 70.0, 80.0, 5000.0, 100.0, 0.7, 0.8, 0.3, 14.0 FROM plan_runs WHERE collapse_score < 30
  UNION ALL SELECT validation_id, 'div_001', 2, 15.0, 16.0, 400.0, 10.0, 0.9, 0.4, 0.2, 3.0 FROM plan_runs WHERE diversity_score < 60),
costed AS (SELECT *, dollar_cost + effort_hours * 100 + gpu_hours * 2 AS cost_usd, ((impact * 1.3 - impact * 0.7) / 4) ** 2 AS variance, 0.8::DOUBLE AS success FROM pool),
cand AS (SELECT *, impact / greatest(1.0, cost_usd) AS roi, impact * success AS risk_adjusted FROM costed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY validation_id ORDER BY priority, impact DESC, rec_id) AS place FROM cand QUALIFY place <= 3)"""


def plan_runs(spark, sf):
    v = roles.validations(spark, sf)
    return v.select("validation_id", "collapse_score", F.floor(F.dayofyear("created_at") / 366 * 100).cast("double").alias("diversity_score"),
                    (F.col("priority") * 6 - 4).cast("double").alias("problem_percent"))


def candidates(spark, sf):
    return pl.candidates(plan_runs(spark, sf), roles.validation_dimensions(spark, sf), pl.template_table(spark))


@query("rec_01_candidates", with_(RUNS) + """
SELECT validation_id, rec_id, CAST(priority AS BIGINT) AS priority, round(impact, 6) AS impact, days, cost_usd FROM cand""")
def rec_01(spark, sf):
    return rounded(candidates(spark, sf).select("validation_id", "rec_id", F.col("priority").cast("bigint").alias("priority"), "impact", "days", "cost_usd"))


@query("jon_13_failing_templates", with_(RUNS) + "SELECT validation_id, dim_name, title FROM dims JOIN templates USING (dim_name) WHERE score < 65")
def jon_13(spark, sf):
    d = roles.validation_dimensions(spark, sf).filter("score < 65")
    return d.join(F.broadcast(pl.template_table(spark)), "dim_name").select("validation_id", "dim_name", "title")


# The links between fixes that the queries plan with: met and unmet needs, a cycle of two, exclusions and synergies.
LINKS = [
    ("corr_Copu", "dist_Adva", "dependency", None), ("loc_001", "dist_Adva", "dependency", None),
    ("crit_001", "div_001", "dependency", None), ("div_001", "crit_001", "dependency", None),
    ("dist_Adva", "crit_001", "exclusion", None), ("corr_Copu", "loc_001", "exclusion", None),
    ("corr_Copu", "dist_Adva", "synergy", 1.1), ("dist_Adva", "div_001", "synergy", 1.2), ("dist_Adva", "loc_001", "synergy", 1.15),
]
LINKED = RUNS + ", links(rec_id, other, kind, factor) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{k}', {'NULL' if f is None else f}::DOUBLE)" for a, b, k, f in LINKS) + ")"


def linked(spark, sf):
    return pl.with_links(candidates(spark, sf), pl.link_table(spark, LINKS))


@query("jon_14_open_dependencies", with_(LINKED) + """
SELECT validation_id, c.rec_id AS wants, other AS rec_id FROM cand c JOIN links l ON l.rec_id = c.rec_id AND kind = 'dependency'
WHERE (validation_id, other) NOT IN (SELECT (validation_id, rec_id) FROM ranked)""")
def jon_14(spark, sf):
    return pl.open_dependencies(linked(spark, sf), pl.ranked(linked(spark, sf), 3))


@query("jon_14_link_states", with_(LINKED) + """
SELECT c.validation_id, c.rec_id, count(*) FILTER (kind = 'dependency' AND r.rec_id IS NULL) = 0 AS satisfied, count(*) FILTER (kind = 'exclusion' AND r.rec_id IS NOT NULL) > 0 AS excluded
FROM cand c LEFT JOIN links l ON l.rec_id = c.rec_id LEFT JOIN ranked r ON r.validation_id = c.validation_id AND r.rec_id = l.other GROUP BY c.validation_id, c.rec_id""")
def jon_14_states(spark, sf):
    return pl.link_states(linked(spark, sf), pl.ranked(linked(spark, sf), 3)).drop("open")


@query("rec_05_costs_and_returns", with_(RUNS) + "SELECT validation_id, rec_id, cost_usd, round(roi, 6) AS roi, round(risk_adjusted, 6) AS risk_adjusted, round(variance, 6) AS variance FROM cand")
def rec_05(spark, sf):
    return rounded(candidates(spark, sf).select("validation_id", "rec_id", "cost_usd", "roi", "risk_adjusted", "variance"))


@query("rec_06_success_probability", with_(RUNS) + """
SELECT validation_id, rec_id, round(greatest(0.1, least(0.99, feasibility - least(0.3, sqrt(variance) / 20) - complexity * 0.2 - novelty * 0.15)), 9) AS probability FROM cand""")
def rec_06(spark, sf):
    p = pl.success_probability(F.col("feasibility"), F.sqrt("variance"), F.col("complexity"), F.col("novelty"))
    return candidates(spark, sf).select("validation_id", "rec_id", F.round(p, 9).alias("probability"))


@query("flt_06_within_limits", with_(RUNS) + "SELECT validation_id, rec_id FROM cand JOIN plan_runs USING (validation_id) WHERE (diversity_score < 20 OR cost_usd <= diversity_score * 50) AND days <= 2")
def flt_06(spark, sf):
    limits = plan_runs(spark, sf).select("validation_id", F.when(F.col("diversity_score") >= 20, F.col("diversity_score") * 50).alias("budget"))
    return pl.within_limits(candidates(spark, sf).join(limits, "validation_id"), F.col("budget"), F.lit(2.0)).select("validation_id", "rec_id")


@query("rec_07_simple_ranking", with_(RUNS) + "SELECT validation_id, rec_id, place FROM ranked")
def rec_07(spark, sf):
    return pl.ranked(candidates(spark, sf), 3).select("validation_id", "rec_id", F.col("place").cast("bigint").alias("place"))


NEEDS = """, needs AS (SELECT c.*, coalesce(list(l.other) FILTER (kind = 'dependency'), []) AS deps, coalesce(list(l.other) FILTER (kind = 'exclusion'), []) AS excl
  FROM cand c LEFT JOIN links l ON l.rec_id = c.rec_id GROUP BY ALL)"""


@query("rec_08_greedy_plan", with_(LINKED + NEEDS).replace("WITH ", "WITH RECURSIVE ", 1) + """, queue AS (SELECT *, row_number() OVER (PARTITION BY validation_id ORDER BY roi DESC, rec_id) AS n FROM needs),
walk AS (
  SELECT DISTINCT validation_id, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS taken, 0.0::DOUBLE AS cost, 0.0::DOUBLE AS spent FROM queue
  UNION ALL
  SELECT validation_id, n, CASE WHEN fits THEN list_append(taken, rec_id) ELSE taken END, CASE WHEN fits THEN cost + cost_usd ELSE cost END, CASE WHEN fits THEN spent + days ELSE spent END
  FROM (SELECT q.validation_id, q.n, taken, cost, spent, q.rec_id, q.cost_usd, q.days,
      len(taken) < 3 AND list_has_all(taken, deps) AND NOT list_has_any(excl, taken) AND cost + cost_usd <= 3000 AND spent + days <= 6 AS fits
    FROM walk w JOIN queue q ON q.validation_id = w.validation_id AND q.n = w.n + 1))
SELECT validation_id, array_to_string(arg_max(taken, n), ',') AS selected FROM walk GROUP BY validation_id""")
def rec_08(spark, sf):
    g = pl.greedy(linked(spark, sf), "balanced", budget=3000.0, days=6.0, most=3)
    return g.select("validation_id", F.array_join(F.transform("selected", lambda x: x["rec_id"]), ",").alias("selected"))


@query("rec_09_execution_order")
def rec_09(spark, sf):
    g = pl.execution_order(pl.as_plans(pl.ranked(linked(spark, sf), 5)))
    return g.select("validation_id", F.array_join("execution_order", ",").alias("execution_order"))


@query("rec_09_execution_layers", with_(LINKED).replace("WITH ", "WITH RECURSIVE ", 1) + """, wants AS (
  SELECT c.validation_id, c.rec_id, l.other FROM cand c JOIN links l ON l.rec_id = c.rec_id AND kind = 'dependency' JOIN cand o ON o.validation_id = c.validation_id AND o.rec_id = l.other),
chain AS (
  SELECT validation_id, rec_id, rec_id AS top, 0 AS depth FROM cand WHERE (validation_id, rec_id) NOT IN (SELECT (validation_id, rec_id) FROM wants)
  UNION ALL SELECT w.validation_id, w.rec_id, top, depth + 1 FROM chain c JOIN wants w ON w.validation_id = c.validation_id AND w.other = c.rec_id WHERE depth < 9),
stuck AS (
  SELECT validation_id, rec_id, other AS reach FROM wants UNION SELECT s.validation_id, s.rec_id, w.other FROM stuck s JOIN wants w ON w.validation_id = s.validation_id AND w.rec_id = s.reach),
cyclic AS (SELECT validation_id, rec_id FROM stuck WHERE rec_id = reach),
out AS (SELECT validation_id, rec_id FROM cyclic UNION SELECT s.validation_id, s.rec_id FROM stuck s JOIN cyclic c ON c.validation_id = s.validation_id AND c.rec_id = s.reach)
SELECT validation_id, rec_id, CASE WHEN (validation_id, rec_id) IN (SELECT (validation_id, rec_id) FROM out) THEN NULL ELSE (
  SELECT max(depth) FROM chain h WHERE h.validation_id = cand.validation_id AND h.rec_id = cand.rec_id) END AS layer FROM cand""")
def rec_09_layers(spark, sf):
    return pl.execution_layers(pl.as_plans(pl.ranked(linked(spark, sf), 5)))


TOTALS = """, totals AS (SELECT validation_id, sum(impact) AS total_impact, sqrt(sum(variance)) AS sd, product(success) AS success, sum(cost_usd) AS cost_usd, sum(effort_hours) AS effort_hours, sum(days) * 0.7 AS days
  FROM ranked GROUP BY validation_id)"""


BOOSTED = """, boosted AS (SELECT r.validation_id, r.rec_id, any_value(r.impact) * coalesce(product(l.factor), 1) AS impact FROM ranked r
  LEFT JOIN ranked e ON e.validation_id = r.validation_id AND e.place < r.place LEFT JOIN links l ON l.rec_id = r.rec_id AND l.other = e.rec_id AND kind = 'synergy' GROUP BY ALL),
gains AS (SELECT validation_id, sum(impact) AS total_impact FROM boosted GROUP BY validation_id)"""


@query("rec_10_plan_totals", with_(LINKED + TOTALS + BOOSTED) + """
SELECT validation_id, round(g.total_impact, 6) AS total_impact, round(greatest(0.0, g.total_impact - 1.96 * sd), 6) AS impact_low, round(least(100.0, g.total_impact + 1.96 * sd), 6) AS impact_high,
  round(success, 6) AS success, cost_usd, effort_hours, round(days, 6) AS days FROM totals JOIN gains g USING (validation_id)""")
def rec_10(spark, sf):
    return rounded(pl.plan_totals(pl.as_plans(pl.ranked(linked(spark, sf), 3))).drop("selected"))


@query("rec_11_quick_wins", with_(RUNS) + "SELECT validation_id, rec_id FROM ranked WHERE days < 2 AND impact > 10 AND feasibility > 0.8")
def rec_11(spark, sf):
    return pl.quick_wins(pl.ranked(candidates(spark, sf), 3)).select("validation_id", "rec_id")


@query("rec_12_alternative_plans")
def rec_12(spark, sf):
    c = candidates(spark, sf)
    return rounded(pl.alternatives(c, pl.greedy(c, "balanced", budget=3000.0, days=6.0, most=3)))


@query("rec_13_plan_summary", with_(RUNS) + """
SELECT validation_id, collapse_score, fixes, n_critical, n_high, n_medium, n_low, strongest, quickest, best_return,
  CASE WHEN collapse_score < 30 THEN 'CRITICAL' WHEN collapse_score < 50 THEN 'SEVERE' WHEN collapse_score < 65 THEN 'MODERATE' ELSE 'MINOR' END AS severity,
  round(least(100.0, collapse_score + impact), 6) AS projected_score
FROM plan_runs JOIN (SELECT validation_id, count(*) AS fixes, count(*) FILTER (priority = 1) AS n_critical, count(*) FILTER (priority = 2) AS n_high, count(*) FILTER (priority = 3) AS n_medium,
  count(*) FILTER (priority = 4) AS n_low, arg_min(rec_id, (-impact, rec_id)) AS strongest, arg_min(rec_id, (days, rec_id)) AS quickest, arg_min(rec_id, (-roi, rec_id)) AS best_return, sum(impact) AS impact
  FROM ranked GROUP BY validation_id) USING (validation_id)""")
def rec_13(spark, sf):
    return rounded(pl.summary(plan_runs(spark, sf), pl.ranked(candidates(spark, sf), 3)))


@query("rec_14_risk_assessment", with_(RUNS) + """
SELECT *, CASE WHEN success > 0.8 THEN 'LOW' WHEN success > 0.6 THEN 'MEDIUM' ELSE 'HIGH' END AS level FROM (
  SELECT validation_id, count(*) FILTER (complexity > 0.7) AS hard, count(*) FILTER (feasibility < 0.6) AS doubtful, count(*) FILTER (novelty > 0.5) AS novel, round(product(success), 6) AS success
  FROM ranked GROUP BY validation_id)""")
def rec_14(spark, sf):
    return rounded(pl.risk_assessment(pl.ranked(candidates(spark, sf), 3)))


@query("rec_15_combined_impact", with_(RUNS + TOTALS) + """
SELECT validation_id, before, round(total_impact, 6) AS total_impact, round(after, 6) AS after,
  CASE WHEN before < 30 THEN 'CRITICAL' WHEN before < 50 THEN 'SEVERE' WHEN before < 65 THEN 'MODERATE' ELSE 'MINOR' END AS band_before,
  CASE WHEN after < 30 THEN 'CRITICAL' WHEN after < 50 THEN 'SEVERE' WHEN after < 65 THEN 'MODERATE' ELSE 'MINOR' END AS band_after
FROM (SELECT validation_id, collapse_score AS before, total_impact, least(100.0, collapse_score + total_impact) AS after FROM plan_runs JOIN totals USING (validation_id))""")
def rec_15(spark, sf):
    return rounded(pl.combined_impact(plan_runs(spark, sf), pl.plan_totals(pl.as_plans(pl.ranked(candidates(spark, sf), 3)))))


# ---------------------------------------------------------------- model results


@query("cas_01_collapse_signals", with_(CURVES) + """, tail AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS back, count(*) OVER (PARTITION BY run) AS n FROM curves)
SELECT run, round(v, 6) AS tail_variance, (n > 3 AND v > 1) OR c_acctbal / 1000 < 2 OR c_nationkey * 5 > 100 AS collapsed
FROM (SELECT run, max(n) AS n, var_pop(loss) AS v FROM tail WHERE back <= 5 GROUP BY run) JOIN customer ON c_custkey = run""")
def cas_01(spark, sf):
    spectra = roles.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("run"), (F.col("c_acctbal") / 1000).alias("spectral_entropy"), (F.col("c_nationkey") * 5).alias("frequency_concentration"))
    return rounded(runs.collapse_signals(curves(spark, sf), spectra))


@query("cas_02_patience", with_(CURVES) + """, p AS (SELECT run, step, loss, row_number() OVER w - 1 AS pos, min(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before
  FROM curves WINDOW w AS (PARTITION BY run ORDER BY step)),
s AS (SELECT *, max(CASE WHEN best_before IS NULL OR loss < best_before THEN pos END) OVER (PARTITION BY run ORDER BY step) AS since FROM p),
e AS (SELECT run, min(pos) FILTER (pos - since >= 3) AS stop FROM s GROUP BY run)
SELECT run, round(min(loss), 6) AS best_loss, max(since) AS convergence_epoch, max(stop) AS early_stop_epoch FROM s JOIN e USING (run) WHERE stop IS NULL OR pos <= stop GROUP BY run""")
def cas_02(spark, sf):
    return rounded(runs.patience(curves(spark, sf), 3))


@query("win_04_running_minimum", with_(CURVES) + "SELECT run, step, round(min(loss) OVER (PARTITION BY run ORDER BY step), 6) AS best_so_far FROM curves")
def win_04(spark, sf):
    from plumbline.operators.sequences import carry

    return rounded(carry(curves(spark, sf), ["run"], ["step"], mins={"best_so_far": "loss"}).select("run", "step", "best_so_far"))


@query("cas_03_output_spectra", """
WITH o AS (SELECT vec_id, label AS run, unnest(embedding) AS x0, unnest(range(len(embedding))) AS t FROM embeddings), x AS (SELECT vec_id, run, t, CAST(x0 AS DOUBLE) AS x FROM o),
psd AS (SELECT vec_id, run, k, sum(x * cos(2 * pi() * k * t / 64)) ** 2 + sum(x * sin(2 * pi() * k * t / 64)) ** 2 AS p FROM x, (SELECT unnest(range(33)) AS k) GROUP BY ALL),
sm AS (SELECT vec_id, run, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS q FROM x), ent AS (SELECT run, vec_id, -sum(q * ln(q + 1e-10)) AS h FROM sm GROUP BY ALL)
SELECT run, round(e, 6) AS spectral_energy, round(h, 6) AS spectral_entropy, round(c, 6) AS frequency_concentration, round(v, 6) AS representation_variance
FROM (SELECT run, avg(x * x) AS e, var_samp(x) AS v FROM x GROUP BY run) JOIN (SELECT run, avg(h) AS h FROM ent GROUP BY run) USING (run) JOIN (SELECT run, max(p) / avg(p) AS c FROM psd GROUP BY run) USING (run)""")
def cas_03(spark, sf):
    o = roles.table(spark, sf, "embeddings").select(F.col("label").alias("run"), F.col("embedding").cast("array<double>").alias("output"))
    return rounded(runs.output_spectra(o))


@query("cas_04_gradient_stats", "SELECT l_suppkey AS run, round(sqrt(sum(l_quantity * l_quantity)), 6) AS total_norm, max(l_quantity) AS max_grad, min(l_quantity) AS min_grad, max(l_quantity) - min(l_quantity) AS grad_range FROM lineitem GROUP BY l_suppkey")
def cas_04(spark, sf):
    return rounded(runs.gradient_stats(roles.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("run"), F.col("l_quantity").alias("norm"))))


@query("cas_05_progress", """
SELECT l_orderkey AS validation_id, count(*) AS models, count(*) FILTER (l_returnflag <> 'N') AS finished, round(count(*) FILTER (l_returnflag <> 'N') * 100.0 / count(*), 6) AS percent,
  round((count(*) - count(*) FILTER (l_returnflag <> 'N')) * avg(l_quantity) FILTER (l_returnflag <> 'N'), 6) AS seconds_left FROM lineitem GROUP BY l_orderkey""")
def cas_05(spark, sf):
    m = roles.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("validation_id"), (F.col("l_returnflag") != "N").alias("done"), F.col("l_quantity").alias("seconds"))
    return rounded(runs.progress(m))


@query("cas_06_consensus", """
SELECT validation_id, round(c, 6) AS consensus, c > 70 AS high_risk, CASE WHEN c < 20 THEN 'low' WHEN c < 50 THEN 'medium' ELSE 'high' END AS band FROM (
  SELECT l_orderkey AS validation_id, sum(CASE WHEN l_returnflag = 'R' THEN w ELSE 0.0 END) / sum(w) * 100 AS c FROM (
    SELECT *, CAST(CASE l_linenumber WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 1 END AS DOUBLE) AS w FROM lineitem) GROUP BY l_orderkey)""")
def cas_06(spark, sf):
    m = roles.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("validation_id"), F.col("l_linenumber").alias("tier"), (F.col("l_returnflag") == "R").alias("collapsed"))
    return rounded(runs.consensus(m))


LAW = """pts AS (SELECT l_suppkey AS run, l_quantity AS size, l_extendedprice / 1000 AS loss FROM lineitem), lo AS (SELECT run, min(loss) AS least FROM pts GROUP BY run),
fits AS (SELECT run, share, max(least) AS least, regr_slope(ln(loss - least * share), ln(size)) AS b, regr_intercept(ln(loss - least * share), ln(size)) AS ln_a, regr_r2(ln(loss - least * share), ln(size)) AS r2
  FROM pts JOIN lo USING (run), (SELECT unnest(range(10)) / 10 AS share) WHERE loss > least * share GROUP BY run, share),
laws AS (SELECT * FROM fits QUALIFY row_number() OVER (PARTITION BY run ORDER BY r2 DESC, share) = 1)"""


def laws(spark, sf):
    p = roles.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("run"), F.col("l_quantity").alias("size"), (F.col("l_extendedprice") / 1000).alias("loss"))
    return runs.scaling_law(p, "run")


@query("cas_07_scaling_law", with_(LAW) + "SELECT run, round(exp(ln_a), 6) AS a, round(b, 6) AS b, round(share * least, 6) AS c, round(r2, 6) AS r2 FROM laws")
def cas_07(spark, sf):
    return rounded(laws(spark, sf))


@query("cas_07_extrapolation", with_(LAW) + "SELECT run, CAST(size AS DOUBLE) AS size, round(exp(ln_a) * size ** b + share * least, 6) AS predicted FROM laws, (VALUES (100), (1000)) s(size)")
def cas_07_at(spark, sf):
    return rounded(runs.extrapolate(laws(spark, sf), "run", [100, 1000]))


@query("cas_08_capacity_ladder")
def cas_08(spark, sf):
    return runs.capacity_ladder(roles.table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_extendedprice"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", [2, 4, 6], 2)


@query("cas_09_prediction_error", """
SELECT o_orderpriority, count(*) AS n, round(avg(abs(p.predicted - a.actual)), 4) AS mae, round(avg(p.predicted - a.actual), 4) AS bias
FROM (SELECT o_orderkey, o_orderpriority, o_totalprice AS predicted FROM orders) p JOIN (SELECT l_orderkey, max(l_extendedprice) AS actual FROM lineitem GROUP BY 1) a ON o_orderkey = l_orderkey GROUP BY 1""")
def cas_09(spark, sf):
    p = roles.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority", F.col("o_totalprice").alias("predicted"))
    a = roles.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_extendedprice").alias("actual"))
    return runs.prediction_error(p, a, "k", "o_orderpriority").withColumns({"mae": F.round("mae", 4), "bias": F.round("bias", 4)})
