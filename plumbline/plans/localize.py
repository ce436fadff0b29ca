"""Row localisation over orders, and sampling over orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import roles
from plumbline.operators import localize as lz
from plumbline.operators import sampling as sm
from plumbline.operators.sequences import islands, positions
from plumbline.plans.oracle_parts import DIMS, with_
from plumbline.plans.profile import rounded
from plumbline.registry import query

SAMPLE_ROWS = 1000
ROWS = "r AS (SELECT o_orderkey AS row_id, o_totalprice / 1000 AS price, CAST(dayofyear(o_orderdate) AS DOUBLE) AS season FROM orders)"
OUTLIER = ROWS + """, s AS (SELECT avg(price) AS mp, avg(season) AS ms, var_samp(price) + 1e-6 AS a, var_samp(season) + 1e-6 AS b, covar_samp(price, season) AS c FROM r),
d AS (SELECT row_id, sqrt(((price - mp) ** 2 * b - 2 * (price - mp) * (season - ms) * c + (season - ms) ** 2 * a) / (a * b - c * c)) AS x FROM r, s),
outlier AS (SELECT row_id, x / (SELECT max(x) FROM d) AS outlier FROM d)"""
ANOMALY = """, z AS (SELECT avg(price) AS mp, avg(season) AS ms, stddev_samp(price) + 1e-6 AS sp, stddev_samp(season) + 1e-6 AS ss FROM r),
zs AS (SELECT row_id, greatest(abs((price - mp) / sp), abs((season - ms) / ss)) AS x FROM r, z),
anomaly AS (SELECT row_id, x / (SELECT max(x) FROM zs) AS anomaly FROM zs)"""
DENSITY = """, sample AS (SELECT price AS p, season AS s FROM r ORDER BY sha256(CAST(row_id AS VARCHAR)), row_id LIMIT 1000),
near AS (SELECT row_id, list_avg(list_slice(list_sort(list(sqrt((price - p) ** 2 + (season - s) ** 2))), 1, 20)) AS distance FROM r, sample GROUP BY row_id),
dens AS (SELECT row_id, 1 / (1 / (distance + 1e-6) + 1e-6) AS x FROM near),
density AS (SELECT row_id, x / (SELECT max(x) FROM dens) AS density FROM dens)"""
IMPACT = OUTLIER + DENSITY + ANOMALY + """, scored AS (SELECT row_id, outlier, density, anomaly, outlier * 0.4 + density * 0.3 + anomaly * 0.3 AS impact
  FROM outlier JOIN density USING (row_id) JOIN anomaly USING (row_id))"""


@query("lcz_01_mahalanobis", with_(OUTLIER) + "SELECT row_id, round(outlier, 6) AS outlier FROM outlier")
def lcz_01(spark, sf):
    return rounded(lz.mahalanobis(*roles.rows_with_impact(spark, sf)))


@query("jon_11_sample_neighbours", with_(ROWS + DENSITY) + "SELECT row_id, round(distance, 6) AS distance FROM near")
def jon_11(spark, sf):
    df, cols, key = roles.rows_with_impact(spark, sf)
    return rounded(lz.neighbour_distance(df, cols, key, lz.reference_sample(df, cols, key, SAMPLE_ROWS), 20))


@query("lcz_02_density", with_(ROWS + DENSITY) + "SELECT row_id, round(density, 6) AS density FROM density")
def lcz_02(spark, sf):
    return rounded(lz.density(*roles.rows_with_impact(spark, sf), SAMPLE_ROWS))


@query("lcz_03_feature_anomaly", with_(ROWS + ANOMALY) + "SELECT row_id, round(anomaly, 6) AS anomaly FROM anomaly")
def lcz_03(spark, sf):
    return rounded(lz.feature_anomaly(*roles.rows_with_impact(spark, sf)))


@query("lcz_04_impact", with_(IMPACT) + "SELECT row_id, round(outlier, 6) AS outlier, round(density, 6) AS density, round(anomaly, 6) AS anomaly, round(impact, 6) AS impact FROM scored")
def lcz_04(spark, sf):
    return rounded(lz.impact(*roles.rows_with_impact(spark, sf), SAMPLE_ROWS))


@query("lcz_05_gradient_impact", "SELECT event_id AS row_id, round(value / (SELECT max(value) FROM events), 6) AS impact FROM events")
def lcz_05(spark, sf):
    n = roles.table(spark, sf, "events").select(F.col("event_id").alias("row_id"), F.col("value").alias("grad_norm"))
    return rounded(lz.gradient_impact(n))


@query("lcz_06_random_share", with_(ROWS) + "SELECT row_id, price, season FROM r WHERE CAST('0x' || substr(md5(CAST(row_id AS VARCHAR)), 1, 13) AS BIGINT) < 0.1 * 4503599627370496")
def lcz_06(spark, sf):
    df, _, key = roles.rows_with_impact(spark, sf)
    return sm.random_share(df, key, 0.1)


@query("lcz_07_top_rows", with_(IMPACT) + "SELECT row_id, round(impact, 6) AS impact FROM scored ORDER BY scored.impact DESC, row_id LIMIT 100")
def lcz_07(spark, sf):
    return rounded(lz.top_rows(lz.impact(*roles.rows_with_impact(spark, sf), SAMPLE_ROWS), "row_id", 100).select("row_id", "impact"))


@query("lcz_08_problem_summary", with_(IMPACT) + """
SELECT rows, problems, round(problems * 100.0 / rows, 6) AS percent, CASE WHEN problems * 100.0 / rows > 20 THEN 'critical' WHEN problems * 100.0 / rows > 10 THEN 'warning'
  WHEN problems * 100.0 / rows > 5 THEN 'caution' ELSE 'acceptable' END AS advice FROM (SELECT count(*) AS rows, count(*) FILTER (impact > 0.6) AS problems FROM scored)""")
def lcz_08(spark, sf):
    return rounded(lz.problem_summary(lz.impact(*roles.rows_with_impact(spark, sf), SAMPLE_ROWS), 0.6))


@query("flt_04_impact_threshold", "SELECT event_id AS row_id FROM events WHERE value / (SELECT max(value) FROM events) > 0.3")
def flt_04(spark, sf):
    n = roles.table(spark, sf, "events").select(F.col("event_id").alias("row_id"), F.col("value").alias("grad_norm"))
    return lz.gradient_impact(n).filter(F.col("impact") > 0.3).select("row_id")


@query("lcz_09_feature_attribution", with_(DIMS, ROWS) + """, v AS (SELECT 'price' AS col, var_pop(price) AS x FROM r UNION ALL SELECT 'season', var_pop(season) FROM r)
SELECT validation_id, dim_name, col, round(x / (SELECT max(x) FROM v), 6) AS attribution FROM dims, v WHERE score < 65""")
def lcz_09(spark, sf):
    df, cols, _ = roles.rows_with_impact(spark, sf)
    return rounded(lz.feature_attribution(df, cols, roles.validation_dimensions(spark, sf), "validation_id"))


@query("lcz_10_problem_regions", """
WITH m AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_index, value / (SELECT max(value) FROM events) AS impact FROM events),
g AS (SELECT row_index, row_index - row_number() OVER (ORDER BY row_index) AS grp FROM m WHERE impact > 0.1)
SELECT min(row_index) AS start_index, max(row_index) AS end_index, count(*) AS size FROM g GROUP BY grp""")
def lcz_10(spark, sf):
    n = roles.table(spark, sf, "events").select(F.col("event_id").alias("row_id"), F.col("value").alias("grad_norm"))
    return lz.problem_regions(lz.gradient_impact(n), "row_id", 0.1)


@query("win_09_turn_islands", """
WITH g AS (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS grp FROM (SELECT DISTINCT conv_id, turn FROM conversations))
SELECT conv_id, min(turn) AS start_index, max(turn) AS end_index, count(*) AS size FROM g GROUP BY conv_id, grp""")
def win_09(spark, sf):
    return islands(roles.table(spark, sf, "conversations"), ["conv_id"], "turn")


@query("src_10_chunked_rows", """
SELECT o_orderkey, o_totalprice, pos, pos // 1000 AS chunk_index, pos // 1000 = (SELECT (count(*) - 1) // 1000 FROM orders) AS is_last
FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders)""")
def src_10(spark, sf):
    from plumbline.sources.readers import chunked

    return chunked(roles.table(spark, sf, "orders"), "o_orderkey", 1000, ["o_orderkey", "o_totalprice"])


# ---------------------------------------------------------------- sampling

STRATA = """sized AS (SELECT *, CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 13) AS BIGINT) AS h, count(*) OVER (PARTITION BY o_orderpriority) AS n, count(*) OVER () AS total FROM orders),
placed AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY h, o_orderkey) - 1 AS pos FROM sized),
quota AS (SELECT * FROM placed WHERE pos < CASE WHEN n > 1 THEN floor(n * least(1.0, 3000 / total) + 0.5) ELSE 1 END),
sample AS (SELECT * FROM quota QUALIFY row_number() OVER (ORDER BY h, o_orderkey) <= 3000)"""


NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TEXTS = ["l_returnflag", "l_linestatus"]
UNIQUES = " UNION ALL ".join(f"SELECT '{c}' AS col, count(DISTINCT {c}) AS unique_count, {kind} AS number FROM lineitem" for kind, cs in (("true", NUMBERS), ("false", TEXTS)) for c in cs)


@query("smp_01_auto_strata", f"""
SELECT col, unique_count, abs(unique_count - 10) AS distance FROM ({UNIQUES})
WHERE CASE WHEN number THEN unique_count <= 50 ELSE unique_count BETWEEN 2 AND 100 END ORDER BY distance, col LIMIT 3""")
def smp_01(spark, sf):
    return sm.auto_strata(roles.table(spark, sf, "lineitem"))


@query("smp_02_stratified_sample", with_(STRATA) + "SELECT o_orderkey, o_orderpriority FROM sample")
def smp_02(spark, sf):
    return sm.stratified_sample(roles.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], "o_orderkey", 3000)


@query("smp_03_sample_info", with_(STRATA) + """
SELECT (SELECT count(*) FROM orders) AS original_size, count(*) AS sample_size, count(DISTINCT o_orderpriority) AS n_strata, round(count(*) / (SELECT count(*) FROM orders), 6) AS sample_fraction FROM sample""")
def smp_03(spark, sf):
    o = roles.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return rounded(sm.sample_info(o, sm.stratified_sample(o, ["o_orderpriority"], "o_orderkey", 3000), ["o_orderpriority"]))


@query("smp_04_adaptive_bins", """
SELECT 'price' AS col, i AS edge_no, round(list_extract(q, i + 1), 4) AS edge FROM (SELECT quantile_cont(o_totalprice, [i / 9 for i in range(10)]) AS q FROM orders), (SELECT unnest(range(10)) AS i)""")
def smp_04(spark, sf):
    o = roles.table(spark, sf, "orders").select(F.col("o_totalprice").alias("price"))
    return sm.adaptive_bins(o, ["price"], 10).select("col", F.col("edge_no").cast("bigint").alias("edge_no"), F.round(F.col("edge").cast("double"), 4).alias("edge"))
