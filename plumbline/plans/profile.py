"""Profiling and diversity queries over the line items."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from plumbline import roles
from plumbline.operators import carried as ca
from plumbline.operators import column_stats as cs
from plumbline.operators import longform as lf
from plumbline.plans.oracle_parts import FEATURES, LONG, with_
from plumbline.registry import query
from plumbline.streaming.run import file_stream, run_batches, shared_folder


def rounded(df, *ints):
    """Doubles to six decimals, so that summation order does not show."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


STATS = """stats AS (
  SELECT col, count(*) AS rows, CAST(sum(CASE WHEN val IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls, count(val) AS count, avg(val) AS mean,
         stddev_samp(val) AS std, min(val) AS min, max(val) AS max, skewness(val) AS skew, kurtosis(val) AS kurtosis,
         quantile_cont(val, 0.25) AS q25, quantile_cont(val, 0.5) AS median, quantile_cont(val, 0.75) AS q75,
         count(DISTINCT val) AS "distinct"
  FROM long GROUP BY col)"""

SCORED = """scored AS (
  SELECT *, (spread + uniqueness + balance) / 3 AS diversity FROM (
    SELECT *, CASE WHEN mean = 0 THEN 50.0 ELSE least(100.0, abs(std / mean) * 50) END AS spread,
      least(100.0, "distinct" / count * 100) AS uniqueness,
      CASE WHEN q75 = q25 THEN 50.0 ELSE greatest(0.0, least(100.0, (1 - abs((median - q25) - (q75 - median)) / (q75 - q25)) * 100)) END AS balance,
      abs(skew) AS skew_factor,
      CASE WHEN q75 = q25 THEN 0.0 WHEN min < q25 - 1.5 * (q75 - q25) OR max > q75 + 1.5 * (q75 - q25) THEN 5.0 ELSE 0.0 END AS outlier_pct
    FROM stats))"""


@query("agg_01_column_stats", with_(LONG, STATS) + """
SELECT col, rows, nulls, count, round(mean, 6) AS mean, round(std, 6) AS std, min, max, round(skew, 6) AS skew,
       round(kurtosis, 6) AS kurtosis, round(q25, 6) AS q25, round(median, 6) AS median, round(q75, 6) AS q75, "distinct" FROM stats""")
def agg_01(spark, sf):
    return rounded(cs.column_stats(roles.pair(spark, sf), FEATURES))


@query("agg_02_mergeable_stats", with_(LONG) + """
SELECT col, count(val) AS count, round(sum(val), 2) AS sum, round(avg(val), 6) AS mean, round(stddev_pop(val), 6) AS std,
       min(val) AS min, max(val) AS max FROM long GROUP BY col""")
def agg_02(spark, sf):
    s = cs.mergeable_stats(roles.pair(spark, sf), FEATURES).drop("q25", "median", "q75")
    return s.withColumns({"sum": F.round("sum", 2), "mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("agg_02_sketched_quantiles")
def agg_02_quantiles(spark, sf):
    return cs.mergeable_stats(roles.pair(spark, sf), FEATURES).select("col", "q25", "median", "q75")


CARRIED = """SELECT col, count(val) AS count, round(avg(val), 4) AS mean, round(stddev_pop(val), 4) AS std, min(val) AS min, max(val) AS max,
  true AS quantiles_close, true AS distinct_close FROM long GROUP BY col"""


def carried_result(spark, sf, states):
    """What merged states say, and whether their estimates hold: ranks within 3 %, distinct counts within 6 %."""
    done = ca.finished(ca.merged_states(states))
    rows = lf.to_long(roles.pair(spark, sf), FEATURES)
    val = F.col("val")
    ranks = rows.join(F.broadcast(done.select("col", *ca.QUANTILES)), "col").groupBy("col").agg(  # one row per column
        F.count_distinct("val").alias("exact"), F.count("*").alias("rows"),
        *[F.count_if(val < F.col(q)).alias(f"below_{q}") for q in ca.QUANTILES], *[F.count_if(val <= F.col(q)).alias(f"upto_{q}") for q in ca.QUANTILES])
    worst = F.greatest(*[ca.rank_error(F.col(f"below_{q}"), F.col(f"upto_{q}"), F.col("rows"), share) for q, share in ca.QUANTILES.items()])
    return done.join(ranks, "col").select(
        "col", "count", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min", "max", (worst <= 0.03).alias("quantiles_close"), (F.abs(F.col("distinct") / F.col("exact") - 1) <= 0.06).alias("distinct_close"))


@query("agg_02_carried_states", with_(LONG) + CARRIED)
def agg_02_carried(spark, sf):
    """A state per chunk of lines, stored; the statistics come from the stored states alone."""
    path = os.path.join(shared_folder(spark), "states")
    pair = roles.pair(spark, sf).withColumn("chunk", F.pmod(F.xxhash64(*FEATURES), F.lit(7)))
    ca.chunk_states(pair, FEATURES, ["chunk"]).write.parquet(path)
    return carried_result(spark, sf, spark.read.parquet(path))


@query("src_11_carried_scan", with_(LONG) + CARRIED)
def src_11_carried(spark, sf):
    """The lines arrive as files; every micro-batch leaves its states behind, and only these are merged."""
    folder = shared_folder(spark)
    pair = roles.pair(spark, sf)
    pair.repartition(4, *FEATURES).write.parquet(os.path.join(folder, "arriving"))
    arriving = file_stream(spark, os.path.join(folder, "arriving"), pair.schema, files_per_batch=1)
    return carried_result(spark, sf, run_batches(arriving, lambda batch: ca.chunk_states(batch, FEATURES)))


PROFILE_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS col, '{t}' AS data_type, count(*) AS rows, CAST(count(*) - count({c}) AS BIGINT) AS null_count,
    count(DISTINCT {c}) AS unique_count, {num[0]} AS min_value, {num[1]} AS max_value, {num[2]} AS mean_value, {num[3]} AS std_dev,
    (count(*) - count({c})) / count(*) AS null_rate, round(count(DISTINCT {c}) / count(*), 6) AS unique_rate FROM orders"""
    for c, t, num in [
        (c, t, (f"CAST(min({c}) AS DOUBLE)", f"CAST(max({c}) AS DOUBLE)", f"round(avg({c}), 4)", f"round(stddev_samp({c}), 4)") if n
         else ("CAST(NULL AS DOUBLE)",) * 4)
        for c, t, n in [("o_orderkey", "bigint", 1), ("o_custkey", "bigint", 1), ("o_orderstatus", "string", 0),
                        ("o_totalprice", "double", 1), ("o_orderdate", "timestamp_ntz", 0), ("o_orderpriority", "string", 0)]])


@query("agg_03_dataset_profile", PROFILE_SQL)
def agg_03(spark, sf):
    p = cs.profile(roles.table(spark, sf, "orders"))
    return p.withColumns({"mean_value": F.round("mean_value", 4), "std_dev": F.round("std_dev", 4),
                          "null_rate": F.round("null_rate", 6), "unique_rate": F.round("unique_rate", 6)})


@query("agg_04_data_quality", with_(LONG, STATS) + """
SELECT rows, duplicate_rows, outlier_count, completeness, round(uniqueness, 6) AS uniqueness, validity,
       round((completeness + uniqueness + validity) / 3 * 100, 6) AS quality_score
FROM (SELECT count(*) AS rows, count(*) - count(DISTINCT (CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END, l_quantity, l_extendedprice, l_discount, l_tax)) AS duplicate_rows,
        count(DISTINCT (CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END, l_quantity, l_extendedprice, l_discount, l_tax)) / count(*) AS uniqueness,
        (count(l_linestatus) + count(l_quantity) + count(l_extendedprice) + count(l_discount) + count(l_tax)) / (count(*) * 5) AS completeness,
        CAST(1.0 AS DOUBLE) AS validity FROM lineitem),
     (SELECT count(*) AS outlier_count FROM long JOIN stats USING (col)
      WHERE val < q25 - 1.5 * (q75 - q25) OR val > q75 + 1.5 * (q75 - q25))""")
def agg_04(spark, sf):
    df = roles.pair(spark, sf)
    return rounded(cs.quality_report(df, cs.column_stats(df, FEATURES), FEATURES))


@query("agg_05_diversity_columns", with_(LONG, STATS, SCORED) + """
SELECT col, round(spread, 6) AS spread, round(uniqueness, 6) AS uniqueness, round(balance, 6) AS balance,
       round(diversity, 6) AS diversity, round(skew_factor, 6) AS skew_factor, CAST(outlier_pct AS DOUBLE) AS outlier_pct FROM scored""")
def agg_05(spark, sf):
    d = cs.diversity_columns(cs.column_stats(roles.pair(spark, sf), FEATURES))
    return rounded(d.select("col", "spread", "uniqueness", "balance", "diversity", "skew_factor", "outlier_pct"))


@query("agg_10_outlier_percent", with_(LONG, STATS) + """
SELECT col, CAST(sum(CASE WHEN o THEN 1 ELSE 0 END) AS BIGINT) AS outliers, round(sum(CASE WHEN o THEN 1 ELSE 0 END) * 100.0 / count(*), 6) AS outlier_percent
FROM (SELECT col, val < q25 - 1.5 * (q75 - q25) OR val > q75 + 1.5 * (q75 - q25) AS o FROM long JOIN stats USING (col)) GROUP BY col""")
def agg_10(spark, sf):
    df = roles.pair(spark, sf)
    return rounded(cs.outlier_percent(df, cs.column_stats(df, FEATURES), FEATURES))


def corr_sql(source: str, group: str | None = None) -> str:
    g = f"{group} AS side, " if group else ""
    tail = " GROUP BY 1" if group else ""
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    return " UNION ALL ".join(
        f"SELECT {g}{i} AS i, {j} AS j, '{FEATURES[i]}' AS col_i, '{FEATURES[j]}' AS col_j, corr({FEATURES[i]}, {FEATURES[j]}) AS r FROM {source}{tail}"
        for i, j in pairs)


@query("agg_11_correlation_matrix", f"SELECT i, j, col_i, col_j, round(r, 6) AS r FROM ({corr_sql('lineitem')})")
def agg_11(spark, sf):
    return rounded(cs.correlations(roles.pair(spark, sf), FEATURES))


@query("agg_12_mergeable_correlations", f"SELECT side, i, j, col_i, col_j, round(r, 6) AS r FROM ({corr_sql('lineitem', chr(39).join(['CASE WHEN l_linestatus = ', 'F', ' THEN ', 'original', ' ELSE ', 'synthetic', ' END']))})")
def agg_12(spark, sf):
    return rounded(cs.gram_correlations(roles.pair(spark, sf), FEATURES, ["side"]))


@query("agg_13_sample_quality", with_(LONG, STATS) + """
SELECT rows, round(coverage, 6) AS coverage, round(least(1.0, rows / 1000000) * 100 * 0.6 + coverage * 0.4, 6) AS sample_quality
FROM (SELECT max(rows) AS rows, avg(CASE WHEN mean <> 0 THEN least(100.0, std / abs(mean) * 50) END) AS coverage FROM stats)""")
def agg_13(spark, sf):
    s = cs.diversity_summary(cs.diversity_columns(cs.column_stats(roles.pair(spark, sf), FEATURES)))
    return rounded(s.select("rows", "coverage", "sample_quality"))


@query("agg_14_overall_diversity", with_(LONG, STATS, SCORED) + """
SELECT columns, round(mean_diversity, 6) AS mean_diversity,
       round(mean_diversity * 0.7 + (least(1.0, rows / 1000000) * 100 * 0.6 + coverage * 0.4) * 0.3, 6) AS overall
FROM (SELECT count(*) AS columns, max(rows) AS rows, avg(diversity) AS mean_diversity,
             avg(CASE WHEN mean <> 0 THEN least(100.0, std / abs(mean) * 50) END) AS coverage FROM scored)""")
def agg_14(spark, sf):
    s = cs.diversity_summary(cs.diversity_columns(cs.column_stats(roles.pair(spark, sf), FEATURES)))
    return rounded(s.select("columns", "mean_diversity", "overall"))


@query("agg_15_diversity_advice", with_(LONG, STATS, SCORED) + """
SELECT col AS subject, 'low_diversity' AS rule, round(diversity, 6) AS measure FROM scored WHERE diversity < 30
UNION ALL SELECT col, 'high_skew', round(skew_factor, 6) FROM scored WHERE skew_factor > 2
UNION ALL SELECT col, 'many_outliers', outlier_pct FROM scored WHERE outlier_pct > 10
UNION ALL SELECT 'sample', 'low_sample_quality', round(q, 6) FROM (
  SELECT least(1.0, max(rows) / 1000000) * 100 * 0.6 + avg(CASE WHEN mean <> 0 THEN least(100.0, std / abs(mean) * 50) END) * 0.4 AS q FROM scored) WHERE q < 60""")
def agg_15(spark, sf):
    scored = cs.diversity_columns(cs.column_stats(roles.pair(spark, sf), FEATURES))
    return rounded(cs.diversity_advice(scored, cs.diversity_summary(scored)))


# ---------------------------------------------------------------- projections and filters


@query("prj_02_target_columns", "SELECT l_orderkey, l_quantity, l_discount FROM lineitem")
def prj_02(spark, sf):
    return roles.table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_discount")


@query("prj_03_scrub", """
SELECT o_orderkey, CASE WHEN isnan(x) THEN 0.0 WHEN x = 'infinity'::DOUBLE THEN 1e10 WHEN x = '-infinity'::DOUBLE THEN -1e10 ELSE x END AS x
FROM (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'nan'::DOUBLE WHEN o_orderpriority = '2-HIGH' THEN 'infinity'::DOUBLE
  WHEN o_orderpriority = '5-LOW' THEN '-infinity'::DOUBLE ELSE o_totalprice END AS x FROM orders)""")
def prj_03(spark, sf):
    p = F.col("o_orderpriority")
    dirty = F.when(p == "1-URGENT", float("nan")).when(p == "2-HIGH", float("inf")).when(p == "5-LOW", float("-inf"))
    return roles.table(spark, sf, "orders").select("o_orderkey", lf.scrub(dirty.otherwise(F.col("o_totalprice"))).alias("x"))


@query("prj_06_long_form", with_(LONG) + "SELECT side, col, val FROM long WHERE val IS NOT NULL")
def prj_06(spark, sf):
    return lf.to_long(roles.pair(spark, sf), FEATURES, ["side"])


@query("flt_08_nulls_per_column", """
SELECT col, count(val) AS kept, CAST(count(*) - count(val) AS BIGINT) AS dropped FROM (
  SELECT 'urgent_price' AS col, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END AS val FROM orders
  UNION ALL SELECT 'price', o_totalprice FROM orders) GROUP BY col""")
def flt_08(spark, sf):
    df = roles.table(spark, sf, "orders").select(
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice")).alias("urgent_price"), F.col("o_totalprice").alias("price"))
    cols = ["urgent_price", "price"]
    kept = lf.to_long(df, cols).groupBy("col").agg(F.count("*").alias("kept"))
    return cs.null_counts(df, cols).join(kept, "col").select("col", "kept", F.col("nulls").alias("dropped"))


@query("set_03_distinct_counts", with_(LONG) + 'SELECT col, count(DISTINCT val) AS "distinct" FROM long GROUP BY col')
def set_03(spark, sf):
    return lf.value_counts(lf.to_long(roles.pair(spark, sf), FEATURES)).groupBy("col").agg(F.count("*").alias("distinct"))
