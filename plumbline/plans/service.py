"""Queries over the service tables: orders as runs, customers as datasets, events as requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import roles
from plumbline.operators import longform as lf
from plumbline.operators import service_tables as st
from plumbline.operators.collapse import OVERALL_THRESHOLD
from plumbline.plans.oracle_parts import DATASETS, DIMS, LONG, VALIDATIONS, with_
from plumbline.plans.profile import rounded
from plumbline.registry import query

V = with_(VALIDATIONS)
VD = with_(VALIDATIONS, DATASETS)


# ---------------------------------------------------------------- projections


@query("prj_07_risk_projection", V + """
SELECT validation_id, risk AS risk_score, CASE WHEN risk < 25 THEN 'low' WHEN risk < 60 THEN 'medium' ELSE 'high' END AS risk_level,
       risk < 25 AS warranty_eligible, CASE WHEN status = 'completed' AND collapse_score >= 65 THEN 'approved' ELSE 'rejected' END AS recommendation
FROM (SELECT validation_id, status, collapse_score, CAST(trunc(100 - collapse_score) AS BIGINT) AS risk FROM validations)""")
def prj_07(spark, sf):
    # a finished run whose score passes is approved for training
    approved = (F.col("status") == "completed") & (F.col("collapse_score") >= OVERALL_THRESHOLD)
    return roles.validations(spark, sf).select("validation_id", *st.risk_projection(F.col("collapse_score"), approved))


@query("prj_08_predicted_performance", V + """
SELECT validation_id, round(0.85 + collapse_score / 100 * 0.1, 6) AS accuracy, round(0.82 + collapse_score / 100 * 0.08, 6) AS accuracy_low,
       round(0.88 + collapse_score / 100 * 0.12, 6) AS accuracy_high,
       round(greatest(0.0, least(1.0, (100 - collapse_score) / 100)), 6) AS collapse_probability FROM validations""")
def prj_08(spark, sf):
    return rounded(roles.validations(spark, sf).select("validation_id", *st.performance_projection(F.col("collapse_score"))))


@query("prj_09_public_dimensions", with_(DIMS) + """
SELECT validation_id,
  CAST(trunc(max(CASE WHEN dim_name = 'distribution_fidelity' THEN score END)) AS BIGINT) AS distribution_fidelity,
  CAST(trunc(max(CASE WHEN dim_name = 'correlation_preservation' THEN score END)) AS BIGINT) AS correlation_preservation,
  CAST(trunc(max(CASE WHEN dim_name = 'statistical_consistency' THEN score END)) AS BIGINT) AS rare_pattern_handling,
  CAST(trunc(max(CASE WHEN dim_name = 'entropy_stability' THEN score END)) AS BIGINT) AS temporal_stability,
  CAST(trunc(max(CASE WHEN dim_name = 'spectral_coherence' THEN score END)) AS BIGINT) AS semantic_coherence,
  CAST(trunc(max(collapse_score)) AS BIGINT) AS diversity_retention
FROM dims GROUP BY validation_id""")
def prj_09(spark, sf):
    return st.public_dimensions(roles.validation_dimensions(spark, sf), "validation_id", F.col("collapse_score"))


@query("prj_10_warranty_coverage", """
SELECT c_custkey, c_mktsegment, CAST(coalesce(nullif(asked, 0), CASE kind WHEN 'premium' THEN 500000 WHEN 'enterprise' THEN 1000000 ELSE 100000 END) AS BIGINT) AS coverage_amount
FROM (SELECT c_custkey, c_mktsegment, CASE c_mktsegment WHEN 'MACHINERY' THEN 'premium' WHEN 'AUTOMOBILE' THEN 'enterprise' WHEN 'BUILDING' THEN 'standard' ELSE 'other' END AS kind,
             CASE WHEN c_acctbal > 5000 THEN CAST(floor(c_acctbal) AS BIGINT) ELSE 0 END AS asked FROM customer)""")
def prj_10(spark, sf):
    seg = F.col("c_mktsegment")
    kind = F.when(seg == "MACHINERY", "premium").when(seg == "AUTOMOBILE", "enterprise").when(seg == "BUILDING", "standard").otherwise("other")
    asked = F.when(F.col("c_acctbal") > 5000, F.floor("c_acctbal")).otherwise(0)
    return roles.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", st.coverage(kind, asked).cast("bigint").alias("coverage_amount"))


@query("prj_11_estimated_completion", """
SELECT o_orderkey, o_orderdate + CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN INTERVAL 12 HOUR
  WHEN o_orderpriority = '5-LOW' THEN INTERVAL 48 HOUR ELSE INTERVAL 24 HOUR END AS estimated_completion FROM orders""")
def prj_11(spark, sf):
    p = F.col("o_orderpriority")
    name = F.when(p.isin("1-URGENT", "2-HIGH"), "high").when(p == "5-LOW", "low").otherwise("normal")
    return roles.table(spark, sf, "orders").select("o_orderkey", st.estimated_completion(F.col("o_orderdate"), name).alias("estimated_completion"))


@query("prj_12_signature_id", """
SELECT vec_id, substr(sha256(CAST(label AS VARCHAR) || '_' || array_to_string(list_transform(embedding[1:10], lambda x: CAST(CAST(floor(CAST(x AS DOUBLE) * 1000) AS BIGINT) AS VARCHAR)), ',')), 1, 16) AS signature_id
FROM embeddings""")
def prj_12(spark, sf):
    return roles.table(spark, sf, "embeddings").select("vec_id", st.signature_id(F.col("label"), F.col("embedding")).alias("signature_id"))


@query("prj_13_username", """
SELECT c_custkey, coalesce(CASE WHEN c_mktsegment = 'BUILDING' THEN c_name END, split_part(lower(c_mktsegment) || '.' || c_custkey || '@example.com', '@', 1)) AS username FROM customer""")
def prj_13(spark, sf):
    mail = F.concat(F.lower("c_mktsegment"), F.lit("."), F.col("c_custkey").cast("string"), F.lit("@example.com"))
    name = F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_name"))
    return roles.table(spark, sf, "customer").select("c_custkey", st.username(name, mail).alias("username"))


# ---------------------------------------------------------------- filters


@query("flt_02_owner_and_status", V + "SELECT user_id, count(*) AS completed FROM validations WHERE status = 'completed' GROUP BY user_id")
def flt_02(spark, sf):
    return st.of_owner(roles.validations(spark, sf), "completed").groupBy("user_id").agg(F.count("*").alias("completed"))


@query("flt_03_history_filter", V + """
SELECT validation_id, risk_level, created_at FROM validations WHERE status = 'completed' AND created_at >= TIMESTAMP '1997-01-01'
  AND created_at <= TIMESTAMP '1998-12-31' AND (risk_level IS NULL OR risk_level = 'medium')""")
def flt_03(spark, sf):
    return st.history(roles.validations(spark, sf), "1997-01-01", "1998-12-31", "medium").select("validation_id", "risk_level", "created_at")


@query("flt_07_expiry_cleanup", """
SELECT event_id, expires_at, CASE WHEN locked_until >= TIMESTAMP '2024-01-15' THEN locked_until END AS locked_until
FROM (SELECT event_id, ts + INTERVAL 7 DAY AS expires_at, CASE WHEN event_type = 'error' THEN ts + INTERVAL 15 MINUTE END AS locked_until FROM events)
WHERE expires_at >= TIMESTAMP '2024-01-15'""")
def flt_07(spark, sf):
    e = roles.security_events(spark, sf)
    ts = F.col("ts")
    rows = e.select("event_id", (ts + F.expr("INTERVAL 7 DAYS")).alias("expires_at"),
                    F.when(F.col("event_type") == "error", ts + F.expr("INTERVAL 15 MINUTES")).alias("locked_until"))
    return st.expire(rows, F.lit("2024-01-15").cast("timestamp_ntz"))


@query("flt_09_soft_delete", V + """
SELECT validation_id, CASE WHEN status = 'pending' THEN 'deleted' ELSE status END AS status FROM validations WHERE priority <> 5""")
def flt_09(spark, sf):
    v = roles.validations(spark, sf).withColumn("deleted_at", F.when(F.col("priority") == 5, F.col("created_at")))
    marked = F.when(F.col("status") == "pending", "deleted").otherwise(F.col("status"))
    return st.live_only(v).select("validation_id", marked.alias("status"))


@query("flt_10_optional_predicate", "SELECT user_id, event_id FROM events WHERE event_type IN ('error', 'signup')")
def flt_10(spark, sf, unread_only: bool = True):
    e = roles.security_events(spark, sf)
    if unread_only:
        e = e.filter(F.col("event_type").isin("error", "signup"))
    return e.select("user_id", "event_id")


@query("jon_01_validation_dataset", VD + """
SELECT validation_id, coalesce(filename, 'Unknown') AS filename FROM validations LEFT JOIN (SELECT * FROM datasets WHERE row_count > 0) USING (dataset_id)""")
def jon_01(spark, sf):
    return st.with_dataset(roles.validations(spark, sf), roles.datasets(spark, sf).filter("row_count > 0")).select("validation_id", "filename")


@query("jon_02_semi_unexpired", """
SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate > TIMESTAMP '1999-01-01')""")
def jon_02(spark, sf):
    live = roles.table(spark, sf, "orders").filter(F.col("o_orderdate") > F.lit("1999-01-01").cast("timestamp_ntz"))
    return st.matching(roles.table(spark, sf, "customer").select("c_custkey", "c_name"),
                       live.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("jon_03_anti_blacklist", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'error')")
def jon_03(spark, sf):
    bad = roles.security_events(spark, sf).filter("event_type = 'error'").select(F.col("user_id").alias("c_custkey"))
    return st.matching(roles.table(spark, sf, "customer").select("c_custkey", "c_name"), bad, "c_custkey", "left_anti")


@query("jon_04_orphans", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def jon_04(spark, sf):
    kept = roles.table(spark, sf, "orders").filter("o_orderstatus <> 'P'")
    return st.orphans(roles.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), kept, "l_orderkey", "o_orderkey")


@query("jon_04_cascade", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def jon_04_cascade(spark, sf):
    kept = roles.table(spark, sf, "customer").filter("c_acctbal >= 0")
    return st.cascade(roles.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), kept, "o_custkey", "c_custkey")


@query("jon_05_warranty_eligibility", VD + """
SELECT v.validation_id, d.dataset_id, v.risk_score FROM validations v JOIN datasets d ON v.dataset_id = d.dataset_id AND v.user_id = d.user_id
WHERE v.status = 'completed' AND v.risk_score < 25""")
def jon_05(spark, sf):
    v = roles.validations(spark, sf).filter("status = 'completed' AND risk_score < 25")
    return v.join(roles.datasets(spark, sf), ["dataset_id", "user_id"]).select("validation_id", "dataset_id", "risk_score")


@query("jon_05_claim_within_coverage", """
SELECT o_orderkey AS warranty_id, l_linenumber, l_partkey, l_extendedprice AS claim_amount FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE o_orderstatus = 'F' AND l_extendedprice <= o_totalprice""")
def jon_05_claims(spark, sf):
    w = roles.table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("warranty_id"), "o_totalprice")
    c = roles.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("warranty_id"), "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("claim_amount"))
    return w.join(c, (w.warranty_id == c.warranty_id) & (c.claim_amount <= w.o_totalprice)).select(w.warranty_id, "l_linenumber", "l_partkey", "claim_amount")


# ---------------------------------------------------------------- aggregates


@query("agg_16_queue_stats", V + """
SELECT s.status, count(v.status) AS jobs FROM (VALUES ('pending'), ('queued'), ('processing'), ('completed'), ('failed'), ('cancelled')) s(status)
LEFT JOIN validations v ON v.status = s.status GROUP BY s.status UNION ALL SELECT 'total', count(*) FROM validations""")
def agg_16(spark, sf):
    return st.queue_stats(roles.validations(spark, sf))


@query("agg_17_usage", VD + """
SELECT coalesce(r.user_id, s.user_id) AS user_id, coalesce(validations, 0) AS validations, coalesce(completed, 0) AS completed,
       CASE WHEN completed > 0 THEN CAST(risk_sum // completed AS BIGINT) ELSE 0 END AS average_risk, coalesce(warranties, 0) AS warranties,
       coalesce(datasets, 0) AS datasets, coalesce(rows_validated, 0) AS rows_validated
FROM (SELECT user_id, count(*) AS validations, CAST(count(*) FILTER (status = 'completed') AS BIGINT) AS completed,
             CAST(coalesce(sum(risk_score) FILTER (status = 'completed'), 0) AS BIGINT) AS risk_sum,
             count(*) FILTER (status = 'completed' AND risk_score < 25) AS warranties FROM validations GROUP BY user_id) r
FULL OUTER JOIN (SELECT user_id, count(*) AS datasets, CAST(sum(row_count) AS BIGINT) AS rows_validated FROM datasets GROUP BY user_id) s ON r.user_id = s.user_id""")
def agg_17(spark, sf):
    return st.usage(roles.validations(spark, sf), roles.datasets(spark, sf))


@query("agg_18_history_trends", VD + """
SELECT month, runs, average_risk, thousand_rows, average_risk - lag(average_risk) OVER (ORDER BY month) AS risk_change FROM (
  SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS runs, CAST(trunc(avg(risk_score)) AS BIGINT) AS average_risk,
         CAST(sum(coalesce(row_count // 1000, 0)) AS BIGINT) AS thousand_rows
  FROM validations LEFT JOIN datasets USING (dataset_id) WHERE status = 'completed' GROUP BY 1)""")
def agg_18(spark, sf):
    return st.history_trends(st.history(roles.validations(spark, sf)), roles.datasets(spark, sf))


@query("agg_19_page_with_total", V + """
SELECT *, CAST(ceil(total / 20.0) AS BIGINT) AS total_pages FROM (
  SELECT validation_id, created_at, collapse_score, (SELECT count(*) FROM validations WHERE status = 'completed') AS total
  FROM validations WHERE status = 'completed' ORDER BY created_at DESC NULLS FIRST, validation_id LIMIT 20 OFFSET 40)""")
def agg_19(spark, sf):
    v = st.of_owner(roles.validations(spark, sf), "completed").select("validation_id", "created_at", "collapse_score")
    return st.page(v, 3, 500, [F.col("created_at").desc_nulls_first(), F.col("validation_id")])


@query("agg_20_unread_count", "SELECT user_id, count(*) FILTER (event_type = 'error') AS unread, count(*) AS notifications FROM events GROUP BY user_id")
def agg_20(spark, sf):
    return roles.security_events(spark, sf).groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "error").alias("unread"), F.count("*").alias("notifications"))


HIST = """hist AS (SELECT event_type, le, CAST(sum(CASE WHEN value <= le THEN 1 ELSE 0 END) AS BIGINT) AS cumulative
  FROM events, (SELECT unnest([1.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0, 600.0, 1800.0, 3600.0, 'infinity'::DOUBLE]) AS le) GROUP BY event_type, le)"""
# Duration bounds in seconds.
DURATION_BOUNDS = [1, 5, 10, 30, 60, 120, 300, 600, 1800, 3600]


@query("agg_22_cumulative_histogram", with_(HIST) + "SELECT event_type, le, cumulative FROM hist")
def agg_22(spark, sf):
    return st.histogram_by_label(roles.security_events(spark, sf), "event_type", "value", DURATION_BOUNDS)


@query("agg_23_counters", "SELECT event_type, user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type, user_id")
def agg_23(spark, sf):
    s = st.counter_summary(roles.security_events(spark, sf), ["event_type", "user_id"], "value", {"p50": 0.5})
    return s.select("event_type", "user_id", "n", F.round("total", 4).alias("total"))


@query("agg_23_quantile_summary", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def agg_23_quantiles(spark, sf):
    e = roles.security_events(spark, sf)
    counts = lf.value_counts(e.select(F.col("event_type").alias("col"), F.col("value").alias("val")))
    edges = lf.bucket_edges(e, ["value"])["value"]
    ranked = lf.running_counts(counts, ["n"], {lf.EVERY: edges})
    return rounded(lf.quantiles(ranked, {"p50": 0.5, "p95": 0.95, "p99": 0.99}).withColumnRenamed("col", "event_type"))


@query("agg_24_bucket_quantile", with_(HIST) + """
SELECT event_type, round(CASE WHEN le = 'infinity'::DOUBLE THEN lo ELSE lo + (le - lo) * (rank - below) / (cumulative - below) END, 6) AS quantile FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY le) AS rn FROM (
    SELECT event_type, le, cumulative, coalesce(lag(le) OVER w, 0.0) AS lo, coalesce(lag(cumulative) OVER w, 0) AS below,
           max(cumulative) OVER (PARTITION BY event_type) * 0.95 AS rank
    FROM hist WINDOW w AS (PARTITION BY event_type ORDER BY le)) WHERE cumulative >= rank) WHERE rn = 1""")
def agg_24(spark, sf):
    h = st.histogram_by_label(roles.security_events(spark, sf), "event_type", "value", DURATION_BOUNDS)
    return rounded(st.bucket_quantile(h, "event_type", 0.95))


@query("agg_25_cascade_summary", """
SELECT l_orderkey AS validation_id, count(*) AS models, round(sum(l_quantity), 4) AS total_time, round(avg(l_extendedprice), 6) AS mean_metric,
       max(l_extendedprice) AS best_metric, arg_max(l_partkey, (l_extendedprice, l_partkey)) AS best_model FROM lineitem GROUP BY l_orderkey""")
def agg_25(spark, sf):
    from plumbline.operators.runs import cascade_summary

    r = roles.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("validation_id"), F.col("l_partkey").alias("model_id"), F.col("l_extendedprice").alias("metric"), F.col("l_quantity").alias("seconds"))
    s = cascade_summary(r)
    return s.withColumns({"total_time": F.round("total_time", 4), "mean_metric": F.round("mean_metric", 6)})


# ---------------------------------------------------------------- windows, sorts, sets


@query("win_08_page_rows", V + """
SELECT validation_id, created_at, total, total_pages FROM (
  SELECT validation_id, created_at, count(*) OVER () AS total, CAST(ceil(count(*) OVER () / 50.0) AS BIGINT) AS total_pages,
         row_number() OVER (ORDER BY created_at DESC, validation_id) AS rn FROM validations) WHERE rn BETWEEN 51 AND 100""")
def win_08(spark, sf):
    return st.page(roles.validations(spark, sf).select("validation_id", "created_at"), 2, 50, [F.col("created_at").desc_nulls_first(), F.col("validation_id")])


@query("win_10_queue_position", V + """
SELECT user_id, validation_id, row_number() OVER (PARTITION BY user_id ORDER BY priority DESC, created_at, validation_id) AS position
FROM validations WHERE status = 'pending'""")
def win_10(spark, sf):
    return st.queue_positions(st.of_owner(roles.validations(spark, sf), "pending"), "user_id").select("user_id", "validation_id", "position")


@query("srt_01_newest_first", V + "SELECT validation_id, risk_score FROM validations ORDER BY risk_score DESC NULLS FIRST, validation_id LIMIT 100")
def srt_01(spark, sf):
    v = roles.validations(spark, sf).select("validation_id", "risk_score")
    return v.orderBy(F.col("risk_score").desc_nulls_first(), "validation_id").limit(100)


@query("srt_03_recent_per_owner", V + """
SELECT user_id, validation_id, created_at, rank FROM (
  SELECT user_id, validation_id, created_at, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, validation_id) AS rank FROM validations) WHERE rank <= 3""")
def srt_03(spark, sf):
    v = roles.validations(spark, sf).select("user_id", "validation_id", "created_at")
    out = st.latest_per_owner(v, "user_id", [F.col("created_at").desc(), F.col("validation_id")], 3)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


@query("srt_04_chosen_order", V + "SELECT validation_id, collapse_score FROM validations ORDER BY collapse_score, validation_id LIMIT 50")
def srt_04(spark, sf, by: str = "collapse_score", direction: str = "asc"):
    v = roles.validations(spark, sf)
    return v.orderBy(*st.sort_listing(v, by, direction), "validation_id").select("validation_id", by).limit(50)


@query("srt_05_top_k", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
def srt_05(spark, sf):
    return roles.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(
        F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber").limit(25)


@query("set_01_key_intersection", "SELECT l_partkey AS part FROM lineitem WHERE l_linestatus = 'F' INTERSECT SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O'")
def set_01(spark, sf):
    li = roles.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("part"), "l_linestatus")
    return li.groupBy("part").agg(F.bool_or(F.col("l_linestatus") == "F").alias("a"), F.bool_or(F.col("l_linestatus") == "O").alias("b")).filter("a AND b").select("part")


@query("set_02_labelled_union", with_(LONG) + "SELECT side, count(*) AS n, round(sum(val), 2) AS total FROM long WHERE col = 'l_quantity' GROUP BY side")
def set_02(spark, sf):
    df = roles.pair(spark, sf)
    a = df.filter("side = 'original'").select("l_quantity").withColumn("side", F.lit("original"))
    b = df.filter("side = 'synthetic'").select("l_quantity").withColumn("side", F.lit("synthetic"))
    return a.unionByName(b).groupBy("side").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"))


@query("set_04_key_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_04(spark, sf):
    o = roles.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return roles.table(spark, sf, "customer").select("c_custkey").distinct().join(o, "c_custkey", "left_anti")


@query("set_05_distinct_categories", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def set_05(spark, sf):
    return roles.table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("json_props", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def json_props(spark, sf):
    k = F.from_json("props", "k long")["k"]
    return rounded(roles.security_events(spark, sf).groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


# ---------------------------------------------------------------- row changes

CHANGES = """base AS (SELECT user_id AS id, max(event_id) AS version, count(*) AS hits FROM events WHERE event_type IN ('view', 'click') GROUP BY 1),
delta AS (SELECT user_id AS id, max(event_id) AS version, count(*) AS hits FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY 1)"""


def _changes(spark, sf):
    e = roles.security_events(spark, sf)
    kept = F.col("event_type").isin("view", "click")
    build = lambda d: d.groupBy(F.col("user_id").alias("id")).agg(F.max("event_id").alias("version"), F.count("*").alias("hits"))
    return build(e.filter(kept)), build(e.filter(~kept))


@query("snk_03_upsert", with_(CHANGES) + """
SELECT id, version, hits FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, hits DESC) AS rn
  FROM (SELECT * FROM base UNION ALL SELECT * FROM delta)) WHERE rn = 1""")
def snk_03(spark, sf):
    return st.upsert(*_changes(spark, sf), "id", "version")


@query("snk_04_insert_if_absent", """
WITH base AS (SELECT user_id AS id, max(event_id) AS version FROM events WHERE event_type = 'view' AND value < 10 GROUP BY 1),
delta AS (SELECT user_id AS id, event_id AS version FROM events WHERE event_type <> 'view')
SELECT * FROM base UNION ALL SELECT id, min(version) FROM delta WHERE id NOT IN (SELECT id FROM base) GROUP BY id""")
def snk_04(spark, sf):
    e = roles.security_events(spark, sf)
    base = e.filter("event_type = 'view' AND value < 10").groupBy(F.col("user_id").alias("id")).agg(F.max("event_id").alias("version"))
    delta = e.filter("event_type <> 'view'").select(F.col("user_id").alias("id"), F.col("event_id").alias("version"))
    return st.insert_if_absent(base, delta, "id", "version")


@query("snk_05_partial_update", with_(CHANGES) + """
SELECT b.id, coalesce(CASE WHEN d.hits > b.hits THEN d.version END, b.version) AS version, coalesce(d.hits, b.hits) AS hits
FROM base b LEFT JOIN delta d ON b.id = d.id""")
def snk_05(spark, sf):
    base, delta = _changes(spark, sf)
    seen = base.select("id", F.col("hits").alias("old"))
    newer = delta.join(seen, "id").select("id", F.when(F.col("hits") > F.col("old"), F.col("version")).alias("version"), "hits")
    return st.partial_update(base, newer, "id", ["version", "hits"])
