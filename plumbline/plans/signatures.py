"""Pattern library queries: every embedding searches all the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import roles
from plumbline.operators import quantised as qs
from plumbline.operators import search as vs
from plumbline.operators import signatures as sg
from plumbline.operators.longform import to_long
from plumbline.plans.oracle_parts import DIMS, FEATURES, LONG, with_
from plumbline.plans.profile import rounded
from plumbline.registry import query


def _part(i: int, scale: float, base: float) -> str:
    return f"greatest(0.0, least(100.0, floor(({base} + {scale} * CAST(embedding[{i + 1}] AS DOUBLE)) * 100) / 100))"


SIGS = f"""raw AS (SELECT *, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
sigs AS (SELECT vec_id AS signature_id, CAST(label AS BIGINT) AS cluster_id, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-10)) AS vector,
  {_part(0, 150.0, 50.0)} AS collapse_score, (vec_id * 7) % 13 AS usage_count, label / 10 AS accuracy, abs(CAST(embedding[10] AS DOUBLE)) AS anomaly_score, embedding FROM raw),
sig_dims AS ({' UNION ALL '.join(f"SELECT vec_id AS signature_id, '{d}' AS dim_name, {_part(i + 1, 200.0, 60.0)} AS score FROM embeddings" for i, d in enumerate(roles.DIMENSIONS))}),
sims AS (SELECT q.signature_id AS query_id, m.signature_id AS match_id, list_dot_product(q.vector, m.vector) AS similarity FROM sigs q JOIN sigs m ON q.signature_id <> m.signature_id),
matches AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, match_id) AS rank FROM sims QUALIFY rank <= 5),
found AS (SELECT * FROM matches WHERE similarity >= 0.7),
aligned AS (SELECT query_id, match_id, similarity, rank, coalesce(avg(CASE WHEN p.score < 65 AND n.score < 65 THEN 1.0 WHEN p.score >= 65 AND n.score >= 65 THEN 0.8 ELSE 0.3 END), 0.5) AS alignment
  FROM found LEFT JOIN sig_dims p ON p.signature_id = match_id LEFT JOIN sig_dims n ON n.signature_id = query_id AND n.dim_name = p.dim_name GROUP BY ALL),
judged AS (SELECT a.*, s.collapse_score, s.usage_count, s.anomaly_score, least(100.0, 0.4 * similarity * 100 + 0.3 * CASE WHEN accuracy > 0 THEN accuracy * 100 ELSE 80.0 END
  + 0.15 * (70 + least(1.0, usage_count / 10.0) * 30) + 0.15 * alignment * 100) AS confidence FROM aligned a JOIN sigs s ON s.signature_id = match_id),
mdims AS (SELECT f.query_id, f.match_id, p.dim_name, p.score AS past, coalesce(n.score, 75.0) AS now, abs(p.score - coalesce(n.score, 75.0)) AS difference
  FROM found f JOIN sig_dims p ON p.signature_id = f.match_id LEFT JOIN sig_dims n ON n.signature_id = f.query_id AND n.dim_name = p.dim_name)"""


def sides(spark, sf):
    s = roles.signatures(spark, sf)
    return (s.select(F.col("signature_id").alias("query_id"), "vector"), s.select(F.col("signature_id").alias("match_id"), "vector"))


def dims(spark, sf, key):
    return roles.signatures(spark, sf).select(F.col("signature_id").alias(key), F.inline("dims"))


def found(spark, sf):
    return vs.search(*sides(spark, sf), k=5, threshold=0.7, how="exact")


@query("jon_08_exact_search", with_(SIGS) + "SELECT query_id, match_id, round(similarity, 6) AS similarity, rank FROM matches")
def jon_08(spark, sf):
    return rounded(vs.exact_search(*sides(spark, sf), k=5)).withColumn("rank", F.col("rank").cast("bigint"))


@query("jon_09_approximate_search")
def jon_09(spark, sf):
    return qs.quantised_search(*sides(spark, sf), k=5)


RECALLED = with_(SIGS) + "SELECT count(*) AS pairs, true AS enough FROM matches"


def enough(found, truth):
    """How many true matches there are, and whether nine in ten of them were found."""
    return vs.recall(found, truth).select("pairs", (F.col("recall") >= 0.9).alias("enough"))


@query("jon_09_recall", RECALLED)
def jon_09_recall(spark, sf):
    return enough(qs.quantised_search(*sides(spark, sf), k=5), vs.exact_search(*sides(spark, sf), k=5))


@query("jon_10_hybrid_search")
def jon_10(spark, sf):
    return qs.reranked_search(*sides(spark, sf), k=5)


@query("jon_10_recall", RECALLED)
def jon_10_recall(spark, sf):
    return enough(qs.reranked_search(*sides(spark, sf), k=5), vs.exact_search(*sides(spark, sf), k=5))


@query("sig_05_similar_patterns", with_(SIGS) + "SELECT query_id, match_id, round(similarity, 6) AS similarity, rank FROM found")
def sig_05(spark, sf):
    return rounded(found(spark, sf)).withColumn("rank", F.col("rank").cast("bigint"))


@query("flt_05_similarity_threshold", with_(SIGS) + "SELECT query_id, count(*) AS matches FROM found GROUP BY query_id")
def flt_05(spark, sf):
    return found(spark, sf).groupBy("query_id").agg(F.count("*").alias("matches"))


@query("jon_07_dimension_alignment", with_(SIGS) + "SELECT query_id, match_id, round(alignment, 6) AS alignment FROM aligned")
def jon_07(spark, sf):
    a = sg.alignment(found(spark, sf), dims(spark, sf, "match_id"), dims(spark, sf, "query_id"))
    return rounded(a.select("query_id", "match_id", "alignment"))


def judged(spark, sf):
    a = sg.alignment(found(spark, sf), dims(spark, sf, "match_id"), dims(spark, sf, "query_id"))
    s = roles.signatures(spark, sf).select(F.col("signature_id").alias("match_id"), "collapse_score", "usage_count", "accuracy", "anomaly_score")
    c = F.col
    return a.join(s, "match_id").withColumn("confidence", sg.confidence(c("similarity"), c("accuracy"), c("usage_count"), c("alignment"))).withColumn(
        "uncertainty", sg.uncertainty(c("similarity"), c("usage_count"), c("anomaly_score"))).withColumn("risk_level", sg.risk_level(c("collapse_score"), c("confidence")))


@query("sig_06_match_judgement", with_(SIGS) + """
SELECT query_id, match_id, round(confidence, 6) AS confidence, round(least(100.0, (1 - similarity) * 50 + greatest(0, 30 - usage_count * 3) + anomaly_score * 20), 6) AS uncertainty,
  CASE WHEN collapse_score < 30 AND confidence > 70 THEN 'CRITICAL' WHEN collapse_score < 50 AND confidence > 60 THEN 'HIGH' WHEN collapse_score < 65 AND confidence > 50 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
FROM judged""")
def sig_06(spark, sf):
    return rounded(judged(spark, sf).select("query_id", "match_id", "confidence", "uncertainty", "risk_level"))


@query("sig_09_match_explanation", with_(SIGS) + """
SELECT query_id, match_id, array_to_string(coalesce(list(dim_name ORDER BY dim_name) FILTER (difference < 15), []), ',') AS matching,
  array_to_string(coalesce(list(dim_name ORDER BY dim_name) FILTER (difference >= 15), []), ',') AS mismatching,
  concat_ws(',', CASE WHEN count(*) FILTER (difference < 15) > 4 THEN 'strong match' END, CASE WHEN any_value(s.collapse_score) < 50 THEN 'severe collapse' END, CASE WHEN any_value(s.usage_count) > 5 THEN 'well validated' END) AS insights
FROM mdims JOIN sigs s ON s.signature_id = match_id GROUP BY query_id, match_id""")
def sig_09(spark, sf):
    s = roles.signatures(spark, sf).select(F.col("signature_id").alias("match_id"), "collapse_score", "usage_count")
    d = sg.match_dimensions(found(spark, sf).join(s, "match_id"), dims(spark, sf, "match_id"), dims(spark, sf, "query_id"))
    e = sg.explain(d)
    return e.select("query_id", "match_id", *[F.array_join(c, ",").alias(c) for c in ("matching", "mismatching", "insights")])


@query("sig_10_history_advice", with_(SIGS) + """
SELECT query_id, match_id, place, dim_name, CASE WHEN now < 65 THEN 'attend' ELSE 'monitor' END AS advice FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, match_id ORDER BY past, dim_name) AS place FROM mdims WHERE past < 65) WHERE place <= 3""")
def sig_10(spark, sf):
    d = sg.match_dimensions(found(spark, sf), dims(spark, sf, "match_id"), dims(spark, sf, "query_id"))
    return sg.history_advice(d).withColumn("place", F.col("place").cast("bigint"))


@query("win_07_worst_dimensions", with_(DIMS) + """
SELECT validation_id, dim_name, score, place FROM (SELECT *, row_number() OVER (PARTITION BY validation_id ORDER BY score, dim_name) AS place FROM dims WHERE score < 65) WHERE place <= 3""")
def win_07(spark, sf):
    from plumbline.operators.service_tables import latest_per_owner

    d = roles.validation_dimensions(spark, sf).filter("score < 65").select("validation_id", "dim_name", "score")
    return latest_per_owner(d, "validation_id", [F.col("score"), F.col("dim_name")], 3).select("validation_id", "dim_name", "score", F.col("rank").cast("bigint").alias("place"))


FEATURES_SQL = DIMS + """, st AS (SELECT l_orderkey AS validation_id, avg(l_extendedprice) AS mean, stddev_pop(l_extendedprice) AS std, min(l_extendedprice) AS min, max(l_extendedprice) AS max FROM lineitem GROUP BY 1),
slots AS (SELECT validation_id, dim_no AS slot, score / 100 AS value FROM dims
  UNION ALL SELECT v.validation_id, 8 + i, CASE i WHEN 0 THEN mean WHEN 1 THEN std WHEN 2 THEN min ELSE max END FROM validations v JOIN st ON v.validation_id = st.validation_id, (SELECT unnest(range(4)) AS i))"""


@query("sig_01_raw_features", with_(FEATURES_SQL) + "SELECT validation_id, CAST(slot AS BIGINT) AS slot, round(value, 7) AS value FROM slots WHERE value <> 0")
def sig_01(spark, sf):
    return features(spark, sf).select("validation_id", sg.filled_slots(F.col("raw"))).select(
        "validation_id", F.col("slot").cast("bigint").alias("slot"), F.round("value", 7).alias("value"))


def features(spark, sf):
    scores = sg.scores_by_name(roles.validation_dimensions(spark, sf), "validation_id")
    v = F.col("l_extendedprice")
    one = roles.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("validation_id")).agg(
        F.create_map(F.lit("mean"), F.avg(v), F.lit("std"), F.stddev_pop(v), F.lit("min"), F.min(v), F.lit("max"), F.max(v)).alias("stats"))
    both = scores.join(one, "validation_id", "left").withColumn("stats", F.coalesce("stats", F.create_map().cast("map<string,double>")))
    return both.select("validation_id", sg.raw_features(F.col("scores"), F.col("stats")).alias("raw"))


@query("sig_02_fingerprint", with_(LONG) + "SELECT round(avg(val), 6) AS mean, round(stddev_pop(val), 6) AS std, min(val) AS min, max(val) AS max FROM long")
def sig_02(spark, sf):
    return rounded(sg.fingerprint(to_long(roles.pair(spark, sf), FEATURES)))


@query("sig_03_normalised", with_(SIGS) + "SELECT signature_id, round(list_dot_product(vector, vector), 6) AS squared, round(vector[1], 6) AS first FROM sigs")
def sig_03(spark, sf):
    v = F.col("vector")
    return rounded(roles.signatures(spark, sf).select("signature_id", vs.dot(v, v).alias("squared"), v[0].alias("first")))


@query("sig_04_learned_embedding")
def sig_04(spark, sf):
    e = sg.learned_embedding(features(spark, sf), "raw", 8)
    return e.select("validation_id", vs.normalised(F.col("vector")).alias("vector"))


@query("sig_11_feedback_average", """
WITH f AS (SELECT user_id, value / 500 AS feedback, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS age, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, max(n) AS usage_count, round(sum(feedback * 0.1 * 0.9 ** age) + 0.5 * 0.9 ** max(n), 6) AS accuracy FROM f GROUP BY user_id""")
def sig_11(spark, sf):
    f = roles.table(spark, sf, "events").select("user_id", "event_id", (F.col("value") / 500).alias("feedback"))
    return rounded(sg.feedback_average(f, "user_id", ["event_id"], 0.5))


@query("sig_12_signature_upsert", with_(SIGS) + """
SELECT cluster_id AS id, max(signature_id) AS version, arg_max(collapse_score, signature_id) AS collapse_score FROM sigs GROUP BY cluster_id""")
def sig_12(spark, sf):
    from plumbline.operators.service_tables import upsert

    s = roles.signatures(spark, sf).select(F.col("cluster_id").alias("id"), F.col("signature_id").alias("version"), "collapse_score")
    held = s.groupBy("id").agg(F.min("version").alias("version"), F.min_by("collapse_score", "version").alias("collapse_score"))
    return upsert(held, s, "id", "version")


@query("sig_13_clusters")
def sig_13(spark, sf):
    return sg.clusters(roles.signatures(spark, sf), "signature_id")


@query("sig_14_window_means", """
WITH f AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, CASE WHEN n < 10 THEN pos ELSE pos // 10 END AS "window", round(avg(o_totalprice), 4) AS mean FROM f WHERE n < 10 OR pos // 10 < n // 10 GROUP BY 1, 2""")
def sig_14(spark, sf):
    w = sg.window_means(roles.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", ["o_orderkey"], "o_totalprice")
    return w.withColumn("mean", F.round("mean", 4))


@query("sig_15_prescreen", with_(SIGS) + """
SELECT signature_id AS query_id, CAST(CASE WHEN b IS NULL THEN 10 WHEN b > 0.9 THEN 85 ELSE trunc(b * 100) END AS BIGINT) AS risk,
  CASE WHEN b IS NULL THEN 10 WHEN b > 0.9 THEN 85 ELSE trunc(b * 100) END < 70 AS proceed
FROM sigs LEFT JOIN (SELECT query_id, max(similarity) AS b FROM found GROUP BY 1) ON query_id = signature_id""")
def sig_15(spark, sf):
    q, _ = sides(spark, sf)
    return sg.prescreen(found(spark, sf), q.select("query_id")).withColumn("risk", F.col("risk").cast("bigint"))


@query("sig_16_prescreen_by_count", with_(SIGS) + """
SELECT signature_id AS query_id, CAST(CASE WHEN n IS NULL THEN 25 ELSE least(50, n * 10) END AS BIGINT) AS risk, true AS proceed
FROM sigs LEFT JOIN (SELECT query_id, count(*) AS n FROM found GROUP BY 1) ON query_id = signature_id""")
def sig_16(spark, sf):
    q, _ = sides(spark, sf)
    return sg.prescreen_by_count(found(spark, sf), q.select("query_id")).withColumn("risk", F.col("risk").cast("bigint"))


@query("agg_21_library_statistics", with_(SIGS) + """
SELECT count(*) AS signatures, round(avg(collapse_score), 6) AS mean, round(stddev_pop(collapse_score), 6) AS std, min(collapse_score) AS min, max(collapse_score) AS max,
  round(median(collapse_score), 6) AS median, round(avg(CASE WHEN collapse_score < 65 THEN 1.0 ELSE 0.0 END), 6) AS collapse_rate, count(DISTINCT cluster_id) AS clusters, count(*) / count(DISTINCT cluster_id) AS mean_cluster_size FROM sigs""")
def agg_21(spark, sf):
    return rounded(sg.library_statistics(roles.signatures(spark, sf)))
