"""Designed samples and near-duplicate rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import roles
from plumbline.operators import sample_design as sd
from plumbline.operators import similar_rows as sr
from plumbline.plans.oracle_parts import with_
from plumbline.registry import query


def design_rows(spark, sf):
    """Orders in clusters by status, with two rare ones at the ends of the price range, by year."""
    price = F.col("o_totalprice")
    cluster = F.when(price >= 497000, "top").when(price < 2500, "bottom").otherwise(F.col("o_orderstatus"))
    return roles.table(spark, sf, "orders").select(
        "o_orderkey", cluster.alias("cluster"), F.year("o_orderdate").alias("period"), (F.dayofyear("o_orderdate") * F.floor(price)).cast("double").alias("score"))


DESIGN = """given AS (
  SELECT o_orderkey, CASE WHEN o_totalprice >= 497000 THEN 'top' WHEN o_totalprice < 2500 THEN 'bottom' ELSE o_orderstatus END AS cluster,
    year(o_orderdate) AS period, dayofyear(o_orderdate) * floor(o_totalprice) AS score, CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 13) AS BIGINT) AS h FROM orders),
sized AS (SELECT *, count(*) OVER () AS total, count(*) OVER (PARTITION BY cluster) AS n, row_number() OVER (ORDER BY score DESC, o_orderkey) AS rank FROM given),
marked AS (
  SELECT *, CASE WHEN n < 0.01 * total THEN least(5, greatest(2, floor(0.01 * total / n))) ELSE 0 END AS times,
    CASE WHEN n < 0.01 * total THEN 'rare' WHEN rank <= ceil(total * 0.001) THEN 'outlier' ELSE 'quota' END AS reason FROM sized),
wanted AS (SELECT (SELECT count(*) // 10 FROM given) - coalesce(sum(greatest(times, 1)), 0) AS wanted FROM marked WHERE reason <> 'quota'),
strata AS (
  SELECT *, count(*) OVER () AS s, sum(n) OVER () AS all_n FROM (SELECT cluster, period, count(*) AS n FROM marked WHERE reason = 'quota' GROUP BY ALL)),
dealt AS (
  SELECT *, CASE WHEN wanted >= s THEN 1 ELSE 0 END AS least_one FROM strata, wanted),
parts AS (
  SELECT *, CAST((wanted - least_one * s) * (n - least_one) AS BIGINT) AS x, CAST(greatest(all_n - least_one * s, 1) AS BIGINT) AS over FROM dealt),
quotas AS (
  SELECT *, least_one + x // over + CASE WHEN row_number() OVER (ORDER BY x % over DESC, cluster, period) <= wanted - least_one * s - sum(x // over) OVER () THEN 1 ELSE 0 END AS quota FROM parts)"""


@query("smp_06_stratum_quotas", with_(DESIGN) + "SELECT cluster, CAST(period AS INTEGER) AS period, n, CAST(quota AS BIGINT) AS quota FROM quotas")
def smp_06_quotas(spark, sf):
    rows = design_rows(spark, sf)
    sample = sd.designed_sample(rows, "cluster", "period", "score", "o_orderkey", rows.count() // 10)
    taken = sample.where("reason = 'quota'").groupBy("cluster", "period").agg(F.count("*").alias("quota"))
    fixed = sample.where("reason = 'outlier'").groupBy("cluster", "period").agg(F.count("*").alias("fixed"))
    strata = rows.groupBy("cluster", "period").agg(F.count("*").alias("n")).join(fixed, ["cluster", "period"], "left")
    return strata.join(taken, ["cluster", "period"]).select("cluster", "period", (F.col("n") - F.coalesce("fixed", F.lit(0))).alias("n"), "quota")


@query("smp_06_designed_sample", with_(DESIGN) + """
SELECT o_orderkey, m.cluster, CAST(m.period AS INTEGER) AS period, reason, unnest(range(1, CAST(greatest(times, 1) AS BIGINT) + 1)) AS copy FROM marked m WHERE reason <> 'quota'
UNION ALL
SELECT o_orderkey, cluster, CAST(period AS INTEGER), reason, 1 FROM (
  SELECT m.*, quota, row_number() OVER (PARTITION BY m.cluster, m.period ORDER BY h, o_orderkey) AS pos
  FROM marked m JOIN quotas q ON q.cluster = m.cluster AND q.period = m.period WHERE reason = 'quota') WHERE pos <= quota""")
def smp_06(spark, sf):
    rows = design_rows(spark, sf)
    sample = sd.designed_sample(rows, "cluster", "period", "score", "o_orderkey", rows.count() // 10)
    return sample.select("o_orderkey", "cluster", "period", "reason", F.col("copy").cast("bigint").alias("copy"))


def similar_sql(tokens: str, percent: int = 95) -> str:
    """All pairs of distinct token sets, by definition."""
    return f"""WITH sets AS ({tokens}),
named AS (SELECT row_id, tokens, min(row_id) OVER (PARTITION BY tokens) AS class_id FROM sets),
cells AS (SELECT class_id, len(tokens) AS n, unnest(tokens) AS token FROM named WHERE row_id = class_id),
met AS (SELECT x.class_id AS a, y.class_id AS b, count(*) AS shared, any_value(x.n + y.n) AS sizes FROM cells x JOIN cells y ON x.token = y.token AND x.class_id <> y.class_id GROUP BY ALL),
linked AS (SELECT a AS class_id, count(*) AS links FROM met WHERE 100 * shared >= {percent} * (sizes - shared) GROUP BY a)
SELECT row_id, CAST(len(tokens) AS BIGINT) AS n_tokens, class_id, coalesce(links, 0) AS links FROM named LEFT JOIN linked USING (class_id)"""


PART_TOKENS = """SELECT p_partkey AS row_id, list_sort(list_distinct(
  list_transform(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type), '\\s+'), lambda w: w <> ''), lambda w: 'text=' || w) || ['p_brand=' || lower(p_brand), 'p_size=' || p_size])) AS tokens FROM part"""
WORDS = """SELECT doc_id AS row_id, list_sort(list_distinct(list_transform(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> ''), lambda w: 'text=' || w))) AS tokens FROM documents"""


@query("doc_02_near_duplicate_parts", similar_sql(PART_TOKENS, 60))
def doc_02_parts(spark, sf):
    """Parts that share three tokens of four or five."""
    rows = roles.table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("text"), "p_brand", "p_size")
    return sr.near_duplicate_rows(rows, "p_partkey", ["text", "p_brand", "p_size"], 60)


@query("doc_02_near_duplicate_rows", similar_sql(WORDS))
def doc_02(spark, sf):
    return sr.near_duplicate_rows(roles.table(spark, sf, "documents").select("doc_id", "text"), "doc_id", ["text"])
