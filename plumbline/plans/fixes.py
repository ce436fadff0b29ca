"""Fix jobs over line items, orders and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import roles
from plumbline.operators import fixes
from plumbline.plans.oracle_parts import SERIES, with_
from plumbline.registry import query

COUNTS = ", ".join(f"CAST(coalesce(len(regexp_extract_all(text, '{p}')), 0) AS BIGINT) AS {n}" for n, p in fixes.PATTERNS.items())


@query("doc_14_personal_data", f"SELECT *, {' + '.join(fixes.PATTERNS)} > 0 AS flagged FROM (SELECT doc_id, {COUNTS} FROM documents)")
def doc_14(spark, sf):
    return fixes.personal_data(roles.table(spark, sf, "documents"), "doc_id", "text")


LIMITS = "s AS (SELECT avg(o_totalprice) AS mp, stddev_samp(o_totalprice) AS sp FROM orders)"


@query("doc_22_drop_outliers", "WITH " + LIMITS + " SELECT o_orderkey, o_totalprice FROM orders, s WHERE abs(o_totalprice - mp) <= 1.5 * sp")
def doc_22(spark, sf):
    """At 1.5 deviations instead of 5, which no price of the given orders exceeds."""
    return fixes.without_outliers(roles.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], 1.5)


@query("doc_22_clip_outliers", "WITH " + LIMITS + " SELECT o_orderkey, round(least(greatest(o_totalprice, mp - 1.5 * sp), mp + 1.5 * sp), 4) AS o_totalprice FROM orders, s")
def doc_22_clip(spark, sf):
    return fixes.clipped(roles.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], 1.5).withColumn("o_totalprice", F.round("o_totalprice", 4))


@query("doc_23_rebalanced_classes", """
SELECT o_orderkey, label, copy FROM (SELECT o_orderkey, o_custkey % 120 AS label, count(*) OVER (PARTITION BY o_custkey % 120) AS n, count(*) OVER () AS total FROM orders),
  (SELECT unnest([1, 2]) AS copy) WHERE copy = 1 OR n < 0.01 * total""")
def doc_23(spark, sf):
    o = roles.table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 120).alias("label"))
    return fixes.rebalanced(o, "label", "o_orderkey")


@query("doc_24_mixed_sides", with_(SERIES) + """, placed AS (SELECT side, row_id, row_number() OVER (PARTITION BY side ORDER BY CAST('0x' || substr(md5(CAST(row_id AS VARCHAR)), 1, 13) AS BIGINT), row_id) - 1 AS pos FROM series),
n AS (SELECT least(count(*) FILTER (side = 'synthetic') / 0.3, count(*) FILTER (side = 'original') / 0.7) AS whole FROM series)
SELECT side, row_id FROM placed, n WHERE pos < floor(whole * CASE side WHEN 'synthetic' THEN 0.3 ELSE 0.7 END + 1e-9)""")
def doc_24(spark, sf):
    return fixes.mixed(roles.order_series(spark, sf), "row_id")


@query("doc_25_smoothed_column", """
SELECT user_id, pos, value, round(smooth, 6) AS smooth FROM (SELECT user_id, value, row_number() OVER w - 1 AS pos,
  avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS smooth FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")
def doc_25(spark, sf):
    e = roles.table(spark, sf, "events")
    return fixes.smoothed(e, ["user_id"], ["ts", "event_id"], "value").withColumn("smooth", F.round("smooth", 6))
