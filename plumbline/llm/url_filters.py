"""URL filters by a sort-merge range join.

A canonical key is the reversed host, a separator and the path. A rule's prefix is an interval of these keys: from the
key itself to the key followed by 0xFF, a byte UTF-8 never holds. A url is probed once for each of its parent hosts
that has rules, with its whole path. Probes and interval ends are sorted together; intervals nest, so the stack of
active rules is known at every interval end from the rules alone: its top is the rule there or, after an end, the rule
around it. The sweep carries the top forward over the probes. DataFrame functions only.

Hot hosts: probes are counted per rule host first, and a host gets one sorted run for each ``run_rows`` probes, or for
as many as it has interval ends if these are more. Its ends are repeated in every run, so their copies never outnumber
the probes. Equal (host, path) pairs are probed once.

Defined cases: a null url, or one without ``://``, has empty host and path, and no rule fits it; equal rules are
merged, block before allow; of fitting rules the longest string wins, then the longer host; repeated rows are judged
alike; an empty table gives an empty table; without rules all urls get the default. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import ascii_lower, spread_join, table
from plumbline.registry import query

#: (host, path, verdict) of the production rules
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    """``blog.example.org`` as ``org.example.blog.``: parents become prefixes."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_intervals(rules: DataFrame) -> DataFrame:
    """Interval ends (host, at, kind, rule, verdict): after each, ``rule`` is the top of the stack of active rules."""
    own = rules.groupBy(ascii_lower(F.col("host")).alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    own = own.withColumn("rule", F.concat("host", "path"))
    # the rule around a rule: the longest proper prefix of its path that is a rule of the same host
    inner = own.select("host", "path", F.explode(F.sequence(F.lit(0), F.length("path"))).alias("cut")).where(F.col("cut") < F.length("path"))
    inner = inner.select("host", F.col("path").alias("inner_path"), F.expr("left(path, cut)").alias("path"))
    around = inner.join(own, ["host", "path"]).groupBy("host", "inner_path").agg(F.max_by(F.struct("rule", "verdict"), F.length("path")).alias("around"))
    opened = own.select("host", F.encode("path", "UTF-8").alias("at"), F.lit(0).alias("kind"), F.struct("rule", "verdict").alias("top"))
    closed = own.withColumnRenamed("path", "inner_path").join(around, ["host", "inner_path"], "left").select(
        "host", F.concat(F.encode("inner_path", "UTF-8"), F.unhex(F.lit("FF"))).alias("at"), F.lit(0).alias("kind"), F.col("around").alias("top"))
    return opened.unionByName(closed)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", page_id: str = "page_id", default: str = "allow", run_rows: int = 256) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict) for every page; ``rules`` has the columns host, path and verdict.

    ``run_rows`` is the number of probes in one sorted run: it balances work and never changes a result.
    """
    urls = pages.select(F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    ends = rule_intervals(rules)
    depth = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 0
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(depth, 1)))), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    probes = urls.where(F.col("host") != "").distinct().select("host", "path", F.explode(parents).alias("parent"))
    rule_hosts = ends.groupBy(F.col("host").alias("parent")).agg(F.count(F.lit(1)).alias("ends"))
    loads = rule_hosts.join(probes.groupBy("parent").agg(F.count(F.lit(1)).alias("load")), "parent").select(
        "parent", F.ceil(F.col("load") / F.greatest(F.lit(run_rows), "ends")).cast("int").alias("runs"))
    probes = spread_join(probes, loads, ["parent"]).select(
        F.col("parent"), F.pmod(F.xxhash64("host", "path"), F.col("runs")).cast("int").alias("run"), F.encode("path", "UTF-8").alias("at"),
        F.lit(1).alias("kind"), F.lit(None).cast("struct<rule:string,verdict:string>").alias("top"), "host", "path")
    ends = ends.withColumnRenamed("host", "parent").join(loads, "parent").select(
        "parent", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), "at", "kind",
        # an end with nothing around it must hide the rule before it, so it is a row of its own, not a null
        F.coalesce(F.col("top"), F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))).alias("top"),
        F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"))
    sweep = Window.partitionBy(reversed_host(F.col("parent")), "run").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = probes.unionByName(ends).withColumn("top", F.last("top", ignorenulls=True).over(sweep)).where((F.col("kind") == 1) & F.col("top.rule").isNotNull())
    best = found.groupBy("host", "path").agg(F.max_by("top", F.struct(F.length("top.rule"), F.length("parent"))).alias("best"))
    return spread_join(urls, best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


SQL = """
WITH urls AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(rule_host, rule_path, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
  SELECT page_id, arg_max({'rule': rule_host || rule_path, 'verdict': verdict}, length(rule_host || rule_path)) AS best
  FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT u.page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM urls u LEFT JOIN fits USING (page_id)
"""


@query("op3_url_filters", SQL)
def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(str(r) for r in RULES) + " AS r(host, path, verdict)")
    return judge_urls(table(spark, sf_dir, "pages"), rules)
