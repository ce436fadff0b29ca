"""Dataset health queries, and reading and writing in every format."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from plumbline import roles
from plumbline.operators import collapse as cd
from plumbline.operators import learned
from plumbline.operators import quality as q
from plumbline.operators import sampling as sm
from plumbline.plans.collapse import BINS, NEUTRAL, OWN, RANKS, judged_dims
from plumbline.plans.localize import STRATA
from plumbline.plans.oracle_parts import DIMS, FEATURES, LONG, SIDE, VALIDATIONS, with_
from plumbline.plans.profile import corr_sql, rounded
from plumbline.plans.signatures import SIGS
from plumbline.registry import query
from plumbline.sources import readers, writers
from plumbline.streaming.run import file_stream, run_to_table, shared_folder


def pair_with_flags(spark, sf):
    return roles.table(spark, sf, "lineitem").select(
        F.when(F.col("l_linestatus") == "F", "original").otherwise("synthetic").alias("side"), "l_returnflag", "l_linenumber", "l_discount", "l_tax")


@query("doc_01_duplicate_rows", """
SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates, max(n) AS largest_group, round(sum(n - 1) / sum(n), 6) AS share
FROM (SELECT count(*) AS n FROM documents GROUP BY text)""")
def doc_01(spark, sf):
    return rounded(q.duplicate_share(roles.table(spark, sf, "documents").select("text")))


@query("doc_03_repeated_entities", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def doc_03(spark, sf):
    return q.repeated_entities(roles.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("doc_04_drift", with_("""long AS (SELECT 'o_totalprice' AS col, o_totalprice AS val, CASE WHEN date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) <= (SELECT (min(d) + max(d)) / 2 FROM (
  SELECT date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS d FROM orders)) THEN 'original' ELSE 'synthetic' END AS side FROM orders)""", RANKS) + "SELECT col, round(ks, 6) AS ks FROM rank_metrics")
def doc_04(spark, sf):
    return rounded(q.drift(roles.table(spark, sf, "orders"), "o_orderdate", ["o_totalprice"]))


Z = "z AS (SELECT event_id, value, (value - avg(value) OVER ()) / stddev_samp(value) OVER () AS z FROM events)"


@query("doc_05_outlier_regions", with_(Z) + """
SELECT region, count(*) AS rows, count(*) FILTER (abs(z) > 3) AS outliers, round(count(*) FILTER (abs(z) > 3) / count(*), 6) AS share, count(*) FILTER (abs(z) > 3) / count(*) > 0.1 AS noisy
FROM (SELECT z, (row_number() OVER (ORDER BY event_id) - 1) // 500 AS region FROM z) GROUP BY region""")
def doc_05(spark, sf):
    return rounded(q.outlier_regions(roles.table(spark, sf, "events"), ["value"], "event_id", 500))


@query("doc_06_correlation_spread", f"""
SELECT i, j, round(min(r), 6) AS lowest, round(max(r), 6) AS highest, round(max(r) - min(r), 6) AS spread FROM ({corr_sql('lineitem', 'l_returnflag')}) GROUP BY i, j""")
def doc_06(spark, sf):
    return rounded(q.correlation_spread(roles.table(spark, sf, "lineitem").select("l_returnflag", *FEATURES), FEATURES, "l_returnflag"))


@query("doc_07_perfect_pairs", "SELECT 'price' AS col_i, 'price_with_fee' AS col_j, round(corr(o_totalprice, o_totalprice * 1.1 + 5), 6) AS r FROM orders")
def doc_07(spark, sf):
    o = roles.table(spark, sf, "orders").select(F.col("o_totalprice").alias("price"), (F.col("o_totalprice") * 1.1 + 5).alias("price_with_fee"), F.col("o_custkey").alias("cust"))
    return rounded(q.perfect_pairs(o, ["price", "price_with_fee", "cust"]).select("col_i", "col_j", "r"))


@query("doc_07_uniform_columns", with_(LONG, OWN.format(n=50)) + """
SELECT col, round(h, 6) AS h_syn, round(h / ln(50), 6) AS flatness, h / ln(50) > 0.99 AS suspicious FROM (
  SELECT col, -sum(p * ln(p)) AS h FROM (SELECT col, side, (n + 1e-10) / sum(n + 1e-10) OVER (PARTITION BY col, side) AS p FROM own_grid) WHERE side = 'synthetic' GROUP BY col)""")
def doc_07_uniform(spark, sf):
    return rounded(q.uniform_columns(roles.pair(spark, sf), FEATURES))


@query("doc_08_concentration", """
WITH v AS (SELECT 'user_id' AS col, CAST(user_id AS VARCHAR) AS v FROM events UNION ALL SELECT 'event_type', event_type FROM events),
c AS (SELECT col, v, count(*) AS n FROM v GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n) AS i, row_number() OVER (PARTITION BY col ORDER BY n DESC) AS d,
  count(*) OVER (PARTITION BY col) AS k, sum(n) OVER (PARTITION BY col) AS t FROM c)
SELECT col, max(k) AS values, round(-sum(n / t * ln(n / t)), 6) AS entropy, round(2 * sum(i * n) / (max(k) * max(t)) - (max(k) + 1) / max(k), 6) AS gini, round(sum(n) FILTER (d <= 4) / max(t), 6) AS top_share
FROM r GROUP BY col""")
def doc_08(spark, sf):
    return rounded(q.concentration(roles.table(spark, sf, "events"), ["user_id", "event_type"]))


@query("doc_09_rare_patterns", """
SELECT l_returnflag, l_discount, l_tax, count(*) AS n, round(count(*) / (SELECT count(*) FROM lineitem), 6) AS share FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) / (SELECT count(*) FROM lineitem) < 0.0033""")
def doc_09(spark, sf):
    return rounded(q.rare_patterns(roles.table(spark, sf, "lineitem"), ["l_returnflag", "l_discount", "l_tax"], 0.0033))


@query("doc_10_cluster_report")
def doc_10(spark, sf):
    return q.cluster_report(roles.table(spark, sf, "orders").select((F.col("o_totalprice") / 1000).alias("price"), F.dayofyear("o_orderdate").cast("double").alias("season")), ["price", "season"])


@query("doc_11_spearman", """
WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS ra, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS rb FROM lineitem)
SELECT 'l_quantity' AS col_a, 'l_extendedprice' AS col_b, round(corr(ra, rb), 6) AS rho FROM r""")
def doc_11(spark, sf):
    return rounded(q.spearman(roles.table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"))


DAYS = "days AS (SELECT date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day, avg(o_totalprice) AS v FROM orders GROUP BY 1)"


@query("doc_12_autocorrelation", with_(DAYS) + "SELECT lag, count(*) AS days, round(corr(a.v, b.v), 6) AS autocorrelation FROM days a JOIN (VALUES (1), (7), (30)) l(lag) ON true JOIN days b ON b.day = a.day + lag GROUP BY lag")
def doc_12(spark, sf):
    return rounded(q.autocorrelation(q.daily(roles.table(spark, sf, "orders"), "o_orderdate", "o_totalprice"), [1, 7, 30]))


@query("doc_12_trend", with_(DAYS) + "SELECT count(*) AS days, round(regr_slope(v, day), 6) AS slope, round(regr_r2(v, day), 6) AS r2 FROM days")
def doc_12_trend(spark, sf):
    return rounded(q.trend(q.daily(roles.table(spark, sf, "orders"), "o_orderdate", "o_totalprice")))


@query("doc_13_z_outliers", with_(Z) + "SELECT event_id, 'value' AS col, value AS val, round(z, 6) AS z FROM z WHERE abs(z) > 3")
def doc_13(spark, sf):
    return rounded(q.z_outliers(roles.table(spark, sf, "events"), ["value"], "event_id"))


@query("doc_15_malformed_values", """
SELECT 'props' AS col, CAST(count(*) FILTER (try_cast(props AS DOUBLE) IS NULL) AS BIGINT) AS malformed FROM events UNION ALL SELECT 'event_type', count(*) FILTER (try_cast(event_type AS BIGINT) IS NULL) FROM events""")
def doc_15(spark, sf):
    return q.malformed(roles.table(spark, sf, "events"), {"props": "DOUBLE", "event_type": "BIGINT"})


@query("doc_15_column_classes", " UNION ALL ".join(
    f"SELECT '{c}' AS col, '{t}' AS data_type, '{k}' AS class, count(DISTINCT {c}) AS values, CAST({s} AS DOUBLE) AS number_share FROM orders"
    for c, t, k, s in [("o_orderkey", "bigint", "numeric", 1), ("o_custkey", "bigint", "numeric", 1), ("o_orderstatus", "string", "categorical", 0),
                       ("o_totalprice", "double", "numeric", 1), ("o_orderdate", "timestamp_ntz", "datetime", 0), ("o_orderpriority", "string", "categorical", 0)]))
def doc_15_classes(spark, sf):
    return q.column_classes(roles.table(spark, sf, "orders"))


@query("doc_16_jensen_shannon", with_(LONG, BINS) + "SELECT col, round(sum((pn * ln(pn / ((pn + qn) / 2)) + qn * ln(qn / ((pn + qn) / 2))) / 2), 6) AS js FROM pqn GROUP BY col")
def doc_16(spark, sf):
    return rounded(cd.intersection_and_kl(cd.fidelity_bins(cd.joint_bins(cd.cells(roles.pair(spark, sf), FEATURES)))).select("col", "js"))


@query("doc_17_entropy_loss", with_(LONG, OWN.format(n=50)) + """
SELECT col, max(h) FILTER (side = 'synthetic') / (max(h) FILTER (side = 'original') + 1e-10) < 0.8 AS entropy_lost FROM (
  SELECT col, side, -sum(p * ln(p)) AS h FROM (SELECT col, side, (n + 1e-10) / sum(n + 1e-10) OVER (PARTITION BY col, side) AS p FROM own_grid) GROUP BY col, side) GROUP BY col""")
def doc_17(spark, sf):
    return cd.entropies(cd.joint_bins(cd.cells(roles.pair(spark, sf), FEATURES))).select("col", (F.col("ratio") < 0.8).alias("entropy_lost"))


@query("doc_18_rare_recall", f"""
WITH p AS (SELECT {SIDE} AS side, l_returnflag, l_discount, l_tax FROM lineitem),
rare AS (SELECT l_returnflag, l_discount, l_tax FROM p WHERE side = 'original' GROUP BY ALL HAVING count(*) / (SELECT count(*) FROM p WHERE side = 'original') < 0.0033)
SELECT count(*) AS rare, count(s.l_tax) AS kept, round(count(s.l_tax) / count(*), 6) AS recall FROM rare LEFT JOIN (SELECT DISTINCT l_returnflag, l_discount, l_tax FROM p WHERE side = 'synthetic') s USING (l_returnflag, l_discount, l_tax)""")
def doc_18(spark, sf):
    return rounded(q.rare_recall(pair_with_flags(spark, sf), ["l_returnflag", "l_discount", "l_tax"], 0.0033))


@query("doc_19_collapse_types", with_(NEUTRAL) + """
SELECT validation_id, array_to_string(list(t ORDER BY t), '') AS types FROM (SELECT validation_id, CASE dim_name WHEN 'distribution_fidelity' THEN 'A' WHEN 'correlation_preservation' THEN 'B' WHEN 'statistical_consistency' THEN 'C'
  WHEN 'entropy_stability' THEN 'D' WHEN 'spectral_coherence' THEN 'E' END AS t FROM judged WHERE score < threshold) WHERE t IS NOT NULL GROUP BY validation_id""")
def doc_19(spark, sf):
    return q.collapse_types(judged_dims(spark, sf), "validation_id")


@query("doc_20_root_causes", with_(Z) + """, c AS (SELECT 'duplicates' AS cause, CAST(sum(n - 1) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM events GROUP BY user_id, event_type, value, props)
  UNION ALL SELECT 'outliers', count(*) FROM z WHERE abs(z) > 3 UNION ALL SELECT 'repeated_entities', count(*) FROM (SELECT 1 FROM events GROUP BY user_id, event_type HAVING count(*) > 1))
SELECT cause, n, round(n * 100.0 / (SELECT sum(n) FROM c), 6) AS percentage FROM c""")
def doc_20(spark, sf):
    e = roles.table(spark, sf, "events")
    found = [
        ("duplicates", q.duplicate_share(e, ["user_id", "event_type", "value", "props"]).select(F.col("duplicates").alias("n"))),
        ("outliers", q.z_outliers(e, ["value"], "event_id").agg(F.count("*").alias("n"))),
        ("repeated_entities", q.repeated_entities(e, ["user_id", "event_type"]).agg(F.count("*").alias("n")))]
    counts = None
    for cause, n in found:
        one = n.select(F.lit(cause).alias("cause"), "n")
        counts = one if counts is None else counts.unionByName(one)
    return rounded(q.root_causes(counts))


@query("doc_21_ablation", with_(VALIDATIONS) + """
SELECT region, round(ts / tn, 6) AS before, round((ts - s) / (tn - n), 6) AS after, round(ts / tn - (ts - s) / (tn - n), 6) AS improvement FROM (
  SELECT validation_id // 1000 AS region, count(collapse_score) AS n, sum(collapse_score) AS s FROM validations GROUP BY 1), (SELECT count(collapse_score) AS tn, sum(collapse_score) AS ts FROM validations)""")
def doc_21(spark, sf):
    v = roles.validations(spark, sf).withColumn("region", F.expr("validation_id div 1000"))
    return rounded(q.ablation(v, "region", "collapse_score"))


@query("doc_26_fix_priority", with_(DIMS) + """
SELECT validation_id, dim_name, CAST(CASE WHEN 65 - score > 20 THEN 1 WHEN 65 - score >= 10 THEN 2 WHEN 65 - score >= 5 THEN 3 ELSE 4 END AS BIGINT) AS priority FROM dims""")
def doc_26(spark, sf):
    return roles.validation_dimensions(spark, sf).select("validation_id", "dim_name", q.fix_priority(65 - F.col("score")).cast("bigint").alias("priority"))


@query("doc_27_separability", with_(SIGS) + """
SELECT round(avg(similarity) FILTER (a.cluster_id = b.cluster_id), 6) AS within, round(avg(similarity) FILTER (a.cluster_id <> b.cluster_id), 6) AS across,
  round(avg(similarity) FILTER (a.cluster_id = b.cluster_id) - avg(similarity) FILTER (a.cluster_id <> b.cluster_id), 6) AS separation
FROM sims JOIN sigs a ON a.signature_id = query_id JOIN sigs b ON b.signature_id = match_id""")
def doc_27(spark, sf):
    return rounded(q.separability(roles.signatures(spark, sf).select(F.col("cluster_id").alias("label"), "vector")))


@query("doc_28_spikes", """
SELECT user_id, event_id, value FROM (SELECT *, avg(value) OVER (PARTITION BY user_id) AS m, stddev_samp(value) OVER (PARTITION BY user_id) AS sd FROM events) WHERE value > m + 3 * sd""")
def doc_28(spark, sf):
    return q.spikes(roles.table(spark, sf, "events").select("user_id", "event_id", "value"), "user_id", "value")


@query("doc_29_null_patterns", """
SELECT (CASE WHEN quality IS NULL THEN '1' ELSE '0' END) || (CASE WHEN toxic IS NULL THEN '1' ELSE '0' END) || (CASE WHEN lang IS NULL THEN '1' ELSE '0' END) AS mask, count(*) AS n
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def doc_29(spark, sf):
    d = roles.table(spark, sf, "documents").join(roles.table(spark, sf, "labels"), "doc_id", "left")
    return q.null_patterns(d, ["quality", "toxic", "lang"])


SAMPLED = """rows_ AS (SELECT *, CAST(dayofyear(o_orderdate) AS DOUBLE) AS season, CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 13) AS BIGINT) AS h,
  count(*) OVER (PARTITION BY o_orderpriority) AS n, count(*) OVER () AS total FROM orders),
target AS (SELECT greatest(1, count(*) // 5) AS t FROM orders),
ordered AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY h, o_orderkey) - 1 AS pos FROM rows_, target),
kept AS (SELECT * FROM ordered WHERE pos < CASE WHEN n > 1 THEN floor(n * least(1.0, t / total) + 0.5) ELSE 1 END QUALIFY row_number() OVER (ORDER BY h, o_orderkey) <= t),
long AS (SELECT 'o_totalprice' AS col, o_totalprice AS val, 1 AS s, 0 AS o FROM kept UNION ALL SELECT 'season', season, 1, 0 FROM kept
  UNION ALL SELECT 'o_totalprice', o_totalprice, 0, 1 FROM rows_ UNION ALL SELECT 'season', season, 0, 1 FROM rows_),
cum AS (SELECT col, val, sum(sum(s)) OVER (PARTITION BY col ORDER BY val) / sum(sum(s)) OVER (PARTITION BY col) AS fs,
  sum(sum(o)) OVER (PARTITION BY col ORDER BY val) / sum(sum(o)) OVER (PARTITION BY col) AS fo FROM long GROUP BY col, val),
ks AS (SELECT col, max(abs(fs - fo)) AS ks FROM cum GROUP BY col),
side AS (SELECT col, val, s = 1 AS syn FROM long),
bins AS (SELECT col, syn, least(CAST(floor((val - min(val) OVER w) / (max(val) OVER w - min(val) OVER w) * 50) AS INTEGER), 49) AS bin FROM side WINDOW w AS (PARTITION BY col, syn)),
mass AS (SELECT g.col, g.syn, g.bin, coalesce(n, 0) + 1e-10 AS m FROM (SELECT DISTINCT b.col, b.syn, i AS bin FROM bins b, (SELECT unnest(range(50)) AS i)) g
  LEFT JOIN (SELECT col, syn, bin, count(*) AS n FROM bins GROUP BY ALL) c USING (col, syn, bin)),
ent AS (SELECT col, syn, -sum(p * ln(p)) AS h FROM (SELECT col, syn, m / sum(m) OVER (PARTITION BY col, syn) AS p FROM mass) GROUP BY col, syn),
ratio AS (SELECT col, max(h) FILTER (syn) / (max(h) FILTER (NOT syn) + 1e-10) AS ratio FROM ent GROUP BY col)"""


@query("smp_07_sample_check", "WITH " + SAMPLED + """
SELECT col, round(ks, 6) AS ks, round(ratio, 6) AS ratio, (SELECT round(abs((SELECT corr(o_totalprice, season) FROM kept) - (SELECT corr(o_totalprice, season) FROM rows_)), 6)) AS correlation_gap
FROM ks JOIN ratio USING (col)""")
def smp_07(spark, sf):
    """KS, entropy ratio and correlation distance of a stratified sample against its table."""
    o = roles.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", F.dayofyear("o_orderdate").cast("double").alias("season"))
    s = sm.stratified_sample(o, ["o_orderpriority"], "o_orderkey", max(1, o.count() // 5))
    cols = ["o_totalprice", "season"]
    both, _ = cd.align(s.select(*cols), o.select(*cols))
    ks = cd.rank_metrics(cd.rank_table(both, cols)).select("col", "ks")
    ent = cd.entropies(cd.joint_bins(cd.cells(both, cols))).select("col", "ratio")
    gap = cd.correlation_pairs(both, cols).agg(F.max(F.abs(F.col("r_syn") - F.col("r_orig"))))  # one pair of columns
    return rounded(ks.join(ent, "col").withColumn("correlation_gap", gap.scalar()))


# ---------------------------------------------------------------- formats

ORDER_TYPES = "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"


def orders(spark, sf):
    return roles.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


def timed(df):
    """Some formats know only times with a zone."""
    return df.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


def through_file(name: str, write):
    """Write the orders in a format and read them back by extension."""

    @query(name, ORDERS)
    def scan(spark, sf):
        path = os.path.join(shared_folder(spark), "orders" + write[0])
        write[1](orders(spark, sf).write, path)
        return timed(readers.read(spark, path, schema=write[2]))

    return scan


through_file("src_02_csv_scan", (".csv", lambda w, p: w.option("header", True).csv(p), None))
through_file("src_03_tsv_scan", (".tsv", lambda w, p: w.option("header", True).option("sep", "\t").csv(p), ORDER_TYPES))
through_file("src_05_json_lines_scan", (".jsonl", lambda w, p: w.json(p), ORDER_TYPES))
through_file("src_06_parquet_scan", (".parquet", lambda w, p: w.parquet(p), None))


@query("src_01_format_dispatch", ORDERS)
def src_01(spark, sf):
    """One folder with files of four formats, by priority of the order."""
    path = os.path.join(shared_folder(spark), "mixed")
    o, first = orders(spark, sf), F.coalesce(F.substring("o_orderpriority", 1, 1), F.lit(""))
    text = {"csv": ",", "tsv": "\t"}
    for own, (ending, sep) in zip(("1", "2"), text.items(), strict=True):
        o.filter(first == own).write.options(header=True, sep=sep, extension=ending).csv(os.path.join(path, ending))
    o.filter(first == "3").write.parquet(os.path.join(path, "parquet"))
    writers.write_arrow(o.filter(~first.isin("1", "2", "3")), os.path.join(path, "arrow"))
    return readers.read_folder(spark, path, ORDER_TYPES)


@query("src_04_json_array_scan", ORDERS)
def src_04(spark, sf):
    """Array documents: each holds the rows of one slice of the table."""
    path = os.path.join(shared_folder(spark), "orders.json")
    o = orders(spark, sf)
    part = F.expr("o_orderkey div 10000")  # documents of bounded size
    docs = o.groupBy(part.alias("part")).agg(F.to_json(F.collect_list(F.struct(*o.columns))).alias("value"))
    docs.write.partitionBy("part").text(path)
    return readers.read(spark, path, schema=ORDER_TYPES).select(*o.columns)


@query("src_07_arrow_scan", ORDERS)
def src_07(spark, sf):
    path = os.path.join(shared_folder(spark), "orders-arrow")
    writers.write_arrow(orders(spark, sf), path)
    return timed(readers.read_arrow(spark, path))


@query("src_08_metadata", "SELECT count(*) AS rows, 6 AS columns FROM orders")
def src_08(spark, sf):
    return readers.metadata(roles.table(spark, sf, "orders")).select("rows", "columns")


@query("src_09_row_estimate")
def src_09(spark, sf):
    return readers.row_estimate(roles.table(spark, sf, "orders"), 0.01)


@query("src_11_incremental_scan", "SELECT o_orderkey, o_totalprice FROM orders")
def src_11(spark, sf):
    """The orders arrive as several files and are read a file at a time."""
    path = os.path.join(shared_folder(spark), "arriving")
    o = roles.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    o.repartition(4, "o_orderkey").write.parquet(path)
    return run_to_table(file_stream(spark, path, o.schema, files_per_batch=1))


@query("src_12_object_listing")
def src_12(spark, sf):
    return readers.list_objects(spark, sf, glob="*.parquet").withColumn("path", F.regexp_extract("path", "[^/]+$", 0))


@query("src_13_service_table", with_(VALIDATIONS) + "SELECT validation_id, user_id, status, risk_score FROM validations WHERE status = 'completed'")
def src_13(spark, sf):
    return roles.validations(spark, sf).filter("status = 'completed'").select("validation_id", "user_id", "status", "risk_score")


REPORTS = DIMS + """, reports AS (SELECT validation_id, CAST(trunc(100 - collapse_score) AS BIGINT) AS risk_score, CAST(trunc(max(score) FILTER (dim_name = 'spectral_coherence')) AS BIGINT) AS semantic_coherence,
  round(0.85 + collapse_score / 100 * 0.1, 6) AS accuracy, max(score) FILTER (dim_name = 'loss_landscape') AS loss_landscape FROM dims GROUP BY validation_id, collapse_score)"""


def _report_fields(r):
    return rounded(r.select("validation_id", "results.risk_score", "results.dimensions.semantic_coherence", "results.predicted_performance.accuracy", F.col("internal.dimension_scores")["loss_landscape"].alias("loss_landscape")))


@query("snk_01_report_json", with_(REPORTS) + "SELECT * FROM reports")
def snk_01(spark, sf):
    made = writers.report(roles.validations(spark, sf), roles.validation_dimensions(spark, sf))
    path = os.path.join(shared_folder(spark), "reports")
    writers.save_report(made, path)
    return _report_fields(spark.read.schema(made.schema).json(path))


@query("snk_01_report_text", with_(REPORTS) + "SELECT * FROM reports")
def snk_01_text(spark, sf):
    made = writers.report(roles.validations(spark, sf), roles.validation_dimensions(spark, sf))
    return _report_fields(writers.report_text(made).select(F.from_json("report", made.schema).alias("r")).select("r.*"))


@query("snk_02_saved_sample", with_(STRATA) + "SELECT o_orderkey, o_orderpriority FROM sample")
def snk_02(spark, sf):
    o = roles.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    path = os.path.join(shared_folder(spark), "sample")
    writers.save_sample(sm.stratified_sample(o, ["o_orderpriority"], "o_orderkey", 3000), path, ["o_orderpriority"])
    return spark.read.parquet(path).select("o_orderkey", F.col("o_orderpriority").cast("string").alias("o_orderpriority"))


@query("snk_06_saved_signatures", with_(SIGS) + """
SELECT s.signature_id, s.collapse_score, len(s.vector) AS size, d.score AS fidelity FROM sigs s JOIN sig_dims d ON d.signature_id = s.signature_id AND d.dim_name = 'distribution_fidelity'""")
def snk_06(spark, sf):
    path = os.path.join(shared_folder(spark), "signatures")
    writers.save_signatures(roles.signatures(spark, sf), path)
    back = writers.load_signatures(spark, path, {"dims": "array<struct<dim_name:string,score:double>>"})
    return back.select("signature_id", "collapse_score", F.size("vector").cast("bigint").alias("size"), F.filter("dims", lambda d: d["dim_name"] == "distribution_fidelity")[0]["score"].alias("fidelity"))


@query("win_05_cumulative_variance")
def win_05(spark, sf):
    return learned.explained_variance(spark, learned.covariances(roles.pair(spark, sf), FEATURES, "side")).select("side", "component", "cumulative")
