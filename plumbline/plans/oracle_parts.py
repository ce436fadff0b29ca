"""SQL twins of ``roles.py``, put in front of the oracle texts as common table expressions."""

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

SIDE = "CASE WHEN l_linestatus = 'F' THEN 'original' ELSE 'synthetic' END"

LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT {SIDE} AS side, '{c}' AS col, {c} AS val FROM lineitem" for c in FEATURES
) + ")"

VALIDATIONS = """validations AS (
  SELECT validation_id, user_id, dataset_id, status, collapse_score, priority, created_at, risk_score,
         CASE WHEN risk_score < 25 THEN 'low' WHEN risk_score < 60 THEN 'medium'
              WHEN risk_score IS NOT NULL THEN 'high' END AS risk_level
  FROM (SELECT *, CASE WHEN status = 'completed' THEN CAST(trunc(100 - collapse_score) AS BIGINT) END AS risk_score
        FROM (SELECT o_orderkey AS validation_id, o_custkey AS user_id, o_custkey AS dataset_id,
                     CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'processing' ELSE 'pending' END AS status,
                     floor(o_totalprice / 50) / 100 AS collapse_score,
                     CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority,
                     o_orderdate AS created_at
              FROM orders)))"""

DATASETS = """datasets AS (
  SELECT c_custkey AS dataset_id, c_custkey AS user_id, c_name AS filename, c_mktsegment AS file_type,
         CAST(floor(greatest(c_acctbal, 0.0) * 10) AS BIGINT) AS row_count, CAST(c_nationkey AS BIGINT) AS company_id
  FROM customer)"""

DIMENSION_LIST = """dimension_list(dim_no, dim_name) AS (VALUES (0, 'distribution_fidelity'),
  (1, 'correlation_preservation'), (2, 'entropy_stability'), (3, 'gradient_health'), (4, 'loss_landscape'),
  (5, 'spectral_coherence'), (6, 'generalization_gap'), (7, 'statistical_consistency'))"""

DIMS = VALIDATIONS + ", " + DIMENSION_LIST + """, dims AS (
  SELECT validation_id, collapse_score, priority, dim_no, dim_name,
         round(least(100.0, greatest(0.0, collapse_score + 6.0 * dim_no - 4.0 * priority)), 2) AS score
  FROM validations, dimension_list)"""

SERIES = """series AS (
  SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'original' ELSE 'synthetic' END AS side,
         o_orderkey AS row_id, o_totalprice / 100000 AS total, dayofyear(o_orderdate) / 100 AS season
  FROM orders)"""


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "
