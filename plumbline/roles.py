"""Which provided table plays which part of the data model.

The test data holds no synthetic/original pair and no service tables, so the
parts are assigned here once, for every query. The SQL twins are in
``plans/oracle_parts.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items, tagged: finished lines are the original, open lines the synthetic side."""
    return table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linestatus") == "F", "original").otherwise("synthetic").alias("side"), *FEATURES
    )


def order_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A numeric series in row order, one per side: urgent and high priority orders against the rest."""
    return table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "original").otherwise("synthetic").alias("side"),
        F.col("o_orderkey").alias("row_id"),
        (F.col("o_totalprice") / 100000).alias("total"),
        (F.dayofyear("o_orderdate") / 100).alias("season"),
    )


def validations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as validation runs: price stands for the collapse score."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "processing")
    scored = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("validation_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_custkey").alias("dataset_id"),
        status.otherwise("pending").alias("status"),
        (F.floor(F.col("o_totalprice") / 50) / 100).alias("collapse_score"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        F.col("o_orderdate").alias("created_at"),
    )
    risk = F.when(F.col("status") == "completed", (100 - F.col("collapse_score")).cast("bigint"))
    return scored.withColumn("risk_score", risk).withColumn(
        "risk_level",
        F.when(F.col("risk_score") < 25, "low")
        .when(F.col("risk_score") < 60, "medium")
        .when(F.col("risk_score").isNotNull(), "high"),
    )


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers read as uploaded datasets, every user owning the one with their own number."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("dataset_id"),
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("filename"),
        F.col("c_mktsegment").alias("file_type"),
        F.floor(F.greatest(F.col("c_acctbal"), F.lit(0.0)) * 10).cast("bigint").alias("row_count"),
        F.col("c_nationkey").cast("bigint").alias("company_id"),
    )


def security_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as sign-in attempts and requests."""
    return table(spark, sf_dir, "events")


def validation_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight dimension scores per validation run, spread from its order's numbers."""
    v = validations(spark, sf_dir).select("validation_id", "collapse_score", "priority")
    return with_dimensions(v, "validation_id")


# The eight dimensions in report order.
DIMENSIONS = [
    "distribution_fidelity",
    "correlation_preservation",
    "entropy_stability",
    "gradient_health",
    "loss_landscape",
    "spectral_coherence",
    "generalization_gap",
    "statistical_consistency",
]


def with_dimensions(scored: DataFrame, key: str) -> DataFrame:
    """``(key, collapse_score, dim_no, dim_name, score)``: the score moved by a fixed step per dimension."""
    steps = F.posexplode(F.array(*[F.lit(d) for d in DIMENSIONS]))
    return scored.select(key, "collapse_score", "priority", steps.alias("dim_no", "dim_name")).withColumn(
        "score",
        F.round(
            F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("collapse_score") + 6.0 * F.col("dim_no") - 4.0 * F.col("priority"))), 2
        ),
    )


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings read as the library of failure patterns; their numbers give scores and history."""
    from plumbline.operators.search import normalised

    part = lambda i, scale, base: F.floor((F.lit(base) + F.lit(scale) * F.col("embedding")[i].cast("double")) * 100) / 100
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))
    dims = F.array(*[F.struct(F.lit(d).alias("dim_name"), clip(part(i + 1, 200.0, 60.0)).alias("score")) for i, d in enumerate(DIMENSIONS)])
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("signature_id"),
        F.col("label").cast("bigint").alias("cluster_id"),
        normalised(F.col("embedding")).alias("vector"),
        clip(part(0, 150.0, 50.0)).alias("collapse_score"),
        F.pmod(F.col("vec_id") * 7, F.lit(13)).alias("usage_count"),
        (F.col("label") / 10).alias("accuracy"),
        F.abs(F.col("embedding")[9].cast("double")).alias("anomaly_score"),
        dims.alias("dims"),
    )


def rows_with_impact(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str], str]:
    """Orders read as a table of rows to localise in: price and season by order key."""
    df = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), (F.col("o_totalprice") / 1000).alias("price"), F.dayofyear("o_orderdate").cast("double").alias("season"))
    return df, ["price", "season"], "row_id"
