"""Jobs over the service's own tables: history, paging, usage, eligibility, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.sequences import positions

# Job states, coverage by warranty type, hours until completion by priority.
JOB_STATES = ["pending", "queued", "processing", "completed", "failed", "cancelled"]
COVERAGE = {"standard": 100000, "premium": 500000, "enterprise": 1000000}
HOURS_BY_PRIORITY = {"high": 12, "normal": 24, "low": 48}
SORTABLE = ("created_at", "collapse_score", "validation_id", "risk_score")


# ---------------------------------------------------------------- scalar projections


def risk_projection(score: Column, approved: Column) -> list[Column]:
    """Risk score, level and warranty flag from a collapse score, and the recommendation the approval stands for."""
    risk = (100 - score).cast("bigint")
    return [
        risk.alias("risk_score"),
        F.when(risk < 25, "low").when(risk < 60, "medium").otherwise("high").alias("risk_level"),
        (risk < 25).alias("warranty_eligible"),
        F.when(approved, "approved").otherwise("rejected").alias("recommendation"),
    ]


def performance_projection(score: Column) -> list[Column]:
    """Predicted accuracy, its interval and the collapse probability."""
    share = score / 100
    return [
        (0.85 + share * 0.1).alias("accuracy"),
        (0.82 + share * 0.08).alias("accuracy_low"),
        (0.88 + share * 0.12).alias("accuracy_high"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), (100 - score) / 100)).alias("collapse_probability"),
    ]


# Public dimension name and the internal one it reads.
PUBLIC_DIMENSIONS = {
    "distribution_fidelity": "distribution_fidelity",
    "correlation_preservation": "correlation_preservation",
    "rare_pattern_handling": "statistical_consistency",
    "temporal_stability": "entropy_stability",
    "semantic_coherence": "spectral_coherence",
}


def public_dimensions(dims: DataFrame, key: str, diversity: Column) -> DataFrame:
    """Eight internal dimension rows per key to one row of six public whole numbers."""
    picks = [
        F.coalesce(F.max(F.when(F.col("dim_name") == src, F.col("score"))).cast("bigint"), F.lit(0).cast("bigint")).alias(name)
        for name, src in PUBLIC_DIMENSIONS.items()
    ]
    return dims.groupBy(key).agg(*picks, F.max(diversity).cast("bigint").alias("diversity_retention"))


def coverage(kind: Column, asked: Column) -> Column:
    default = F.lit(COVERAGE["standard"])
    for name, amount in COVERAGE.items():
        default = F.when(kind == name, F.lit(amount)).otherwise(default)
    return F.coalesce(F.nullif(asked, F.lit(0)), default)


def estimated_completion(created: Column, priority: Column) -> Column:
    hours = F.lit(HOURS_BY_PRIORITY["normal"])
    for name, h in HOURS_BY_PRIORITY.items():
        hours = F.when(priority == name, F.lit(h)).otherwise(hours)
    return created + F.make_dt_interval(hours=hours)


def signature_id(dataset: Column, vector: Column, prefix: int = 10) -> Column:
    """Sixteen hex digits of the hash of the dataset and the head of its vector, in thousandths."""
    head = F.transform(F.slice(vector, 1, prefix), lambda x: F.floor(x.cast("double") * 1000).cast("bigint").cast("string"))
    return F.substring(F.sha2(F.concat_ws("_", dataset.cast("string"), F.array_join(head, ",")), 256), 1, 16)


def username(name: Column, email: Column) -> Column:
    return F.coalesce(name, F.split_part(email, F.lit("@"), F.lit(1)))


# ---------------------------------------------------------------- filters and lists


def history(df: DataFrame, start=None, end=None, risk_level: str | None = None) -> DataFrame:
    """Completed runs in an inclusive date range; rows without a level pass the level filter."""
    out = df.filter(F.col("status") == "completed")
    if start is not None:
        out = out.filter(F.col("created_at") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out.filter(F.col("created_at") <= F.lit(end).cast("timestamp_ntz"))
    if risk_level is not None:
        out = out.filter(F.col("risk_level").isNull() | (F.col("risk_level") == risk_level))
    return out


def of_owner(df: DataFrame, status: str | None = None, user_id: int | None = None) -> DataFrame:
    """Filters come before any paging, so totals count what is shown."""
    if user_id is not None:
        df = df.filter(F.col("user_id") == user_id)
    if status is not None:
        df = df.filter(F.col("status") == status)
    return df


def page(df: DataFrame, number: int, size: int, order: list[Column]) -> DataFrame:
    """One page with the total and page count beside every row.

    Only the rows up to the end of the page are sorted (a top-k plan); the total is one aggregate.
    """
    number = max(1, number)
    size = size if 1 <= size <= 100 else 20
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    pages = F.ceil(F.col("total") / F.lit(float(size))).cast("bigint")
    return rows.withColumn("total", df.agg(F.count("*")).scalar()).withColumn("total_pages", pages)


def sort_listing(df: DataFrame, by: str, direction: str = "desc") -> list[Column]:
    """Order from an allow-list; descending puts nulls first, as the service's database does."""
    if by not in SORTABLE:
        raise ValueError(f"cannot sort by {by}")
    if direction not in ("asc", "desc"):
        raise ValueError(f"unknown direction {direction}")
    c = F.col(by)
    return [c.desc_nulls_first() if direction == "desc" else c.asc_nulls_last()]


def latest_per_owner(df: DataFrame, owner: str, order: list[Column], n: int) -> DataFrame:
    """The newest ``n`` rows of every owner. Spark cuts each partition to n per owner before the shuffle."""
    w = Window.partitionBy(owner).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def queue_positions(jobs: DataFrame, owner: str) -> DataFrame:
    """1-based place in the owner's queue by priority, then age; a long queue is numbered bucket by bucket."""
    age = F.unix_seconds(F.col("created_at").cast("timestamp"))
    keyed = jobs.withColumn("_order", age - F.col("priority") * F.lit(2**36))  # seconds stay below 2^36
    return positions(keyed, [owner], ["_order", "created_at", "validation_id"], "_pos").withColumn("position", F.col("_pos") + 1).drop("_order", "_pos")


def live_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("deleted_at").isNull())


def expire(df: DataFrame, now: Column) -> DataFrame:
    """Drop expired rows and release locks that have run out."""
    return df.filter(F.col("expires_at") >= now).withColumn(
        "locked_until", F.when(F.col("locked_until") >= now, F.col("locked_until"))
    )


# ---------------------------------------------------------------- joins


def with_dataset(runs: DataFrame, datasets: DataFrame) -> DataFrame:
    """Each run with its dataset's name, ``Unknown`` if there is none."""
    names = datasets.select("dataset_id", "filename")
    return runs.join(names, "dataset_id", "left").withColumn("filename", F.coalesce("filename", F.lit("Unknown")))


def matching(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
    """Semi or anti join; the right side is cut to distinct keys so a hot key is shipped once."""
    return left.join(right.select(key).distinct(), key, how)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return matching(child, parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def cascade(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return matching(child, parent.select(F.col(parent_key).alias(child_key)), child_key, "left_semi")


# ---------------------------------------------------------------- aggregates


def queue_stats(jobs: DataFrame) -> DataFrame:
    """Jobs per state with the empty states and the total."""
    spark = jobs.sparkSession
    states = spark.createDataFrame([(s,) for s in JOB_STATES], "status string")
    counted = states.join(jobs.groupBy("status").agg(F.count("*").alias("jobs")), "status", "left").select(
        "status", F.coalesce("jobs", F.lit(0)).alias("jobs")
    )
    return counted.unionByName(jobs.agg(F.count("*").alias("jobs")).select(F.lit("total").alias("status"), "jobs"))


def usage(runs: DataFrame, datasets: DataFrame) -> DataFrame:
    """Per user: completed runs, whole-number mean risk, warranties, datasets and rows held."""
    done = F.col("status") == "completed"
    per_run = runs.groupBy("user_id").agg(
        F.count("*").alias("validations"),
        F.count_if(done).alias("completed"),
        F.coalesce(F.sum(F.when(done, F.col("risk_score"))), F.lit(0)).alias("risk_sum"),
        F.count_if(done & (F.col("risk_score") < 25)).alias("warranties"),
    )
    per_set = datasets.groupBy("user_id").agg(
        F.count("*").alias("datasets"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows_validated")
    )
    none = F.lit(0).cast("bigint")
    mean = F.when(F.col("completed") > 0, F.expr("risk_sum div completed")).otherwise(none)
    return per_set.join(per_run, "user_id", "full_outer").na.fill(0).select(
        "user_id", "validations", "completed", mean.alias("average_risk"), "warranties", "datasets", "rows_validated"
    )


def history_trends(runs: DataFrame, datasets: DataFrame) -> DataFrame:
    """Per month: runs, mean risk, thousands of rows, and the change of mean risk against the month before."""
    month = F.date_format("created_at", "yyyy-MM")
    sized = runs.join(datasets.select("dataset_id", "row_count"), "dataset_id", "left")
    per_month = sized.groupBy(month.alias("month")).agg(
        F.count("*").alias("runs"),
        F.avg("risk_score").cast("bigint").alias("average_risk"),
        F.sum(F.coalesce(F.expr("row_count div 1000"), F.lit(0))).alias("thousand_rows"),
    )
    # one row per calendar month
    before = F.lag("average_risk").over(Window.partitionBy(F.lit(0)).orderBy("month"))
    return per_month.withColumn("risk_change", F.col("average_risk") - before)


def histogram_by_label(df: DataFrame, label: str, value: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts at fixed bounds per label, with the open last bound and the sum."""
    counters = [F.count_if(F.col(value) <= b) for b in bounds] + [F.count(value)]
    marks = [*bounds, float("inf")]
    cells = F.array(*[F.struct(F.lit(float(b)).alias("le"), c.alias("cumulative")) for b, c in zip(marks, counters)])
    return df.groupBy(label).agg(cells.alias("cells")).select(label, F.inline("cells"))


def bucket_quantile(hist: DataFrame, label: str, q: float) -> DataFrame:
    """Quantile from cumulative bucket counts, linear inside the bucket; the open bucket gives its lower bound."""
    w = Window.partitionBy(label).orderBy("le")
    prev_le = F.coalesce(F.lag("le").over(w), F.lit(0.0))
    prev_n = F.coalesce(F.lag("cumulative").over(w), F.lit(0))
    total = F.max("cumulative").over(Window.partitionBy(label))
    # one row per label and bound
    t = hist.select(label, "le", "cumulative", prev_le.alias("lo"), prev_n.alias("below"), (total * q).alias("rank"))
    hit = t.filter((F.col("cumulative") >= F.col("rank")) & ((F.col("below") < F.col("rank")) | (F.col("below") == 0)))
    inside = F.col("lo") + (F.col("le") - F.col("lo")) * F.try_divide(F.col("rank") - F.col("below"), F.col("cumulative") - F.col("below"))
    value = F.when(F.col("le") == float("inf"), F.col("lo")).otherwise(inside)
    return hit.groupBy(label).agg(F.min_by(value, "le").alias("quantile"))


def counter_summary(df: DataFrame, labels: list[str], value: str, shares: dict[str, float], accuracy: int = 100000) -> DataFrame:
    """Counts, sums and sketched quantiles by label."""
    q = F.percentile_approx(value, list(shares.values()), accuracy)
    base = df.groupBy(*labels).agg(F.count("*").alias("n"), F.sum(value).alias("total"), q.alias("q"))
    return base.select(*labels, "n", "total", *[F.col("q")[i].alias(a) for i, a in enumerate(shares)])


# ---------------------------------------------------------------- row changes


def upsert(base: DataFrame, delta: DataFrame, key: str, version: str) -> DataFrame:
    """The newest version of every key wins. ``max_by`` keeps one row per key on the map side."""
    cols = [c for c in base.columns if c != key]
    newest = F.max_by(F.struct(*cols), F.struct(version, *[c for c in cols if c != version])).alias("r")
    return base.unionByName(delta).groupBy(key).agg(newest).select(key, "r.*")


def insert_if_absent(base: DataFrame, delta: DataFrame, key: str, order: str) -> DataFrame:
    """Only new keys are added; among equal new keys the first by ``order``."""
    cols = [c for c in delta.columns if c != key]
    first = delta.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(order, *cols)).alias("r")).select(key, "r.*")
    return base.unionByName(first.join(base.select(key), key, "left_anti"))


def partial_update(base: DataFrame, delta: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Null in the delta keeps the old value. The delta holds one row per key."""
    new = delta.select(key, *[F.col(c).alias(f"new_{c}") for c in cols])
    return base.join(new, key, "left").select(
        *[F.coalesce(f"new_{c}", c).alias(c) if c in cols else F.col(c) for c in base.columns]
    )
