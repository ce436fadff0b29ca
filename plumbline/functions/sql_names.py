"""SQL names for two-sample measures over arrays: ``bin_counts``, ``psi``, ``ks_of_counts`` and the table function ``expand_bins``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# The tiny share that keeps an empty bin finite.
EPS = "1e-6D"

FUNCTIONS = {
    "bin_counts": f"""(vals ARRAY<DOUBLE>, lo DOUBLE, hi DOUBLE, bins INT) RETURNS ARRAY<BIGINT> RETURN
        aggregate(vals, array_repeat(0L, bins), (acc, v) -> CASE WHEN v IS NULL THEN acc ELSE transform(acc, (n, i) ->
          n + CAST(i = greatest(0, least(bins - 1, CAST(floor((v - lo) / (hi - lo) * bins) AS INT))) AS BIGINT)) END)""",
    "psi": f"""(expected ARRAY<BIGINT>, actual ARRAY<BIGINT>) RETURNS DOUBLE RETURN
        aggregate(zip_with(
            transform(expected, n -> greatest(n / aggregate(expected, 0L, (s, x) -> s + x), {EPS})),
            transform(actual, n -> greatest(n / aggregate(actual, 0L, (s, x) -> s + x), {EPS})), (q, p) -> (p - q) * ln(p / q)), 0D, (s, x) -> s + x)""",
    "ks_of_counts": """(a ARRAY<BIGINT>, b ARRAY<BIGINT>) RETURNS DOUBLE RETURN
        array_max(transform(sequence(1, size(a)), k -> abs(
          aggregate(slice(a, 1, k), 0L, (s, x) -> s + x) / aggregate(a, 0L, (s, x) -> s + x)
          - aggregate(slice(b, 1, k), 0L, (s, x) -> s + x) / aggregate(b, 0L, (s, x) -> s + x))))""",
}


@F.udtf(returnType="bin bigint, low double, high double, n bigint")
class ExpandBins:
    """Table function: a row for each bin of packed counts between two limits; null or empty counts give no row."""

    def eval(self, counts: list[int], lo: float, hi: float) -> Iterator[tuple]:
        width = len(counts or [])
        for i in range(width):
            yield i, lo + (hi - lo) * i / width, lo + (hi - lo) * (i + 1) / width, counts[i]


def register(spark: SparkSession) -> None:
    """Make the functions known to a session. All but the table function are SQL expressions, so the optimizer sees through them."""
    spark.udtf.register("expand_bins", ExpandBins)
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
