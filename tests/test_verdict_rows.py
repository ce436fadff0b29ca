"""Verdicts over many validations: rows that are there stay in place, and nothing is sorted or collected per validation."""

from plumbline.operators import collapse as cd


def test_neutral_rows_of_odd_keys(spark):
    """A null score is neutral, repeated rows stay, a null key has no row of its own, other names take no part."""
    rows = [(1, "gradient_health", 10.0), (1, "gradient_health", 20.0), (1, "entropy_stability", None), (1, "unknown", 5.0), (None, "gradient_health", 1.0), (2, "unknown", 1.0)]
    out = cd.with_neutral(spark.createDataFrame(rows, "k long, dim_name string, score double"), "k", {"more": 50.0}).collect()
    got = sorted((r["k"] or 0, r["dim_name"], r["threshold"], r["score"], r["neutral"]) for r in out)
    marks = cd.THRESHOLDS | {"more": 50.0}
    want = [(k, d, t, t, True) for k in (0, 1, 2) for d, t in marks.items() if (k, d) != (1, "gradient_health")]
    assert got == sorted([*want, (1, "gradient_health", 60.0, 10.0, False), (1, "gradient_health", 60.0, 20.0, False)])


def test_warnings_are_counted_not_collected(spark, sf):
    from __spark_entry__ import queries

    plan = queries()["cd_28_warnings"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Join" not in plan and "Sort" not in plan
    plan = queries()["cd_27_overall"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Sort" not in plan


def test_warning_texts(spark):
    d = spark.createDataFrame([(1, "a", 40.0, "critical"), (1, "gradient_health", 50.0, "warning"), (2, "gradient_health", 70.0, "ok")], "k long, dim_name string, score double, severity string")
    got = {r["k"]: r["warnings"] for r in cd.warnings(d, "k", {"a": 60.0}).collect()}
    assert got == {1: ["COLLAPSE DETECTED", "CRITICAL: a", "WARNING: gradient_health"], 2: ["ALL PASSED"]}
