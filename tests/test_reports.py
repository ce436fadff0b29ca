"""The validation report holds every field of the risk projection."""

from plumbline.sources import writers


def test_report_carries_the_recommendation(spark):
    runs = spark.createDataFrame([(1, 7, "completed", "2020-01-01", 80.0), (2, 7, "pending", "2020-01-01", 80.0), (3, 7, "completed", "2020-01-01", 40.0)],
                                 "validation_id long, dataset_id long, status string, created_at string, collapse_score double")
    dims = runs.selectExpr("validation_id", "collapse_score", "'entropy_stability' AS dim_name", "collapse_score AS score")
    made = {r["validation_id"]: r["results"] for r in writers.report(runs, dims).collect()}
    assert {k: r["recommendation"] for k, r in made.items()} == {1: "approved", 2: "rejected", 3: "rejected"}
    assert made[1]["risk_score"] == 20 and made[1]["warranty_eligible"] and made[3]["risk_level"] == "high"
