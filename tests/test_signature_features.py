"""Raw features: every case of a slot, and work that grows with the filled slots only."""

from pyspark.sql import functions as F

from plumbline.operators import signatures as sg


def test_slots_of_missing_scores_and_statistics(spark):
    dims = spark.createDataFrame([(1, "gradient_health", 30.0), (1, "entropy_stability", None), (2, "unknown", 1.0)], "k long, dim_name string, score double")
    stats = F.create_map(F.lit("mean"), F.when(F.col("k") == 1, 7.0), F.lit("max"), F.lit(9.0), F.lit("kurtosis"), F.lit(2.0))
    rows = sg.scores_by_name(dims, "k").withColumn("raw", sg.raw_features(F.col("scores"), stats))
    got = {r["k"]: r["raw"] for r in rows.collect()}
    marks = [0.5, 0.5, 0.5, 0.3, 0.5, 0.5, 0.5, 0.5]
    assert got[1] == (marks + [7.0] + [0.0] * 16 + [9.0] + [0.0] * 24 + [0.0, 2.0] + [0.0] * 128)[:128]
    assert got[2] == ([0.5] * 8 + [0.0] * 24 + [9.0] + [0.0] * 24 + [0.0, 2.0] + [0.0] * 128)[:128]
    slots = {(r["slot"], r["value"]) for r in rows.filter("k = 1").select(sg.filled_slots(F.col("raw"))).collect()}
    assert slots == {(i, v) for i, v in enumerate(got[1]) if v != 0}


def test_empty_slots_make_no_rows(spark, sf):
    """No list is collected per validation, and no row is made and dropped again."""
    from __spark_entry__ import queries

    plan = queries()["sig_01_raw_features"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "posexplode(raw" not in plan


def test_features_are_written_once(spark):
    """Fitting and the result read the stored features, so what is behind them runs once."""
    reads = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            reads.add(len(f))
            yield f

    rows = spark.createDataFrame([(i, [float(i), float(i * i % 7), 1.0]) for i in range(40)], "k long, raw array<double>")
    assert sg.learned_embedding(rows.mapInPandas(counted, rows.schema), "raw", 2).count() == 40
    assert reads.value == 40
