"""State that outlives its rows: sketches, session and entry streams, spectra in few passes, links between fixes."""

import datetime as dt
import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from plumbline.functions import sql_names
from plumbline.operators import carried as ca
from plumbline.operators import collapse as cd
from plumbline.operators import learned
from plumbline.operators import planning as pl
from plumbline.streaming import jobs
from plumbline.streaming.run import file_stream, timer_store

START = dt.datetime(2024, 1, 1)
EVENT = "event_id long, user_id long, ts timestamp_ntz"


def test_merged_sketches(spark):
    """Any chunks, merged in any number of steps, keep the error bounds of one pass over all rows."""
    rng = np.random.default_rng(1)
    x = np.sort(np.concatenate([rng.normal(size=6000), np.full(4000, 0.5)]))
    df = spark.createDataFrame([(i % 13, float(v), None if i % 2 else 1.0) for i, v in enumerate(x)], "chunk int, a double, b double")
    states = ca.chunk_states(df, ["a", "b"], ["chunk"])
    halves = [ca.merged_states(states.where(c)) for c in ("chunk < 6", "chunk >= 6")]
    whole = ca.chunk_states(df, ["a", "b"])
    for merged in (ca.merged_states(states), ca.merged_states(halves[0].unionByName(halves[1])), ca.merged_states(whole)):
        r = {r["col"]: r for r in ca.finished(merged).collect()}
        assert (r["a"]["count"], r["b"]["count"], r["b"]["distinct"], r["b"]["std"]) == (10_000, 5000, 1, 0.0)
        assert np.isclose(r["a"]["mean"], x.mean()) and np.isclose(r["a"]["std"], x.std()) and abs(r["a"]["distinct"] / 6001 - 1) < 0.06
        for name, q in ca.QUANTILES.items():
            low, high = np.searchsorted(x, r["a"][name], "left") / len(x), np.searchsorted(x, r["a"][name], "right") / len(x)
            assert low - 0.03 <= q <= high + 0.03
    assert ca.finished(ca.merged_states(states.limit(0))).count() == 0


def run_counting(spark, stream, folder):
    """All rows a stream appends, and the rows in its state after every micro-batch."""
    q = stream.writeStream.outputMode("append").option("checkpointLocation", str(folder / "progress")).trigger(availableNow=True).format("parquet").option("path", str(folder / "out")).start()
    q.awaitTermination()
    states = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in q.recentProgress]
    return spark.read.schema(stream.schema).parquet(str(folder / "out")).collect(), states


def arriving(spark, folder, batches):
    """Files of events, one for each micro-batch, in the order given."""
    path = str(folder / "in")
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, EVENT).coalesce(1).write.mode("append").parquet(path)
        # the source reads files in the order of their times
        for f in os.listdir(path):
            if f.endswith(".parquet") and os.path.getmtime(f"{path}/{f}") > 1e9 + 10**6:
                os.utime(f"{path}/{f}", (1e9 + n, 1e9 + n))
    return file_stream(spark, path, spark.createDataFrame([], EVENT).schema, 1)


def test_session_stream_merges_late_rows_and_forgets(spark, tmp_path):
    rnd = random.Random(3)
    events, ids = [], itertools.count()
    for hour in range(0, 40, 2):
        for user in range(5):
            events += [(next(ids), user, START + dt.timedelta(hours=hour, minutes=rnd.randint(0, 50))) for _ in range(6)]
    events.sort(key=lambda e: (e[2], e[0]))
    # rows are shuffled within nine minutes, less than the watermark waits
    shuffled = sorted(events, key=lambda e: e[2] + dt.timedelta(minutes=rnd.random() * 9))
    batches = [shuffled[k : k + 60] for k in range(0, len(shuffled), 60)]
    rows, states = run_counting(spark, jobs.sessions_stream(arriving(spark, tmp_path, batches)), tmp_path)
    want = []
    for user in range(5):
        times = sorted(e[2] for e in events if e[1] == user)
        group = [times[0]]
        for t in times[1:] + [None]:
            if t is None or t - group[-1] >= dt.timedelta(minutes=30):
                want.append((user, group[0], group[-1] + dt.timedelta(minutes=30), len(group)))
                group = []
            group.append(t)
    end = max(e[2] for e in events) - dt.timedelta(minutes=10)
    assert sorted((r["user_id"], r["started_at"], r["expires_at"], r["events"]) for r in rows) == sorted(w for w in want if w[2] <= end)
    assert len(want) > 60 and max(states) <= 5 * 8


def test_session_query_sends_open_sessions(spark, tmp_path):
    """Sessions that are open when the events end are in the result, and files out of order lose no event."""
    minute = lambda m: START + dt.timedelta(minutes=m)
    rows = [(0, 1, minute(0)), (1, 1, minute(20)), (2, 2, minute(600)), (3, 1, minute(605))]
    spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = queries()["str_06_sessions_stream"](spark, str(tmp_path)).collect()
    assert sorted((r["user_id"], r["started_at"], r["expires_at"], r["events"]) for r in got) == [
        (1, minute(0), minute(50), 2), (1, minute(605), minute(635), 1), (2, minute(600), minute(630), 1)]


def test_entries_expire_by_timer(spark, tmp_path):
    minute = lambda m: START + dt.timedelta(minutes=m)
    batches = [
        [(k, k % 7, minute(k % 5)) for k in range(70)],
        [(100, 0, minute(30)), (101, 99, minute(31))],
        # far ahead: every entry but the last expires
        [(102, 50, minute(600))],
        [(103, 51, minute(1200))],
    ]
    with timer_store(spark):
        rows, states = run_counting(spark, jobs.expired_entries(arriving(spark, tmp_path, batches), 3600), tmp_path)
    got = {r["user_id"]: (r["first_used"], r["last_used"], r["expired_at"], r["uses"]) for r in rows}
    assert set(got) == {*range(7), 99, 50} and len(rows) == 9
    assert got[0] == (minute(0), minute(30), minute(90), 11) and got[99] == (minute(31), minute(31), minute(91), 1)
    assert got[3][3] == 10 and got[50][2] == minute(660)
    # one key is left of nine; a state holds its entry and its timer
    assert max(states) >= 7 and states[-1] <= 4


def test_entry_ends_at_a_pause_inside_a_batch(spark, tmp_path):
    minute = lambda m: START + dt.timedelta(minutes=m)
    with timer_store(spark):
        rows, _ = run_counting(spark, jobs.expired_entries(arriving(spark, tmp_path, [[(1, 1, minute(0)), (2, 1, minute(59)), (3, 1, minute(119)), (4, 1, minute(300))]]), 3600), tmp_path)
    assert sorted((r["first_used"], r["uses"]) for r in rows) == [(minute(0), 2), (minute(119), 1)]


@pytest.mark.parametrize("d", [1, 4, 64])
def test_spectra_of_few_columns_are_exact(spark, d):
    rng = np.random.default_rng(d)
    x = rng.normal(size=(300, d)) * np.linspace(5, 0.1, d) + 100
    x[:, 0] *= 3
    cols = [f"x{i}" for i in range(d)]
    df = spark.createDataFrame([("a" if k % 3 else "b", *map(float, v)) for k, v in enumerate(x)], "side string, " + ", ".join(f"{c} double" for c in cols))
    for side, (values, whole) in learned.spectra(df.repartition(3), cols, "side").items():
        mine = x[[k for k in range(300) if (k % 3 > 0) == (side == "a")]]
        cov = np.atleast_2d(np.cov(mine.T))
        assert np.allclose(values, np.linalg.eigvalsh(cov)[::-1], rtol=1e-6, atol=1e-6) and np.isclose(whole, np.trace(cov))
        assert learned.components_needed(values, whole) == learned.effective_dimension(cov)


def test_spectra_of_two_thousand_columns(spark):
    d, n = 2000, 240
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, d))
    x = (rng.normal(size=(n, 12)) * np.linspace(9, 2, 12)) @ base + 0.05 * rng.normal(size=(n, d))
    cols = [f"x{i}" for i in range(d)]
    df = spark.createDataFrame([("original" if k % 2 else "synthetic", v.tolist()) for k, v in enumerate(x)], "side string, v array<double>")
    df = df.select("side", *[F.col("v")[i].alias(c) for i, c in enumerate(cols)])
    found = learned.spectra(df, cols, "side")
    for side, (values, whole) in found.items():
        mine = x[[k for k in range(n) if (k % 2 == 1) == (side == "original")]]
        centred = mine - mine.mean(0)
        exact = np.linalg.svd(centred, compute_uv=False) ** 2 / (len(mine) - 1)
        assert np.allclose(values[:12], exact[:12], rtol=1e-6) and np.isclose(whole, exact.sum())
        assert learned.components_needed(values, whole) == int(np.argmax(np.cumsum(exact) / exact.sum() > 0.9)) + 1
    assert learned.dimension_metrics(found)["dimensionality_ratio"] > 0


def test_spectra_with_nulls_and_without_variance(spark):
    df = spark.createDataFrame([("original", 1.0, None), ("original", 3.0, None), ("synthetic", 2.0, 2.0)], "side string, a double, b double")
    found = learned.spectra(df, ["a", "b"], "side")
    assert np.allclose(found["original"][0], [2, 0]) and found["synthetic"][1] == 0
    assert learned.dimension_rows(spark, found).select("side", "dimension", "share").collect() == [("original", 1, 1.0), ("synthetic", 1, 0.0)]


def test_expand_bins(spark):
    sql_names.register(spark)
    rows = spark.sql("SELECT k, e.* FROM VALUES (1, array(2L, 0L, 5L), 0D, 3D), (2, array(), 0D, 1D), (3, CAST(NULL AS ARRAY<BIGINT>), 0D, 1D) t(k, c, lo, hi), LATERAL expand_bins(c, lo, hi) e")
    assert sorted(map(tuple, rows.collect())) == [(1, 0, 0.0, 1.0, 2), (1, 1, 1.0, 2.0, 0), (1, 2, 2.0, 3.0, 5)]


def test_top_pairs_with_ties(spark):
    rnd = random.Random(2)
    rows = [(i, j, rnd.choice([-0.9, 0.1, 0.5, 0.9, 0.0]), rnd.uniform(-1, 1)) for i in range(40) for j in range(i + 1, 40)]
    got = cd.top_pairs(spark.createDataFrame(rows, "i int, j int, r_syn double, r_orig double").repartition(5), 25).collect()
    for at, name in ((2, "in_syn"), (3, "in_orig")):
        want = {r[:2] for r in sorted(rows, key=lambda r: (-abs(r[at]), r[0], r[1]))[:25]}
        assert {(r["i"], r["j"]) for r in got if r[name]} == want


def plan(spark, links, ids, impact=None):
    """Candidates with the given ids in one validation, chosen in that order."""
    runs = [(1, x, f"t{x}", "c", 2, float((impact or {}).get(x, 10)), 1.0, 1.0, 1.0, 1.0, 0.1, 0.1, 1.0) for x in ids]
    names = ["validation_id", *pl.FIELDS[1:13]]
    df = spark.createDataFrame(runs, names).withColumns({
        "dependencies": F.array().cast("array<string>"), "incompatible": F.array().cast("array<string>"), "synergies": F.create_map().cast("map<string,double>")})
    df = pl.with_impact(pl.with_costs(pl.with_links(df, pl.link_table(spark, links))))
    return df, pl.as_plans(df.withColumn("place", F.array_position(F.array(*[F.lit(x) for x in ids]), F.col("rec_id")).cast("int")))


def test_links_between_fixes(spark):
    links = [("b", "a", "dependency", None), ("c", "b", "dependency", None), ("c", "outside", "dependency", None), ("x", "y", "dependency", None), ("y", "x", "dependency", None),
             ("z", "x", "dependency", None), ("d", "a", "exclusion", None), ("c", "a", "synergy", 2.0), ("c", "a", "synergy", 1.5), ("a", "c", "synergy", 9.0)]
    df, plans = plan(spark, links, ["c", "b", "a", "d", "x", "y", "z"])
    layers = {r["rec_id"]: r["layer"] for r in pl.execution_layers(plans).collect()}
    assert layers == {"a": 0, "b": 1, "c": 2, "d": 0, "x": None, "y": None, "z": None}
    order = pl.execution_order(plans).first()["execution_order"]
    assert set(order) == {"a", "b", "c", "d"} and order.index("a") < order.index("b") < order.index("c")
    states = {r["rec_id"]: (sorted(r["open"]), r["satisfied"], r["excluded"]) for r in pl.link_states(df, df.where("rec_id IN ('a', 'b', 'd')")).collect()}
    assert states["c"] == (["outside"], False, False) and states["d"] == ([], True, True) and states["b"] == ([], True, False)
    assert {(r["wants"], r["rec_id"]) for r in pl.open_dependencies(df, df.where("rec_id = 'x'")).collect()} == {("b", "a"), ("c", "b"), ("c", "outside"), ("x", "y")}
    # the synergy of c counts only if a was taken before it, the larger factor of a repeated link
    totals = lambda ids: pl.plan_totals(plan(spark, links, ids)[1]).first()["total_impact"]
    assert (totals(["a", "c"]), totals(["c", "d"])) == (30.0, 20.0) and totals(["c", "a"]) == 10.0 + 90.0
    greedy = lambda ids, impact: [x["rec_id"] for x in pl.greedy(plan(spark, links, ids, impact)[0], "max_impact").first()["selected"]]
    assert greedy(["a", "b", "d"], {"a": 9, "b": 5, "d": 1}) == ["a", "b"] and greedy(["a", "b", "d"], {"a": 5, "b": 9, "d": 7}) == ["d", "a"]
    assert greedy(["x", "y"], {}) == []
    with pytest.raises(ValueError, match="unknown kind"):
        pl.link_table(spark, [("a", "b", "friendship", None)])
