"""Folders of mixed formats, and results of models against plain numpy on whole tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from plumbline import roles
from plumbline.plans.oracle_parts import FEATURES
from plumbline.sources import readers

ROWS = "k BIGINT, s STRING"


def test_folder_of_mixed_formats(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "a.csv").write_text("k,s\n1,one\n2,\n")
    (tmp_path / "deep" / "b.TSV").write_text("k\ts\n3,\tthree\n".replace("3,", "3"))
    (tmp_path / "deep" / "c.json").write_text(json.dumps([{"k": 4, "s": "four"}, {"k": 5, "s": None}], indent=1))
    (tmp_path / "deep" / "er" / "d.jsonl").write_text('{"s": "six", "k": 6, "more": 1}\n{"k": 7}\n')
    (tmp_path / "e.ndjson").write_text('{"k": 8, "s": "eight"}\n')
    spark.createDataFrame([(9, "nine")], ROWS).coalesce(1).write.parquet(str(tmp_path / "p"))
    got = sorted(tuple(r) for r in readers.read_folder(spark, str(tmp_path), ROWS).collect())
    assert got == [(1, "one"), (2, None), (3, "three"), (4, "four"), (5, None), (6, "six"), (7, None), (8, "eight"), (9, "nine")]
    (tmp_path / "deep" / "notes.xyz").write_text("?")
    with pytest.raises(ValueError, match=r"unsupported file format: \.xyz"):
        readers.read_folder(spark, str(tmp_path), ROWS)


def test_folder_without_files(spark, tmp_path):
    assert readers.read_folder(spark, str(tmp_path), ROWS).count() == 0


def test_format_column_is_the_functions(spark):
    names = ["a.csv", "b/c.TSV", "x.y/noending", "m.parquet", "m.pq", "q.Feather", "z.arrow", "u.json", "v.ndjson", "w.jsonl", "t.csv.gz", "x.txt"]
    got = {r[0]: r[1] for r in spark.createDataFrame([(n,) for n in names], "p string").select("p", readers.format_column(F.col("p"))).collect()}
    for n in names:
        try:
            assert got[n] == readers.detect_format(n)
        except ValueError:
            assert got[n] is None


def test_cumulative_variance(spark, sf):
    pair = roles.pair(spark, sf).select("side", *FEATURES).toPandas()
    want = []
    for side, rows in pair.groupby("side"):
        values = np.linalg.eigvalsh(rows[FEATURES].astype(float).cov().to_numpy())[::-1]
        want += [(side, i, c) for i, c in enumerate(np.cumsum(values) / values.sum())]
    got = sorted(tuple(r) for r in queries()["win_05_cumulative_variance"](spark, sf).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-9)


def test_cluster_report(spark, sf):
    """Sizes, radii, densities and the silhouette follow from the centres by definition."""
    rows = roles.table(spark, sf, "orders").select(F.col("o_totalprice") / 1000, F.dayofyear("o_orderdate").cast("double")).toPandas().fillna(0.0).to_numpy(float)
    report = sorted(queries()["doc_10_cluster_report"](spark, sf).collect(), key=lambda r: r["cluster_id"])
    centres = np.array([r["centroid"] for r in report])
    far = np.sqrt(((rows[:, None] - centres) ** 2).sum(axis=2))
    own = far.argmin(axis=1)
    assert sum(r["size"] for r in report) == len(rows)
    for k, r in enumerate(report):
        assert r["size"] == (own == k).sum() and np.isclose(r["radius"], far[own == k, k].mean())
        assert np.isclose(r["density"], r["size"] / r["radius"])
    apart = ((rows[:, None] - rows) ** 2).sum(axis=2)
    sums = np.stack([apart[:, own == k].sum(axis=1) for k in range(len(report))], axis=1)
    sizes = np.bincount(own)
    at = np.arange(len(rows))
    inner = sums[at, own] / (sizes[own] - 1)
    means = sums / sizes
    means[at, own] = np.inf
    outer = means.min(axis=1)
    assert np.isclose(report[0]["silhouette"], ((outer - inner) / np.maximum(outer, inner)).mean(), atol=1e-6)


def test_signature_clusters(spark, sf):
    """Every pattern has a cluster, and its anomaly is the distance to the mean of the cluster it is in."""
    library = {r["signature_id"]: np.array(r["vector"], float) for r in roles.signatures(spark, sf).select("signature_id", "vector").collect()}
    got = {r["signature_id"]: r for r in queries()["sig_13_clusters"](spark, sf).collect()}
    assert set(got) == set(library)
    groups = {}
    for i, r in got.items():
        groups.setdefault(r["cluster_id"], []).append(i)
    assert len(groups) == max(2, min(10, len(library) // 10))
    centres = {c: np.mean([library[i] for i in ids], axis=0) for c, ids in groups.items()}
    for i, r in got.items():
        assert np.isclose(r["anomaly_score"], np.linalg.norm(library[i] - centres[r["cluster_id"]]), rtol=1e-6)
