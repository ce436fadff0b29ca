"""Every registered query runs; those with SQL agree with it on whole tables."""

import pathlib
import shutil
import subprocess
import sys

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle_check import compare

ORACLES = oracle_sql()
QUERIES = queries()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, sf, duck, name):
    assert compare(QUERIES[name](spark, sf), duck, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() > 0


def test_entry(spark):
    rows = {r["dim_name"]: r for r in entry(spark).collect()}
    assert len(rows) == 9 and all(0 <= r["score"] <= 100 for r in rows.values())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("left_out", [("plumbline/llm", "tests/llm"), ("plumbline/llm", "tests/llm", "corpus_pipeline.py")])
def test_imports_without_the_optional_parts(tmp_path, left_out):
    """The training-data folders can be deleted, with or without the pipeline; all other queries stay."""
    root = pathlib.Path(__file__).parent.parent
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=lambda folder, names: [n for n in names if n == ".git" or str((pathlib.Path(folder) / n).relative_to(root)) in left_out])
    code = "import __spark_entry__ as e; print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=300, check=True).stdout
    assert int(out) == sum(not (n.startswith("op") and n[2].isdigit()) and n != "pipeline" for n in QUERIES)
