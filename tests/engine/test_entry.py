"""The entry points, with and without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[2]


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["c_custkey", "pos", "o_orderkey", "o_totalprice"] and df.count() == 21


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_engine_stands_alone(tmp_path):
    """Without the subpackage and the pipeline everything else is there."""
    for name in ("nidifold", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", ROOT / name, tmp_path / name], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "nidifold/llm"], check=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    n, pipeline = said.stdout.split()[-2:]
    assert int(n) > 60 and pipeline == "False"
