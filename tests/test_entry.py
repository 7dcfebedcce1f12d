"""Every registered query against its SQL on the smallest tables; queries without SQL must run."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = sorted(entry.queries())


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in sorted(os.listdir(data)):
        c.execute(f"create view {f[:-8]} as select * from '{data}/{f}'")
    return c


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and entry.entry(spark).columns == ["campo", "note_id", "parte", "periodo", "caso"]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, data, duck, name):
    df = entry.queries()[name](spark, data)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    rel = duck.sql(sql)
    cols = list(rel.columns)
    assert sorted(cols) == sorted(df.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in rows), key=repr)
    theirs = sorted((tuple(map(plain, r)) for r in rel.fetchall()), key=repr)
    assert mine == theirs


def test_rest_works_without_the_text_subpackage(tmp_path):
    """A copy without the subpackage imports and registers everything else."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(os.path.join(root, "tabularium"), tmp_path / "tabularium", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*sorted(e.queries()))"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout.split()
    llm = {n for n in NAMES if n.startswith("p") and n not in {q for q in said}}
    assert set(said) == set(NAMES) - llm and {"p2_found", "p7_found"} <= set(said) and not any(q.startswith(("p1_", "p3_", "p8_")) for q in said)
