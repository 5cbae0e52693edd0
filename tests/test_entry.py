import importlib
import subprocess
import sys

import duckdb
import pytest

from gridloom.plans import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, frame.astype(object).where(frame.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_queries_equal_their_sql(spark, duck, name):
    got = core.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(core.ORACLE[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_the_entry_point_runs(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_entry_imports_without_the_llm_folder(tmp_path):
    """A copy of the repository without the optional parts still works."""
    import shutil
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "gridloom", tmp_path / "gridloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(n.startswith('op') for n in q), q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
