"""Every query runs on the smallest tables, gives a stable schema, and agrees with its SQL."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from archiveloom.plans import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the test tables aren't there")
NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SMALL}/{f}'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    shown = lambda v: "-" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(shown(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    got = df.toPandas()
    assert list(got.columns) == df.columns and len(set(df.columns)) == len(df.columns)
    if name in ORACLE:
        assert rows(got) == rows(duck.sql(ORACLE[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_without_the_subpackage(tmp_path):
    """The rest imports and registers with the llm folder gone."""
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "archiveloom"), tmp_path / "archiveloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('p1_') for n in q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, timeout=120).returncode == 0
