"""Every query of the subpackage runs on the smallest tables, gives a stable schema, and agrees with its SQL where it has one."""

import os

import pytest

from archiveloom.llm.queries import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the test tables aren't there")


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


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    got = df.toPandas()
    assert list(got.columns) == df.columns and len(set(df.columns)) == len(df.columns)
    if name in ORACLE:
        assert rows(got) == rows(duck.sql(ORACLE[name]).df())


def test_found_columns(spark):
    """The cases that the problems define come with exactly their columns."""
    wanted = {
        "p1_found": "rec_no bigint, lang string", "p2_found": "node_id string, subject string", "p3_found": "keep_id bigint, copy_id bigint", "p4_found": "rec_no bigint",
        "p5_found": "rec_no bigint", "p6_found": "rec_no bigint, kind string", "p7_found": "src string, item_key bigint", "p10_found": "doc_id bigint",
    }
    for name, columns in wanted.items():
        assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in QUERIES[name](spark, SMALL).schema) == columns
