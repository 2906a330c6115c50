"""Every registered core query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from plumbline.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def cells(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr([round(float(r[k]), 6) if isinstance(r[k], float) else r[k] for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    got = df.collect()
    if name in SQL:
        found = db.execute(SQL[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == sorted(df.columns)
        assert cells([list(r) for r in got], df.columns) == cells(found.fetchall(), names)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_whole_reports(spark):
    risks = {r["risk_type"] for r in QUERIES["leakage_report_whole"](spark, DATA).select("risk_type").distinct().collect()}
    assert {"full_decode_error", "cross_split_group", "near_duplicate"} <= risks
    assert QUERIES["gate_orphans"](spark, DATA).agg({"orphan": "sum"}).first()[0] > 0
