"""Every query with SQL gives DuckDB's rows; the others give rows."""

import datetime
import math

import pytest

duckdb = pytest.importorskip("duckdb")

from veilframe.plans import queries as q  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return round(float(v), 4) if type(v).__name__ == "Decimal" else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(norm(r[i]) for i in order)) for r in data)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [n for n in q.QUERIES if n in q.ORACLE])
def test_same_rows(spark, sf, duck, name):
    df = q.QUERIES[name](spark, sf)
    found = duck.execute(q.ORACLE[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, found.fetchall())


@pytest.mark.parametrize("name", [n for n in q.QUERIES if n not in q.ORACLE])
def test_gives_rows(spark, sf, name):
    assert q.QUERIES[name](spark, sf).count() >= 0


def test_every_subject_in_order_of_use(spark):
    sf = "/root/testdata/sf0.01"  # the smallest with more than ten subjects
    users = spark.read.parquet(f"{sf}/events.parquet").where("user_id > 5").select("user_id").distinct().count()
    found = q.QUERIES["subjects_by_use"](spark, sf).collect()
    assert len(found) == users > 10
    assert [r["id"] for r in found] == [r["id"] for r in sorted(found, key=lambda r: (-r["used_us"], r["id"]))]


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert len(rows) == 4
    assert all(r["passed"] and r["survivors"] == 0 for r in rows)
    assert sum(r["detections"] for r in rows) == 7
    assert set(e.oracle_sql()) <= set(e.queries())
