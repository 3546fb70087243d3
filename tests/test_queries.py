"""Every query against its SQL, and the driver contract."""

import datetime
import decimal
import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from tidemark import queries
from tidemark.streaming import windows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def same(spark, duck, run, sql):
    want = duck.sql(sql)
    columns = sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    got = run(spark, SF)
    assert sorted(got.columns) == columns
    found = Counter(tuple(plain(r[c]) for c in columns) for r in got.collect())
    assert found == Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    same(spark, duck, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_stream_windows_are_whole(spark):
    got = queries.QUERIES["stream_tumbling"](spark, SF)
    assert got.columns == ["event_type", "start", "n"] and got.where("n < 1").count() == 0


def test_drained_stream_drops_neither_open_windows_nor_late_events(spark, tmp_path):
    days = [datetime.datetime(2024, 1, d, 12) for d in (20, 21, 1, 2, 20)]
    for day in days:  # a file each, one a micro-batch
        spark.createDataFrame([(day, "a")], "ts timestamp, event_type string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    stream = windows.tumbling(windows.events(spark, f"{tmp_path}/events", 1), "ts", "event_type")
    got = Counter({r.start: r.n for r in windows.drained(stream, "late", "complete").collect()})
    assert got == Counter(d.replace(hour=0) for d in days)


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 5
