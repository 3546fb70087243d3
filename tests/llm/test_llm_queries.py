"""The queries of this subpackage that SQL can express, against it; all ten are registered."""

import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from tidemark.llm import queries

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(want.fetchall())


def test_neighbours_reach_the_recall(spark):
    want: dict = {}
    for r in queries.QUERIES["op9_near_neighbours"](spark, SF).collect():
        want.setdefault(r.query_id, set()).add(r.vec_id)
    c = duckdb.connect()
    rows = c.sql(f"""
        WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM '{SF}/embeddings.parquet')
        SELECT q.vec_id, c.vec_id FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id != c.vec_id
        QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.x, c.x) DESC, c.vec_id) <= 20""").fetchall()
    assert sum(v in want[q] for q, v in rows) / len(rows) >= 0.9
