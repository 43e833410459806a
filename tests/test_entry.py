"""The driver contract, and every registered query against its DuckDB oracle
on the smallest scale factor."""

from __future__ import annotations

import os

import duckdb
import pytest
from conftest import SMALL

import __spark_entry__ as E
from evlog.plans.oracle import SQL
from evlog.plans.queries import BATCH_QUERIES
from evlog.streaming.queries import STREAM_QUERIES, STREAM_SQL

CORE = {*BATCH_QUERIES, *STREAM_QUERIES}  # the optional subpackage has tests of its own

DUCK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE",
              "date": "DATE"}
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def _canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = []
    for r in rows:
        vals = []
        for i in order:
            v = r[i]
            if isinstance(v, float):
                v = round(v, 6)
            elif isinstance(v, (bytes, bytearray)):
                v = bytes(v).hex()
            vals.append(v)
        out.append(repr(tuple(vals)))
    return sorted(out)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SMALL}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["window_start", "n", "total"]
    rows = df.orderBy("window_start").collect()
    assert rows and rows[-1].total == 1000


def test_every_query_has_an_oracle():
    assert CORE == set(SQL) | set(STREAM_SQL) and CORE <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(CORE))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SMALL)
    s_rows = [tuple(r) for r in df.collect()]
    res = duck.execute(E.oracle_sql()[name])
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    assert sorted(df.columns) == sorted(d_cols)
    spark_types = {f.name: DUCK_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString())
                   for f in df.schema.fields}
    assert spark_types == {d[0]: str(d[1]) for d in res.description}
    assert len(s_rows) == len(d_rows)
    assert _canon(df.columns, s_rows) == _canon(d_cols, d_rows)


def test_queries_do_not_depend_on_session_settings(spark, duck):
    """Other time zone, ANSI off, other shuffle width: same results."""
    settings = {"spark.sql.session.timeZone": "Asia/Kolkata", "spark.sql.ansi.enabled": "false",
                "spark.sql.shuffle.partitions": "13"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for name in sorted(CORE):
            df = E.queries()[name](spark, SMALL)
            res = duck.execute(E.oracle_sql()[name])
            d_cols = [d[0] for d in res.description]
            assert _canon(df.columns, [tuple(r) for r in df.collect()]) == _canon(d_cols, res.fetchall()), name
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
