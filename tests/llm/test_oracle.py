"""The queries that SQL can express against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from evlog.llm.oracle import SQL
from evlog.llm.queries import QUERIES
from tests.conftest import SMALL


def plain(rows):
    return sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "embeddings"):
        assert os.path.exists(f"{SMALL}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    found = QUERIES[name](spark, SMALL)
    columns = sorted(found.columns)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    assert plain(found.select(*columns).collect()) == plain(expected)
