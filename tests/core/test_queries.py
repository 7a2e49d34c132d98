"""Every query against its DuckDB SQL over the smallest tables, where they are there."""

import os
from pathlib import Path

import duckdb
import pytest

from helixloom.queries import ORACLE_SQL, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    db = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from '{p}'")
    found = db.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    want = sorted(tuple(map(plain, r)) for r in found.fetchall())
    got = QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(map(plain, r)) for r in got.select(*[f"`{c}`" for c in columns]).collect()) == want
