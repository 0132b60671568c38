"""Every registered query against its SQL, on the smallest given tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from spanveil.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, tables, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(row[c]) for c in columns) for row in df.collect())
    assert got, "a query that finds nothing checks nothing"
    if name not in ORACLES:
        return
    result = tables.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    assert got == Counter(tuple(plain(row[i]) for i in place) for row in result.fetchall())
