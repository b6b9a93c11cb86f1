"""Registered SQL of the subpackage against its queries on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from corpusgraph.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    a, b = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLE[name]).df()
    c = sorted(a.columns)
    assert c == sorted(b.columns) and len(a)
    rows = lambda d: sorted(map(str, d[c].astype(str).values.tolist()))
    assert rows(a) == rows(b)
