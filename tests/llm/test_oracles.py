"""The queries that SQL can express against DuckDB, on the driver's small tables."""

from pathlib import Path

import pytest

from tessella.llm import queries

SMALL = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SMALL.exists(), reason="the driver's tables are elsewhere")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in SMALL.glob("*.parquet"):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
    got = queries.QUERIES[name](spark, str(SMALL))
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))
