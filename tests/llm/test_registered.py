"""The registered queries with an oracle, on the given small tables."""

import duckdb
import pytest

from tierline.llm.queries import QUERIES
from tierline.llm.sql import ORACLE

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    want = con.sql(ORACLE[name])
    columns = sorted(want.columns)
    rows = sorted(repr(r) for r in want.select(", ".join(columns)).fetchall())
    got = QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == columns
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == rows
