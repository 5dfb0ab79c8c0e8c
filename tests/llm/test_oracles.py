"""Registered queries of this subpackage against their SQL on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from turnmill.llm.oracles import ORACLES
from turnmill.llm.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = QUERIES[name](spark, str(DATA)), con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    place = [want.columns.index(c) for c in got.columns]
    assert Counter(map(str, map(tuple, got.collect()))) == Counter(str(tuple(r[i] for i in place)) for r in want.fetchall())
