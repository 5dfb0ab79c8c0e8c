"""Each registered transcript query against its SQL on the smallest tables."""

from collections import Counter
from pathlib import Path

import pytest

from turnmill.plans import oracles, queries, rule_oracles, rules

QUERIES, ORACLES = queries.QUERIES | rules.QUERIES, oracles.ORACLES | rule_oracles.ORACLES

duckdb = pytest.importorskip("duckdb")
DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = QUERIES[name](spark, str(DATA))
    want = con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = want.fetchall()
    place = [want.columns.index(c) for c in got.columns]
    assert Counter(map(str, map(tuple, got.collect()))) == Counter(str(tuple(r[i] for i in place)) for r in rows)


def test_whole_texts_and_lines_come_through(spark):
    docs = spark.read.parquet(str(DATA / "documents.parquet")).select("doc_id", "text").collect()
    got = {r.doc_id: r.body for r in QUERIES["fence_strip"](spark, str(DATA)).collect()}
    assert got == {r.doc_id: r.text.strip() for r in docs} and max(map(len, got.values())) > 300
    assert max(len(r.text) for r in QUERIES["preferences_ranked"](spark, str(DATA)).collect()) > 12
    assert all(r.dropped == 0 for r in QUERIES["digest_prompts"](spark, str(DATA)).collect())
