"""The operators that SQL can express, against DuckDB on the smallest tables, whole."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

from palimpsest.llm import registry  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not here")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "sale_lines"):
        c.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    found = c.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    df = registry.QUERIES[name](spark, DIR)
    assert sorted(names) == sorted(df.columns)
    mine = sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
    assert mine == sorted(found.fetchall(), key=repr)
