"""Every query against its SQL on the smallest tables, whole."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

from palimpsest.plans import registry  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    rows = df.collect()
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    found = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    mine = sorted(([r[c] for c in order] for r in rows), key=repr)
    theirs = sorted(([r[names.index(c)] for c in order] for r in found.fetchall()), key=repr)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        assert [float(x) if isinstance(x, float) else x for x in a] == pytest.approx([float(y) if type(y).__name__ == "Decimal" else y for y in b]) if any(isinstance(x, float) for x in a) else a == b
