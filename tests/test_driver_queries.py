"""Every query of the library against its SQL on the smallest tables."""

from decimal import Decimal

import duckdb
import pytest

from folioflow.plans import blob_queries, campaign_queries, guarded_queries, more_queries, norm_queries  # noqa: F401
from folioflow.plans.driver_queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)):
        return round(float(v), 6)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    out = QUERIES[name](spark, DATA)
    cols = sorted(out.columns)
    rows = sorted((tuple(plain(v) for v in r) for r in out.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
    if name not in ORACLE_SQL:
        assert rows
        return
    found = sql.execute(ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert len(rows) == len(want)
    assert rows == want
