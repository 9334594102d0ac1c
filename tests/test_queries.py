"""Every registered query with SQL against DuckDB on the smallest tables; the others run and return rows."""

from __future__ import annotations

import datetime
import math

import duckdb
import pytest

from loomwork import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 9) + 0.0)
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return repr(x)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted([norm(r[c]) for c in cols] for r in df.collect())
    want = con.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert got == sorted([norm(r[i]) for i in at] for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_returns_rows(spark, name):
    if name in ("sample_rows",):
        assert catalog.QUERIES[name](spark, SF).count() < 1000
    else:
        assert catalog.QUERIES[name](spark, SF).count() > 0


def test_similar_rows_compares_the_rounded_cosine(spark, tmp_path):
    """Pairs at 0.5999997 round to 0.6 and count; pairs at 0.5999993 don't."""
    for t in TABLES[:6]:
        duckdb.sql(f"copy (from '{SF}/{t}.parquet') to '{tmp_path}/{t}.parquet'")
    order, values = f"select o_orderkey from '{SF}/orders.parquet' order by 1", {0: [1.0], 1: [0.5999997, math.sqrt(1 - 0.5999997**2)], 2: [0.5999993, 0.0, math.sqrt(1 - 0.5999993**2)]}
    keys = [k for (k,) in duckdb.sql(order).fetchall()[:3]]
    cells = ", ".join(f"({keys[o]}, {p}, {q!r})" for o, own in values.items() for p, q in enumerate(own) if q)
    duckdb.sql(f"copy (select l.* replace (v.o AS l_orderkey, v.p AS l_partkey, v.q AS l_quantity) from (from '{SF}/lineitem.parquet' limit 1) l, (values {cells}) v(o, p, q)) to '{tmp_path}/lineitem.parquet'")
    con = duckdb.connect()
    for t in TABLES[:7]:
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    want = con.sql(catalog.ORACLES["join_similar_rows"]).fetchall()
    assert want == [(keys[0], keys[1], 0.6)]
    assert [tuple(r) for r in catalog.QUERIES["join_similar_rows"](spark, str(tmp_path)).select("a", "b", "cosine").collect()] == want
