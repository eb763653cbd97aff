import math
import os

import duckdb
import pytest

from granary.plans import checked  # noqa: F401  registers its queries
from granary.plans.queries import Q, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 5) + 0.0 if isinstance(v, float) and math.isfinite(v) else v


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


def test_every_query_has_sql():
    assert set(Q) == set(SQL)


@pytest.mark.parametrize("name", sorted(Q))
def test_query_matches_sql(spark, con, sf, name):
    df = Q[name](spark, sf)
    cols = sorted(df.columns)
    rel = con.sql(SQL[name])
    assert sorted(rel.columns) == cols
    want = rel.select(*[f'"{c}"' for c in cols]).fetchall()
    got = [tuple(r) for r in df.select(*cols).collect()]
    a, b = ordered(got), ordered(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(u == pytest.approx(v, abs=2e-5) if isinstance(u, float) else u == v for u, v in zip(x, y, strict=True)), (x, y)


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
