"""Every registered query with a SQL oracle, on sf0.001, against DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
ORACLES = E.oracle_sql()


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, "nan") if math.isnan(v) else (2, repr(round(v, 9)))
    return (3, str(v))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    srows, scols = sdf.collect(), sdf.columns
    res = duck.execute(ORACLES[name])
    drows, dcols = res.fetchall(), [d[0] for d in res.description]
    assert sorted(scols) == sorted(dcols)
    order = sorted(scols)
    sv = sorted(tuple(_norm(r[scols.index(c)]) for c in order) for r in srows)
    dv = sorted(tuple(_norm(r[dcols.index(c)]) for c in order) for r in drows)
    assert sv == dv
