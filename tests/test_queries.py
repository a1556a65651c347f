"""Every registered query with SQL is compared with DuckDB on the driver's tables."""

import math

import duckdb
import pytest

from terrajobs import plans

TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, bool):
        return float(v)
    try:
        f = float(v)
    except (TypeError, ValueError):
        return str(v)
    return round(f, 5) + 0.0 if math.isfinite(f) else f


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_matches_sql(spark, duck, sf_dir, name):
    got = plans.QUERIES[name](spark, sf_dir)
    want = duck.sql(plans.ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    expected = sorted((tuple(plain(v) for v in r) for r in want.select(*[f'"{c}"' for c in columns]).fetchall()), key=repr)
    assert rows == expected
