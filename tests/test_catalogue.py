"""Every query of the catalogue against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from gneiss.plans import catalogue, planted, projects  # noqa: F401  these add their queries to the catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: "null" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(columns), sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_same_rows(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    want = duck.execute(catalogue.ORACLES[name])
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon([d[0] for d in want.description], want.fetchall())


def test_flagship(spark):
    rows = catalogue.hot_churn(spark, SF).collect()
    assert len(rows) == 25 and rows == sorted(rows, key=lambda r: (-r.heat, r.id))
