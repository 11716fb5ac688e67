"""Every registered query with SQL against DuckDB over the smallest tables, one for rows; test_queries has the others."""

from collections import Counter

import duckdb
import pytest

from tessera.plans import catalog

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return out


def plain(v):
    return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql(spark, con, name):
    relation = con.sql(catalog.SQL[name])
    df = catalog.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    assert sorted(relation.columns) == cols
    want = Counter(str(tuple(plain(r[relation.columns.index(c)]) for c in cols)) for r in relation.fetchall())
    assert Counter(str(tuple(plain(r[c]) for c in cols)) for r in df.collect()) == want


@pytest.mark.parametrize("name", ["parsed_records"])
def test_rows(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0
