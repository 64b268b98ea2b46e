from decimal import Decimal

import duckdb
import pytest
from metaloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events pages".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(row):
    return tuple(float(v) if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) else v for v in row)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_rows_equal_the_sql(spark, oracle, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = sorted((plain(r[c] for c in columns) for r in df.collect()), key=str)
    q = oracle.execute(catalogue.ORACLES[name])
    names = [c[0] for c in q.description]
    assert sorted(names) == columns
    assert found == sorted((plain(r[names.index(c)] for c in columns) for r in q.fetchall()), key=str)
    assert found
