import duckdb
import pytest
from metaloom.llm import registry

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_rows_equal_the_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    q = con.execute(registry.ORACLES[name])
    names = [c[0] for c in q.description]
    assert sorted(names) == columns
    wanted = sorted((tuple(r[names.index(c)] for c in columns) for r in q.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == wanted and wanted
