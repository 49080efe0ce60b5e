"""Every query of the catalog with SQL is run on the smallest tables and held against DuckDB."""

import duckdb
import pytest

from sinoflow import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: v if v is None or isinstance(v, (str, bool)) else round(float(v), 5) + 0.0
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    own = rows(df.columns, df.collect())
    result = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    other = rows(names, result.fetchall())
    assert len(own) == len(other)
    for a, b in zip(own, other, strict=True):
        # nulls and names are equal, numbers nearly so
        assert [None if isinstance(v, float) else v for v in a] == [None if isinstance(v, float) else v for v in b]
        assert [v for v in a if isinstance(v, float)] == pytest.approx([v for v in b if isinstance(v, float)], rel=1e-6, abs=1e-4, nan_ok=True)
