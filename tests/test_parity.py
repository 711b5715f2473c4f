"""Each query against its SQL on the smallest tables."""

import duckdb
import pytest

from convoq import registry

SF = "/root/testdata/sf0.001"
KINDS = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}
TABLES = ("conversations", "events", "embeddings", "documents", "pages", "benchmark", "labels")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canonical(rows):
    return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = canonical(tuple(r) for r in df.select(*[df[c] for c in cols]).collect())
    if name not in registry.ORACLE_SQL:
        assert got
        return
    sql = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(sql.columns) == cols
    kinds = dict(zip(sql.columns, map(str, sql.types), strict=True))
    assert {c: KINDS[k] for c, k in df.dtypes} == kinds
    assert got == canonical(sql.select(",".join(f'"{c}"' for c in cols)).fetchall())
    assert got
