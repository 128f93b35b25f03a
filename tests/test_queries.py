"""Every registered query of the point-cloud operators against its SQL."""

import duckdb
import pytest

from nubila.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tiny}/{t}.parquet')")
    return con


def same(value):
    return round(value, 5) + 0.0 if isinstance(value, float) else value


def rows_of(rows, columns):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(same(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, v) for v in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, tiny, name):
    df = QUERIES[name](spark, tiny)
    rows = [tuple(r) for r in df.collect()]
    if name in SQL:
        found = sql.execute(SQL[name])
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows_of(rows, df.columns) == rows_of(found.fetchall(), columns)
    else:
        assert rows


def test_names_without_the_training_subpackage():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
