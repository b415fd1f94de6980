"""Each query against its SQL on the smallest tables; no answer may be empty but where it has to be."""

import duckdb
import pytest

from quillstack import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
EMPTY = {"delete_everything"}


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    return c


def rows(frame, columns):
    return sorted(map(repr, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, tables, small, name):
    got = Q.queries()[name](spark, small).toPandas()
    assert bool(len(got)) != (name in EMPTY)
    want = tables.execute(Q.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)
