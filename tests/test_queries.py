"""Every query with SQL against DuckDB over the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no tables here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(str(round(v, 9) if isinstance(v, float) else v) for v in row) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - set(getattr(entry.llm_queries, "ORACLE_SQL", {}))))
def test_query_equals_its_sql(spark, db, name):
    got, want = entry.queries()[name](spark, str(SF)).toPandas(), db.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_near_clone_classes_store_what_they_read_again(spark, monkeypatch):
    names, real = [], entry.own.stored
    monkeypatch.setattr(entry.own, "stored", lambda df, name: names.append((name, "tokens" in df.columns)) or real(df, name))
    entry.queries()["near_clone_classes"](spark, str(SF))
    assert names == [("near", False), ("units", False)]
