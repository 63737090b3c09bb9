"""The driver contract; queries against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(value):
    return None if isinstance(value, float) and math.isnan(value) else round(value, 5) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, oracle, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    assert len(df.columns) == len(set(df.columns))
    sql = entry.oracle_sql().get(name)
    if sql:
        cursor = oracle.execute(sql)
        names = [c[0] for c in cursor.description]
        assert sorted(names) == sorted(df.columns)
        want = sorted(repr([norm(r[names.index(c)]) for c in sorted(names)]) for r in cursor.fetchall())
        assert sorted(repr([norm(r[c]) for c in sorted(names)]) for r in rows) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_a_last_part_as_long_as_a_narrowed_one(spark, tmp_path):
    """A third part of 116 characters is shown whole; only a narrowed one has a digest."""
    rows = [(1, "x" * 516), (2, "y" * 600), (3, "z" * 515)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["prompt_by_characters"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()['prompt_by_characters']})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())
