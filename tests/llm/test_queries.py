"""The subpackage's queries against their SQL."""

import os

import duckdb
import pytest

from kgaudit.llm import catalogue

SF_DIR = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(columns).collect()), key=repr)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    assert got == sorted(want, key=repr)


def test_pages_are_segmented(spark, tmp_path):
    from pyspark.sql import functions as F

    from kgaudit.llm import common, warc

    warc.write_archives(common.table(spark, SF_DIR, "pages"), str(tmp_path / "warc"))
    pieces = warc.segments(spark, str(tmp_path / "warc"))
    parts = {r["record"]: r["n"] for r in pieces.filter("block is not null").groupBy("record").agg(F.count("*").alias("n")).collect()}
    assert parts and min(parts.values()) >= 2
    found = warc.read_archives(spark, str(tmp_path / "warc")).collect()
    assert all(r["complete"] and r["sha1"] == r["digest"] for r in found if r["kind"] == "response")
