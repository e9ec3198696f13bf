"""The registered queries themselves: those with SQL against DuckDB, over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from millrace.llm.queries import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(x):
    if x is None:
        return ""
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.7g}"
    return str(x)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_its_sql(spark, name):
    duck = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    df = QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    found = duck.execute(ORACLES[name])
    there = [c[0] for c in found.description]
    assert sorted(there) == names
    assert got == sorted(tuple(plain(r[there.index(c)]) for c in names) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_a_row_for_each_document(spark, name):
    df = QUERIES[name](spark, FOLDER)
    ids = {r[0] for r in df.select("doc_id").distinct().collect()}
    assert ids == {r[0] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()}
