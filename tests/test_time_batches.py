"""Batches since a mark against SQL: seconds are rounded, not cut off."""

import datetime as dt

import duckdb
from pyspark.sql import functions as F

from millrace.operators.incremental import batch_since


def test_seconds_round_as_in_sql(spark):
    micros = [-1_500_000, -500_001, -1, 0, 1, 499_999, 500_000, 500_001, 999_999, 1_000_000, 1_500_000]
    start = dt.datetime(2024, 1, 19, 12)
    times = [start + dt.timedelta(microseconds=m) for m in micros] + [start + dt.timedelta(seconds=1, microseconds=500_000)]
    for mark in (dt.datetime(2024, 1, 20, 12), dt.datetime(2024, 1, 20, 12, 0, 0, 500_000), dt.datetime(2024, 1, 20, 12, 0, 0, 700_000)):
        rows = spark.createDataFrame([(i, str(t)) for i, t in enumerate(times)], "i long, t string").select("i", F.col("t").cast("timestamp").alias("t"))
        got = sorted(r["i"] for r in batch_since(rows, "t", mark, 24).collect())
        duck = duckdb.connect()
        duck.execute("CREATE TABLE e (i BIGINT, t TIMESTAMP)")
        duck.executemany("INSERT INTO e VALUES (?, ?)", list(enumerate(times)))
        want = sorted(i for (i,) in duck.execute(f"SELECT i FROM e WHERE epoch(t)::BIGINT > epoch(TIMESTAMP '{mark}')::BIGINT - 24 * 3600").fetchall())
        assert got == want
