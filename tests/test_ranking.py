"""Ranks over whole tables against plain sorting: ties, a value that most rows share, nulls, strings."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import gold, merge, ranking, star
from millrace.sources import shared


def plain_tile(rank, rows, tiles):
    sizes = [rows // tiles + (k < rows % tiles) for k in range(tiles)]
    for k, size in enumerate(sizes):
        if rank <= size:
            return k + 1
        rank -= size


@pytest.mark.parametrize("size", [0, 1, 7, 5000])
def test_ranks_are_those_of_sorting(spark, size):
    rng = random.Random(size)
    ids = rng.sample(range(10 * size + 1), size)
    rows = [(i, rng.choice([None, 1, 1, 1, 1, 1, 2, rng.randrange(1000)]), rng.choice(["b", "a", None, str(rng.random())])) for i in ids]
    df = spark.createDataFrame(rows, "id long, n int, s string").repartition(5)
    got = {r["id"]: r for r in ranking.with_ranks(df, "id", {"up": F.col("n"), "down": -F.col("n"), "text": F.col("s")}).collect()}
    first = lambda x: (x is not None, x)  # noqa: E731  nulls come first
    for name, key in (("up", lambda r: (r[1] is not None, r[1] or 0, r[0])), ("down", lambda r: (r[1] is not None, -(r[1] or 0), r[0])), ("text", lambda r: (r[2] is not None, r[2] or "", r[0]))):
        assert [r[0] for r in sorted(rows, key=key)] == [i for i, _ in sorted(got.items(), key=lambda x: x[1][name])], name
        assert sorted(r[name] for r in got.values()) == list(range(1, size + 1))
    assert all(r["__rows"] == size for r in got.values()) and first(None) < first(0)


def test_a_common_value_is_cut(spark, monkeypatch):
    df = spark.range(20_000).select(F.col("id"), F.when(F.col("id") % 10 < 8, 1).otherwise(F.col("id")).alias("n"))
    seen = []
    monkeypatch.setattr(ranking, "written", lambda rows, label: seen.append(shared.written(rows, label)) or seen[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranking.with_ranks(df, "id", {"a": F.col("n"), "b": -F.col("n")})
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in seen[0].groupBy("range").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 15_000 and sum(sizes) == 40_000


@pytest.mark.parametrize("rows", [0, 1, 4, 5, 6, 23, 25])
def test_tiles(spark, rows):
    df = spark.range(1, rows + 1).select("id", ranking.tile(F.col("id"), F.lit(rows), 5).alias("t"))
    assert [r["t"] for r in df.orderBy("id").collect()] == [plain_tile(k, rows, 5) for k in range(1, rows + 1)]


def test_no_task_sees_all_customers_or_changes(spark):
    dim = spark.range(1, 400).selectExpr("id AS customer_sk", "id AS customer_id", "string(id) AS name", "'X' AS state", "1 AS version", "true AS is_current", "date'2000-01-01' AS valid_from", "date'2001-01-01' AS valid_to")
    changed = merge.next_versions(dim, dim.select("customer_id", F.lit("new").alias("name")), "2002-01-01")
    assert sorted(r["customer_sk"] for r in changed.where("version = 2").collect()) == list(range(400, 799))
    revenue = spark.range(1000).selectExpr("id AS order_id", "id % 77 AS customer_id", "date_add(date'2000-01-01', int(id % 50)) AS order_date", "cast(id AS decimal(18,4)) AS revenue")
    for df in (changed, gold.rfm(revenue), star.key_by_rank(dim, "customer_id")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        lines = [x for x in plan.splitlines() if "SinglePartition" in x]
        assert all("max(order_date" in plan for _ in lines) and len(lines) <= 1, "one row's aggregate at most"
