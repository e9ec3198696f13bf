"""Joins by time, sketches, the graph of models and dimensions that stay, against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import merge, sketches, temporal
from millrace.plans.models import Graph, Model, not_null, unique
from millrace.plans.runner import Params, Pipeline
from millrace.sources.retail import retail
from millrace.sources.store import TableStore

TINY = "/root/testdata/sf0.001"


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, f"file://{tmp_path}/store")


def moments(n, seed, users):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    return [(i, rng.choice(users), None if rng.random() < 0.03 else start + dt.timedelta(seconds=rng.choice([0, 3600, 86400, 86399, rng.randrange(10 * 86400)]))) for i in range(n)]


USERS = [1, 1, 1, 1, 2, 3, None]


@pytest.mark.parametrize("bucket", [1, 3600, 86400, 10**9])
def test_asof_is_the_latest_before(spark, bucket):
    left, right = moments(200, 1, USERS), moments(120, 2, USERS)
    a, b = (spark.createDataFrame(r, f"{n} long, user long, ts timestamp") for r, n in ((left, "id"), (right, "rid")))
    got = {r["id"]: (r["at"], r["rid"]) for r in temporal.asof_join(a, b.select("rid", "user", F.col("ts").alias("at")), "user", "ts", ("at", "rid"), "at", bucket).collect()}
    for i, user, ts in left:
        met = [(at, rid) for rid, u, at in right if u is not None and u == user and at is not None and ts is not None and at <= ts]
        assert got[i] == (max(met) if met else (None, None)), i
    assert len(got) == 200
    assert temporal.asof_join(a.limit(0), b.withColumnRenamed("ts", "at"), "user", "ts", ("rid",), "at").count() == 0


@pytest.mark.parametrize("before,after", [(0, 0), (0, 3600), (7200, 100), (90000, 90000)])
def test_interval_pairs_are_all_pairs(spark, before, after):
    left, right = moments(150, 3, USERS), moments(150, 4, USERS)
    a, b = (spark.createDataFrame(r, f"{n} long, user long, {n}_at timestamp") for r, n in ((left, "id"), (right, "rid")))
    got = sorted((r["id"], r["rid"]) for r in temporal.interval_join(a, b, "user", "id_at", "rid_at", before, after).collect())
    want = sorted((i, k) for i, u, t in left for k, v, s in right if None not in (u, v, t, s) and u == v and -before <= (s - t).total_seconds() <= after)
    assert got == want


def test_joins_by_time_have_no_nested_loop(spark):
    a = spark.range(10).selectExpr("id", "id % 2 AS user", "timestamp_seconds(id) AS at")
    b = a.selectExpr("id AS rid", "user", "at AS rid_at")
    for df in (temporal.interval_join(a, b, "user", "at", "rid_at", 1, 1), temporal.asof_join(a, b, "user", "at", ("rid",), "rid_at")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_spans_of_sketches(spark):
    rows = spark.range(40_000).selectExpr("date_add(date'2024-01-01', int(id % 20)) AS ts", "id % 7001 AS k", "double(id) AS v").repartition(6)
    found = sketches.span(sketches.daily_sketches(rows, "ts", "k", "v"), "2024-01-03", "2024-01-12").first()
    exact = rows.where("ts BETWEEN date'2024-01-03' AND date'2024-01-12'").agg(F.count("*"), F.count_distinct("k")).first()
    assert found["n"] == exact[0] and abs(found["distinct_keys"] - exact[1]) <= sketches.distinct_error() * exact[1]
    assert abs(found["q50"] - 20_000) < 800 and abs(found["q95"] - 38_000) < 800


def test_models_run_when_their_inputs_change(spark, store):
    store.overwrite("a", spark.createDataFrame([(1, 2), (2, 3)], "k int, n int"))
    store.overwrite("b", spark.createDataFrame([(1, "x")], "k int, s string"))
    models = [
        Model("top", "SELECT sum(n) AS n FROM {joined}", table=True),
        Model("view_a", "SELECT k, n FROM {a} WHERE n > 0"),
        Model("joined", "SELECT k, n, s FROM {view_a} LEFT JOIN {b} USING (k)", table=True, tests={**unique("k"), **not_null("k")}),
        Model("only_b", "SELECT count(*) AS rows FROM {b}", table=True),
    ]
    graph = Graph(store, models)
    assert graph.order.index("view_a") < graph.order.index("joined") < graph.order.index("top")
    assert set(graph.run().values()) == {"built"}
    assert set(graph.run().values()) == {"fresh"}
    store.append("a", spark.createDataFrame([(3, 10)], "k int, n int"))
    assert graph.run() == {"joined": "built", "top": "built", "only_b": "fresh"} and graph.read("top").first()[0] == 15
    store.append("b", spark.createDataFrame([(1, "again")], "k int, s string"))
    assert graph.run() == {"joined": "failed: joined: k unique", "top": "held back", "only_b": "built"}
    assert graph.read("joined").count() == 3, "a table whose test fails stays as it was"
    store.delete("b", F.col("s") == "again")
    assert graph.run() == {"joined": "built", "top": "built", "only_b": "built"}
    changed = Graph(store, [*models[:-1], Model("only_b", "SELECT count(*) + 1 AS rows FROM {b}", table=True)])
    assert changed.run() == {"joined": "fresh", "top": "fresh", "only_b": "built"}
    with pytest.raises(ValueError):
        Graph(store, [Model("x", "SELECT * FROM {y}"), Model("y", "SELECT * FROM {x}")])


def test_changes_listed_twice_are_refused(spark):
    customers = spark.createDataFrame([(1, "a", "s"), (2, "b", "s")], "customer_id long, name string, state string")
    dim = merge.first_versions(customers, spark.createDataFrame([(3,)], "customer_id long"))
    twice = spark.createDataFrame([(1, "x"), (1, "y")], "customer_id long, name string")
    with pytest.raises(Exception, match="listed twice"):
        merge.next_versions(dim, twice, "2020-01-01").collect()
    after = merge.refresh_versions(dim, spark.createDataFrame([(1, "a", "t"), (2, "b", "s"), (3, "now known", "s"), (4, "new", "s")], "customer_id long, name string, state string"), spark.createDataFrame([(9,)], "customer_id long"), "2020-01-01")
    got = sorted((r["customer_id"], r["version"], r["is_current"], r["customer_sk"], r["name"]) for r in after.collect())
    assert got == [(1, 1, False, 1, "a"), (1, 2, True, 6, "a"), (2, 1, True, 2, "b"), (3, 1, False, 3, "UNKNOWN"), (3, 2, True, 7, "now known"), (4, 1, True, 4, "new"), (9, 1, True, 5, "UNKNOWN")]


def test_the_pipeline_keeps_versions_and_keys(spark, store):
    source = retail(spark, TINY)
    Pipeline(store, source, Params(as_of="2001-01-01")).dimensional()
    before = {r["customer_id"]: r["customer_sk"] for r in store.read("gold/dim_customers").collect()}
    moved = retail(spark, TINY)
    moved.__dict__["customers"] = source.customers.withColumn("state", F.when(F.col("customer_id") < 4, F.lit("ELSEWHERE")).otherwise(F.col("state")))
    for _ in range(2):
        report = Pipeline(store, moved, Params(as_of="2002-01-01")).dimensional()
        assert report["check"]["is_valid"]
    rows = store.read("gold/dim_customers").collect()
    assert {r["customer_id"]: r["customer_sk"] for r in rows if r["version"] == 1} == before
    assert sorted(r["customer_id"] for r in rows if r["version"] == 2 and r["is_current"]) == [0, 1, 2, 3] and len(rows) == len(before) + 4


def test_orders_that_pass_the_gate_are_not_sorted_again(spark, store):
    source = retail(spark, TINY)
    first = source.orders.orderBy("order_id").limit(5)
    own = retail(spark, TINY)
    own.__dict__["orders"] = source.orders.unionByName(first).unionByName(first.withColumn("order_id", F.lit(None).cast("long"))).unionByName(first.limit(1).withColumns({"order_id": F.lit(-1).cast("long"), "customer_id": F.lit(-1).cast("long")}))
    task = Pipeline(store, own, Params(as_of="2001-01-01"))
    got = task.silver_orders()
    want = source.orders.join(first.select("order_id"), "order_id", "left_anti")
    key = lambda df: sorted(map(str, df.select(*source.orders.columns).collect()))
    assert key(got) == key(want)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_delivered_lines_hash_orders_within_tasks(spark, store):
    from millrace.plans.models import retail_models

    source = retail(spark, TINY)
    store.overwrite("orders", source.orders)
    store.overwrite("items", source.items)
    plan = Graph(store, retail_models())._build(next(m for m in retail_models() if m.name == "delivered_lines"))._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
