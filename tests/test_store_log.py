"""The store's log: replay and checkpoints, statistics, clustering, writers at the same time, changes, views."""

import datetime as dt
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace.operators import merge, views
from millrace.plans.queries import QUERIES
from millrace.sources import store as stores
from millrace.sources.store import Conflict, TableStore, apply_changes, clustered

SCHEMA = "k long, v string, n long"


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, f"file://{tmp_path}/t/data/lake")  # a root that looks like a table's folder


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def some(spark, first, last, files=2):
    return spark.range(first, last).selectExpr("id AS k", "string(id) AS v", "id % 10 AS n").repartitionByRange(files, "k")


def test_replays_agree(spark, store, monkeypatch):
    monkeypatch.setattr(stores, "CHECKPOINT_EVERY", 4)
    rng, model, history = random.Random(1), {}, []
    store.ensure("t", SCHEMA)
    for i in range(14):
        kind = rng.choice(["append", "append", "delete", "update", "merge", "restore"])
        if kind == "append":
            store.append("t", some(spark, 100 * i, 100 * i + 20))
            model.update({k: (str(k), k % 10) for k in range(100 * i, 100 * i + 20)})
        elif kind == "delete":
            store.delete("t", F.col("n") == i % 10)
            model = {k: v for k, v in model.items() if v[1] != i % 10}
        elif kind == "update":
            store.update("t", {"v": F.lit("u")}, F.col("k") % 7 == i % 7)
            model = {k: ("u", v[1]) if k % 7 == i % 7 else v for k, v in model.items()}
        elif kind == "merge":
            keys = rng.sample(range(2000, 2030), 4) + rng.sample(range(100 * i), min(5, 100 * i))  # of no later append
            store.merge("t", spark.createDataFrame([(k, "m", i) for k in keys], SCHEMA), ["k"], merge.upsert())
            model.update({k: ("m", i) for k in keys})
        else:
            old = rng.randrange(len(history) + 1)
            store.restore("t", old)
            model = dict(history[old - 1]) if old else {}
        history.append(dict(model))
    assert store._listing("t")[1] == [4, 8, 12], "checkpoints"
    for number in (3, 7, 11, 14):
        whole = store.replay("t", number)
        assert rows(store.read("t", number)) == sorted(((k, *v) for k, v in history[number - 1].items()), key=str)
        assert {r["path"] for r in whole.collect()} == set(store.paths("t", number))
        assert sum(r["rows"] for r in whole.collect()) == len(history[number - 1])
    assert [r["version"] for r in store.history("t").collect()] == list(range(14, -1, -1))


def test_a_commit_grows_with_what_it_changes(spark, store):
    store.overwrite("t", some(spark, 0, 400, 40))
    store.append("t", some(spark, 400, 410, 1))
    store.delete("t", F.col("k") == 5)
    assert [len(store._lines("t", n)) for n in (0, 1, 2)] == [41, 2, 3]


def test_ranges_skip_files_and_lose_no_row(spark, store):
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 10).cast("int"))
    df = spark.range(1000).select(F.col("id").alias("k"), day.alias("day"), day.cast("timestamp").alias("at"), F.concat(F.lit("x" * 40), F.lpad(F.col("id").cast("string"), 5, "0")).alias("long"), (F.col("id") / 3).alias("d"), F.when(F.col("id") < 500, F.col("id")).alias("half"))
    store.overwrite("t", df.repartitionByRange(10, "k"))
    for between in ({"k": (105, 110)}, {"day": (dt.date(2020, 1, 5), dt.date(2020, 1, 6))}, {"at": (dt.datetime(2020, 2, 1), None)}, {"long": ("x" * 40 + "00500", None)}, {"d": (None, 10.0)}, {"half": (None, None)}, {"half": (100, None), "k": (None, 300)}, {"k": (5000, None)}):
        want = df
        for c, (low, high) in between.items():
            want = want.where(F.col(c).isNotNull())
            want = want if low is None else want.where(F.col(c) >= F.lit(low))
            want = want if high is None else want.where(F.col(c) <= F.lit(high))
        assert rows(store.read("t", between=between)) == rows(want)
        found = store.pruning("t", between)
        assert found["files"] == 10 and (found["files_skipped"] >= 3 or "long" in between)
    assert store.pruning("t", {"k": (105, 110)})["files_skipped"] >= 8
    assert len(store.read("t", between={"k": (105, 110)}).inputFiles()) <= 2


def test_optimize_takes_what_is_not_clustered(spark, store):
    own = some(spark, 0, 20000)
    store.overwrite("t", clustered(own.where("k % 20 <> 0"), ["k"], 20), layout={"clustered_by": ["k"]})
    store.append("t", own.where("k % 20 = 0"))
    report = store.optimize("t", cluster_by=["k"], target_bytes=20000)
    assert report["files_rewritten"] == 2 and report["bytes_rewritten"] < 0.12 * report["bytes_before"]
    assert rows(store.read("t")) == rows(own)
    assert store.optimize("t", cluster_by=["k"], target_bytes=20000)["files_rewritten"] == 0
    for i in range(6):
        store.append("t", own.where(f"k % 100 = {i}"))
        store.optimize("t", cluster_by=["k"], target_bytes=1 << 20)
    assert store.pruning("t", {"k": (700, 701)})["files"] - store.pruning("t", {"k": (700, 701)})["files_skipped"] <= stores.OVERLAPS + 2
    assert store.read("t").count() == 20000 + 1200


class Between(TableStore):
    """Does something else once, just before it commits."""

    def __init__(self, spark, root, act):
        super().__init__(spark, root)
        self.act = act

    def commit(self, *given):
        act, self.act = self.act, None
        if act:
            act()
        return super().commit(*given)


@pytest.mark.parametrize("seed", range(3))
def test_writers_at_the_same_time(spark, tmp_path, seed):
    other = TableStore(spark, f"file://{tmp_path}/s")
    def put(m, new, update):
        keys = {r[0] for r in m}
        return [next((x for x in new if x[0] == r[0]), r) if update else r for r in m] + [x for x in new if x[0] not in keys]

    batch = lambda v: [(10, v, 1), (55, v, 1)]
    base, more, few = ([(k, str(k), k % 10) for k in range(*span)] for span in ((0, 40), (50, 60), (0, 3)))
    acts = {
        "append": (lambda s: s.append("t", some(spark, 50, 60, 1)), lambda m: m + more),
        "delete": (lambda s: s.delete("t", F.col("k").between(5, 12)), lambda m: [r for r in m if not 5 <= r[0] <= 12]),
        "far": (lambda s: s.update("t", {"v": F.lit("far")}, F.col("k") >= 38), lambda m: [(r[0], "far", r[2]) if r[0] >= 38 else r for r in m]),
        "merge": (lambda s: s.merge("t", spark.createDataFrame(batch("m"), SCHEMA), ["k"], merge.upsert()), lambda m: put(m, batch("m"), True)),
        "insert": (lambda s: s.merge("t", spark.createDataFrame(batch("i"), SCHEMA), ["k"], merge.insert_only()), lambda m: put(m, batch("i"), False)),
        "optimize": (lambda s: s.optimize("t", zorder_by=["n"]), lambda m: m),
        "overwrite": (lambda s: s.overwrite("t", some(spark, 0, 3, 1)), lambda m: few),
    }
    rng = random.Random(seed)
    for one, two in [(rng.choice(list(acts)), rng.choice(list(acts))) for _ in range(5)]:
        other.overwrite("t", some(spark, 0, 40, 8))
        first = Between(spark, other.root, lambda two=two: acts[two][0](other))
        f, g = acts[one][1], acts[two][1]
        try:
            acts[one][0](first)
            orders = [f(g(base)), g(f(base))]
        except Conflict:
            orders = [g(base)]
        assert rows(other.read("t").select("k", "v", "n")) in [sorted(o, key=str) for o in orders], (one, two)


def test_appends_commute(spark, store):
    store.overwrite("t", some(spark, 0, 10))
    first = Between(spark, store.root, lambda: store.append("t", some(spark, 10, 20).withColumn("more", F.lit(1)), merge_schema=True))
    first.append("t", some(spark, 20, 30))
    assert store.read("t").count() == 30 and store.read("t").columns == ["k", "v", "n", "more"] and store.version("t").number == 2
    first.act = lambda: store.delete("t", F.col("k") < 5)
    first.update("t", {"v": F.lit("z")}, F.col("k") < 3)  # tried again on what is left
    assert store.read("t").where("v = 'z'").count() == 0 and store.read("t").count() == 25


def test_types_are_never_narrowed(spark, store):
    store.overwrite("t", spark.createDataFrame([(1, 2, Decimal("1.50"))], "i int, l long, m decimal(10,2)"))
    with pytest.raises(ValueError, match="doesn't hold"):
        store.append("t", spark.createDataFrame([(1.9,)], "i double"))
    with pytest.raises(ValueError, match="doesn't hold"):
        store.append("t", spark.createDataFrame([(1 << 40,)], "i long"))
    with pytest.raises(ValueError, match="doesn't hold"):
        store.append("t", spark.createDataFrame([(1.5,)], "l double"), merge_schema=True)
    store.append("t", spark.createDataFrame([(7,)], "l int"))
    store.append("t", spark.createDataFrame([(1 << 40, Decimal("0.125"))], "i long, m decimal(20,3)"), merge_schema=True)
    assert rows(store.read("t")) == sorted([(1, 2, Decimal("1.500")), (None, 7, None), (1 << 40, None, Decimal("0.125"))], key=str)
    assert store.read("t").dtypes == [("i", "bigint"), ("l", "bigint"), ("m", "decimal(20,3)")]
    with pytest.raises(ValueError, match="doesn't hold"):
        store.merge("t", spark.createDataFrame([(1, 2.5)], "i long, l double"), ["i"], merge.upsert())


def test_changes_lead_from_one_version_to_another(spark, store):
    store.overwrite("t", some(spark, 0, 60, 6))
    store.append("t", spark.createDataFrame([(7, "7", 7), (7, "7", 7), (None, None, None)], SCHEMA))  # repeats and nulls
    store.merge("t", spark.createDataFrame([(3, "new", 3), (900, "x", 0), (20, "20", 0)], SCHEMA), ["k"], merge.upsert())
    store.delete("t", F.col("k").between(40, 44) | F.col("k").isNull())
    store.append("t", spark.createDataFrame([(1000, "y", 1, 2.5)], SCHEMA + ", d double"), merge_schema=True)
    store.optimize("t", zorder_by=["k"])
    last = store.version("t").number
    for since, until in [(0, last), (1, 3), (2, 2), (3, last), (last, 0), (0, 1)]:
        feed = store.changes("t", since, until, on=["k"])
        before = store.read("t", since)
        for c in store.read("t", until).columns:
            before = before if c in before.columns else before.withColumn(c, F.lit(None).cast("double"))
        columns = store.read("t", until).columns
        assert rows(apply_changes(before.select(*columns), feed.select(*columns, "_change"))) == rows(store.read("t", until)), (since, until)
    kinds = {r["_change"]: r["n"] for r in store.changes("t", 1, 3, on=["k"]).groupBy("_change").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"insert": 1, "delete": 6, "update_before": 1, "update_after": 1}
    with pytest.raises(Exception, match="isn't there"):
        apply_changes(store.read("t", 0), store.changes("t", 0, 3).where("_change = 'insert'").withColumn("_change", F.lit("delete"))).collect()


def test_incremental_view_equals_its_query(spark, store):
    store.overwrite("t", some(spark, 0, 100, 10).withColumn("g", F.when(F.col("k") % 5 > 0, F.concat(F.lit("g"), F.col("k") % 5))))
    view = views.Incremental(store, "v", "t", ("g",), {"n2": F.col("n").cast("decimal(18,4)") / 4, "k": F.col("k")}, F.col("k") < 2000)

    def full():
        r = store.read("t").where("k < 2000")
        return r.groupBy("g").agg(F.count("*").alias("n"), F.sum((F.col("n").cast("decimal(18,4)") / 4).cast("decimal(24,4)")).alias("n2"), F.sum("k").alias("k"))

    def check():
        found = view.refresh()
        got, want = view.read().select("g", "n", "n2", F.col("k").cast("long")), full().select("g", "n", "n2", "k")
        assert sorted(map(str, map(tuple, got.select("g", "n", F.col("n2").cast("double"), F.col("k").cast("long")).collect()))) == sorted(map(str, map(tuple, want.select("g", "n", F.col("n2").cast("double"), "k").collect())))
        return found

    assert check() == {"since": None, "until": 0, "files_read": 10}
    store.append("t", spark.createDataFrame([(500, "x", None, "new"), (501, "y", 2, None), (5000, "z", 2, "out")], SCHEMA + ", g string"))
    assert check()["files_read"] <= 3
    store.delete("t", F.col("g") == "g1")
    store.update("t", {"n": F.col("n") + 1, "g": F.lit("g2")}, F.col("k").between(10, 14))
    assert check()["since"] == 1
    assert check()["files_read"] == 0
    store.optimize("t", zorder_by=["k"])
    before = store.version("v").number
    check()
    assert rows(store.read("v")) == rows(store.read("v", before)), "moved rows change nothing"
    store.vacuum("t", hours=-1, dry_run=False)
    store.append("t", some(spark, 600, 610).withColumn("g", F.lit("late")))
    check()


def test_files_wanted_compacts_whatever_the_size(spark, store):
    store.overwrite("t", some(spark, 0, 4000, files=5))
    assert store.optimize("t", target_bytes=3000)["files_after"] > 1
    assert store.optimize("t", target_bytes=3000, files_wanted=1)["files_after"] == 1
    assert rows(store.read("t")) == rows(some(spark, 0, 4000))


def test_files_are_described_without_sorting_their_rows(spark, tmp_path):
    folder = f"file://{tmp_path}/strings"
    some(spark, 0, 3000, files=3).write.parquet(folder)
    there = spark.read.schema(SCHEMA).parquet(folder)
    found = stores._described(there, list(there.schema))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" in plan and "Sort" not in plan
    got = found.select("bytes", "rows", "c0.min", "c0.max", "c1.nulls").collect()
    assert len(got) == 3 and sum(r["rows"] for r in got) == 3000 and all(r["bytes"] > 0 and r["nulls"] == 0 for r in got)
    assert {int(r["min"]) for r in got} >= {0} and max(int(r["max"]) for r in got) == 2999


def plans_of(spark, name):
    def executions():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        found = spark._jsparkSession.sharedState().statusStore().executionsList()
        return {e.executionId(): e for e in (found.apply(i) for i in range(found.size()))}

    before = executions()
    QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    return [e.physicalPlanDescription() for i, e in executions().items() if i not in before]


@pytest.mark.parametrize("name", ["nested_tables", "table_detail", "stream_events"])
def test_tables_of_a_query_are_described_without_sorting(spark, name):
    plans = plans_of(spark, name)
    assert any("ObjectHashAggregate" in p and "file_path" in p for p in plans) and not any("SortAggregate" in p for p in plans)


def test_events_are_dealt_by_key_as_round_robin_sorts_them_first(spark):
    dealt = [p for p in plans_of(spark, "stream_events") if "REPARTITION_BY_NUM" in p]
    assert dealt and not any("RoundRobinPartitioning" in p for p in dealt)


def test_numbers_alone_are_described_by_plain_hashing(spark, tmp_path):
    folder = f"file://{tmp_path}/numbers"
    spark.range(3000).selectExpr("id AS k", "IF(id % 3 = 0, NULL, id / 7) AS x", "timestamp_seconds(id) AS at", "CAST(id AS DECIMAL(18,4)) AS m").repartition(3).write.parquet(folder)
    there = spark.read.parquet(folder)
    found = stores._described(there, list(there.schema))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "ObjectHashAggregate" not in plan and "Sort" not in plan
    got = found.select("bytes", "rows", "c0.min", "c2.max", F.col("c1.nulls").alias("nulls")).collect()
    assert sum(r["rows"] for r in got) == 3000 and sum(r["nulls"] for r in got) == 1000 and all(r["bytes"] > 0 for r in got)
    assert min(int(r["min"]) for r in got) == 0 and max(int(r["max"]) for r in got) == 2999 * 10**6


@pytest.mark.parametrize("by", [(), ("part",)])
def test_refused_rows_are_not_described(spark, store, monkeypatch, by):
    seen, described = [], []
    monkeypatch.setattr(stores, "_described", lambda *a, own=stores._described: described.append(1) or own(*a))

    def refuse(found):
        seen.append(rows(found.select(*some(spark, 0, 1).columns)))
        raise ValueError("refused")

    with pytest.raises(ValueError, match="refused"):
        store.overwrite("t", some(spark, 0, 100).withColumn("part", F.col("k") % 2), partition_by=by, check=refuse)
    assert seen == [rows(some(spark, 0, 100))] and not described and not store.exists("t")
    store.overwrite("t", some(spark, 0, 0).withColumn("part", F.col("k") % 2), partition_by=by, check=lambda found: seen.append(found.count()))
    assert seen[1] == 0 and store.read("t").count() == 0


def test_zorder_of_a_partitioned_table_sorts_small_ranges(spark, store, monkeypatch):
    monkeypatch.setattr(stores, "SORTED", 4000)
    rows_in = some(spark, 0, 4000).withColumn("part", F.col("k") % 2)
    store.overwrite("t", rows_in, partition_by=["part"])
    size = sum(r["bytes"] for r in store.files("t").collect())
    store.optimize("t", zorder_by=["k"])
    tasks = {re.search("part-([0-9]+)", r["path"])[1] for r in store.files("t").collect()}
    assert len(tasks) >= min(4, size // 8000) > 1 and rows(store.read("t").select(*rows_in.columns)) == rows(rows_in)
