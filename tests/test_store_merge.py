"""The table store, and merges against a model in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import merge
from millrace.sources.store import Commit, Conflict, TableStore

SCHEMA = "k long, v string, n long"


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, f"file://{tmp_path}/store")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def model(target, source, clauses):
    """clauses: functions of (old, new) or new, or None."""
    out = {k: v for k, v in target.items()}
    for k, (v, n, op) in source.items():
        if k in target:
            if clauses["delete"](target[k], (v, n), op):
                del out[k]
            elif clauses["update"](target[k], (v, n), op):
                out[k] = (v, n)
        elif clauses["insert"]((v, n), op):
            out[k] = (v, n)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_merge_is_the_model(spark, seed):
    rng = random.Random(seed)
    value = lambda: (rng.choice([None, "a", "b"]), rng.choice([None, 1, 2]))
    target = {k: value() for k in rng.sample(range(40), 25)}
    source = {k: (*value(), rng.choice(["insert", "update", "delete", "noop"])) for k in rng.sample(range(40), 25)}
    t = spark.createDataFrame([(k, *v) for k, v in target.items()], SCHEMA)
    s = spark.createDataFrame([(k, *v) for k, v in source.items()], SCHEMA + ", cdc_operation string")
    want = model(target, source, {"delete": lambda o, n, op: op == "delete", "update": lambda o, n, op: op == "update", "insert": lambda n, op: op == "insert"})
    assert rows(merge.merge_rows(t, s, ["k"], merge.cdc_clauses(("v", "n")))) == sorted(((k, *v) for k, v in want.items()), key=str)
    want = model(target, source, {"delete": lambda *_: False, "update": lambda o, n, op: o != n, "insert": lambda n, op: True})
    plain = s.drop("cdc_operation")
    assert rows(merge.merge_rows(t, plain, ["k"], merge.upsert_changed(("v", "n")))) == sorted(((k, *v) for k, v in want.items()), key=str)
    assert rows(merge.merge_rows(t, plain, ["k"], merge.insert_only())) == sorted(((k, *v) for k, v in {**{a: b[:2] for a, b in source.items()}, **target}.items()), key=str)


def test_repeated_source_keys_are_refused(spark):
    t = spark.createDataFrame([(1, "a", 1)], SCHEMA)
    s = spark.createDataFrame([(1, "b", 1), (1, "c", 1)], SCHEMA)
    with pytest.raises(Exception, match="several rows"):
        merge.merge_rows(t, s, ["k"], merge.upsert()).collect()
    assert rows(merge.merge_rows(t, spark.createDataFrame([(None, "x", 1)], SCHEMA), ["k"], merge.upsert())) == [(1, "a", 1), (None, "x", 1)]


def test_versions(spark, store):
    store.ensure("t", SCHEMA)
    store.ensure("t", SCHEMA)
    assert store.read("t").count() == 0
    store.append("t", spark.createDataFrame([(1, "a", 1)], SCHEMA))
    store.append("t", spark.createDataFrame([(2, "b", 2)], "k long, v string, extra n long".replace("extra n", "n")))
    with pytest.raises(ValueError):
        store.append("t", spark.createDataFrame([(3, 1.5)], "k long, price double"))
    store.append("t", spark.createDataFrame([(3, 1.5)], "k long, price double"), merge_schema=True)
    assert store.read("t").columns == ["k", "v", "n", "price"] and store.read("t").where("price is null").count() == 2
    store.overwrite("t", store.read("t").where("k > 1"))  # the table it reads
    store.update("t", {"v": F.lit("z")}, F.col("k") == 2)
    store.delete("t", F.col("k") == 3)
    assert [tuple(r) for r in store.read("t").select("k", "v").collect()] == [(2, "z")]
    assert store.read("t", 1).count() == 1 and store.read("t", 3).count() == 3
    store.restore("t", 3)
    assert store.read("t").count() == 3
    assert [r["operation"] for r in store.history("t").collect()][:3] == ["RESTORE", "DELETE", "UPDATE"]
    with pytest.raises(KeyError):
        store.read("t", 99)


def test_two_writers_conflict(spark, store):
    store.overwrite("t", spark.createDataFrame([(1, "a", 1)], SCHEMA))
    base = store.version("t")
    store.append("t", spark.createDataFrame([(2, "a", 1)], SCHEMA))
    with pytest.raises(Conflict):
        store.commit("t", base.number, Commit("LATE", base.schema, {}, []))
    assert store.read("t").count() == 2


def test_maintenance(spark, store):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).cast("string").alias("v"), (F.col("id") % 13).alias("n"))
    store.overwrite("t", df.repartition(10))
    report = store.optimize("t", zorder_by=["k", "n"])
    assert report["files_before"] == 10 and report["files_after"] == 1 and store.detail("t")["clustered_by"] == ["k", "n"]
    assert store.vacuum("t") == [] and len(store.vacuum("t", hours=0)) == 1
    assert len(store.vacuum("t", hours=0, dry_run=False)) == 1 and store.read("t").count() == 1000
    with pytest.raises(KeyError):
        store.read("t", 0)
    store.overwrite("p", df, partition_by=["v"])
    store.append("p", df)
    assert store.read("p").where("v = '3'").count() == 2 * 143 and store.read("p").columns == ["k", "v", "n"]
    store.drop("p")
    assert not store.exists("p")


def test_scd2_repair(spark):
    rows_ = [(1, 1, "a", "s", 1, False, None, None), (2, 1, "a", "s", 2, False, None, None), (3, 2, "b", "s", 1, True, None, None), (4, 2, "b", "s", 2, True, None, None), (5, 3, "c", "s", 1, True, None, None)]
    dim = spark.createDataFrame(rows_, "customer_sk long, customer_id long, name string, state string, version int, is_current boolean, valid_from date, valid_to date")
    fixed = {(r["customer_id"], r["version"]): r["is_current"] for r in merge.one_current(dim).collect()}
    assert fixed == {(1, 1): False, (1, 2): True, (2, 1): False, (2, 2): True, (3, 1): True}
    moved = merge.next_versions(merge.one_current(dim), spark.createDataFrame([(1, "A")], "customer_id long, name string"), "2020-01-01")
    assert merge.version_history(moved, 1).select("version", "name", "is_current").collect()[-1] == (3, "A", True)
    assert merge.next_versions(dim, spark.createDataFrame([], "customer_id long, name string"), "2020-01-01").count() == 5


def test_merges_rewrite_only_touched_files(spark, store):
    base = spark.range(1000).selectExpr("id AS k", "string(id) AS v", "id AS n").repartitionByRange(10, "k")
    store.overwrite("t", base)
    before = set(store.paths("t"))
    assert len(before) == 10
    batch = spark.createDataFrame([(k, "new", k) for k in (3, 5, 7, 2000)], SCHEMA)
    store.merge("t", batch, ["k"], merge.upsert())
    found = store.version("t")
    after = set(store.paths("t"))
    assert len(before - after) == 1 and found.metrics["files_rewritten"] == 1 and found.metrics["files_kept"] == 9
    want = {**{k: (str(k), k) for k in range(1000)}, **{k: ("new", k) for k in (3, 5, 7, 2000)}}
    assert {r["k"]: (r["v"], r["n"]) for r in store.read("t").collect()} == want
    store.merge("t", batch.withColumn("v", F.lit("never")), ["k"], merge.insert_only())
    store.merge("t", spark.createDataFrame([(2001, "x", 1), (None, "null", 1)], SCHEMA), ["k"], merge.insert_only())
    assert after <= set(store.paths("t")), "inserting rewrites no file"
    assert store.read("t").count() == len(want) + 2
    store.delete("t", F.col("k").between(300, 305))
    store.update("t", {"v": F.lit("u")}, F.col("k") == 999)
    assert store.version("t").metrics["files_rewritten"] == 1
    assert store.read("t").count() == len(want) + 2 - 6 and store.read("t").where("v = 'u'").count() == 1
    store.delete("t", F.col("k") == 12345)
    assert store.version("t").metrics["files_rewritten"] == 0
    assert store.read("t", 0).count() == 1000, "old versions stay whole"
    rows_now = rows(store.read("t"))
    gone = store.vacuum("t", hours=-1, dry_run=False)
    assert gone and all(g.startswith("data/") for g in gone)
    assert rows(store.read("t")) == rows_now and not store.vacuum("t", hours=-1)
    with pytest.raises(KeyError):
        store.read("t", 0)


def test_merges_into_partitions(spark, store):
    base = spark.range(400).selectExpr("id AS k", "concat('a b/', id % 4) AS p", "id AS n")
    store.overwrite("t", base, partition_by=["p"])
    store.merge("t", spark.createDataFrame([(1, "a b/1", -1), (900, "a b/9", 9)], "k long, p string, n long"), ["k"], merge.upsert())
    found = store.version("t")
    assert found.metrics["files_rewritten"] < found.metrics["files_kept"]
    got = {r["k"]: (r["p"], r["n"]) for r in store.read("t").collect()}
    assert len(got) == 401 and got[1] == ("a b/1", -1) and got[900] == ("a b/9", 9) and got[2] == ("a b/2", 2)
    store.optimize("t", zorder_by=["n"])
    assert store.read("t").where("p = 'a b/1'").count() == 100


def test_zorder_goes_by_whole_strings(spark, store):
    df = spark.range(4000).selectExpr("concat('the-same-long-beginning-', lpad(string(pmod(xxhash64(id), 4000)), 4, '0')) AS s", "pmod(xxhash64(id, 1), 4000) AS n")
    store.overwrite("t", df)
    store.optimize("t", target_bytes=4000, zorder_by=["s", "n"])
    spans = store.read("t").withColumn("f", F.col("_metadata.file_path")).groupBy("f").agg(F.min("s").alias("a"), F.max("s").alias("b")).collect()
    assert len(spans) > 8 and sum(r["a"] <= "the-same-long-beginning-1000" <= r["b"] for r in spans) < 0.6 * len(spans)
