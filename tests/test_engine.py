"""Silver rules, quality rules, ingest, streams, the runner and plans."""

import datetime as dt
import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace.functions.columns import arrival_status, month_key, month_label
from millrace.operators import checks, gold, payments, star, tuning
from millrace.operators.incremental import Load, run_load
from millrace.operators.silver import clean_places, resolve, silver_items, silver_orders
from millrace.plans.runner import ORDER, Params, Pipeline, deduped, run_task, sequence
from millrace.sources import landing
from millrace.sources.retail import retail
from millrace.sources.store import TableStore
from millrace.streaming.files import event_windows, file_stream, run_available

RAW = "order_id string, customer_id string, order_status string, order_purchase_timestamp string, order_approved_at string, order_delivered_carrier_date string, order_delivered_customer_date string, order_estimated_delivery_date string, _ingested_at timestamp"
T = dt.datetime
TINY = "/root/testdata/sf0.001"


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, f"file://{tmp_path}/store")


def test_arrival_classes(spark):
    cases = [(T(2024, 1, 10), T(2024, 1, 5), "on_time"), (T(2024, 1, 12), T(2024, 1, 5), "on_time"), (T(2024, 2, 4), T(2024, 1, 5), "late_arriving"), (T(2024, 3, 1), T(2024, 1, 1), "very_late"), (None, T(2024, 1, 1), "very_late")]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "i timestamp, e timestamp")
    assert [r[0] for r in df.select(arrival_status(F.col("i"), F.col("e"))).collect()] == [c[2] for c in cases]


def test_silver_order_figures(spark):
    row = ("o1", "c1", "delivered", "2018-05-01 10:00:00", "2018-05-01 11:00:00", "2018-05-05 08:00:00", "2018-05-07 18:00:00", "2018-05-08 18:00:00", T(2018, 6, 1, 12))
    bad = ("o2", "c1", "delivered", "no time", "", None, None, "2018-05-08 18:00:00", None)
    newer = (*row[:2], "shipped", *row[3:8], T(2018, 5, 1))
    for _ in range(2):
        got = {r["order_id"]: r for r in silver_orders(spark.createDataFrame([row, bad, newer], RAW)).collect()}
        assert len(got) == 2
        o = got["o1"]
        assert (o["order_status"], o["delivery_duration_days"], o["approval_time_hours"], o["delivery_late"], o["arrival_status"]) == ("delivered", 2, 1.0, False, "very_late")
        assert got["o2"]["purchased_at"] is None and got["o2"]["delivery_late"] is None
    channel = spark.createDataFrame([(*newer, "web"), (*row, None)], RAW + ", order_channel string")
    assert silver_orders(channel).first()["order_status"] == "shipped"


def test_silver_items(spark):
    items = spark.createDataFrame([("o", 1, "p1", "10", None), ("o", 1, "p1", "12.5", "1"), ("o", 2, "p2", None, "2"), ("o", 3, "p9", "x", "2")], "order_id string, item_no int, product_id string, price string, freight string")
    products = spark.createDataFrame([("p1", "casa"), ("p2", "novo")], "product_id string, category string")
    words = spark.createDataFrame([("casa", "home")], "category string, category_en string")
    got = {r["item_no"]: (r["price"], r["line_total"], r["category_en"]) for r in silver_items(items, products, words).collect()}
    assert got == {1: (12.5, 13.5, "home"), 2: (None, None, "unknown"), 3: (None, None, "unknown")}


def test_places_keep_zeros(spark):
    df = spark.createDataFrame([(1, "  são paulo ", "sp", " 01000 "), (1, "x", "SP", "2")], "id int, city string, state string, zip string")
    assert clean_places(df, "id", zip_code="zip").collect()[0] == (1, "São Paulo", "SP", "01000")
    assert df.select(resolve(df, "zip_code", ["zip"])).first()[0] == " 01000 " and df.select(resolve(df, "none", [])).first()[0] is None


def test_rules_and_gate(spark):
    orders = spark.createDataFrame([("o1", None, "delivered", "2018"), ("o2", "c2", "delivered", "2018"), (None, "c2", "delivered", "2018"), (None, "c2", "lost", "2018"), ("o3", "c9", None, "2018")], "order_id string, customer_id string, order_status string, order_purchase_timestamp string")
    rules = checks.order_rules(spark.createDataFrame([("c2",)], "customer_id string"))
    failed = [r["order_id"] for r in checks.failed_rows(orders, rules).collect()]
    assert sorted(map(str, failed)) == ["None", "None", "o1", "o3"], "repeated null keys are found, each row by itself"
    assert [r["order_id"] for r in checks.passing_rows(orders, rules).collect()] == ["o2"]
    outcome = {r["rule"]: (r["failed"], r["passed"]) for r in checks.results(orders, rules).collect()}
    assert outcome["order_id_unique"] == (2, False) and outcome["status_accepted"] == (2, False) and outcome["customer_exists"] == (2, False)
    assert checks.status(checks.results(orders.limit(0), rules)).first()["status"] == "PASSED"
    letters = checks.dead_letters(checks.failed_rows(orders, rules), "orders", "order_id", F.col("failed_rules"))
    assert letters.count() == 4 and checks.dead_letter_summary(letters).agg(F.sum("records")).first()[0] == 4


def test_reconciliation(spark):
    s = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "n")], "k int, v string")
    t = spark.createDataFrame([(1, "a"), (2, "B"), (3, "c")], "k int, v string")
    assert not checks.level_counts(s, t, "k").first()["passed"] and not checks.level_counts(s, s.distinct(), "k", strict=True).first()["passed"]
    assert checks.level_counts(s, s.distinct(), "k").first()["passed"]
    bad = checks.level_buckets(s, t, "k", content=("v",))
    assert sorted(map(tuple, checks.level_keys(s, t, "k", bad).collect())) == [(3, "target_only")]
    assert [r["passed"] for r in checks.reconcile(s, s, "k").orderBy("level").collect()] == [True] * 3


def test_contract(spark):
    df = spark.createDataFrame([], "a bigint, b string, c double")
    assert checks.contract_violations(df, {"a": "int", "b": "StringType", "d": "date", "c": "string"}) == [("MISSING_COLUMN", "d", "date", ""), ("TYPE_MISMATCH", "c", "string", "double")]


def test_streaks(spark):
    months = [("a", 2020 * 12 + k, float(v)) for k, v in zip(range(11, 20), [5, 6, 7, 8, 8, 9, 10, 3, 4])] + [("b", 24240 + k, float(v)) for k, v in ((1, 1), (2, 2), (4, 3), (5, 4), (6, 5))]
    got = sorted((r["category"], r["start_month"], r["end_month"], r["streak_length"], r["growth_pct"]) for r in gold.growth_streaks(spark.createDataFrame(months, "category string, month_key int, revenue double")).collect())
    assert got == [("a", "2020-12", "2021-02", 3, 33.33), ("b", "2020-04", "2020-06", 3, 66.67)]
    assert spark.sql("SELECT DATE'2020-12-31' AS d").select(month_label(month_key(F.col("d")))).first()[0] == "2020-12"


def test_new_and_returning_add_up(spark):
    r = retail(spark, TINY)
    days = gold.new_and_returning(gold.delivered_revenue(r.orders, r.items))
    assert gold.wrong_customer_counts(days).isEmpty() and days.agg(F.sum("new_customers")).first()[0] > 0


def test_nested_questions(spark):
    df = spark.createDataFrame([(1, 1, "card", 2, 100.0), (1, 2, "card", 3, 100.01), (1, 3, "slip", 9, 5.0), (2, 1, "slip", 1, None), (3, 1, "card", 5, None)], "k int, seq int, kind string, number int, value double")
    n = payments.nest(df, "k", "seq", ("kind", "number", "value"), "value")
    assert payments.flatten(n, "k").count() == 5 and payments.nest_report(df, n, "k").first()["lines_match"]
    assert sorted(map(tuple, payments.dear_nested(n, "k", "card", 100).collect())) == [(1, 1)] == sorted(map(tuple, payments.dear_exploded(df, "k", "card", 100).collect()))
    assert sorted(map(tuple, payments.total_nested(n, "k", "card").collect())) == [(1, 200.01), (2, 0.0), (3, 0.0)]
    assert sorted(map(tuple, payments.most_nested(n, "k", "slip").collect())) == [(1, 3), (2, 0), (3, 5)]
    assert sorted(map(tuple, payments.most_exploded(df, "k", "slip").collect())) == [(1, 3), (3, 5)]


def test_surrogate_keys(spark):
    df = spark.createDataFrame([(str(k),) for k in range(50)], "id string")
    ranks = star.key_by_rank(df.repartition(5), "id").orderBy("id")
    assert [r["sk"] for r in ranks.collect()] == list(range(1, 51))
    assert star.key_stability(star.key_by_hash(df, "id"), star.key_by_hash(df.repartition(3), "id"), "id").first()["changed"] == 0
    assert star.key_by_hash(df, "id").where("sk < 0").isEmpty()
    assert star.key_by_position(df).select("sk").distinct().count() == 50


def test_ingest_twice(spark, store, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    (folder / "orders.CSV").write_text("order_id,zip\no1,01000\no2,\"a\nb\"\n")
    (folder / "other.csv").write_text("x\n1\n")
    (folder / "notes.txt").write_text("x")
    first = landing.ingest(store, f"file://{folder}", {"orders.CSV": "orders"}, "r1", multi_line={"orders.CSV"})
    second = landing.ingest(store, f"file://{folder}", {"orders.CSV": "orders"}, "r2")
    assert [(e["status"], e["reason"]) for e in first] == [("INGESTED", ""), ("SKIPPED", "not in manifest")]
    assert landing.run_report(first, second)["idempotent"] and store.read("orders").count() == 2
    store.drop(landing.LOG)  # as if the first run had failed before its log
    assert landing.ingest(store, f"file://{folder}", {"orders.CSV": "orders"}, "r3")[0]["reason"] == "already ingested"
    (folder / "orders.CSV").write_text("order_id,zip,channel\no3,1,web\n")
    assert {(r["file_name"], r["is_loaded"]) for r in landing.ingest_probe(store, f"file://{folder}").collect()} == {("orders.CSV", False), ("other.csv", False)}
    landing.ingest(store, f"file://{folder}", {"orders.CSV": "orders"}, "r4")
    assert landing.ingest_probe(store, f"file://{folder}").where("is_loaded").first()["file_name"] == "orders.CSV"
    assert store.read("orders").count() == 3 and "01000" in [r["zip"] for r in store.read("orders").collect()]
    assert landing.load_summary(store, ["orders", "none"]).where("status = 'LOADED'").first()["rows"] == 3


def test_a_run_is_a_commit_for_each_table(spark, store, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    texts = {"a one.csv": "k,v\n1,x\n2,y\n", "b+2.csv": "k,v\n3,z\n", "c.csv": "k,w\n4,q\n", "empty.csv": "k,v\n", "d.csv": "n\n7\n"}
    for name, text in texts.items():
        (folder / name).write_text(text)
    manifest = {**dict.fromkeys(texts, "t"), "d.csv": "other"}
    report = landing.ingest(store, f"file://{folder}", manifest, "r1")
    assert {e["file"]: (e["records"], e["columns"]) for e in report} == {"a one.csv": (2, 6), "b+2.csv": (1, 6), "c.csv": (1, 6), "empty.csv": (0, 6), "d.csv": (1, 5)}
    assert store.version("t").number == 0 and store.version("other").number == 0
    assert sorted((r["k"], r["v"], r["w"], r["_source_file_name"]) for r in store.read("t").collect()) == [("1", "x", None, "a one.csv"), ("2", "y", None, "a one.csv"), ("3", "z", None, "b+2.csv"), ("4", None, "q", "c.csv")]
    assert not any(e["status"] == "INGESTED" for e in landing.ingest(store, f"file://{folder}", manifest, "r2")) and store.version("t").number == 0


def test_daily_files(spark, store, tmp_path):
    files = landing.daily_files()
    assert len(files) == 30 and files == landing.daily_files() and all(6 <= len(t.splitlines()) <= 16 for t in files.values())
    name = landing.daily_name(dt.date(2024, 1, 5))
    (tmp_path / name).write_text(files[name])
    assert [landing.branch(t) for t in (files[name], None, "", "a,b\n1,2\n", "order_id,transaction_date,amount,status\n")] == ["load"] + ["invalid"] * 4
    with pytest.raises(RuntimeError):
        landing.load_daily(store, f"file://{tmp_path}/{name}", fail=True)
    assert not store.exists("daily_transactions")
    for _ in range(2):
        n = landing.load_daily(store, f"file://{tmp_path}/{name}")
        assert store.read("daily_transactions").count() == n == len(files[name].splitlines()) - 1


def test_incremental(spark, store):
    rows = lambda xs: spark.createDataFrame(xs, "k int, at timestamp, v string")
    load = Load("p", "t", "k", "at", 24)
    one = [(1, T(2024, 1, 1), "a"), (2, T(2024, 1, 3), "b"), (2, T(2024, 1, 2), "old")]
    assert run_load(store, load, rows(one), "r1")["rows"] == 3 and store.read("t").count() == 2
    two = [(1, T(2024, 1, 1), "too old"), (2, T(2024, 1, 2, 12), "late"), (3, T(2024, 1, 4), "c")]
    out = run_load(store, load, rows(two), "r2")
    assert (out["rows"], out["fresh"], out["watermark"]) == (2, 1, T(2024, 1, 4))
    assert {r["k"]: r["v"] for r in store.read("t").collect()} == {1: "a", 2: "late", 3: "c"}
    assert run_load(store, load, rows([(9, T(2023, 1, 1), "x")]), "r3")["rows"] == 0


def test_stream_once(spark, store, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "a.csv").write_text("k,v\n1,x\n2,y\n")
    go = lambda: run_available(file_stream(spark, f"file://{inbox}", "k int, v string"), store, "t", f"file://{tmp_path}/cp")
    assert (go(), go()) == (2, 0)
    (inbox / "b.csv").write_text("k,v\n3,z\n")
    assert go() == 1 and store.read("t").count() == 3


def test_event_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{TINY}/events.parquet")
    stream = event_windows(spark.readStream.schema(events.schema).parquet(f"{TINY}/events.parquet".replace("events.parquet", "event*.parquet")))
    stream.writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()
    assert sorted(map(str, spark.table("w").collect())) == sorted(map(str, event_windows(events).collect()))


def test_pipeline_runs_twice_and_dry(spark, store, tmp_path):
    source = retail(spark, TINY)
    dry = Pipeline(store, source, Params(dry_run=True)).run()
    assert all(r["status"] == "SUCCESS" for r in dry) and not store.exists("silver/orders")
    for _ in range(2):
        reports = Pipeline(store, source, Params("r"), tmp_path / "reports").run()
        by = {r["task"]: r for r in reports}
        assert by["dimensional"]["check"]["is_valid"] and by["quality"]["quality"] == "PASSED"
        assert by["visualization"]["datasets"]["top_states"] == 10
    assert json.loads((tmp_path / "reports" / "gold.json").read_text())["status"] == "SUCCESS"
    with pytest.raises(RuntimeError, match="simulated"):
        Pipeline(store, source, Params("r", simulate_failure="silver"), tmp_path / "reports").run()
    assert json.loads((tmp_path / "reports" / "silver.json").read_text())["status"] == "FAILED"
    assert sequence(ORDER).index("dimensional") > sequence(ORDER).index("gold")
    with pytest.raises(ValueError):
        sequence({"a": ("b",), "b": ("a",)})
    assert run_task("x", Params(), lambda: {"n": 1})["n"] == 1


def test_plans(spark):
    r = retail(spark, TINY)
    revenue = tuning.explain(gold.delivered_revenue(r.orders, deduped(r.items)), "simple")
    lines = next(x for x in revenue.splitlines() if "FileScan" in x and "l_orderkey" in x)
    assert "l_returnflag" not in lines.split("Batched")[0] and "l_quantity" not in lines.split("Batched")[0], "columns are pruned"
    assert revenue.count("hashpartitioning(order_id") <= 2, "lines are dealt once"
    sellers = r.sellers.select("seller_id", "state")
    name = lambda hint: tuning.join_strategy(tuning.explain(tuning.with_strategy(r.items, sellers, "seller_id", hint)))
    assert [name(h) for h in ("merge", "broadcast", "shuffle_hash")] == ["sort_merge", "broadcast_hash", "shuffled_hash"]
    late = r.orders.join(r.customers, "customer_id").groupBy("state").count().where("state = 'BRAZIL'")
    assert "EqualTo(n_name,BRAZIL)" in tuning.explain(late), "the filter reaches the scan"
    scan = tuning.explain(r.items.where("price > 50000").select("order_id"))
    assert "GreaterThan(l_extendedprice,50000.0)" in scan and "l_comment" not in scan and "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double>" in scan
    assert not tuning.has_shuffle(scan) and tuning.has_shuffle(tuning.explain(r.items.groupBy("seller_id").count()))
    assert {v["variant"] for v in tuning.compare({"a": lambda: r.items.where("price > 1"), "b": lambda: r.items}, rounds=1)} == {"a", "b"}
    old = tuning.skew_settings(spark)
    assert set(tuning.set_skew_join(spark, True).values()) == {"set"} and old


def test_entry_works_without_the_training_operators(tmp_path):
    root = Path(__file__).resolve().parent.parent
    code = "import sys; sys.modules['millrace.llm'] = None; sys.path.insert(0, %r); import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 80 and set(e.oracle_sql()) <= set(q)" % str(root)
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
    for f in (root / "millrace").rglob("*.py"):
        if "llm" not in f.relative_to(root / "millrace").parts:
            assert "llm" not in f.read_text().replace("``llm``", ""), f


def test_logs_and_completion(spark, store):
    orders = spark.createDataFrame([("o1", None), ("o2", "c2")], "order_id string, customer_id string")
    rules = [checks.Rule("customer_id_not_null", "not_null", "customer_id")]
    for run in ("r1", "r2"):
        assert checks.run_checks(store, orders, rules, "orders", run) == "FAILED"
    assert store.read("data_quality_results").count() == 2 and store.read("dead_letter_queue").count() == 1
    assert checks.check_contract(store, orders, {"order_id": "string"}, "orders", "r1") == 1
    items = spark.createDataFrame([(1,), (2,), (None,)], "product_id long")
    store.overwrite("dim", star.dimension(spark.createDataFrame([(1, "a")], "product_id long, name string"), "product_id", ("name",)))
    fill = {"name": "UNKNOWN"}
    assert (star.complete_dimension(store, "dim", items, "product_id", fill), star.complete_dimension(store, "dim", items, "product_id", fill)) == (1, 0)
    assert store.read("dim").count() == 2


def test_staging_backfill_and_export(spark, store, tmp_path):
    days = landing.daily_files(days=3)
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    for name, text in list(days.items())[:2]:
        (tmp_path / name).write_text(text)
        assert landing.stage(store, f"file://{tmp_path}/{name}", f"file://{inbox}").endswith(name)
    for _ in range(2):
        report = landing.backfill(store, f"file://{inbox}", dt.date(2024, 1, 1), 3)
        assert [r["status"] for r in report] == ["LOADED", "LOADED", "INVALID"]
        assert store.read("daily_transactions").count() == sum(r["rows"] for r in report)
    landing.export_csv(store.read("daily_transactions"), f"file://{tmp_path}/out")
    assert len(list((tmp_path / "out").glob("*.csv"))) == 1
    before = store.read("daily_transactions").count()
    store.append_sample("daily_transactions", 0.5)
    assert before < store.read("daily_transactions").count() < 2 * before


def test_antipattern_pairs_agree(spark):
    r = retail(spark, TINY)
    for slow, quick in tuning.antipatterns(r.orders, r.items, r.customers, r.sellers, "BRAZIL", 50000.0).values():
        assert sorted(map(tuple, slow().collect())) == sorted(map(tuple, quick().collect()))
    pair = tuning.antipatterns(r.orders, r.items, r.customers, r.sellers, "BRAZIL", 50000.0)["late_filter"]
    assert tuning.speedup(*pair, rounds=1)["speedup"] > 0


def test_partition_filter_reaches_the_scan(spark, store):
    store.overwrite("p", spark.range(100).selectExpr("id", "id % 5 AS part"), partition_by=["part"])
    assert "part" in tuning.partition_filters(store.read("p").where("part = 3"))
