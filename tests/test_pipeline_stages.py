"""Each task of the pipeline works on what those before it stored, not on the source again."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import checks
from millrace.operators.silver import price_gate
from millrace.plans.runner import Params, Pipeline, deduped
from millrace.sources.retail import retail
from millrace.sources.store import TableStore

TINY = "/root/testdata/sf0.001"


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, f"file://{tmp_path}/store")


def text(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def odd(spark):
    """A source with orders that are there twice, without id, or of a customer that isn't known, an unknown status and a line without price."""
    source, own = retail(spark, TINY), retail(spark, TINY)
    first = source.orders.orderBy("order_id").limit(5)
    null = first.withColumn("order_id", F.lit(None).cast("long"))
    lost = first.limit(1).withColumns({"order_id": F.lit(-1).cast("long"), "customer_id": F.lit(-1).cast("long"), "status": F.lit("?")})
    own.__dict__["orders"] = source.orders.unionByName(first).unionByName(null).unionByName(lost)
    own.__dict__["items"] = source.items.withColumn("price", F.when(F.col("item_no") == 2, F.lit(None)).otherwise(F.col("price")))
    return own


def test_what_follows_bronze_comes_from_it(spark, store):
    task = Pipeline(store, retail(spark, TINY), Params("r", as_of="2001-01-01"))
    task.bronze()
    store.delete("bronze/orders", F.col("order_id") % 2 == 1)
    store.update("bronze/items", {"price": F.lit(0.0)}, F.col("item_no") == 1)
    want = task.source.orders.where("order_id % 2 = 0")
    assert {r["total"] for r in task.quality()["rules"]} == {want.count()}
    task.silver()
    assert text(store.read("silver/orders")) == text(want)
    lines = store.read("silver/items")
    assert lines.where("item_no = 1").count() == 0 and lines.count() == task.source.items.where("item_no <> 1").select("order_id", "item_no").distinct().count()
    assert all(level["passed"] for level in task.reconciliation()["levels"])
    task.gold()
    assert task.dimensional()["check"]["is_valid"]
    facts = store.read("gold/fact_sales")
    assert facts.count() and facts.where("order_id % 2 = 1 OR item_no = 1").count() == 0


def test_silver_goes_by_what_quality_stored(spark, store):
    task = Pipeline(store, odd(spark), Params("r"))
    task.bronze()
    assert task.quality()["quality"] == "FAILED"
    gate = task.silver_orders()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in gate and "/metadata/checked_orders/" in "".join(task.silver_orders().inputFiles()), "the rules' joins run once"
    one = store.read("bronze/orders").agg(F.max("order_id")).first()[0]
    store.update("metadata/checked_orders", {"failed_rules": F.array(F.lit("customer_exists"))}, F.col("order_id") == one)
    task.silver()
    assert store.read("silver/orders").where(F.col("order_id") == one).count() == 0
    assert [r["failure_reason"] for r in store.read("metadata/dead_letters").where(F.col("record_key") == str(one)).collect()] == ["customer_exists"]
    task.bronze()
    task.silver()
    assert store.read("silver/orders").where(F.col("order_id") == one).count() == 1, "what quality said of older bronze orders doesn't count"


def test_checked_rows_give_the_same_results_and_gate(spark, store):
    task = Pipeline(store, odd(spark), Params("r"))
    orders, rules = task.source.orders, task.rules()
    store.overwrite("checked", checks.checked(orders, rules))
    seen = store.read("checked")
    assert seen.count() == orders.count() and text(checks.checked_results(seen, rules)) == text(checks.results(orders, rules))
    assert {r["rule"]: r["failed"] for r in checks.checked_results(seen, rules).collect()} == {"order_id_not_null": 5, "order_id_unique": 15, "customer_exists": 1, "status_accepted": 1}
    for severities in (("critical",), ("warning",), ("critical", "warning")):
        passing, failed = checks.checked_gate(seen, rules, severities)
        assert passing.columns == orders.columns and text(passing) == text(checks.passing_rows(orders, rules, severities))
        assert text(failed) == text(checks.failed_rows(orders, rules, severities))
    letters = lambda df: checks.dead_letters(df, "orders", "order_id", F.col("failed_rules"))
    assert text(letters(checks.checked_gate(seen, rules)[1])) == text(letters(checks.failed_rows(orders, rules)))


def test_lines_are_gated_and_deduped_in_one_shuffle(spark, store):
    own = odd(spark)
    extra = own.items.where("item_no = 1").orderBy("order_id").limit(4)
    others = [extra.withColumn("price", F.lit(p).cast("double")) for p in (0.0, 1e9)] + [extra.withColumns({c: F.lit(None).cast(own.items.schema[c].dataType), "price": F.lit(p).cast("double")}) for c in ("order_id", "item_no") for p in (None, 5.0)]
    for df in others:
        own.__dict__["items"] = own.items.unionByName(df)
    got, want = Pipeline(store, own, Params("r")).silver_items(), deduped(price_gate(own.items)[0])
    assert text(got) == text(want) and got.where("order_id IS NULL OR item_no IS NULL").count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1 and "Join" not in plan, plan


def test_a_dry_run_reports_what_a_run_would_write(spark, store, tmp_path):
    old, dry = Pipeline(store, retail(spark, TINY), Params("r")), Pipeline(store, odd(spark), Params("r", dry_run=True))
    wet = Pipeline(TableStore(spark, f"file://{tmp_path}/other"), odd(spark), Params("r"))
    for name in ("bronze", "quality", "silver"):
        getattr(old, name)()
        assert getattr(dry, name)() == getattr(wet, name)(), name
    assert dry.reconciliation() == wet.reconciliation() and dry.items().count() == wet.items().count()
