"""The star schema: dimensions, surrogate keys, the fact, its checks and the star query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import date_key, share, surrogate
from .gold import line_total
from .ranking import with_ranks


def date_dimension(spark: SparkSession, first: str, last: str, fiscal_start: int = 4) -> DataFrame:
    """A row for each day, with calendar and fiscal columns; the fiscal year begins in fiscal_start."""
    day = spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}', INTERVAL 1 DAY)) AS full_date")
    d = F.col("full_date")
    fiscal = F.pmod(F.month(d) - fiscal_start, F.lit(12)) + 1
    return day.select(
        date_key(d).alias("date_key"),
        d,
        F.year(d).alias("year"),
        F.quarter(d).alias("quarter"),
        F.month(d).alias("month"),
        F.weekofyear(d).alias("week_of_year"),
        F.dayofmonth(d).alias("day"),
        F.dayofweek(d).alias("day_of_week"),
        F.date_format(d, "EEEE").alias("day_name"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.date_format(d, "yyyy-MM").alias("year_month"),
        F.dayofweek(d).isin(1, 7).alias("is_weekend"),
        (F.dayofmonth(d) == 1).alias("is_month_start"),
        (d == F.last_day(d)).alias("is_month_end"),
        (F.year(d) - (F.month(d) < fiscal_start).cast("int")).alias("fiscal_year"),
        fiscal.alias("fiscal_month"),
        F.ceil(fiscal / 3).cast("int").alias("fiscal_quarter"),
    )


def key_by_position(df: DataFrame, name: str = "sk") -> DataFrame:
    """Unique, but another number whenever rows are dealt otherwise."""
    return df.withColumn(name, F.monotonically_increasing_id())


def key_by_rank(df: DataFrame, natural: str, name: str = "sk", after: int = 0) -> DataFrame:
    """Gapless numbers in the order of the natural key; see operators.ranking."""
    return with_ranks(df, natural, {name: F.col(natural)}).withColumn(name, F.col(name) + after).drop("__rows")


def key_by_hash(df: DataFrame, natural: str, name: str = "sk", salt: str = "") -> DataFrame:
    """The same number on every run, from the natural key alone."""
    return df.withColumn(name, surrogate(F.col(natural), salt=salt))


def key_stability(one: DataFrame, other: DataFrame, natural: str, name: str = "sk") -> DataFrame:
    """Rows, keys that changed between two runs, and keys given twice."""
    both = one.select(natural, F.col(name).alias("a")).join(other.select(natural, F.col(name).alias("b")), natural)
    return both.agg(F.count("*").alias("rows"), F.sum((F.col("a") != F.col("b")).cast("long")).alias("changed"), (F.count("*") - F.count_distinct("a")).alias("repeated"))


def dimension(source: DataFrame, natural: str, columns: Sequence[str]) -> DataFrame:
    """A type 1 dimension: the hash key, the natural key and the columns."""
    return source.select(surrogate(F.col(natural)).alias(f"{natural.removesuffix('_id')}_sk"), natural, *columns)


def orphans(items: DataFrame, dim: DataFrame, natural: str, fill: dict[str, object]) -> DataFrame:
    """Stub rows for natural keys that the facts use and the dimension lacks."""
    missing = items.select(natural).where(F.col(natural).isNotNull()).distinct().join(dim.select(natural), natural, "left_anti")
    return missing.select(surrogate(F.col(natural)).alias(f"{natural.removesuffix('_id')}_sk"), natural, *(F.lit(v).cast(dim.schema[c].dataType).alias(c) for c, v in fill.items()))


def category_conformance(dim: DataFrame, reference: DataFrame, source: str = "category", english: str = "category_en") -> DataFrame:
    """Categories whose English name the reference lacks, or that have several English names."""
    unknown = dim.select(F.col(source).alias("category"), F.col(english).alias("detail")).where("detail is not null").distinct().join(reference.select(F.col(english).alias("detail")), "detail", "left_anti").select("category", F.lit("NOT_IN_REFERENCE").alias("issue"), "detail")
    several = dim.groupBy(F.col(source).alias("category")).agg(F.count_distinct(english).alias("n")).where("n > 1").select("category", F.lit("SEVERAL_TRANSLATIONS").alias("issue"), F.col("n").cast("string").alias("detail"))
    return unknown.unionByName(several)


def fact_base(orders: DataFrame, items: DataFrame, status: str = "F") -> DataFrame:
    """Delivered lines with their day."""
    delivered = orders.where(F.col("status") == status).select("order_id", "customer_id", "purchased_at")
    return items.join(delivered, "order_id").withColumn("date_key", date_key(F.col("purchased_at")))


def fact_sales(base: DataFrame, dates: DataFrame, products: DataFrame, sellers: DataFrame, customers: DataFrame, promise_days: int = 30) -> DataFrame:
    """The fact: each line with the keys of its four dimensions, the customer's current version.
    Dimensions are joined without hints; Spark broadcasts those that are small enough."""
    days = F.datediff("shipped_at", "purchased_at")
    return (
        base.join(dates.select("date_key"), "date_key")
        .join(products.select("product_id", "product_sk"), "product_id")
        .join(sellers.select("seller_id", "seller_sk"), "seller_id")
        .join(customers.where("is_current").select("customer_id", "customer_sk"), "customer_id")
        .select(
            "order_id",
            "item_no",
            "date_key",
            "product_sk",
            "seller_sk",
            "customer_sk",
            "price",
            F.round(F.col("price") * F.col("tax"), 4).alias("freight"),
            line_total().alias("total_amount"),
            days.alias("delivery_days"),
            (days > promise_days).alias("is_late"),
        )
    )


def join_gaps(base: DataFrame, **dims: tuple[DataFrame, str]) -> DataFrame:
    """What each dimension costs the fact, in the order given: the lines whose key it lacks, those whose key
    it has but in no current version (for dimensions with ``is_current``), the distinct keys among both, and
    the lines that are left after this join and those before; the last row is the total.

    One pass: each dimension is reduced to a row for each key and joined on the left."""
    rows, left, measures = base, F.lit(True), []
    for i, (dim, key) in enumerate(dims.values()):
        current = F.col("is_current") if "is_current" in dim.columns else F.lit(True)
        keys = dim.select(F.col(key).alias(f"__key{i}"), current.alias("__current")).groupBy(f"__key{i}").agg(F.max("__current").alias(f"__found{i}"))
        rows = rows.join(keys, F.col(key) == F.col(f"__key{i}"), "left")
        absent, stale = F.col(f"__found{i}").isNull(), F.coalesce(~F.col(f"__found{i}"), F.lit(False))
        left = left & ~absent & ~stale
        measures += [F.count_if(absent).alias(f"a{i}"), F.count_if(stale).alias(f"s{i}"), F.count_distinct(F.when(absent | stale, F.col(key))).alias(f"k{i}"), F.count_if(left).alias(f"l{i}")]
    sums = rows.agg(F.count("*").alias("n"), *measures)
    last = len(dims) - 1
    lines = [F.struct(F.lit(name).alias("dimension"), F.col(f"a{i}").alias("absent_lines"), F.col(f"s{i}").alias("not_current_lines"), F.col(f"k{i}").alias("lost_keys"), F.col(f"l{i}").alias("lines_left"), (F.col("n") - F.col(f"l{i}")).alias("lines_dropped")) for i, name in enumerate(dims)]
    total = F.struct(F.lit("total").alias("dimension"), F.lit(0).cast("long").alias("absent_lines"), F.lit(0).cast("long").alias("not_current_lines"), F.lit(0).cast("long").alias("lost_keys"), F.col(f"l{last}").alias("lines_left"), (F.col("n") - F.col(f"l{last}")).alias("lines_dropped"))
    return sums.select(F.inline(F.array(*lines, total)))


def validate_fact(fact: DataFrame, base: DataFrame) -> DataFrame:
    """Null keys, row counts and revenue of the fact against its source."""
    nulls = sum((F.col(c).isNull().cast("long") for c in ("date_key", "product_sk", "seller_sk", "customer_sk")), F.lit(0))
    own = fact.agg(F.sum(nulls).alias("null_keys"), F.count("*").alias("fact_rows"), F.round(F.sum("total_amount"), 2).cast("double").alias("fact_revenue"))
    source = base.agg(F.count("*").alias("base_rows"), F.round(F.sum(line_total()), 2).cast("double").alias("base_revenue"))
    return own.crossJoin(source).withColumn("is_valid", (F.col("null_keys") == 0) & (F.col("fact_rows") == F.col("base_rows")) & (F.col("fact_revenue") == F.col("base_revenue")))  # one row each


def star_summary(fact: DataFrame, dates: DataFrame, products: DataFrame, customers: DataFrame, year: int, states: Sequence[str]) -> DataFrame:
    """Sales of a year in some states by month, state and category. Late share: null is on time."""
    rows = (
        fact.join(dates.where(F.col("year") == year).select("date_key", "year_month"), "date_key")
        .join(customers.where(F.col("is_current") & F.col("state").isin(*states)).select("customer_sk", "state"), "customer_sk")
        .join(products.select("product_sk", "category"), "product_sk")
    )
    return rows.groupBy("year_month", "state", "category").agg(
        F.count_distinct("order_id").alias("order_count"),
        F.count("*").alias("line_count"),
        F.round(F.sum("total_amount"), 2).cast("double").alias("revenue"),
        F.round(F.sum("delivery_days") / F.count("delivery_days"), 2).alias("avg_delivery_days"),
        share(F.col("is_late"), 2, 100.0).alias("late_pct"),
    )


def complete_dimension(store, name: str, items: DataFrame, natural: str, fill: dict[str, object]) -> int:
    """Merges stubs for keys that the facts use into a stored dimension; returns how many were new."""
    from .merge import insert_only

    stubs = orphans(items, store.read(name), natural, fill)
    n = stubs.count()
    if n:
        store.merge(name, stubs, [natural], insert_only())
    return n
