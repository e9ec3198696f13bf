"""Cleaning and keyed deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import arrival_status, code, hours_between, timestamp, title


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column], dealt_by: Sequence[str] | None = None, unless: Column | None = None) -> DataFrame:
    """One row for each key, the first in the given order, which should end in a unique column.

    ``dealt_by``, some of the keys, deals the rows by those only: later grouping or joining by them
    needs no second shuffle. ``unless``: a key with a row for which it holds has none; keys with a null are
    equal to no other there, as in a join."""
    rows = df.repartition(*dealt_by) if dealt_by else df
    by = W.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumn("__rank", F.row_number().over(by))
    if unless is not None:
        found = unless
        for k in keys:
            found = found & F.col(k).isNotNull()
        whole = by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        rows = rows.withColumn("__out", F.coalesce(F.max(found).over(whole), F.lit(False))).where("NOT __out").drop("__out")
    return rows.where("__rank = 1").drop("__rank")


def silver_orders(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Raw string orders with parsed times and what follows from them, one row for each order_id:
    rows with a channel first (if there is such a column), then the newest."""
    order = [F.col("order_channel").isNull()] if "order_channel" in raw.columns else []
    rows = keep_first(raw, ["order_id"], [*order, F.col("_ingested_at").desc_nulls_last(), F.xxhash64(*raw.columns)])
    parsed = rows.withColumns(
        {
            "purchased_at": timestamp(F.col("order_purchase_timestamp")),
            "approved_at": timestamp(F.col("order_approved_at")),
            "carrier_at": timestamp(F.col("order_delivered_carrier_date")),
            "delivered_at": timestamp(F.col("order_delivered_customer_date")),
            "estimated_at": timestamp(F.col("order_estimated_delivery_date")),
        }
    )
    return parsed.withColumns(
        {
            "delivery_duration_days": F.datediff("delivered_at", "carrier_at"),
            "approval_time_hours": hours_between(F.col("approved_at"), F.col("purchased_at")),
            "delivery_late": F.col("delivered_at") > F.col("estimated_at"),
            "order_year": F.year("purchased_at"),
            "order_month": F.month("purchased_at"),
            "order_day_of_week": F.dayofweek("purchased_at"),
            "arrival_status": arrival_status(F.col("_ingested_at"), F.col("purchased_at")),
        }
    )


def split_late(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """On-time orders, and the late arrivals."""
    on_time = F.col("arrival_status") == "on_time"
    return orders.where(on_time), orders.where(~on_time)


def silver_items(items: DataFrame, products: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """Priced lines with their category: missing freight is 0, a category that is missing or has no
    translation is unknown, and of repeated lines the dearest stays. Dealt by order_id."""
    price, freight = F.col("price").try_cast("double"), F.coalesce(F.col("freight").try_cast("double"), F.lit(0.0))
    rows = items.withColumns({"price": price, "freight": freight, "line_total": price + freight})
    tie = [c for c in ("product_id", "seller_id") if c in rows.columns]
    rows = keep_first(rows, ["order_id", "item_no"], [F.col("price").desc_nulls_last(), *map(F.col, tie), F.xxhash64(*rows.columns)], dealt_by=["order_id"])
    rows = rows.join(products.select("product_id", "category"), "product_id", "left")
    if categories is not None:
        rows = rows.join(categories.select("category", "category_en"), "category", "left")
        return rows.withColumn("category_en", F.coalesce("category_en", F.lit("unknown")))
    return rows.withColumn("category", F.coalesce("category", F.lit("unknown")))


def invalid_price() -> Column:
    return F.col("price").isNull() | (F.col("price") <= 0)


def invalid_prices(items: DataFrame) -> DataFrame:
    return items.where(invalid_price())


def clean_places(df: DataFrame, key: str, city: str = "city", state: str = "state", zip_code: str | None = None) -> DataFrame:
    """Customers or sellers: tidied city, state and zip, one row for each key."""
    tidy = {city: title(F.col(city)), state: code(F.col(state))}
    if zip_code:
        tidy[zip_code] = F.trim(zip_code)
    return keep_first(df.withColumns(tidy), [key], [F.col(city), F.xxhash64(*df.columns)])


def uniqueness(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys and whether they agree."""
    return df.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys")).withColumn("is_unique", F.col("rows") == F.col("keys"))


def unknown_share(items: DataFrame, category: str = "category_en") -> DataFrame:
    """Percent of lines without a known category."""
    unknown = F.when(F.col(category) == "unknown", 1.0).otherwise(0.0)
    return items.agg(F.count("*").alias("lines"), F.round(100 * F.avg(unknown), 2).alias("unknown_pct"))


def top_untranslated(items: DataFrame, products: DataFrame, categories: DataFrame, limit: int = 3) -> DataFrame:
    """The categories without a translation that most lines have. Lines are counted by product before the
    joins, which so carry a row for each product."""
    sold = items.groupBy("product_id").agg(F.count("*").alias("n")).join(products.select("product_id", "category"), "product_id")
    unknown = sold.groupBy("category").agg(F.sum("n").alias("lines")).join(categories.select("category"), "category", "left_anti")
    return unknown.orderBy(F.desc("lines"), "category").limit(limit)


def price_gate(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines whose (order_id, item_no) has no invalid price, and the invalid lines."""
    bad = invalid_prices(items)
    return items.join(bad.select("order_id", "item_no").distinct(), ["order_id", "item_no"], "left_anti"), bad


def damaged_orders(orders: DataFrame, each: int = 3) -> DataFrame:
    """Bad rows to try the dead letters with: the first orders without their id, then without their customer."""
    first = orders.orderBy("order_id").limit(each)
    gone = lambda c: F.lit(None).cast(orders.schema[c].dataType)
    return first.withColumn("order_id", gone("order_id")).unionByName(first.withColumn("customer_id", gone("customer_id")))


def resolve(df: DataFrame, name: str, also: Sequence[str]) -> Column:
    """The column of that name or of one of the spellings it also goes by; null if there is none."""
    return next((df[c] for c in (name, *also) if c in df.columns), F.lit(None)).alias(name)
