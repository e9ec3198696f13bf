"""Analytics over orders and items: sales by day, customers, growth, sellers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import exact_mean, money, month_key, month_label, percent_change
from .ranking import tile, with_ranks


def line_total() -> Column:
    return money(F.col("price") * (1 - F.col("discount")) * (1 + F.col("tax")))


def all_orders(on_time: DataFrame, late: DataFrame) -> DataFrame:
    """Both populations, by name; columns that one lacks are null there."""
    return on_time.unionByName(late, allowMissingColumns=True)


def delivered_revenue(orders: DataFrame, items: DataFrame, status: str = "F") -> DataFrame:
    """Delivered orders with the sums of their lines; orders without lines or date fall away.

    Lines are summed up by order before the join, so the join carries one row for each order."""
    lines = items.groupBy("order_id").agg(
        F.sum(line_total()).alias("revenue"), F.sum(money(F.col("price") * F.col("tax"))).alias("freight"), F.count("*").alias("item_count")
    )
    delivered = orders.where((F.col("status") == status) & F.col("purchased_at").isNotNull()).select("order_id", "customer_id", F.to_date("purchased_at").alias("order_date"))
    return delivered.join(lines, "order_id")


def daily_sales(revenue: DataFrame) -> DataFrame:
    """Sales by day with running sum, moving averages over 7 and 30 rows, change from the row before
    and rank within the month. The windows run over days, of which there are few."""
    days = revenue.groupBy("order_date").agg(
        F.count_distinct("order_id").alias("order_count"),
        F.count_distinct("customer_id").alias("customer_count"),
        F.sum("revenue").alias("revenue"),
        F.sum("freight").alias("freight"),
        F.sum("item_count").alias("item_count"),
    )
    by_day = W.orderBy("order_date")
    mean = lambda n: exact_mean(F.sum("revenue").over(by_day.rowsBetween(1 - n, 0)), F.count("*").over(by_day.rowsBetween(1 - n, 0)))
    before = F.lag("revenue").over(by_day)
    double = lambda c: c.cast("double")
    return days.select(
        "order_date",
        "order_count",
        "customer_count",
        double(F.round("revenue", 2)).alias("revenue"),
        double(F.round("freight", 2)).alias("freight"),
        "item_count",
        double(F.round(F.sum("revenue").over(by_day), 2)).alias("cumulative_revenue"),
        mean(7).alias("ma_7"),
        mean(30).alias("ma_30"),
        double(F.round(before, 2)).alias("previous_revenue"),
        double(F.round(F.col("revenue") - before, 2)).alias("change"),
        percent_change(double(F.col("revenue")), double(before)).alias("change_pct"),
        F.rank().over(W.partitionBy(F.year("order_date"), F.month("order_date")).orderBy(F.desc("revenue"))).alias("rank_in_month"),
    )


def month_slice(days: DataFrame, year: int, month: int, column: str = "order_date") -> DataFrame:
    return days.where((F.year(column) == year) & (F.month(column) == month))


def new_and_returning(revenue: DataFrame) -> DataFrame:
    """Customers by day: new on the day of their first order, returning later."""
    first = revenue.groupBy("customer_id").agg(F.min("order_date").alias("first_date"))
    rows = revenue.join(first, "customer_id")
    new = F.col("order_date") == F.col("first_date")
    return rows.groupBy("order_date").agg(
        F.count_distinct("order_id").alias("order_count"),
        F.round(F.sum("revenue"), 2).cast("double").alias("revenue"),
        F.round(F.sum("freight"), 2).cast("double").alias("freight"),
        F.count_distinct("customer_id").alias("unique_customers"),
        F.count_distinct(F.when(new, F.col("customer_id"))).alias("new_customers"),
        F.count_distinct(F.when(~new, F.col("customer_id"))).alias("returning_customers"),
        F.sum("item_count").alias("item_count"),
    )


def wrong_customer_counts(days: DataFrame) -> DataFrame:
    """Days on which new and returning customers don't add up."""
    return days.where(F.col("new_customers") + F.col("returning_customers") != F.col("unique_customers"))


def rfm(revenue: DataFrame, documented_direction: bool = False) -> DataFrame:
    """Recency, frequency and money scores by quintile, segments and value rank.

    As published, a *low* frequency or money score is the better one; ``documented_direction`` turns
    them round. Ties are broken by customer_id, so scores don't depend on the order of rows."""
    reference = revenue.agg(F.max("order_date").alias("reference_date"))
    rows = revenue.groupBy("customer_id").agg(F.max("order_date").alias("last_date"), F.count_distinct("order_id").alias("frequency"), F.round(F.sum("revenue"), 2).alias("monetary"))
    rows = rows.crossJoin(F.broadcast(reference)).withColumn("recency_days", F.datediff("reference_date", "last_date"))  # one row
    rows = with_ranks(rows, "customer_id", {"r_rank": F.col("recency_days"), "f_rank": -F.col("frequency"), "value_rank": -F.col("monetary")})
    fifth = lambda rank: tile(F.col(rank), F.col("__rows"), 5)
    turn = (lambda c: 6 - c) if documented_direction else (lambda c: c)
    rows = rows.withColumns({"r_score": 6 - fifth("r_rank"), "f_score": turn(fifth("f_rank")), "m_score": turn(fifth("value_rank"))}).drop("r_rank", "f_rank", "__rows")
    return rows.withColumns({"rfm_score": F.col("r_score") + F.col("f_score") + F.col("m_score"), "segment": segment(F.col("r_score"), F.col("f_score"), F.col("m_score"))})


def segment(r: Column, f: Column, m: Column) -> Column:
    return (
        F.when((r >= 4) & (f >= 4) & (m >= 4), "Champions")
        .when((r >= 3) & (f >= 3) & (m >= 3), "Loyal")
        .when((r >= 4) & (f <= 2), "Potential")
        .when((r <= 2) & (f >= 3), "At Risk")
        .when((r <= 2) & (f <= 2), "Lost")
        .otherwise("Needs Attention")
    )


def segments(scores: DataFrame) -> DataFrame:
    mean = lambda c: exact_mean(F.sum(money(F.col(c))), F.count("*")).alias(f"avg_{c}")
    return scores.groupBy("segment").agg(F.count("*").alias("customers"), mean("monetary"), mean("frequency"), mean("recency_days"))


def category_months(orders: DataFrame, items: DataFrame, products: DataFrame, status: str = "F") -> DataFrame:
    lines = items.join(orders.where(F.col("status") == status).select("order_id", "purchased_at"), "order_id").join(products.select("product_id", "category"), "product_id")
    return lines.groupBy("category", month_key(F.col("purchased_at")).alias("month_key")).agg(F.round(F.sum(line_total()), 2).cast("double").alias("revenue"))


def growth_streaks(months: DataFrame, least: int = 3) -> DataFrame:
    """Runs of consecutive months that each beat the row before them. Within a run the month's number and
    its place among the category's growing months rise together, so their difference names the run."""
    order = W.partitionBy("category").orderBy("month_key")
    growing = months.select("category", "month_key", "revenue", (F.col("revenue") > F.lag("revenue").over(order)).alias("grew")).where("grew")
    islands = growing.withColumn("island", F.col("month_key") - F.row_number().over(order))
    ends = islands.groupBy("category", "island").agg(
        F.count("*").alias("streak_length"), F.min("month_key").alias("start"), F.max("month_key").alias("end"), F.min_by("revenue", "month_key").alias("start_revenue"), F.max_by("revenue", "month_key").alias("end_revenue")
    )
    growth = percent_change(F.col("end_revenue"), F.col("start_revenue")).alias("growth_pct")
    return ends.where(F.col("streak_length") >= least).select("category", month_label(F.col("start")).alias("start_month"), month_label(F.col("end")).alias("end_month"), "streak_length", "start_revenue", "end_revenue", growth)


def customer_summary(revenue: DataFrame, inactive_days: int = 180) -> DataFrame:
    """Lifetime figures; active are those whose last order is no older than inactive_days."""
    reference = revenue.agg(F.max("order_date").alias("reference_date"))
    rows = revenue.groupBy("customer_id").agg(F.count_distinct("order_id").alias("total_orders"), F.round(F.sum("revenue"), 2).alias("spend"), F.min("order_date").alias("first_order_date"), F.max("order_date").alias("last_order_date"))
    rows = rows.crossJoin(F.broadcast(reference))  # one row
    return rows.select(
        "customer_id",
        "total_orders",
        F.col("spend").cast("double").alias("total_spend"),
        "first_order_date",
        "last_order_date",
        exact_mean(F.col("spend"), F.col("total_orders")).alias("avg_order_value"),
        (F.col("last_order_date") >= F.date_sub("reference_date", inactive_days)).alias("is_active"),
    )


SUMMARY_METRICS = ("total_orders", "total_spend", "first_order_date", "last_order_date", "avg_order_value", "is_active")


def plan_counts(source: DataFrame, target: DataFrame, key: str = "customer_id", metrics: tuple[str, ...] = SUMMARY_METRICS) -> DataFrame:
    """What a merge would do: inserts, updates and soft deletes, in one pass."""
    old = target.select(F.col(key), F.struct(*metrics).alias("old"))
    both = source.select(F.col(key), F.struct(*metrics).alias("new")).join(old, key, "left")
    count = lambda condition: F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")
    known = F.col("old").isNotNull()
    changed = known & ~F.col("new").eqNullSafe(F.col("old"))
    gone = known & F.coalesce(F.col("old.is_active"), F.lit(False)) & ~F.coalesce(F.col("new.is_active"), F.lit(False))
    return both.agg(count(~known).alias("inserts"), count(changed).alias("updates"), count(gone).alias("soft_deletes"))


def seller_months(orders: DataFrame, items: DataFrame, sellers: DataFrame, status: str = "F", promise_days: int = 30) -> DataFrame:
    """Sellers by month: revenue, orders, days to ship and late share (both over lines), and ranks.
    The late share skips lines without a shipping date."""
    lines = items.join(orders.where(F.col("status") == status).select("order_id", "purchased_at"), "order_id").join(sellers.select("seller_id", "state"), "seller_id")
    days = F.datediff("shipped_at", "purchased_at")
    rows = lines.groupBy("seller_id", "state", F.to_date(F.date_trunc("month", "purchased_at")).alias("month")).agg(
        F.round(F.sum(line_total()), 2).cast("double").alias("revenue"),
        F.count_distinct("order_id").alias("order_count"),
        F.round(F.sum(days) / F.count(days), 2).alias("avg_delivery_days"),
        F.round(F.avg((days > promise_days).cast("int")), 4).alias("late_rate"),
    )
    best = F.desc("revenue")
    return rows.withColumns({"rank_overall": F.rank().over(W.partitionBy("month").orderBy(best)), "rank_in_state": F.rank().over(W.partitionBy("month", "state").orderBy(best))})


def top_sellers(months: DataFrame, year: int, month: int, limit: int = 5) -> DataFrame:
    return month_slice(months, year, month, "month").orderBy("rank_overall", "seller_id").limit(limit)


def seller_days(orders: DataFrame, items: DataFrame, sellers: DataFrame, status: str = "F") -> DataFrame:
    """Revenue by seller, state and day."""
    lines = items.join(orders.where(F.col("status") == status).select("order_id", F.to_date("purchased_at").alias("order_date")), "order_id").join(sellers.select("seller_id", "state"), "seller_id")
    return lines.groupBy("seller_id", "state", "order_date").agg(F.round(F.sum(line_total()), 2).cast("double").alias("revenue"))


def without_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of the left table whose key the right one lacks; a null key has no match."""
    return left.join(right.select(key), key, "left_anti")


def top_orders(revenue: DataFrame, customers: DataFrame, limit: int = 10) -> DataFrame:
    """The dearest orders with their customers; the limit comes before the join."""
    top = revenue.orderBy(F.desc("revenue"), "order_id").limit(limit)
    return top.join(customers.select("customer_id", "name", "state"), "customer_id").select("order_id", "customer_id", "name", "state", "order_date", F.round("revenue", 2).cast("double").alias("revenue"))


#: The business questions: text, kind of join, and why it is the right one.
QUESTIONS = (
    ("How many orders have no matching customer?", "left_anti", "Only orders whose key the customers lack are wanted, and no column of theirs."),
    ("How many sellers have never sold anything?", "left_anti", "Only sellers whose key the lines lack are wanted; repeated lines change nothing."),
    ("Which orders are the dearest?", "inner", "An order is shown with its customer; the limit comes before the join, which so has few rows."),
    ("How many customers order in both populations?", "left_semi", "A customer counts once however many orders match."),
)


def business_questions(orders: DataFrame, late_orders: DataFrame, items: DataFrame, customers: DataFrame, sellers: DataFrame, revenue: DataFrame, limit: int = 10) -> DataFrame:
    """A row for each question: its number, text, kind of join, why, and the answer (for the dearest orders
    how many are shown and the first one's order_id)."""
    top = top_orders(revenue, customers, limit)
    answers = (
        without_match(all_orders(orders, late_orders), customers, "customer_id").agg(F.count_distinct("order_id").cast("string")),
        without_match(sellers, items, "seller_id").agg(F.count("*").cast("string")),
        top.agg(F.concat_ws(":", F.count("*").cast("string"), F.max_by("order_id", F.struct("revenue", -F.col("order_id"))).cast("string"))),
        in_both(orders, late_orders, "customer_id").agg(F.count("*").cast("string")),
    )
    out = None
    for n, ((text, join, why), answer) in enumerate(zip(QUESTIONS, answers), 1):
        row = answer.toDF("answer").select(F.lit(n).alias("id"), F.lit(text).alias("question"), F.lit(join).alias("join_type"), F.lit(why).alias("justification"), "answer")
        out = row if out is None else out.unionByName(row)
    return out


def without_revenue(revenue: DataFrame) -> DataFrame:
    """Delivered orders that a test of the marts refuses: their revenue isn't positive."""
    return revenue.where(F.coalesce(F.col("revenue"), F.lit(0)) <= 0)


def in_both(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys that both tables have."""
    return left.select(key).join(right.select(key), key, "left_semi").distinct()
