"""Dashboard queries, as SQL over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DASHBOARDS = {
    "monthly_revenue": """
        SELECT d.year_month, CAST(round(sum(f.total_amount), 2) AS DOUBLE) AS revenue, count(DISTINCT f.order_id) AS order_count
        FROM {fact_sales} f JOIN {dim_dates} d ON f.date_key = d.date_key GROUP BY d.year_month""",
    "top_states": """
        SELECT c.state, CAST(round(sum(f.total_amount), 2) AS DOUBLE) AS revenue, count(DISTINCT f.order_id) AS order_count
        FROM {fact_sales} f JOIN {dim_customers} c ON f.customer_sk = c.customer_sk AND c.is_current = true
        GROUP BY c.state ORDER BY revenue DESC, c.state LIMIT 10""",
    "late_rate": """
        SELECT d.year_month, count(*) AS line_count, round(avg(CASE WHEN f.is_late THEN CAST(100 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 2) AS late_pct
        FROM {fact_sales} f JOIN {dim_dates} d ON f.date_key = d.date_key GROUP BY d.year_month""",
    "top_categories": """
        SELECT p.category, CAST(round(sum(f.total_amount), 2) AS DOUBLE) AS revenue, count(*) AS line_count
        FROM {fact_sales} f JOIN {dim_products} p ON f.product_sk = p.product_sk
        GROUP BY p.category ORDER BY revenue DESC, p.category LIMIT 10""",
    "top_sellers": """
        SELECT s.seller_id, s.state, CAST(round(sum(f.total_amount), 2) AS DOUBLE) AS revenue, count(DISTINCT f.order_id) AS order_count
        FROM {fact_sales} f JOIN {dim_sellers} s ON f.seller_sk = s.seller_sk
        GROUP BY s.seller_id, s.state ORDER BY revenue DESC, s.seller_id LIMIT 10""",
}


def dashboards(spark: SparkSession, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All five datasets; tables are handed to SQL by name, without global views."""
    return {name: dashboard(spark, name, tables) for name in DASHBOARDS}


def dashboard(spark: SparkSession, name: str, tables: dict[str, DataFrame]) -> DataFrame:
    text = DASHBOARDS[name]
    return spark.sql(text, **{t: df for t, df in tables.items() if f"{{{t}}}" in text})
