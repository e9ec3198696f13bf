"""The driver's tables under the names that the operators use."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Order status that stands for "delivered".
DELIVERED = "F"


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


class Retail:
    """orders, items (as delivered, repeats and all), customers, sellers and products of a folder.
    A table is opened when it is first asked for, as opening one costs a job."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _get(self, name: str) -> DataFrame:
        return read_table(self.spark, self.path, name)

    @cached_property
    def _places(self) -> DataFrame:
        both = self._get("nation").join(self._get("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return both.select("n_nationkey", F.col("n_name").alias("state"), F.col("r_name").alias("region"))

    @cached_property
    def orders(self) -> DataFrame:
        return self._get("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_orderdate").cast("timestamp").alias("purchased_at"),
            F.col("o_totalprice").alias("total_price"),
            F.col("o_orderpriority").alias("priority"),
        )

    @cached_property
    def items(self) -> DataFrame:
        return self._get("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("item_no"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_extendedprice").alias("price"),
            F.col("l_discount").alias("discount"),
            F.col("l_tax").alias("tax"),
            F.col("l_returnflag").alias("return_flag"),
            F.col("l_shipdate").cast("timestamp").alias("shipped_at"),
        )

    @cached_property
    def customers(self) -> DataFrame:
        rows = self._get("customer").join(self._places, F.col("c_nationkey") == F.col("n_nationkey"))
        return rows.select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"), "state", "region", F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))

    @cached_property
    def sellers(self) -> DataFrame:
        rows = self._get("supplier").join(self._places, F.col("s_nationkey") == F.col("n_nationkey"))
        return rows.select(F.col("s_suppkey").alias("seller_id"), F.col("s_name").alias("name"), "state", "region", F.col("s_acctbal").alias("balance"))

    @cached_property
    def products(self) -> DataFrame:
        return self._get("part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("retail_price"))


def retail(spark: SparkSession, path: str) -> Retail:
    return Retail(spark, path)
