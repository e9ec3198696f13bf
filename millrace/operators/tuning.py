"""Skew reports, salted joins, join strategies and plan comparisons."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import exact_mean


def key_skew(df: DataFrame, key: str, threshold: float = 3.0) -> DataFrame:
    """Rows of each key, against the mean: factor, percent and whether it is skewed."""
    counts = df.groupBy(key).agg(F.count("*").alias("row_count"))
    total = counts.agg(F.sum("row_count").alias("__total"), F.count("*").alias("__keys"))
    rows = counts.crossJoin(F.broadcast(total))  # one row
    factor = exact_mean(F.col("row_count") * F.col("__keys"), F.col("__total"))
    return rows.select(key, "row_count", factor.alias("skew_factor"), F.round(100 * F.col("row_count") / F.col("__total"), 4).alias("pct_of_total"), (factor >= threshold).alias("is_skewed"))


def top_skewed(df: DataFrame, key: str, limit: int = 10, threshold: float = 3.0) -> DataFrame:
    return key_skew(df, key, threshold).orderBy(F.desc("row_count"), key).limit(limit)


def most_skewed_column(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The greatest factor of each column."""
    parts = [key_skew(df, c).agg(F.lit(c).alias("column_name"), F.max("skew_factor").alias("max_skew")) for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Hot keys that are broadcast at most.
HOT_KEYS = 100_000


def inflate_key(df: DataFrame, key: str, hot: object, times: int) -> DataFrame:
    """Every row of one key ``times`` times, by exploding a sequence; other rows, those without key
    included, stay."""
    n = F.when(F.col(key) == F.lit(hot), F.lit(times)).otherwise(1)
    return df.withColumn("__copy", F.explode(F.sequence(F.lit(1), n))).drop("__copy")


def salted_join_sum(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, row_id: Sequence[str], group: str, value: str, salts: int = 8) -> DataFrame:
    """Sum of ``value`` by ``group`` over an inner join whose hot keys are dealt to ``salts`` tasks.

    Hot keys are those of ``hot``: fewer than all keys by the factor that makes them hot. They are counted
    and then broadcast; HOT_KEYS or more of them are no few hot keys, and adaptive execution is left to split
    what is large. The left rows of a hot key get a salt from their row id, the right ones are repeated for
    every salt; others have salt 0."""
    found = [r[0] for r in hot.select(key).where(F.col(key).isNotNull()).distinct().limit(HOT_KEYS).collect()]
    if not found or len(found) == HOT_KEYS:
        return plain_join_sum(left, right, key, group, value)
    flags = F.broadcast(left.sparkSession.createDataFrame([(k, True) for k in found], f"`{key}` {left.schema[key].dataType.simpleString()}, __hot boolean"))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*row_id), F.lit(salts)).cast("int")).otherwise(0)
    l = left.join(flags, key, "left").withColumn("__salt", salt).drop("__hot")
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    r = right.join(flags, key, "left").withColumn("__salt", F.explode(copies)).drop("__hot")
    return l.join(r, [key, "__salt"]).groupBy(group).agg(F.count("*").alias("line_count"), F.round(F.sum(F.col(value).cast("decimal(18,4)")), 2).cast("double").alias("total"))


def plain_join_sum(left: DataFrame, right: DataFrame, key: str, group: str, value: str, hint: str | None = None) -> DataFrame:
    """The same without salt; adaptive execution splits skewed partitions by itself."""
    r = right.hint(hint) if hint else right
    return left.join(r, key).groupBy(group).agg(F.count("*").alias("line_count"), F.round(F.sum(F.col(value).cast("decimal(18,4)")), 2).cast("double").alias("total"))


def explain(df: DataFrame, mode: str = "formatted") -> str:
    """The plan as text."""
    jvm = df.sparkSession._jvm
    return df._jdf.queryExecution().explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


_STRATEGIES = (("BroadcastHashJoin", "broadcast_hash"), ("BroadcastNestedLoopJoin", "nested_loop"), ("SortMergeJoin", "sort_merge"), ("ShuffledHashJoin", "shuffled_hash"), ("CartesianProduct", "cartesian"))


def join_strategy(plan: str) -> str:
    """The strategy of the outermost join, which the plan names first."""
    found = re.search("|".join(node for node, _ in _STRATEGIES), plan)
    return dict(_STRATEGIES)[found[0]] if found else "none"


def has_shuffle(plan: str) -> bool:
    return bool(re.search(r"(?<!Broadcast)\bExchange\b|ShuffleQueryStage", plan))


def with_strategy(left: DataFrame, right: DataFrame, key: str, strategy: str | None = None) -> DataFrame:
    """A join by a strategy of choice: merge, broadcast, shuffle_hash, or what Spark picks."""
    return left.join(right.hint(strategy) if strategy else right, key)


def seconds(df: DataFrame) -> float:
    """Time to compute every row and column, without storing them."""
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def compare(variants: dict[str, Callable[[], DataFrame]], rounds: int = 3) -> list[dict]:
    """Median time, strategy and shuffle of each variant; they take turns after a warm-up."""
    took: dict[str, list[float]] = {name: [] for name in variants}
    for n in range(rounds + 1):
        for name in list(variants) if n % 2 else reversed(variants):
            t = seconds(variants[name]())
            if n:
                took[name].append(t)
    plans = {name: explain(make()) for name, make in variants.items()}
    return [{"variant": name, "seconds": sorted(t)[len(t) // 2], "strategy": join_strategy(plans[name]), "shuffles": has_shuffle(plans[name])} for name, t in took.items()]


SKEW_SETTINGS = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled", "spark.sql.adaptive.skewJoin.skewedPartitionFactor", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.autoBroadcastJoinThreshold")


def skew_settings(spark: SparkSession) -> dict[str, str | None]:
    return {k: spark.conf.get(k, None) for k in SKEW_SETTINGS}


def set_skew_join(spark: SparkSession, on: bool) -> dict[str, str]:
    """Switches adaptive skew joins; a platform that refuses a setting is told, not fought."""
    out = {}
    for k in SKEW_SETTINGS[:2]:
        try:
            spark.conf.set(k, str(on).lower())
            out[k] = "set"
        except Exception as e:  # noqa: BLE001  any refusal is reported
            out[k] = f"refused: {str(e).splitlines()[0]}"
    return out


def partition_candidates(df: DataFrame, columns: Sequence[str], low: int = 2, high: int = 1000) -> DataFrame:
    """Distinct values of each column, rows for each value, and whether it suits as a partition key."""
    counts = df.agg(F.count("*").alias("n"), *(F.count_distinct(c).alias(f"d{i}") for i, c in enumerate(columns)))
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"d{i}").alias("distinct_values"), F.round(F.col("n") / F.col(f"d{i}"), 2).alias("rows_per_value"), F.col(f"d{i}").between(low, high).alias("suits")) for i, c in enumerate(columns)]
    return counts.select(F.inline(F.array(*rows)))


def antipatterns(orders: DataFrame, items: DataFrame, customers: DataFrame, sellers: DataFrame, state: str, least: float) -> dict[str, tuple[Callable[[], DataFrame], Callable[[], DataFrame]]]:
    """Three pairs of the same question asked the slow way and the quick way: a filter after the
    aggregation or before the join, a forced sort-merge join or Spark's choice, a needless repartition
    or none."""
    count = lambda df, key: df.groupBy(key).agg(F.count("*").alias("n"))
    return {
        "late_filter": (
            lambda: count(orders.join(customers, "customer_id"), "state").where(F.col("state") == state),
            lambda: count(orders.join(customers.where(F.col("state") == state), "customer_id"), "state"),
        ),
        "forced_sort_merge": (
            lambda: count(items.join(sellers.hint("merge"), "seller_id"), "state"),
            lambda: count(items.join(sellers, "seller_id"), "state"),
        ),
        "needless_repartition": (
            lambda: count(items.repartition(200).where(F.col("price") >= least).join(orders, "order_id"), "status"),
            lambda: count(items.where(F.col("price") >= least).join(orders, "order_id"), "status"),
        ),
    }


def speedup(slow: Callable[[], DataFrame], quick: Callable[[], DataFrame], rounds: int = 3) -> dict:
    """Median times of a pair and how many times quicker the quick way is."""
    found = {v["variant"]: v for v in compare({"slow": slow, "quick": quick}, rounds)}
    return {"slow": found["slow"], "quick": found["quick"], "speedup": round(found["slow"]["seconds"] / max(found["quick"]["seconds"], 1e-9), 2)}


def partition_filters(df: DataFrame) -> str:
    """The partition filters that reach the scan, as the plan prints them."""
    return "; ".join(re.findall(r"PartitionFilters: \[([^\]]*)\]", explain(df)))
