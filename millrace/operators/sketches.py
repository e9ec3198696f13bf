"""Distinct counts and quantiles by day, kept as sketches of Spark's own that any span of days merges.

A day's rows are read once; afterwards a span costs a sketch a day and not its rows. HyperLogLog with 2^LG_K registers
errs by 1.04 / sqrt(2^LG_K) of the count as its standard deviation; a KLL sketch with K keeps ranks within some
2.3 / K of the number of values, with 99 % confidence."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K, K = 12, 800


def daily_sketches(rows: DataFrame, day: str, key: str, value: str, lg_k: int = LG_K, k: int = K) -> DataFrame:
    """day, n, a sketch of the distinct keys and one of the values."""
    return rows.groupBy(F.col(day).cast("date").alias("day")).agg(F.count("*").alias("n"), F.hll_sketch_agg(F.col(key), lg_k).alias("keys"), F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("values"))


def span(sketches: DataFrame, first: str, last: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Rows, distinct keys and quantiles of the days from first to last, from their sketches alone."""
    days = sketches.where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    merged = days.agg(F.sum("n").alias("n"), F.hll_union_agg("keys").alias("keys"), F.kll_merge_agg_double("values").alias("values"))
    quantiles = [F.kll_sketch_get_quantile_double("values", F.lit(s)).alias(f"q{round(100 * s)}") for s in shares]
    return merged.select("n", F.hll_sketch_estimate("keys").alias("distinct_keys"), *quantiles)


def distinct_error(lg_k: int = LG_K) -> float:
    """Three standard deviations of a distinct count, as a share of it."""
    return 3 * 1.04 / math.sqrt(1 << lg_k)
