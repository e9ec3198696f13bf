"""Nested lines: one row for each order with an array of its lines, and questions over the array,
each as a higher-order function and over the exploded rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import money


def nest(rows: DataFrame, key: str, order: str, fields: tuple[str, ...], value: str) -> DataFrame:
    """Rows of a key as an array of structs, in order, with the exact sum of ``value`` and their number."""
    line = F.struct(order, *(f for f in fields if f != order))
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(line)).alias("lines"), F.round(F.sum(money(F.col(value))), 2).cast("double").alias("total_value"), F.count("*").alias("n_lines"))


def write_nested(store, rows: DataFrame, nested_name: str, flat_name: str, key: str, order: str, fields: tuple[str, ...], value: str) -> dict[str, int]:
    """Writes the nested table and the flat one made from it; returns their row counts."""
    store.overwrite(nested_name, nest(rows, key, order, fields, value))
    store.overwrite(flat_name, flatten(store.read(nested_name), key))
    return {n: store.read(n).count() for n in (nested_name, flat_name)}


def flatten(nested: DataFrame, key: str) -> DataFrame:
    """One row for each line of the array."""
    return nested.select(key, F.inline("lines"))


def nest_report(rows: DataFrame, nested: DataFrame, key: str) -> DataFrame:
    """The invariants: one nested row for each key, one line for each row; share of keys with several."""
    source = rows.agg(F.count_distinct(key).alias("keys"), F.count("*").alias("rows"))
    built = nested.agg(F.count("*").alias("nested_rows"), F.sum("n_lines").alias("lines"), F.round(100 * F.avg((F.col("n_lines") > 1).cast("double")), 2).alias("several_pct"))
    return source.crossJoin(built).withColumns({"keys_match": F.col("keys") == F.col("nested_rows"), "lines_match": F.col("rows") == F.col("lines")})  # one row each


def _wanted(line: Column, kind: str) -> Column:
    return line["kind"] == kind


def dear_nested(nested: DataFrame, key: str, kind: str, above: float) -> DataFrame:
    """Keys with a line of that kind above a value, and how many."""
    return nested.select(key, F.size(F.filter("lines", lambda x: _wanted(x, kind) & (x["value"] > above))).cast("long").alias("n")).where("n > 0")


def dear_exploded(rows: DataFrame, key: str, kind: str, above: float) -> DataFrame:
    return rows.where((F.col("kind") == kind) & (F.col("value") > above)).groupBy(key).agg(F.count("*").alias("n"))


def total_nested(nested: DataFrame, key: str, kind: str) -> DataFrame:
    """The value of all lines of that kind, 0 for keys without one."""
    values = F.transform(F.filter("lines", lambda x: _wanted(x, kind)), lambda x: money(x["value"]).cast("decimal(28,4)"))
    return nested.select(key, F.round(F.aggregate(values, F.lit(0).cast("decimal(28,4)"), lambda a, v: (a + F.coalesce(v, F.lit(0))).cast("decimal(28,4)")), 2).cast("double").alias("total"))


def total_exploded(rows: DataFrame, key: str, kind: str) -> DataFrame:
    """As above, without the keys that have none."""
    return rows.where(F.col("kind") == kind).groupBy(key).agg(F.round(F.sum(money(F.col("value"))), 2).cast("double").alias("total"))


def most_nested(nested: DataFrame, key: str, not_kind: str) -> DataFrame:
    """The greatest count over lines of other kinds, 0 for keys without one."""
    counts = F.transform(F.filter("lines", lambda x: x["kind"] != not_kind), lambda x: x["number"].cast("long"))
    return nested.select(key, F.aggregate(counts, F.lit(0).cast("long"), lambda a, n: F.greatest(a, n)).alias("most"))


def most_exploded(rows: DataFrame, key: str, not_kind: str) -> DataFrame:
    return rows.where(F.col("kind") != not_kind).groupBy(key).agg(F.max(F.col("number").cast("long")).alias("most"))
