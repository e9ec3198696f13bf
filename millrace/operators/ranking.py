"""Numbers over a whole table's order, without a task that sees the whole table.

Rows are dealt to ranges of the order, as many as the session has shuffle partitions, sorted there and written with their
places; a range's size moves those after it. The tie-breaker is part of the order, so a value that many rows
share is cut like any other. Several orders are one pass: each row is dealt once for each of them, all in one shuffle,
and its numbers meet by the tie-breaker. What is written is dealt once, so sizes and places agree whatever is
computed again.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import written

#: Rows of the sample, which bounds what comes to the driver, and bounds of each order.
SAMPLE, BOUNDS = 2048, 256


def sample_bounds(df: DataFrame, columns: Sequence[Column], seed: Sequence[Column], bounds: int = BOUNDS) -> list[list]:
    """For each column up to ``bounds`` values, sorted and with repeats, that cut it into equal parts."""
    named = [c.alias(f"c{i}") for i, c in enumerate(columns)]
    rows = df.select(*named, F.xxhash64(*seed).alias("__hash")).orderBy("__hash").limit(SAMPLE).collect()
    out = []
    for i in range(len(columns)):
        values = sorted(r[i] for r in rows if r[i] is not None)
        out.append([values[len(values) * k // (bounds + 1)] for k in range(1, bounds + 1)] if values else [])
    return out


def below(value: Column, bounds: Sequence) -> Column:
    """How many of the bounds are less; 0 for null, which is first."""
    return F.coalesce(F.size(F.filter(_array(bounds), lambda b: b < value)), F.lit(0)) if bounds else F.lit(0)


def _array(values: Sequence) -> Column:
    """The values as one constant: a text that is parsed when the query is planned, where each literal of its
    own would take a call to the JVM."""
    kinds = {type(v) for v in values}
    if kinds == {Decimal}:
        kind, text = f"decimal(38,{max(-v.as_tuple().exponent for v in values)})", "[" + ",".join(f"{v:f}" for v in values) + "]"
    elif kinds in ({int}, {str}):
        kind, text = "bigint" if kinds == {int} else "string", json.dumps(values)
    else:
        return F.array(*map(F.lit, values))
    return F.from_json(F.lit(text), f"array<{kind}>")


def with_ranks(df: DataFrame, tie: str, orders: Mapping[str, Column]) -> DataFrame:
    """Adds, for each name, the row's number from 1 in ascending order of that column (nulls first) and then
    of ``tie``; and ``__rows``, how many rows there are. Several orders need a unique ``tie``, and are one pass if
    they are whole or decimal numbers, else one after the other."""
    names = list(orders)
    kinds = [f.dataType for f in df.select(*(orders[n].alias(n) for n in names)).schema]
    if len(names) > 1 and not all(isinstance(k, (T.IntegralType, T.DecimalType)) and getattr(k, "scale", 0) <= 6 for k in kinds):
        out = df
        for n in names:
            out = with_ranks(out.drop("__rows"), tie, {n: orders[n]})
        return out
    value = lambda n: orders[n].cast("decimal(38,6)") if len(names) > 1 else orders[n]
    each = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(tie).alias("tie"), F.explode(F.array(*[F.struct(F.lit(i).alias("o"), value(n).alias("v")) for i, n in enumerate(names)])).alias("x"))
    each = each.select("tie", "x.o", "x.v", F.when(F.col("x.o") == 0, F.col("row")).alias("row"))
    order = [F.col("o"), F.col("v").asc_nulls_first(), F.col("tie").asc_nulls_first()]
    number = each.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    dealt = written(number.select("tie", "o", "row", F.shiftright("at", 33).alias("range"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "ranks")
    sizes = dealt.groupBy("o", "range").agg(F.count("*").alias("n"), F.min("place").alias("low")).orderBy("o", "range").collect()  # a row for each range
    before, at = [], {}
    for r in sizes:
        before.append((r["o"], r["range"], at.get(r["o"], 0) - r["low"] + 1))
        at[r["o"]] = at.get(r["o"], 0) + r["n"]
    offsets = df.sparkSession.createDataFrame(before, "o int, range long, __before long")
    ranked = dealt.join(F.broadcast(offsets), ["o", "range"]).withColumn("rank", F.col("place") + F.col("__before"))
    rows = F.lit(at.get(0, 0)).cast("long").alias("__rows")
    if len(names) == 1:
        return ranked.select("row.*", rows, F.col("rank").alias(names[0]))
    found = ranked.groupBy("tie").agg(F.first("row", ignorenulls=True).alias("row"), *(F.max(F.when(F.col("o") == i, F.col("rank"))).alias(n) for i, n in enumerate(names)))
    return found.select("row.*", rows, *names)


def tile(rank: Column, rows: Column, tiles: int) -> Column:
    """The tile of a rank if rows are dealt to ``tiles`` of equal size, the first ones a row larger."""
    size, larger = F.floor(rows / tiles), rows % tiles
    edge = larger * (size + 1)
    early = F.floor((rank - 1) / (size + 1)) + 1
    late = larger + F.floor((rank - 1 - edge) / F.greatest(size, F.lit(1))) + 1
    return F.when(rank <= edge, early).otherwise(late).cast("int")
