"""Column expressions that several operators share. All are built-in functions: no UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,4)"


def money(amount: Column) -> Column:
    """An amount as an exact decimal, so that sums don't depend on the order of rows."""
    return amount.cast(MONEY)


def money_sum(amount: Column, places: int = 2) -> Column:
    """Exact sum of amounts, rounded once at the end."""
    return F.round(F.sum(money(amount)), places).cast("double")


def exact_mean(total: Column, n: Column, places: int = 2) -> Column:
    """A decimal total over a count, divided exactly before it is rounded half up."""
    return F.round(total.cast("decimal(24,4)") / n.cast("decimal(10,0)"), places).cast("double")


def share(condition: Column, places: int = 4, scale: float = 1.0) -> Column:
    """Share of rows for which the condition holds; null counts as not."""
    return F.round(F.avg(F.when(condition, F.lit(scale)).otherwise(F.lit(0.0))), places)


def timestamp(text: Column) -> Column:
    """A timestamp, or null where the text is none (dirty input must not stop a job)."""
    return F.try_to_timestamp(text)


def arrival_status(ingested_at: Column, event_at: Column, on_time: int = 7, late: int = 30) -> Column:
    """on_time within a week, late_arriving within 30 days, else very_late (as where a time is missing)."""
    delay = F.datediff(ingested_at, event_at)
    return F.when(delay <= on_time, "on_time").when(delay <= late, "late_arriving").otherwise("very_late")


def hours_between(later: Column, earlier: Column, places: int = 2) -> Column:
    return F.round((later.cast("timestamp").cast("long") - earlier.cast("timestamp").cast("long")) / F.lit(3600.0), places)


def month_key(day: Column) -> Column:
    """Months since year 0, so that neighbouring months differ by one across years."""
    return F.year(day) * 12 + F.month(day)


def month_label(key: Column) -> Column:
    """YYYY-MM of a month_key."""
    return F.format_string("%d-%02d", F.floor((key - 1) / 12).cast("int"), ((key - 1) % 12 + 1).cast("int"))


def date_key(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd").cast("int")


def title(text: Column) -> Column:
    return F.initcap(F.trim(text))


def code(text: Column) -> Column:
    return F.upper(F.trim(text))


def masked(text: Column, shown: int = 3) -> Column:
    """Three stars and the last characters."""
    return F.concat(F.lit("***"), F.substring(text, -shown, shown))


def surrogate(*natural: Column | str, salt: str = "") -> Column:
    """A positive 63-bit key that depends on the natural key only."""
    return F.xxhash64(*natural, F.lit(salt)).bitwiseAND(F.lit((1 << 63) - 1))


def bucket(key: Column, buckets: int) -> Column:
    """A key's bucket by its text, which any engine can work out: MD5's first 32 bits, modulo; null goes with the empty text."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def percent_change(now: Column, before: Column, places: int = 2) -> Column:
    """Null where there is nothing to compare with."""
    return F.when(before != 0, F.round((now - before) / before * 100, places))
