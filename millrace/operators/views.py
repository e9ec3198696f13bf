"""Views: masked, filtered by reader, and materialised in the table store, in whole or by what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import exact_mean, masked
from ..sources.store import TableStore
from .merge import Clauses, insert_only


def masked_customers(customers: DataFrame, columns: tuple[str, ...] = ("name",)) -> DataFrame:
    return customers.withColumns({c: masked(F.col(c)) for c in columns})


def allowed_rows(fact: DataFrame, customers: DataFrame, access: DataFrame, user: str | None = None) -> DataFrame:
    """Fact rows of customers in the states that a user may see, the one who asks unless named; none
    without an entry. A row shows once however often a state is granted."""
    states = access.where(F.col("user_email") == (F.current_user() if user is None else F.lit(user))).select(F.col("allowed_state").alias("state"))
    seen = customers.where("is_current").join(states, "state", "left_semi").select("customer_sk", "state")
    return fact.join(seen, "customer_sk")


def grant(store: TableStore, rows: DataFrame | list[tuple[str, str]], name: str = "user_state_access") -> None:
    """Adds grants (user_email, allowed_state) that are not there yet."""
    new = (rows if isinstance(rows, DataFrame) else store.spark.createDataFrame(rows, "user_email string, allowed_state string")).distinct()
    store.merge(name, new, ["user_email", "allowed_state"], insert_only())


def secure_views(fact: DataFrame, customers: DataFrame, access: DataFrame, prefix: str = "secure") -> tuple[str, str]:
    """Creates or replaces two views of the session, customers masked and the fact filtered by who asks,
    and returns their names."""
    names = (f"{prefix}_customers", f"{prefix}_fact_sales")
    masked_customers(customers).createOrReplaceTempView(names[0])
    allowed_rows(fact, customers, access).createOrReplaceTempView(names[1])
    return names


class Materialized:
    """A query kept as a table of the store, brought up to date by refresh()."""

    def __init__(self, store: TableStore, name: str, query):
        self.store, self.name, self.query = store, name, query

    def refresh(self) -> int:
        return self.store.overwrite(self.name, self.query(), operation="REFRESH")

    def read(self) -> DataFrame:
        if not self.store.exists(self.name):
            self.refresh()
        return self.store.read(self.name)


class Incremental:
    """Counts and exact sums by group, kept in the store and brought up to date from what changed in their source.

    ``measures`` are whole or decimal expressions (sums of doubles depend on the order of rows). A refresh reads
    the files that the source's version and the one last seen don't share, adds up their rows with a sign (rows
    that were only moved cancel out), and merges the sums into the groups they concern; a group without rows
    goes. The version seen is part of the merge's commit, so a refresh that fails is repeated as it was. If
    the version seen is no longer there, all rows are read."""

    def __init__(self, store: TableStore, name: str, source: str, keys: tuple[str, ...], measures: dict[str, Column], where: Column | None = None):
        self.store, self.name, self.source, self.keys, self.measures, self.where = store, name, source, keys, measures, where

    def _sums(self, rows: DataFrame) -> DataFrame:
        rows = rows if self.where is None else rows.where(self.where)
        group = [F.col(f"`{k}`") for k in self.keys]
        total = lambda c: F.sum(F.col("__sign") * F.coalesce(c.cast("decimal(24,4)"), F.lit(0))).cast("decimal(38,4)")
        sums = [a for m, c in self.measures.items() for a in (F.sum(F.when(c.isNotNull(), F.col("__sign")).otherwise(0)).alias(f"n_{m}"), total(c).alias(f"sum_{m}"))]
        grouped = rows.groupBy(*group).agg(F.sum("__sign").alias("n"), *sums)
        return grouped.withColumn("view_key", F.to_json(F.struct(*group)))

    def refresh(self) -> dict:
        """Which versions the refresh went from and to, and how many files it read."""
        now = self.store.version(self.source)
        signed = lambda paths, sign: self.store.open_files(self.source, now, paths).withColumn("__sign", F.lit(sign).cast("long"))
        seen = self.store.last_metrics(self.name, lambda m: "source_version" in m) if self.store.exists(self.name) else None
        marks = {"source_version": now.number}
        try:
            gone, come = self.store.differing(self.source, seen["source_version"], now.number) if seen else ([], None)
        except KeyError:  # vacuumed
            seen, come = None, None
        if come is None:
            paths = self.store.paths(self.source, now.number)
            self.store.overwrite(self.name, self._sums(signed(paths, 1)), operation="REFRESH", metrics=marks)
            return {"since": None, "until": now.number, "files_read": len(paths)}
        if gone or come:
            delta = self._sums(signed(gone, -1).unionByName(signed(come, 1)))
            numbers = [c for c in delta.columns if c not in (*self.keys, "view_key")]
            moved = F.lit(False)
            for c in numbers:
                moved = moved | (F.col(c) != 0)
            both = lambda c: F.coalesce(F.col(f"t.{c}"), F.lit(0)) + F.col(f"s.{c}")
            clauses = Clauses(delete=both("n") == 0, update=F.lit(True), insert=F.col("s.n") != 0, columns=tuple(numbers), values={c: both(c) for c in numbers})
            self.store.merge(self.name, delta.where(moved), ["view_key"], clauses, metrics=marks, attempts=1)
        return {"since": seen["source_version"], "until": now.number, "files_read": len(gone) + len(come)}

    def read(self) -> DataFrame:
        """The groups: n rows, and of each measure its sum and mean (null where no value was)."""
        some = lambda m, c: F.when(F.col(f"n_{m}") > 0, c)
        out = [x for m in self.measures for x in (some(m, F.col(f"sum_{m}")).alias(m), some(m, exact_mean(F.col(f"sum_{m}"), F.col(f"n_{m}"))).alias(f"avg_{m}"))]
        return self.store.read(self.name).select(*self.keys, "n", *out)
