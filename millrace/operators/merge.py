"""Keyed merge as one full outer join, and what is built on it: change data, type 1 and 2 dimensions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.types import fits


def _always() -> Column:
    return F.lit(True)


@dataclass(frozen=True)
class Clauses:
    """What happens to a matched row and to a source row without match. Conditions see the target's
    columns as ``t.name`` and the source's as ``s.name``; None stands for never.

    delete: matched rows to delete. update: matched rows to update. insert: new rows to insert.
    columns: those that an update sets (all but the key if None). values: expressions for some of
    them in place of the source's column. helpers: source columns that the target doesn't have."""

    delete: Column | None = None
    update: Column | None = None
    insert: Column | None = None
    columns: tuple[str, ...] | None = None
    values: dict[str, Column] = field(default_factory=dict)
    helpers: tuple[str, ...] = ()


def upsert(**more) -> Clauses:
    return Clauses(update=_always(), insert=_always(), **more)


def insert_only(**more) -> Clauses:
    return Clauses(insert=_always(), **more)


def update_only(condition: Column | None = None, **more) -> Clauses:
    return Clauses(update=_always() if condition is None else condition, **more)


def upsert_changed(columns: Sequence[str], **more) -> Clauses:
    """Updates only rows of which one of the columns differs, nulls compared as values."""
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"t.{c}").eqNullSafe(F.col(f"s.{c}"))
    return Clauses(update=~same, insert=_always(), **more)


def merge_rows(target: DataFrame, source: DataFrame, on: Sequence[str], clauses: Clauses) -> DataFrame:
    """The target after the merge. A source key that occurs twice is an error if a clause would use it,
    as it would update one row twice; null keys match nothing. So is a source column whose values the
    target's type doesn't hold."""
    names = target.columns
    for c in names:
        if c in source.columns and c not in clauses.values and not fits(source.schema[c].dataType, target.schema[c].dataType):
            raise ValueError(f"{c} is {target.schema[c].dataType.simpleString()} and doesn't hold {source.schema[c].dataType.simpleString()}")
    source = source.withColumn("__copies", F.count("*").over(W.partitionBy(*on)))
    t = target.withColumn("__t", F.lit(True)).alias("t")
    s = source.withColumn("__s", F.lit(True)).alias("s")
    both = t.join(s, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in on], "full_outer")
    matched = F.col("t.__t") & F.col("s.__s")
    new = F.col("t.__t").isNull()
    never = F.lit(False)
    holds = lambda c: F.coalesce(c, never) if c is not None else never
    delete = F.coalesce(matched, never) & holds(clauses.delete)
    update = F.coalesce(matched, never) & ~delete & holds(clauses.update)
    insert = new & holds(clauses.insert)
    ambiguous = F.coalesce(matched, never) & (F.col("s.__copies") > 1)
    setting = set(clauses.columns if clauses.columns is not None else [c for c in names if c not in on])
    out = []
    for c in names:
        given = clauses.values.get(c, F.col(f"s.{c}") if c in source.columns else None)
        kind = target.schema[c].dataType
        taken = (given if given is not None else F.lit(None)).cast(kind)
        kept = F.col(f"t.{c}")
        out.append(F.when(insert, taken).when(update, taken if c in setting and given is not None else kept).otherwise(kept).alias(c))
    checked = F.when(ambiguous, F.raise_error(F.lit("a row of the target matches several rows of the source"))).otherwise(F.when(new, insert).otherwise(~delete))
    return both.where(checked.cast("boolean")).select(*out)


def change_data(counts: dict[str, int], customers: DataFrame, key: str = "customer_id", city: str = "name") -> DataFrame:
    """A batch of changes: the first ids deleted (their key only), the next updated, some inserted."""
    d, u, i = counts["delete"], counts["update"], counts["insert"]
    first = customers.orderBy(key).limit(d + u).withColumn("__n", F.row_number().over(W.orderBy(key)))
    others = [c for c in customers.columns if c != key]
    null = lambda c: F.lit(None).cast(customers.schema[c].dataType).alias(c)
    deletes = first.where(F.col("__n") <= d).select(key, *map(null, others), F.lit("delete").alias("cdc_operation"))
    updates = first.where(F.col("__n") > d).select(key, *((F.concat(city, F.lit(" (CDC Updated)")) if c == city else F.col(c)).alias(c) for c in others), F.lit("update").alias("cdc_operation"))
    spark = customers.sparkSession
    inserts = spark.range(1, i + 1).select((-F.col("id")).cast(customers.schema[key].dataType).alias(key), *((F.concat(F.lit("cdc-insert-"), F.lower(F.hex("id"))).alias(c) if c == city else null(c)) for c in others), F.lit("insert").alias("cdc_operation"))
    return deletes.unionByName(updates).unionByName(inserts)


def cdc_clauses(mutable: Sequence[str]) -> Clauses:
    """delete, update and insert as the batch's cdc_operation says."""
    op = F.col("s.cdc_operation")
    return Clauses(delete=op == "delete", update=op == "update", insert=op == "insert", columns=tuple(mutable), helpers=("cdc_operation",))


def cdc_report(before: DataFrame, after: DataFrame, batch: DataFrame, key: str = "customer_id") -> DataFrame:
    """Rows before and after, changes by kind, and whether they add up."""
    kind = lambda name: F.sum((F.col("cdc_operation") == name).cast("long")).alias(name)
    counts = batch.agg(kind("insert"), kind("update"), kind("delete"))
    rows = before.agg(F.count("*").alias("rows_before")).crossJoin(after.agg(F.count("*").alias("rows_after"))).crossJoin(counts)  # one row each
    return rows.withColumn("adds_up", F.col("rows_after") == F.col("rows_before") + F.col("insert") - F.col("delete"))


# type 2 dimensions: versions of a customer, one of them current

VERSION_COLUMNS = ("customer_sk", "customer_id", "name", "state", "version", "is_current", "valid_from", "valid_to")


def first_versions(customers: DataFrame, used_ids: DataFrame, start: str = "1992-01-01") -> DataFrame:
    """Version 1 of every customer, with stubs for ids that orders use and the source lacks."""
    from .star import key_by_rank

    stubs = used_ids.where("customer_id is not null").distinct().join(customers.select("customer_id"), "customer_id", "left_anti").select("customer_id", F.lit("UNKNOWN").alias("name"), F.lit("UN").alias("state"))
    rows = key_by_rank(customers.select("customer_id", "name", "state").unionByName(stubs), "customer_id", "customer_sk")
    return rows.select(
        F.col("customer_sk").cast("long").alias("customer_sk"), "customer_id", "name", "state", F.lit(1).alias("version"), F.lit(True).alias("is_current"), F.lit(start).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to")
    )


def complete_versions(dim: DataFrame, used_ids: DataFrame, start: str = "1992-01-01") -> DataFrame:
    """The dimension with a first version for ids that orders use and it lacks; keys go on from the greatest."""
    from .star import key_by_rank

    top = dim.agg(F.coalesce(F.max("customer_sk"), F.lit(0))).first()[0]
    missing = used_ids.where("customer_id is not null").select("customer_id").distinct().join(dim.select("customer_id"), "customer_id", "left_anti")
    stubs = key_by_rank(missing, "customer_id", "customer_sk", after=top)
    fill = {"name": F.lit("UNKNOWN"), "state": F.lit("UN"), "version": F.lit(1), "is_current": F.lit(True), "valid_from": F.lit(start).cast("date"), "valid_to": F.lit(None).cast("date")}
    return dim.unionByName(stubs.withColumns(fill).select(*dim.columns))


def next_versions(dim: DataFrame, changes: DataFrame, as_of: str) -> DataFrame:
    """The dimension after changes (customer_id and new values): the current version is closed and
    the next begins; its key follows the greatest one, in order of customer_id. A customer whose changes are
    listed twice is an error, as which one holds isn't known."""
    from .star import key_by_rank

    today = F.lit(as_of).cast("date")
    top = dim.agg(F.coalesce(F.max("customer_sk"), F.lit(0))).first()[0]
    attributes = [c for c in ("name", "state") if c in changes.columns]
    twice = F.raise_error(F.concat(F.lit("changes of customer "), F.col("customer_id").cast("string"), F.lit(" are listed twice")))
    changes = changes.groupBy("customer_id").agg(F.count("*").alias("__n"), *(F.first(c).alias(c) for c in attributes)).where(F.when(F.col("__n") > 1, twice.cast("boolean")).otherwise(F.lit(True)))
    new = changes.select("customer_id", *(F.col(c).alias(f"__{c}") for c in attributes))
    hit = dim.where("is_current").join(new, "customer_id")
    opened = key_by_rank(hit.drop("customer_sk"), "customer_id", "customer_sk", after=top).select(
        "customer_sk", "customer_id", *(F.coalesce(f"__{c}", c).alias(c) if c in attributes else F.col(c) for c in ("name", "state")), (F.col("version") + 1).alias("version"), F.lit(True).alias("is_current"), today.alias("valid_from"), F.lit(None).cast("date").alias("valid_to")
    )
    closing = dim.join(changes.select("customer_id", F.lit(True).alias("__hit")).distinct(), "customer_id", "left")
    close = F.coalesce("__hit", F.lit(False)) & F.col("is_current")
    closed = closing.withColumns({"valid_to": F.when(close, today).otherwise(F.col("valid_to")), "is_current": F.col("is_current") & ~close}).select(*dim.columns)
    return closed.unionByName(opened.select(*dim.columns))


def refresh_versions(dim: DataFrame, customers: DataFrame, used_ids: DataFrame, as_of: str, start: str = "1992-01-01") -> DataFrame:
    """A stored dimension brought up to date: customers it lacks get their first version (a stub for ids that only
    orders have), those whose name or state differs from their current version get the next, and each
    customer is left with one current version. All other rows, and all keys, stay as they are."""
    from .star import key_by_rank

    own = customers.select("customer_id", "name", "state")
    known = dim.select("customer_id").distinct()
    stubs = used_ids.where("customer_id is not null").select("customer_id").distinct().join(own.select("customer_id"), "customer_id", "left_anti")
    rows = own.unionByName(stubs.withColumns({"name": F.lit("UNKNOWN"), "state": F.lit("UN")})).join(known, "customer_id", "left_anti")
    top = dim.agg(F.coalesce(F.max("customer_sk"), F.lit(0))).first()[0]
    fill = {"version": F.lit(1), "is_current": F.lit(True), "valid_from": F.lit(start).cast("date"), "valid_to": F.lit(None).cast("date")}
    first = key_by_rank(rows, "customer_id", "customer_sk", after=top).withColumns(fill).select(*dim.columns)
    new = own.select("customer_id", F.col("name").alias("__name"), F.col("state").alias("__state"))
    differs = ~(F.col("name").eqNullSafe(F.col("__name")) & F.col("state").eqNullSafe(F.col("__state")))
    changes = one_current(dim).where("is_current").join(new, "customer_id").where(differs).select("customer_id", F.col("__name").alias("name"), F.col("__state").alias("state"))
    return next_versions(one_current(dim).unionByName(first), changes, as_of)


def one_current(dim: DataFrame) -> DataFrame:
    """Exactly one current version for each customer: the highest. One that is raised loses its end;
    those that are lowered keep theirs."""
    by = W.partitionBy("customer_id")
    n = F.sum(F.col("is_current").cast("int")).over(by)
    last = F.row_number().over(by.orderBy(F.desc("version"), F.desc("customer_sk"))) == 1
    raised = (n == 0) & last
    current = F.when(n == 0, last).when(n > 1, F.col("is_current") & (F.max(F.when(F.col("is_current"), F.col("version"))).over(by) == F.col("version"))).otherwise(F.col("is_current"))
    return dim.withColumns({"__current": current, "__raised": raised}).withColumns({"is_current": F.col("__current"), "valid_to": F.when(F.col("__raised"), F.lit(None).cast("date")).otherwise(F.col("valid_to"))}).drop("__current", "__raised")


def version_history(dim: DataFrame, customer_id: object) -> DataFrame:
    return dim.where(F.col("customer_id") == customer_id).orderBy("version")
