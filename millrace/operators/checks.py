"""Data quality: rules, failing rows, dead letters, reconciliation and schema contracts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import bucket


@dataclass(frozen=True)
class Rule:
    """kind: not_null, unique, accepted_values, referential or range."""

    name: str
    kind: str
    column: str
    severity: str = "critical"
    values: tuple = ()
    low: float | None = None
    high: float | None = None
    other: DataFrame | None = None
    other_column: str | None = None


#: The order statuses that the rules accept.
ORDER_STATUSES = ("delivered", "shipped", "processing", "invoiced", "created", "approved", "unavailable", "canceled")


def order_rules(customers: DataFrame) -> list[Rule]:
    return [
        Rule("order_id_not_null", "not_null", "order_id"),
        Rule("customer_id_not_null", "not_null", "customer_id"),
        Rule("purchase_timestamp_not_null", "not_null", "order_purchase_timestamp"),
        Rule("order_id_unique", "unique", "order_id"),
        Rule("customer_exists", "referential", "customer_id", other=customers, other_column="customer_id"),
        Rule("status_accepted", "accepted_values", "order_status", "warning", values=ORDER_STATUSES),
    ]


#: Tasks that rows without a value are dealt to where they are equal to each other.
NULL_PARTS = 32


def failing(df: DataFrame, rule: Rule) -> Column | None:
    """The rule as a condition on a row, or None if it takes other rows to tell."""
    c = F.col(rule.column)
    if rule.kind == "not_null":
        return c.isNull()
    if rule.kind == "accepted_values":
        return c.isNull() | ~c.isin(*rule.values)
    if rule.kind == "range":
        low = c < rule.low if rule.low is not None else F.lit(False)
        high = c > rule.high if rule.high is not None else F.lit(False)
        return F.coalesce(low | high, F.lit(False))
    return None


def marked(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rows with a column __fail_<n> for each rule. Rules that look at a row alone cost no job of
    their own; a unique rule is a join with the keys that occur twice, where nulls are equal to each other but
    dealt to NULL_PARTS tasks, and a referential rule a join with the distinct keys."""
    out = df
    for n, rule in enumerate(rules):
        own = failing(df, rule)
        if rule.kind == "unique":
            column = F.col(rule.column)
            part = F.when(column.isNull(), F.pmod(F.xxhash64(*df.columns), F.lit(NULL_PARTS)).cast("int")).otherwise(0)
            twice = df.groupBy(column.alias("__key")).agg(F.count("*").alias("__n")).where("__n > 1")
            parts = F.when(F.col("__key").isNull(), F.sequence(F.lit(0), F.lit(NULL_PARTS - 1))).otherwise(F.array(F.lit(0)))
            twice = twice.select("__key", F.explode(parts).alias("__part"), F.lit(True).alias("__found"))
            out = out.withColumn("__own_part", part).join(twice, column.eqNullSafe(F.col("__key")) & (F.col("__own_part") == F.col("__part")), "left").drop("__key", "__part", "__own_part")
            own = F.col("__found").isNotNull()
        elif rule.kind == "referential":
            keys = rule.other.select(F.col(rule.other_column).alias("__key")).where("__key is not null").distinct().withColumn("__found", F.lit(True))
            out = out.join(keys, F.col(rule.column) == F.col("__key"), "left").drop("__key")
            own = F.col("__found").isNull()
        out = out.withColumn(f"__fail_{n}", own)
        out = out.drop("__found")
    return out


def _outcomes(rows: DataFrame, rules: Sequence[Rule], fails: Sequence[Column]) -> DataFrame:
    sums = rows.agg(F.count("*").alias("total"), *(F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(f"f{n}") for n, c in enumerate(fails)))
    lines = [F.struct(F.lit(r.name).alias("rule"), F.lit(r.kind).alias("kind"), F.lit(r.column).alias("column_name"), F.lit(r.severity).alias("severity"), F.col("total"), F.col(f"f{n}").alias("failed")) for n, r in enumerate(rules)]
    out = sums.select(F.inline(F.array(*lines)))
    pct = F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.round(100 * F.col("failed") / F.col("total"), 4))
    return out.withColumns({"failure_pct": pct, "passed": F.col("failed") == 0})


def results(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """A row for each rule: totals, failures, percent and whether it passed. One pass over the rows."""
    return _outcomes(marked(df, rules), rules, [F.col(f"__fail_{n}") for n in range(len(rules))])


def status(outcome: DataFrame) -> DataFrame:
    """FAILED iff a critical rule failed."""
    bad = F.coalesce(F.max(((F.col("severity") == "critical") & ~F.col("passed")).cast("int")), F.lit(0))
    return outcome.agg(F.when(bad == 1, "FAILED").otherwise("PASSED").alias("status"), F.sum((~F.col("passed")).cast("long")).alias("failed_rules"))


def _any_fail(rules: Sequence[Rule], severities: Sequence[str]) -> Column:
    out = F.lit(False)
    for n, r in enumerate(rules):
        if r.severity in severities:
            out = out | F.col(f"__fail_{n}")
    return out


def failed_rows(df: DataFrame, rules: Sequence[Rule], severities: Sequence[str] = ("critical",)) -> DataFrame:
    """Rows that fail a rule of those severities, each once, with the names of the rules."""
    names = F.concat_ws(",", *(F.when(F.col(f"__fail_{n}"), F.lit(r.name)) for n, r in enumerate(rules) if r.severity in severities))
    return marked(df, rules).where(_any_fail(rules, severities)).withColumn("failed_rules", names).select(*df.columns, "failed_rules")


def passing_rows(df: DataFrame, rules: Sequence[Rule], severities: Sequence[str] = ("critical",)) -> DataFrame:
    """The gate: rows that fail none of those rules. It looks at the rules and not at keys, so rows
    without a key don't slip through."""
    return marked(df, rules).where(~_any_fail(rules, severities)).select(*df.columns)


def checked(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rows with ``failed_rules``, the names of all rules that they fail in the rules' order: what a store keeps of
    a check, so that results and gate are read from it and the rules' joins run once."""
    names = F.array_compact(F.array(*(F.when(F.col(f"__fail_{n}"), F.lit(r.name)) for n, r in enumerate(rules))))
    return marked(df, rules).select(*df.columns, names.alias("failed_rules"))


def checked_results(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``results`` of checked rows."""
    return _outcomes(rows, rules, [F.array_contains("failed_rules", r.name) for r in rules])


def checked_gate(rows: DataFrame, rules: Sequence[Rule], severities: Sequence[str] = ("critical",)) -> tuple[DataFrame, DataFrame]:
    """``passing_rows`` and ``failed_rows`` of checked rows."""
    own = F.array_intersect("failed_rules", F.array(*(F.lit(r.name) for r in rules if r.severity in severities)))
    failed = rows.where(F.size(own) > 0).withColumn("failed_rules", F.concat_ws(",", own))
    return rows.where(F.size(own) == 0).drop("failed_rules"), failed


DEAD_LETTERS = "dlq_id string, source_table string, record_key string, record string, failure_reason string, status string"


def dead_letters(failed: DataFrame, table: str, key: str, reason: Column | str) -> DataFrame:
    """Failing rows as JSON, each distinct one once. Ids follow from the content, so a repeated run
    writes the same ones."""
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in failed.columns if c != "failed_rules"]))
    why = F.lit(reason) if isinstance(reason, str) else reason
    rows = failed.select(F.lit(table).alias("source_table"), F.col(key).cast("string").alias("record_key"), record.alias("record"), why.alias("failure_reason")).distinct()
    return rows.select(F.sha2(F.concat_ws("|", "source_table", "record", "failure_reason"), 256).alias("dlq_id"), "*", F.lit("pending_review").alias("status"))


def dead_letter_summary(letters: DataFrame) -> DataFrame:
    return letters.groupBy("source_table", "failure_reason", "status").agg(F.count("*").alias("records"))


# reconciliation of a source and a target by key


def level_counts(source: DataFrame, target: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """Level 1: as many distinct keys; with ``strict`` as many rows too."""
    side = lambda df, s: df.agg(F.count("*").alias(f"{s}_rows"), F.count_distinct(key).alias(f"{s}_keys"))
    both = side(source, "source").crossJoin(side(target, "target"))  # one row each
    same = F.col("source_keys") == F.col("target_keys")
    return both.withColumn("passed", same & (F.col("source_rows") == F.col("target_rows")) if strict else same)


def level_buckets(source: DataFrame, target: DataFrame, key: str, buckets: int = 64, content: Sequence[str] = ()) -> DataFrame:
    """Level 2: buckets of keys whose rows or distinct keys differ, or, with columns in ``content``,
    whose contents do."""
    sums = [F.count("*").alias("n"), F.count_distinct(key).alias("keys")]
    if content:
        sums.append(F.sum(F.xxhash64(key, *content).cast("decimal(38,0)")).alias("content"))
    side = lambda df, s: df.groupBy(bucket(F.col(key), buckets).alias("bucket")).agg(*sums).select("bucket", F.struct(*(["n", "keys"] + ["content"] * bool(content))).alias(s))
    both = side(source, "source").join(side(target, "target"), "bucket", "full_outer")
    return both.where(~F.col("source").eqNullSafe(F.col("target")))


def level_keys(source: DataFrame, target: DataFrame, key: str, bad: DataFrame, buckets: int = 64) -> DataFrame:
    """Level 3: keys of the bad buckets that only one side has."""
    own = lambda df: df.select(F.col(key)).where(F.col(key).isNotNull()).join(F.broadcast(bad.select("bucket")), bucket(F.col(key), buckets) == F.col("bucket"), "left_semi").distinct()  # noqa: E731  at most ``buckets`` rows
    s, t = own(source), own(target)
    only = lambda a, b, tag: a.join(b, key, "left_anti").withColumn("side", F.lit(tag))
    return only(s, t, "source_only").unionByName(only(t, s, "target_only"))


def reconcile(source: DataFrame, target: DataFrame, key: str, buckets: int = 64, content: Sequence[str] = ()) -> DataFrame:
    """A row for each level: whether it passed and how many differences it found."""
    one = level_counts(source, target, key).select(F.lit(1).alias("level"), "passed", F.abs(F.col("source_keys") - F.col("target_keys")).alias("differences"))
    bad = level_buckets(source, target, key, buckets, content)
    count = lambda df, level: df.agg(F.count("*").alias("differences")).select(F.lit(level).alias("level"), (F.col("differences") == 0).alias("passed"), "differences")
    return one.unionByName(count(bad, 2)).unionByName(count(level_keys(source, target, key, bad, buckets), 3))


# schema contracts


def normal_type(kind: str) -> str:
    return kind.lower().removesuffix("type")


def contract_violations(df: DataFrame, contract: dict[str, str]) -> list[tuple[str, str, str, str]]:
    """(violation, column, expected, actual). Types are compared leniently: one that contains the
    other (int, bigint) is no mismatch."""
    actual = {f.name: normal_type(f.dataType.simpleString()) for f in df.schema}
    out = [("MISSING_COLUMN", c, normal_type(t), "") for c, t in contract.items() if c not in actual]
    out += [("EXTRA_COLUMN", c, "", t) for c, t in actual.items() if c not in contract]
    for c, t in contract.items():
        if c in actual and not (normal_type(t) in actual[c] or actual[c] in normal_type(t)):
            out.append(("TYPE_MISMATCH", c, normal_type(t), actual[c]))
    return out


def evolved(df: DataFrame, key: str, new: dict[str, Sequence[str]], limit: int) -> DataFrame:
    """Some rows, by key, with new categorical columns that follow from the key's hash."""
    rows = df.orderBy(key).limit(limit)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.pmod(F.xxhash64(F.col(key)), F.lit(len(values))).cast("int") + 1)
    return rows.withColumns({c: pick(v) for c, v in new.items()})


def evolution_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many rows have each of the new columns filled."""
    rows = [F.struct(F.lit(c).alias("column_name"), F.count(c).alias("populated"), F.sum(F.col(c).isNull().cast("long")).alias("missing")) for c in columns]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def schema_of(contract: dict[str, str]) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in contract.items()))


def freshness(df: DataFrame, column: str, now: Column, warn_days: int = 7, error_days: int = 30) -> DataFrame:
    """Status of a source by the age of its newest row."""
    age = F.datediff(now, F.max(column))
    return df.agg(age.alias("age_days"), F.when(age > error_days, "error").when(age > warn_days, "warn").otherwise("pass").alias("status"))


# logs in a store: results, dead letters, reconciliation levels and schema violations

RESULTS = "run_id string, table_name string, rule string, kind string, column_name string, severity string, total long, failed long, failure_pct double, passed boolean"
LEVELS = "run_id string, table_name string, level int, passed boolean, differences long"
VIOLATIONS = "run_id string, table_name string, violation string, column_name string, expected string, actual string"


def record(store, log: str, schema: str, rows: DataFrame, run_id: str, table: str) -> DataFrame:
    """Appends a run's rows to a log and returns them as logged."""
    store.ensure(log, schema)
    names = T.StructType.fromDDL(schema).names
    own = rows.withColumns({"run_id": F.lit(run_id), "table_name": F.lit(table)}).select(*names)
    store.append(log, own)
    return store.read(log).where(F.col("run_id") == run_id)


def run_checks(store, df: DataFrame, rules: Sequence[Rule], table: str, run_id: str) -> str:
    """Checks a table, logs the results and the dead letters, and returns PASSED or FAILED."""
    logged = record(store, "data_quality_results", RESULTS, results(df, rules), run_id, table)
    letters = dead_letters(failed_rows(df, rules), table, rules[0].column, F.col("failed_rules"))
    store.ensure("dead_letter_queue", DEAD_LETTERS)
    known = store.read("dead_letter_queue").select("dlq_id")
    store.append("dead_letter_queue", letters.join(known, "dlq_id", "left_anti"))
    return status(logged).first()["status"]


def check_contract(store, df: DataFrame, contract: dict[str, str], table: str, run_id: str) -> int:
    """Logs a table's violations of its contract and returns their number."""
    rows = store.spark.createDataFrame(contract_violations(df, contract), "violation string, column_name string, expected string, actual string")
    return record(store, "schema_violation_log", VIOLATIONS, rows, run_id, table).count()
