"""A graph of models over a table store: what hangs on what, what has to be built again, and tests as gates.

A model is SQL that names the tables and models it reads in braces, as ``SELECT * FROM {orders}``, or a function of
their DataFrames. Views are read through; tables are kept in the store, and their commits say which
versions of which tables, and which text of the model, they were built from. A run builds the tables whose inputs or
text aren't those any more, in order of the graph: after one source changes, what hangs on it runs and nothing
else. A model's tests are SQL over ``{this}`` that must find no row; they see the new rows before they are committed,
and a failure leaves the table, and what hangs on it, as it was."""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable
from dataclasses import dataclass, field
from string import Formatter

from pyspark.sql import DataFrame

from ..sources.store import TableStore
from .runner import sequence


class TestFailed(RuntimeError):
    """A model's test found rows."""

    __test__ = False


@dataclass(frozen=True)
class Model:
    name: str
    build: str | Callable[..., DataFrame]
    table: bool = False
    tests: dict[str, str] = field(default_factory=dict)

    @property
    def reads(self) -> tuple[str, ...]:
        """What it reads: the names in the SQL's braces, or the function's parameters."""
        if callable(self.build):
            return tuple(inspect.signature(self.build).parameters)
        return tuple(dict.fromkeys(name for _, name, _, _ in Formatter().parse(self.build) if name))

    @property
    def text(self) -> str:
        build = inspect.getsource(self.build) if callable(self.build) else self.build
        return hashlib.sha256(build.encode()).hexdigest()


class Graph:
    """Models over a store's tables; names that aren't models are tables of the store."""

    def __init__(self, store: TableStore, models: list[Model]):
        self.store, self.models = store, {m.name: m for m in models}
        self.order = sequence({m.name: tuple(r for r in m.reads if r in self.models) for m in models})

    def inputs(self, name: str) -> dict[str, str]:
        """The texts and table versions that a model's rows follow from; views stand for what they read."""
        model = self.models[name]
        out = {f"model {name}": model.text}
        for r in model.reads:
            if r in self.models and not self.models[r].table:
                out |= self.inputs(r)
            else:
                out[f"table {r}"] = str(self.store.version(r).number)
        return out

    def read(self, name: str) -> DataFrame:
        model = self.models.get(name)
        return self.store.read(name) if model is None or model.table else self._build(model)

    def _build(self, model: Model) -> DataFrame:
        read = {r: self.read(r) for r in model.reads}
        return model.build(**read) if callable(model.build) else self.store.spark.sql(model.build, **read)

    def _test(self, model: Model, rows: DataFrame) -> None:
        for test, sql in model.tests.items():
            if not self.store.spark.sql(sql, this=rows).isEmpty():
                raise TestFailed(f"{model.name}: {test}")

    def run(self) -> dict[str, str]:
        """``built``, ``fresh``, ``failed`` (with the test) or ``held back`` for each table, in order."""
        report: dict[str, str] = {}
        for name in self.order:
            model = self.models[name]
            if not model.table:
                if any(report.get(r, "").startswith(("failed", "held")) for r in model.reads):
                    report[name] = "held back"
                continue
            if any(report.get(r, "").startswith(("failed", "held")) for r in model.reads):
                report[name] = "held back"
                continue
            inputs = self.inputs(name)
            last = self.store.last_metrics(name, lambda m: "inputs" in m) if self.store.exists(name) else None
            if last and last["inputs"] == inputs:
                report[name] = "fresh"
                continue
            try:
                self.store.overwrite(name, self._build(model), operation="MODEL", metrics={"inputs": inputs}, check=lambda rows, model=model: self._test(model, rows))
                report[name] = "built"
            except TestFailed as e:
                report[name] = f"failed: {e}"
        return {n: r for n, r in report.items() if self.models[n].table}


def not_null(*columns: str) -> dict[str, str]:
    return {f"{c} is not null": f"SELECT * FROM {{this}} WHERE {c} IS NULL" for c in columns}


def unique(*columns: str) -> dict[str, str]:
    key = ", ".join(columns)
    return {f"{key} unique": f"SELECT {key} FROM {{this}} GROUP BY {key} HAVING count(*) > 1"}


def retail_models() -> list[Model]:
    """Staging views, delivered lines, daily sales and customer scores over the tables ``orders`` and ``items``."""
    from ..operators import gold

    def mart_customer_rfm(delivered_lines: DataFrame) -> DataFrame:
        from pyspark.sql import functions as F

        revenue = delivered_lines.groupBy("order_id", "customer_id", "order_date").agg(F.sum("line_total").alias("revenue"))
        return gold.rfm(revenue).withColumn("monetary", F.col("monetary").cast("double"))

    return [
        Model("stg_orders", "SELECT order_id, customer_id, status, purchased_at, CAST(purchased_at AS DATE) AS order_date FROM {orders} WHERE order_id IS NOT NULL"),
        Model("stg_items", "SELECT order_id, item_no, product_id, seller_id, price, CAST(price * (1 - discount) * (1 + tax) AS DECIMAL(18,4)) AS line_total, shipped_at FROM {items}"),
        Model(
            "delivered_lines",
            # orders are hashed within a task, as sorting both sides takes longer and a task's orders are a small part of its lines
            """SELECT /*+ SHUFFLE_HASH(o) */ order_id, item_no, o.customer_id, o.order_date, i.product_id, i.seller_id, i.line_total, greatest(o.purchased_at, i.shipped_at) AS source_updated_at
               FROM {stg_orders} o JOIN {stg_items} i USING (order_id) WHERE o.status = 'F'""",
            table=True,
            tests={**not_null("order_id", "order_date"), **unique("order_id", "item_no"), "line_total is not negative": "SELECT * FROM {this} WHERE line_total < 0"},
        ),
        Model(
            "mart_daily_sales",
            """SELECT order_date, count(DISTINCT order_id) AS order_count, count(DISTINCT customer_id) AS customer_count, CAST(round(sum(line_total), 2) AS DOUBLE) AS revenue, count(*) AS item_count
               FROM {delivered_lines} GROUP BY order_date""",
            table=True,
            tests={**not_null("order_date"), **unique("order_date")},
        ),
        Model("mart_customer_rfm", mart_customer_rfm, table=True, tests={**unique("customer_id"), "scores from 1 to 5": "SELECT * FROM {this} WHERE NOT (r_score BETWEEN 1 AND 5 AND f_score BETWEEN 1 AND 5 AND m_score BETWEEN 1 AND 5)"}),
        Model("customer_count", "SELECT count(DISTINCT customer_id) AS customers FROM {stg_orders}", table=True),
    ]
