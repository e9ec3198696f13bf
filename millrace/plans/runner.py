"""Tasks of the retail pipeline, their order, dry runs, simulated failures and reports."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import functions as F

from ..operators import checks, gold, star
from ..operators.merge import first_versions, one_current, refresh_versions, upsert_changed
from ..operators.silver import invalid_price, keep_first, silver_items
from ..sources.retail import Retail
from ..sources.store import TableStore


@dataclass(frozen=True)
class Params:
    run_id: str = "manual"
    dry_run: bool = False
    simulate_failure: str = ""
    as_of: str = ""


def run_task(name: str, params: Params, task: Callable[[], dict], reports: Path | str | None = None, store: TableStore | None = None) -> dict:
    """Runs a task and writes its report, to a folder of the driver's or, with a store, to any folder that
    the store's file system has; a failure is reported and raised again."""
    report = {"task": name, "run_id": params.run_id, "dry_run": params.dry_run}
    try:
        if params.simulate_failure == name:
            raise RuntimeError("simulated_failure")
        report |= {"status": "SUCCESS", **task()}
    except Exception as e:
        report |= {"status": "FAILED", "error": str(e)}
        raise
    finally:
        if store is not None and isinstance(reports, str):
            store.write_text(f"{reports}/{name}.json", json.dumps(report, default=str, sort_keys=True))
        elif reports is not None:
            reports = Path(reports)
            reports.mkdir(parents=True, exist_ok=True)
            (reports / f"{name}.json").write_text(json.dumps(report, default=str, sort_keys=True))
    return report


#: Each task's predecessors.
ORDER = {
    "bronze": (),
    "quality": ("bronze",),
    "silver": ("quality",),
    "reconciliation": ("silver",),
    "gold": ("silver",),
    "dimensional": ("reconciliation", "gold"),
    "visualization": ("dimensional",),
}


def sequence(order: dict[str, tuple[str, ...]]) -> list[str]:
    """The tasks so that each comes after its predecessors; a cycle is an error."""
    done: list[str] = []
    while len(done) < len(order):
        ready = [t for t in order if t not in done and all(p in done for p in order[t])]
        if not ready:
            raise ValueError("the tasks wait for each other")
        done += ready[:1]
    return done


@dataclass
class Pipeline:
    """The seven tasks over a retail source and a store. Each takes what those before it stored: quality, silver and
    reconciliation the bronze tables, silver the orders as quality checked them, gold and dimensional the silver
    tables, visualization the star. What isn't stored yet follows from the source, and in a dry run all does."""

    store: TableStore
    source: Retail
    params: Params = field(default_factory=Params)
    reports: Path | None = None

    def _save(self, name: str, df) -> dict:
        if self.params.dry_run:
            return {name: df.count()}
        self.store.overwrite(name, df)
        return {name: self.store.read(name).count()}

    def _table(self, name: str, otherwise):
        return self.store.read(name) if not self.params.dry_run and self.store.exists(name) else otherwise()

    def bronze(self) -> dict:
        return {"rows": {n: r for n, df in (("orders", self.source.orders), ("items", self.source.items)) for n, r in self._save(f"bronze/{n}", df).items()}}

    def rules(self) -> list[checks.Rule]:
        return [
            checks.Rule("order_id_not_null", "not_null", "order_id"),
            checks.Rule("order_id_unique", "unique", "order_id"),
            checks.Rule("customer_exists", "referential", "customer_id", other=self.source.customers, other_column="customer_id"),
            checks.Rule("status_accepted", "accepted_values", "status", "warning", values=("F", "O", "P")),
        ]

    def bronze_orders(self):
        return self._table("bronze/orders", lambda: self.source.orders)

    def bronze_items(self):
        return self._table("bronze/items", lambda: self.source.items)

    def _bronze_version(self) -> int | None:
        return self.store.version("bronze/orders").number if self.store.exists("bronze/orders") else None

    def quality(self) -> dict:
        """Checks the bronze orders and stores them with the rules they fail, which silver's gate goes by."""
        if self.params.dry_run:
            outcome = checks.results(self.bronze_orders(), self.rules())
        else:
            version = self._bronze_version()
            self.store.overwrite("metadata/checked_orders", checks.checked(self.bronze_orders(), self.rules()), metrics={"bronze": version})
            outcome = checks.checked_results(self.store.read("metadata/checked_orders"), self.rules())
        return {"quality": checks.status(outcome).first()["status"], "rules": [r.asDict() for r in outcome.collect()]}

    def gated(self):
        """Orders that pass the rules and those that don't: by what quality stored, if that is of the bronze orders as they
        are now, or else checked here."""
        if not self.params.dry_run and self.store.exists("metadata/checked_orders"):
            seen = self.store.last_metrics("metadata/checked_orders", lambda m: "bronze" in m)
            if seen and seen["bronze"] == self._bronze_version():
                return checks.checked_gate(self.store.read("metadata/checked_orders"), self.rules())
        orders = self.bronze_orders()
        return checks.passing_rows(orders, self.rules()), checks.failed_rows(orders, self.rules())

    def silver_orders(self):
        """The gate lets no order through that is there twice or has no id, so there is nothing left to choose from."""
        return self.gated()[0]

    def silver_items(self):
        """The lines that ``price_gate`` lets through, deduped, from one shuffle."""
        return deduped(self.bronze_items(), unless=invalid_price())

    def silver(self) -> dict:
        passing, failed = self.gated()
        letters = checks.dead_letters(failed, "orders", "order_id", F.col("failed_rules"))
        return {"rows": self._save("silver/orders", passing) | self._save("silver/items", self.silver_items()) | self._save("metadata/dead_letters", letters)}

    def orders(self):
        return self._table("silver/orders", self.silver_orders)

    def items(self):
        return self._table("silver/items", self.silver_items)

    def reconciliation(self) -> dict:
        return {"levels": [r.asDict() for r in checks.reconcile(self.bronze_orders(), self.orders(), "order_id").collect()]}

    def gold(self) -> dict:
        revenue = gold.delivered_revenue(self.orders(), self.items())
        return {"rows": self._save("gold/daily_sales", gold.daily_sales(revenue)) | self._save("gold/customer_rfm", gold.rfm(revenue)) | self._save("gold/customer_summary", gold.customer_summary(revenue))}

    def customers(self):
        """The stored versions of customers, completed, repaired and with what changed in the source; the first time, version 1 of each."""
        used = self.orders().select("customer_id")
        if not self.store.exists("gold/dim_customers"):
            return one_current(first_versions(self.source.customers, used))
        return refresh_versions(self.store.read("gold/dim_customers"), self.source.customers, used, self.params.as_of or dt.date.today().isoformat())

    def dims(self) -> dict:
        """The dimensions as they will be, with stubs for products and sellers that only lines have."""
        orders, items = self.orders(), self.items()
        span = orders.agg(F.min(F.to_date("purchased_at")), F.max(F.to_date("purchased_at"))).first()
        out = {"dates": star.date_dimension(self.store.spark, str(span[0]), str(span[1])), "customers": self.customers()}
        for name, source, key, columns in (("products", self.source.products, "product_id", ("name", "brand", "category")), ("sellers", self.source.sellers, "seller_id", ("name", "state"))):
            own = star.dimension(source, key, columns)
            out[name] = own.unionByName(star.orphans(items, own, key, dict.fromkeys(columns, "UNKNOWN")))
        return out

    def save_dimension(self, name: str, df) -> dict:
        """Merges a dimension into the stored one, whose rows and versions stay: only what is new or differs is written."""
        table = f"gold/dim_{name}"
        if self.params.dry_run or not self.store.exists(table) or name == "dates":
            return self._save(table, df)
        key = f"{name.removesuffix('s')}_sk"
        self.store.merge(table, df, [key], upsert_changed([c for c in df.columns if c != key]))
        return {table: self.store.read(table).count()}

    def dimensional(self) -> dict:
        """Prepares and repairs the dimensions, then builds the fact from those that are stored; the fact is checked as stored,
        so that its joins run once."""
        dims, base, out = self.dims(), star.fact_base(self.orders(), self.items()), {}
        for name, df in dims.items():
            out |= self.save_dimension(name, df)
        stored = dims if self.params.dry_run else {name: self.store.read(f"gold/dim_{name}") for name in dims}
        fact = star.fact_sales(base, **stored)
        out |= self._save("gold/fact_sales", fact)
        check = star.validate_fact(fact if self.params.dry_run else self.store.read("gold/fact_sales"), base).first().asDict()
        return {"rows": out, "check": check}

    def visualization(self) -> dict:
        from .dashboards import dashboards

        if self.params.dry_run:
            return {"datasets": []}
        names = ("fact_sales", "dim_dates", "dim_products", "dim_sellers", "dim_customers")
        found = dashboards(self.store.spark, {n: self.store.read(f"gold/{n}") for n in names})
        return {"datasets": {n: df.count() for n, df in found.items()}}

    def run(self, order: dict[str, tuple[str, ...]] = ORDER) -> list[dict]:
        """All tasks in order; the first failure stops the run."""
        return [run_task(name, self.params, getattr(self, name), self.reports, self.store) for name in sequence(order)]


def deduped(items, unless=None):
    """Of repeated lines the dearest, dealt by order. Ties are broken by three more columns and not by
    a hash of all, so that a query reads and shuffles only the columns it needs. ``unless``: see ``keep_first``."""
    return keep_first(items, ["order_id", "item_no"], [F.desc("price"), "product_id", "seller_id", "shipped_at"], dealt_by=["order_id"], unless=unless)


__all__ = ["ORDER", "Params", "Pipeline", "deduped", "run_task", "sequence", "silver_items"]
