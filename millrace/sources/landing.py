"""Idempotent loading of landing-zone files, and of daily files by date."""

from __future__ import annotations

import csv
import datetime as dt
import io
import random
import uuid
from collections.abc import Callable, Collection, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.merge import upsert
from .store import TableStore

LOG = "file_ingestion_log"
LOG_SCHEMA = "file_name string, source_path string, fingerprint string, target_table string, status string, reason string, records long, columns int, run_id string, ingested_at timestamp, bytes long, version long"


def fingerprint(path: str, size: int, modified: int) -> str:
    return f"{path}|{size}|{modified}"


def landing_files(store: TableStore, folder: str) -> list[tuple[str, str, int, int]]:
    """(name, path, bytes, modified) of the folder's CSV files, whatever the case of their ending."""
    found = []
    for s in store._list(folder):
        name = s.getPath().getName()
        if s.isFile() and name.lower().endswith(".csv"):
            found.append((name, s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return sorted(found)


def with_lineage(df: DataFrame, run_id: str, at: dt.datetime) -> DataFrame:
    """The rows of files with the file they came from, the run and its time."""
    plus = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))  # decoding would make it a blank
    path = F.regexp_replace(F.url_decode(plus), "^file:/+", "file:/")
    return df.withColumns({"_source_file_name": F.regexp_extract(path, "[^/]*$", 0), "_source_path": path, "_ingestion_run_id": F.lit(run_id), "_ingested_at": F.lit(at).cast("timestamp")})


def first_line(store: TableStore, path: str) -> str:
    jvm = store.spark._jvm
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(store._fs.open(store._path(path)), "UTF-8"))
    try:
        return reader.readLine() or ""
    finally:
        reader.close()


def read_csv(store: TableStore, path: str | list[str], schema: str | None = None, multi_line: bool = False, infer: bool = False) -> DataFrame:
    """CSV files with one header, as strings unless a schema is given or types are to be inferred: types are a
    later step's business, and inferring them costs a pass and leading zeros. ``multi_line``: quoted values
    may hold line feeds; such a file can't be split and is read by one task."""
    reader = store.spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", multi_line).option("escape", '"').option("inferSchema", infer)
    return (reader.schema(schema) if schema else reader).csv(path)


def ingest(store: TableStore, folder: str, manifest: dict[str, str], run_id: str | None = None, now: dt.datetime | None = None, multi_line: Collection[str] = ()) -> list[dict]:
    """Loads the folder's files into the manifest's tables, each content once. ``multi_line`` names files
    whose quoted values hold line feeds.

    Files of one header are read together, and all that a table gets is one commit. It carries the files'
    fingerprints, so that a run that fails before it writes the log finds them loaded when it is repeated: the commits
    after those that the log knows are looked at. Of the log only what concerns the folder's files comes to the driver."""
    run_id, now = run_id or uuid.uuid4().hex, now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    store.ensure(LOG, LOG_SCHEMA)
    files = landing_files(store, folder)
    seen = known_files(store, [fingerprint(path, size, modified) for _, path, size, modified in files])
    logged = {r[0]: r[1] for r in store.read(LOG).where("status = 'INGESTED'").groupBy("target_table").agg(F.max("version")).collect()}  # a row for each table
    for target in set(manifest.values()):
        if store.exists(target):
            for m in store.metrics_since(target, -1 if logged.get(target) is None else logged[target]):
                seen |= {m["fingerprint"]} if "fingerprint" in m else set(m.get("fingerprints", ()))
    fresh: dict[str, dict[tuple[str, bool], list[str]]] = {}
    for name, path, size, modified in files:
        if name in manifest and fingerprint(path, size, modified) not in seen:
            fresh.setdefault(manifest[name], {}).setdefault((first_line(store, path), name in multi_line), []).append(path)
    marks = {path: fingerprint(path, size, modified) for _, path, size, modified in files}
    loaded: dict[str, tuple[int, int, int]] = {}  # of each file its records, columns and version
    for target, groups in fresh.items():
        parts = [(paths, with_lineage(read_csv(store, paths, multi_line=lines), run_id, now)) for (_, lines), paths in groups.items()]
        rows = parts[0][1]
        for _, more in parts[1:]:
            rows = rows.unionByName(more, allowMissingColumns=True)
        own = [p for paths, _ in parts for p in paths]
        version = store.append(target, rows, merge_schema=True, metrics={"fingerprints": [marks[p] for p in own], "run_id": run_id})
        counts = {r[0]: r[1] for r in store.added(target, version).groupBy("_source_path").count().collect()}  # a row for each file
        loaded |= {p: (counts.get(p, 0), len(df.columns), version) for paths, df in parts for p in paths}
    rows, report = [], []
    for name, path, size, modified in files:
        target = manifest.get(name)
        records, columns, version = loaded.get(path, (0, 0, None))
        status, reason = ("INGESTED", "") if path in loaded else ("SKIPPED", "not in manifest" if target is None else "already ingested")
        report.append({"file": name, "target": target, "records": records, "columns": columns, "status": status, "reason": reason})
        rows.append((name, path, marks[path], target, status, reason, records, columns, run_id, now, size, version))
    if rows:
        store.append(LOG, store.spark.createDataFrame(rows, LOG_SCHEMA))
    return report


def known_files(store: TableStore, marks: Sequence[str]) -> set[str]:
    """Those of the fingerprints that the log has as ingested."""
    listing = store.spark.createDataFrame([(m,) for m in marks], "fingerprint string")
    return {r[0] for r in store.read(LOG).where("status = 'INGESTED'").join(F.broadcast(listing), "fingerprint", "left_semi").select("fingerprint").distinct().collect()}  # a folder's files


def ingest_probe(store: TableStore, folder: str) -> DataFrame:
    """A row for each file of the folder: whether a run would load it."""
    files = landing_files(store, folder)
    rows = [(name, path, size, fingerprint(path, size, modified)) for name, path, size, modified in files]
    listing = store.spark.createDataFrame(rows, "file_name string, source_path string, bytes long, fingerprint string")
    store.ensure(LOG, LOG_SCHEMA)
    done = store.read(LOG).where("status = 'INGESTED'").select("fingerprint", F.lit(True).alias("is_loaded")).distinct()
    return listing.join(done, "fingerprint", "left").select("file_name", "source_path", "bytes", F.coalesce("is_loaded", F.lit(False)).alias("is_loaded"))


def load_summary(store: TableStore, tables: Sequence[str]) -> DataFrame:
    """Rows and columns of each table, or NOT_LOADED."""
    rows = []
    for t in tables:
        there = store.exists(t)
        df = store.read(t) if there else None
        rows.append((t, df.count() if there else 0, len(df.columns) if there else 0, "LOADED" if there else "NOT_LOADED"))
    return store.spark.createDataFrame(rows, "table_name string, rows long, columns int, status string")


def run_report(first: list[dict], second: list[dict]) -> dict:
    """Two runs side by side: the second must load nothing."""
    count = lambda run, status: sum(e["status"] == status for e in run)
    top = max(first, key=lambda e: e["records"], default=None)
    return {
        "first_ingested": count(first, "INGESTED"),
        "second_ingested": count(second, "INGESTED"),
        "second_skipped": count(second, "SKIPPED"),
        "records": sum(e["records"] for e in first),
        "idempotent": count(second, "INGESTED") == 0,
        "largest": top and {"file": top["file"], "records": top["records"]},
    }


# daily files


def daily_name(day: dt.date) -> str:
    return f"transactions_{day.isoformat()}.csv"


#: What a daily file's header must hold, and the statuses of generated rows.
DAILY_COLUMNS = ("order_id", "transaction_date", "amount", "status")
DAILY_STATUSES = ("delivered", "shipped", "processing")


def daily_files(first: dt.date = dt.date(2024, 1, 1), days: int = 30, seed: int = 42) -> dict[str, str]:
    """Generated daily files: name to text, 5 to 15 rows each."""
    rng, out = random.Random(seed), {}
    for k in range(days):
        day, text = first + dt.timedelta(days=k), io.StringIO()
        writer = csv.writer(text, lineterminator="\n")
        writer.writerow(DAILY_COLUMNS)
        for n in range(1, rng.randint(5, 15) + 1):
            writer.writerow([f"SIM-{day:%Y%m%d}-{n:03d}", day.isoformat(), f"{rng.uniform(10, 500):.2f}", rng.choice(DAILY_STATUSES)])
        out[daily_name(day)] = text.getvalue()
    return out


def branch(text: str | None) -> str:
    """load, or invalid for a file that is missing, empty or without the columns."""
    lines = (text or "").splitlines()
    header = next(csv.reader(lines[:1]), [])
    return "load" if len(lines) > 1 and set(DAILY_COLUMNS) <= set(header) else "invalid"


def load_daily(store: TableStore, path: str, table: str = "daily_transactions", fail: bool = False, before_commit: Callable[[], None] | None = None) -> int:
    """Upserts a daily file by order_id: loading it again changes nothing. Returns its rows."""
    df = read_csv(store, path).select("order_id", F.col("transaction_date").cast("date").alias("transaction_date"), F.col("amount").try_cast("double").alias("amount"), "status")
    if fail:
        raise RuntimeError("simulated failure")
    if before_commit:
        before_commit()
    store.merge(table, df, ["order_id"], upsert())
    return df.count()


def stage(store: TableStore, source: str, inbox: str) -> str:
    """Copies a file into a stream's inbox, over an older copy; returns its path there."""
    src = store._path(source)
    target = store._path(f"{inbox.rstrip('/')}/{src.getName()}")
    conf = store.spark._jsc.hadoopConfiguration()
    store.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(src.getFileSystem(conf), src, store._fs, target, False, True, conf)
    return target.toString()


def backfill(store: TableStore, inbox: str, first: dt.date, days: int, table: str = "daily_transactions") -> list[dict]:
    """Loads each day's file that is there and sound; days without one are reported. Days may be
    repeated and in any order, as every load is an upsert."""
    out = []
    for k in range(days):
        day = first + dt.timedelta(days=k)
        path = f"{inbox.rstrip('/')}/{daily_name(day)}"
        text = store._read(path) if store._fs.exists(store._path(path)) else None
        if branch(text) == "invalid":
            out.append({"day": day.isoformat(), "status": "INVALID", "rows": 0})
        else:
            out.append({"day": day.isoformat(), "status": "LOADED", "rows": load_daily(store, path, table)})
    return out


def export_csv(df: DataFrame, path: str, single: bool = True) -> None:
    """CSV with header: one file, for small results, unless ``single`` is off."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)
