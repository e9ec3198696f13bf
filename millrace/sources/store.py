"""Versioned Parquet tables with a log of actions.

A table is a folder. ``data/<id>`` holds the files of one write. ``_log/<version>.json`` holds what a commit did, a
line each: its schema, layout, operation and metrics, then the files it adds and those it removes, so it grows with
the files it changes and not with the table. Every CHECKPOINT_EVERY commits the files that are live are folded into
``_log/<version>.checkpoint``, a Parquet table. The files of a version are its last checkpoint and the commits since,
of each file the last action: Spark replays them, or the driver while there is no checkpoint and the log is small.

The log keeps rows, bytes, clustering, and of the first STATS columns the least and greatest value and the nulls of
each file. ``read(between=...)`` picks files by them before any is opened, and OPTIMIZE takes those that
aren't clustered or overlap many others.

Writers are optimistic. A commit creates the next version's log file, which fails if it is there; then what was
committed meanwhile is looked at. Appends commute with everything whose schema fits. A merge, update or delete
commutes unless a file it rewrites was removed, or a file added since holds rows it concerns; OPTIMIZE unless a
file it rewrites was removed. Those that don't commute are tried again on the new version, and fail after
ATTEMPTS. So every outcome is that of some serial order. All file access goes through Hadoop's file system.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import fits, widest
from ..operators.merge import Clauses, merge_rows
from ..operators.ranking import below, sample_bounds

CHECKPOINT_EVERY, ATTEMPTS, STATS, PREFIX = 50, 3, 16, 32
#: Bytes of a log without checkpoint that the driver replays itself.
SMALL_LOG = 1 << 20
#: Clustered files that a file may overlap before OPTIMIZE takes it again.
OVERLAPS = 4
#: Bytes of a partitioned table's files that a task of OPTIMIZE sorts along a Z-order curve.
SORTED = 32 << 20
FILES = "path string, rows long, bytes long, mins map<string,string>, maxs map<string,string>, nulls map<string,long>, clustering string"
_FILE = tuple(f.split()[0] for f in FILES.split(", "))
_HEAD = "operation string, schema string, layout string, metrics string, at double, clear boolean, data_change boolean"
_LOG = f"kind string, {_HEAD}, {FILES}"


class Conflict(RuntimeError):
    """Another writer committed something that this commit doesn't commute with."""


@dataclass(frozen=True)
class Version:
    number: int
    schema: T.StructType
    operation: str
    metrics: dict
    layout: dict
    at: float


@dataclass
class Commit:
    """What a version changes. ``rebase`` gets what was committed since its base (lines of the log) and the latest
    version; it returns the schema to commit with, or None if the two don't commute."""

    operation: str
    schema: T.StructType
    layout: dict
    adds: list[dict]
    removes: Iterable[str] = ()
    metrics: dict | None = None
    clear: bool = False
    data_change: bool = True
    rebase: Callable[[list[dict], Version], T.StructType | None] = lambda since, latest: None


class TableStore:
    """Named tables below a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # files
    def _list(self, path: str) -> list:
        p = self._path(path)
        return list(self._fs.listStatus(p)) if self._fs.exists(p) else []

    def _read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        """A small file, over an older one."""
        stream = self._fs.create(self._path(path), True)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()

    def _create(self, path: str, text: str) -> None:
        """A file that readers see whole; fails if it is there. Local disks: a hard link, which never replaces a
        file. Stores whose rename is atomic and refuses to replace: a rename. Others, which show a file when it is
        closed: a create that must not replace one, as a conditional request where the store has them."""
        jvm, target, draft = self.spark._jvm, self._path(path), f"{path}.{uuid.uuid4().hex}.draft"
        scheme = self._fs.getScheme()
        if scheme not in ("file", "hdfs", "viewfs", "abfs", "abfss"):
            try:
                stream = self._fs.createFile(target).overwrite(False).opt("fs.option.create.conditional.overwrite", True).recursive().build()
                stream.write(bytearray(text.encode("utf-8")))
                stream.close()
            except Exception as e:
                if self._fs.exists(target):
                    raise Conflict(path) from e
                raise
            return
        self.write_text(draft, text)
        try:
            if scheme == "file":
                local = lambda p: jvm.java.nio.file.Paths.get(self._path(p).toUri().getPath(), self.spark._sc._gateway.new_array(jvm.java.lang.String, 0))
                jvm.java.nio.file.Files.createLink(local(path), local(draft))
            elif self._fs.exists(target) or not self._fs.rename(self._path(draft), target):
                raise Conflict(path)
        except Exception as e:
            if isinstance(e, Conflict) or self._fs.exists(target):
                raise Conflict(path) from e
            raise
        finally:
            self._fs.delete(self._path(draft), False)

    def _log(self, name: str) -> str:
        return f"{self.root}/{name}/_log"

    def _listing(self, name: str) -> tuple[dict[int, int], list[int]]:
        """The versions with their log files' sizes, and the checkpoints."""
        sizes, checkpoints = {}, []
        for s in self._list(self._log(name)):
            found = re.match(r"(\d{12})\.(json|checkpoint)$", s.getPath().getName())
            if found and found[2] == "json":
                sizes[int(found[1])] = s.getLen()
            elif found:
                checkpoints.append(int(found[1]))
        return dict(sorted(sizes.items())), sorted(checkpoints)

    def _numbers(self, name: str) -> list[int]:
        return list(self._listing(name)[0])

    def _entry(self, name: str, number: int) -> str:
        return f"{self._log(name)}/{number:012d}.json"

    def _lines(self, name: str, number: int) -> list[dict]:
        return [json.loads(line) for line in self._read(self._entry(name, number)).splitlines()]

    # reading
    def exists(self, name: str) -> bool:
        return bool(self._numbers(name))

    def version(self, name: str, number: int | None = None) -> Version:
        """The latest version unless told; of its log file only the first line is read."""
        numbers = self._numbers(name)
        if not numbers or (number is not None and number not in numbers):
            raise KeyError(f"{name} has no version {number if number is not None else ''}".rstrip())
        number = numbers[-1] if number is None else number
        jvm = self.spark._jvm
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(self._fs.open(self._path(self._entry(name, number))), "UTF-8"))
        try:
            head = json.loads(reader.readLine())
        finally:
            reader.close()
        return Version(number, T.StructType.fromJson(json.loads(head["schema"])), head["operation"], json.loads(head["metrics"]), json.loads(head["layout"]), head["at"])

    def _since(self, name: str, number: int) -> tuple[int | None, dict[int, int]]:
        """The checkpoint that a version starts from, and the commits to replay with their sizes."""
        sizes, checkpoints = self._listing(name)
        if number not in sizes:
            raise KeyError(f"{name} has no version {number}")
        start = max((c for c in checkpoints if c <= number), default=None)
        return start, {n: s for n, s in sizes.items() if n <= number and (start is None or n > start)}

    def _actions(self, name: str, numbers: Iterable[int]) -> DataFrame:
        """Lines of the log with their versions."""
        paths = [self._entry(name, n) for n in numbers]
        if not paths:
            return self.spark.createDataFrame([], f"{_LOG}, version long")
        log = self.spark.read.schema(_LOG).json(paths)
        return log.withColumn("version", F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)", 1).cast("long"))

    def _history_of_files(self, name: str, number: int) -> DataFrame:
        """kind, version and the file's columns of all that the log has of files up to a version."""
        start, todo = self._since(name, number)
        rows = self._actions(name, todo).where("kind <> 'commit'").select("kind", "version", *_FILE)
        if start is not None:
            folded = self.spark.read.schema(FILES).parquet(f"{self._log(name)}/{start:012d}.checkpoint")
            rows = rows.unionByName(folded.select(F.lit("add").alias("kind"), F.lit(start).cast("long").alias("version"), *_FILE))
        return rows

    def replay(self, name: str, number: int | None = None) -> DataFrame:
        """The files of a version, by Spark: of each file the last action, after the last commit that cleared all."""
        number = self.version(name).number if number is None else number
        todo = self._since(name, number)[1]
        cleared = self._actions(name, todo).where("kind = 'commit' AND clear").agg(F.max("version")).first()[0]
        rows = self._history_of_files(name, number).where(F.col("version") >= (cleared or 0))
        last = rows.groupBy("path").agg(F.max_by(F.struct("kind", *(c for c in _FILE if c != "path")), "version").alias("last"))
        return last.where("last.kind = 'add'").select("path", *(f"last.{c}" for c in _FILE if c != "path"))

    def _live(self, name: str, number: int) -> dict[str, dict] | None:
        """The same by the driver, where the log is small and has no checkpoint; else None."""
        start, todo = self._since(name, number)
        if start is not None or sum(todo.values()) > SMALL_LOG:
            return None
        live: dict[str, dict] = {}
        for n in todo:
            for line in self._lines(name, n):
                if line["kind"] == "commit" and line["clear"]:
                    live.clear()
                elif line["kind"] == "add":
                    live[line["path"]] = line
                elif line["kind"] == "remove":
                    live.pop(line["path"], None)
        return live

    def files(self, name: str, number: int | None = None) -> DataFrame:
        """A row for each file of a version, as FILES."""
        number = self.version(name).number if number is None else number
        live = self._live(name, number)
        if live is None:
            return self.replay(name, number)
        return self.spark.createDataFrame([tuple(a.get(c) for c in _FILE) for a in live.values()], FILES)

    def paths(self, name: str, number: int | None = None, between: dict[str, tuple] | None = None) -> list[str]:
        """A version's files; ``between``: only those that may hold rows in the ranges, by their statistics."""
        found = self.version(name, number)
        live = self._live(name, found.number)
        if live is not None and not between:
            return list(live)
        files = self.files(name, found.number)
        for column, (low, high) in (between or {}).items():
            files = files.where(_may_hold(found.schema[column].dataType, column, low, high))
        return [r[0] for r in files.select("path").orderBy("path").collect()]  # a name for each file that is read

    def read(self, name: str, version: int | None = None, between: dict[str, tuple] | None = None) -> DataFrame:
        """A version of the table, the latest unless told; columns that older files lack are null. ``between``: the rows
        whose columns lie in closed ranges (None is open, null is in none); files without such rows aren't opened."""
        found = self.version(name, version)
        df = self.open_files(name, found, self.paths(name, found.number, between))
        for column, (low, high) in (between or {}).items():
            kind, c = found.schema[column].dataType, F.col(f"`{column}`")
            df = df.where(c.isNotNull() & (F.lit(True) if low is None else c >= F.lit(low).cast(kind)) & (F.lit(True) if high is None else c <= F.lit(high).cast(kind)))
        return df

    def pruning(self, name: str, between: dict[str, tuple]) -> dict:
        """How many files and bytes a read with ranges opens and skips."""
        kept = set(self.paths(name, between=between))
        rows = self.files(name).select("path", "bytes").collect()
        return {"files": len(rows), "files_skipped": len(rows) - len(kept), "bytes": sum(r[1] for r in rows), "bytes_skipped": sum(r[1] for r in rows if r[0] not in kept)}

    def open_files(self, name: str, found: Version, paths: Sequence[str]) -> DataFrame:
        """Rows of some of a table's files, under a version's schema."""
        if not paths:
            return self.spark.createDataFrame([], found.schema)
        reader = lambda base: self.spark.read.schema(found.schema).option("basePath", f"{self.root}/{name}/{base}".rstrip("/"))
        if not found.layout.get("partitioned_by"):
            return reader("").parquet(*[f"{self.root}/{name}/{p}" for p in paths])
        by_write: dict[str, list[str]] = {}  # each write has its own partition folders, so each is read by itself
        for p in paths:
            by_write.setdefault("/".join(p.split("/")[:2]), []).append(p)
        parts = [reader(base).parquet(*[f"{self.root}/{name}/{p}" for p in own]).select(*found.schema.names) for base, own in by_write.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _relative(self, name: str, paths: Iterable[str]) -> list[str]:
        """Paths that Spark names, below the table's own folder."""
        plain = lambda p: re.sub(r"^file:/+", "/", p)
        base = plain(self._fs.makeQualified(self._path(f"{self.root}/{name}")).toString()) + "/"
        out = [plain(unquote(p)) for p in paths]
        if strange := [p for p in out if not p.startswith(base)]:
            raise RuntimeError(f"{strange[0]} is not a file of {name}")
        return [p.removeprefix(base) for p in out]

    def _touched(self, name: str, found: Version, hit: Callable[[DataFrame], DataFrame], paths: Sequence[str]) -> list[str]:
        """Those of the files that hold rows which ``hit`` keeps. Of the rows only the columns that ``hit`` looks
        at are read; the driver gets names of files, as the log does."""
        if not paths:
            return []
        rows = hit(self.open_files(name, found, paths).withColumn("__file", F.col("_metadata.file_path")))
        touched = self._relative(name, (r[0] for r in rows.select("__file").distinct().collect()))
        if strange := set(touched) - set(paths):
            raise RuntimeError(f"{min(strange)} is not one of the files that {name} names")
        return touched

    def last_metrics(self, name: str, wanted: Callable[[dict], bool]) -> dict | None:
        """The metrics of the latest version for which ``wanted`` holds; older log files aren't opened."""
        return next((m for n in reversed(self._numbers(name)) if wanted(m := self.version(name, n).metrics)), None)

    def metrics_since(self, name: str, number: int) -> list[dict]:
        """The metrics of the versions after a number."""
        return [self.version(name, n).metrics for n in self._numbers(name) if n > number]

    def added_rows(self, name: str, number: int) -> int:
        """The rows in files that a commit added, from the log."""
        return sum(a["rows"] for a in self._lines(name, number) if a["kind"] == "add")

    def added(self, name: str, number: int) -> DataFrame:
        """The rows of files that a commit added."""
        return self.open_files(name, self.version(name, number), [a["path"] for a in self._lines(name, number) if a["kind"] == "add"])

    def history(self, name: str) -> DataFrame:
        """Versions, the latest first, from the log's first lines."""
        rows = self._actions(name, self._numbers(name)).where("kind = 'commit'")
        return rows.select(F.col("version").cast("int").alias("version"), "operation", "metrics", "at").orderBy(F.desc("version"))

    def detail(self, name: str) -> dict:
        """Files, bytes and layout of the latest version, from the log."""
        found = self.version(name)
        n, size = self.files(name, found.number).agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
        return {"name": name, "version": found.number, "files": n, "bytes": size, "average_bytes": size / n if n else 0.0, **found.layout}

    # writing
    def _write(self, name: str, df: DataFrame, partition_by: Sequence[str], clustering: str | None = None, check: Callable[[str], None] | None = None) -> list[dict]:
        """Writes a folder and describes its files: a row for each, found by one job over the columns with statistics.
        ``check`` gets the folder first, so files that it refuses aren't described."""
        path = f"data/{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(f"{self.root}/{name}/{path}")
        if check:
            check(path)
        there = self.spark.read.schema(_nullable(df.schema)).option("basePath", f"{self.root}/{name}/{path}").parquet(f"{self.root}/{name}/{path}")
        columns = [f for f in df.schema if _comparable(f.dataType)][:STATS]
        rows = _described(there, columns).collect()
        adds = []
        for relative, r in zip(self._relative(name, (r["f"] for r in rows)), rows):
            of = lambda what: {f.name: r[f"c{i}"][what] for i, f in enumerate(columns)}  # noqa: E731, B023
            adds.append({"kind": "add", "path": relative, "rows": r["rows"], "bytes": r["bytes"], "mins": of("min"), "maxs": of("max"), "nulls": of("nulls"), "clustering": clustering})
        return adds

    def commit(self, name: str, base: int, what: Commit) -> int:
        """Commits after version ``base``, or after what was committed since if that commutes."""
        schema, layout = _nullable(what.schema), what.layout
        number = base
        while True:
            head = {"kind": "commit", "operation": what.operation, "schema": json.dumps(schema.jsonValue()), "layout": json.dumps(layout), "metrics": json.dumps(what.metrics or {}, sort_keys=True), "at": time.time(), "clear": what.clear, "data_change": what.data_change}
            lines = [head, *what.adds, *({"kind": "remove", "path": p} for p in what.removes)]
            try:
                self._create(self._entry(name, number + 1), "\n".join(map(json.dumps, lines)))
                break
            except Conflict:
                newer = [n for n in self._numbers(name) if n > base]
                latest = self.version(name)
                fitting = what.rebase([line for n in newer for line in self._lines(name, n)], latest)
                if fitting is None:
                    raise
                schema, layout, number = _nullable(fitting), latest.layout, latest.number
        if number >= 0 and (number + 1) % CHECKPOINT_EVERY == 0:
            self.checkpoint(name, number + 1)
        return number + 1

    def checkpoint(self, name: str, number: int | None = None) -> int:
        """Folds the files of a version into a Parquet table that later reads start from."""
        number = self.version(name).number if number is None else number
        target, draft = f"{self._log(name)}/{number:012d}.checkpoint", f"{self._log(name)}/_draft-{uuid.uuid4().hex}"
        if not self._fs.exists(self._path(target)):
            self.files(name, number).write.parquet(draft)
            if self._fs.exists(self._path(target)) or not self._fs.rename(self._path(draft), self._path(target)):
                self._fs.delete(self._path(draft), True)
        return number

    def _base(self, name: str) -> Version | None:
        return self.version(name) if self.exists(name) else None

    def ensure(self, name: str, schema: T.StructType | str) -> None:
        """Creates an empty table unless it is there."""
        if not self.exists(name):
            schema = self.spark.createDataFrame([], schema).schema
            self.commit(name, -1, Commit("CREATE", schema, {}, []))

    def overwrite(self, name: str, df: DataFrame, partition_by: Sequence[str] = (), operation: str = "OVERWRITE", metrics: dict | None = None, layout: dict | None = None, check: Callable[[DataFrame], None] | None = None) -> int:
        """The rows in place of all others; a layout with ``clustered_by`` says that they come in that order. ``check``
        sees the rows once they are written; if it raises, they are not committed."""
        base = self._base(name)
        layout = {**({"partitioned_by": list(partition_by)} if partition_by else {}), **(layout or {})}
        found = Version(-1, _nullable(df.schema), operation, {}, layout, 0.0)
        seen = (lambda path: check(self.open_files(name, found, [path]))) if check else None
        adds = self._write(name, df, partition_by, _clustering("range", layout["clustered_by"]) if "clustered_by" in layout else None, seen)
        return self.commit(name, base.number if base else -1, Commit(operation, df.schema, layout, adds, metrics=metrics, clear=True))

    def append(self, name: str, df: DataFrame, merge_schema: bool = False, metrics: dict | None = None) -> int:
        """Adds rows; columns that they lack are null. Refused unless ``merge_schema``: columns that the table lacks, and
        types that its own don't hold; then columns are added and types widened. Where neither type
        holds the other, the rows are refused in any case: no value is ever narrowed."""
        base = self._base(name)
        if base is None:
            return self.overwrite(name, df, operation="APPEND", metrics=metrics)
        schema = _evolved(name, base.schema, df.schema, merge_schema)
        own = df.select(*((F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
        adds = self._write(name, own, base.layout.get("partitioned_by", ()))

        def rebase(since: list[dict], latest: Version) -> T.StructType | None:
            if latest.layout.get("partitioned_by") != base.layout.get("partitioned_by"):
                return None
            try:
                return _evolved(name, latest.schema, own.schema, merge_schema)
            except ValueError:
                return None

        return self.commit(name, base.number, Commit("APPEND", schema, base.layout, adds, metrics=metrics, rebase=rebase))

    def _rewrite(self, name: str, hit: Callable[[DataFrame], DataFrame], change: Callable[[DataFrame], DataFrame], operation: str, metrics: dict | None = None, anyway: bool = False, concerns: Callable[[DataFrame], DataFrame] | None = None, attempts: int = ATTEMPTS) -> int:
        """Rewrites the files with rows that ``hit`` keeps; ``anyway``: there may be new rows even if none has.
        ``concerns``: rows that would have changed the outcome, had they been there; those of ``hit`` unless told."""
        for left in reversed(range(attempts)):
            base = self.version(name)
            live = self.paths(name, base.number)
            touched = self._touched(name, base, hit, live)
            counts = {"files_rewritten": len(touched), "files_kept": len(live) - len(touched)}
            adds = self._write(name, change(self.open_files(name, base, touched)), base.layout.get("partitioned_by", ())) if touched or anyway else []

            def rebase(since: list[dict], latest: Version, touched=touched) -> T.StructType | None:
                if any(x["kind"] == "commit" and x["clear"] for x in since) or {x["path"] for x in since if x["kind"] == "remove"} & set(touched):
                    return None
                fresh = self._fresh(since)
                return None if self._touched(name, latest, concerns or hit, fresh) else latest.schema

            try:
                return self.commit(name, base.number, Commit(operation, base.schema, base.layout, adds, touched, {**(metrics or {}), **counts}, rebase=rebase))
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    def _fresh(self, since: list[dict]) -> list[str]:
        """Files with new rows that are still there: those of commits that only moved rows don't count."""
        live, moves = {}, False
        for line in since:
            if line["kind"] == "commit":
                moves = not line["data_change"]
            elif line["kind"] == "add":
                live[line["path"]] = moves
            else:
                live.pop(line["path"], None)
        return [p for p, moved in live.items() if not moved]

    def merge(self, name: str, source: DataFrame, on: Sequence[str], clauses: Clauses, metrics: dict | None = None, attempts: int = ATTEMPTS) -> int:
        """See operators.merge; a missing table is created from what would be inserted. A source row's match
        lies in a rewritten file or nowhere, so only those files take part in the outer join; where matched rows
        stay as they are, none does."""
        if not self.exists(name):
            empty = self.spark.createDataFrame([], T.StructType([f for f in source.schema if f.name not in clauses.helpers]))
            return self.overwrite(name, merge_rows(empty, source, on, clauses), operation="MERGE", metrics=metrics)
        keys = source.select(*on).distinct()
        met = lambda old: old.join(keys, list(on), "left_semi")
        if clauses.update is None and clauses.delete is None:
            own = source.select(*on, *(c for c in source.columns if c not in on))
            empty = self.spark.createDataFrame([], self.version(name).schema)
            fresh = lambda _: merge_rows(empty, own.join(self.read(name).select(*on), list(on), "left_anti"), on, clauses)
            return self._rewrite(name, lambda old: old.where(F.lit(False)), fresh, "MERGE", metrics, anyway=True, concerns=met, attempts=attempts)
        return self._rewrite(name, met, lambda old: merge_rows(old, source, on, clauses), "MERGE", metrics, anyway=True, attempts=attempts)

    def append_sample(self, name: str, share: float, salt: str = "") -> int:
        """Adds a share of the table's own rows to it, chosen by their hash: the same ones every time."""
        rows = self.read(name)
        return self.append(name, rows.where(F.pmod(F.xxhash64(*rows.columns, F.lit(salt)), F.lit(1_000_000)) < int(share * 1_000_000)))

    def update(self, name: str, set_: dict[str, Column], where: Column) -> int:
        return self._rewrite(name, lambda old: old.where(where), lambda old: old.withColumns({c: F.when(where, v).otherwise(F.col(c)).cast(old.schema[c].dataType) for c, v in set_.items()}), "UPDATE")

    def delete(self, name: str, where: Column) -> int:
        return self._rewrite(name, lambda old: old.where(where), lambda old: old.where(~F.coalesce(where, F.lit(False))), "DELETE")

    def restore(self, name: str, number: int) -> int:
        """Makes an old version the latest, as a new one: the files that differ are added and removed."""
        base, old = self.version(name), self.version(name, number)
        before, after = ({r["path"]: r for r in self.files(name, v).collect()} for v in (base.number, number))
        adds = [{"kind": "add", **after[p].asDict()} for p in after if p not in before]
        return self.commit(name, base.number, Commit("RESTORE", old.schema, old.layout, adds, [p for p in before if p not in after], {"restored": number}))

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    # changes
    def differing(self, name: str, since: int, until: int | None = None) -> tuple[list[str], list[str]]:
        """The files that the first of two versions has alone, and those that the second has alone."""
        before, after = set(self.paths(name, since)), set(self.paths(name, until))
        return sorted(before - after), sorted(after - before)

    def changes(self, name: str, since: int, until: int | None = None, on: Sequence[str] = ()) -> DataFrame:
        """The rows that differ between two versions, with ``_change``: ``insert`` or ``delete``, and where both have
        rows of a key (``on``) ``update_before`` and ``update_after``. Only files that the versions don't share
        are read, under the second one's schema; rows that were moved between files cancel out."""
        found = self.version(name, until)
        gone, come = self.differing(name, since, found.number)
        signed = lambda paths, sign: self.open_files(name, found, paths).withColumn("__n", F.lit(sign))
        columns = [F.col(f"`{c}`") for c in found.schema.names]
        net = signed(gone, -1).unionByName(signed(come, 1)).groupBy(*columns).agg(F.sum("__n").alias("__n")).where("__n <> 0")
        kind = F.when(F.col("__n") < 0, "delete").otherwise("insert")
        if on:
            key = W.partitionBy(*on)
            both = (F.min("__n").over(key) < 0) & (F.max("__n").over(key) > 0)
            kind = F.when(both & (F.col("__n") < 0), "update_before").when(both, "update_after").otherwise(kind)
        times = F.explode(F.sequence(F.lit(1).cast("long"), F.abs("__n")))
        return net.withColumn("_change", kind).select(*columns, "_change", times.alias("__time")).drop("__time")

    # maintenance
    def optimize(self, name: str, target_bytes: int = 128 << 20, cluster_by: Sequence[str] = (), zorder_by: Sequence[str] = (), full: bool = False, files_wanted: int | None = None) -> dict:
        """Rewrites files into some of about ``target_bytes``, clustered if asked. Taken are, unless ``full``: without
        clustering, files of under half the target; with it, files that aren't clustered so, and of those in ranges
        the ones that overlap more than OVERLAPS others. ``files_wanted``: all are rewritten into so many, however
        large; each is a task that streams its rows, so time grows with a file's size and memory doesn't."""
        base, before = self.version(name), self.detail(name)
        files = self.files(name, base.number)
        wanted = _clustering("zorder", zorder_by) if zorder_by else _clustering("range", cluster_by) if cluster_by else None
        if full or files_wanted is not None:
            picked = files
        elif wanted is None:
            picked = files.where(F.col("bytes") < target_bytes // 2)
        else:
            picked = files.where(~F.col("clustering").eqNullSafe(F.lit(wanted)))
            if cluster_by:
                picked = picked.unionByName(_overlapping(files.where(F.col("clustering") == wanted), cluster_by[0], base.schema[cluster_by[0]].dataType))
        taken = {r["path"]: r["bytes"] for r in picked.select("path", "bytes").collect()}
        report = {"files_before": before["files"], "bytes_before": before["bytes"], "files_rewritten": len(taken), "bytes_rewritten": sum(taken.values())}
        if len(taken) > (wanted is None):
            n = files_wanted or max(1, -(-report["bytes_rewritten"] // target_bytes))
            df, by = self.open_files(name, base, list(taken)), base.layout.get("partitioned_by", ())
            # a partitioned table's files follow its partitions, so smaller ranges may be sorted there
            ranges = n if files_wanted or not by else max(n, -(-report["bytes_rewritten"] // SORTED))
            df = zordered(df, zorder_by, ranges, by) if zorder_by else clustered(df, cluster_by, n) if cluster_by else df.coalesce(n)
            layout = {**base.layout, **({"clustered_by": list(cluster_by or zorder_by)} if wanted else {})}
            adds = self._write(name, df, by, wanted)

            def rebase(since: list[dict], latest: Version) -> T.StructType | None:
                lost = any(x["kind"] == "commit" and x["clear"] for x in since) or {x["path"] for x in since if x["kind"] == "remove"} & set(taken)
                return None if lost else latest.schema

            self.commit(name, base.number, Commit("OPTIMIZE", base.schema, layout, adds, taken, {k: report[k] for k in ("files_before", "files_rewritten", "bytes_rewritten")}, data_change=False, rebase=rebase))
        after = self.detail(name)
        return {**report, "files_after": after["files"], "bytes_after": after["bytes"]}

    def vacuum(self, name: str, hours: float = 168.0, dry_run: bool = True) -> list[str]:
        """Files that the latest version doesn't name, if older than ``hours``; where none of a write's files is
        named and all are as old, its folder. Deleted unless ``dry_run``; the versions up to the last that loses
        a file go from the log as well, and those after it start from a checkpoint. Spark lists the files."""
        found = self.version(name)
        if not self._list(f"{self.root}/{name}/data"):
            return []
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{self.root}/{name}/data").select("path", F.unix_millis("modificationTime").alias("at"))
        inside = F.regexp_extract("path", r"/(data/[0-9a-f]{32}/(?:[^/]+=[^/]*/)*[^/]+)$", 1)
        there = listed.select(inside.alias("path"), "at").withColumn("folder", F.substring("path", 1, 37))
        live = self.files(name, found.number).select("path", F.lit(True).alias("live"))
        by_folder = W.partitionBy("folder")
        limit = (time.time() - hours * 3600) * 1000
        kept = F.max(F.coalesce("live", F.lit(False)) | (F.col("at") > limit)).over(by_folder)
        marked = there.join(live, "path", "left").withColumn("in_use", kept)
        gone = [r[0] for r in marked.where(F.col("live").isNull() & (F.col("at") <= limit)).select(F.when(F.col("in_use"), F.col("path")).otherwise(F.col("folder"))).distinct().collect()]
        if gone and not dry_run:
            clears = [r[0] for r in self._actions(name, self._numbers(name)).where("kind = 'commit' AND clear").select("version").collect()]
            last = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("version")))
            spans = self._log_of_files(name).groupBy("path").agg(last("add").alias("added"), last("remove").alias("removed"))
            cleared = F.array_min(F.filter(F.array(*map(F.lit, clears)).cast("array<long>"), lambda v: v > F.col("added")))
            ended = F.least(F.when(F.col("removed") > F.col("added"), F.col("removed")), cleared)
            lost = self.spark.createDataFrame([(g,) for g in gone], "gone string")
            first = spans.withColumn("ended", ended).join(lost, (F.col("path") == F.col("gone")) | (F.substring("path", 1, 37) == F.col("gone"))).agg(F.max("ended")).first()[0]
            if first is not None:
                self.checkpoint(name, first)
                for number in self._numbers(name):
                    if number < first:
                        self._fs.delete(self._path(self._entry(name, number)), False)
                for number in self._listing(name)[1]:
                    if number < first:
                        self._fs.delete(self._path(f"{self._log(name)}/{number:012d}.checkpoint"), True)
            for p in gone:
                self._fs.delete(self._path(f"{self.root}/{name}/{p}"), True)
        return sorted(gone)

    def _log_of_files(self, name: str) -> DataFrame:
        """kind, version and path of all actions there are, from the first checkpoint that is needed on."""
        sizes, checkpoints = self._listing(name)
        rows = self._actions(name, sizes).where("kind <> 'commit'").select("kind", "version", "path")
        if checkpoints and (not sizes or checkpoints[0] <= min(sizes)):
            folded = self.spark.read.schema(FILES).parquet(f"{self._log(name)}/{checkpoints[0]:012d}.checkpoint")
            rows = rows.unionByName(folded.select(F.lit("add").alias("kind"), F.lit(checkpoints[0]).cast("long").alias("version"), "path"))
        return rows


def apply_changes(rows: DataFrame, feed: DataFrame) -> DataFrame:
    """The rows after the changes: a row goes for each delete or before image, and comes for each other one."""
    columns = [F.col(f"`{c}`") for c in rows.columns]
    signed = feed.withColumn("__n", F.when(F.col("_change").isin("delete", "update_before"), -1).otherwise(1)).drop("_change")
    net = rows.withColumn("__n", F.lit(1)).unionByName(signed).groupBy(*columns).agg(F.sum("__n").alias("__n"))
    wrong = F.raise_error(F.lit("a change takes a row that isn't there")).cast("boolean")
    return net.where(F.when(F.col("__n") < 0, wrong).otherwise(F.col("__n") > 0)).select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))).alias("__time")).drop("__time")


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in schema])


def _clustering(kind: str, columns: Sequence[str]) -> str:
    return json.dumps([kind, *columns])


def _comparable(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType))


def _described(there: DataFrame, columns: Sequence[T.StructField]) -> DataFrame:
    """A row for each file of a folder: bytes, rows, and the ends and nulls of the columns. With strings among them, a
    file's size is gathered as a set of one, as Spark hashes groups whose aggregates are objects; with strings' bounds
    alone it would sort all rows by file, in memory and then on disk. Without strings it hashes anyway, and faster."""
    size = F.col("_metadata.file_size")
    strings = any(isinstance(f.dataType, T.StringType) for f in columns)
    ends = lambda f: [_stored(fn(F.col(f"`{f.name}`")), f.dataType, fn is F.max).alias(f"{fn.__name__}") for fn in (F.min, F.max)]
    measures = [F.struct(*ends(f), (F.count("*") - F.count(F.col(f"`{f.name}`"))).alias("nulls")).alias(f"c{i}") for i, f in enumerate(columns)]
    return there.groupBy(F.col("_metadata.file_path").alias("f")).agg((F.element_at(F.collect_set(size), 1) if strings else F.max(size)).alias("bytes"), F.count("*").alias("rows"), *measures)


def _stored(value: Column, kind: T.DataType, upper: bool) -> Column:
    """A bound as the log has it: times as microseconds, long strings by their beginning (none as upper bounds)."""
    if isinstance(kind, T.StringType):
        return F.when(F.length(value) <= PREFIX, value) if upper else F.substring(value, 1, PREFIX)
    return (F.unix_micros(value) if isinstance(kind, T.TimestampType) else value).cast("string")


def _bound(kept: Column, kind: T.DataType) -> Column:
    return kept.cast("long" if isinstance(kind, T.TimestampType) else kind)


def _may_hold(kind: T.DataType, column: str, low, high) -> Column:
    """Whether a file may hold rows of the closed range, as far as its statistics tell."""
    of = lambda c: F.try_element_at(F.col(c), F.lit(column))
    given = lambda v: F.unix_micros(F.lit(v).cast(kind)) if isinstance(kind, T.TimestampType) else F.lit(v).cast(kind)
    keep = F.col("rows") > F.coalesce(of("nulls"), F.lit(0))
    if high is not None:
        keep = keep & F.coalesce(_bound(of("mins"), kind) <= given(high), F.lit(True))
    if low is not None:
        keep = keep & F.coalesce(_bound(of("maxs"), kind) >= given(low), F.lit(True))
    return keep


def _overlapping(files: DataFrame, column: str, kind: T.DataType) -> DataFrame:
    """Files whose range of a column holds a point that more than OVERLAPS other ranges hold. The most crowded
    points are beginnings of ranges: there, the ranges begun so far less those that ended before hold it.
    The windows go over a row or two for each file of the log."""
    low, high = (_bound(F.try_element_at(F.col(c), F.lit(column)), kind) for c in ("mins", "maxs"))
    known = files.select("path", low.alias("low"), high.alias("high")).where("low IS NOT NULL AND high IS NOT NULL")
    row = lambda at, begins, ends, path: known.select(F.col(at).alias("at"), F.lit(begins).alias("begins"), F.lit(ends).alias("ends"), (F.col("path") if path else F.lit(None).cast("string")).alias("path"))
    upto, here = W.orderBy("at").rangeBetween(W.unboundedPreceding, 0), W.partitionBy("at")
    before = lambda c: F.sum(c).over(upto) - F.sum(c).over(here)
    line = row("low", 1, 0, True).unionByName(row("high", 0, 1, False))
    crowded = line.withColumn("depth", F.sum("begins").over(upto) - before("ends")).where((F.col("begins") == 1) & (F.col("depth") > OVERLAPS + 1))
    points = crowded.select("at", F.lit(1).alias("begins"), F.lit(0).alias("ends"), F.lit(None).cast("string").alias("path"))
    ends = points.unionByName(row("low", 0, 1, True)).unionByName(row("high", 0, 2, True))
    seen = ends.withColumn("points", F.when(F.col("ends") == 1, -before("begins")).otherwise(F.sum("begins").over(upto))).where("path IS NOT NULL")
    worn = seen.groupBy("path").agg(F.sum("points").alias("points")).where("points > 0")
    return files.join(worn, "path", "left_semi").select(*_FILE)


def _evolved(name: str, table: T.StructType, rows: T.StructType, merge_schema: bool) -> T.StructType:
    """The table's schema after rows of another are appended."""
    own = {f.name: f for f in rows}
    known = {f.name for f in table}
    if (extra := [f for f in rows if f.name not in known]) and not merge_schema:
        raise ValueError(f"{name} has no column {', '.join(f.name for f in extra)}")
    out = []
    for f in table:
        kind = f.dataType
        if f.name in own and not fits(own[f.name].dataType, kind):
            kind = widest(kind, own[f.name].dataType) if merge_schema else None
            if kind is None:
                raise ValueError(f"{name}.{f.name} is {f.dataType.simpleString()} and doesn't hold {own[f.name].dataType.simpleString()}")
        out.append(T.StructField(f.name, kind, True, f.metadata))
    return T.StructType([*out, *extra])


def clustered(df: DataFrame, columns: Sequence[str], files: int) -> DataFrame:
    """Rows in ranges of the columns, so that files can be skipped by their statistics."""
    return df.repartitionByRange(files, *columns).sortWithinPartitions(*columns)


def zordered(df: DataFrame, columns: Sequence[str], files: int, first: Sequence[str] = (), bits: int = 8) -> DataFrame:
    """Rows along a Z-order curve over the columns' quantiles, one bit of each in turn; whole values count,
    strings too. Ranges go by the columns in ``first`` (a partitioned table's) before the curve, so a
    partition is as many tasks as its share of rows asks for, and a task writes few partitions."""
    edges = sample_bounds(df, [F.col(c) for c in columns], df.columns, (1 << bits) - 1)
    cells = [below(F.col(c), e) for c, e in zip(columns, edges)]
    z = F.lit(0).cast("long")
    for b in range(bits):
        for i, cell in enumerate(cells):
            z = z.bitwiseOR(F.shiftleft(F.shiftright(cell, b).bitwiseAND(F.lit(1)).cast("long"), b * len(cells) + i))
    return df.withColumn("__z", z).repartitionByRange(files, *first, "__z").sortWithinPartitions(*first, "__z").drop("__z")
