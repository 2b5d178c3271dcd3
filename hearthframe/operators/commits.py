"""All-or-nothing writes over several tables: files first, then one manifest that makes them visible together.

Rows go to folders of their own under the root; a commit is one small file, put only if no other has its number, which lists the
folders of every table. Readers follow the last commit, so what a lost job has written is never seen, and a writer that was
overtaken looks again and puts the next number. Tables stay Parquet folders that any reader of Parquet can open.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import urlparse

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.shared import written

LOG = "_commits"


class Overtaken(RuntimeError):
    """Another writer has changed a table that this commit has read."""


@dataclass(frozen=True)
class Commit:
    """version, and for each table its folders and schema (as JSON); notes are what the writer has to say of it."""

    version: int = 0
    tables: dict[str, dict] = field(default_factory=dict)
    notes: dict = field(default_factory=dict)

    def schema(self, table: str) -> StructType:
        return StructType.fromJson(self.tables[table]["schema"])


class Store:
    """The tables under one root folder, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def versions(self) -> list[int]:
        log = self._path(LOG)
        if not self._fs.exists(log):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(log)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def at(self, version: int | None = None) -> Commit:
        """The last commit, or that of the version; an empty one before the first."""
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        if version == 0:
            return Commit()
        text = self.spark.read.text(f"{self.root}/{LOG}/{version:020d}.json", wholetext=True).first()[0]  # one small file
        return Commit(**json.loads(text))

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The table's rows as of the commit; columns that older files lack are null."""
        state = self.at(version)
        if table not in state.tables:
            raise KeyError(table)
        schema, folders = state.schema(table), [f"{self.root}/{f}" for f in state.tables[table]["folders"]]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def has(self, table: str) -> bool:
        return table in self.at().tables

    def _put(self, commit: Commit) -> bool:
        """Writes the manifest unless its number is taken; whether it was written."""
        name = f"{commit.version:020d}.json"
        self._fs.mkdirs(self._path(LOG))
        whole, last = self._path(f"{LOG}/.{uuid.uuid4().hex}"), self._path(f"{LOG}/{name}")
        out = self._fs.create(whole, False)
        out.write(bytearray(json.dumps({"version": commit.version, "tables": commit.tables, "notes": commit.notes}).encode()))
        out.close()
        try:
            if self._fs.getScheme() == "file":  # a link fails if the name is there; a local rename would replace it
                local = lambda p: urlparse(p.toUri().toString()).path
                try:
                    os.link(local(whole), local(last))
                except FileExistsError:
                    return False
                return True
            return not self._fs.exists(last) and self._fs.rename(whole, last)  # of two renames to one name one fails
        finally:
            self._fs.delete(whole, False)

    def commit(self, appends: dict[str, DataFrame] | None = None, replaces: dict[str, DataFrame] | None = None, notes: dict | None = None, read_at: Commit | None = None, check: Callable[[Commit], None] | None = None) -> Commit:
        """Writes the rows of all tables given, then makes them visible at once; a failure before leaves nothing to see.

        read_at: the commit from which the rows were derived; Overtaken if any table that is replaced, or appended to by a
        rule that looks at it, has changed since. check is called with the state that the commit follows, each time that is tried.
        """
        put: dict[str, dict] = {}
        for mode, tables in (("append", appends or {}), ("replace", replaces or {})):
            for name, rows in tables.items():
                folder = f"{name}/{uuid.uuid4().hex}"
                rows.write.parquet(f"{self.root}/{folder}")
                put[name] = {"mode": mode, "folder": folder, "schema": json.loads(rows.schema.json())}
        while True:
            now = self.at()
            if read_at is not None and any(now.tables.get(n) != read_at.tables.get(n) for n in put):
                raise Overtaken(f"changed since version {read_at.version}: {sorted(n for n in put if now.tables.get(n) != read_at.tables.get(n))}")
            if check is not None:
                check(now)
            tables = dict(now.tables)
            for name, w in put.items():
                old = tables.get(name, {"folders": [], "schema": w["schema"]})
                keep = old["folders"] if w["mode"] == "append" else []
                schema = _merged(old["schema"], w["schema"]) if w["mode"] == "append" else w["schema"]
                tables[name] = {"folders": [*keep, w["folder"]], "schema": schema}
            state = Commit(now.version + 1, tables, notes or {})
            if self._put(state):
                return state

    def append_once(self, rows: DataFrame, table: str, *key: str) -> int:
        """Appends the rows whose key the table lacks, in one commit, and returns their number; tried again if overtaken.

        Of rows that share a key one is appended; rows with a null in it are all appended.
        """
        while True:
            now = self.at()
            nulls = F.lit(False)
            for k in key:
                nulls = nulls | F.col(k).isNull()
            fresh = rows.where(~nulls).dropDuplicates(list(key)).unionByName(rows.where(nulls))
            if table in now.tables:
                fresh = fresh.join(self.read(table, now.version).select(*key).distinct(), list(key), "left_anti").select(*rows.columns)
            counted = _Counted(fresh)
            try:
                state = self.commit(appends={table: counted.rows}, read_at=now)
            except Overtaken:
                continue
            return counted.number(lambda: self.spark.read.parquet(f"{self.root}/{state.tables[table]['folders'][-1]}").count())

    def with_ids(self, rows: DataFrame, table: str, id_col: str = "id") -> DataFrame:
        """rows with ids that follow the table's largest one without a gap and stay when tasks run again, as the rows are written.

        Ids follow the order of partitions: each one's rows are counted and numbered from where the ones before it end.
        """
        top = self.read(table).agg(F.max(id_col)).first()[0] if self.has(table) else None
        return numbered(rows, id_col, (top or 0) + 1)

    def vacuum(self, keep_versions: int = 1) -> list[str]:
        """Deletes the folders that none of the last commits lists and returns them; for when no writer is at work."""
        live = {f for v in self.versions()[-keep_versions:] for t in self.at(v).tables.values() for f in t["folders"]}
        gone = []
        for name in {t for v in self.versions() for t in self.at(v).tables}:
            for x in self._fs.listStatus(self._path(name)):
                folder = f"{name}/{x.getPath().getName()}"
                if folder not in live:
                    self._fs.delete(x.getPath(), True)
                    gone.append(folder)
        return sorted(gone)


class _Counted:
    """Rows that count themselves as they are written; a second scan only where the count was not heard of."""

    def __init__(self, rows: DataFrame):
        self._seen = Observation()
        self.rows = rows.observe(self._seen, F.count(F.lit(1)).alias("n"))

    def number(self, otherwise: Callable[[], int]) -> int:
        got = self._seen.get.get("n")
        return otherwise() if got is None else int(got)


def _merged(old: dict, new: dict) -> dict:
    """The schema with the columns of both, the old ones first; a column that changes its type is refused."""
    known = {f["name"]: f for f in old["fields"]}
    for f in new["fields"]:
        if f["name"] in known and known[f["name"]]["type"] != f["type"]:
            raise ValueError(f"column {f['name']} is {known[f['name']]['type']}, not {f['type']}")
    return {"type": "struct", "fields": [*old["fields"], *[f | {"nullable": True} for f in new["fields"] if f["name"] not in known]]}


def numbered(rows: DataFrame, id_col: str, first: int = 1) -> DataFrame:
    """rows with dense ids from `first`, by partition; told by rows that are written, so that ids stay the same however often tasks run."""
    fixed = written(rows.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}))
    from pyspark.sql import Window

    sizes = fixed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_start"))
    before = sizes.select("_part", "_start", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a partition
    at = F.col("_before") + F.col("_place") - F.col("_start") + first
    return fixed.join(F.broadcast(before), "_part").withColumn(id_col, at.cast("long")).select(*[c for c in rows.columns if c != id_col], id_col)
