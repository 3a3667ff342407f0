"""Units, vectors, the index and pages as tables, published framework by framework.

A table is a folder for each framework and state; which folders are current stands in a numbered manifest.  Whatever
changes together (units, their vectors, their part of the index, the version) is written beside what is there and
published by one new manifest, so a reader sees all of it or none.  Only the frameworks that change are written.  Folders
go when the last manifests that name them are no longer kept, so a DataFrame that was taken before a publication stays
readable for a while.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import schema
from siltstone.scratch import drop_table, write_table

from . import index as IX
from .units import first_by_id, symbols

#: Given units: their vectors.
Embed = Callable[[DataFrame], DataFrame]
#: Manifests that are kept, the current one among them.
KEPT = 5


def upsert(old: DataFrame, new: DataFrame, key: str = "id", *order: str) -> DataFrame:
    """``old`` with the rows of ``new``: rows of one key are replaced; of several new ones the last by ``order`` stays."""
    from pyspark.sql import Window

    columns = order or ("unit_seq",)
    last = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in columns)))
    fresh = new.withColumn("__n", last).where("__n = 1").drop("__n")
    return old.join(fresh.select(key), key, "left_anti").select(*new.columns).unionByName(fresh)


def remove_framework(table: DataFrame, framework: str) -> DataFrame:
    return table.where(~F.col("framework").eqNullSafe(F.lit(framework)))


class Store:
    """Tables below one folder of any Spark file system."""

    def __init__(self, spark: SparkSession, path: str, kept: int = KEPT):
        self.spark, self.path, self.kept = spark, path.rstrip("/"), max(1, kept)
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        if self._numbers() and self.manifest().get("schema") != schema.SCHEMA_VERSION:
            self.clear_all()

    # -- manifests

    def _numbers(self) -> list[int]:
        folder = self._fs_path(f"{self.path}/_manifests")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, number: int | None = None) -> dict[str, Any]:
        """The current state, or an older one: folders by table and framework, and versions by framework."""
        numbers = self._numbers()
        if not numbers:
            return {"schema": schema.SCHEMA_VERSION, "tables": {}, "versions": {}}
        stream = self._fs.open(self._fs_path(f"{self.path}/_manifests/{numbers[-1] if number is None else number}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, change: Callable[[dict[str, Any]], None]) -> None:
        """Publishes the current state with ``change`` applied; where another writer was faster, on top of theirs."""
        while True:
            number = (self._numbers() or [0])[-1] + 1
            state = self.manifest()
            change(state)
            staged, target = (self._fs_path(f"{self.path}/_manifests/{n}") for n in (f".{uuid.uuid4().hex}", f"{number}.json"))
            stream = self._fs.create(staged, True)
            stream.write(bytearray(json.dumps(state).encode()))
            stream.close()
            if not self._fs.exists(target) and self._fs.rename(staged, target):
                return self._vacuum()
            self._fs.delete(staged, False)

    def _vacuum(self) -> None:
        """Removes manifests beyond the last ones, and the folders that only those name."""
        numbers = self._numbers()
        named = lambda n: {f for folders in self.manifest(n)["tables"].values() for f in folders.values()}
        living = set().union(*(named(n) for n in numbers[-self.kept :]))
        for n in numbers[: -self.kept]:
            for folder in named(n) - living:
                self._fs.delete(self._fs_path(folder), True)
            self._fs.delete(self._fs_path(f"{self.path}/_manifests/{n}.json"), False)

    def _write(self, table: str, df: DataFrame) -> str:
        folder = f"{self.path}/{table}/{uuid.uuid4().hex}"
        df.select(*schema.struct(schema.STORED[table]).fieldNames()).write.parquet(folder)
        return folder

    def _open(self, table: str, folders: list[str]) -> DataFrame:
        kind = schema.struct(schema.STORED[table])
        return self.spark.read.schema(kind).parquet(*folders) if folders else self.spark.createDataFrame([], kind)

    def publish(self, framework: str, tables: dict[str, DataFrame], version: dict[str, str] | None = None) -> None:
        """One framework's new state of some tables, all at once."""
        folders = {table: self._write(table, df) for table, df in tables.items()}
        self._point(framework, folders, version)

    def _point(self, framework: str, folders: dict[str, str], version: dict[str, str] | None = None) -> None:
        def change(state: dict[str, Any]) -> None:
            for table, folder in folders.items():
                state["tables"].setdefault(table, {})[framework] = folder
            if version is not None:
                state["versions"][framework] = version

        self.commit(change)

    # -- reading

    def read(self, table: str, framework: str | None = None) -> DataFrame:
        """A table as it is now, of one framework or all; other frameworks' files are not looked at."""
        folders = self.manifest()["tables"].get(table, {})
        return self._open(table, [f for name, f in sorted(folders.items()) if framework in (None, name)])

    def units(self, framework: str | None = None) -> DataFrame:
        return self.read("units", framework)

    def symbols(self, framework: str | None = None) -> DataFrame:
        """Always derived from the units: there is no second state to keep in step."""
        return symbols(self.units(framework))

    def index(self) -> IX.Index:
        """The full-text index of all frameworks, as it was published with their units."""
        return IX.Index(self.read("postings"), self.read("lengths"), self.read("entries"))

    def get(self, *ids: str) -> DataFrame:
        """Units by id, in the order asked for; ids that are not there are left out."""
        order = F.array_position(F.array(*(F.lit(i) for i in ids)), F.col("id"))
        return self.units().where(F.col("id").isin(*ids)).withColumn("__o", order).orderBy("__o").drop("__o")

    def version(self, framework: str) -> str | None:
        found = self.manifest()["versions"].get(framework)
        return found["version_key"] if found else None

    def versions(self) -> DataFrame:
        rows = [(name, v["version_key"], datetime.fromisoformat(v["ingested_at"]), v["doc_system"]) for name, v in sorted(self.manifest()["versions"].items())]
        return self.spark.createDataFrame(rows, schema.VERSIONS)

    def usage(self) -> DataFrame:
        """(table, framework, bytes) of the current state, from the file system's own counts."""
        rows = [(table, name, self._fs.getContentSummary(self._fs_path(folder)).getLength()) for table, folders in sorted(self.manifest()["tables"].items()) for name, folder in sorted(folders.items())]
        return self.spark.createDataFrame(rows, "table string, framework string, bytes bigint")

    # -- writing

    def _put(self, framework: str, units: DataFrame, embed: Embed | None, version: tuple[str, str] | None) -> None:
        """A framework's units with all that follows from them: index, and vectors (those of units that stay are kept)."""
        folders = {"units": self._write("units", units)}
        stored = self._open("units", [folders["units"]])
        made = IX.build(stored).tables()
        folders |= {table: self._write(table, df) for table, df in made.items()}
        old = self.read("vectors", framework)
        vectors = old.join(stored.select("id"), "id", "left_semi")
        if embed is not None:
            vectors = vectors.unionByName(embed(stored.join(old.select("id"), "id", "left_anti")).select(*old.columns))
        if embed is not None or framework in self.manifest()["tables"].get("vectors", {}):
            folders["vectors"] = self._write("vectors", vectors)
        self._point(framework, folders, version and self._version(*version))

    def _each(self, units: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame], embed: Embed | None, version: tuple[str, str] | None) -> None:
        fresh = write_table(first_by_id(units), "units")
        for framework in sorted(r["framework"] for r in fresh.select("framework").distinct().collect()):
            new = fresh.where(F.col("framework") == framework)
            self._put(framework, merged(self.units(framework), new), embed, version)
        drop_table(fresh)

    def insert(self, units: DataFrame, embed: Embed | None = None, version: tuple[str, str] | None = None) -> None:
        """Units by id; what is there under another id stays."""
        self._each(units, lambda old, new: upsert(old, new), embed, version)

    def replace(self, framework: str, units: DataFrame, embed: Embed | None = None, version: tuple[str, str] | None = None) -> None:
        """All units of a framework; the vectors of those that are gone go with them."""
        self._put(framework, first_by_id(units.where(F.col("framework") == framework)), embed, version)

    def replace_files(self, units: DataFrame, files: DataFrame, embed: Embed | None = None) -> None:
        """The units of ``files`` (framework, source_file) become ``units``; a file without any loses what it had."""
        fresh, told = write_table(first_by_id(units), "units"), write_table(files.select("framework", "source_file").distinct(), "files")
        for framework in sorted(r["framework"] for r in told.select("framework").distinct().collect()):
            left = self.units(framework).join(told.where(F.col("framework") == framework).select("source_file"), "source_file", "left_anti")
            new = fresh.where(F.col("framework") == framework)
            self._put(framework, upsert(left.select(*new.columns), new), embed, None)
        drop_table(fresh), drop_table(told)

    def put_vectors(self, framework: str, vectors: DataFrame) -> None:
        """Vectors by id, of units that are there."""
        merged = upsert(self.read("vectors", framework), vectors).join(self.units(framework).select("id"), "id", "left_semi")
        self.publish(framework, {"vectors": merged})

    def put_pages(self, framework: str, pages: DataFrame) -> None:
        """The page cache: etag and body by url."""
        old, new = self.read("pages", framework), pages.dropDuplicates(["url"])
        self.publish(framework, {"pages": old.join(new.select("url"), "url", "left_anti").select(*old.columns).unionByName(new.select(*old.columns))})

    def _version(self, version_key: str, doc_system: str) -> dict[str, str]:
        return {"version_key": version_key, "doc_system": doc_system, "ingested_at": datetime.now(timezone.utc).isoformat()}

    def set_version(self, framework: str, version_key: str, doc_system: str = "") -> None:
        self.commit(lambda state: state["versions"].update({framework: self._version(version_key, doc_system)}))

    def clear_framework(self, framework: str) -> int:
        """Removes a framework everywhere; how many units it had."""
        n = self.units(framework).count()

        def change(state: dict[str, Any]) -> None:
            for folders in [*state["tables"].values(), state["versions"]]:
                folders.pop(framework, None)

        self.commit(change)
        return n

    def clear_all(self) -> None:
        for name in ("_manifests", *schema.STORED):
            self._fs.delete(self._fs_path(f"{self.path}/{name}"), True)
