"""The versioned store of symbols and edges.

A version is a pointer file that names a Parquet folder of each table; it is created in one step, complete, and only if
its number is free. The highest pointer is the committed version. Writers write their folders first, so readers never
see half of a version. A change is made to a version it has read and committed as the next one; if another writer was
first, it is made again to what that one left. The version before is kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import schema
from skein.session import Folder

#: What a change makes of the two tables of a version (None where there is none).
Change = Callable[[DataFrame | None, DataFrame | None], tuple[DataFrame, DataFrame]]


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.folder = Folder(spark, self.path)

    def _pointer(self, version: int) -> str:
        return f"pointers/{version:012d}"

    @property
    def version(self) -> int:
        """The committed version; 0 if there is none."""
        return max((int(p) for p in self.folder.names("pointers")), default=0)

    def migrate(self) -> bool:
        """S14, 1.3: drop everything of another schema version; True if something was dropped."""
        meta = self.folder.read("schema.json")
        dropped = meta is not None and meta["schema_version"] != schema.SCHEMA_VERSION
        if dropped:
            self.folder.delete()
        if meta is None or dropped:
            self.folder.create("schema.json", {"schema_version": schema.SCHEMA_VERSION})
        return dropped

    def _data(self, symbols: DataFrame, edges: DataFrame) -> dict:
        """Write both tables to folders of their own: paths and row counts."""
        made = {"data": {}, "counts": {}}
        for name, df in (("symbols", symbols), ("edges", edges)):
            made["data"][name] = f"{self.path}/{name}/{uuid.uuid4().hex}"
            df.write.parquet(made["data"][name])
            made["counts"][name] = self.spark.read.parquet(made["data"][name]).count()
        return made

    def _commit(self, version: int, made: dict, batches: dict) -> bool:
        if self.folder.create(self._pointer(version), {"schema_version": schema.SCHEMA_VERSION, "batches": batches, **made}):
            self._drop_before(version - 1)
            return True
        return False

    def change(self, make: Change, attempts: int = 20, batch: tuple[str, int] | None = None) -> int:
        """Commit what ``make`` gives for the newest tables as the next version, and again if another writer was first.

        ``batch`` (stream, number) is committed with the version: a batch that the store holds is not applied again.
        """
        self.migrate()
        for _ in range(attempts):
            base = self.version
            entry = self.folder.read(self._pointer(base)) if base else {"batches": {}}
            if entry is None:  # so many commits went by that this version is gone
                continue
            batches = dict(entry["batches"])
            if batch is not None:
                if batches.get(batch[0], -1) >= batch[1]:
                    return base
                batches[batch[0]] = batch[1]
            tables = [self.spark.read.parquet(entry["data"][name]) if base else None for name in ("symbols", "edges")]
            try:
                made = self._data(*make(*tables))
            except Exception:
                if self.version == base:
                    raise
                continue
            if self._commit(base + 1, made, batches):
                return base + 1
            for path in made["data"].values():
                self.folder.drop(path)
        raise RuntimeError("other writers keep committing first")

    def persist(self, symbols: DataFrame, edges: DataFrame, attempts: int = 20) -> int:
        """Write both tables and commit them as the next version, whatever the one before holds. The new version."""
        self.migrate()
        made = self._data(symbols, edges)
        for _ in range(attempts):
            base = self.version
            entry = self.folder.read(self._pointer(base)) if base else {"batches": {}}
            if entry is not None and self._commit(base + 1, made, entry["batches"]):
                return base + 1
        raise RuntimeError("other writers keep committing first")

    def _drop_before(self, keep: int) -> None:
        for number in self.folder.names("pointers"):
            if int(number) < keep and (entry := self.folder.read(f"pointers/{number}")):
                self.folder.delete(f"pointers/{number}")
                for path in entry["data"].values():
                    self.folder.drop(path)

    def load(self, name: str, version: int | None = None) -> DataFrame | None:
        """A table at the committed version."""
        while True:
            at = self.version if version is None else version
            if not at:
                return None
            entry = self.folder.read(self._pointer(at))
            if entry is not None:
                return self.spark.read.parquet(entry["data"][name])
            if version is not None:
                raise ValueError(f"version {version} is not kept")

    def upsert(self, symbols: DataFrame, edges: DataFrame, removed_files: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Drop the symbols and edges of removed or changed files (root_id, file_path), add the new ones, as a new version.

        Everything is by root: a file of the same name in another root stays.
        """

        def make(old_s: DataFrame | None, old_e: DataFrame | None) -> tuple[DataFrame, DataFrame]:
            if old_s is None:
                return symbols, edges
            gone = old_s.join(removed_files.select("root_id", "file_path").distinct(), ["root_id", "file_path"], "left_semi").select("id")
            replaced = gone.union(symbols.select("id")).distinct()
            kept_s = old_s.join(replaced, "id", "left_anti").unionByName(symbols, allowMissingColumns=True)
            kept_e = old_e.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(edges.select("id"), "id", "left_anti").unionByName(edges, allowMissingColumns=True)
            return kept_s, kept_e

        return self.change(make, batch=batch)

    def roots(self) -> DataFrame | None:
        """root_id, symbols."""
        s = self.load("symbols")
        return None if s is None else s.groupBy("root_id").agg(F.count("*").alias("symbols"))

    def remove_roots(self, roots: list[str]) -> int:
        """A new version without some roots; the store as it is if it is empty."""
        if not self.version:
            return 0
        keep = lambda d: d.where(~F.col("root_id").isin(roots) | F.col("root_id").isNull())
        return self.change(lambda s, e: (keep(s), keep(e)))

    def sentinel(self) -> dict | None:
        """What the committed version's writer left: schema version, row counts, the last batch of each stream."""
        return self.folder.read(self._pointer(self.version)) if self.version else None
