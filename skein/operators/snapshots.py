"""What changed between full snapshots: a bucketed index from key to content hash.

The index is kept between runs. It holds one row for each key of a root's last snapshot and lies in
buckets of (tbl, root_id, id), so it is joined without being shuffled. A run reads the snapshots that are newer than
the index: their rows are reduced to hashes and aggregated by key into one slot for each of up to ``WAVE`` following
snapshots (one shuffle of narrow rows with partial aggregation), probe the index, and are written once, as the
next index, with what has changed beside each key. The swap to it is one atomic step.
Old values are fetched for changed records only (``fetch_old``), where they are wanted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skein.session import Folder, Stored, bounded_join, content_hash, instant_ms, scratch_path, store

#: New snapshots of a root that one pass compares.
WAVE = 12
KEYS = ["tbl", "root_id", "id"]
POSITIONS = "tbl string, root_id string, done bigint"


def hashed_rows(df: DataFrame, tbl: str, alone: bool = False) -> DataFrame:
    """tbl, root_id, id, scan_version, ms and two hashes of all columns but updated_at and scan_version.

    Rows without id, root or version are no records.
    """
    content = [c for c in df.columns if c not in ("updated_at", "scan_version")]
    ms = F.coalesce(instant_ms("updated_at"), F.lit(-(2**62))).alias("ms")
    good = df.where("id is not null and root_id is not null and scan_version is not null")
    # of a single table the name would be a constant and no longer a key of the join with the buckets
    name = F.concat(F.substring("root_id", 1, 0), F.lit(tbl)) if alone else F.lit(tbl)
    return good.select(name.alias("tbl"), "root_id", "id", "scan_version", ms, *content_hash(content))


def generations(rows: DataFrame, positions: DataFrame) -> DataFrame:
    """tbl, root_id, scan_version, old_version, gen, last: the snapshots above a root's position (tbl, root_id, done).

    ``gen`` counts them from 0, ``last`` is that of the newest, and ``old_version`` the snapshot before (null for a root's first).
    """
    versions = rows.select("tbl", "root_id", "scan_version").distinct().join(positions, ["tbl", "root_id"], "left")
    w = W.partitionBy("tbl", "root_id")
    by_version = w.orderBy("scan_version")
    new = versions.where("done is null or scan_version > done")
    return new.select("tbl", "root_id", "scan_version", F.coalesce(F.lag("scan_version").over(by_version), "done").alias("old_version"), (F.row_number().over(by_version) - 1).alias("gen"), (F.count("*").over(w) - 1).cast("int").alias("last"))


class SnapshotIndex:
    """The hashes of every root's latest processed snapshot in a shared folder, in buckets of (tbl, root_id, id)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.folder, self._names = spark, path.rstrip("/"), Folder(spark, path), []

    def _state(self) -> tuple[int, dict]:
        runs = self.folder.names("runs")
        return (int(runs[-1]), self.folder.read(f"runs/{runs[-1]}")) if runs else (-1, {})

    def _table(self, at: str, buckets: int, schema: str) -> DataFrame:
        """A bucketed folder as a table, named in the catalog for as long as this index is open."""
        name = f"snapshot_index_{uuid.uuid4().hex}"
        keys = ", ".join(KEYS)
        self.spark.sql(f"create table {name} ({schema}) using parquet clustered by ({keys}) sorted by ({keys}) into {buckets} buckets location '{at}'")
        self._names.append(name)
        return self.spark.table(name)

    def close(self) -> None:
        """Take the names out of the catalog. The files stay, also for results that are yet to be read."""
        while self._names:
            self.spark.sql(f"drop table if exists {self._names.pop()}")

    def _write(self, rows: DataFrame) -> dict:
        """Write an index (KEYS, h1, h2, changes) in buckets: where it lies."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name, at = f"snapshot_index_{uuid.uuid4().hex}", f"{self.path}/index-{uuid.uuid4().hex}"
        rows.repartition(n, *KEYS).write.bucketBy(n, *KEYS).sortBy(*KEYS).option("path", at).format("parquet").saveAsTable(name)
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.spark.table(name).schema)
        self._names.append(name)
        return {"at": at, "buckets": n, "schema": schema}

    def read(self) -> DataFrame | None:
        """tbl, root_id, id, h1, h2 of the records of the last snapshots; None before the first run."""
        _, state = self._state()
        return self._table(**state["index"]).where("h1 is not null").select(*KEYS, "h1", "h2") if state else None

    def advance(self, tables: dict[str, DataFrame], wave: int = WAVE) -> DataFrame:
        """tbl, root_id, id, old_version, scan_version, change: what the snapshots above the index added, removed and changed.

        A root's first snapshot fills the index and gives no changes. Several rows of a key in a snapshot count as the
        one with the latest instant (ties: larger hash). Rows of snapshots that the index holds or has passed are not looked
        at. A run that fails leaves the index as it was. Of two runs at once one fails.
        """
        rows = None
        for tbl, df in tables.items():
            part = hashed_rows(df, tbl, len(tables) == 1)
            rows = part if rows is None else rows.unionByName(part)
        number, state = self._state()
        none = self.spark.createDataFrame([], "tbl string, root_id string, id string, old_version bigint, scan_version bigint, change string")
        positions = self.spark.read.schema(POSITIONS).parquet(state["positions"]) if state else self.spark.createDataFrame([], POSITIONS)
        gens = store(generations(rows, positions), "generations")
        top = gens.df.agg(F.max("gen")).first()[0]
        if top is None:
            return none
        ends = store(gens.df.where("gen = last").select("tbl", "root_id", "last"), "ends")
        index, out = state.get("index"), none
        for start in range(0, top + 1, wave):
            count = min(wave, top + 1 - start)
            slots = _slots(rows, gens, start, count)
            if index is None:
                probed = slots.withColumn("p", F.lit(None).cast("struct<h1:bigint,h2:bigint>"))
            else:
                old = self._table(**index).where("h1 is not null").select(*KEYS, F.struct("h1", "h2").alias("p"))
                probed = old.join(slots, KEYS, "full")
            probed = bounded_join(probed, ends, ["tbl", "root_id"], "left", spread=["id"])
            steps, before = [], F.col("p")
            for k in range(count):
                now = F.col(f"s{k}")
                what = F.when(before.isNull() & now.isNotNull(), "added").when(before.isNotNull() & now.isNull(), "removed").when((before["h1"] != now["h1"]) | (before["h2"] != now["h2"]), "changed")
                steps.append(F.struct(F.lit(start + k).alias("gen"), F.when(F.col("last") >= start + k, what).alias("change")))
                before = now
            changed = F.filter(F.array(*steps), lambda s: s["change"].isNotNull())
            newest = F.element_at(F.array(*[F.struct(F.col(f"s{k}.h1"), F.col(f"s{k}.h2")) for k in range(count)]), F.least(F.col("last") - start + 1, F.lit(count)))
            after = F.when(F.col("last") >= start, newest).otherwise(F.col("p"))
            index = self._write(probed.select(*KEYS, after.alias("l"), changed.alias("changes")).where("l.h1 is not null or size(changes) > 0").select(*KEYS, "l.h1", "l.h2", "changes"))
            found = self._table(**index).where("size(changes) > 0").select(*KEYS, F.explode("changes").alias("c")).select(*KEYS, "c.gen", "c.change")
            found = bounded_join(found, gens, ["tbl", "root_id", "gen"], spread=["id"]).where("old_version is not null")
            out = out.unionByName(found.select("tbl", "root_id", "id", "old_version", "scan_version", "change"))
        done = gens.df.where("gen = last").select("tbl", "root_id", F.col("scan_version").alias("done"))
        now = store(positions.join(done, ["tbl", "root_id"], "left_anti").unionByName(done), "positions")
        at = f"{self.path}/positions-{uuid.uuid4().hex}"
        now.df.write.parquet(at)
        if not self.folder.create(f"runs/{number + 1:012d}", {"index": index, "positions": at}):
            raise RuntimeError("another run has moved the index")
        return out


def _slots(rows: DataFrame, gens: Stored, first: int, count: int) -> DataFrame:
    """One row for each key with s0 .. s<count-1>: the valid row's hashes in new snapshots first .. first+count-1."""
    part = bounded_join(rows, gens, ["tbl", "root_id", "scan_version"], spread=["id"])
    part = part.where(F.col("gen").between(first, first + count - 1))
    valid = F.struct("ms", "h1", "h2")
    return part.groupBy(*KEYS).agg(*[F.max(F.when(F.col("gen") == first + k, valid)).alias(f"s{k}") for k in range(count)])


def snapshot_changes(tables: dict[str, DataFrame], wave: int = WAVE) -> DataFrame:
    """tbl, root_id, id, old_version, scan_version, change of all snapshots of some tables, by an index of their own."""
    spark = next(iter(tables.values())).sparkSession
    index = SnapshotIndex(spark, scratch_path(spark, "snapshots"))
    try:
        return index.advance(tables, wave)
    finally:
        index.close()


def fetch_old(changes: Stored, rows: DataFrame, version: str = "old_version") -> DataFrame:
    """The valid rows that changed records had: ``changes`` has root_id, id and ``version``; ``rows`` is the snapshot table.

    With version="scan_version" the rows they have now. Only rows of these keys are moved.
    """
    keys = Stored(changes.df.select("root_id", "id", F.col(version).alias("scan_version")), changes.path, changes.rows, changes.size, changes.weight)
    content = [c for c in rows.columns if c not in ("updated_at", "scan_version")]
    mine = bounded_join(rows, keys, ["root_id", "id", "scan_version"], "left_semi", spread=["updated_at"])
    order = F.struct(F.coalesce(instant_ms("updated_at"), F.lit(-(2**62))), *content_hash(content))
    values = [c for c in rows.columns if c not in ("root_id", "id", "scan_version")]
    valid = mine.groupBy("root_id", "id", "scan_version").agg(F.max_by(F.struct(*values), order).alias("r"))
    return valid.select("root_id", "id", "scan_version", "r.*").select(*rows.columns)


def changed_columns(changes: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """tbl, column, records: how many changed records differ in each column, by their old and new values. Null is a value."""
    out = None
    for tbl, rows in tables.items():
        mine = store(changes.where((F.col("tbl") == tbl) & (F.col("change") == "changed")).select("root_id", "id", "old_version", "scan_version").distinct(), "changed")
        old = fetch_old(mine, rows).withColumnRenamed("scan_version", "old_version")
        new = fetch_old(mine, rows, "scan_version")
        both = mine.df.join(old.alias("o"), ["root_id", "id", "old_version"]).join(new.alias("n"), ["root_id", "id", "scan_version"])
        cols = [c for c in rows.columns if c not in ("root_id", "id", "scan_version", "updated_at")]
        pairs = F.array(*[F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.lit(c)) for c in cols])
        part = both.select(F.explode(F.array_compact(pairs)).alias("column")).groupBy("column").agg(F.count("*").alias("records")).select(F.lit(tbl).alias("tbl"), "column", "records")
        out = part if out is None else out.unionByName(part)
    return out
