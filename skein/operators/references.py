"""References to records that do not exist: parent keys as contiguous runs.

The parent keys of one id are the integer versions under which the id exists.
Sorted, they are compressed into contiguous runs; a reference (id, version) is
matched as of the last run that starts at or before it and is an orphan if that
run ends before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import bounded_join, instant_ms, store


def runs_of(versions):
    """Column: a sorted array of distinct integers as runs (start, end) of consecutive ones, by comparing neighbours."""
    starts = F.filter(versions, lambda v, i: (i == 0) | (F.get(versions, i - 1) != v - 1))
    ends = F.filter(versions, lambda v, i: F.coalesce(F.get(versions, i + 1) != v + 1, F.lit(True)))
    return F.arrays_zip(starts.alias("start"), ends.alias("end"))


def parent_runs(symbols: DataFrame) -> DataFrame:
    """id, runs. The versions of one id are as many as its root has snapshots."""
    good = symbols.where("id is not null and scan_version is not null")
    sets = good.groupBy("id").agg(F.array_sort(F.collect_set("scan_version")).alias("versions"))
    return sets.select("id", runs_of(F.col("versions")).alias("runs"))


def orphan_keys(edges: DataFrame, symbols: DataFrame, external: DataFrame) -> DataFrame:
    """ref, scan_version: the referenced ids that no symbol of that version and no external symbol has."""
    ends = edges.where("scan_version is not null").select("scan_version", F.explode(F.array("source_id", "target_id")).alias("ref"))
    refs = ends.where("ref <> ''").groupBy("ref").agg(F.collect_set("scan_version").alias("versions"))
    known = store(external.select(F.col("id").alias("ref")).where("ref is not null").distinct(), "external")
    refs = bounded_join(refs, known, ["ref"], "left_anti")
    held = refs.join(parent_runs(symbols).withColumnRenamed("id", "ref"), "ref", "left")

    def missing(v):
        before = F.filter(F.col("runs"), lambda r: r["start"] <= v)
        return F.col("runs").isNull() | (F.size(before) == 0) | (F.get(before, F.size(before) - 1)["end"] < v)

    return held.select("ref", F.explode(F.filter("versions", missing)).alias("scan_version"))


def orphan_references(edges: DataFrame, symbols: DataFrame, external: DataFrame) -> DataFrame:
    """edge_id, scan_version, endpoint: the ends of valid edge rows that name no record of their version.

    The valid row of (id, scan_version) has the latest instant (ties: the
    larger source, then target). Null or empty ids are no references; rows
    without id or version are no records. Orphan keys are found on distinct
    references, so that only rows which touch one are read again and ordered.
    """
    orphans = store(orphan_keys(edges, symbols, external), "orphans")
    rows = edges.where("id is not null and scan_version is not null")
    rows = rows.select("id", "scan_version", instant_ms("updated_at").alias("ms"), "source_id", "target_id")
    touching = None
    for end in ("source_id", "target_id"):
        part = bounded_join(rows.withColumnRenamed(end, "ref"), orphans, ["ref", "scan_version"], "left_semi", spread=["id"]).select("id", "scan_version")
        touching = part if touching is None else touching.union(part)
    keys = store(touching.distinct(), "touching")
    valid = (
        bounded_join(rows, keys, ["id", "scan_version"], "left_semi", spread=["id"])
        .groupBy("id", "scan_version")
        .agg(F.max(F.struct(F.coalesce("ms", F.lit(-(2**62))).alias("ms"), F.coalesce("source_id", F.lit("")).alias("source"), F.coalesce("target_id", F.lit("")).alias("target"))).alias("v"))
    )
    pairs = F.array(*[F.struct(F.lit(e).alias("endpoint"), F.col(f"v.{e}").alias("ref")) for e in ("source", "target")])
    ends = valid.select(F.col("id").alias("edge_id"), "scan_version", F.explode(pairs).alias("e")).select("edge_id", "scan_version", "e.endpoint", "e.ref")
    return bounded_join(ends, orphans, ["ref", "scan_version"], "left_semi", spread=["edge_id"]).select("edge_id", "scan_version", "endpoint")


def orphan_counts(found: DataFrame) -> DataFrame:
    """endpoint, scan_version, orphans: the report per end and period."""
    return found.groupBy("endpoint", "scan_version").agg(F.count("*").alias("orphans"))
