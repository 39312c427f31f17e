"""Queries p2, p5 and p6: new, changed and missing records, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.incremental import WorkLedger, last_succeeded, process_pending
from skein.operators.references import orphan_counts, orphan_references
from skein.operators.snapshots import SnapshotIndex, changed_columns, snapshot_changes
from skein.session import scratch_path, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edge_id: the edges that still have to be processed, through a work-item ledger."""
    ledger = WorkLedger(spark, scratch_path(spark, "ledger"))
    return process_pending(ledger, table(spark, sf_dir, "edges"), table(spark, sf_dir, "scan_runs"))


def p2_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, edges: two successive runs on one ledger; the second finds nothing that is new."""
    path, args = scratch_path(spark, "ledger"), (table(spark, sf_dir, "edges"), table(spark, sf_dir, "scan_runs"))
    found = [process_pending(WorkLedger(spark, path), *args, only_new=True).agg(F.lit(run).alias("run"), F.count("*").alias("edges")) for run in (1, 2)]
    return found[0].unionByName(found[1])


def p2_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """root_id, done_version: how far each root has been processed."""
    return last_succeeded(table(spark, sf_dir, "scan_runs"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, id, scan_version, change: what changed between consecutive snapshots of symbols and edges."""
    return snapshot_changes({t: table(spark, sf_dir, t) for t in ("symbols", "edges")}).select("tbl", "id", "scan_version", "change")


def p5_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, id, scan_version, change of three runs on one index: of early snapshots, of all, and of nothing new."""
    index = SnapshotIndex(spark, scratch_path(spark, "snapshots"))
    tables = {t: table(spark, sf_dir, t) for t in ("symbols", "edges")}
    middle = table(spark, sf_dir, "edges").agg(F.expr("percentile_disc(0.5) within group (order by scan_version)")).first()[0]
    runs = [index.advance({t: d.where(F.col("scan_version") <= middle) for t, d in tables.items()}), index.advance(tables), index.advance(tables)]
    index.close()
    return runs[0].unionByName(runs[1]).unionByName(runs[2]).select("tbl", "id", "scan_version", "change")


def p5_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, column, records: in which columns changed records differ, by their old and new values."""
    tables = {t: table(spark, sf_dir, t) for t in ("symbols", "edges")}
    return changed_columns(snapshot_changes(tables), tables)


def p5_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, change, n."""
    return p5_found(spark, sf_dir).groupBy("tbl", "change").agg(F.count("*").alias("n"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edge_id, scan_version, endpoint: the ends of edges that name no record."""
    return orphan_references(*(table(spark, sf_dir, t) for t in ("edges", "symbols", "external_symbols")))


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """endpoint, scan_version, orphans."""
    return orphan_counts(p6_found(spark, sf_dir))


MS = "case when abs(updated_at) >= 100000000000 then updated_at else updated_at * 1000 end"
EDGE_COLUMNS = ["source_id", "source_type", "target_id", "target_type", "edge_type", "edge_source", "edge_confidence", "root_id"]
SYMBOL_COLUMNS = "root_id file_path name kind language line_start line_end signature body meta_package meta_name_col cyclomatic importance decorators is_static is_async is_test visibility exported doc_comment".split()

DONE = """
runs as (
  select root_id, run_id, to_version, lower(trim(status)) st,
         row_number() over (partition by root_id, run_id order by logged_at desc, (lower(trim(status)) <> 'started') desc, lower(trim(status)) desc, to_version desc) n
  from scan_runs where run_id is not null and root_id is not null and logged_at is not null),
done as (select root_id, max(to_version) done_version from runs where n = 1 and st = 'succeeded' group by 1)"""

VALID_EDGES = f"valid_edges as (select * from (select *, {MS} ms, row_number() over (partition by id, scan_version order by {MS} desc) n from edges) where n = 1)"


def _changes(tbl: str, columns: list[str]) -> str:
    differs = " or ".join(f"a.{c} is distinct from b.{c}" for c in columns)
    return f"""
{tbl}_v as (select * from (select *, row_number() over (partition by root_id, id, scan_version order by {MS} desc) n from {tbl}) where n = 1),
{tbl}_s as (select *, lead(scan_version) over (partition by root_id order by scan_version) nxt, lag(scan_version) over (partition by root_id order by scan_version) prv
            from (select distinct root_id, scan_version from {tbl})),
{tbl}_c as (
  select '{tbl}' tbl, b.id, b.scan_version, case when a.id is null then 'added' else 'changed' end change
  from {tbl}_v b join {tbl}_s s on s.root_id = b.root_id and s.scan_version = b.scan_version and s.prv is not null
  left join {tbl}_v a on a.root_id = b.root_id and a.id = b.id and a.scan_version = s.prv
  where a.id is null or {differs}
  union all
  select '{tbl}', a.id, s.nxt, 'removed'
  from {tbl}_v a join {tbl}_s s on s.root_id = a.root_id and s.scan_version = a.scan_version and s.nxt is not null
  left join {tbl}_v b on b.root_id = a.root_id and b.id = a.id and b.scan_version = s.nxt where b.id is null)"""


CHANGES = "with " + ",".join([_changes("symbols", SYMBOL_COLUMNS), _changes("edges", EDGE_COLUMNS)]) + ", found as (select * from symbols_c union all select * from edges_c)"


def _columns(tbl: str, columns: list[str]) -> str:
    both = f"{tbl}_v b join {tbl}_s s on s.root_id = b.root_id and s.scan_version = b.scan_version join {tbl}_v a on a.root_id = b.root_id and a.id = b.id and a.scan_version = s.prv"
    return " union all ".join(f"select '{tbl}' tbl, '{c}' \"column\", count(*) records from {both} where a.{c} is distinct from b.{c} having count(*) > 0" for c in columns)


COLUMNS = CHANGES + " " + _columns("symbols", SYMBOL_COLUMNS) + " union all " + _columns("edges", EDGE_COLUMNS)
ORPHANS = f"""with {VALID_EDGES},
ends as (select id edge_id, scan_version, 'source' endpoint, source_id ref from valid_edges union all select id, scan_version, 'target', target_id from valid_edges),
found as (
  select edge_id, scan_version, endpoint from ends e
  where ref <> '' and not exists (select 1 from symbols s where s.id = e.ref and s.scan_version = e.scan_version)
    and not exists (select 1 from external_symbols x where x.id = e.ref))"""

OPEN_EDGES = f"""with {DONE}, {VALID_EDGES},
per_root as (
  select e.root_id, max(scan_version) newest, max(case when scan_version <= done_version then scan_version end) base
  from (select distinct root_id, scan_version from edges) e left join done d on d.root_id = e.root_id group by 1)
select b.id edge_id from valid_edges b join per_root p on p.root_id = b.root_id and p.newest = b.scan_version
left join valid_edges a on a.root_id = b.root_id and a.id = b.id and a.scan_version = p.base
where a.id is null or a.ms is distinct from b.ms or {" or ".join(f"a.{c} is distinct from b.{c}" for c in EDGE_COLUMNS)}"""

QUERIES = {
    "p2_found": (p2_found, OPEN_EDGES),
    "p2_runs": (p2_runs, f"select 1 run, count(*) edges from ({OPEN_EDGES}) union all select 2, 0"),
    "p2_positions": (p2_positions, f"with {DONE} select * from done"),
    "p5_found": (p5_found, CHANGES + " select * from found"),
    "p5_runs": (p5_runs, CHANGES + " select * from found"),
    "p5_columns": (p5_columns, COLUMNS),
    "p5_summary": (p5_summary, CHANGES + " select tbl, change, count(*) n from found group by 1, 2"),
    "p6_found": (p6_found, ORPHANS + " select * from found"),
    "p6_counts": (p6_counts, ORPHANS + " select endpoint, scan_version, count(*) orphans from found group by 1, 2"),
}
