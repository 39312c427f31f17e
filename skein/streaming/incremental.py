"""Incremental indexing as a stream (T01 to T05, T09, T10): file batches into the store, exactly once.

``foreachBatch`` gets each micro-batch with its number, which is committed in the
same step as the version that holds it, so a batch that is delivered again after a
failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from skein.plans import pipeline
from skein.session import cut
from skein.sources import extract
from skein.sources.store import Store

FILES = "root string, file string, language string, body string, deleted boolean"


def as_tables(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Extracted rows as the store's symbols and edges."""
    nodes = extract.nodes_of(rows)
    symbols = nodes.select("id", F.col("root").alias("root_id"), F.col("file").alias("file_path"), "name", "kind", "language", "line_start", "line_end", "signature", "body", "metadata")
    edges = extract.edges_of(rows).withColumn("root_id", F.split_part("source_id", F.lit(":"), F.lit(1)))
    return symbols, edges.withColumn("id", F.concat("source_id", F.lit("->"), "edge_type", F.lit("->"), "target_id"))


def latest(files: DataFrame) -> DataFrame:
    """One row for each (root, file) of a batch: the last by arrival (column seq), else any of equal content."""
    order = F.struct(F.col("seq") if "seq" in files.columns else F.lit(0), F.coalesce("body", F.lit("")))
    return files.groupBy("root", "file").agg(F.max_by(F.struct("language", "body", "deleted"), order).alias("r")).select("root", "file", "r.*")


def apply_batch(store: Store, files: DataFrame, batch: int, stream: str = "files") -> int:
    """Apply one batch of changed and deleted files; the store's version. A batch applied before is skipped."""
    applied = store.sentinel()
    if applied and applied["batches"].get(stream, -1) >= batch:
        return store.version
    files = latest(files)
    alive = files.where(~F.coalesce("deleted", F.lit(False)))
    symbols, edges = (cut(d, "batch") for d in as_tables(extract.extract(alive)))
    gone = files.select(F.col("root").alias("root_id"), F.col("file").alias("file_path"))
    return store.upsert(symbols, edges, gone, batch=(stream, batch))


def remove_missing_roots(store: Store, roots: list[str]) -> int:
    """Drop the roots that no longer exist; ``roots`` are those that do. Unchanged if none is gone."""
    if not store.version:
        return 0
    gone = [r[0] for r in store.roots().where(~F.col("root_id").isin(roots)).select("root_id").collect()]
    return store.remove_roots(gone) if gone else store.version


def refresh(store: Store) -> int:
    """Run the link passes and the ranking again over all committed nodes; the new version.

    Edges of earlier passes are replaced, so edges to what is gone disappear and the
    result is that of a full build over the same nodes. Passes that read whole files
    (routers, routes, manifests) belong to the full build.
    """

    def make(symbols: DataFrame | None, edges: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        if symbols is None:
            raise ValueError("the store is empty")
        base = ["id", "root", "file", "name", "kind", "language", "line_start", "line_end", "signature", "body", "metadata"]
        nodes = pipeline.typed(symbols.withColumnsRenamed({"root_id": "root", "file_path": "file"}).select(*base))
        if "edge_source" in edges.columns:
            edges = edges.where("edge_source is null or edge_source <> 'pass'")
        own = edges.select("source_id", "target_id", "edge_type", F.lit("detected").alias("edge_confidence"), F.lit(None).cast("string").alias("edge_source"))
        none = store.spark.createDataFrame([], "root string, path string, text string")
        nodes, linked = pipeline.link(nodes, none)
        both = own.unionByName(linked.withColumn("edge_source", F.lit("pass")))
        both = cut(both.groupBy("source_id", "target_id", "edge_type").agg(F.min("edge_confidence").alias("edge_confidence"), F.min(F.coalesce("edge_source", F.lit(""))).alias("edge_source")), "edges")
        ranked = pipeline.ranked(nodes, both).withColumnsRenamed({"root": "root_id", "file": "file_path"})
        named = both.withColumn("id", F.concat("source_id", F.lit("->"), "edge_type", F.lit("->"), "target_id")).withColumn("root_id", F.split_part("source_id", F.lit(":"), F.lit(1)))
        return ranked, named

    return store.change(make)


def index_stream(spark: SparkSession, source: str, store: Store, checkpoint: str, available_now: bool = True, relink: bool = False) -> StreamingQuery:
    """Watch a folder of Parquet file batches (schema FILES) and keep the store up to date; with ``relink`` its links and ranks too."""
    files = spark.readStream.schema(FILES).parquet(source)

    def step(batch: DataFrame, number: int) -> None:
        apply_batch(store, batch, number)
        if relink:
            refresh(store)  # also after a batch that comes again: a failure may have come between the two

    writer = files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="900 seconds")).start()


def embed_stream(changed: DataFrame, stored: DataFrame, id_col: str = "id") -> DataFrame:
    """The rows of a batch whose text_hash the embedding table lacks."""
    return changed.join(stored.select(id_col, "text_hash"), [id_col, "text_hash"], "left_anti")


class Progress(StreamingQueryListener):
    """Rows and batches seen so far."""

    def __init__(self):
        self.batches, self.rows, self.failed = 0, 0, 0

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.batches += 1
        self.rows += int(event.progress.numInputRows or 0)

    def onQueryTerminated(self, event):
        self.failed += bool(event.exception)
