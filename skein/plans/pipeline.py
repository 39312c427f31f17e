"""The index build: files to a committed version of the store, stage by stage.

scan, decode, extract, merges, import resolution, link passes in their fixed order,
ranking, communities, persist; ``embed`` then brings the vectors up to date. Each stage is a DataFrame; what several later
stages read is written to the scratch folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import passes as L
from skein.operators import ranking as R
from skein.operators import search as S_
from skein.operators.graph import Graph
from skein.session import cut
from skein.sources import history as H
from skein.sources import extract as X
from skein.sources import files as S
from skein.sources.history import manifest_packages
from skein.sources.store import Store

EDGES = ["source_id", "target_id", "edge_type", "edge_confidence"]


def typed(nodes: DataFrame) -> DataFrame:
    """Nodes with the columns that passes and ranking read promoted from the metadata."""
    m = lambda key: F.try_element_at("metadata", F.lit(key))
    return nodes.select("*", m("decorators").alias("decorators"), (m("is_test") == "true").alias("is_test"), m("cyclomatic").cast("int").alias("cyclomatic"), m("doc_comment").alias("doc_comment"), F.lit(None).cast("double").alias("importance"))


def resolved_imports(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Targets of import edges that name a file by its module path point to that file's module node."""
    modules = nodes.where("kind = 'module'").select("root", "file", F.col("id").alias("module"))
    stem = F.regexp_replace(F.regexp_replace("file", r"\.[^./]+$", ""), r"/(?:__init__|index|mod)$", "")
    ends = modules.select("root", "module", F.explode(L.suffixes(stem)).alias("end"))
    unique = ends.groupBy("root", "end").agg(F.count("*").alias("n"), F.min("module").alias("module")).where("n = 1").drop("n")
    imports = edges.where((F.col("edge_type") == "depends_on") & F.col("target_id").endswith(":module"))
    name = F.regexp_extract("target_id", r"^[^:]*:.*?:(.*):module$", 1)
    path = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"^(?:crate::|\.+/?|(?:\.\./)+)", ""), r"::|(?<=\w)\.(?=\w)", "/"), r"^/|\.[jt]sx?$", ""))
    out = imports.select("*", F.split_part("source_id", F.lit(":"), F.lit(1)).alias("root"), path.alias("end")).join(unique, ["root", "end"], "left")
    hit = out.where("module is not null").select("source_id", F.col("module").alias("target_id"), "edge_type", F.lit("confirmed").alias("edge_confidence"))
    rest = out.where("module is null").select(*EDGES)
    return edges.join(imports.select("source_id", "target_id", "edge_type"), ["source_id", "target_id", "edge_type"], "left_anti").select(*EDGES).unionByName(hit).unionByName(rest)


def link(nodes: DataFrame, files: DataFrame, configs: list[dict] | None = None) -> tuple[DataFrame, DataFrame]:
    """2.8: run the link passes in order over all nodes: (nodes with rewritten paths, new edges)."""
    used = L.frameworks(nodes)
    detected = sorted(r[0] for r in used.select("framework").distinct().collect())  # at most the frameworks of the rule table
    texts = files.select("root", F.col("path").alias("file"), F.col("text").alias("body"))
    if "fastapi" in detected:
        nodes = cut(L.apply_router_prefixes(nodes, L.router_prefixes(texts.where(F.col("file").endswith(".py")))), "routed")
        full = L.sdk_full_paths(nodes).withColumnRenamed("http_path", "full")
        keep = F.map_filter("metadata", lambda k, _: k != "http_path")
        path = F.map_from_entries(F.array(F.struct(F.lit("http_path").alias("key"), F.col("full").alias("value"))))
        nodes = nodes.join(full, "id", "left").withColumn("metadata", F.when(F.col("full").isNull(), F.col("metadata")).otherwise(F.map_concat(keep, path))).drop("full")
    packages = manifest_packages(files)
    manifests = L.edges(packages.select(F.concat_ws(":", "root", "manifest", "manifest", F.lit("module")).alias("m"), F.concat_ws(":", F.lit("external"), "ecosystem", "package", F.lit("package")).alias("p")), "m", "p", "depends_on")
    parts = [
        L.framework_edges(nodes), L.url_links(nodes), L.sdk_links(nodes), manifests, L.test_links(nodes), L.import_calls(nodes), L.same_file_calls(nodes), L.directory_modules(nodes), L.topics(nodes, detected),
        L.route_handlers(files.select("root", F.col("path").alias("file")), nodes), L.rpc_calls(nodes), L.boundaries(nodes, configs or []),
    ]
    if "socketio" in detected:
        parts.append(L.socket_events(nodes))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return nodes, out


def minimal_endpoint_nodes(files: DataFrame) -> DataFrame:
    """P14 as nodes of C# files."""
    hits = L.minimal_endpoints(files.where(F.col("path").endswith(".cs")).select("root", F.col("path").alias("file"), F.col("text").alias("body")))
    meta = F.map_from_entries(F.array(F.struct(F.lit("http_method").alias("key"), F.col("method").alias("value")), F.struct(F.lit("http_path").alias("key"), F.col("path").alias("value"))))
    name = F.concat_ws(" ", "method", "path")
    return hits.select(
        F.concat_ws(":", "root", "file", name, F.lit("api_endpoint")).alias("id"), "root", "file", name.alias("name"), F.lit("api_endpoint").alias("kind"), F.lit("csharp").alias("language"),
        F.col("line").alias("line_start"), F.col("line").alias("line_end"), F.lit("").alias("signature"), F.lit("").alias("body"), meta.alias("metadata"),
    )


def ranked(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with importance and subsystem; ranks come before virtual nodes are added."""
    graph = Graph(nodes, edges)
    importance = R.pagerank(graph)
    labels = R.subsystems(graph, R.communities(graph))
    names = R.community_names(nodes, labels).withColumnRenamed("name", "subsystem")
    placed = labels.join(names, "community").select("id", "subsystem")
    return nodes.drop("importance").join(importance, "id", "left").join(placed, "id", "left")


def merge_nodes(spark: SparkSession, repos: dict[str, str]) -> DataFrame:
    """The merges of each root's git repository as nodes, with their files."""
    out = None
    for root, folder in repos.items():
        part = H.merges(H.commits(spark, folder)).withColumn("root", F.lit(root))
        out = part if out is None else out.unionByName(part)
    pairs = [("branch", F.coalesce("branch", F.lit(""))), ("outcomes", F.array_join("outcomes", ",")), ("timestamp", F.col("timestamp").cast("string"))]
    meta = F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs]))
    none = F.lit(None).cast("int")
    return out.select(
        F.concat_ws(":", "root", F.lit("git"), "hash", F.lit("pr_merge")).alias("id"), "root", F.lit("git").alias("file"), F.col("title").alias("name"), F.lit("pr_merge").alias("kind"), F.lit(None).cast("string").alias("language"),
        none.alias("line_start"), none.alias("line_end"), F.col("title").alias("signature"), F.lit("").alias("body"), meta.alias("metadata"), "files",
    )


def modified(merges: DataFrame, nodes: DataFrame) -> DataFrame:
    """P16 by root: a merge modified the symbols of its files."""
    files = merges.select("id", "root", F.explode("files").alias("file")).distinct()
    touched = files.join(nodes.where("kind not in ('import', 'module', 'pr_merge')").select("root", "file", F.col("id").alias("symbol")), ["root", "file"])
    return L.edges(touched, "id", "symbol", "modified")


def framework_shares(nodes: DataFrame) -> DataFrame:
    """Subsystems use the frameworks that most of their members' files use."""
    node = lambda folder, name, kind: F.concat_ws(":", "root", F.lit(folder), name, F.lit(kind))
    members = nodes.where("subsystem is not null").select("root", "file", node("subsystems", "subsystem", "subsystem").alias("subsystem"))
    shares = L.subsystem_frameworks(members, L.frameworks(nodes)).withColumn("root", F.split_part("subsystem", F.lit(":"), F.lit(1)))
    return L.edges(shares.withColumn("target", node("frameworks", "framework", "framework")), "subsystem", "target", "uses_framework")


def embed(store: Store, size: int = 64) -> dict[str, int]:
    """Bring the store's vectors up to its symbols: how many were embedded, deleted and kept.

    Rows are named by a hash of their text; only those whose hash is not held are embedded. The new table is committed in one step.
    """
    symbols = store.load("symbols").select("id", "kind", "name", "language", "body", "doc_comment")
    rows = cut(S_.index_rows(symbols).withColumn("text_hash", F.sha2("text", 256)), "index_rows")
    done = store.folder.names("embedded")
    old = store.spark.read.parquet(store.folder.read(f"embedded/{done[-1]}")["data"]) if done else store.spark.createDataFrame([], "id string, embedding array<float>, kind string, title string, text_hash string")
    new, stale, kept = S_.upsert_embeddings(old, rows)
    made = S_.hashed_vectors(new, "id", "text", size).join(new.select("id", "kind", "title", "text_hash"), "id")
    at = f"{store.path}/embeddings/{uuid.uuid4().hex}"
    kept.select("id", "embedding", "kind", "title", "text_hash").unionByName(made.select("id", "embedding", "kind", "title", "text_hash")).write.parquet(at)
    counts = {"embedded": new.count(), "deleted": stale.count(), "kept": kept.count()}
    if not store.folder.create(f"embedded/{int(done[-1]) + 1 if done else 0:012d}", {"data": at}):
        raise RuntimeError("another writer has embedded meanwhile")
    return counts


def build(spark: SparkSession, roots: dict[str, str], store: Store, configs: list[dict] | None = None, excludes: list[str] | None = None, repos: dict[str, str] | None = None) -> int:
    """3.1: index the roots (slug to folder) from scratch, with the merges of their git repositories (``repos``); the committed version."""
    files = S.decoded(S.scan(spark, roots, excludes)).where("not binary")
    files = cut(files.select("root", "path", "text", "modified", "size", F.sha2("content", 256).alias("sha256")), "files")
    sources = files.select("root", F.col("path").alias("file"), F.lit(None).cast("string").alias("language"), F.col("text").alias("body"))
    rows = cut(X.extract(sources), "rows")
    nodes = X.nodes_of(rows).unionByName(minimal_endpoint_nodes(files))
    merges = cut(merge_nodes(spark, repos), "merges") if repos else None
    if merges is not None:
        nodes = nodes.unionByName(merges.drop("files"), allowMissingColumns=True)
    nodes = cut(typed(nodes), "nodes")
    found = cut(resolved_imports(X.edges_of(rows).withColumn("edge_confidence", F.lit("detected")), nodes), "edges")
    nodes, linked = link(nodes, files, configs)
    if merges is not None:
        linked = linked.unionByName(modified(merges, nodes))
    edges = cut(found.unionByName(linked).groupBy("source_id", "target_id", "edge_type").agg(F.min("edge_confidence").alias("edge_confidence")), "edges")
    nodes = cut(ranked(nodes, edges), "ranked")
    virtual = L.subsystem_nodes(nodes.where("subsystem is not null")).select(*EDGES).unionByName(framework_shares(nodes).select(*EDGES))
    edges = edges.unionByName(virtual).withColumn("id", F.concat("source_id", F.lit("->"), "edge_type", F.lit("->"), "target_id")).withColumn("root_id", F.split_part("source_id", F.lit(":"), F.lit(1)))
    symbols = nodes.withColumnsRenamed({"root": "root_id", "file": "file_path"})
    return store.persist(symbols, edges)


def open_graph(store: Store) -> Graph:
    """The committed version as a graph."""
    return Graph(store.load("symbols").withColumnsRenamed({"root_id": "root", "file_path": "file"}), store.load("edges"))
