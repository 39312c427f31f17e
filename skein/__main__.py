"""python -m skein COMMAND --store FOLDER ...: scan, search, graph, stats, repo-map, list-roots."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from skein.plans import api, pipeline
from skein.sources.files import slug
from skein.sources.history import boundary_configs
from skein.sources.store import Store


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    p = argparse.ArgumentParser(prog="skein", description=__doc__)
    p.add_argument("--store", required=True)
    sub = p.add_subparsers(dest="command", required=True)
    scan = sub.add_parser("scan")
    scan.add_argument("folders", nargs="+")
    scan.add_argument("--configs")
    find = sub.add_parser("search")
    find.add_argument("query")
    for name in ("kind", "language", "file", "root"):
        find.add_argument(f"--{name}")
    find.add_argument("--min-complexity", type=int)
    find.add_argument("--limit", type=int, default=20)
    find.add_argument("--sort-by", default="relevance", choices=["relevance", "complexity", "importance"])
    walk = sub.add_parser("graph")
    walk.add_argument("node")
    walk.add_argument("--mode", default="neighbors", choices=["neighbors", "impact", "reachable", "tests_for", "cycles"])
    walk.add_argument("--hops", type=int)
    walk.add_argument("--edge-types", nargs="*")
    for name in ("stats", "repo-map", "list-roots"):
        sub.add_parser(name)
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("skein").getOrCreate()
    store = Store(spark, a.store)
    if a.command == "scan":
        configs = boundary_configs(a.configs) if a.configs else None
        return f"version {pipeline.build(spark, {slug(f): f for f in a.folders}, store, configs)}"
    if not store.version:
        return "nothing has been scanned"
    graph = pipeline.open_graph(store)
    if a.command == "search":
        return api.render(api.search(graph, a.query, limit=a.limit, sort_by=a.sort_by, kind=a.kind, language=a.language, file=a.file, root=a.root, min_complexity=a.min_complexity).orderBy("place"), a.limit)
    if a.command == "graph":
        return api.render(api.traverse(graph, a.node, a.mode, a.hops, a.edge_types or None))
    if a.command == "repo-map":
        return "\n".join(f"## {name}\n{api.render(df) if 'id' in df.columns else chr(10).join(map(str, df.collect()))}" for name, df in api.repo_map(graph).items())
    return "\n".join(str(r.asDict()) for r in api.list_roots(graph).orderBy("root").collect())


if __name__ == "__main__":
    print(main())
