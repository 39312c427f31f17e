"""The programming interface: search, traversal, repository map, outcome progress, roots and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skein import schema
from skein.functions import predicates as P
from skein.operators import graph as G
from skein.operators import ranking as R
from skein.operators import search as S
from skein.session import cut

#: Default hops of each traversal, limits, and the sizes from which an impact is summarised.
DEFAULT_HOPS = {"neighbors": 1, "impact": 3, "reachable": 3, "tests_for": 1}
LIMIT, SUMMARY_NODES, SUMMARY_CHARACTERS = 10, 30, 40_000


def filtered(nodes: DataFrame, kind=None, language=None, file=None, root=None, synthetic=None, min_complexity=None, subsystem=None) -> DataFrame:
    """F01 to F08 in one place."""
    if kind is not None:
        nodes = nodes.where(P.equals_ignoring_case("kind", kind))
    if language is not None:
        nodes = nodes.where(P.equals_ignoring_case("language", language))
    if file is not None:
        nodes = nodes.where(P.file_contains("file", file))
    if root is not None:
        nodes = nodes.where(P.in_root("root", root))
    if synthetic is not None:
        nodes = nodes.where(P.synthetic_is("synthetic", synthetic))
    if min_complexity is not None:
        nodes = nodes.where(P.at_least_complex("kind", "cyclomatic", min_complexity))
    if subsystem is not None:
        nodes = nodes.where(P.in_subsystem("subsystem", subsystem))
    return nodes


def search(graph: G.Graph, query: str | None = None, node: str | None = None, nodes: list[str] | None = None, mode: str | None = None, limit: int = LIMIT, sort_by: str = "relevance", hops: int | None = None, edge_types: list[str] | None = None, direction: str = "outgoing", vectors: DataFrame | None = None, asked: DataFrame | None = None, scorer=None, target_subsystem: str | None = None, **filters) -> DataFrame:
    """A list of nodes, else a traversal mode, else one node, else flat search. Nothing is collected."""
    if nodes:
        return batch(graph, nodes, mode, edge_types)
    if mode:
        return traverse(graph, node or query, mode, hops, edge_types, direction, filters.get("subsystem"), target_subsystem)
    if node:
        return entry_points(graph, node)
    if vectors is not None and query:
        return by_vector(graph, query, vectors, asked, limit, sort_by, scorer, **filters)
    hits = filtered(graph.nodes, **filters)
    if query:
        hits = hits.where(P.name_or_signature("name", "signature", query))
    return _best(hits, _order(sort_by, query), limit)


def _order(sort_by: str, query: str | None) -> list:
    orders = {"relevance": S.relevance_order(query or ""), "complexity": [F.desc_nulls_last("cyclomatic"), F.asc("id")], "importance": [F.desc_nulls_last("importance"), F.asc("id")]}
    if sort_by not in orders:
        raise ValueError(f"unknown order {sort_by}; known: {', '.join(orders)}")
    return orders[sort_by]


def _best(hits: DataFrame, order: list, limit: int) -> DataFrame:
    return hits.orderBy(*order).limit(limit).select("*", F.row_number().over(W.orderBy(*order)).alias("place"))


def by_vector(graph: G.Graph, query: str, vectors: DataFrame, asked: DataFrame, limit: int = LIMIT, sort_by: str = "relevance", scorer=None, **filters) -> DataFrame:
    """The nodes nearest to a query's vector, supplemented by name matches, sorted or reranked, with their place.

    ``vectors`` has id, embedding; ``asked`` one row query, embedding. Filters come before the search, so ``limit``
    neighbours are enough. Name matches take the last places; without another order the result is in that of the tiers.
    """
    kept = filtered(graph.nodes, **filters).where(P.embeddable("kind"))
    pool = vectors.join(kept.select("id"), "id", "left_semi")
    near = S.nearest(pool, asked, limit).select("id", "score")
    named = kept.where(P.name_or_signature("name", "signature", query)).select("id", F.coalesce("importance", F.lit(0.0)).alias("score"))
    hits = cut(S.supplement(near, named, limit), "hits").join(kept, "id")
    if scorer is None or sort_by != "relevance":
        return _best(hits, _order(sort_by, query), limit)
    ranked = S.rerank(hits.withColumn("text", F.concat_ws("\n", "signature", "body")), query, scorer)
    return _best(ranked, [F.desc_nulls_last("rerank"), *_order("relevance", query)], limit).drop("text")


def sections(graph: G.Graph, query: str, artifacts: DataFrame, markdown: DataFrame, limit: int = LIMIT, artifact_kinds: list[str] | None = None, **more) -> dict[str, DataFrame]:
    """One search in three sections: code symbols, artifacts (id, kind, title, text) and markdown sections (id, name, level, body).

    R09: artifacts are chosen by kind before the best are taken. They are ranked by the words of the query, sections by ``section_score``.
    """
    chosen = artifacts if artifact_kinds is None else artifacts.where(F.col("kind").isin(artifact_kinds))
    by_word = S.bm25(S.postings(chosen, "id", "text"), S.corpus_lengths(chosen, "text"), query)
    found = S.placed(by_word.select("id", F.round("score", 9).alias("score")), limit).join(chosen.select("id", "kind", "title"), "id")
    scored = markdown.select("id", F.round(S.section_score(query, F.col("name"), F.col("level"), F.col("body")), 9).alias("score")).where("score is not null").distinct()
    return {"symbols": search(graph, query=query, limit=limit, **more), "artifacts": found, "markdown": S.placed(scored, limit)}


def entry_points(graph: G.Graph, wanted: str) -> DataFrame:
    """An id, a short id, path/name, or a name (ignoring case); exact matches only where there are any."""
    n = graph.nodes
    short = F.substr("id", F.length("root") + 2)
    rank = F.when(F.col("id") == wanted, 0).when(short == wanted, 1)
    if parts := P.path_and_name(wanted):
        rank = rank.when(F.col("file").contains(parts[0]) & (F.col("name") == parts[1]), 2)
    rank = rank.when(F.col("name") == wanted, 3).when(F.lower("name") == wanted.lower(), 4)
    hits = n.withColumn("match", rank).where("match is not null")
    return hits.where(F.col("match") == hits.agg(F.min("match")).scalar()).drop("match")


def traverse(graph: G.Graph, wanted: str, mode: str, hops: int | None = None, edge_types: list[str] | None = None, direction: str = "outgoing", subsystem: str | None = None, target_subsystem: str | None = None) -> DataFrame:
    """Neighbors, impact, reachable, tests_for, cycles from the entry points of a name.

    With ``subsystem`` or ``target_subsystem`` only nodes in it (or below it) are kept; nodes then need a column subsystem.
    """
    if mode in ("impact", "tests_for", "cycles") and edge_types:
        raise ValueError(f"{mode} takes no edge_types")
    start = entry_points(graph, wanted).select("id")
    if mode == "cycles":
        comps = cut(G.components(graph.edges), "components")
        return comps.join(comps.join(start, "id", "left_semi").select("component").distinct(), "component", "left_semi").select("id", "component")
    if mode not in DEFAULT_HOPS:
        raise ValueError(f"unknown mode {mode}")
    hops = hops or DEFAULT_HOPS[mode]
    if mode == "impact":
        found = G.reach(graph.edges, start, hops, "incoming", schema.IMPACT_EDGES, True)
    elif mode == "tests_for":
        found = G.reach(graph.edges, start, hops, "incoming", ["calls"], True)
    elif mode == "neighbors":
        found = G.levels(graph.edges, start, hops, direction, edge_types).withColumn("first_kind", F.lit(None).cast("string"))
    else:
        found = G.reach(graph.edges, start, hops, direction, edge_types, True)
    out = G.with_nodes(found, graph.nodes).where(F.col("kind").isNull() | P.shown_in_traversal("kind"))
    for name in (subsystem, target_subsystem):
        if name is not None:
            out = out.join(graph.nodes.where(P.in_subsystem("subsystem", name)).select("id"), "id", "left_semi")
    return out.where(P.is_test_path("file")) if mode == "tests_for" else out


def path(graph: G.Graph, source: str, target: str, edge_types: list[str] | None = None) -> list[str] | None:
    """The ids of a shortest path between two nodes; None if there is none or a node is unknown."""
    ends = [entry_points(graph, x).select("id").orderBy("id").limit(1).collect() for x in (source, target)]
    if not all(ends):
        return None
    return G.shortest_path(graph.edges, ends[0][0][0], ends[1][0][0], edge_types)


def batch(graph: G.Graph, ids: list[str], mode: str | None = None, edge_types: list[str] | None = None, depth: int = 1) -> DataFrame:
    """The nodes of a list of ids (full or short), or their traversal."""
    if mode == "neighbors" and depth > 1:
        raise ValueError("neighbors of several nodes have a depth of 1")
    if mode in ("impact", "tests_for") and edge_types:
        raise ValueError(f"{mode} takes no edge_types")
    wanted = graph.nodes.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], "wanted string")
    found = G.resolve_ids(wanted, graph.nodes)
    if not mode:
        return found.join(graph.nodes, "id")
    direction = "incoming" if mode in ("impact", "tests_for") else "outgoing"
    return G.reach(graph.edges, found.select("id"), DEFAULT_HOPS[mode] if mode != "neighbors" else depth, direction, edge_types or (schema.IMPACT_EDGES if mode == "impact" else None))


def impact_summary(found: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """Per directory when there are more nodes than a listing holds; None otherwise."""
    if found.select("id").distinct().limit(SUMMARY_NODES + 1).count() <= SUMMARY_NODES:
        return None
    hit = found.select("id", "hop").join(nodes.select("id", "root", "file"), "id")
    folder = F.regexp_extract("file", r"^(?:(.*)/)?[^/]*$", 1)
    return hit.groupBy("root", folder.alias("folder")).agg(F.countDistinct("id").alias("affected"), F.min_by("id", F.struct("hop", "id")).alias("entry"))


def repo_map(graph: G.Graph, top_n: int = 15, outcomes: DataFrame | None = None) -> dict[str, DataFrame]:
    """Top symbols, communities (those over half of all nodes are dropped), their interfaces, hotspots, entry points, outcomes."""
    labels = cut(R.subsystems(graph, R.communities(graph)), "labels")
    sizes = R.cohesion(graph, labels).join(R.community_names(graph.nodes, labels), "community")
    total = sizes.agg(F.sum("size")).scalar()
    shown = sizes.where(F.col("size") <= total * 0.5).orderBy(F.desc("size"), "community").limit(15)
    out = {"top_symbols": R.top_symbols(graph.nodes, top_n), "communities": shown, "interfaces": R.interfaces(graph, labels, graph.nodes), "hotspots": R.hotspots(graph.nodes), "entry_points": R.entry_points(graph.nodes)}
    if outcomes is not None:
        out["outcomes"] = outcomes
    return out


def outcome_progress(graph: G.Graph, outcomes: DataFrame, commits: DataFrame, include_impact: bool = False, merges: DataFrame | None = None, serves: DataFrame | None = None, sections: DataFrame | None = None) -> dict[str, DataFrame]:
    """Commits and symbols of outcomes, their merges (J14), markdown sections that name them and (on request) the blast radius, by risk."""
    from skein.operators import passes

    hits = passes.outcome_commits(outcomes, commits)
    symbols = passes.outcome_symbols(hits, commits, graph.nodes)
    out = {"commits": hits, "symbols": symbols}
    if merges is not None:
        none = merges.sparkSession.createDataFrame([], "merge string, outcome string")
        out["merges"] = passes.outcome_merges(outcomes, merges, none if serves is None else serves)
    if sections is not None:
        out["sections"] = passes.outcome_sections(outcomes, sections)
    if include_impact:
        out["impact"] = R.by_risk(G.blast_radius(graph, symbols.select("id").distinct()))
    return out


def list_roots(graph: G.Graph) -> DataFrame:
    return R.statistics(graph)


def render(rows: DataFrame, limit: int = 50, compact: bool = True, per_kind: int | None = None) -> str:
    """A listing for people, after the limit has been applied; grouped by kind with ``per_kind``."""
    cols = [c for c in ("id", "name", "kind", "file", "line_start", "risk", "hop", "signature") if c in rows.columns and (not compact or c not in ("signature", "line_start"))]
    lines = []
    if per_kind:
        w = W.partitionBy("kind").orderBy("id")
        rows = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_kind).orderBy("kind", "id")
    for r in rows.select(*cols).limit(limit).collect():
        lines.append("- " + " | ".join(f"{c}: {r[c]}" for c in cols if r[c] is not None))
    return "\n".join(lines)


def age(seconds: float) -> str:
    """How long ago, in the largest unit that counts."""
    for size, unit in ((86400, "d"), (3600, "h"), (60, "m")):
        if seconds >= size:
            return f"{int(seconds // size)}{unit} ago"
    return "just now" if seconds < 10 else f"{int(seconds)}s ago"
