"""The property graph and its traversals.

``symbols`` and ``edges`` are snapshot tables; the graph is the valid rows of
every root's newest snapshot. Traversals are frontier loops: each hop joins the
frontier with the edges, drops what was visited and is written to the scratch
folder, so lineage stays short and the frontier's size is known before it may be
broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import schema
from skein.functions import predicates as P
from skein.session import Stored, bounded_join, instant_ms, store, table


def newest(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """The valid rows of every root's newest snapshot: one row for each id with ``cols`` (all but the version columns if None).

    Only the wanted columns are read and moved. Rows of one id and instant that differ in them are decided by their hash.
    """
    wanted = [c for c in df.columns if c not in ("scan_version", "updated_at")] if cols is None else list(dict.fromkeys(["id", *cols]))
    last = df.where("root_id is not null").groupBy("root_id").agg(F.max("scan_version").alias("scan_version"))
    rows = df.join(last, ["root_id", "scan_version"], "left_semi").where("id is not null")
    others = [c for c in wanted if c != "id"]
    order = F.struct(F.coalesce(instant_ms("updated_at"), F.lit(-(2**62))), F.xxhash64(*wanted))
    if not others:
        return rows.select("id").distinct()
    valid = rows.groupBy("id").agg(F.max_by(F.struct(*others), order).alias("r"))
    return valid.select("id", "r.*").select(*wanted)


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def stored(self) -> Graph:
        """The graph written to the scratch folder, for loops that read it again and again."""
        return Graph(store(self.nodes, "nodes").df, store(self.edges, "edges").df)


def load(spark: SparkSession, sf_dir: str, node_cols: str | None = None, edge_cols: str = "edge_type") -> Graph:
    """Nodes (id, root, file, name, kind, ...) and deduplicated edges (source_id, target_id, edge_type, ...).

    ``node_cols`` and ``edge_cols`` name the columns that are wanted beside the ids.
    """
    stored = {"root": "root_id", "file": "file_path"}
    cols = None if node_cols is None else [stored.get(c, c) for c in node_cols.split()]
    nodes = newest(table(spark, sf_dir, "symbols"), cols).withColumnsRenamed({v: k for k, v in stored.items()})
    edges = newest(table(spark, sf_dir, "edges"), ["source_id", "target_id", *edge_cols.split()]).where("source_id <> '' and target_id <> ''")
    return Graph(nodes, edges)


def check_kinds(kinds: list[str] | None) -> list[str] | None:
    """Edge kinds of a filter; an unknown one is an error, not a filter that matches nothing."""
    if kinds is None:
        return None
    unknown = [k for k in kinds if k not in schema.EDGE_KINDS]
    if unknown:
        raise ValueError(f"unknown edge kinds: {', '.join(unknown)}; known: {', '.join(schema.EDGE_KINDS)}")
    return kinds


def steps(edges: DataFrame, direction: str = "outgoing", kinds: list[str] | None = None) -> DataFrame:
    """at, to, edge_type: the edges as steps of a walk. Parallel edges of different kinds are kept."""
    if check_kinds(kinds) is not None:
        edges = edges.where(F.col("edge_type").isin(kinds))
    out = edges.select(F.col("source_id").alias("at"), F.col("target_id").alias("to"), "edge_type")
    if direction == "outgoing":
        return out
    back = edges.select(F.col("target_id").alias("at"), F.col("source_id").alias("to"), "edge_type")
    return back if direction == "incoming" else out.unionByName(back)


def neighbors(edges: DataFrame, ids: DataFrame, direction: str = "outgoing", kinds: list[str] | None = None) -> DataFrame:
    """Source, edge_type, id of the direct neighbors of ``ids`` (a column id)."""
    at = store(ids.select(F.col("id").alias("at")).distinct(), "ids")
    return bounded_join(steps(edges, direction, kinds), at, ["at"], spread=["to"]).select(F.col("at").alias("source"), "edge_type", F.col("to").alias("id"))


def grouped_neighbors(found: DataFrame) -> DataFrame:
    """Source, edge_type, neighbors, n in the order of the edge kinds; the lists hold distinct ids, sorted."""
    rank = F.array_position(F.array(*[F.lit(k) for k in schema.EDGE_KINDS]), F.col("edge_type"))
    each = found.distinct().groupBy("source", "edge_type").agg(F.array_sort(F.collect_list("id")).alias("neighbors"), F.count("*").alias("n"))
    return each.withColumn("kind_rank", rank)


def with_nodes(ids: DataFrame, nodes: DataFrame, how: str = "left") -> DataFrame:
    """Node columns for ids; unknown ids are kept with how="left"."""
    return ids.join(nodes.select("id", "root", "file", "name", "kind"), "id", how)


#: Hops after which what has been seen is written anew, so that plans of long walks stay short.
REWRITE = 12


def reach(edges: DataFrame, sources: DataFrame, max_hops: int | None, direction: str = "outgoing", kinds: list[str] | None = None, first_kinds: bool = False) -> DataFrame:
    """Source, id, hop for everything within ``max_hops`` (None: any number) of each source, itself excluded.

    ``sources`` has a column id. With ``first_kinds`` (G16) also first_kind, the kind of
    the first step of a shortest walk (of several, the first in the order of kinds).
    Null ids reach nothing; repeated sources count once; rings end.
    """
    walk = steps(edges, direction, kinds).where("at is not null and to is not null")
    rank = F.array_position(F.array(*[F.lit(k) for k in schema.EDGE_KINDS]), F.col("edge_type")).cast("int")
    walk = store(walk.select("at", "to", (rank if first_kinds else F.lit(0)).alias("kind")).distinct(), "steps").df
    start = sources.where("id is not null").select(F.col("id").alias("source"), "id").distinct()
    frontier = store(start.withColumn("first", F.lit(0)), "frontier")
    seen, hop = frontier.df.withColumn("hop", F.lit(0)), 0
    while frontier.rows and (max_hops is None or hop < max_hops):
        hop += 1
        at = Stored(frontier.df.withColumnRenamed("id", "at"), frontier.path, frontier.rows, frontier.size, frontier.weight)
        stepped = bounded_join(walk, at, ["at"], spread=["to"])
        first = F.col("kind") if hop == 1 else F.col("first")
        new = stepped.select("source", F.col("to").alias("id"), first.alias("first")).groupBy("source", "id").agg(F.min("first").alias("first"))
        frontier = store(new.join(seen.select("source", "id"), ["source", "id"], "left_anti"), "frontier")
        seen = seen.unionByName(frontier.df.withColumn("hop", F.lit(hop)))
        if hop % REWRITE == 0:
            seen = store(seen, "seen").df
    found = seen.where("hop > 0")
    if not first_kinds:
        return found.select("source", "id", "hop")
    names = F.array(*[F.lit(k) for k in schema.EDGE_KINDS])
    return found.select("source", "id", "hop", F.get(names, F.col("first") - 1).alias("first_kind"))


def levels(edges: DataFrame, sources: DataFrame, depth: int, direction: str = "both", kinds: list[str] | None = None) -> DataFrame:
    """Source, id, hop level by level, nothing twice across levels."""
    return reach(edges, sources, depth, direction, kinds)


def shortest_path(edges: DataFrame, source: str, target: str, kinds: list[str] | None = None) -> list[str] | None:
    """The ids after ``source`` up to ``target`` by fewest steps; [] if they are equal, None if there is no way.

    Of several shortest paths the one with the smallest id at each step back from the target is taken.
    """
    if source == target:
        return []
    spark = edges.sparkSession
    walk = store(steps(edges, "outgoing", kinds or ["calls"]).select("at", "to").distinct(), "steps").df
    frontier = store(spark.createDataFrame([(source,)], "id string"), "frontier")
    seen, layers = frontier.df, []
    while True:
        at = Stored(frontier.df.withColumnRenamed("id", "at"), frontier.path, frontier.rows, frontier.size, frontier.weight)
        new = bounded_join(walk, at, ["at"], spread=["to"]).groupBy(F.col("to").alias("id")).agg(F.min("at").alias("parent"))
        layer = store(new.join(seen, "id", "left_anti"), "layer")
        if not layer.rows:
            return None
        layers.append(layer.df)
        if layer.df.where(F.col("id") == target).limit(1).collect():
            break
        frontier = Stored(layer.df.select("id"), layer.path, layer.rows, layer.size, layer.weight)
        seen = seen.unionByName(frontier.df)
        if len(layers) % REWRITE == 0:
            seen = store(seen, "seen").df
    path, at = [], target
    for layer in reversed(layers):
        path.append(at)
        at = layer.where(F.col("id") == at).select("parent").first()[0]
    return path[::-1]


def distances(edges: DataFrame, source: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """source, id, hop: the length of the shortest path to everything reachable."""
    return reach(edges, source, None, "outgoing", kinds or ["calls"])


def numbered(ids: DataFrame) -> Stored:
    """id, n: distinct numbers for distinct ids in an order without pattern (that of their hashes), for loops on numbers."""
    return store(ids.select("id").distinct().orderBy(F.xxhash64("id"), "id").select("id", F.monotonically_increasing_id().alias("n")), "numbers")


def _trimmed(walk: Stored) -> Stored:
    """Without steps that no ring can hold: nodes with no step in or none out are dropped while that pays."""
    while walk.rows:
        ins, outs = walk.df.select(F.col("to").alias("at")).distinct(), walk.df.select(F.col("at").alias("to")).distinct()
        left = store(walk.df.join(ins, "at", "left_semi").join(outs, "to", "left_semi").select("at", "to"), "steps")
        if left.rows > 0.9 * walk.rows:
            return left
        walk = left
    return walk


def _colours(walk: DataFrame) -> DataFrame:
    """n, f, b: the largest number that reaches n, and the largest one that n reaches.

    Each round passes both on along the steps and takes those of the nodes they name, so distances are halved.
    """
    ends = walk.select(F.col("at").alias("n")).union(walk.select(F.col("to").alias("n"))).distinct()
    now = store(ends.select("n", F.col("n").alias("f"), F.col("n").alias("b")), "colours").df
    both = walk.select("at", "to", F.lit(True).alias("on")).union(walk.select("to", "at", F.lit(False)))
    while True:
        passed = both.join(now.withColumnRenamed("n", "at"), "at").groupBy(F.col("to").alias("n")).agg(F.max(F.when(F.col("on"), F.col("f"))).alias("pf"), F.max(F.when(~F.col("on"), F.col("b"))).alias("pb"))
        one = now.join(passed, "n", "left").select("n", "f", "b", F.greatest("f", "pf").alias("vf"), F.greatest("b", "pb").alias("vb"))
        two = one.join(now.select(F.col("n").alias("vf"), F.col("f").alias("ff")), "vf").join(now.select(F.col("n").alias("vb"), F.col("b").alias("bb")), "vb")
        new = two.select("n", F.greatest("vf", "ff").alias("nf"), F.greatest("vb", "bb").alias("nb"), "f", "b")
        new = store(new.select("n", F.col("nf").alias("f"), F.col("nb").alias("b"), ((F.col("nf") > F.col("f")) | (F.col("nb") > F.col("b"))).alias("moved")), "colours").df
        now = new.select("n", "f", "b")
        if new.where("moved").isEmpty():
            return now


def components(edges: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Id, component (the smallest id in it), size of the strongly connected components of two or more nodes.

    Nodes are coloured by the largest number that reaches them and by the largest one they reach: where both are
    the same, they form a component. Steps between other nodes of the same two colours go through the next round. Numbers
    follow no order of the graph, so each round is expected to break what chains are left.
    """
    named = steps(edges, "outgoing", kinds or schema.CYCLE_EDGES).select("at", "to").where("at <> to").distinct()
    named = store(named, "named")
    numbers = numbered(named.df.select(F.col("at").alias("id")).union(named.df.select(F.col("to").alias("id")))).df
    walk = store(
        named.df.join(numbers.withColumnsRenamed({"id": "at", "n": "a"}), "at").join(numbers.withColumnsRenamed({"id": "to", "n": "b"}), "to").select(F.col("a").alias("at"), F.col("b").alias("to")),
        "steps",
    )
    found = None
    while (walk := _trimmed(walk)).rows:
        colours = _colours(walk.df)
        done = colours.where("f = b").select("n", F.col("f").alias("c"))
        found = done if found is None else found.unionByName(done)
        rest = colours.where("f <> b")
        walk = store(walk.df.join(rest.toDF("at", "f", "b"), "at").join(rest.toDF("to", "f2", "b2"), "to").where("f = f2 and b = b2").select("at", "to"), "steps")
    if found is None:
        return edges.sparkSession.createDataFrame([], "id string, component string, size bigint")
    members = found.join(numbers, "n").select("id", "c")
    named_ = members.groupBy("c").agg(F.min("id").alias("component"), F.count("*").alias("size")).where("size > 1")
    return members.join(named_, "c").select("id", "component", "size")


def component_of(edges: DataFrame, node: str, kinds: list[str] | None = None) -> DataFrame:
    """The ids of the component of one node: what it reaches and what reaches it."""
    spark = edges.sparkSession
    one = spark.createDataFrame([(node,)], "id string")
    kinds = kinds or schema.CYCLE_EDGES
    return reach(edges, one, None, "outgoing", kinds).select("id").intersect(reach(edges, one, None, "incoming", kinds).select("id"))


def in_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("in_degree"))


def risk(nodes: DataFrame) -> DataFrame:
    """Adds risk by path, name, importance and in_degree (columns file, name, kind, importance, in_degree)."""
    low = F.lower("name")
    entry = ((low == "main") & (F.col("kind") == "function")) | low.startswith("handle_") | low.endswith("_handler") | (F.col("kind") == "api_endpoint")
    n = F.coalesce("in_degree", F.lit(0))
    tier = (
        F.when(P.is_test_path("file"), "low")
        .when(entry, "critical")
        .when(F.col("importance") > 0.7, "critical")
        .when(F.col("importance") > 0.4, "high")
        .when(n >= 5, "high")
        .when((P.kind_rank("kind") == 0) & (n >= 1), "medium")
        .otherwise("low")
    )
    return nodes.withColumn("risk", tier)


def blast_radius(graph: Graph, changed: DataFrame, hops: int = 3) -> DataFrame:
    """Id, name, kind, file, hop, risk of everything that depends on changed symbols (a column id)."""
    found = reach(graph.edges, changed, hops, "incoming", schema.BLAST_EDGES).groupBy("id").agg(F.min("hop").alias("hop"))
    found = found.join(changed.select("id"), "id", "left_anti")
    nodes = found.join(graph.nodes, "id").where("kind <> 'pr_merge'").join(in_degrees(graph.edges), "id", "left")
    return risk(nodes).select("id", "name", "kind", "file", "hop", "risk")


def risk_counts(radius: DataFrame) -> DataFrame:
    """A05."""
    return radius.groupBy("risk").agg(F.count("*").alias("n"))


def resolve_ids(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """wanted, id: an exact id, else the first root (in order) whose prefix makes one."""
    exact = wanted.join(nodes.select("id", "root"), wanted.wanted == nodes.id).select("wanted", "id", F.lit(0).alias("order"), "root")
    short = nodes.select("id", "root", F.substr("id", F.length("root") + 2).alias("wanted"))
    prefixed = wanted.join(short, "wanted").select("wanted", "id", F.lit(1).alias("order"), "root")
    return exact.unionByName(prefixed).groupBy("wanted").agg(F.min_by("id", F.struct("order", "root", "id")).alias("id"))


#: Lines are met in blocks of 16, 256, ... lines: spans are cut into such blocks, at most 30 of each size.
BLOCK_BITS, BLOCK_SIZES = 4, 8


def _blocks_of(start: Column, end: Column) -> Column:
    """The blocks (size, block) that make up the lines from ``start`` to ``end``, each line in exactly one."""
    none = F.array().cast("array<struct<size:int,block:bigint>>")

    def run(size: int, first: Column, behind: Column) -> Column:
        blocks = F.transform(F.sequence(first, behind - 1), lambda b: F.struct(F.lit(size).alias("size"), b.alias("block")))
        return F.when(first < behind, blocks).otherwise(none)

    parts, one = [], F.lit(1).cast("bigint")
    for size in range(BLOCK_SIZES):
        width = F.lit(1 << (BLOCK_BITS * size)).cast("bigint")
        first, behind = F.floor((start + width - 1) / width), F.floor((end + one) / width)
        if size == BLOCK_SIZES - 1:
            parts.append(run(size, first, behind))
            continue
        wider = width * (1 << BLOCK_BITS)
        up_first, up_behind = F.floor((start + wider - 1) / wider) * (1 << BLOCK_BITS), F.floor((end + one) / wider) * (1 << BLOCK_BITS)
        split = up_first < up_behind
        parts += [run(size, first, F.when(split, up_first).otherwise(behind)), F.when(split, run(size, up_behind, behind)).otherwise(none)]
    return F.concat(*parts)


def containing(locations: DataFrame, spans: DataFrame) -> DataFrame:
    """``locations`` (root, file, line, ...) with every span (root, file, line_start, line_end, ...) around them.

    Both meet in blocks of lines, so a location is joined with the spans that hold it and no others, however many
    a file has. Null lines and spans that end before they start hold nothing.
    """
    good = spans.where("line_start >= 0 and line_end >= line_start")
    cut = good.withColumn("_b", F.explode(_blocks_of(F.col("line_start").cast("bigint"), F.col("line_end").cast("bigint"))))
    cut = cut.select("*", F.col("_b.size").alias("_size"), F.col("_b.block").alias("_block")).drop("_b")
    at = locations.where("line >= 0").withColumn("_size", F.explode(F.sequence(F.lit(0), F.lit(BLOCK_SIZES - 1))))
    at = at.withColumn("_block", F.expr(f"shiftright(cast(line as bigint), _size * {BLOCK_BITS})"))
    return at.join(cut, ["root", "file", "_size", "_block"]).drop("_size", "_block")


def narrowest(locations: DataFrame, nodes: DataFrame, kinds: list[str]) -> DataFrame:
    """Location (root, file, line) to the narrowest node of ``kinds`` around it (ties: smallest id)."""
    spans = nodes.where(F.col("kind").isin(kinds)).select("root", "file", "id", "line_start", "line_end")
    hit = containing(locations.select("root", "file", "line").distinct(), spans)
    return hit.groupBy("root", "file", "line").agg(F.min_by("id", F.struct(F.expr("line_end - line_start"), "id")).alias("id"))
