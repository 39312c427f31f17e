"""PageRank, communities and the repository map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skein import schema
from skein.functions import predicates as P
from skein.operators.graph import Graph, numbered
from skein.session import cut, store

#: Fixed values of communities: the resolution, most sweeps of moves, the number of communities aimed at, and the largest share of one.
GAMMA, SWEEPS, TARGET, LARGEST = 0.8, 20, 12, 0.3


def weight_of(kind) -> F.Column:
    """The weight of an edge kind; unknown kinds weigh nothing."""
    pairs = [x for k, v in schema.EDGE_WEIGHTS.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), kind), F.lit(0.0))


def pagerank(graph: Graph, iterations: int = 20, damping: float = 0.85) -> DataFrame:
    """Id, importance: every edge passes an equal share of its source's rank, times the kind's weight.

    What the weights hold back is lost; nodes without edges out spread their
    rank evenly; the result is divided by its largest value. Nodes are the ids
    of the table and of edge ends. Parallel edges count. An empty graph gives no rows.

    All that is added to ranks from outside is the same for every node, so the ranks after t rounds are sums of the
    powers u_k = (damping * flow)^k * 1 with one coefficient for each. A round computes u_k from u_(k-1) by one join and
    one shuffle, and only for nodes that a path of k edges reaches; the coefficients follow from the sums of u_k over
    nodes without edges out. The flow lies partitioned by source; sources with more edges than a partition holds on
    average are fewer than the partitions, and their ranks go to their edges by broadcast.
    """
    ends = graph.edges.select(F.col("source_id").alias("id")).union(graph.edges.select(F.col("target_id").alias("id")))
    numbers = numbered(graph.nodes.select("id").union(ends))
    n = numbers.rows
    if not n:
        return numbers.df.select("id", F.lit(None).cast("double").alias("importance"))
    of = numbers.df
    weights = graph.edges.groupBy("source_id", "target_id").agg(F.sum(weight_of(F.col("edge_type"))).alias("w"), F.count("*").alias("edges"))
    flow = store(weights.join(of.withColumnsRenamed({"id": "source_id", "n": "at"}), "source_id").join(of.withColumnsRenamed({"id": "target_id", "n": "to"}), "target_id").select("at", "to", "w", "edges"), "flow")
    out = flow.df.groupBy("at").agg(F.sum("edges").alias("degree"), F.count("*").alias("targets"))
    out = store(out, "degrees").df
    parts = int(of.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = max(flow.rows / parts, 10_000)
    hot = out.where(F.col("targets") > each).select("at")  # fewer than there are partitions
    share = flow.df.join(out.select("at", "degree"), "at").select("at", "to", (F.col("w") / F.col("degree") * damping).alias("share"))
    usual = share.join(F.broadcast(hot), "at", "left_anti").repartition(parts, "at").persist()
    busy = share.join(F.broadcast(hot), "at", "left_semi").persist()
    no_hot = hot.isEmpty()
    dangling = of.select("n").join(out.select(F.col("at").alias("n")), "n", "left_anti").withColumn("loose", F.lit(True))
    powers, u = [], of.select("n", F.lit(1.0).alias("u"))
    for _ in range(iterations):
        at = u.withColumnRenamed("n", "at")
        moved = usual.join(at, "at").select("to", (F.col("share") * F.col("u")).alias("u"))
        if not no_hot:
            moved = moved.unionByName(busy.join(F.broadcast(at.join(F.broadcast(hot), "at", "left_semi")), "at").select("to", (F.col("share") * F.col("u")).alias("u")))
        u = cut(moved.groupBy(F.col("to").alias("n")).agg(F.sum("u").alias("u")), "power")
        powers.append(u)
        if u.isEmpty():
            break
    usual.unpersist()
    busy.unpersist()
    every = of.select("n", F.lit(0).alias("k"), F.lit(1.0).alias("u"))
    for k, p in enumerate(powers, 1):
        every = every.unionByName(p.select("n", F.lit(k).alias("k"), "u"))
    sums = dict(every.join(dangling, "n", "left_semi").groupBy("k").agg(F.sum("u")).collect())
    added: list[float] = []  # what every node gets from outside in each round
    for t in range(iterations):
        loose = sums.get(t, 0.0) / n + sum(a * sums.get(t - 1 - j, 0.0) for j, a in enumerate(added))
        added.append((1 - damping) / n + damping * loose / n)
    factor = [added[iterations - 1 - k] for k in range(iterations)] + [1 / n]
    ranks = every.groupBy("n").agg(F.sum(F.col("u") * F.get(F.array(*map(F.lit, factor)), F.col("k"))).alias("rank"))
    ranks = cut(ranks.join(of, "n").select("id", "rank"), "ranks")
    return ranks.select("id", (F.col("rank") / ranks.agg(F.max("rank")).scalar()).alias("importance"))


def coupling(graph: Graph) -> DataFrame:
    """a < b, weight: the undirected coupling graph without tests and loops."""
    code = graph.nodes.where(~P.is_test_function("kind", "is_test", "decorators", "file")).select("id")
    pairs = graph.edges.where(F.col("edge_type").isin(schema.COUPLING_EDGES)).where("source_id <> target_id")
    pairs = pairs.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), weight_of(F.col("edge_type")).alias("w"))
    pairs = pairs.groupBy("a", "b").agg(F.sum("w").alias("weight"))
    return pairs.join(code.withColumnRenamed("id", "a"), "a", "left_semi").join(code.withColumnRenamed("id", "b"), "b", "left_semi")


def communities(graph: Graph, gamma: float = GAMMA, sweeps: int = SWEEPS) -> DataFrame:
    """Id, community (the smallest member id): local moving by modularity gain, then merging of the closest communities.

    A sweep has two rounds, in each of which half of the nodes (by a hash of node and sweep) move at once to the
    community with the largest gain; of equal ones to the one with the smaller number. A node alone moves to another
    node alone only if that has the smaller number, so the two can't change places. It ends with a sweep without moves.

    Then each community proposes to be merged with the one it shares most weight with, in relation to the smaller of the
    two, if that ratio reaches a bar set by the first number of communities and both together hold at most LARGEST of all
    nodes. The smaller one is taken in, unless its partner itself is taken in elsewhere in that round; where all that is
    proposed to a community would make it too large, it takes the best one.
    """
    pairs = store(coupling(graph), "pairs").df
    numbers = numbered(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))))
    if not numbers.rows:
        return numbers.df.select("id", F.col("id").alias("community"))
    of = numbers.df
    hashed = of.withColumn("h", F.xxhash64("id"))
    links = pairs.join(hashed.withColumnsRenamed({"id": "a", "n": "x", "h": "hx"}), "a").join(hashed.withColumnsRenamed({"id": "b", "n": "y", "h": "hy"}), "b")
    links = store(links.select("x", "hx", "y", "hy", "weight"), "links").df
    near = links.select("x", "hx", "y", "weight").union(links.select("y", "hy", "x", "weight")).toDF("n", "h", "m", "w")
    home = store(near.groupBy("n", "h").agg(F.round(F.sum("w"), 9).alias("k")).withColumn("c", F.col("n")), "home").df
    twice = home.agg(F.sum("k")).first()[0] or 1.0
    for sweep in range(sweeps):
        moved = 0
        for half in (0, 1):
            home, moves = _moved(near, home, twice, gamma, F.pmod(F.xxhash64("h", F.lit(sweep)), F.lit(2)) == half)
            moved += moves
        if not moved:
            break
    return _named(cut(of.join(_merged(near, home, gamma), "n").select("id", "c"), "labels"))


def _named(labels: DataFrame) -> DataFrame:
    """id, community: each community c by its smallest id."""
    return labels.join(labels.groupBy("c").agg(F.min("id").alias("community")), "c").select("id", "community")


def _moved(near: DataFrame, home: DataFrame, twice: float, gamma: float, turn) -> tuple[DataFrame, int]:
    """One round of moves: the nodes (n, h, k, c) after it, and how many moved. ``turn`` says whose turn it is."""
    totals = home.groupBy("c").agg(F.sum("k").alias("total"), F.count("*").alias("size"))
    movers = home.where(turn)
    to = near.where(turn).join(home.select(F.col("n").alias("m"), "c"), "m").groupBy("n", "c").agg(F.sum("w").alias("w"))
    stay = movers.select("n", "c", F.lit(0.0).alias("w"))
    sums = to.unionByName(stay).groupBy("n", "c").agg(F.sum("w").alias("w"))
    each = sums.join(movers.select("n", "k", F.col("c").alias("own")), "n").join(totals, "c")
    alone = home.join(totals.where("size = 1"), "c", "left_semi").select("n", F.lit(True).alias("alone"))
    each = each.join(alone, "n", "left").withColumn("alone", F.coalesce("alone", F.lit(False)))
    here = F.col("c") == F.col("own")
    swap = ~here & F.col("alone") & (F.col("size") == 1) & (F.col("c") > F.col("own"))
    gain = F.col("w") - gamma * F.col("k") * (F.col("total") - F.when(here, F.col("k")).otherwise(0.0)) / twice
    scored = each.where(~swap).select("n", "c", here.alias("here"), F.round(gain, 9).alias("gain"))
    best = scored.groupBy("n").agg(F.max(F.struct("gain", "here", (-F.col("c")).alias("minus"))).alias("b")).select("n", (-F.col("b.minus")).alias("new"))
    after = home.join(best, "n", "left").select("n", "h", "k", F.coalesce("new", "c").alias("c"), (F.coalesce("new", "c") != F.col("c")).alias("moved"))
    after = store(after, "home").df
    return after.select("n", "h", "k", "c"), after.where("moved").count()


def _merged(near: DataFrame, home: DataFrame, gamma: float) -> DataFrame:
    """n, c: the communities after merging."""
    sizes = store(home.groupBy("c").agg(F.count("*").alias("size")), "sizes")
    nodes = sizes.df.agg(F.sum("size")).first()[0]
    bar, cap = gamma * min(TARGET / sizes.rows, 1) ** 0.5, int(LARGEST * nodes)
    at = home.select("n", "c")
    ends = near.join(at.withColumnRenamed("c", "a"), "n").join(at.select(F.col("n").alias("m"), F.col("c").alias("b")), "m").where("a < b")
    cross = store(ends.groupBy("a", "b").agg(F.round(F.sum("w"), 9).alias("w")), "cross").df
    sizes, label = sizes.df, store(home.select("c", F.col("c").alias("now")).distinct(), "label").df
    while True:
        sized = cross.join(sizes.withColumnsRenamed({"c": "a", "size": "sa"}), "a").join(sizes.withColumnsRenamed({"c": "b", "size": "sb"}), "b").where(F.col("sa") + F.col("sb") <= cap)
        score = F.round(F.col("w") / F.least("sa", "sb"), 9)
        pairs = sized.withColumn("score", score).where(F.col("score") >= bar)
        smaller = F.col("sa") < F.col("sb")
        pairs = pairs.select("score", F.when(smaller, F.col("a")).otherwise(F.col("b")).alias("source"), F.when(smaller, F.col("b")).otherwise(F.col("a")).alias("target"), F.least("sa", "sb").alias("size"), F.greatest("sa", "sb").alias("into"))
        both = pairs.select(F.col("source").alias("c"), "*").unionByName(pairs.select(F.col("target").alias("c"), "*"))
        order = F.struct("score", (-F.col("target")).alias("t"), (-F.col("source")).alias("s"))
        best = store(both.groupBy("c").agg(F.max_by(F.struct("source", "target", "score", "size", "into"), order).alias("p")).select("c", "p.*").where("c = source"), "proposals")
        if not best.rows:
            return home.join(label, "c").select("n", F.col("now").alias("c"))
        free = best.df.join(best.df.select(F.col("source").alias("target")), "target", "left_anti")
        per = free.groupBy("target").agg(F.sum("size").alias("all"), F.max_by("source", F.struct("score", (-F.col("source")).alias("s"))).alias("first"))
        taken = free.join(per, "target").where((F.col("into") + F.col("all") <= cap) | (F.col("source") == F.col("first")))
        merges = store(taken.select("source", "target"), "merges").df
        into = merges.withColumnsRenamed({"source": "c", "target": "to"})
        label = store(label.join(into.withColumnsRenamed({"c": "now"}), "now", "left").select("c", F.coalesce("to", "now").alias("now")), "label").df
        sizes = store(sizes.join(into, "c", "left").groupBy(F.coalesce("to", "c").alias("c")).agg(F.sum("size").alias("size")), "sizes").df
        moved = cross.join(into.withColumnsRenamed({"c": "a", "to": "x"}), "a", "left").join(into.withColumnsRenamed({"c": "b", "to": "y"}), "b", "left")
        moved = moved.select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"), "w").where("x <> y")
        cross = store(moved.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.round(F.sum("w"), 9).alias("w")), "cross").df


def _strongest(links: DataFrame) -> DataFrame:
    """id, community: the community with most weight; ties go to the smaller one. ``links`` has id, community, w."""
    sums = links.groupBy("id", "community").agg(F.round(F.sum("w"), 9).alias("w")).where("w > 0")
    return sums.groupBy("id").agg(F.min_by("community", F.struct(-F.col("w"), "community")).alias("community"))


def subsystems(graph: Graph, labels: DataFrame) -> DataFrame:
    """Id, community: ``labels`` with small communities merged and test functions assigned.

    Communities are large from 3 members, in graphs of 50 or more symbols without tests from
    clamp(symbols / 200, 5, 10). A member of a smaller one joins the large one its coupled pairs weigh
    most to, outwards until nothing changes; test functions then join the one their edges of all kinds
    weigh most to. What no path leads to a large one keeps its label, or none if it is a test. Graphs
    with under 3 coupled symbols, or over 100 symbols of which under 5 % are coupled, and those without a
    large community have no subsystems.
    """
    test = graph.nodes.withColumn("test", P.is_test_function("kind", "is_test", "decorators", "file")).select("id", "test")
    labels, tests = store(labels, "labels"), cut(test.where("test").select("id"), "tests")
    code = graph.nodes.select("id").count() - tests.count()
    least = 3 if code < 50 else min(max(code // 200, 5), 10)
    none = labels.df.where("false")
    if labels.rows < 3 or (code > 100 and labels.rows < code * 0.05):
        return none
    large = labels.df.groupBy("community").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("community")
    placed = cut(labels.df.join(large, "community", "left_semi").select("id", "community"), "placed")
    if placed.isEmpty():
        return none
    pairs = cut(coupling(graph), "pairs")
    both = pairs.select("a", "b", "weight").union(pairs.select("b", "a", "weight")).toDF("id", "near", "w")
    open_ = cut(both.join(placed, "id", "left_anti"), "open")
    new = placed
    while True:
        near = new.withColumnRenamed("id", "near")
        joined = store(_strongest(open_.join(near, "near").select("id", "community", "w")), "joined")
        if not joined.rows:
            break
        placed = placed.unionByName(joined.df)
        new, open_ = joined.df, cut(open_.join(joined.df, "id", "left_anti"), "open")
    kept = labels.df.join(placed, "id", "left_anti").select("id", "community")
    e = graph.edges.select("source_id", "target_id", weight_of(F.col("edge_type")).alias("w"))
    ends = e.select(F.col("source_id").alias("id"), F.col("target_id").alias("near"), "w").union(e.select("target_id", "source_id", "w"))
    near = cut(placed, "placed").withColumnRenamed("id", "near")
    found = _strongest(ends.join(tests, "id", "left_semi").join(near, "near").select("id", "community", "w"))
    return near.withColumnRenamed("near", "id").unionByName(kept).unionByName(found)


def interfaces(graph: Graph, labels: DataFrame, importance: DataFrame, top_n: int = 5) -> DataFrame:
    """Community, id, score, place: the members with most coupling edges to other communities, times their importance."""
    code = graph.nodes.where(~P.is_test_function("kind", "is_test", "decorators", "file")).select("id")
    e = graph.edges.where(F.col("edge_type").isin(schema.COUPLING_EDGES)).where("source_id <> target_id")
    e = e.join(code.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(code.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    both = e.select(F.col("source_id").alias("id"), F.col("target_id").alias("near")).union(e.select("target_id", "source_id"))
    both = both.join(labels.select("id", "community"), "id").join(labels.select(F.col("id").alias("near"), F.col("community").alias("other")), "near", "left")
    cross = both.where(~F.col("community").eqNullSafe(F.col("other"))).groupBy("community", "id").agg(F.count("*").alias("n"))
    scored = cross.join(importance.select("id", "importance"), "id", "left").select("community", "id", (F.col("n") * F.coalesce("importance", F.lit(0.0))).alias("score"))
    w = W.partitionBy("community").orderBy(F.desc("score"), "id")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top_n)


def cohesion(graph: Graph, labels: DataFrame) -> DataFrame:
    """Community, size, cohesion (weight inside to all weight of its members' pairs)."""
    pairs = coupling(graph)
    both = pairs.join(labels.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(labels.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b")
    ends = both.select("weight", F.explode(F.array_distinct(F.array("ca", "cb"))).alias("community"), (F.col("ca") == F.col("cb")).alias("inside"))
    sums = ends.groupBy("community").agg((F.sum(F.when(F.col("inside"), F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("cohesion"))
    sizes = labels.groupBy("community").agg(F.count("*").alias("size"))
    return sizes.join(sums, "community", "left").select("community", "size", F.coalesce("cohesion", F.lit(1.0)).alias("cohesion"))


def community_names(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Community, name: the most frequent name of its modules (ties: the later name), else the directory that all
    its files share (without src at the front), else the most frequent first directory; files without one count by their stem.
    """
    parts = F.split("file", "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    folders = F.when(F.get(folders, F.lit(0)) == "src", F.slice(folders, F.lit(2), F.size(folders))).otherwise(folders)
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    dirs = F.when(F.size(folders) > 0, folders).otherwise(F.array(stem))
    members = labels.join(nodes.where("file is not null").select("id", "kind", "name", dirs.alias("dirs")), "id")
    modules = members.where("kind = 'module'").groupBy("community", "name").agg(F.count("*").alias("n"))
    module = modules.groupBy("community").agg(F.max_by("name", F.struct("n", "name")).alias("module"))
    ends = members.groupBy("community").agg(F.min("dirs").alias("low"), F.max("dirs").alias("high"))
    same = F.transform(F.arrays_zip("low", "high"), lambda p: p["low"].eqNullSafe(p["high"]))
    length = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same)).cast("int")
    shared = ends.select("community", F.nullif(F.array_join(F.slice("low", F.lit(1), length), "/"), F.lit("")).alias("shared"))
    firsts = members.groupBy("community", F.get("dirs", F.lit(0)).alias("first")).agg(F.count("*").alias("n"))
    first = firsts.groupBy("community").agg(F.max_by("first", F.struct("n", "first")).alias("first"))
    out = shared.join(first, "community", "left").join(module, "community", "left")
    return out.select("community", F.coalesce("module", "shared", "first").alias("name"))


def hierarchy(subsystems: DataFrame) -> DataFrame:
    """Parent, children, size, cohesion: subsystems (name, size, cohesion) rolled up by the text before the last slash."""
    parents = subsystems.where(F.col("name").contains("/")).withColumn("parent", F.regexp_extract("name", r"^(.*)/[^/]*$", 1))
    return parents.groupBy("parent").agg(F.count("*").alias("children"), F.sum("size").alias("size"), (F.sum(F.col("cohesion") * F.col("size")) / F.sum("size")).alias("cohesion"))


def top_symbols(nodes: DataFrame, top_n: int = 15) -> DataFrame:
    """Id, name, file, score: the most important symbols, tests demoted, common methods hidden."""
    test = P.is_test_function("kind", "is_test", "decorators", "file")
    shown = nodes.where(F.col("kind").isin(schema.PRIMARY_KINDS) & ~P.is_trait_method("kind", "name")).withColumn("score", P.shown_importance("importance", test))
    return shown.where(F.col("score") > schema.LEAST_IMPORTANCE).orderBy(F.desc("score"), "id").limit(top_n).select("id", "name", "file", "score")


def hotspots(nodes: DataFrame, top_n: int = 10) -> DataFrame:
    """Root, file, definitions: the files with most definitions."""
    shown = nodes.where(~F.col("kind").isin("import", "module", "pr_merge", "field"))
    return shown.groupBy("root", "file").agg(F.count("*").alias("definitions")).orderBy(F.desc("definitions"), "root", "file").limit(top_n)


def entry_points(nodes: DataFrame, top_n: int = 10) -> DataFrame:
    """Functions named like entry points."""
    low = F.lower("name")
    hit = (F.col("kind") == "api_endpoint") | ((F.col("kind") == "function") & ((low == "main") | low.startswith("handle_") | low.endswith("_handler")))
    return nodes.where(hit & ~P.is_test_path("file")).orderBy("id").limit(top_n).select("id", "name", "file")


def statistics(graph: Graph) -> DataFrame:
    """Root, symbols, files, languages, edges."""
    symbols = graph.nodes.groupBy("root").agg(F.count("*").alias("symbols"), F.countDistinct("file").alias("files"), F.countDistinct(F.lower("language")).alias("languages"))
    edges = graph.edges.groupBy(F.col("root_id").alias("root")).agg(F.count("*").alias("edges"))
    return symbols.join(edges, "root", "full").select("root", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("symbols", "files", "languages", "edges")])


def root_statistics(graph: Graph, frameworks: DataFrame) -> DataFrame:
    """``statistics`` with the frameworks (root, file, framework) that a root's files use, in alphabetical order, of a fixed list of rules."""
    used = frameworks.groupBy("root").agg(F.array_sort(F.collect_set("framework")).alias("frameworks"))
    return statistics(graph).join(used, "root", "left").withColumn("frameworks", F.coalesce("frameworks", F.array().cast("array<string>")))


def affected_subsystems(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Affected: the number of subsystems that hold something of ``found`` (id). labels: id, subsystem."""
    return found.select("id").distinct().join(labels.where("subsystem is not null"), "id").agg(F.countDistinct("subsystem").alias("affected"))


def by_risk(radius: DataFrame, cap: int = 50, each: int = 10) -> DataFrame:
    """The ``cap`` first symbols by risk, then name, then id, with their place; ``shown`` marks the first ``each`` of a risk."""
    rank = F.array_position(F.array(*[F.lit(r) for r in schema.RISK_TIERS]), F.col("risk"))
    top = radius.withColumn("_rank", rank).orderBy("_rank", "name", "id").limit(cap)
    place = F.row_number().over(W.orderBy("_rank", "name", "id"))
    within = F.row_number().over(W.partitionBy("_rank").orderBy("name", "id"))
    return top.withColumns({"place": place, "shown": within <= each}).drop("_rank")


def top_per_file(nodes: DataFrame, k: int = 3) -> DataFrame:
    """The k most important symbols of each file."""
    w = W.partitionBy("root", "file").orderBy(F.desc_nulls_last("importance"), "id")
    return nodes.where("kind not in ('import', 'module')").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("root", "file", "id", "place")
