"""Queries of filters, traversals, ranking and statistics over the newest snapshots, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skein import schema
from skein.functions import predicates as P
from skein.operators import graph as G
from skein.operators import ranking as R
from skein.operators.snapshots import snapshot_changes
from skein.plans.records import MS, SYMBOL_COLUMNS, _changes
from skein.session import table

CUR_S = f"""sv as (select root_id, max(scan_version) v from symbols where root_id is not null group by 1),
cur_s as (select * from (select s.*, row_number() over (partition by s.id order by {MS.replace('updated_at', 's.updated_at')} desc) n
          from symbols s join sv on sv.root_id = s.root_id and sv.v = s.scan_version where s.id is not null) where n = 1)"""
CUR_E = f"""ev as (select root_id, max(scan_version) v from edges where root_id is not null group by 1),
cur_e as (select * from (select e.*, row_number() over (partition by e.id order by {MS.replace('updated_at', 'e.updated_at')} desc) n
          from edges e join ev on ev.root_id = e.root_id and ev.v = e.scan_version where e.id is not null) where n = 1 and source_id <> '' and target_id <> '')"""
CUR = f"{CUR_S}, {CUR_E}"
WEIGHTS = "(values " + ", ".join(f"('{k}', {v}::double)" for k, v in schema.EDGE_WEIGHTS.items()) + ") w(edge_type, weight)"
KIND_ORDER = "(values " + ", ".join(f"('{k}', {i})" for i, k in enumerate(schema.EDGE_KINDS, 1)) + ") ko(edge_type, k)"
HUB = "hub as (select target_id id from cur_e where edge_type = 'calls' and target_id in (select id from cur_s) group by 1 order by count(*) desc, 1 limit 1)"
CALLER = "caller as (select source_id id from cur_e where edge_type = 'calls' group by 1 order by count(*) desc, 1 limit 1)"


def _test_path(c: str) -> str:
    name = f"string_split({c}, '/')[-1]"
    has = [f"contains({c}, '{x}')" for x in (".test.", ".spec.", "_test.", "_tests.", "_spec.", "/test/", "/tests/", "/fixtures/", "/fixture/")]
    has += [f"starts_with({c}, '{x}')" for x in ("test/", "tests/", "fixtures/", "fixture/")]
    has += [f"starts_with({name}, 'test_')", f"contains({name}, 'smoke')", f"contains({name}, 'bench')"]
    return f"coalesce({' or '.join(has)}, false)"


TEST_FN = f"(kind = 'function' and (coalesce(is_test, false) or list_has_any(regexp_split_to_array(coalesce(decorators, ''), '[,\\s]'), ['test', 'tokio::test']) or {_test_path('file_path')}))"
KIND_RANK = f"case when kind in ({', '.join(repr(k) for k in schema.PRIMARY_KINDS)}) then 0 when kind in ('import', 'module') then 2 else 1 end"
FUNCTIONS = f"list_contains({schema.TRAIT_METHODS}, lower(name))"


def _hub(g: G.Graph) -> DataFrame:
    calls = g.edges.where("edge_type = 'calls'").join(g.nodes.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return calls.groupBy(F.col("target_id").alias("id")).count().orderBy(F.desc("count"), "id").limit(1).select("id")


def _caller(g: G.Graph) -> DataFrame:
    return g.edges.where("edge_type = 'calls'").groupBy(F.col("source_id").alias("id")).count().orderBy(F.desc("count"), "id").limit(1).select("id")


def j01_edges_with_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = G.load(spark, sf_dir, "root file name kind")
    ends = g.edges.select("source_id", "edge_type", F.col("target_id").alias("id"))
    return G.with_nodes(ends, g.nodes).groupBy("edge_type", "kind").agg(F.count("*").alias("n"))


def g01_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = G.load(spark, sf_dir, "")
    return G.neighbors(g.edges, _hub(g), "incoming").select("edge_type", "id")


def g02_grouped_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = G.load(spark, sf_dir, "")
    found = G.grouped_neighbors(g.edges.select(F.col("source_id").alias("source"), "edge_type", F.col("target_id").alias("id")))
    return found.select("source", "edge_type", "n", "kind_rank", F.element_at("neighbors", 1).alias("first"))


def _reach(direction: str, start, hops: int, kinds=None, first: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = G.load(spark, sf_dir, "").stored()
        return G.reach(g.edges, start(g), hops, direction, kinds, first).drop("source")

    return run


def _reach_sql(at: str, to: str, start: str, seed: str, hops: int, kinds=None) -> str:
    only = f"where edge_type in ({', '.join(repr(k) for k in kinds)})" if kinds else ""
    return f"""with recursive {CUR}, {start}, walk as (select distinct {at} at_id, {to} to_id from cur_e {only}),
r(id, hop) as (select id, 0 from {seed} union select to_id, hop + 1 from r join walk on at_id = r.id where hop < {hops})
select id, min(hop)::int hop from r where id not in (select id from {seed}) group by 1"""


def _cyclic(g: G.Graph) -> DataFrame:
    """The smallest id of two that call or need each other."""
    e = g.edges.where(F.col("edge_type").isin(schema.CYCLE_EDGES)).where("source_id <> target_id")
    back = e.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
    return e.join(back, ["source_id", "target_id"], "left_semi").agg(F.min("source_id").alias("id"))


def g06_component_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of a node that lies on a cycle."""
    g = G.load(spark, sf_dir, "").stored()
    node = _cyclic(g).first()[0]
    return G.component_of(g.edges, node) if node else g.nodes.select("id").where("false")


def g18_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """step, id of a shortest path from the busiest caller to one of what is farthest from it."""
    g = G.load(spark, sf_dir, "").stored()
    start = _caller(g)
    far = G.distances(g.edges, start).orderBy(F.desc("hop"), "id").first()
    path = G.shortest_path(g.edges, far["source"], far["id"]) if far else []
    return spark.createDataFrame(list(enumerate(path, 1)), "step int, id string")


def g05_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.components(G.load(spark, sf_dir, "").edges)


def g08_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pagerank(G.load(spark, sf_dir, "")).select("id", F.round("importance", 6).alias("importance"))


def _pagerank_sql(iterations: int = 20) -> str:
    steps = []
    for k in range(1, iterations + 1):
        p = f"r{k - 1}"
        steps.append(
            f"r{k} as materialized (select i.id, 0.15 / t.n + 0.85 * (coalesce(p.x, 0) + l.x) as rank from ids i cross join total t cross join (select coalesce(sum(rank), 0) / (select n from total) x from {p} where id not in (select id from outs)) l"
            f" left join (select f.dst id, sum({p}.rank * f.share) x from {p} join flow f on f.src = {p}.id group by 1) p on p.id = i.id)"
        )
    return f"""with {CUR}, ids as materialized (select id from cur_s union select source_id from cur_e union select target_id from cur_e),
total as materialized (select count(*) n from ids), outs as materialized (select source_id id, count(*) d from cur_e group by 1),
flow as materialized (select source_id src, target_id dst, sum(coalesce(w.weight, 0)) / any_value(o.d) share from cur_e left join {WEIGHTS} using (edge_type) join outs o on o.id = source_id group by 1, 2),
r0 as materialized (select id, 1.0::double / n rank from ids cross join total), {', '.join(steps)}
select id, round(rank / (select max(rank) from r{iterations}), 6) importance from r{iterations}"""


def g09_edge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = G.load(spark, sf_dir, "").edges
    return e.groupBy("edge_type").agg(F.count("*").alias("n"), F.round(F.sum(R.weight_of(F.col("edge_type"))), 3).alias("weight"))


def g10_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = G.load(spark, sf_dir, "kind is_test decorators file").stored()
    return R.subsystems(g, R.communities(g))


def g11_community_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = G.load(spark, sf_dir, "kind is_test decorators file name").stored()
    labels = R.subsystems(g, R.communities(g))
    return R.cohesion(g, labels).join(R.community_names(g.nodes, labels), "community")


def g12_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories as subsystems, rolled up to their parents."""
    nodes = G.load(spark, sf_dir, "file kind").nodes.where(F.col("file").contains("/"))
    subs = nodes.groupBy(F.regexp_extract("file", r"^(.*)/[^/]*$", 1).alias("name")).agg(F.count("*").alias("size"), F.avg(F.when(F.col("kind") == "function", 1.0).otherwise(0.0)).alias("cohesion"))
    return R.hierarchy(subs).select("parent", "children", "size", F.round("cohesion", 6).alias("cohesion"))


def g13_top_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_symbols(G.load(spark, sf_dir, "kind is_test decorators file name importance").nodes).select("id", "name", "file", F.round("score", 6).alias("score"))


def g13_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.hotspots(G.load(spark, sf_dir, "root file kind").nodes)


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols that the newest snapshot of their root changed."""
    symbols = table(spark, sf_dir, "symbols")
    newest = symbols.groupBy("root_id").agg(F.max("scan_version").alias("scan_version"))
    found = snapshot_changes({"symbols": symbols}).where("change = 'changed'").withColumn("root_id", F.split_part("id", F.lit(":"), F.lit(1)))
    return found.join(newest, ["root_id", "scan_version"], "left_semi").select("id")


def g22_blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = G.load(spark, sf_dir, "name kind file importance").stored()
    return G.blast_radius(g, _changed(spark, sf_dir)).select("id", "hop", "risk")


def g23_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = G.load(spark, sf_dir, "root name kind file importance")
    return G.risk(g.nodes.join(G.in_degrees(g.edges), "id", "left")).groupBy("root", "risk").agg(F.count("*").alias("n"))


RISK = f"""case when {_test_path('file_path')} then 'low'
  when (lower(name) = 'main' and kind = 'function') or starts_with(lower(name), 'handle_') or ends_with(lower(name), '_handler') or kind = 'api_endpoint' then 'critical'
  when importance > 0.7 then 'critical' when importance > 0.4 then 'high' when coalesce(deg, 0) >= 5 then 'high'
  when ({KIND_RANK}) = 0 and coalesce(deg, 0) >= 1 then 'medium' else 'low' end"""
DEG = "deg as (select target_id id, count(*) deg from cur_e group by 1)"


def g20_impact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affected symbols per directory with a first member, over the impact of the hub."""
    g = G.load(spark, sf_dir, "root file").stored()
    hit = G.reach(g.edges, _hub(g), 3, "incoming", schema.IMPACT_EDGES).join(g.nodes, "id")
    folder = F.regexp_extract("file", r"^(?:(.*)/)?[^/]*$", 1)
    return hit.groupBy("root", folder.alias("folder")).agg(F.countDistinct("id").alias("affected"), F.min_by("id", F.struct("hop", "id")).alias("entry"))


def f18_short_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every id without its root, resolved again."""
    nodes = G.load(spark, sf_dir, "root").nodes
    return G.resolve_ids(nodes.select(F.substr("id", F.length("root") + 2).alias("wanted")).distinct(), nodes)


def f_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F13 to F16, F19, F21 to F23 of every current symbol."""
    n = G.load(spark, sf_dir, "kind is_test decorators file name language").nodes
    return n.select(
        "id",
        P.is_test_path("file").alias("test_path"),
        P.is_test_function("kind", "is_test", "decorators", "file").alias("test_function"),
        P.is_trait_method("kind", "name").alias("trait_method"),
        P.kind_rank("kind").alias("kind_rank"),
        P.embeddable("kind").alias("embeddable"),
        P.shown_in_traversal("kind").alias("shown"),
        P.is_generated_sdk("file").alias("sdk"),
        P.language_family("language").alias("family"),
        P.operation_key("name").alias("operation"),
        P.sdk_method("name").alias("method"),
    )


def f_search_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F01 to F10 together."""
    n = G.load(spark, sf_dir, "root kind language file cyclomatic name signature").nodes
    hit = P.equals_ignoring_case("kind", "FUNCTION") & (P.equals_ignoring_case("language", "Python") | P.equals_ignoring_case("language", "rust")) & P.file_contains("file", "src/") & P.at_least_complex("kind", "cyclomatic", 3)
    return n.where(hit & P.name_or_signature("name", "signature", "Ledger") & P.in_root("root", "all")).select("id", "cyclomatic")


def f12_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of three patterns."""
    files = G.load(spark, sf_dir, "root file").nodes.select("root", "file").distinct()
    patterns = spark.createDataFrame([("src/*",), ("src/core/*.rs",), ("*/io/*",)], "pattern string")
    return files.join(F.broadcast(patterns), P.simple_glob("file", "pattern")).groupBy("pattern").agg(F.count("*").alias("files"))


def o01_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five tiers for the query "batch", the best 50."""
    from skein.operators.search import relevance_order

    n = G.load(spark, sf_dir, "name signature kind file importance").nodes.where(P.name_or_signature("name", "signature", "batch"))
    top = n.orderBy(*relevance_order("batch")).limit(50)
    return top.select("*", F.row_number().over(W.orderBy(*relevance_order("batch"))).alias("place")).select("id", "place")


def a06_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.statistics(G.load(spark, sf_dir, "root file language", "root_id"))


def a08_top_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_per_file(G.load(spark, sf_dir, "root file kind importance").nodes)


def a12_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = G.load(spark, sf_dir, "root importance").nodes
    top = n.groupBy("root").agg(F.max("importance").alias("top"))
    return n.join(top, "root").select("id", F.round(F.col("importance") / F.col("top"), 6).alias("share"))


def j16_narrowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrowest symbol around the first line of every function."""
    n = G.load(spark, sf_dir, "root file kind line_start line_end").nodes
    lines = n.where("kind = 'function' and line_start is not null").select("root", "file", F.col("line_start").alias("line")).distinct()
    return G.narrowest(lines, n, ["function", "impl", "struct"])


_P = f"{CUR_S}"
QUERIES = {
    "j01_edges_with_nodes": (j01_edges_with_nodes, f"with {CUR} select e.edge_type, s.kind, count(*) n from cur_e e left join cur_s s on s.id = e.target_id group by 1, 2"),
    "g01_neighbors": (g01_neighbors, f"with {CUR}, {HUB} select e.edge_type, e.source_id id from cur_e e join hub on hub.id = e.target_id"),
    "g02_grouped_neighbors": (g02_grouped_neighbors, f"with {CUR} select source_id source, e.edge_type, count(distinct target_id) n, any_value(k)::bigint kind_rank, min(target_id) \"first\" from cur_e e left join {KIND_ORDER} on ko.edge_type = e.edge_type group by 1, 2"),
    "g03_reachable": (_reach("outgoing", _caller, 3), _reach_sql("source_id", "target_id", CALLER, "caller", 3)),
    "g04_impact": (_reach("incoming", _hub, 3, schema.IMPACT_EDGES), _reach_sql("target_id", "source_id", HUB, "hub", 3, schema.IMPACT_EDGES)),
    "g05_components": (g05_components, f"""with recursive {CUR}, e0 as (select distinct source_id a, target_id b from cur_e where edge_type in ('calls', 'depends_on') and source_id <> target_id),
n as (select id, row_number() over (order by id)::int k from (select a id from e0 union select b from e0)), e as materialized (select x.k a, y.k b from e0 join n x on x.id = e0.a join n y on y.id = e0.b),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on e.a = r.b),
s as (select x.a, least(x.a, min(x.b)) c from r x join r y on y.a = x.b and y.b = x.a group by 1), z as (select c, count(*) size from s group by 1 having count(*) > 1)
select n.id, m.id component, z.size from s join z on z.c = s.c join n on n.k = s.a join n m on m.k = s.c"""),
    "g06_component_of": (g06_component_of, f"""with recursive {CUR}, c as (select distinct source_id a, target_id b from cur_e where edge_type in ('calls', 'depends_on')),
node as (select min(x.a) id from c x join c y on x.a = y.b and x.b = y.a where x.a <> x.b),
f(id) as (select id from node union select b from f join c on a = id), r(id) as (select id from node union select a from r join c on b = id)
select id from f join r using (id) where id <> (select id from node)"""),
    "g18_shortest_path": (g18_shortest_path, f"""with recursive {CUR}, {CALLER}, walk as materialized (select distinct source_id at_id, target_id to_id from cur_e where edge_type = 'calls'),
r(id) as (select id from caller union select to_id from r join walk on at_id = r.id),
h(id, hop) as (select id, 0 from caller union select to_id, hop + 1 from h join walk on at_id = h.id where hop < 40), m as materialized (select id, min(hop) hop from h group by 1),
far as (select id, hop from m where hop > 0 order by hop desc, id limit 1),
p(id, hop) as (select id, hop from far union all select (select min(w.at_id) from walk w join m on m.id = w.at_id and m.hop = p.hop - 1 where w.to_id = p.id), hop - 1 from p where hop > 1)
select hop step, id from p where (select count(*) from r) = (select count(*) from m)"""),
    "g07_path_lengths": (_reach("outgoing", _caller, 6, ["calls"]), _reach_sql("source_id", "target_id", CALLER, "caller", 6, ["calls"])),
    "g08_pagerank": (g08_pagerank, _pagerank_sql()),
    "g09_edge_weights": (g09_edge_weights, f"with {CUR} select edge_type, count(*) n, round(sum(coalesce(weight, 0)), 3) weight from cur_e left join {WEIGHTS} using (edge_type) group by 1"),
    "g10_communities": (g10_communities, None),
    "g11_community_names": (g11_community_names, None),
    "g12_hierarchy": (g12_hierarchy, f"with {_P}, f as (select regexp_extract(file_path, '^(.*)/[^/]*$', 1) name, count(*) size, avg(case when kind = 'function' then 1.0 else 0.0 end) cohesion from cur_s where contains(file_path, '/') group by 1) select regexp_extract(name, '^(.*)/[^/]*$', 1) parent, count(*) children, sum(size)::bigint size, round(sum(cohesion * size) / sum(size), 6) cohesion from f where contains(name, '/') group by 1"),
    "g13_top_symbols": (g13_top_symbols, f"with {_P}, t as (select id, name, file_path file, case when {TEST_FN} then importance * 0.1 else importance end score from cur_s where kind in ({', '.join(repr(k) for k in schema.PRIMARY_KINDS)}) and not (kind = 'function' and {FUNCTIONS})) select id, name, file, round(score, 6) score from t where score > 0.001 order by t.score desc, id limit 15"),
    "g13_hotspots": (g13_hotspots, f"with {_P} select root_id root, file_path file, count(*) definitions from cur_s where kind not in ('import', 'module', 'pr_merge', 'field') group by 1, 2 order by 3 desc, 1, 2 limit 10"),
    "g16_first_kinds": (
        _reach("outgoing", _caller, 3, None, True),
        f"""with recursive {CUR}, {CALLER}, walk as (select distinct source_id at_id, target_id to_id, k from cur_e e join {KIND_ORDER} on ko.edge_type = e.edge_type),
r(id, hop, first) as (select id, 0, 0 from caller union select to_id, hop + 1, case when hop = 0 then k else first end from r join walk on at_id = r.id where hop < 3),
m as (select id, min(hop) hop from r where id not in (select id from caller) group by 1)
select m.id, any_value(m.hop)::int hop, any_value(ko.edge_type) first_kind from (select r.id, r.hop, min(first) f from r group by 1, 2) x join m on m.id = x.id and m.hop = x.hop join {KIND_ORDER} on ko.k = x.f group by 1""",
    ),
    "g17_levels": (_reach("both", _caller, 2), f"""with recursive {CUR}, {CALLER}, walk as (select source_id at_id, target_id to_id from cur_e union select target_id, source_id from cur_e),
r(id, hop) as (select id, 0 from caller union select to_id, hop + 1 from r join walk on at_id = r.id where hop < 2)
select id, min(hop)::int hop from r where id not in (select id from caller) group by 1"""),
    "g20_impact_summary": (g20_impact_summary, f"""with recursive {CUR}, {HUB}, walk as (select distinct target_id at_id, source_id to_id from cur_e where edge_type in ('calls', 'referenced_by')),
r(id, hop) as (select id, 0 from hub union select to_id, hop + 1 from r join walk on at_id = r.id where hop < 3),
m as (select id, min(hop) hop from r where id not in (select id from hub) group by 1)
select root_id root, regexp_extract(file_path, '^(?:(.*)/)?[^/]*$', 1) folder, count(distinct m.id) affected, arg_min(m.id, (m.hop, m.id)) entry from m join cur_s s on s.id = m.id group by 1, 2"""),
    "g22_blast_radius": (g22_blast_radius, f"""with recursive {_changes("symbols", SYMBOL_COLUMNS)}, {CUR}, {DEG},
changed as (select distinct c.id from symbols_c c join sv on sv.root_id = split_part(c.id, ':', 1) and sv.v = c.scan_version where c.change = 'changed'),
walk as (select distinct target_id at_id, source_id to_id from cur_e where edge_type in ({', '.join(repr(k) for k in schema.BLAST_EDGES)})),
r(id, hop) as (select id, 0 from changed union select to_id, hop + 1 from r join walk on at_id = r.id where hop < 3),
m as (select id, min(hop)::int hop from r where id not in (select id from changed) group by 1)
select m.id, m.hop, {RISK} risk from m join cur_s s on s.id = m.id left join deg on deg.id = m.id where kind <> 'pr_merge'"""),
    "g23_risk": (g23_risk, f"with {CUR}, {DEG} select root_id root, {RISK} risk, count(*) n from cur_s s left join deg on deg.id = s.id group by 1, 2"),
    "f18_short_ids": (f18_short_ids, f"with {_P}, w as (select distinct substr(id, length(root_id) + 2) wanted from cur_s), c as (select w.wanted, s.id, 0 o, s.root_id r from w join cur_s s on s.id = w.wanted union all select substr(id, length(root_id) + 2), id, 1, root_id from cur_s) select wanted, arg_min(id, (o, r, id)) id from c group by 1"),
    "f_predicates": (f_predicates, f"""with {_P}, f as (select *, lower(string_split(file_path, '/')[-1]) fname, lower(language) ll from cur_s)
select id, {_test_path('file_path')} test_path, {TEST_FN} test_function, (kind = 'function' and {FUNCTIONS}) trait_method, {KIND_RANK} kind_rank, kind not in ({', '.join(repr(k) for k in schema.NOT_EMBEDDED)}) embeddable, kind not in ('module', 'pr_merge') shown,
  coalesce(contains(fname, 'sdk.gen') or contains(fname, '.generated.') or contains(fname, '_generated.') or contains(fname, 'generated_client') or contains(fname, 'openapi_client') or starts_with(fname, 'api_client.'), false) sdk,
  case when regexp_matches(ll, 'typescript|javascript|tsx|jsx') then 'ecmascript' else ll end family, lower(replace(name, '_', '')) operation,
  case {' '.join(f"when starts_with(lower(name), '{p}') and (length(name) = {len(p)} or regexp_matches(substr(name, {len(p) + 1}, 1), '^[A-Z]')) then '{p.upper()}'" for p in schema.HTTP_PREFIXES)} else 'GET' end "method" from f"""),
    "f_search_filters": (f_search_filters, f"with {_P} select id, cyclomatic from cur_s where lower(kind) = 'function' and lower(language) in ('python', 'rust') and contains(file_path, 'src/') and cyclomatic >= 3 and (contains(lower(name), 'ledger') or contains(lower(coalesce(signature, '')), 'ledger'))"),
    "f12_globs": (f12_globs, f"with {_P}, f as (select distinct root_id, file_path p from cur_s) select 'src/*' pattern, count(*) files from f where starts_with(p, 'src/') having count(*) > 0 union all select 'src/core/*.rs', count(*) from f where starts_with(p, 'src/core/') and ends_with(p, '.rs') having count(*) > 0 union all select '*/io/*', count(*) from f"),
    "o01_relevance": (o01_relevance, f"""with {_P} select id, place from (select id, row_number() over (order by (lower(name) = 'batch') desc, contains(lower(name), 'batch') desc, {KIND_RANK}, {_test_path('file_path')}, importance desc nulls last, id)::int place
from cur_s where contains(lower(name), 'batch') or contains(lower(coalesce(signature, '')), 'batch')) where place <= 50"""),
    "a06_statistics": (a06_statistics, f"with {CUR}, a as (select root_id root, count(*) symbols, count(distinct file_path) files, count(distinct lower(language)) languages from cur_s group by 1), b as (select root_id root, count(*) edges from cur_e group by 1) select coalesce(a.root, b.root) root, coalesce(symbols, 0) symbols, coalesce(files, 0) files, coalesce(languages, 0) languages, coalesce(edges, 0) edges from a full join b on a.root = b.root"),
    "a08_top_per_file": (a08_top_per_file, f"with {_P} select root_id root, file_path file, id, place from (select *, row_number() over (partition by root_id, file_path order by importance desc nulls last, id)::int place from cur_s where kind not in ('import', 'module')) where place <= 3"),
    "a12_normalized": (a12_normalized, f"with {_P} select id, round(importance / max(importance) over (partition by root_id), 6) share from cur_s"),
    "j16_narrowest": (j16_narrowest, f"with {_P}, l as (select distinct root_id root, file_path file, line_start line from cur_s where kind = 'function' and line_start is not null) select l.root, l.file, l.line, arg_min(s.id, (s.line_end - s.line_start, s.id)) id from l join cur_s s on s.root_id = l.root and s.file_path = l.file and l.line between s.line_start and s.line_end where s.kind in ('function', 'impl', 'struct') group by 1, 2, 3"),
}
