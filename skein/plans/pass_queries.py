"""Queries of link passes, filters, search, API and store over inputs made from the test tables, with their SQL.

The tables hold few import statements, endpoints or calls that the passes read, so each query makes such nodes from the
structs, functions and files of the newest snapshots (by rules stated in Spark and in SQL) and runs the operator on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import schema
from skein.functions import predicates as P
from skein.operators import graph as G
from skein.operators import passes as L
from skein.operators import ranking as R
from skein.operators import search as S
from skein.plans import api
from skein.plans.graph_queries import CALLER, CUR, CUR_S, HUB, KIND_RANK, _caller, _changed, _hub, _reach_sql, _test_path
from skein.plans.graph_queries import QUERIES as GRAPH
from skein.plans.search_queries import FRAMEWORK_VALUES, SECTIONS, WORDS
from skein.session import scratch_path, table
from skein.sources import history
from skein.sources.store import Store

NODE = "id string, root string, file string, name string, kind string, language string, line_start int, line_end int, signature string, body string, decorators string, is_test boolean, metadata map<string,string>"


def _cur(spark: SparkSession, sf_dir: str, kind: str, cols: str = "root file name kind line_start line_end") -> DataFrame:
    return G.load(spark, sf_dir, cols).nodes.where(F.col("kind") == kind)


def _made(df: DataFrame, meta: dict[str, str] | None = None, **cols: str) -> DataFrame:
    """Rows of ``df`` as nodes whose columns are SQL expressions; what isn't given is null."""
    pairs = [x for k, v in (meta or {}).items() for x in (F.lit(k), F.expr(v))]
    made = F.create_map(*pairs).cast("map<string,string>") if pairs else F.create_map().cast("map<string,string>")
    exprs = []
    for part in NODE.split(", "):
        name, kind = part.split(" ", 1)
        exprs.append(made.alias(name) if name == "metadata" else F.expr(cols.get(name, "null")).cast(kind).alias(name))
    return df.select(*exprs)


def _union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _ends(found: DataFrame) -> DataFrame:
    return found.select("source_id", "target_id", "edge_type")


# P01 to P08 -------------------------------------------------------------------

IMPORTED = ["fastapi", "react", "tokio", "axios", "gorm.io/gorm", "nothing"]


def _imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every function as an import, whose text its first line's number chooses, with its file's module."""
    texts = f"array({', '.join(map(repr, IMPORTED))})[line_start % {len(IMPORTED)}]"
    cur = G.load(spark, sf_dir, "root file kind language line_start").nodes
    fns = _made(cur.where("kind = 'function' and line_start is not null"), id="id", root="root", file="file", kind="'import'", name=f"'import ' || {texts}", language="language")
    return _union(fns, _made(cur.where("kind = 'module'"), id="id", root="root", file="file", kind="'module'"))


_IMPORTS = f"imports as (select root_id, file_path, lower(language) lang, 'import ' || ({IMPORTED!r})[line_start % {len(IMPORTED)} + 1] t from cur_s where kind = 'function' and line_start is not null), used as (select distinct root_id, file_path, framework from imports i join {FRAMEWORK_VALUES} on contains(t, r.text) and (r.lang = '' or r.lang = i.lang))"


def link01_import_frameworks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frameworks of each file by its imports."""
    return L.frameworks(_imports(spark, sf_dir))


def link01_framework_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ends(L.framework_edges(_imports(spark, sf_dir)))


def link18_frameworks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frameworks that 70 % of the files of a root's first folder use."""
    n = _imports(spark, sf_dir)
    members = n.select(F.concat_ws("/", "root", F.split_part("file", F.lit("/"), F.lit(1))).alias("subsystem"), "root", "file")
    return L.subsystem_frameworks(members, L.frameworks(n)).select("subsystem", "framework", F.round("share", 6).alias("share"))


def a07_root_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = G.load(spark, sf_dir, "root file language", "root_id")
    return R.root_statistics(g, L.frameworks(_imports(spark, sf_dir))).select("root", "symbols", "edges", F.array_join("frameworks", ",").alias("frameworks"))


def link02_router_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each module as a router: with a prefix of its own if its name's length is odd, else by an include call."""
    mods = _cur(spark, sf_dir, "module").where("name rlike '^[A-Za-z_]+$'")
    own = mods.where("length(name) % 2 = 1").selectExpr("root", "file", """name || ' = APIRouter(prefix="/' || root || '")' body""")
    other = mods.where("length(name) % 2 = 0").selectExpr("root", "'main/' || file file", """'app.include_router(mod.' || name || ', prefix="/inc/' || file || '")' body""")
    ends = _made(mods, {"router_var": "name", "http_path": "'/x'"}, id="id", root="root", file="file", name="name", kind="'api_endpoint'", language="'Python'")
    out = L.apply_router_prefixes(ends, L.router_prefixes(own.unionByName(other)))
    return out.select("id", L.meta("http_path").alias("path"), L.meta("http_path_local").alias("local"))


def link03_sdk_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each struct as a constant path of an SDK (two of them if its name's length is odd) and as an endpoint."""
    st = _cur(spark, sf_dir, "struct").where("name rlike '^[A-Za-z]+$'")
    const = [_made(part, id="id", root="root", file="'sdk.gen.ts'", kind="'const'", name=f"'/{at}/' || root || '/' || name") for at, part in (("api", st), ("v2", st.where("length(name) % 2 = 1")))]
    ends = _made(st, {"http_path": "'/' || root || '/' || name"}, id="id", root="root", file="file", kind="'api_endpoint'", language="'python'")
    return L.sdk_full_paths(_union(*const, ends)).distinct()


def link04_url_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules as endpoints of their root and first folder, structs as literals of such paths."""
    mods, st = _cur(spark, sf_dir, "module"), _cur(spark, sf_dir, "struct")
    ends = _made(mods, {"http_path": "'/' || root || '/' || split_part(file, '/', 1) || '/:id'"}, id="id", root="root", kind="'api_endpoint'")
    lits = _made(st, {"synthetic": "'true'"}, id="id", root="root", kind="'const'", name="'/' || root || '/' || split_part(file, '/', 1) || '/{x}'")
    return _ends(L.url_links(_union(ends, lits)))


def link05_sdk_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structs as SDK functions, half of them named after an operation, half by the path on their lines."""
    st = _cur(spark, sf_dir, "struct").where("name rlike '^[A-Za-z]+$' and line_start is not null and line_end is not null")
    sdk = {"root": "root", "file": "file || '.generated.ts'", "line_start": "line_start", "line_end": "line_end"}
    ends = _made(st, {"operation_id": "'get_' || name", "http_path": "'/' || root || '/' || file", "http_method": "'get'"}, id="'ep:' || id", root="root", kind="'api_endpoint'")
    named = _made(st, id="'fn:' || id", kind="'function'", name="'get' || name", **sdk)
    other = _made(st, id="'ld:' || id", kind="'function'", name="'load' || name", **sdk)
    urls = _made(st, id="'c:' || id", kind="'const'", name="'/' || root || '/' || file", **sdk)
    return _ends(L.sdk_links(_union(ends, named, other, urls)))


def link06_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each root's packages as a requirements file."""
    names = G.load(spark, sf_dir, "root meta_package").nodes.where("meta_package rlike '^[a-z0-9-]+$'").select("root", "meta_package").distinct()
    files = names.groupBy("root").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_set("meta_package")), lambda p: F.concat(p, F.lit("==1.0  # pinned")))).alias("text"))
    return history.manifest_packages(files.select("root", F.lit("deps/requirements.txt").alias("path"), "text"))


def link07_test_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P07, J03."""
    nodes = G.load(spark, sf_dir, "root file name kind decorators is_test").nodes
    return L.test_links(nodes).select("source_id", "target_id")


def _call_nodes(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Each struct as a function that is called, one that calls it by bare name, and the import between the two."""
    st = _cur(spark, sf_dir, "struct").where("name rlike '^[A-Za-z]+$'")
    called = _made(st, id="'d:' || id", root="root", file=f"'{folder}' || file", name="'do_' || name", kind="'function'", language="'python'", body="'return 1'")
    caller = _made(st, id="'c:' || id", root="root", file="file", name="'use_' || name", kind="'function'", language="'PYTHON'", body="'x = do_' || name || '(1) + y.do_other(2)'")
    binds = _made(st, id="'i:' || id", root="root", file="file", name="'from lib import do_' || name", kind="'import'", language="'python'")
    return _union(called, caller, binds)


def link08_import_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P08, J04."""
    return _ends(L.import_calls(_call_nodes(spark, sf_dir, "lib/")))


def e06_same_file_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caller and called function in one file."""
    return _ends(L.same_file_calls(_call_nodes(spark, sf_dir, "")))


# P10 to P16 -------------------------------------------------------------------


def _bodies(spark: SparkSession, sf_dir: str, body: str, **more: str) -> DataFrame:
    """Each struct as a function with a body."""
    st = _cur(spark, sf_dir, "struct").where("name rlike '^[A-Za-z]+$'")
    return _made(st, id="id", root="root", file="file", name="name", kind="'function'", language="'python'", body=body, **more)


def link10_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that send to a topic and publish on a channel."""
    n = _bodies(spark, sf_dir, """'producer.send("' || name || '")\nbus.publish("' || root || '")\nqueue.basic_publish(routing_key="no")'""")
    return _ends(L.topics(n, ["kafka-python", "redis"]))


def link11_socket_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that emit one event, listen to another and to the connection."""
    return _ends(L.socket_events(_bodies(spark, sf_dir, """'socket.emit("' || name || '"); socket.on("connect", f); socket.on("' || root || '", g)'""")))


def link12_route_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each struct's folder as a route file with a GET handler and a helper; half of them by the older convention."""
    st = _cur(spark, sf_dir, "struct").where("name rlike '^[A-Za-z]+$'")
    at = "case when length(name) % 2 = 0 then 'src/app/' || lower(name) || '/[id]/route.ts' else 'pages/api/' || lower(name) || '/[id].ts' end"
    fns = _union(*[_made(st, id=f"'{name}:' || id", root="root", file=at, name=f"'{name}'", kind="'function'") for name in ("GET", "helper")])
    return _ends(L.route_handlers(fns.select("root", "file").distinct(), fns))


def link13_rpc_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of files that import a stub call RPCs of the same name, or of it in Pascal case."""
    st = _cur(spark, sf_dir, "struct").where("name rlike '^[A-Za-z]+$'")
    rpcs = _made(st, {"parent_service": "'S'"}, id="'rpc:' || id", root="root", file="'a.proto'", name="case when length(name) % 2 = 0 then 'get' || name else 'Get' || name end", kind="'function'")
    calls = _made(st, id="'c:' || id", root="root", file="file", name="'call'", kind="'function'", body="'stub.get' || name || '(x)'")
    binds = _made(st.where("length(file) % 2 = 0"), id="'i:' || id", root="root", file="file", name="'import svc_pb2_grpc'", kind="'import'")
    return _ends(L.rpc_calls(_union(rpcs, calls, binds)))


def link14_minimal_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints in file texts, but not in comments."""
    st = _cur(spark, sf_dir, "struct").where("name rlike '^[A-Za-z]+$'")
    files = st.selectExpr("root", "file", """'// app.MapGet("/no", h);\napp.MapPost("/' || name || '", h);' body""").distinct()
    return L.minimal_endpoints(files)


def link15_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that a boundary config describes, in files whose imports name the library."""
    n = _bodies(spark, sf_dir, """'bus.publish_it(1, "' || name || '"); bus.publish(2, topic)'""")
    binds = _made(_cur(spark, sf_dir, "struct").where("length(file) % 2 = 0"), id="'i:' || id", root="root", file="file", name="'import bus'", kind="'import'")
    config = {"language": "Python", "imports": ["bus"], "pattern": "bus.publish*", "argument": 1, "edge_kind": "produces"}
    return _ends(L.boundaries(_union(n, binds), [config]))


def link16_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every root as a merge that changed its module files."""
    mods = _cur(spark, sf_dir, "module")
    merges = mods.groupBy("root").agg(F.collect_set("file").alias("files")).select(F.concat(F.lit("merge:"), "root").alias("id"), "files")
    return L.merge_links(merges, G.load(spark, sf_dir, "file kind").nodes).groupBy("source_id").agg(F.count("*").alias("n"))


OUTCOMES = [("core", ["src/core/*", "*.rs"]), ("docs", ["docs/*", "README.md"])]


def _outcomes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OUTCOMES, "outcome string, patterns array<string>")


def j14_outcome_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as merges of their file, and outcome notes as serving the outcome "Core"."""
    d = table(spark, sf_dir, "documents")
    merges = d.select(F.concat(F.lit("m:"), "doc_id").alias("id"), F.array_compact(F.array("file_path")).alias("files"))
    serves = d.where("source = 'outcome_note'").select(F.concat(F.lit("m:"), "doc_id").alias("merge"), F.lit("Core").alias("outcome"))
    return L.outcome_merges(_outcomes(spark), merges, serves)


def g24_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What outcomes have, by kind: commits, symbols, merges, sections that name them."""
    d = table(spark, sf_dir, "documents")
    commits = d.select(F.col("doc_id").cast("string").alias("hash"), F.coalesce("text", F.lit("")).alias("message"), F.array_compact(F.array("file_path")).alias("files"))
    merges = d.where("source = 'readme'").select(F.concat(F.lit("m:"), "doc_id").alias("id"), F.array_compact(F.array("file_path")).alias("files"))
    sections = d.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("body"))
    parts = api.outcome_progress(G.load(spark, sf_dir, "file kind"), _outcomes(spark), commits, merges=merges, sections=sections)
    counts = [df.groupBy("outcome").agg(F.count("*").alias("n")).select("outcome", F.lit(what).alias("what"), "n") for what, df in parts.items()]
    return _union(*counts)


# filters ----------------------------------------------------------------------


def f04_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """current symbols of one root (in other case), external symbols, and results of either kind in it."""
    n = G.load(spark, sf_dir, "root kind").nodes.select("id", "root", "kind")
    ext = table(spark, sf_dir, "external_symbols").select("id", F.lit("external").alias("root"), "kind")
    both = n.unionByName(ext).withColumn("first", F.upper(n.agg(F.min("root")).scalar()))
    one = n.agg(F.min("root")).first()[0]
    passed = both.where(P.in_root("root", one.upper())).select("id", F.lit("in_root").alias("how"))
    labels = both.select("id", F.when(F.col("kind") == "function", F.lit("code:function")).otherwise("markdown").alias("label"))
    return passed.unionByName(labels.where(P.result_in_root("id", "label", one.upper())).select("id", F.lit("result").alias("how")))


def f06_synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """async flags as the synthetic mark, folders as subsystems, an escaped part, and file paths as URL paths."""
    n = G.load(spark, sf_dir, "root file name is_async").nodes.withColumn("subsystem", F.regexp_extract("file", r"^(?:(.*)/)?[^/]*$", 1))
    return n.select(
        "id", P.synthetic_is("is_async", True).alias("synthetic"), P.synthetic_is("is_async", False).alias("written"), P.in_subsystem("subsystem", "SRC").alias("subsystem"),
        P.like_literal("name", "e_c").alias("part"), P.looks_like_url_path(F.concat(F.when(F.length("name") % 2 == 0, "/").otherwise(""), F.col("file"))).alias("url"),
    )


def f08_api_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F01 to F08 through the API's search, sorted by importance."""
    g = G.load(spark, sf_dir, "root file name kind language signature cyclomatic importance is_async")
    g = G.Graph(g.nodes.withColumn("subsystem", F.split_part("file", F.lit("/"), F.lit(1))).withColumnRenamed("is_async", "synthetic"), g.edges)
    return api.search(g, limit=25, sort_by="importance", kind="Function", language="RUST", subsystem="src", synthetic=False, min_complexity=2, file="o").select("id", "place")


def o02_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most complex functions."""
    return api.search(G.load(spark, sf_dir, "root file name kind cyclomatic importance"), sort_by="complexity", limit=30, kind="function").select("id", "place")


def o05_entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols that a folder and a name stand for, and those of a name in other case."""
    g = G.load(spark, sf_dir, "root file name")
    first = g.nodes.where("name rlike '^[a-z_]+$' and file like 'src/%/%'").orderBy("id").select("file", "name").first()
    folder = first["file"].rsplit("/", 1)[0]
    asked = (("path", f"{folder}/{first['name']}"), ("name", first["name"].upper()))
    return _union(*[api.entry_points(g, q).select(F.lit(how).alias("how"), "id") for how, q in asked])


def o03_by_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blast radius of the newest changes by risk and name."""
    g = G.load(spark, sf_dir, "name kind file importance").stored()
    return R.by_risk(G.blast_radius(g, _changed(spark, sf_dir))).select("id", "risk", "place", "shown")


def a05_risk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = G.load(spark, sf_dir, "name kind file importance").stored()
    return G.risk_counts(G.blast_radius(g, _changed(spark, sf_dir)))


def a04_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many folders the impact of the hub reaches."""
    g = G.load(spark, sf_dir, "root file").stored()
    labels = g.nodes.select("id", F.concat_ws("/", "root", F.regexp_extract("file", r"^(?:(.*)/)?[^/]*$", 1)).alias("subsystem"))
    return R.affected_subsystems(G.reach(g.edges, _hub(g), 3, "incoming", schema.IMPACT_EDGES), labels)


def _folders(n: DataFrame) -> DataFrame:
    """Folders as communities: id, community."""
    return n.where("file is not null").select("id", F.concat_ws(":", "root", F.split_part("file", F.lit("/"), F.lit(1))).alias("community"))


def a09_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A09 of folders as communities."""
    g = G.load(spark, sf_dir, "root kind is_test decorators file").stored()
    return R.cohesion(g, _folders(g.nodes)).select("community", "size", F.round("cohesion", 6).alias("cohesion"))


def a10_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G11, A10 of folders as communities; the modules of half of them are left out, so that directories give the name."""
    n = G.load(spark, sf_dir, "root file name kind").nodes
    return R.community_names(n.where("kind <> 'module' or length(file) % 2 = 0"), _folders(n))


def g13_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry points, of functions renamed so that some are."""
    n = G.load(spark, sf_dir, "root file name kind").nodes
    name = F.when(F.length("name") % 3 == 0, F.concat(F.lit("Handle_"), "name")).when(F.length("name") % 7 == 0, F.concat("name", F.lit("_handler"))).otherwise(F.col("name"))
    return R.entry_points(n.withColumn("name", name), 200)


def g14_traverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The impact of the hub by the API, in one folder, without hidden kinds."""
    g = G.load(spark, sf_dir, "root file name kind").stored()
    g = G.Graph(g.nodes.withColumn("subsystem", F.split_part("file", F.lit("/"), F.lit(1))), g.edges)
    return api.traverse(g, _hub(g).first()[0], "impact", subsystem="src").select("id", "hop")


def g21_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbors of a list of ids, one of them without its root."""
    g = G.load(spark, sf_dir, "root").stored()
    ids = [_hub(g).first()[0], _caller(g).first()[0]]
    return api.batch(g, [ids[0], ids[1].split(":", 1)[1]], "neighbors").groupBy("source").agg(F.count("*").alias("n"))


def u01_deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of all snapshots once each; how many by kind and confidence."""
    e = table(spark, sf_dir, "edges").select("source_id", "edge_type", "target_id", "edge_confidence", "root_id")
    return L.deduped(e).groupBy("edge_type", "edge_confidence").agg(F.count("*").alias("n"), F.min("root_id").alias("root"))


# search -----------------------------------------------------------------------


def _artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("d:"), "doc_id").alias("id"), F.col("source").alias("kind"), F.coalesce("file_path", F.lit("-")).alias("title"), "text")


def r02_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols, documents of two kinds as artifacts, and markdown sections for one word."""
    markdown = table(spark, sf_dir, "nodes").where("kind = 'markdown_section'").select("id", "name", F.lit(2).alias("level"), "body")
    parts = api.sections(G.load(spark, sf_dir, "root file name kind signature importance"), "ledger", _artifacts(spark, sf_dir), markdown, 20, ["readme", "adr"])
    return _union(*[df.select(F.lit(what).alias("section"), "id", "place") for what, df in parts.items()])


def r12_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of one word reranked by the words they share with a question."""
    n = G.load(spark, sf_dir, "name signature").nodes.where(P.name_or_signature("name", "signature", "batch"))
    return S.rerank(n.withColumn("text", F.regexp_replace(F.concat_ws(" ", "name", "signature"), "[^A-Za-z]+", " ")), "batch ledger usize").select("id", F.round("rerank", 6).alias("rerank"))


def r15_full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to embed, with types and metadata."""
    n = G.load(spark, sf_dir, "kind name doc_comment body signature visibility language").nodes.where(P.embeddable("kind"))
    meta = F.map_filter(F.create_map(F.lit("visibility"), F.col("visibility"), F.lit("lang"), F.col("language")), lambda k, v: v.isNotNull())
    return n.select("id", F.md5(S.full_text(F.col("name"), F.col("doc_comment"), F.col("body"), F.col("signature"), meta)).alias("digest"))


def r18_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols, artifacts and the newest commits and merges in one index, counted by kind with a digest of titles."""
    d = table(spark, sf_dir, "documents")
    at = F.unix_timestamp(F.coalesce("created_at", F.lit("1970-01-01").cast("timestamp"))).alias("timestamp")
    commits = d.where("source = 'commit_message'").select(F.col("doc_id").cast("string").alias("hash"), F.coalesce("text", F.lit("")).alias("message"), at)
    merges = d.where("source = 'pr_description'").select(F.col("doc_id").cast("string").alias("hash"), F.coalesce("text", F.lit("")).alias("title"), F.lit("b").alias("branch"), at)
    notes = d.where("source = 'outcome_note'").select(F.concat(F.lit("d:"), "doc_id").alias("id"), F.lit("outcome").alias("kind"), F.lit("t").alias("title"), F.create_map(F.lit("lang"), "lang").alias("frontmatter"), F.col("text").alias("body"))
    rows = S.index_rows(G.load(spark, sf_dir, "kind name language body doc_comment").nodes, notes, commits, merges, 40, 30)
    return rows.where("kind not like 'code:%'").select("id", "kind", F.md5("text").alias("digest")).unionByName(rows.where("kind like 'code:%'").select("id", "kind", F.md5("title").alias("digest")))


def r19_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols by a part of their name or signature."""
    return G.load(spark, sf_dir, "name signature").nodes.where(P.name_or_signature("name", "signature", "Ledger")).select("id")


def j18_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 100 symbols by importance with their nodes, in their order."""
    n = G.load(spark, sf_dir, "file importance").nodes
    hits = n.where("importance is not null").select("id", F.col("importance").alias("score"))
    return S.resolve_hits(hits, n.select("id", "file"), 100).select("id", "file", "place")


# sources and store --------------------------------------------------------------


def s09_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as commits of their file: the newest of each file, and those whose message has a word."""
    d = table(spark, sf_dir, "documents").where("file_path is not null")
    log = d.select(F.col("doc_id").cast("string").alias("hash"), F.coalesce("text", F.lit("")).alias("message"), F.col("doc_id").alias("timestamp"), F.array("file_path").alias("files"))
    found = history.search_commits(log, "LEDGER", 15).select(F.lit("word").alias("how"), F.lit(None).cast("string").alias("file"), "hash")
    return found.unionByName(history.latest_per_file(log).select(F.lit("file").alias("how"), "file", "hash"))


def s10_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a root as commits of two parents: their titles, branches and tags."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    message = F.concat(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Merge branch 'b"), "doc_id", F.lit("'\n"))).otherwise(F.concat(F.lit("Merge pull request #1 from o/b"), "doc_id", F.lit("\n[outcome: a ] "))), F.col("source"))
    parents = F.when(F.col("root_id").isNull(), F.array(F.lit("p"))).otherwise(F.array(F.lit("p"), F.lit("q")))
    log = d.select(F.col("doc_id").cast("string").alias("hash"), message.alias("message"), parents.alias("parents"), F.array(F.lit("f")).alias("files"), F.lit(1).alias("timestamp"))
    return history.merges(log).select("hash", "title", "branch", F.array_join("outcomes", ",").alias("outcomes"))


def s13_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All current symbols persisted, the files of one folder replaced by one symbol each, one root removed: symbols and edges by root."""
    g = G.load(spark, sf_dir, "root file name")
    symbols = g.nodes.withColumnsRenamed({"root": "root_id", "file": "file_path"})
    edges = g.edges.select(F.concat("source_id", F.lit("->"), "edge_type", F.lit("->"), "target_id").alias("id"), "source_id", "target_id", "edge_type", F.split_part("source_id", F.lit(":"), F.lit(1)).alias("root_id")).distinct()
    store = Store(spark, scratch_path(spark, "store"))
    store.persist(symbols, edges)
    files = symbols.where("file_path like 'src/core/%'").select("root_id", "file_path").distinct()
    new = files.select(F.concat_ws(":", "root_id", "file_path", F.lit("new"), F.lit("function")).alias("id"), "root_id", "file_path", F.lit("new").alias("name"))
    store.upsert(new, edges.where("false"), files)
    store.remove_roots([symbols.agg(F.min("root_id")).first()[0]])
    count = lambda what: store.load(what).groupBy("root_id").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "root_id", "n")
    return _union(count("symbols"), count("edges"), spark.createDataFrame([("version", None, store.version)], "what string, root_id string, n bigint"))


def _recorded(kind: str):
    """How many of the current symbols of a kind, in files whose text the nodes hold, the extractors find by name.

    Of a single Go import the extractors keep the path only, which is its name in a group of imports as well.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from skein.sources import extract

        modules = table(spark, sf_dir, "nodes").where("kind = 'module' and body <> ''")
        mine = extract.nodes_of(extract.extract(modules)).where(F.col("kind") == kind).select("root", "file", "name").distinct()
        theirs = _cur(spark, sf_dir, kind, "root file name kind").withColumn("name", F.regexp_replace("name", r'^import (?=")', "")).select("root", "file", "name").distinct().join(modules.select("root", "file").distinct(), ["root", "file"], "left_semi")
        return theirs.join(mine.withColumn("hit", F.lit(1)), ["root", "file", "name"], "left").agg(F.count("*").alias("recorded"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found"))

    return run


_ST = "st as (select * from cur_s where kind = 'struct' and regexp_full_match(name, '[A-Za-z]+'))"
_NEWEST_CHANGED = GRAPH["g22_blast_radius"][1]
_RADIUS = f"{_NEWEST_CHANGED.replace('select m.id, m.hop, ', 'select m.id, s.name, ')}"
_RISK_RANK = "list_position(['critical', 'high', 'medium', 'low'], risk)"
_IMPACT = _reach_sql("target_id", "source_id", HUB, "hub", 3, schema.IMPACT_EDGES)


def _with(sql: str, name: str, rest: str) -> str:
    """A query whose last select becomes the table ``name`` of ``rest``."""
    at = sql.rindex("\nselect ")
    return f"{sql[:at]},\n{name} as ({sql[at + 1:]}) {rest}"


QUERIES = {
    "link01_import_frameworks": (link01_import_frameworks, f"with {CUR_S}, {_IMPORTS} select root_id root, file_path file, framework from used"),
    "link01_framework_edges": (link01_framework_edges, f"with {CUR_S}, {_IMPORTS}, m as (select root_id, file_path, min(id) id from cur_s where kind = 'module' group by 1, 2) select m.id source_id, concat_ws(':', root_id, 'frameworks', framework, 'framework') target_id, 'depends_on' edge_type from used join m using (root_id, file_path)"),
    "link18_frameworks": (link18_frameworks, f"with {CUR_S}, {_IMPORTS}, f as (select distinct root_id || '/' || split_part(file_path, '/', 1) subsystem, root_id, file_path from cur_s where kind = 'module' or (kind = 'function' and line_start is not null)), t as (select subsystem, count(*) n from f group by 1), h as (select subsystem, framework, count(*) k from f join used using (root_id, file_path) group by 1, 2) select subsystem, framework, round(k / n, 6) share from h join t using (subsystem) where k / n >= 0.7"),
    "a07_root_statistics": (a07_root_statistics, f"with {CUR}, {_IMPORTS}, a as (select root_id root, count(*) symbols from cur_s group by 1), b as (select root_id root, count(*) edges from cur_e group by 1), u as (select root_id root, string_agg(distinct framework, ',' order by framework) frameworks from used group by 1) select coalesce(a.root, b.root) root, coalesce(symbols, 0) symbols, coalesce(edges, 0) edges, coalesce(frameworks, '') frameworks from a full join b on a.root = b.root left join u on u.root = coalesce(a.root, b.root)"),
    "link02_router_prefixes": (link02_router_prefixes, f"with {CUR_S}, m as (select * from cur_s where kind = 'module' and regexp_full_match(name, '[A-Za-z_]+')), own as (select root_id, file_path, name from m where length(name) % 2 = 1), inc as (select root_id, name, arg_min('/inc/' || file_path, 'main/' || file_path) p from m where length(name) % 2 = 0 group by 1, 2) select id, coalesce(case when own.name is not null then '/' || m.root_id || '/x' end, inc.p || '/x', '/x') path, case when own.name is not null or inc.p is not null then '/x' end \"local\" from m left join own using (root_id, file_path, name) left join inc using (root_id, name)"),
    "link03_sdk_paths": (link03_sdk_paths, f"with {CUR_S}, {_ST} select distinct id, '/api/' || root_id || '/' || name http_path from st where length(name) % 2 = 0"),
    "link04_url_links": (link04_url_links, f"with {CUR_S} select distinct s.id source_id, m.id target_id, 'depends_on' edge_type from cur_s s join cur_s m on s.root_id = m.root_id and split_part(s.file_path, '/', 1) = split_part(m.file_path, '/', 1) where s.kind = 'struct' and m.kind = 'module'"),
    "link05_sdk_links": (link05_sdk_links, f"with {CUR_S}, {_ST}, x as (select * from st where line_start is not null and line_end is not null), op as (select lower(name) k, count(*) n, min('ep:' || id) t from x group by 1), rt as (select root_id, file_path, count(*) n, min('ep:' || id) t from x group by 1, 2) select distinct 'fn:' || x.id source_id, op.t target_id, 'implements' edge_type from x join op on op.k = lower(x.name) where op.n = 1 union select distinct 'ld:' || f.id, rt.t, 'implements' from x f join x c on c.root_id = f.root_id and c.file_path = f.file_path and c.line_start between f.line_start and f.line_end join rt on rt.root_id = f.root_id and rt.file_path = f.file_path where rt.n = 1"),
    "link06_manifests": (link06_manifests, f"with {CUR_S} select distinct root_id root, 'deps/requirements.txt' manifest, meta_package package, 'pypi' ecosystem from cur_s where regexp_full_match(meta_package, '[a-z0-9-]+')"),
    "link07_test_links": (
        link07_test_links,
        f"""with recursive {CUR_S}, f as (select id, root_id, lower(name) name, (coalesce(is_test, false) or list_has_any(regexp_split_to_array(coalesce(decorators, ''), '[,\\s]'), ['test', 'tokio::test']) or {_test_path('file_path')}) t from cur_s where kind = 'function' and name is not null),
p as (select name, root_id, min(id) id from f where not t and length(name) >= 4 group by 1, 2), a as (select name, min(id) id from p group by 1), texts as (select distinct name tx from f where t),
sub as (select tx, unnest(range(1, length(tx) + 1)) st from texts), hits as (select tx, st, length(a.name) ln, a.name from sub join a on a.name = substr(tx, st, length(a.name)) and substr(a.name, 1, 4) = substr(tx, st, 4)),
r(tx, free, name) as (select tx, 1::bigint, null::varchar from texts union all select tx, st + ln, name from (select h.*, row_number() over (partition by h.tx order by h.st, h.ln desc) k from r join hits h on h.tx = r.tx and h.st >= r.free) where k = 1)
select distinct f.id source_id, coalesce(p.id, a.id) target_id from r join f on f.name = r.tx and f.t join a on a.name = r.name left join p on p.name = r.name and p.root_id = f.root_id where f.id <> coalesce(p.id, a.id)""",
    ),
    "link08_import_calls": (link08_import_calls, f"with {CUR_S}, {_ST} select distinct 'c:' || a.id source_id, 'd:' || b.id target_id, 'calls' edge_type from st a join st b on a.name = b.name"),
    "e06_same_file_calls": (e06_same_file_calls, f"with {CUR_S}, {_ST} select distinct 'c:' || a.id source_id, 'd:' || b.id target_id, 'calls' edge_type from st a join st b on a.name = b.name and a.root_id = b.root_id and a.file_path = b.file_path"),
    "link10_topics": (link10_topics, f"with {CUR_S}, {_ST} select distinct id source_id, concat_ws(':', root_id, 'channels', unnest([name, root_id]), 'channel') target_id, 'produces' edge_type from st"),
    "link11_socket_events": (link11_socket_events, f"with {CUR_S}, {_ST} select distinct id source_id, concat_ws(':', root_id, 'events', name, 'event') target_id, 'produces' edge_type from st union select distinct id, concat_ws(':', root_id, 'events', root_id, 'event'), 'consumes' from st"),
    "link12_route_handlers": (link12_route_handlers, f"with {CUR_S}, {_ST}, x as (select id, root_id, lower(name) n, length(name) % 2 = 0 app from st) select distinct 'GET:' || id source_id, concat_ws(':', root_id, case when app then 'src/app/' || n || '/[id]/route.ts' else 'pages/api/' || n || '/[id].ts' end, case when app then 'GET /' else 'ANY /api/' end || n || '/{{id}}', 'api_endpoint') target_id, 'implements' edge_type from x union select distinct 'helper:' || id, concat_ws(':', root_id, 'pages/api/' || n || '/[id].ts', 'ANY /api/' || n || '/{{id}}', 'api_endpoint'), 'implements' from x where not app"),
    "link13_rpc_calls": (link13_rpc_calls, f"with {CUR_S}, {_ST}, x as (select distinct root_id, file_path from st where length(file_path) % 2 = 0) select distinct 'c:' || a.id source_id, 'rpc:' || b.id target_id, 'calls' edge_type from st a semi join x on x.root_id = a.root_id and x.file_path = a.file_path join st b on a.name = b.name"),
    "link14_minimal_endpoints": (link14_minimal_endpoints, f"with {CUR_S}, {_ST} select distinct root_id root, file_path file, 2 line, 'POST' \"method\", '/' || name path from st"),
    "link15_boundaries": (link15_boundaries, f"with {CUR_S}, {_ST}, x as (select distinct root_id, file_path from cur_s where kind = 'struct' and length(file_path) % 2 = 0) select distinct id source_id, concat_ws(':', root_id, 'channels', name, 'channel') target_id, 'produces' edge_type from st semi join x using (root_id, file_path)"),
    "link16_merges": (link16_merges, f"with {CUR_S}, m as (select distinct root_id, file_path from cur_s where kind = 'module') select 'merge:' || m.root_id source_id, count(distinct s.id) n from m join cur_s s on s.file_path = m.file_path where s.kind not in ('import', 'module') group by 1"),
    "j14_outcome_merges": (j14_outcome_merges, "select distinct 'core' outcome, 'm:' || doc_id \"merge\" from documents where source = 'outcome_note' or starts_with(file_path, 'src/core/') or ends_with(file_path, '.rs') union select 'docs', 'm:' || doc_id from documents where starts_with(file_path, 'docs/') or file_path = 'README.md'"),
    "g24_progress": (g24_progress, f"""with {CUR_S}, h as (select 'core' outcome, doc_id, file_path p, source from documents where starts_with(file_path, 'src/core/') or ends_with(file_path, '.rs') union select 'docs', doc_id, file_path, source from documents where starts_with(file_path, 'docs/') or file_path = 'README.md'),
w as (select distinct doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_-]+')) word from documents where text is not null)
select outcome, 'commits' what, count(distinct doc_id) n from h group by 1 union all select outcome, 'merges', count(distinct doc_id) from h where source = 'readme' group by 1
union all select outcome, 'symbols', count(distinct s.id) from h join cur_s s on s.file_path = h.p where s.kind <> 'import' group by 1 union all select word, 'sections', count(distinct doc_id) from w where word in ('core', 'docs') group by 1"""),
    "f04_roots": (f04_roots, f"with {CUR_S}, o as (select min(root_id) r from cur_s), b as (select id, root_id r, kind from cur_s union all select id, 'external', kind from external_symbols) select id, 'in_root' how from b, o where lower(b.r) = lower(o.r) or b.r = 'external' union all select id, 'result' from b, o where kind <> 'function' or lower(split_part(id, ':', 1)) = lower(o.r)"),
    "f06_synthetic": (f06_synthetic, f"with {CUR_S}, x as (select *, lower(regexp_extract(file_path, '^(?:(.*)/)?[^/]*$', 1)) sub from cur_s) select id, coalesce(is_async, false) synthetic, not coalesce(is_async, false) written, sub = 'src' or starts_with(sub, 'src/') subsystem, contains(name, 'e_c') part, length(name) % 2 = 0 url from x"),
    "f08_api_filters": (f08_api_filters, f"with {CUR_S} select id, place from (select id, row_number() over (order by importance desc nulls last, id)::int place from cur_s where kind = 'function' and lower(language) = 'rust' and lower(split_part(file_path, '/', 1)) = 'src' and not coalesce(is_async, false) and cyclomatic >= 2 and contains(file_path, 'o')) where place <= 25"),
    "o02_complexity": (o02_complexity, f"with {CUR_S} select id, place from (select id, row_number() over (order by cyclomatic desc nulls last, id)::int place from cur_s where kind = 'function') where place <= 30"),
    "o05_entry_points": (o05_entry_points, f"with {CUR_S}, o as (select file_path fp, name nm, regexp_extract(file_path, '^(.*)/[^/]*$', 1) dr from cur_s where regexp_full_match(name, '[a-z_]+') and file_path like 'src/%/%' order by id limit 1) select 'path' how, id from cur_s, o where contains(file_path, dr) and name = nm union all select 'name', id from cur_s, o where (name = upper(nm)) or (lower(name) = lower(nm) and not exists (select 1 from cur_s z where z.name = upper(nm)))"),
    "o03_by_risk": (o03_by_risk, _with(_RADIUS, "rad", f"select id, risk, place, shown from (select *, row_number() over (order by {_RISK_RANK}, name, id)::int place, row_number() over (partition by risk order by name, id) <= 10 shown from rad) where place <= 50")),
    "a05_risk_counts": (a05_risk_counts, _with(_RADIUS, "rad", "select risk, count(*) n from rad group by 1")),
    "a04_affected": (a04_affected, _with(_IMPACT, "imp", "select count(distinct root_id || '/' || regexp_extract(file_path, '^(?:(.*)/)?[^/]*$', 1)) affected from imp join cur_s s on s.id = imp.id")),
    "a09_cohesion": (a09_cohesion, f"""with {CUR}, t as (select id, kind = 'function' and (coalesce(is_test, false) or list_has_any(regexp_split_to_array(coalesce(decorators, ''), '[,\\s]'), ['test', 'tokio::test']) or {_test_path('file_path')}) test, root_id || ':' || split_part(file_path, '/', 1) c from cur_s),
p as (select least(source_id, target_id) a, greatest(source_id, target_id) b, sum(case edge_type when 'calls' then 1.0 when 'implements' then 0.8 when 'connects_to' then 0.3 else 0.5 end::double) w from cur_e where edge_type in ({', '.join(map(repr, schema.COUPLING_EDGES))}) and source_id <> target_id group by 1, 2),
q as (select x.c ca, y.c cb, w from p join t x on x.id = a and not x.test join t y on y.id = b and not y.test), e as (select ca c, w, ca = cb i from q union all select cb, w, false from q where ca <> cb), z as (select c, sum(case when i then w else 0 end) / sum(w) co from e group by 1)
select t.c community, count(*) size, round(coalesce(any_value(co), 1.0), 6) cohesion from t left join z on z.c = t.c group by 1"""),
    "a10_names": (a10_names, f"""with {CUR_S}, m as (select root_id || ':' || split_part(file_path, '/', 1) c, kind, name, string_split(file_path, '/') s from cur_s where file_path is not null and (kind <> 'module' or length(file_path) % 2 = 0)),
d as (select c, kind, name, case when len(s) = 1 or (len(s) = 2 and s[1] = 'src') then [regexp_replace(s[-1], '(.)\\.[^.]*$', '\\1')] when s[1] = 'src' then s[2:-2] else s[:-2] end d from m),
mods as (select c, arg_max(name, (n, name)) mod from (select c, name, count(*) n from d where kind = 'module' group by 1, 2) group by 1), ends as (select c, min(d) lo, max(d) hi from d group by 1),
sh as (select c, (select coalesce(min(i) - 1, least(len(lo), len(hi))) from range(1, least(len(lo), len(hi)) + 1) t(i) where lo[i] is distinct from hi[i]) k, lo from ends), fi as (select c, arg_max(f, (n, f)) f from (select c, d[1] f, count(*) n from d group by 1, 2) group by 1)
select sh.c community, coalesce(mod, nullif(array_to_string(lo[:k], '/'), ''), f) name from sh left join mods on mods.c = sh.c join fi on fi.c = sh.c"""),
    "g13_handlers": (g13_handlers, f"with {CUR_S}, x as (select id, kind, file_path, case when length(name) % 3 = 0 then 'Handle_' || name when length(name) % 7 = 0 then name || '_handler' else name end name from cur_s) select id, name, file_path file from x where (kind = 'api_endpoint' or (kind = 'function' and (lower(name) = 'main' or starts_with(lower(name), 'handle_') or ends_with(lower(name), '_handler')))) and not {_test_path('file_path')} order by id limit 200"),
    "g14_traverse": (g14_traverse, _with(_IMPACT, "imp", "select imp.id, hop from imp join cur_s s on s.id = imp.id where kind not in ('module', 'pr_merge') and lower(split_part(file_path, '/', 1)) = 'src'")),
    "g21_batch": (g21_batch, f"with {CUR}, {HUB}, {CALLER}, w as (select id from hub union select arg_min(s.id, (s.root_id, s.id)) from cur_s s, caller where substr(s.id, length(s.root_id) + 2) = substr(caller.id, strpos(caller.id, ':') + 1)) select source_id source, count(distinct target_id) n from cur_e join w on w.id = source_id where target_id <> source_id group by 1"),
    "u01_deduped": (u01_deduped, "with g as (select source_id, edge_type, target_id, arg_min(struct_pack(c := edge_confidence, r := root_id), ((edge_confidence is distinct from 'confirmed')::int, edge_confidence, root_id)) x from edges where source_id is not null and edge_type is not null and target_id is not null group by 1, 2, 3) select edge_type, x.c edge_confidence, count(*) n, min(x.r) root from g group by 1, 2"),
    "r02_sections": (
        r02_sections,
        f"""with {CUR_S}, sy as (select id, row_number() over (order by (lower(name) = 'ledger') desc, contains(lower(name), 'ledger') desc, {KIND_RANK}, {_test_path('file_path')}, importance desc nulls last, id)::int place from cur_s where contains(lower(name), 'ledger') or contains(lower(coalesce(signature, '')), 'ledger')),
w as (select doc_id, {WORDS} w from documents where source in ('readme', 'adr')), c as (select count(*) filter (len(w) > 0) docs, avg(len(w)) filter (len(w) > 0) average from w), h as (select doc_id, len(w) length, len(list_filter(w, lambda x: x = 'ledger')) tf from w), k as (select * from h where tf > 0), df as (select count(*) df from k),
ar as (select 'd:' || doc_id id, row_number() over (order by round(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average)), 9) desc, 'd:' || doc_id)::int place from k, c, df),
{SECTIONS}, md as (select id, row_number() over (order by score desc, id)::int place from (select distinct id, round((case when contains(head, 'ledger') then case when head = 'ledger' then 1.0 else 0.7 end else 0.4 end + 0.08 + least((length(body) - length(replace(body, 'ledger', ''))) / 6 * 0.02, 0.10))::double, 9) score from s where contains(head, 'ledger') or contains(body, 'ledger')))
select 'symbols' section, id, place from sy where place <= 20 union all select 'artifacts', id, place from ar where place <= 20 union all select 'markdown', id, place from md where place <= 20""",
    ),
    "r12_rerank": (r12_rerank, f"with {CUR_S}, x as (select id, string_split(trim(lower(regexp_replace(concat_ws(' ', name, signature), '[^A-Za-z]+', ' ', 'g'))), ' ') w from cur_s where contains(lower(name), 'batch') or contains(lower(coalesce(signature, '')), 'batch')) select id, round((list_contains(w, 'batch')::int + list_contains(w, 'ledger')::int + list_contains(w, 'usize')::int) / 3, 6) rerank from x"),
    "r15_full_text": (
        r15_full_text,
        f"""with {CUR_S}, a as (select id, name n, coalesce(doc_comment, '') d, coalesce(body, '') b, coalesce(signature, '') t, greatest(649 - length(name), 0) aft, ' lang: ' || language e1, ' visibility: ' || visibility e2 from cur_s where kind not in ({', '.join(map(repr, schema.NOT_EMBEDDED))})),
m as (select *, coalesce(length(e1) <= greatest(aft - 325, 0), true) f1 from a), m2 as (select *, case when f1 then coalesce(e1, '') else '' end x1 from m), m3 as (select *, x1 || case when f1 and length(x1) + length(e2) <= greatest(aft - 325, 0) then e2 else '' end meta from m2),
r as (select *, greatest(aft - length(meta), 0) lft from m3), r2 as (select *, least(lft // 6, length(t)) ot from r), r3 as (select *, lft - ot rest from r2), r4 as (select *, least(rest // 2, length(d)) od from r3), r5 as (select *, case when d = '' then rest else greatest(rest - od - 1, 0) end ob from r4)
select id, md5(substr(n || case when d <> '' and od > 0 then ' ' || substr(d, 1, od) else '' end || case when b <> '' and ob > 0 then ' ' || substr(b, 1, ob) else '' end || case when t <> '' and ot > 0 then ' ' || substr(t, 1, ot) else '' end || meta, 1, 650)) digest from r5""",
    ),
    "r18_index": (r18_index, f"""with {CUR_S}, d as (select *, epoch(coalesce(created_at, timestamp '1970-01-01'))::bigint ts from documents), c as (select 'commit:' || doc_id id, 'commit' kind, md5(substr(coalesce(text, ''), 1, 500)) digest from d where source = 'commit_message' order by ts desc, doc_id::varchar limit 40),
m as (select 'merge:' || doc_id id, 'merge' kind, md5(substr(coalesce(text, '') || ' b', 1, 500)) digest from d where source = 'pr_description' order by ts desc, doc_id::varchar limit 30)
select id, 'code:' || kind kind, md5(kind || ' ' || name || ' (' || coalesce(language, '') || ')') digest from cur_s where kind not in ({', '.join(map(repr, schema.NOT_EMBEDDED))}) union all select * from c union all select * from m
union all select 'd:' || doc_id, 'outcome', md5(substr(concat_ws(' ', 'd:' || doc_id, 'lang: ' || coalesce(lang, ''), text), 1, 500)) from d where source = 'outcome_note'"""),
    "r19_names": (r19_names, f"with {CUR_S} select id from cur_s where contains(lower(name), 'ledger') or contains(lower(coalesce(signature, '')), 'ledger')"),
    "j18_resolved": (j18_resolved, f"with {CUR_S} select id, file_path file, place from (select *, row_number() over (order by importance desc, id)::int place from cur_s where importance is not null) where place <= 100"),
    "s09_history": (s09_history, "select how, file, hash from (select 'word' how, null::varchar file, doc_id::varchar hash from documents where file_path is not null and contains(lower(text), 'ledger') order by doc_id desc limit 15) union all select 'file', file_path, max(doc_id)::varchar from documents where file_path is not null group by 2"),
    "s10_merges": (s10_merges, "select doc_id::varchar hash, case when doc_id % 2 = 0 then 'Merge branch ''b' || doc_id || '''' else 'Merge pull request #1 from o/b' || doc_id end title, case when doc_id % 2 = 0 then '' else 'o/' end || 'b' || doc_id branch, case when doc_id % 2 = 0 then '' else 'a' end outcomes from documents where text is not null and root_id is not null"),
    "s13_store": (s13_store, f"""with {CUR}, o as (select min(root_id) r from cur_s), e as (select distinct source_id, edge_type, target_id, split_part(source_id, ':', 1) root_id from cur_e), s as (select id, root_id, file_path from cur_s where file_path not like 'src/core/%' union select root_id || ':' || file_path || ':new:function', root_id, file_path from cur_s where file_path like 'src/core/%')
select 'symbols' what, root_id, count(*) n from s, o where root_id <> r group by 1, 2 union all select 'edges', e.root_id, count(*) from e cross join o where e.root_id <> r and source_id not in (select id from cur_s where file_path like 'src/core/%') group by 1, 2 union all select 'version', null, 3"""),
    "x_imports": (_recorded("import"), f"with {CUR_S}, m as (select distinct root, file from nodes where kind = 'module' and body <> ''), t as (select distinct root_id, file_path, regexp_replace(name, '^import \"', '\"') from cur_s semi join m on m.root = root_id and m.file = file_path where kind = 'import') select count(*) recorded, count(*) found from t"),
}
