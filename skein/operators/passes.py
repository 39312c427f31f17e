"""Link and enrichment passes (P01 to P18 with their joins J02 to J15, J20 to J22).

Every pass takes nodes (id, root, file, name, kind, language, line_start, signature,
body, decorators, is_test, metadata) and gives edges (source_id, target_id, edge_type,
edge_confidence) or updated nodes. Null names, bodies and paths match nothing;
repeated nodes give one edge.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skein import schema
from skein.functions import predicates as P
from skein.operators.graph import containing
from skein.session import salted_join


def edges(df: DataFrame, source: str, target: str, kind, confidence: str = "detected") -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    out = df.select(F.col(source).alias("source_id"), F.col(target).alias("target_id"), kind.alias("edge_type"), F.lit(confidence).alias("edge_confidence"))
    return out.where("source_id is not null and target_id is not null").distinct()


def meta(key: str) -> Column:
    return F.try_element_at("metadata", F.lit(key))


# P01, J10, P18 ----------------------------------------------------------------


def frameworks(nodes: DataFrame) -> DataFrame:
    """Root, file, framework: what the import statements of each file name. The rules are a fixed table."""
    rules = nodes.sparkSession.createDataFrame([(t.lower(), lang, f) for t, lang, f in schema.FRAMEWORKS], "text string, rule_language string, framework string")
    imports = nodes.where("kind = 'import'").select("root", "file", F.lower("language").alias("language"), F.lower("name").alias("imported")).distinct()
    hit = F.expr("contains(imported, text) and (rule_language = '' or rule_language = language)")
    return imports.join(F.broadcast(rules), hit).select("root", "file", "framework").distinct()


def framework_edges(nodes: DataFrame) -> DataFrame:
    """A file's module depends on a framework node of its root."""
    modules = nodes.where("kind = 'module'").groupBy("root", "file").agg(F.min("id").alias("id"))
    target = F.concat_ws(":", "root", F.lit("frameworks"), "framework", F.lit("framework"))
    return edges(frameworks(nodes).join(modules, ["root", "file"]).withColumn("target", target), "id", "target", "depends_on")


def subsystem_frameworks(members: DataFrame, used: DataFrame, least: float = 0.7) -> DataFrame:
    """Subsystem, framework, share where at least ``least`` of the members' files use it. members: subsystem, root, file."""
    files = members.select("subsystem", "root", "file").distinct()
    total = files.groupBy("subsystem").agg(F.count("*").alias("files"))
    hits = files.join(used, ["root", "file"]).groupBy("subsystem", "framework").agg(F.count("*").alias("n"))
    return hits.join(total, "subsystem").select("subsystem", "framework", (F.col("n") / F.col("files")).alias("share")).where(F.col("share") >= least)


# P02, P03, J08, J09 -----------------------------------------------------------


def router_prefixes(files: DataFrame) -> DataFrame:
    """root, file, router, prefix, rank: prefixes from the router's own file (rank 0) and from include calls (rank 1). files: root, file, body."""
    text = F.coalesce(F.col("body"), F.lit(""))
    own = F.regexp_extract_all(text, F.lit(r"(?m)^\s*(\w+)\s*(?::[^=\n]*)?=\s*APIRouter\(([^)]*)\)"), F.lit(0))
    made = files.select("root", "file", F.explode(own).alias("call"), F.lit(0).alias("rank"))
    made = made.withColumn("router", F.regexp_extract("call", r"^\s*(\w+)", 1))
    calls = F.regexp_extract_all(text, F.lit(r"\.include_router\(([^)]*)\)"), F.lit(0))
    included = files.select("root", "file", F.explode(calls).alias("call"), F.lit(1).alias("rank"))
    included = included.withColumn("router", F.regexp_extract("call", r"include_router\(\s*(?:\w+\.)?(\w+)", 1))
    prefix = F.regexp_extract("call", r"prefix\s*=\s*[\"']([^\"']*)[\"']", 1)
    return made.unionByName(included).select("root", "file", "router", prefix.alias("prefix"), "rank").where("prefix <> '' and router <> ''")


def apply_router_prefixes(nodes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """http_path of Python endpoints with their router's prefix; the path in the file stays in http_path_local.

    The prefix of the same file comes first, else the one of an include call (by file order). Applying it again changes nothing.
    """
    own = prefixes.where("rank = 0").groupBy("root", "file", F.col("router").alias("router_var")).agg(F.min("prefix").alias("own_prefix"))
    other = prefixes.where("rank = 1").groupBy("root", F.col("router").alias("router_var")).agg(F.min_by("prefix", F.struct("file", "prefix")).alias("included_prefix"))
    n = nodes.withColumn("router_var", meta("router_var")).join(own, ["root", "file", "router_var"], "left").join(other, ["root", "router_var"], "left")
    prefix = F.coalesce("own_prefix", "included_prefix")
    local = F.coalesce(meta("http_path_local"), meta("http_path"))
    path = F.concat(F.regexp_replace(prefix, "/+$", ""), local)
    changed = F.map_from_entries(F.array(F.struct(F.lit("http_path").alias("key"), path.alias("value")), F.struct(F.lit("http_path_local").alias("key"), local.alias("value"))))
    kept = F.map_filter("metadata", lambda k, _: ~k.isin("http_path", "http_path_local"))
    hit = (F.col("kind") == "api_endpoint") & (F.lower("language") == "python") & prefix.isNotNull() & local.isNotNull()
    return n.withColumn("metadata", F.when(hit, F.map_concat(kept, changed)).otherwise(F.col("metadata"))).select(*nodes.columns)


def suffixes(path) -> Column:
    """All suffixes of a path that start at a segment: /a/b gives /a/b and /b."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, k, F.size(parts)), "/")))


def sdk_full_paths(nodes: DataFrame) -> DataFrame:
    """Id, http_path of Python endpoints whose local path ends exactly one SDK path of their root."""
    sdk = nodes.where((F.col("kind") == "const") & P.is_generated_sdk("file") & P.looks_like_url_path("name")).select("root", F.col("name").alias("full")).distinct()
    ends = sdk.select("root", "full", F.explode(suffixes(F.col("full"))).alias("local"))
    unique = ends.groupBy("root", "local").agg(F.count("*").alias("n"), F.min("full").alias("full")).where("n = 1")
    local = nodes.where((F.col("kind") == "api_endpoint") & (F.lower("language") == "python") & meta("http_path_local").isNull()).select("id", "root", meta("http_path").alias("local"))
    return local.join(unique, ["root", "local"]).where("full <> local").select("id", F.col("full").alias("http_path"))


def resolve_by_suffix(paths: DataFrame, files: DataFrame) -> DataFrame:
    """Path, file, confidence: an exact file, else the only file that ends with /path. paths: path; files: file."""
    exact = paths.join(files.select(F.col("file").alias("path"), "file").distinct(), "path")
    rest = paths.join(exact.select("path"), "path", "left_anti")
    ends = files.distinct().select("file", F.explode(suffixes(F.col("file"))).alias("end")).select("file", F.substr("end", F.lit(2)).alias("path"))
    unique = ends.groupBy("path").agg(F.count("*").alias("n"), F.min("file").alias("file")).where("n = 1")
    return exact.unionByName(rest.join(unique.drop("n"), "path")).withColumn("confidence", F.lit("confirmed"))


# P04, P05, J02, J06, J07 ------------------------------------------------------


def url_links(nodes: DataFrame) -> DataFrame:
    """Literals that look like paths depend on the endpoints of the same normalized path."""
    ends = nodes.where("kind = 'api_endpoint'").select(F.col("id").alias("target"), P.normalized_route(meta("http_path")).alias("route")).where("route is not null")
    lits = nodes.where((F.col("kind") == "const") & (meta("synthetic") == "true") & P.looks_like_url_path("name")).select("id", P.normalized_route("name").alias("route"))
    return edges(salted_join(lits, ends, ["route"], ["id"]), "id", "target", "depends_on")


def sdk_links(nodes: DataFrame) -> DataFrame:
    """Generated SDK functions implement the endpoint of their operation id, if it is the only one.

    An operation id that several endpoints share links nothing and stops the fallback: by the
    path literals on the function's lines and the method in its name.
    """
    ends = nodes.where("kind = 'api_endpoint'").select(F.col("id").alias("target"), P.operation_key(meta("operation_id")).alias("operation"), P.normalized_route(meta("http_path")).alias("route"), F.upper(meta("http_method")).alias("method"))
    fns = nodes.where((F.col("kind") == "function") & P.is_generated_sdk("file")).select("id", "root", "file", "line_start", "line_end", P.operation_key("name").alias("operation"), P.sdk_method("name").alias("method"))
    by_operation = ends.where("operation is not null").groupBy("operation").agg(F.count("*").alias("n"), F.min("target").alias("target"))
    hit = fns.join(by_operation, "operation")
    first = edges(hit.where("n = 1"), "id", "target", "implements")
    rest = fns.join(hit.select("id"), "id", "left_anti")
    urls = nodes.where((F.col("kind") == "const") & P.looks_like_url_path("name")).select("root", "file", F.col("line_start").alias("line"), P.normalized_route("name").alias("route"))
    on_lines = containing(urls, rest)
    unique = ends.groupBy("route", "method").agg(F.count("*").alias("n"), F.min("target").alias("target")).where("n = 1")
    return first.unionByName(edges(on_lines.join(unique, ["route", "method"]), "id", "target", "implements")).distinct()


# P07, J03 ---------------------------------------------------------------------


def test_links(nodes: DataFrame) -> DataFrame:
    """Test functions are linked to the production functions whose names (4 letters or more) theirs contain.

    Matches are leftmost, then longest, don't overlap and ignore case. All
    substrings of the distinct test names that have some name's length are joined with
    the distinct names, so no pair of names is compared that doesn't match.
    A name defined several times is linked once: to the smallest id in the test's root, else of all.
    """
    test = P.is_test_function("kind", "is_test", "decorators", "file")
    fns = nodes.where("kind = 'function' and name is not null").select("id", "root", F.lower("name").alias("name"), test.alias("test"))
    names = fns.where("not test and length(name) >= 4").select("root", "name", "id")
    local = names.groupBy("name", "root").agg(F.min("id").alias("local_id"))
    anywhere = local.groupBy("name").agg(F.min("local_id").alias("any_id"))
    tests = fns.where("test")
    span = anywhere.select(F.length("name").alias("size")).distinct().agg(F.collect_set("size").alias("sizes"))
    texts = tests.select(F.col("name").alias("text")).distinct().withColumn("sizes", span.scalar())
    parts = texts.select("text", F.explode(F.filter("sizes", lambda s: s <= F.length("text"))).alias("size"))
    parts = parts.select("text", "size", F.explode(F.sequence(F.lit(1), F.length("text") - F.col("size") + 1)).alias("start"))
    found = parts.withColumn("name", F.substr("text", "start", "size")).join(anywhere.select("name"), "name", "left_semi")
    each = found.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("size")).alias("less"), "name"))).alias("hits"))

    def take(acc, hit):
        taken = F.struct((hit["start"] - hit["less"]).cast("int").alias("free"), F.concat(acc["names"], F.array(hit["name"])).alias("names"))
        return F.when(hit["start"] >= acc["free"], taken).otherwise(acc)

    zero = F.struct(F.lit(1).alias("free"), F.array().cast("array<string>").alias("names"))
    kept = each.select("text", F.explode(F.array_distinct(F.aggregate("hits", zero, take)["names"])).alias("name"))
    pairs = tests.select("id", "root", F.col("name").alias("text")).join(kept, "text").join(anywhere, "name").join(local, ["name", "root"], "left")
    return edges(pairs.withColumn("target", F.coalesce("local_id", "any_id")).where("id <> target"), "id", "target", "tested_by")


# P08, J04 ---------------------------------------------------------------------


def imported_names(text) -> Column:
    """The callable names an import statement binds; none for namespaces, whole modules and types."""
    t = F.trim(text)
    first = lambda x: F.regexp_extract(x, r"^\s*(?:type\s+\S+|([A-Za-z_$][\w$]*))", 1)
    listed = lambda s: F.filter(F.transform(F.split(s, ","), first), lambda n: ~n.isin("", "self"))
    python = F.regexp_extract(t, r"(?s)^from\s+\S+\s+import\s+\(?([^)]*)\)?", 1)
    braces = F.regexp_extract(t, r"(?s)^import\s+[^'\"]*?\{([^}]*)\}", 1)
    default = F.regexp_extract(t, r"^import\s+(?!type\b)([A-Za-z_$][\w$]*)\s*(?:,|from\b)", 1)
    group = F.regexp_extract(t, r"(?s)^(?:pub(?:\([^)]*\))?\s+)?use\s+[^{;]*::\{([^}]*)\}", 1)
    single = F.regexp_extract(t, r"^(?:pub(?:\([^)]*\))?\s+)?use\s+(?:\w+::)*(\w+)\s*(?:as\s+\w+\s*)?;?$", 1)
    script = F.filter(F.concat(F.array(default), listed(braces)), lambda n: n != "")
    return (
        F.when(t.rlike(r"^import\s+type\b"), F.array().cast("array<string>"))
        .when(python != "", listed(python))
        .when(t.rlike(r"^import\b.*\bfrom\b"), script)
        .when(group != "", listed(group))
        .when(single != "", F.array(single))
        .otherwise(F.array().cast("array<string>"))
    )


def import_calls(nodes: DataFrame) -> DataFrame:
    """A function calls what its file imports and its body calls by bare name, where that is defined in another file of the same language family."""
    fns = nodes.where("kind = 'function'").select("id", "root", "file", "name", P.language_family("language").alias("family"), "body")
    sites = fns.select("id", "root", "file", "family", F.col("name").alias("caller"), F.explode(P.call_sites("body")).alias("name"))
    bound = nodes.where("kind = 'import'").select("root", "file", F.explode(imported_names(F.col("name"))).alias("name")).where("length(name) >= 4").distinct()
    used = sites.join(bound, ["root", "file", "name"]).where("caller <> name")
    defined = fns.select(F.col("id").alias("target"), F.col("root").alias("troot"), F.col("file").alias("tfile"), "name", "family")
    hits = salted_join(used, defined, ["name", "family"], ["id"]).where("root <> troot or file <> tfile")
    return edges(hits, "id", "target", "calls")


def same_file_calls(nodes: DataFrame) -> DataFrame:
    """Bare calls of functions that are defined in the same file; no self-calls."""
    fns = nodes.where("kind = 'function'").select("id", "root", "file", "name", "body")
    sites = fns.select("id", "root", "file", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"(?<![\w$.:])([A-Za-z_$][\w$]*)\s*\("), F.lit(1)))).alias("name"))
    return edges(sites.join(fns.select(F.col("id").alias("target"), "root", "file", "name"), ["root", "file", "name"]).where("id <> target"), "id", "target", "calls")


# P09 --------------------------------------------------------------------------


def directory_modules(nodes: DataFrame) -> DataFrame:
    """Every symbol belongs to the module of its directory; a file at the top to that of its stem."""
    n = nodes.where("kind <> 'module' and root <> 'external' and file <> ''").where(F.coalesce(meta("virtual"), F.lit("")) != "true")
    parts = F.split("file", "/")
    nested = F.size(parts) > 1
    folder = F.when(nested, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")).otherwise("")
    module = F.when(nested, F.element_at(parts, -2)).otherwise(F.regexp_replace("file", r"(?<=.)\.[^.]*$", ""))
    return edges(n.withColumn("target", F.concat_ws(":", "root", folder, module, F.lit("module"))), "id", "target", "belongs_to")


# P10, P11, P15, J20, J21 ------------------------------------------------------


def topics(nodes: DataFrame, detected: list[str]) -> DataFrame:
    """P10: functions produce to or consume from the first topic that each rule of a detected framework finds in their body."""
    rules = []
    for framework, pattern, prefix, name, direction in schema.TOPIC_RULES:
        if framework in detected:
            topic = F.lit(name) if name else P.quoted_after("body", prefix)
            hit = F.lower("body").contains(pattern.lower()) & topic.isNotNull()
            rules.append(F.when(hit, F.struct(topic.alias("topic"), F.lit(direction).alias("direction"))))
    if not rules:
        return edges(nodes.where("false").withColumn("t", F.lit("")), "id", "t", "produces")
    hits = nodes.where("kind = 'function' and body is not null").select("id", "root", F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull())).alias("r"))
    target = F.concat_ws(":", "root", F.lit("channels"), "r.topic", F.lit("channel"))
    return edges(hits.withColumn("target", target), "id", "target", F.col("r.direction"))


def socket_events(nodes: DataFrame) -> DataFrame:
    """Functions produce or consume every event they name, but those of the connection itself."""

    def named(direction):
        return lambda e: F.struct(e.alias("event"), F.lit(direction).alias("direction"))

    found = [F.transform(P.all_quoted_after("body", pattern), named(direction)) for pattern, direction in schema.SOCKET_RULES]
    hits = nodes.where("kind = 'function' and body is not null").select("id", "root", F.explode(F.array_distinct(F.flatten(F.array(*found)))).alias("e"))
    hits = hits.where(~F.col("e.event").isin("", *schema.LIFECYCLE_EVENTS))
    return edges(hits.withColumn("target", F.concat_ws(":", "root", F.lit("events"), "e.event", F.lit("event"))), "id", "target", F.col("e.direction"))


def boundaries(nodes: DataFrame, configs: list[dict]) -> DataFrame:
    """Calls that a boundary config describes. A config has language, imports (gate), pattern (glob), argument (position) or decorator, edge_kind.

    A file is looked at where one of its imports contains one of the config's texts.
    Only literal arguments count.
    """
    import re

    def names(text):
        return lambda x: x.contains(text)

    out = None
    files = nodes.where("kind = 'import'").groupBy("root", "file").agg(F.collect_set("name").alias("imported"))
    for c in configs:
        gate = reduce(lambda a, b: a | b, [F.exists("imported", names(t)) for t in c["imports"]]) if c.get("imports") else F.lit(True)
        part = nodes.where((F.col("kind") == "function") & (F.lower("language") == c["language"].lower())).join(files, ["root", "file"], "left").where(F.coalesce(gate, F.lit(False)))
        call = r"(?<![\w.])" + ".*".join(map(re.escape, c["pattern"].split("*"))).replace(".*", r"[\w.]*")
        if c.get("decorator"):
            found = F.when(F.coalesce("decorators", F.lit("")).rlike(call), F.array(F.col("name")))
        else:
            before = r"[^,()]*," * int(c.get("argument", 0))
            found = F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(call + r"\s*\(" + before + r"\s*[\"']([^\"']+)[\"']"), F.lit(1))
        hits = part.select("id", "root", F.explode(found).alias("topic"))
        hits = edges(hits.withColumn("target", F.concat_ws(":", "root", F.lit("channels"), "topic", F.lit("channel"))), "id", "target", c["edge_kind"])
        out = hits if out is None else out.unionByName(hits)
    return out.distinct() if out is not None else edges(nodes.where("false").withColumn("t", F.lit("")), "id", "t", "produces")


# P12, P14, J22 ----------------------------------------------------------------


def _segment(s) -> Column:
    return F.regexp_replace(s, r"^\[{1,2}(?:\.\.\.)?([^\[\]]*)\]{1,2}$", r"\{$1\}")


def file_routes(files: DataFrame) -> DataFrame:
    """Root, file, http_path, convention of files that are routes by their place (app/.../route, pages/api/...)."""
    path = F.replace("file", F.lit("\\"), F.lit("/"))
    app = F.regexp_extract(path, r"^(?:.*/)?(?:src/)?app/(?:(.*)/)?route\.(?:tsx?|jsx?)$", 1)
    is_app = path.rlike(r"^(?:.*/)?app/(?:.*/)?route\.(?:tsx?|jsx?)$")
    pages = F.regexp_extract(path, r"^(?:.*/)?pages/(api(?:/.*)?)\.(?:tsx?|jsx?)$", 1)
    name = F.element_at(F.split(path, "/"), -1)
    noise = name.startswith("_") | name.contains(".test.") | name.contains(".spec.") | name.endswith(".d.ts")
    local = F.when(is_app, app).when((pages != "") & ~noise, F.regexp_replace(pages, "/index$", ""))
    http = F.concat(F.lit("/"), F.array_join(F.transform(F.split(local, "/"), _segment), "/"))
    return files.select("root", "file", http.alias("http_path"), F.when(is_app, "app").otherwise("pages").alias("convention")).where("http_path is not null").distinct()


def route_handlers(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Endpoints are implemented by the functions of the same file: by exported method names (app) or any function (pages)."""
    fns = nodes.where("kind = 'function'").select("id", "root", "file", "name")
    hits = file_routes(files).join(fns, ["root", "file"])
    methods = ["GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS"]
    hits = hits.where(F.col("name").isin(methods) | (F.col("convention") == "pages"))
    method = F.when(F.col("convention") == "app", F.col("name")).otherwise("ANY")
    return edges(hits.withColumn("target", F.concat_ws(":", "root", "file", F.concat_ws(" ", method, "http_path"), F.lit("api_endpoint"))), "id", "target", "implements")


def minimal_endpoints(files: DataFrame) -> DataFrame:
    """Root, file, line, method, path of calls like app.MapGet("/x", ...) outside comments. files: root, file, body."""
    lines = files.select("root", "file", F.posexplode(F.split("body", "\n")).alias("at", "text")).where(~F.trim("text").startswith("//"))
    call = F.regexp_extract_all("text", F.lit(r"\b(Map(?:Get|Post|Put|Delete|Patch))\s*\(\s*\"[^\"]*\""), F.lit(0))
    hits = lines.select("root", "file", (F.col("at") + 1).alias("line"), F.explode(call).alias("call"))
    method = F.upper(F.regexp_extract("call", r"Map(\w+?)\s*\(", 1))
    return hits.select("root", "file", "line", method.alias("method"), F.regexp_extract("call", r"\"([^\"]*)\"", 1).alias("path"))


# P13, J05 ---------------------------------------------------------------------


def rpc_calls(nodes: DataFrame) -> DataFrame:
    """Functions of files that import an RPC stub call the RPCs they name on a receiver, exactly or in Pascal case."""
    imports = nodes.where("kind = 'import'").where(reduce(lambda a, b: a | b, [F.col("name").contains(x) for x in schema.RPC_IMPORTS]))
    fns = nodes.where("kind = 'function' and body is not null").join(imports.select("root", "file").distinct(), ["root", "file"], "left_semi")
    sites = fns.select("id", F.col("name").alias("caller"), F.explode(P.method_call_sites("body")).alias("site"))
    rpcs = nodes.where((F.col("kind") == "function") & meta("parent_service").isNotNull()).select(F.col("id").alias("target"), F.col("name").alias("rpc"))
    known = rpcs.select(F.col("rpc").alias("site")).distinct().withColumn("exact", F.lit(True))
    keyed = sites.join(known, "site", "left").withColumn("rpc", F.when(F.col("exact"), F.col("site")).otherwise(P.pascal_case("site")))
    hits = salted_join(keyed.select("id", "caller", "rpc"), rpcs, ["rpc"], ["id"])
    return edges(hits.where("caller <> rpc and id <> target"), "id", "target", "calls")


# P16, P17, J12 to J14 ----------------------------------------------------------


def merge_links(merges: DataFrame, nodes: DataFrame) -> DataFrame:
    """A merge modified the symbols of its files. merges: id, files array."""
    touched = merges.select(F.col("id").alias("merge"), F.explode("files").alias("file")).distinct()
    return edges(touched.join(nodes.where("kind not in ('import', 'module')").select("id", "file"), "file"), "merge", "id", "modified")


def subsystem_nodes(labels: DataFrame) -> DataFrame:
    """Symbols (id, root, subsystem) belong to the node of their subsystem."""
    return edges(labels.withColumn("target", F.concat_ws(":", "root", F.lit("subsystems"), "subsystem", F.lit("subsystem"))), "id", "target", "belongs_to")


def glob_matches(files: DataFrame, globs: DataFrame) -> DataFrame:
    """F12 as a join: ``files`` (file, ...) with every pattern of ``globs`` (pattern, ...) that they match.

    Files meet patterns by the text before the first star, so no file is compared with a pattern that starts
    otherwise; patterns without a star by the whole path.
    """
    head = F.split_part("pattern", F.lit("*"), F.lit(1))
    stars = F.length("pattern") - F.length(F.replace("pattern", F.lit("*"), F.lit("")))
    g = globs.where("pattern is not null").withColumn("_head", head)
    lengths = g.where(stars > 0).agg(F.coalesce(F.collect_set(F.length("_head")), F.array().cast("array<int>")).alias("lengths")).scalar()
    whole = files.join(g.where(stars == 0).withColumnRenamed("_head", "_key"), files.file == F.col("_key")).drop("_key")
    keyed = files.withColumn("_sizes", lengths).withColumn("_size", F.explode("_sizes")).where(F.col("_size") <= F.length("file")).withColumn("_head", F.substr("file", F.lit(1), F.col("_size"))).drop("_size", "_sizes")
    begun = salted_join(keyed, g.where(stars > 0), ["_head"], ["file"]).where(P.simple_glob("file", "pattern")).drop("_head")
    return whole.unionByName(begun)


def outcome_commits(outcomes: DataFrame, commits: DataFrame) -> DataFrame:
    """Outcome, hash, how: commits tagged [outcome:id] (ignoring case), then those that touch the outcome's file patterns.

    outcomes: outcome, patterns array; commits: hash, message, files array.
    """
    tags = commits.select("hash", F.explode(P.outcome_tags("message")).alias("tag")).select("hash", F.lower("tag").alias("tag"))
    tagged = tags.join(outcomes.select("outcome", F.lower("outcome").alias("tag")), "tag").select("outcome", "hash", F.lit(0).alias("how"))
    globs = outcomes.select("outcome", F.explode("patterns").alias("pattern"))
    touched = glob_matches(commits.select("hash", F.explode("files").alias("file")).distinct(), globs).select("outcome", "hash", F.lit(1).alias("how"))
    return tagged.unionByName(touched).groupBy("outcome", "hash").agg(F.min("how").alias("how"))


def outcome_merges(outcomes: DataFrame, merges: DataFrame, serves: DataFrame) -> DataFrame:
    """Outcome, merge: by a serves edge (merge, outcome) or by file pattern."""
    globs = outcomes.select("outcome", F.explode("patterns").alias("pattern"))
    touched = glob_matches(merges.select(F.col("id").alias("merge"), F.explode("files").alias("file")), globs).select("outcome", "merge")
    served = serves.join(outcomes.select(F.col("outcome").alias("known")), F.lower("outcome") == F.lower("known")).select(F.col("known").alias("outcome"), "merge")
    return served.unionByName(touched).distinct()


def outcome_symbols(hits: DataFrame, commits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Outcome, id: the symbols (no imports) in the files of an outcome's commits."""
    files = hits.join(commits.select("hash", F.explode("files").alias("file")), "hash").select("outcome", "file").distinct()
    return files.join(nodes.where("kind <> 'import'").select("id", "file"), "file").select("outcome", "id").distinct()


def outcome_sections(outcomes: DataFrame, sections: DataFrame) -> DataFrame:
    """Outcome, id: the markdown sections (id, body) that name an outcome as a word, ignoring case. outcomes: outcome."""
    words = sections.where("body is not null").select("id", F.explode(F.array_distinct(F.split(F.lower("body"), r"[^\p{L}\p{N}_-]+"))).alias("word"))
    return words.join(outcomes.select("outcome", F.lower("outcome").alias("word")), "word").select("outcome", "id").distinct()


def deduped(edges_: DataFrame) -> DataFrame:
    """One row for each (source_id, edge_type, target_id): a confirmed edge before a detected one, then the smallest values. Edges with a null end or kind are none."""
    keys = ["source_id", "edge_type", "target_id"]
    rest = [c for c in edges_.columns if c not in keys]
    good = edges_.where("source_id is not null and target_id is not null and edge_type is not null")
    if not rest:
        return good.distinct()
    rank = [F.when(F.col(c) == "confirmed", 0).otherwise(1) for c in rest if c == "edge_confidence"]
    one = good.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*rank, *rest)).alias("r"))
    return one.select(*keys, "r.*").select(*edges_.columns)


def dirty_only(nodes: DataFrame, dirty: list[str] | None) -> DataFrame:
    """None means all roots, an empty list none."""
    return nodes if dirty is None else nodes.where(F.col("root").isin(dirty)) if dirty else nodes.where("false")


def newest_wins(nodes: DataFrame) -> DataFrame:
    """Node dedupe of an incremental update: the highest batch of each id (ties: lowest line)."""
    w = W.partitionBy("id").orderBy(F.desc("batch"), F.asc_nulls_last("line_start"))
    return nodes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
