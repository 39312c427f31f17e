"""Queries of search, link passes, extraction and sources, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import schema
from skein.functions import predicates as P
from skein.operators import graph as G
from skein.operators import passes, search
from skein.plans.graph_queries import CUR_S, _test_path
from skein.session import table
from skein.sources import extract, markdown

ASK = "tractor ledger balance"


def _nodes(spark: SparkSession, sf_dir: str, cols: str = "root file name kind language line_start line_end signature body decorators is_test") -> DataFrame:
    """Current symbols as the passes read them."""
    return G.load(spark, sf_dir, cols).nodes.withColumn("metadata", F.create_map().cast("map<string,string>"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def s19_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and occurrences of each term."""
    return search.postings(_documents(spark, sf_dir), "doc_id", "text").groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("n"))


def r04_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir)
    hits = search.bm25(search.postings(d, "doc_id", "text"), search.corpus_lengths(d, "text"), ASK)
    return hits.select("id", F.round("score", 6).alias("score"))


def r05_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 100."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    q = v.where("id % 100 = 0").withColumnRenamed("id", "query")
    return search.nearest(v, q, 10).select("query", "id", F.round("score", 6).alias("score"), "place")


def r06_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword hits fused with the nearest vectors of id 0, joined by id."""
    d = _documents(spark, sf_dir)
    key = search.bm25(search.postings(d, "doc_id", "text"), search.corpus_lengths(d, "text"), ASK).select("id", F.round("score", 6).alias("score"))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    near = search.nearest(v, v.where("id = 0").withColumnRenamed("id", "query"), 50).select("id", F.round("score", 6).alias("score"))
    return search.fuse(key, near).select("id", F.round("score", 8).alias("score"))


def r07_squash(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = G.load(spark, sf_dir, "file importance").nodes.where("importance is not null")
    return n.select("id", F.round(search.squash(F.col("importance"), "file"), 6).alias("score"))


def r13_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown sections that match "ledger"."""
    n = table(spark, sf_dir, "nodes").where("kind = 'markdown_section'")
    return n.select("id", F.round(search.section_score("ledger", F.col("name"), F.lit(2), F.col("body")), 6).alias("score")).where("score is not null").distinct()


def r14_section_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nodes").where("kind = 'markdown_section'")
    return n.select("id", search.section_points("ledger", F.col("name"), F.lit(2), F.col("body")).alias("points")).where("points is not null").distinct()


def r10_supplement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols whose signature says "batch" by importance, with name matches that this list lacks."""
    n = G.load(spark, sf_dir, "name signature importance").nodes
    hits = n.where(F.lower("signature").contains("batch") & F.col("importance").isNotNull()).select("id", F.col("importance").alias("score")).orderBy(F.desc("score"), "id").limit(40)
    names = n.where(F.lower("name").contains("batch")).select("id", F.coalesce("importance", F.lit(0.0)).alias("score"))
    return search.supplement(hits, names, 40).select("id", "source_rank")


def r15_embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = G.load(spark, sf_dir, "kind name doc_comment body").nodes.where(P.embeddable("kind"))
    return n.select("id", F.md5(search.embedding_text("name", "doc_comment", "body")).alias("digest"))


def r17_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of every document's stand-in vector, 1 or 0, and whether no more places are taken than there are words."""
    d = _documents(spark, sf_dir)
    v = search.hashed_vectors(d, "doc_id", "text").join(d.select(F.col("doc_id").alias("id"), F.size(F.array_distinct(search.words_of(F.col("text")))).alias("words")), "id")
    taken = F.size(F.filter("embedding", lambda x: x != 0))
    return v.select(F.col("id").alias("doc_id"), F.round(F.sqrt(search.dot(F.col("embedding"), F.col("embedding"))), 4).alias("norm"), ((taken <= F.col("words")) & ((taken > 0) == (F.col("words") > 0))).alias("fits"))


def s20_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an embedding table would do between the snapshots before the newest and the newest: embed, delete, keep."""
    s = table(spark, sf_dir, "symbols")
    last = s.groupBy("root_id").agg(F.max("scan_version").alias("v"))
    before = s.join(last, "root_id").where("scan_version < v").drop("v")
    text = lambda d: G.newest(d, ["name", "doc_comment", "body"]).select("id", F.md5(search.embedding_text("name", "doc_comment", "body")).alias("text_hash"))
    new, stale, kept = search.upsert_embeddings(text(before), text(s))
    count = lambda d, what: d.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    return count(new, "embed").unionByName(count(stale, "delete")).unionByName(count(kept, "keep"))


def link08_imported_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _nodes(spark, sf_dir, "name kind").where("kind = 'import'")
    return n.select(F.explode(passes.imported_names(F.col("name"))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


def link09_directory_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passes.directory_modules(_nodes(spark, sf_dir, "root file kind")).select("source_id", "target_id")


def link10_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first quoted literal after "Error(" in every function."""
    n = _nodes(spark, sf_dir, "kind body").where("kind = 'function'")
    return n.select("id", P.quoted_after("body", "Error(").alias("literal")).where("literal is not null")


def link11_quoted_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _nodes(spark, sf_dir, "kind body").where("kind = 'function'")
    return n.select("id", F.explode(P.all_quoted_after("body", "Error(")).alias("literal")).groupBy("literal").agg(F.count("*").alias("n"))


def link12_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file's path as a normalized route, counted."""
    n = _nodes(spark, sf_dir, "root file").select("root", F.concat(F.lit("/"), F.col("file")).alias("path")).distinct()
    return n.select(P.normalized_route("path").alias("route")).groupBy("route").agg(F.count("*").alias("n"))


def link13_method_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _nodes(spark, sf_dir, "kind body").where("kind = 'function'")
    return n.select(F.explode(P.method_call_sites("body")).alias("site")).groupBy("site").agg(F.count("*").alias("functions"))


def link17_subsystems(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _nodes(spark, sf_dir, "root file").withColumn("subsystem", F.split_part("file", F.lit("/"), F.lit(1)))
    return passes.subsystem_nodes(n).select("source_id", "target_id")


def link18_subsystem_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages as what 70% of a directory's files use."""
    n = _nodes(spark, sf_dir, "root file language").where("language is not null")
    members = n.select(F.concat_ws("/", "root", F.split_part("file", F.lit("/"), F.lit(1))).alias("subsystem"), "root", "file")
    used = n.select("root", "file", F.lower("language").alias("framework")).distinct()
    return passes.subsystem_frameworks(members, used).select("subsystem", "framework", F.round("share", 6).alias("share"))


def j15_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare file names resolved to the only file that ends with them."""
    files = _nodes(spark, sf_dir, "file").select("file").where("file <> ''").distinct()
    paths = files.select(F.element_at(F.split("file", "/"), -1).alias("path")).distinct()
    return passes.resolve_by_suffix(paths, files).select("path", "file")


def s10_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches and tags in all texts, and the words in square brackets as tags."""
    d = _documents(spark, sf_dir).where("text is not null")
    text = F.regexp_replace("text", r"\[(warn|error|note)\]", r"[outcome: $1 ]")
    return d.select("doc_id", F.array_join(F.array_sort(P.outcome_tags(text)), ",").alias("tags"), P.branch_name("text").alias("branch")).where("tags <> '' or branch is not null")


def s07_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown sections in all documents, by level."""
    d = _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("file_path"), "text")
    return markdown.markdown_chunks(d).groupBy("heading_level", "is_frontmatter").agg(F.count("*").alias("n"))


def x_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges that the extractors find in all module texts, by kind."""
    rows = extract.extract(table(spark, sf_dir, "nodes").where("kind = 'module'"))
    return rows.groupBy("what", F.coalesce("kind", "edge_type", "name").alias("kind")).agg(F.count("*").alias("n"))


def x_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the recorded function nodes, how many the extractors find at their line."""
    n = table(spark, sf_dir, "nodes")
    mine = extract.nodes_of(extract.extract(n.where("kind = 'module'"))).where("kind = 'function'").select("root", "file", "name")
    theirs = n.where("kind = 'function'").select("root", "file", "name").distinct()
    modules = n.where("kind = 'module' and body <> ''").select("root", "file").distinct()
    theirs = theirs.join(modules, ["root", "file"], "left_semi")
    return theirs.join(mine.distinct().withColumn("hit", F.lit(1)), ["root", "file", "name"], "left").agg(F.count("*").alias("functions"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found"))


def g24_outcome_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as commits of outcomes, which are file patterns; symbols in their files."""
    d = _documents(spark, sf_dir)
    commits = d.select(F.col("doc_id").cast("string").alias("hash"), F.coalesce("text", F.lit("")).alias("message"), F.array_compact(F.array("file_path")).alias("files"))
    outcomes = spark.createDataFrame([("core", ["src/core/*"]), ("docs", ["docs/*", "*.md"])], "outcome string, patterns array<string>")
    hits = passes.outcome_commits(outcomes, commits)
    symbols = passes.outcome_symbols(hits, commits, _nodes(spark, sf_dir, "file kind")).groupBy("outcome").agg(F.count("*").alias("symbols"))
    return hits.groupBy("outcome").agg(F.count("*").alias("commits")).join(symbols, "outcome", "left").select("outcome", "commits", F.coalesce("symbols", F.lit(0)).alias("symbols"))


def r20_minified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much shorter all function bodies become, by language."""
    from skein.functions.minify import minified

    n = table(spark, sf_dir, "nodes").where("kind = 'function' and body <> ''")
    both = minified(n).select("id", F.length("body").alias("after")).groupBy("id").agg(F.max("after").alias("after"))
    before = n.groupBy("id").agg(F.max(F.length("body")).alias("before"), F.max(F.lower("language")).alias("language"))
    return before.join(both, "id").groupBy("language").agg(F.count("*").alias("functions"), F.round(F.sum("after") / F.sum("before"), 4).alias("kept"))


def r03_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol search by name with filters, sort and limit, through the API."""
    from skein.plans import api

    return api.search(G.load(spark, sf_dir, "kind name signature file importance"), query="batch", kind="function", limit=20).select("id", "place")


WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
POST = f"w as (select doc_id id, {WORDS} w from documents), post as (select id, len(w) length, unnest(w) term from w), tf as (select term, id, length, count(*) tf from post group by all)"
BM25 = f"""{POST}, c as (select count(*) filter (len(w) > 0) docs, avg(len(w)) filter (len(w) > 0) average from w), q as (select unnest(['{"', '".join(ASK.split())}']) term),
h as (select tf.* from tf join q using (term)), d as (select term, count(*) df from h group by 1),
bm as (select id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))), 6) score from h join d using (term), c group by 1)"""
COS = "list_dot_product(a.embedding::double[], b.embedding::double[]) / sqrt(list_dot_product(a.embedding::double[], a.embedding::double[]) * list_dot_product(b.embedding::double[], b.embedding::double[]))"
EMBED = "md5(substr(concat_ws(chr(10), name, doc_comment, body), 1, 650))"
NOT_EMBEDDED = ", ".join(repr(k) for k in schema.NOT_EMBEDDED)
FRAMEWORK_VALUES = "(values " + ", ".join("('" + t.lower().replace("'", "''") + f"', '{lang}', '{f}')" for t, lang, f in schema.FRAMEWORKS) + ") r(text, lang, framework)"
SECTIONS = "s as (select distinct id, lower(trim(regexp_replace(name, '^#+', ''))) head, lower(name) raw, lower(coalesce(body, '')) body from nodes where kind = 'markdown_section')"

QUERIES = {
    "s19_postings": (s19_postings, f"with {POST} select term, count(*) docs, sum(tf)::bigint n from tf group by 1"),
    "r03_search": (r03_search, f"""with {CUR_S} select id, place from (select id, row_number() over (order by (lower(name) = 'batch') desc, contains(lower(name), 'batch') desc, {_test_path('file_path')}, importance desc nulls last, id)::int place
from cur_s where kind = 'function' and (contains(lower(name), 'batch') or contains(lower(coalesce(signature, '')), 'batch'))) where place <= 20"""),
    "r04_keyword": (r04_keyword, f"with {BM25} select id, score from bm"),
    "r05_semantic": (r05_semantic, f"with s as (select a.vec_id query, b.vec_id id, round({COS}, 12) score from embeddings a, embeddings b where a.vec_id % 100 = 0) select query, id, round(greatest(score, 0), 6) score, place from (select *, row_number() over (partition by query order by greatest(score, 0) desc, id)::int place from s) where place <= 10"),
    "r06_hybrid": (r06_hybrid, f"with {BM25}, v as (select b.vec_id id, round({COS}, 12) score from embeddings a, embeddings b where a.vec_id = 0), n as (select id, round(greatest(score, 0), 6) score from (select *, row_number() over (order by greatest(score, 0) desc, id) p from v) where p <= 50), x as (select id, row_number() over (order by score desc, id) a from bm), y as (select id, row_number() over (order by score desc, id) b from n) select coalesce(x.id, y.id) id, round(coalesce(1.0 / (60 + a), 0) + coalesce(1.0 / (60 + b), 0), 8)::double score from x full join y on x.id = y.id"),
    "r07_squash": (r07_squash, f"with {CUR_S} select id, round(importance / (1 + importance) * case when {_test_path('file_path')} then 0.7 else 1 end, 6) score from cur_s where importance is not null"),
    "r10_supplement": (r10_supplement, f"with {CUR_S}, h as (select id, importance score from cur_s where contains(lower(signature), 'batch') and importance is not null order by 2 desc, 1 limit 40), m as (select id, coalesce(importance, 0) score from cur_s where contains(lower(name), 'batch') and id not in (select id from h) order by 2 desc, 1 limit 10) select id, 0 source_rank from (select id, row_number() over (order by score desc, id) p from h) where p <= 40 - (select count(*) from m) union all select id, 1 from m"),
    "r13_sections": (r13_sections, f"with {SECTIONS} select distinct id, round((case when contains(head, 'ledger') then case when head = 'ledger' then 1.0 else 0.7 end else 0.4 end + 0.08 + least((length(body) - length(replace(body, 'ledger', ''))) / 6 * 0.02, 0.10))::double, 6) score from s where contains(head, 'ledger') or contains(body, 'ledger')"),
    "r14_section_points": (r14_section_points, f"with {SECTIONS} select distinct id, case when raw = 'ledger' then 10 when contains(raw, 'ledger') then 5 else 0 end + case when contains(body, 'ledger') then 2 else 0 end + 5 points from s where contains(raw, 'ledger') or contains(body, 'ledger')"),
    "r15_embedding_text": (r15_embedding_text, f"with {CUR_S} select id, {EMBED} digest from cur_s where kind not in ({NOT_EMBEDDED})"),
    "r17_norms": (r17_norms, f"select doc_id, case when len({WORDS}) > 0 then 1.0::double else 0.0 end norm, true fits from documents"),
    "r20_minified": (r20_minified, None),
    "s20_upsert": (s20_upsert, f"""with {CUR_S}, bv as (select s.root_id, max(scan_version) v from symbols s join sv on sv.root_id = s.root_id and s.scan_version < sv.v group by 1),
b as (select id, {EMBED} h from (select s.*, row_number() over (partition by s.id order by case when abs(s.updated_at) >= 100000000000 then s.updated_at else s.updated_at * 1000 end desc) n from symbols s join bv on bv.root_id = s.root_id and bv.v = s.scan_version) where n = 1),
a as (select id, {EMBED} h from cur_s)
select 'embed' what, count(*) n from a where not exists (select 1 from b where b.id = a.id and b.h = a.h) union all select 'delete', count(*) from b where not exists (select 1 from a where b.id = a.id and b.h = a.h) union all select 'keep', count(*) from b where exists (select 1 from a where b.id = a.id and b.h = a.h)"""),
    "link08_imported_names": (link08_imported_names, None),
    "link09_directory_modules": (link09_directory_modules, f"with {CUR_S}, p as (select id, root_id, string_split(file_path, '/') s from cur_s where kind <> 'module' and root_id <> 'external' and file_path <> '') select id source_id, concat_ws(':', root_id, case when len(s) > 1 then array_to_string(s[:-2], '/') else '' end, case when len(s) > 1 then s[-2] else regexp_replace(s[1], '(.)\\.[^.]*$', '\\1') end, 'module') target_id from p"),
    "link10_quoted": (link10_quoted, f"with {CUR_S} select * from (select id, nullif(regexp_extract(body, 'Error\\(\\s*[\"'']([^\"'']*)[\"'']', 1), '') literal from cur_s where kind = 'function') where literal is not null"),
    "link11_quoted_all": (link11_quoted_all, f"with {CUR_S} select literal, count(*) n from (select unnest(regexp_extract_all(body, 'Error\\(\\s*[\"'']([^\"'']*)[\"'']', 1)) literal from cur_s where kind = 'function') group by 1"),
    "link12_routes": (link12_routes, f"with {CUR_S} select route, count(*) n from (select array_to_string(list_transform(string_split(p, '/'), lambda s: case when starts_with(s, ':') or (starts_with(s, '{{') and ends_with(s, '}}')) or (starts_with(s, '[') and ends_with(s, ']')) then '<param>' else s end), '/') route from (select distinct root_id, '/' || file_path p from cur_s)) group by 1"),
    "link13_method_calls": (link13_method_calls, f"with {CUR_S} select site, count(*) functions from (select unnest(list_distinct(regexp_extract_all(body, '\\.([A-Za-z0-9_]{{3,}}) *\\(', 1))) site from cur_s where kind = 'function') group by 1"),
    "link17_subsystems": (link17_subsystems, f"with {CUR_S} select id source_id, concat_ws(':', root_id, 'subsystems', split_part(file_path, '/', 1), 'subsystem') target_id from cur_s"),
    "link18_subsystem_shares": (link18_subsystem_shares, f"with {CUR_S}, f as (select distinct root_id || '/' || split_part(file_path, '/', 1) subsystem, root_id, file_path from cur_s where language is not null), u as (select distinct root_id, file_path, lower(language) framework from cur_s where language is not null), t as (select subsystem, count(*) n from f group by 1), h as (select subsystem, framework, count(*) k from f join u using (root_id, file_path) group by 1, 2) select subsystem, framework, round(k / n, 6) share from h join t using (subsystem) where k / n >= 0.7"),
    "j15_resolved": (j15_resolved, f"with {CUR_S}, f as (select distinct file_path file from cur_s where file_path <> ''), p as (select distinct string_split(file, '/')[-1] path from f) select path, min(file) file from p join f on f.file = p.path or ends_with(f.file, '/' || p.path) group by 1 having count(*) = 1 or bool_or(f.file = p.path)"),
    "s10_tags": (s10_tags, "with t as (select doc_id, regexp_extract_all(regexp_replace(text, '\\[(warn|error|note)\\]', '[outcome: \\1 ]', 'g'), '\\[outcome:([^\\]]*)\\]', 1) x, split_part(text, chr(10), 1) l from documents where text is not null), u as (select doc_id, array_to_string(list_sort(list_filter(list_distinct(list_transform(x, lambda s: trim(s))), lambda s: s <> '')), ',') tags, coalesce(nullif(trim(regexp_extract(l, '^Merge pull request.*? from (.*)$', 1)), ''), nullif(regexp_extract(l, '^Merge branch ''([^'']*)''', 1), '')) branch from t) select * from u where tags <> '' or branch is not null"),
    "s07_chunks": (s07_chunks, None),
    "x_extract": (x_extract, None),
    "x_functions": (x_functions, "with m as (select distinct root, file from nodes where kind = 'module' and body <> ''), t as (select distinct root, file, name from nodes semi join m using (root, file) where kind = 'function') select count(*) functions, count(*) found from t"),
    "g24_outcome_progress": (g24_outcome_progress, f"with {CUR_S}, d as (select distinct doc_id, file_path p, case when starts_with(file_path, 'src/core/') then 'core' end a, case when starts_with(file_path, 'docs/') or ends_with(file_path, '.md') then 'docs' end b from documents where file_path is not null), h as (select a outcome, doc_id, p from d where a is not null union all select b, doc_id, p from d where b is not null), f as (select distinct outcome, p from h) select outcome, count(distinct doc_id) commits, (select count(distinct s.id) from f join cur_s s on s.file_path = f.p where f.outcome = h.outcome and s.kind <> 'import') symbols from h group by 1"),
}
