"""Search and ranking (R01 to R18): keyword, vector and hybrid retrieval, relevance tiers, reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skein.functions import predicates as P
from skein.session import bounded_join, cut, store

#: BM25's parameters, and the constant of reciprocal rank fusion.
K1, B, RRF = 1.2, 0.75, 60


def relevance_order(query: str, edge_count: str | None = None) -> list[Column]:
    """Exact name; name contains; kind; no test; importance, scored before unscored; then edges and id."""
    q, name = query.lower(), F.lower("name")
    order = [(name == q).desc(), name.contains(q).desc(), P.kind_rank("kind").asc(), P.is_test_path("file").asc(), F.col("importance").desc_nulls_last()]
    if edge_count:
        order.append(F.when(F.col("importance").isNull(), F.col(edge_count)).desc_nulls_last())
    return [*order, F.col("id").asc()]


def words_of(text) -> Column:
    """The lower-case words of a text; letters and digits only."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Term, id, tf, length: the inverted index. Null texts have no terms."""
    words = docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("w")).withColumn("length", F.size("w"))
    return words.select("id", "length", F.explode("w").alias("term")).groupBy("term", "id", "length").agg(F.count("*").alias("tf"))


def bm25(index: DataFrame, lengths: DataFrame, query: str) -> DataFrame:
    """Id, score for the words of a query. ``lengths`` has one row (docs, average) of the corpus."""
    spark = index.sparkSession
    asked = spark.createDataFrame([(w,) for w in sorted(set(query.lower().split()))], "term string")
    hits = index.join(F.broadcast(asked), "term")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    docs, average = lengths.select("docs").scalar(), lengths.select("average").scalar()
    idf = F.log(1 + (docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / average))
    return hits.join(F.broadcast(df), "term").groupBy("id").agg(F.sum(part).alias("score"))


def corpus_lengths(docs: DataFrame, text_col: str) -> DataFrame:
    """docs and average length over the documents that have words."""
    n = F.size(words_of(F.col(text_col)))
    return docs.agg(F.count(F.when(n > 0, 1)).alias("docs"), F.avg(F.when(n > 0, n)).alias("average"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v) -> Column:
    """A vector as doubles of length 1; null for a null, empty or zero vector."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


#: Queries that one pass over all vectors answers: a task holds a table of this many by the rows of a step, about 100 MB.
QUERY_BLOCK, STEP = 10_000, 500


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """Query, id, score (cosine, at least 0), place: the k best of all vectors for each query.

    ``vectors`` has id, embedding; ``queries`` has query, embedding. The stated query
    set meets all vectors in blocks of about ``block`` queries, one pass for each: a task
    multiplies its vectors with the block's matrix and keeps k of each query, so what is
    shuffled is k rows for each query and task. Ties go to the smaller id. Vectors
    that are null, zero or of another length than the queries are left out.
    """
    good = queries.where("query is not null and size(embedding) > 0").select("query", unit(F.col("embedding")).alias("embedding")).where("embedding is not null")
    size, count = good.agg(F.max(F.size("embedding")), F.count("*")).first()
    out_schema = f"query {queries.schema['query'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double"
    if not count:
        return vectors.sparkSession.createDataFrame([], out_schema + ", place int")
    blocks = -(-count // block)
    found = None
    for at in range(blocks):
        asked = good.where((F.size("embedding") == size) & (F.pmod(F.xxhash64("query"), F.lit(blocks)) == at)).toArrow().to_pandas()
        if len(asked):
            part = _best(vectors, asked, k, size, out_schema)
            found = part if found is None else found.unionByName(part)
    w = W.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def _top(scores, ids, k: int):
    """The k best of each row, ties to the smaller id. Only rows with ties at the k-th place are sorted whole."""
    import numpy as np

    if scores.shape[1] > k:
        part = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        chosen, chosen_ids = np.take_along_axis(scores, part, axis=1), np.take_along_axis(ids, part, axis=1)
        tied = np.flatnonzero((scores >= chosen.min(axis=1, keepdims=True)).sum(axis=1) > k)
        if len(tied):
            order = np.lexsort((ids[tied], -scores[tied]), axis=1)[:, :k]
            chosen[tied], chosen_ids[tied] = np.take_along_axis(scores[tied], order, axis=1), np.take_along_axis(ids[tied], order, axis=1)
        return chosen, chosen_ids
    return scores, ids


def _best(vectors: DataFrame, asked: pd.DataFrame, k: int, size: int, out_schema: str) -> DataFrame:
    """The k best of each task's vectors for one block of queries."""
    import numpy as np

    shared = vectors.sparkSession.sparkContext.broadcast((asked["query"].to_numpy(), np.stack(asked["embedding"].to_numpy())))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, matrix = shared.value
        best, best_ids = np.full((len(names), 0), -1.0), None
        for batch in batches:
            for start in range(0, len(batch), STEP):
                part = batch.iloc[start : start + STEP]
                v = np.stack([np.asarray(x, dtype=float) for x in part["embedding"]])
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                s = np.maximum(np.round(matrix @ v.T, 12), 0)
                ids = np.broadcast_to(part["id"].to_numpy(), s.shape)
                both = np.concatenate([best, s], axis=1)
                both_ids = ids if best_ids is None else np.concatenate([best_ids, ids], axis=1)
                best, best_ids = _top(both, both_ids, k)
        if best_ids is not None:
            yield pd.DataFrame({"query": np.repeat(names, best.shape[1]), "id": best_ids.ravel(), "score": best.ravel()})

    good = vectors.where(F.size("embedding") == size).where(dot(F.col("embedding"), F.col("embedding")) > 0).select("id", "embedding")
    return good.mapInPandas(score, out_schema)


def squash(score, file) -> Column:
    """s/(1+s), times 0.7 for test paths."""
    s = score / (1 + score)
    return F.when(P.is_test_path(file), s * 0.7).otherwise(s)


def placed(hits: DataFrame, count: int) -> DataFrame:
    """The ``count`` best of a list (id, score) with their place; ties go to the smaller id. Only these meet in one task."""
    order = [F.desc("score"), F.asc("id")]
    return hits.orderBy(*order).limit(count).withColumn("place", F.row_number().over(W.orderBy(*order)))


def places(hits: DataFrame) -> DataFrame:
    """Every row of a list (id, score) with its place; ties go to the smaller id.

    The list is sorted into ranges and written down with each row's range and number in it;
    a place is that number behind the rows of the ranges before, of which there is one count each.
    """
    at = F.monotonically_increasing_id()
    sorted_ = hits.orderBy(F.desc("score"), F.asc("id")).withColumn("_at", at)
    rows = cut(sorted_.withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1)), "places")
    counts = rows.groupBy("_range").agg(F.count("*").alias("n"))
    before = counts.select("_range", (F.sum("n").over(W.orderBy("_range")) - F.col("n")).alias("_before"))
    return rows.join(F.broadcast(before), "_range").withColumn("place", F.col("_before") + F.col("_at") + 1).drop("_at", "_range", "_before")


def fuse(left: DataFrame, right: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of two whole lists (id, score): id, score."""
    both = places(left).select("id", F.col("place").alias("a")).join(places(right).select("id", F.col("place").alias("b")), "id", "full")
    part = lambda c: F.coalesce(1.0 / (RRF + F.col(c)), F.lit(0.0))
    return both.select("id", (part("a") + part("b")).alias("score"))


def supplement(hits: DataFrame, names: DataFrame, limit: int) -> DataFrame:
    """Name matches that retrieval missed take up to min(limit, 10) of the last places."""
    more = placed(names.join(hits.select("id"), "id", "left_anti"), min(limit, 10))
    kept = placed(hits, limit).where(F.col("place") <= F.greatest(limit - more.agg(F.count("*")).scalar(), F.lit(0)))
    return kept.select("id", "score", F.lit(0).alias("source_rank")).unionByName(more.select("id", "score", F.lit(1).alias("source_rank")))


def rerank(hits: DataFrame, query: str, scorer: Callable[[str, str], float] | None = None) -> DataFrame:
    """Adds rerank, a score of (query, text) by a pluggable scorer; the default counts shared words."""

    def overlap(q: str, text: str) -> float:
        asked, have = set(q.lower().split()), set((text or "").lower().split())
        return len(asked & have) / max(len(asked), 1)

    fn = scorer or overlap

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return text.map(lambda t: fn(query, t))

    return hits.withColumn("rerank", score(F.col("text")))


def section_score(query: str, heading, level, content, spans=None) -> Column:
    """Where a section matches, its level, code spans and density; null without a match."""
    q = query.lower()
    head, body = F.lower(F.trim(F.regexp_replace(heading, r"^#+", ""))), F.lower(F.coalesce(content, F.lit("")))
    in_head, in_body = F.coalesce(head.contains(q), F.lit(False)), body.contains(q)
    place = F.when(in_head, F.when(head == q, 1.0).otherwise(0.7)).otherwise(0.4)
    depth = F.when(level == 0, 0.02).when(level == 1, 0.10).when(level == 2, 0.08).when(level == 3, 0.06).otherwise(0.04)
    count = (F.length(body) - F.length(F.replace(body, F.lit(q), F.lit("")))) / len(q)
    density = F.least(count * 0.02, F.lit(0.10))
    span = F.lit(0.0) if spans is None else F.when(F.exists(spans, lambda s: F.lower(s).contains(q)), 0.15).otherwise(0.0)
    return F.when(in_head | in_body, place + depth + span + density)


def section_points(query: str, heading, level, content, frontmatter=None, ancestors=None) -> Column:
    """Whole points: 10 or 5 for the heading, else 4 for an ancestor, 3 front matter, 2 body, and 7 - level."""
    q = query.lower()
    head, body = F.lower(heading), F.lower(F.coalesce(content, F.lit("")))
    front = F.lit(False) if frontmatter is None else frontmatter
    points = F.when(head == q, 10).when(head.contains(q), 5).otherwise(0)
    if ancestors is not None:
        points = F.when(points == 0, F.when(F.exists(ancestors, lambda h: F.lower(h).contains(q)), 4).otherwise(0)).otherwise(points)
    points = points + F.when(front & body.contains(q), 3).otherwise(0) + F.when(body.contains(q), 2).otherwise(0)
    return F.when(points > 0, points + F.when(front, 0).otherwise(F.greatest(7 - level, F.lit(0))))


def embedding_text(name, doc, body, budget: int = 650) -> Column:
    """Name, documentation and body within a budget of characters."""
    return F.substring(F.concat_ws("\n", name, doc, body), 1, budget)


def full_text(name, doc, body, types, metadata, budget: int = 650) -> Column:
    """Name, documentation, body, inferred types and metadata (a map) of a symbol in ``budget`` characters.

    Behind the name at least half of the budget is kept from the metadata, of which whole entries are taken in the order
    of their keys. Of the rest types get up to a sixth, documentation half of what then remains, the body the rest.
    """
    name, doc, body, types = (F.coalesce(x, F.lit("")) for x in (name, doc, body, types))
    after = F.greatest(F.lit(budget - 1) - F.length(name), F.lit(0))
    entries = F.transform(F.array_sort(F.map_entries(F.coalesce(metadata, F.create_map().cast("map<string,string>")))), lambda e: F.concat(F.lit(" "), e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))
    room = F.greatest(after - budget // 2, F.lit(0))

    def take(acc, e):
        fits = acc["open"] & (acc["used"] + F.length(e) <= room)
        return F.struct((acc["used"] + F.when(fits, F.length(e)).otherwise(0)).alias("used"), F.when(fits, F.concat(acc["text"], e)).otherwise(acc["text"]).alias("text"), fits.alias("open"))

    meta = F.aggregate(entries, F.struct(F.lit(0).alias("used"), F.lit("").alias("text"), F.lit(True).alias("open")), take)
    left = F.greatest(after - meta["used"], F.lit(0))
    of_types = F.least((left / 6).cast("int"), F.length(types))
    rest = left - of_types
    of_doc = F.least((rest / 2).cast("int"), F.length(doc))
    of_body = F.when(doc == "", rest).otherwise(F.greatest(rest - of_doc - 1, F.lit(0)))
    part = lambda text, size: F.when((text != "") & (size > 0), F.concat(F.lit(" "), F.substr(text, F.lit(1), size))).otherwise("")
    return F.substring(F.concat(name, part(doc, of_doc), part(body, of_body), part(types, of_types), meta["text"]), 1, budget)


def index_rows(nodes: DataFrame, artifacts: DataFrame | None = None, commits: DataFrame | None = None, merges: DataFrame | None = None, newest_commits: int = 100, newest_merges: int = 50) -> DataFrame:
    """Id, kind, title, text of all that search finds: code (kind code:x), artifacts, and the newest commits and merges.

    nodes: id, kind, name, language, body, doc_comment; artifacts: id, kind, title, frontmatter map, body; commits: hash, message, timestamp;
    merges: hash, title, branch, timestamp. An artifact's text is its id, its fields in the order of their keys and its body, in 500 characters.
    """
    empty = F.create_map().cast("map<string,string>")
    out = nodes.where(P.embeddable("kind")).select("id", F.concat(F.lit("code:"), "kind").alias("kind"), F.concat(F.concat_ws(" ", "kind", "name"), F.lit(" ("), F.coalesce("language", F.lit("")), F.lit(")")).alias("title"), full_text(F.col("name"), F.col("doc_comment"), F.col("body"), F.lit(None).cast("string"), empty).alias("text"))
    if artifacts is not None:
        pairs = F.transform(F.array_sort(F.map_entries(F.coalesce("frontmatter", empty))), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))
        text = F.substring(F.concat_ws(" ", F.col("id"), F.nullif(F.array_join(pairs, " "), F.lit("")), F.col("body")), 1, 500)
        out = out.unionByName(artifacts.select("id", "kind", "title", text.alias("text")))
    for rows, kind, title, body, count in ((commits, "commit", F.split_part("message", F.lit("\n"), F.lit(1)), F.col("message"), newest_commits), (merges, "merge", F.col("title"), F.concat_ws(" ", "title", "branch"), newest_merges)):
        if rows is not None:
            top = rows.orderBy(F.desc("timestamp"), "hash").limit(count)
            out = out.unionByName(top.select(F.concat(F.lit(f"{kind}:"), "hash").alias("id"), F.lit(kind).alias("kind"), title.alias("title"), F.substring(body, 1, 500).alias("text")))
    return out


def hashed_vectors(docs: DataFrame, id_col: str, text_col: str, size: int = 64) -> DataFrame:
    """Id, embedding: a deterministic stand-in for a model: word counts hashed into ``size`` places, of length 1.

    Texts without words, and null texts, have the zero vector. Ids must be distinct.
    """
    place = F.pmod(F.xxhash64("term"), F.lit(size)).cast("int")
    counts = postings(docs, id_col, text_col).groupBy("id", place.alias("place")).agg(F.sum("tf").alias("n"))
    per = counts.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("place", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    all_ids = docs.select(F.col(id_col).alias("id")).join(per, "id", "left")
    value = lambda k: F.coalesce(F.try_element_at(F.col("m"), k) / F.col("norm"), F.lit(0.0)).cast("float")
    return all_ids.select("id", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), value).alias("embedding"))


def upsert_embeddings(stored: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows to embed anew, ids to delete, rows to keep) from id and text_hash of both sides."""
    new = current.join(stored.select("id", "text_hash"), ["id", "text_hash"], "left_anti")
    stale = stored.join(current.select("id", "text_hash"), ["id", "text_hash"], "left_anti").select("id")
    kept = stored.join(current.select("id", "text_hash"), ["id", "text_hash"], "left_semi")
    return new, stale, kept


def resolve_hits(hits: DataFrame, nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """The hits (the ``limit`` best, if given) with their nodes, their order kept by the column place."""
    return bounded_join(nodes, store(places(hits) if limit is None else placed(hits, limit), "hits"), ["id"])
