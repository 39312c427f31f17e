"""The queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm import docpairs, origin, packing, pieces, subjects, tokens
from skein.session import store, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """root, file, name, line_start: functions with documentation that isn't trivial."""
    return docpairs.found(table(spark, sf_dir, "nodes"))


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code-description pairs with what the symbols table holds about them."""
    return docpairs.code_description_pairs(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "symbols"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """root, file: source files that are generated, minified, third-party or data."""
    return origin.found(table(spark, sf_dir, "nodes"))


def p3_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """origin, reason, files: what speaks for each class."""
    return origin.origins(table(spark, sf_dir, "nodes")).groupBy("origin", "reason").count().withColumnRenamed("count", "files")


def p3_hand_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """root, file: what remains."""
    return origin.hand_written(table(spark, sf_dir, "nodes"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id: the nodes whose body is over 6,000 characters, each split."""
    return pieces.found(table(spark, sf_dir, "nodes"))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, piece, start, end, text of every oversized body."""
    return pieces.split_oversized(table(spark, sf_dir, "nodes"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids: every document encoded by byte_bpe_50k."""
    return tokens.encode(table(spark, sf_dir, "documents"))


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, same: whether the decoded ids give the text again (null and empty texts have no ids)."""
    docs = table(spark, sf_dir, "documents")
    back = tokens.decode(tokens.encode(docs)).withColumnRenamed("text", "again")
    return docs.join(back, "doc_id").select("doc_id", (F.col("again") == F.coalesce("text", F.lit(""))).alias("same"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, part, length, container, start: every document in containers of 2,048 tokens."""
    return packing.pack_texts(table(spark, sf_dir, "documents"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """containers, tokens, unused."""
    return packing.fill(p8_containers(spark, sf_dir))


#: Capacities of which each takes part: containers of 2,048 tokens, 24 documents and an attention cost of a third of a full one.
BOUND = {"tokens": 2048, "documents": 24, "cost": 1_400_000, "weights": (1.0, 0.5, 0.5)}


def p8_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rule, containers, least, used shares: both rules where tokens, documents and cost all bind."""
    out = None
    sizes = store(tokens.lengths(table(spark, sf_dir, "documents")), "sizes").df
    for rule in ("norm", "dot"):
        limits = packing.Limits(rule=rule, **BOUND)
        part = packing.used(packing.pack(sizes, "doc_id", limits), limits).select(F.lit(rule).alias("rule"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def p8_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, whole, fits: whether a document's parts make it up in order, and its containers are within every limit of ``BOUND``."""
    sizes = store(tokens.lengths(table(spark, sf_dir, "documents")), "sizes").df
    limits = packing.Limits(**BOUND)
    packed = store(packing.pack(sizes, "doc_id", limits), "packed").df
    per = packed.groupBy("container").agg(F.sum("length").alias("t"), F.count("*").alias("d"), F.sum(F.col("length").cast("bigint") * F.col("length")).alias("c"))
    fits = per.select("container", ((F.col("t") <= limits.tokens) & (F.col("d") <= limits.documents) & (F.col("c") <= limits.cost)).alias("fits"))
    parts = packed.join(fits, "container").groupBy("doc_id").agg(F.sum("length").alias("sum"), F.max("part").alias("last"), F.count("*").alias("parts"), F.bool_and("fits").alias("fits"))
    return sizes.join(parts, "doc_id", "left").select("doc_id", F.coalesce((F.col("sum") == F.col("tokens")) & (F.col("last") + 1 == F.col("parts")), F.lit(False)).alias("whole"), F.coalesce("fits", F.lit(False)).alias("fits"))


def p4_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, digest, least_shared, most_shared, fits: each oversized text's pieces put together again, with what consecutive pieces share and whether all are within the limit."""
    cut = pieces.split_oversized(table(spark, sf_dir, "nodes").groupBy("id").agg(F.max("body").alias("body")))
    own = F.when(F.col("piece") == 0, F.col("text")).otherwise(F.substr("text", F.lit(pieces.OVERLAP + 1)))
    w = Window.partitionBy("id").orderBy("piece")
    parts = cut.select("id", "piece", own.alias("own"), (F.lag("end").over(w) - F.col("start")).alias("shared"), F.length("text").alias("size"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "own"))), lambda p: p["own"]), "")
    return parts.groupBy("id").agg(F.md5(whole).alias("digest"), F.min("shared").alias("least_shared"), F.max("shared").alias("most_shared"), (F.max("size") <= pieces.LIMIT).alias("fits"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, subject: what each document is about."""
    return subjects.found(*(table(spark, sf_dir, t) for t in ("documents", "subject_examples", "subject_areas")))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, documents: the corpus composition."""
    return p9_found(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("documents"))


QUERIES: dict[str, tuple] = {
    "p1_found": (p1_found, None),
    "p1_pairs": (p1_pairs, None),
    "p3_found": (p3_found, None),
    "p3_origins": (p3_origins, None),
    "p3_hand_written": (p3_hand_written, None),
    "p4_found": (p4_found, "select distinct id from nodes where length(body) > 6000"),
    "p4_pieces": (p4_pieces, None),
    "p4_checked": (p4_checked, "select id, md5(max(body)) digest, 200::bigint least_shared, 200::bigint most_shared, true fits from nodes group by id having length(max(body)) > 6000"),
    "p7_ids": (p7_ids, None),
    "p8_containers": (p8_containers, None),
    "p8_fill": (p8_fill, None),
    "p8_vector": (p8_vector, None),
    "p8_checked": (p8_checked, "select doc_id, true whole, true fits from documents"),
    "p9_found": (p9_found, None),
    "p9_mix": (p9_mix, None),
    "p7_round_trip": (p7_round_trip, "select doc_id, true as same from documents"),
}
