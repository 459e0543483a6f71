"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm import bpe, canon, clusters, leak, neardup, pii, spam, vectors
from memloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.closed_pairs(table(spark, sf_dir, "memories").select("id", "embedding", "embedding_model"))


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clusters(table(spark, sf_dir, "memories").select("id", "subject", "embedding", "embedding_model"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon.canonical_rows(*[table(spark, sf_dir, t) for t in ("open_loops", "projects", "project_aliases")])


def p2_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report of the values without a match and how many rows hold them."""
    loops = table(spark, sf_dir, "open_loops")
    refs = canon.references(table(spark, sf_dir, "projects"), table(spark, sf_dir, "project_aliases"), "slug", "alias", "canonical")
    lost = canon.match(loops, refs, "project").where(F.col("canonical") == canon.UNMATCHED).select("value")
    return loops.select(F.col("project").alias("value")).join(lost, "value").groupBy("value").agg(F.count("*").alias("n"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found_kinds(table(spark, sf_dir, "memories")).select(F.col("id").alias("memory_id"), "field", "kind")


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact(table(spark, sf_dir, "memories")).withColumnRenamed("id", "memory_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_pairs(table(spark, sf_dir, "memories").select("id", "subject", "body"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups_of_similar(table(spark, sf_dir, "memories").select("id", "subject", "body"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest_pairs(vectors.nearest(table(spark, sf_dir, "memories").select("id", "embedding", "embedding_model")))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), bpe.vocabulary())


def p6_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of documents, and of those whose ids decode to the stored text."""
    ranks = bpe.vocabulary()
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = bpe.encode(docs, ranks).select("doc_id", bpe.decode(F.col("ids"), ranks).alias("back"))
    return docs.join(back, "doc_id").agg(F.count("*").alias("documents"), F.count_if(F.col("text") == F.col("back")).alias("equal"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "bench_items")).select("doc_id", "item_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.spam_texts(table(spark, sf_dir, "documents")).select("doc_id")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_clusters, p2_found, p2_unmatched, p3_found, p3_redacted, p4_found, p4_groups, p5_found, p6_ids, p6_roundtrip, p7_found, p8_found)}
