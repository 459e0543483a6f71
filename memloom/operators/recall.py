"""Recall from end to end: pool, lenses, score, level pick, cut, and the deltas a caller may write back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import clock
from memloom.operators import graph, rank, search, select


@dataclass
class Recalled:
    """hits, and as separate frames what a recall leaves behind; a read-only caller ignores those."""

    hits: DataFrame
    edges: DataFrame
    weights: DataFrame
    events: DataFrame
    doorways: DataFrame


def recall(memories: DataFrame, queries: DataFrame, as_of: Column, limit: int = 5, policy: rank.Policy = rank.Policy(), lenses: DataFrame | None = None, lens_types: list[str] | None = None, creativity: float = 0.0, collapse: bool = False, seed: int = 0, **filters: object) -> DataFrame:
    """(query_id, id, pos, cosine, score, status, serendipity, gap) for many queries in one plan.

    ``queries`` has query_id, embedding and embedding_model.
    """
    pool = search.narrowed(search.active(memories, as_of), **filters)
    size = select.pool_size(limit, creativity > 0 or collapse)
    found = search.top_k(pool, queries, size).select("query_id", "id", "cosine")
    if lenses is not None:
        found = search.merged_pool(found, search.lens_top_k(lenses, pool, queries, size, lens_types))
    ranked = rank.placed(rank.scored(found, memories, as_of, policy))
    ranked = select.level_pick(ranked, memories)
    if collapse:
        out = select.collapse(ranked, limit).withColumn("serendipity", F.lit(False))
    else:
        out = select.serendipity(ranked, limit, creativity, seed).withColumn("gap", F.lit(None).cast("double"))
    return out.select("query_id", "id", "pos", "cosine", "score", "status", "serendipity", "gap")


def deltas(hits: DataFrame, memories: DataFrame) -> Recalled:
    """Edges of consecutive hits, weight gained by exposure, shown events, and doorway candidates; sparks leave no trace."""
    solid = hits.where(~F.col("serendipity"))
    seq = Window.partitionBy("query_id").orderBy("pos")
    edges = solid.withColumn("to_id", F.lead("id").over(seq)).where(F.col("to_id").isNotNull() & (F.col("to_id") != F.col("id")))
    edges = edges.select(F.col("id").alias("from_id"), "to_id", F.lit("temporal_sequence").alias("link_type"))
    seen = solid.groupBy("id").agg(F.count("*").alias("times"))
    gained = seen.join(memories.select("id", "access_count"), "id").select("id", "times", clock.diminishing(F.coalesce("access_count", F.lit(0)), F.col("times")).alias("gain"))
    events = solid.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("rank"), "id", "score"))).alias("shown"))
    groups = solid.where(F.col("gap").isNotNull()).groupBy("query_id").agg(F.sort_array(F.collect_list("id")).alias("member_ids"), F.max("gap").alias("cut_gap")).where(F.size("member_ids") > 1)
    return Recalled(hits, edges, gained, events, groups)


def with_associations(hits: DataFrame, edges: DataFrame, memories: DataFrame, hops: int = 2, decay: float = 0.5, limit: int = 10) -> DataFrame:
    """(query_id, id, activation): what the graph adds to the hits, spread from each query's top hit only."""
    seeds = hits.where("pos = 1").select(F.col("query_id").alias("group"), F.col("id").alias("node"))
    spread = graph.activate(edges, seeds, memories, hops, decay, limit)
    return spread.select(F.col("group").alias("query_id"), "id", "activation").join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti")


def by_node_types(memories: DataFrame, queries: DataFrame, node_types: list[str], as_of: Column, top_k: int = 12, **filters: object) -> DataFrame:
    """One recall for each node type; the first sight of a row counts, then the best ``top_k`` by score."""
    parts = [recall(memories, queries, as_of, limit=top_k, node_type=t, **filters).withColumn("turn", F.lit(i)) for i, t in enumerate(node_types)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    first = both.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("turn", "pos"))).where("n = 1").drop("n")
    return rank.placed(first.drop("pos"), limit=top_k).drop("turn")
