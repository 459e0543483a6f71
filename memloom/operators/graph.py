"""The graph that use builds: traversal log, compacted edges, decay, activation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import clock


def traversals(log: DataFrame) -> DataFrame:
    """The log without self-loops and open ends."""
    return log.where(F.col("from_id").isNotNull() & F.col("to_id").isNotNull() & (F.col("from_id") != F.col("to_id")))


def compact(log: DataFrame, edges: DataFrame | None = None, continue_series: bool = False) -> DataFrame:
    """(from_id, to_id, link_type, strength, hop_count, last_walked): the log merged into the edges.

    An edge gains the sum of 1/(n+2) over its walks n = 0, 1, ... of this run; with
    ``continue_series`` the count goes on from the edge's hop_count instead.
    """
    key = ["from_id", "to_id", "link_type"]
    new = traversals(log).groupBy(*key).agg(F.count("*").alias("walks"), F.max("created_at").alias("walked"))
    if edges is None:
        return new.select(*key, clock.diminishing(F.lit(0), F.col("walks")).alias("strength"), F.col("walks").alias("hop_count"), F.col("walked").alias("last_walked"))
    old = edges.select(*key, "strength", "hop_count", "last_walked")
    both = old.join(new, key, "full_outer")
    walks, before = F.coalesce("walks", F.lit(0)), F.coalesce("hop_count", F.lit(0))
    gain = clock.diminishing(before if continue_series else F.lit(0), walks)
    return both.select(*key, (F.coalesce("strength", F.lit(0.0)) + gain).alias("strength"), (before + walks).alias("hop_count"), F.greatest("last_walked", "walked").alias("last_walked"))


def decay_and_prune(edges: DataFrame, as_of: Column, decay: float = 0.95, days: int = 7, prune: float = 0.02) -> DataFrame:
    """Edges idle for ``days`` lose a share, then edges below ``prune`` go."""
    idle = clock.older_than(F.col("last_walked"), as_of, days)
    return edges.withColumn("strength", F.when(idle, F.col("strength") * decay).otherwise(F.col("strength"))).where(F.col("strength") >= prune)


def activate(edges: DataFrame, seeds: DataFrame, memories: DataFrame, hops: int = 2, decay: float = 0.5, limit: int = 10, floor: float = 1e-4) -> DataFrame:
    """(group, id, activation): spreading from ``seeds`` (group, node), both ways along the edges.

    Each hop passes frontier x strength x decay^(hop+1); what is below ``floor`` on an
    edge is dropped; sums meet in the nodes.  Seeds may be crossed again and are taken
    out at the end.  The best ``limit`` are cut before archived rows are removed.
    """
    e = edges.groupBy("from_id", "to_id").agg(F.sum("strength").alias("strength")) if "link_type" not in edges.columns else edges.select("from_id", "to_id", "strength")
    both = e.select(F.col("from_id").alias("node"), F.col("to_id").alias("next"), "strength").unionByName(e.select(F.col("to_id").alias("node"), F.col("from_id").alias("next"), "strength"))
    frontier = seeds.select("group", "node").distinct().withColumn("level", F.lit(1.0))
    total = None
    for hop in range(hops):
        passed = frontier.join(both, "node").withColumn("p", F.col("level") * F.col("strength") * F.lit(decay ** (hop + 1))).where(F.col("p") >= floor)
        frontier = passed.groupBy("group", F.col("next").alias("node")).agg(F.sum("p").alias("level"))
        total = frontier if total is None else total.unionByName(frontier)
    summed = total.groupBy("group", "node").agg(F.sum("level").alias("activation")).join(seeds.select("group", "node"), ["group", "node"], "left_anti")
    ranked = summed.withColumn("n", F.row_number().over(Window.partitionBy("group").orderBy(F.desc(F.round("activation", 9)), "node"))).where(F.col("n") <= limit)
    live = memories.where(~F.coalesce("archived", F.lit(False))).select(F.col("id").alias("node"))
    return ranked.join(live, "node", "left_semi").select("group", F.col("node").alias("id"), F.round("activation", 6).alias("activation"))


def supersession_edges(log: DataFrame, memories: DataFrame) -> DataFrame:
    """Edges from a replaced row to its successor that the log does not hold yet."""
    wanted = memories.where(F.col("superseded_by").isNotNull()).select(F.col("id").alias("from_id"), F.col("superseded_by").alias("to_id"))
    have = log.where("link_type = 'supersedes'").select("from_id", "to_id").distinct()
    return wanted.join(have, ["from_id", "to_id"], "left_anti").withColumn("link_type", F.lit("supersedes"))


def directly_linked(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs (a, b) with linked: an edge in either direction."""
    known = edges.select(F.least("from_id", "to_id").alias("lo"), F.greatest("from_id", "to_id").alias("hi")).distinct().withColumn("linked", F.lit(True))
    p = pairs.withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b"))
    return p.join(known, ["lo", "hi"], "left").select("a", "b", F.coalesce("linked", F.lit(False)).alias("linked"))


def without_scope(edges: DataFrame, memories: DataFrame, project: str) -> DataFrame:
    """The edges but those with both ends in the project."""
    own = memories.where(F.col("project") == project).select("id")
    inside = edges.join(own.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(own.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return edges.join(inside.select("from_id", "to_id", "link_type").distinct(), ["from_id", "to_id", "link_type"], "left_anti")


def session_chains(events: DataFrame, spine: int = 2) -> DataFrame:
    """(from_id, to_id, walks): the top rows of a query crossed with those of the next query of its session."""
    top = events.select("session_id", "created_at", "id", F.slice(F.transform("shown", lambda s: s["id"]), 1, spine).alias("top"))
    w = Window.partitionBy("session_id").orderBy("created_at", "id")
    steps = top.withColumn("after", F.lead("top").over(w)).where(F.col("after").isNotNull())
    pairs = steps.select(F.explode("top").alias("from_id"), "after").select("from_id", F.explode("after").alias("to_id")).where("from_id <> to_id")
    return pairs.groupBy("from_id", "to_id").agg(F.count("*").alias("walks"))


def statistics(edges: DataFrame) -> DataFrame:
    return edges.groupBy("link_type").agg(F.count("*").alias("edges"), F.round(F.avg("strength"), 6).alias("mean_strength"), F.round(F.max("strength"), 6).alias("max_strength"))
