"""Seeds: a versioned snapshot of what is known about an entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import keys, text
from memloom.operators import graph, lifecycle


def gaps(rows: DataFrame, by: str) -> DataFrame:
    """(by, missing): categories that no row of the group touches."""
    touched = rows.select(by, F.explode_outer(text.categories(F.concat_ws(" ", F.coalesce("subject", F.lit("")), F.coalesce("body", F.lit(""))))).alias("c")).groupBy(by).agg(F.collect_set("c").alias("have"))
    return touched.select(by, F.array_except(F.array(*[F.lit(c) for c in text.CATEGORIES]), "have").alias("missing"))


def compiled(memories: DataFrame, edges: DataFrame, seeds: DataFrame | None, entities: DataFrame, as_of: Column, limit: int = 50, hops: int = 2, activation_limit: int = 10, strongest: bool = False) -> DataFrame:
    """(entity, version, payload, content_checksum) for many ``entities`` (entity) at once.

    Up to ``limit`` live rows an entity, the lowest ids first (or the strongest), plus what
    the graph activates from them, tagged; gaps, a weight summary, and the next version.
    """
    live = memories.where(~F.coalesce("archived", F.lit(False)))
    own = live.join(entities.select(F.col("entity").alias("person")), "person", "left_semi").select(F.col("person").alias("entity"), "id", "subject", "body", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    order = Window.partitionBy("entity").orderBy(*([F.desc("weight"), "id"] if strongest else ["id"]))
    own = own.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).drop("n")
    near = graph.activate(edges, own.select(F.col("entity").alias("group"), F.col("id").alias("node")), memories, hops, limit=activation_limit)
    more = near.join(live.select("id", "subject"), "id").select(F.col("group").alias("entity"), "id", "subject", "activation")
    base = own.groupBy("entity").agg(
        F.array_sort(F.collect_list(F.struct("id", "subject"))).alias("rows"), F.round(F.sum("weight"), 6).alias("total"), F.round(F.avg("weight"), 6).alias("mean"), F.round(F.max("weight"), 6).alias("top")
    )
    assoc = more.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("id", "subject"))).alias("activated"))
    out = base.join(assoc, "entity", "left").join(gaps(own, "entity"), "entity", "left")
    payload = F.struct("rows", F.coalesce("activated", F.array().cast("array<struct<id:bigint,subject:string>>")).alias("activated"), F.col("missing").alias("gaps"), F.struct("total", "mean", "top").alias("weights"))
    out = out.select("entity", payload.alias("payload"))
    if seeds is None:
        out = out.withColumn("version", F.lit(1).cast("long"))
    else:
        out = out.join(seeds.groupBy("entity").agg(F.max("version").alias("v")), "entity", "left").withColumn("version", F.coalesce("v", F.lit(0)).cast("long") + 1).drop("v")
    return out.select("entity", "version", "payload", keys.checksum(F.col("payload")).alias("content_checksum"), as_of.alias("compiled_at"))


def newest(seeds: DataFrame) -> DataFrame:
    return lifecycle.latest(seeds, ["entity"], [F.desc("version")])
