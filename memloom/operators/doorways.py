"""Doorways: content-addressed sets of rows that a query resolved to, with their centroid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import keys, text
from memloom.functions.vector import centroid
from memloom.operators.lifecycle import latest


def recorded(doorways: DataFrame | None, resolved: DataFrame, memories: DataFrame, as_of: Column, least: int = 2, min_gap: float = 0.18) -> DataFrame:
    """Doorways after a batch of resolutions (query_id, member_ids, cut_gap).

    Sets of fewer than ``least`` rows or below ``min_gap`` are passed over.  A known key
    gains its resolutions and is fresh again; a new one gets the centroid of its members.
    """
    good = resolved.where((F.size("member_ids") >= least) & (F.col("cut_gap") >= min_gap)).withColumn("key", keys.set_key(F.col("member_ids")))
    new = good.groupBy("key").agg(F.first(F.array_sort(F.array_distinct("member_ids"))).alias("member_ids"), F.max("cut_gap").alias("cut_gap"), F.count("*").alias("query_count"))
    space = F.concat_ws("|", F.coalesce("embedding_model", F.lit("")), F.size("embedding").cast("string"))
    parts = new.select("key", F.explode("member_ids").alias("id")).join(memories.where(F.col("embedding").isNotNull()).select("id", "embedding", space.alias("space")), "id")
    # Vectors of different models have no common mean: the space of most members counts, ties to the smaller name.
    main = latest(parts.groupBy("key", "space").agg(F.count("*").alias("n")), ["key"], [F.desc("n"), "space"]).select("key", "space")
    new = new.join(centroid(parts.join(main, ["key", "space"]), ["key"]).select("key", "centroid"), "key", "left").select("key", "member_ids", "centroid", "cut_gap", "query_count")
    new = new.withColumns({"name": F.lit(None).cast("string"), "stale": F.lit(False), "formed_at": as_of})
    if doorways is None:
        return new
    more = new.select("key", F.col("query_count").alias("n"))
    kept = doorways.join(more, "key", "left").withColumns({"query_count": F.col("query_count") + F.coalesce("n", F.lit(0)), "stale": F.when(F.col("n").isNotNull(), F.lit(False)).otherwise(F.col("stale"))}).drop("n")
    return kept.unionByName(new.join(doorways.select("key"), "key", "left_anti").select(*kept.columns))


def aged(doorways: DataFrame, memories: DataFrame) -> DataFrame:
    """A doorway is stale once an active row is newer than it."""
    newest = memories.where(~F.coalesce("archived", F.lit(False))).agg(F.max("created_at").alias("newest"))
    return doorways.join(F.broadcast(newest)).withColumn("stale", F.col("stale") | F.coalesce(F.col("newest") > F.col("formed_at"), F.lit(False))).drop("newest")


def by_name(doorways: DataFrame, name: str) -> DataFrame:
    """The fresh doorway of a name with the most resolutions."""
    return doorways.where((F.col("name") == name) & ~F.col("stale")).orderBy(F.desc("query_count"), "key").limit(1)


def named(doorways: DataFrame, memories: DataFrame, budget: int, least: int = 3, given: DataFrame | None = None) -> DataFrame:
    """Up to ``budget`` unnamed doorways of ``least`` resolutions get a name, those resolved most often first.

    ``given`` (key, name) are names from a provider; without one the subject of the
    first member makes the name.
    """
    first = doorways.select("key", F.get("member_ids", F.lit(0)).alias("id")).join(memories.select("id", "subject"), "id", "left").select("key", text.cluster_name(F.coalesce("subject", F.lit("unnamed"))).alias("fallback"))
    turn = doorways.where(F.col("name").isNull() & (F.col("query_count") >= least)).orderBy(F.desc("query_count"), "key").limit(budget).select("key", F.lit(True).alias("turn"))
    d = doorways.join(turn, "key", "left").join(first, "key", "left")
    if given is not None:
        d = d.join(given.select("key", text.clean_name(F.col("name")).alias("asked")), "key", "left")
    else:
        d = d.withColumn("asked", F.lit(None).cast("string"))
    return d.withColumn("name", F.when(F.col("turn"), F.coalesce(F.nullif("asked", F.lit("")), "fallback")).otherwise(F.col("name"))).drop("turn", "fallback", "asked")


def of_periods(doorways: DataFrame, due: DataFrame, memories: DataFrame, as_of: Column) -> DataFrame:
    """The doorways with one for each hour (hour, members), named by the hour, so that the hour itself finds its rows."""
    new = recorded(None, due.select(F.col("members").alias("member_ids"), F.lit(1.0).alias("cut_gap")), memories, as_of, least=1)
    hours = due.select(keys.set_key(F.array_sort(F.array_distinct("members"))).alias("key"), "hour")
    new = new.join(hours, "key").withColumn("name", F.col("hour")).drop("hour")
    return doorways.unionByName(new.join(doorways.select("key"), "key", "left_anti").select(*doorways.columns))


def promoted(doorways: DataFrame, topics: DataFrame, memories: DataFrame, least: int = 3, limit: int = 10) -> tuple[DataFrame, DataFrame]:
    """New topics (slug, name, project, centroid) and their members (slug, id), from named doorways that are no topic yet."""
    ripe = doorways.where(F.col("name").isNotNull() & (F.col("query_count") >= least)).withColumn("slug", text.topic_slug(F.col("name")))
    ripe = latest(ripe.join(topics.select("slug"), "slug", "left_anti"), ["slug"], [F.desc("query_count"), "key"]).orderBy(F.desc("query_count"), "slug").limit(limit)
    live = memories.where(~F.coalesce("archived", F.lit(False))).select("id", "project")
    members = ripe.select("slug", F.explode("member_ids").alias("id")).join(live, "id")
    main = dominant(members, "slug", "project")
    return ripe.join(main, "slug", "left").select("slug", "name", "project", "centroid"), members.select("slug", "id").distinct()


def dominant(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, value): the most frequent value of each group, ties to the smaller one; nulls do not count."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), value))
    return counts.withColumn("p", place).where("p = 1").select(by, value)
