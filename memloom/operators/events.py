"""Recall events: what was shown, and what was used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import clock
from memloom.operators import lifecycle


def once(events: DataFrame) -> DataFrame:
    """Redelivered rows once: of each id the one that was attributed, else any (they are equal)."""
    return lifecycle.latest(events, ["id"], [F.desc_nulls_last("attributed_at"), "created_at"])


def recorded(hits: DataFrame, queries: DataFrame, as_of: Column) -> DataFrame:
    """(query_id, query, shown, used): the shown rows with rank and score; sparks leave a gap in the ranks; nothing is judged yet."""
    solid = hits.where(~F.col("serendipity")).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("rank"), "id", "score"))), lambda x: F.struct(x["id"].alias("id"), x["rank"].cast("int").alias("rank"), x["score"].alias("score"))).alias("shown"))
    return queries.select("query_id", "query").join(solid, "query_id").select("query_id", "query", "shown", F.lit(None).cast("array<long>").alias("used"), as_of.alias("created_at"))


def attributed(events: DataFrame, marks: DataFrame, as_of: Column) -> DataFrame:
    """Events after ``marks`` (id, used, how): distinct sorted ids; an empty list says nothing helped."""
    m = marks.select("id", F.array_sort(F.array_distinct("used")).alias("_used"), F.col("how").alias("_how"))
    hit = F.col("_used").isNotNull()
    out = events.join(m, "id", "left")
    return out.withColumns({"used": F.when(hit, F.col("_used")).otherwise(F.col("used")), "attributed_at": F.when(hit, as_of).otherwise(F.col("attributed_at")), "attribution": F.when(hit, F.col("_how")).otherwise(F.col("attribution"))}).drop("_used", "_how")


def judgement(used: Column) -> Column:
    return F.when(used.isNull(), "unjudged").when(F.size(used) == 0, "nothing used").otherwise("used")


def waiting(events: DataFrame, as_of: Column, limit: int = 50, session_id: str | None = None, older_than_seconds: int = 0) -> DataFrame:
    """Events without a judgement, of an age, the oldest first."""
    rows = once(events).where(F.col("used").isNull() & clock.older_than(F.col("created_at"), as_of, older_than_seconds / 86400))
    if session_id is not None:
        rows = rows.where(F.col("session_id") == session_id)
    return rows.orderBy("created_at", "id").limit(limit)


def funnel(events: DataFrame) -> DataFrame:
    """One row: events, those judged, those where nothing helped, rows used in all, and whether 200 judgements are there."""
    return once(events).agg(
        F.count("*").alias("total"), F.count("used").alias("judged"), F.count_if(F.size("used") == 0).alias("nothing_used"),
        F.coalesce(F.sum(F.when(F.size("used") > 0, F.size("used"))), F.lit(0)).alias("used_rows"), (F.count("used") >= 200).alias("ready"),
    )


def shown_ranks(events: DataFrame) -> DataFrame:
    """(event_id, memory_id, rank, was_used): one row for each shown row of judged events."""
    flat = once(events).where(F.col("used").isNotNull()).select(F.col("id").alias("event_id"), "used", F.explode("shown").alias("s"))
    return flat.select("event_id", F.col("s.id").alias("memory_id"), F.col("s.rank").alias("rank"), F.array_contains("used", F.col("s.id")).alias("was_used"))


def repeated_in_session(events: DataFrame) -> DataFrame:
    """(session_id, shown, repeated): rows shown in a session, and those of them that were shown before in it."""
    flat = once(events).select("session_id", "created_at", F.col("id").alias("event_id"), F.explode("shown").alias("s"))
    seen = F.row_number().over(Window.partitionBy("session_id", "s.id").orderBy("created_at", "event_id"))
    return flat.withColumn("seen", seen).groupBy("session_id").agg(F.count("*").alias("shown"), F.count_if(F.col("seen") > 1).alias("repeated"))
