"""Open loops: what was concluded and perhaps not done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import clock, text

OPEN = "open"


def state(loops: DataFrame) -> DataFrame:
    """Loops with a status in lower case; null counts as open."""
    return loops.withColumn("status", F.lower(F.trim(F.coalesce("status", F.lit(OPEN)))))


def candidates(memories: DataFrame, loops: DataFrame, as_of: Column, tiers: tuple[str, ...] = ("curated", "insight", "decision", "project"), since_days: int = 45, budget: int = 40, over_fetch: int = 12, project: str | None = None) -> DataFrame:
    """(id, subject, body): the newest rows never judged that hold a marker, up to ``budget`` of the newest budget x over_fetch."""
    rows = memories.where(F.col("tier").isin(*tiers) & ~F.coalesce("archived", F.lit(False)) & ~clock.older_than(F.col("created_at"), as_of, since_days) & (F.col("created_at") <= as_of))
    if project is not None:
        rows = rows.where(F.col("project") == project)
    rows = rows.join(loops.select(F.col("memory_id").alias("id")), "id", "left_anti")
    newest = rows.select("id", "subject", "body", "created_at").orderBy(F.desc("created_at"), F.desc("id")).limit(budget * over_fetch)
    return newest.where(text.has_marker(F.concat_ws(" ", "subject", "body"))).orderBy(F.desc("created_at"), F.desc("id")).limit(budget).select("id", "subject", "body")


def judged(loops: DataFrame, verdicts: DataFrame, as_of: Column) -> DataFrame:
    """Loops with every verdict (memory_id, action, project, actionable) recorded, also those without an action."""
    new = verdicts.join(loops.select("memory_id"), "memory_id", "left_anti").select(
        "memory_id", "action", "project", F.when(F.col("actionable"), OPEN).otherwise("not_actionable").alias("status"), as_of.alias("detected_at"),
        F.lit(None).cast("timestamp").alias("closed_at"), F.lit(None).cast("long").alias("closed_by"), F.lit(None).cast("string").alias("close_reason"),
    )
    return loops.unionByName(new)


def _closed(loops: DataFrame, hit: Column, as_of: Column, status: str, reason: Column, by: Column | None = None) -> DataFrame:
    """Only what is open changes."""
    now = hit & (F.col("status") == OPEN)
    cols = {"closed_at": F.when(now, as_of).otherwise(F.col("closed_at")), "close_reason": F.when(now, reason).otherwise(F.col("close_reason")), "closed_by": F.when(now, by if by is not None else F.lit(None).cast("long")).otherwise(F.col("closed_by"))}
    return loops.withColumns(cols).withColumn("status", F.when(now, status).otherwise(F.col("status")))


def aged_out(loops: DataFrame, as_of: Column, days: int = 45) -> DataFrame:
    return _closed(state(loops), clock.older_than(F.col("detected_at"), as_of, days), as_of, "dismissed", F.lit("aged out"))


def closed_by_successor(loops: DataFrame, memories: DataFrame, as_of: Column) -> DataFrame:
    next_ = memories.where(F.col("superseded_by").isNotNull()).select(F.col("id").alias("memory_id"), F.col("superseded_by").alias("_by"))
    return _closed(state(loops).join(next_, "memory_id", "left"), F.col("_by").isNotNull(), as_of, "closed", F.lit("superseded"), F.col("_by")).drop("_by")


def closed_one(loops: DataFrame, memory_id: int, reason: str, as_of: Column, by: int | None = None) -> DataFrame:
    return _closed(state(loops), F.col("memory_id") == memory_id, as_of, "closed", F.lit(reason), F.lit(by).cast("long"))


def outstanding(loops: DataFrame, memories: DataFrame, limit: int | None = 20, project: str | None = None) -> DataFrame:
    """(memory_id, action, project, detected_at, cited): open loops, the oldest first, with how many later rows cite them."""
    cites = memories.select(F.col("id").alias("by"), F.explode(text.wikilinks(F.col("body"))).alias("memory_id")).where(F.col("by") > F.col("memory_id")).groupBy("memory_id").agg(F.count("*").alias("cited"))
    rows = state(loops).where(F.col("status") == OPEN)
    if project is not None:
        rows = rows.where(F.col("project") == project)
    rows = rows.join(cites, "memory_id", "left").select("memory_id", "action", "project", "detected_at", F.coalesce("cited", F.lit(0)).alias("cited")).orderBy("detected_at", "memory_id")
    return rows if limit is None else rows.limit(limit)


def statistics(loops: DataFrame, as_of: Column, old_days: int = 7) -> DataFrame:
    """(status, n, old): loops by status, and how many of them were detected over ``old_days`` ago."""
    return state(loops).groupBy("status").agg(F.count("*").alias("n"), F.count_if(clock.older_than(F.col("detected_at"), as_of, old_days)).alias("old"))


def project_order(loops: DataFrame) -> DataFrame:
    """Loops numbered within their project, the oldest first."""
    return state(loops).withColumn("place", F.row_number().over(Window.partitionBy("project").orderBy("detected_at", "memory_id")))
