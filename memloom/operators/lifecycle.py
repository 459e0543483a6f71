"""Lifecycle of rows: every step maps a state to a new state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import clock


def strengthen(memories: DataFrame, exposures: DataFrame, as_of: Column) -> DataFrame:
    """Recalled rows: ``exposures`` (id, one row each time) raise access_count and weight.

    k exposures at count c add the sum of 1/(c+2+i), as one after the other would.
    """
    times = exposures.groupBy("id").agg(F.count("*").alias("times"))
    n = F.coalesce("times", F.lit(0))
    count = F.coalesce("access_count", F.lit(0))
    # Two steps: inside the lambda of ``diminishing`` the count must be the one before.
    weighed = memories.join(times, "id", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)) + clock.diminishing(count, n))
    return weighed.withColumns({"access_count": count + n, "last_accessed": F.when(n > 0, as_of).otherwise(F.col("last_accessed"))}).drop("times")


def used(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows that helped: success_count + 1 and weight + 1/(access_count+2), once for each call and id."""
    hit = F.coalesce("hit", F.lit(False))
    return memories.join(ids.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left").withColumns({
        "weight": F.coalesce("weight", F.lit(0.0)) + F.when(hit, F.lit(1.0) / (F.coalesce("access_count", F.lit(0)) + 2)).otherwise(0.0),
        "success_count": F.coalesce("success_count", F.lit(0)) + hit.cast("long"),
    }).drop("hit")


def failed(memories: DataFrame, ids: DataFrame, step: float = 0.05) -> DataFrame:
    """Rows that misled: fail_count + 1, weight down by ``step``, not below 0."""
    hit = F.coalesce("hit", F.lit(False))
    return memories.join(ids.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left").withColumns({
        "weight": F.when(hit, F.greatest(F.lit(0.0), F.coalesce("weight", F.lit(0.0)) - step)).otherwise(F.coalesce("weight", F.lit(0.0))),
        "fail_count": F.coalesce("fail_count", F.lit(0)) + hit.cast("long"),
    }).drop("hit")


def supersede(memories: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (old, new): the last new id of each old one becomes its successor."""
    last = pairs.groupBy(F.col("old").alias("id")).agg(F.max("new").alias("new"))
    return memories.join(last, "id", "left").withColumn("superseded_by", F.coalesce("new", "superseded_by")).drop("new")


def attach(entities: DataFrame, new: DataFrame) -> DataFrame:
    """(memory_id, entity) without doubles."""
    return entities.select("memory_id", "entity").unionByName(new.select("memory_id", "entity")).distinct()


def decay_nodes(memories: DataFrame, as_of: Column, decay: float = 0.95, days: int = 7, floor: float = 0.01) -> DataFrame:
    """Rows idle for ``days`` lose a share of their weight; rows once used and now below ``floor`` are archived."""
    idle = F.coalesce(clock.older_than(F.col("last_accessed"), as_of, days), F.lit(False)) & ~F.coalesce("archived", F.lit(False))
    weight = F.when(idle, F.col("weight") * decay).otherwise(F.col("weight"))
    return memories.withColumn("weight", weight).withColumn("archived", F.coalesce("archived", F.lit(False)) | F.coalesce((F.col("weight") < floor) & (F.col("access_count") > 0), F.lit(False)))


def archive_unused(memories: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """Rows never used and older than ``days`` are archived."""
    old = (F.coalesce("access_count", F.lit(0)) == 0) & clock.older_than(F.col("created_at"), as_of, days)
    return memories.withColumn("archived", F.coalesce("archived", F.lit(False)) | F.coalesce(old, F.lit(False)))


def retensed(memories: DataFrame, written: DataFrame) -> DataFrame:
    """The state after rewrites (id, body) of rows that were due; blank rewrites change nothing, of several for one row the smallest counts."""
    new = written.where(F.trim(F.coalesce("body", F.lit(""))) != "").groupBy("id").agg(F.min("body").alias("_new"))
    return memories.join(new, "id", "left").withColumn("body", F.coalesce("_new", "body")).select(*memories.columns)


def due_for_retensing(memories: DataFrame, as_of: Column, limit: int = 50) -> DataFrame:
    """(id, subject, status): anchored live rows whose date is past or current, oldest anchor first."""
    status = clock.temporal_status(F.col("temporal_anchor_start"), F.col("temporal_anchor_end"), F.to_date(as_of))
    rows = memories.where(F.col("temporal_anchor_start").isNotNull() & ~F.coalesce("archived", F.lit(False))).withColumn("status", status)
    return rows.where("status in ('past', 'current')").orderBy("temporal_anchor_start", "id").limit(limit).select("id", "subject", "status")


def by_entity(memories: DataFrame, entities: DataFrame | None, entity: str, limit: int = 20, strongest: bool = False) -> DataFrame:
    """Live rows whose person is the entity or that it is attached to; the lowest ids first, or the strongest."""
    own = memories.where(F.col("person") == entity).select("id")
    if entities is not None:
        own = own.unionByName(entities.where(F.col("entity") == entity).select(F.col("memory_id").alias("id")))
    rows = memories.join(own.distinct(), "id", "left_semi").where(~F.coalesce("archived", F.lit(False)))
    return rows.orderBy(*([F.desc_nulls_last("weight"), "id"] if strongest else ["id"])).limit(limit)


def by_ids(memories: DataFrame, ids: DataFrame) -> DataFrame:
    return memories.join(ids.select("id").distinct(), "id", "left_semi")


def looked_up(memories: DataFrame, ids: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Rows as they were before the look-up, and the state strengthened by it."""
    live = by_ids(memories, ids).where(~F.coalesce("archived", F.lit(False)))
    return live, strengthen(memories, live.select("id"), as_of)


def forget(memories: DataFrame, children: dict[str, tuple[DataFrame, str]], project: str, confirmed: bool) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The state without a project's rows and their children (name: frame, column of the memory id)."""
    if not confirmed:
        raise ValueError("deleting a project must be confirmed")
    gone = memories.where(F.col("project") == project).select("id")
    kept = {name: df.join(gone.withColumnRenamed("id", col), col, "left_anti") for name, (df, col) in children.items()}
    return memories.where(~F.col("project").eqNullSafe(project)), kept


def latest(rows: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """One row for each key: the first in ``order``."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
