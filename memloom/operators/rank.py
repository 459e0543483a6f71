"""Composite re-ranking of a candidate pool (query_id, id, cosine) with the rows' use history."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import clock


@dataclass(frozen=True)
class Policy:
    """Terms of the score; an override with an unknown name is an error."""

    use_share: float = 0.7
    recency_share: float = 0.2
    use_bonus: float = 0.1
    current: float = 1.05
    past: float = 0.92
    superseded: float = 0.4
    success_bonus: float = 0.0
    normalise: str = "rank"
    temporal: bool = True
    supersession: bool = True
    recency_days: int = 60

    def override(self, **terms: object) -> Policy:
        unknown = set(terms) - {f.name for f in fields(self)}
        if unknown:
            raise ValueError(f"unknown policy terms: {sorted(unknown)}")
        return replace(self, **terms)


PURE_COSINE = Policy(use_bonus=0.0, temporal=False, supersession=False)
#: Rungs of the policy ladder, from plain similarity to everything.
LADDER = {
    "cosine": PURE_COSINE,
    "use_max": PURE_COSINE.override(use_bonus=0.1, normalise="max"),
    "use_log": PURE_COSINE.override(use_bonus=0.1, normalise="log"),
    "use_rank": PURE_COSINE.override(use_bonus=0.1),
    "temporal": Policy(supersession=False),
    "shipped": Policy(),
    "success": Policy(success_bonus=0.3),
}


def normalised(weight: Column, by: list[str], mode: str = "rank") -> Column:
    """Weight within its pool, 0 to 1.

    rank: middle rank of ties over n - 1; max: share of the largest; log: the same
    on log1p.  A pool whose largest weight is 0 divides by 1; null weights count as 0.
    """
    w = F.coalesce(weight, F.lit(0.0))
    pool = Window.partitionBy(*by)
    if mode == "rank":
        first = F.rank().over(pool.orderBy(w))
        ties = F.count("*").over(Window.partitionBy(*by, w))
        return (first - 1 + (ties - 1) / F.lit(2.0)) / F.greatest(F.count("*").over(pool) - 1, F.lit(1))
    if mode not in ("max", "log"):
        raise ValueError(f"unknown normalisation: {mode}")
    v = F.log1p(w) if mode == "log" else w
    top = F.max(v).over(pool)
    return v / F.when(top > 0, top).otherwise(F.lit(1.0))


def scored(pool: DataFrame, memories: DataFrame, as_of: Column, policy: Policy = Policy(), by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The pool with weight_norm, recency, status and score, rounded to 4 places before any sorting."""
    p = with_history(pool, memories, as_of).withColumn("weight_norm", normalised(F.col("weight"), list(by), policy.normalise))
    p = p.withColumn("recency", clock.recency(F.col("last_accessed"), as_of, policy.recency_days))
    return p.withColumn("score", score(policy, F.col("weight_norm"), F.col("recency")))


def with_history(pool: DataFrame, memories: DataFrame, as_of: Column) -> DataFrame:
    """The pool with what the score needs of its rows, and their status."""
    rows = memories.select("id", "weight", "last_accessed", "temporal_anchor_start", "temporal_anchor_end", "superseded_by", "success_count", "fail_count")
    return pool.join(rows, "id").withColumn("status", clock.temporal_status(F.col("temporal_anchor_start"), F.col("temporal_anchor_end"), F.to_date(as_of)))


def score(policy: Policy, weight_norm: Column, recency: Column) -> Column:
    """The composite score of a row of with_history, rounded half-even to 4 places."""
    use = F.lit(1.0) + F.lit(policy.use_bonus) * (F.lit(policy.use_share) * weight_norm + F.lit(policy.recency_share) * recency)
    factor = F.lit(1.0)
    if policy.temporal:
        factor = F.when(F.col("status") == "current", policy.current).when(F.col("status") == "past", policy.past).otherwise(1.0)
    if policy.supersession:
        factor = factor * F.when(F.col("superseded_by").isNotNull(), policy.superseded).otherwise(1.0)
    if policy.success_bonus:
        net = F.coalesce("success_count", F.lit(0)) - F.coalesce("fail_count", F.lit(0))
        factor = factor * F.when(net > 0, F.lit(1.0) + F.lit(policy.success_bonus) * net / (net + 2)).otherwise(1.0)
    return F.bround(F.col("cosine") * use * factor, 4)


def order(*by: str) -> Window:
    """Score first, then cosine, then the smaller id."""
    return Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("cosine"), "id")


def placed(p: DataFrame, by: tuple[str, ...] = ("query_id",), limit: int | None = None) -> DataFrame:
    p = p.withColumn("pos", F.row_number().over(order(*by)))
    return p if limit is None else p.where(F.col("pos") <= limit)
