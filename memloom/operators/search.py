"""Exact top-k vector search for many queries at once.

Queries go out in blocks of at most QUERY_BYTES, the memories stay where they are:
each task scores its rows against up to BLOCKS_A_SCAN blocks in one scan, tile by
tile, and keeps the best k different rows of every query, so that only k rows for
each query and task are shuffled.  Nothing is sampled; the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import vector as V

#: Bytes of query vectors in one block, and blocks that one scan of the rows answers.
QUERY_BYTES = 32 << 20
BLOCKS_A_SCAN = 8
#: Rows and queries of a tile.
ROWS = 2_048


def active(memories: DataFrame, as_of: Column) -> DataFrame:
    """Rows that recall may return: with a vector, not archived, not expired."""
    return memories.where(F.col("embedding").isNotNull() & ~F.coalesce("archived", F.lit(False)) & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of)))


def narrowed(memories: DataFrame, aliases: DataFrame | None = None, tiers: list[str] | str | None = None, **equal: str | None) -> DataFrame:
    """Optional equality filters, tier membership, and a project filter that resolves aliases."""
    out = memories
    project = equal.pop("project", None)
    for column, value in equal.items():
        if value is not None:
            out = out.where(F.col(column) == value)
    if tiers is not None:
        out = out.where(F.col("tier").isin([tiers] if isinstance(tiers, str) else list(tiers)))
    if project is not None:
        if aliases is None:
            out = out.where(F.col("project") == project)
        else:  # one row: the target of the alias, or the raw string
            wanted = aliases.where(F.col("alias") == project).agg(F.coalesce(F.min("canonical"), F.lit(project)).alias("project"))
            out = out.join(F.broadcast(wanted), "project", "left_semi")
    return out


def not_recycled(origin: Column) -> Column:
    """Everything but recycled rows; a null origin stays."""
    return ~origin.eqNullSafe("recycle")


def _key(df: DataFrame, vec: str, model: str | None) -> DataFrame:
    space = F.concat_ws("|", F.size(vec).cast("string"), F.col(model)) if model else F.size(vec).cast("string")
    return df.where(F.col(vec).isNotNull() & (F.col(model).isNotNull() if model else F.lit(True))).withColumn("space", space)


def _kept(q: np.ndarray, ids: np.ndarray, cos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best different ids of every query, ties to the smaller id."""
    order = np.lexsort((-cos, ids, q))
    q, ids, cos = q[order], ids[order], cos[order]
    first = np.ones(len(q), dtype=bool)
    first[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])
    q, ids, cos = q[first], ids[first], cos[first]
    order = np.lexsort((ids, -cos, q))
    q, ids, cos = q[order], ids[order], cos[order]
    starts = np.searchsorted(q, q, side="left")
    keep = np.arange(len(q)) - starts < k
    return q[keep], ids[keep], cos[keep]


class _Best:
    """The k best rows so far of every query of one block and space."""

    def __init__(self, k: int, qid: np.ndarray) -> None:
        self.k, self.qid = k, qid
        self.held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        self.least = np.full(len(qid), -2.0)

    def add(self, q: np.ndarray, ids: np.ndarray, rows: np.ndarray, skip_self: bool) -> None:
        """Score rows (unit vectors) against the queries, tile by tile."""
        for at in range(0, len(q), ROWS):
            cos = (q[at : at + ROWS] @ rows.T).round(9)
            if skip_self:
                cos[self.qid[at : at + ROWS, None] == ids[None, :]] = -9.0
            hit = cos >= self.least[at : at + ROWS, None]
            # Repeated ids may take several of the best places, so the cut counts different ids only where all are different.
            if self.unique(ids) and cos.shape[1] > self.k:
                hit &= cos >= np.partition(cos, -self.k, axis=1)[:, -self.k][:, None]
            hit &= cos > -2.0
            r, c = np.nonzero(hit)
            if not len(r):
                continue
            mine = (self.held[0] >= at) & (self.held[0] < at + ROWS)
            new = _kept(*[np.concatenate(x) for x in zip([h[mine] for h in self.held], (r + at, ids[c], cos[r, c]))], self.k)
            self.held = tuple(np.concatenate([h[~mine], n]) for h, n in zip(self.held, new))
            number = np.bincount(new[0] - at, minlength=len(cos))
            low = np.full(len(cos), np.inf)
            np.minimum.at(low, new[0] - at, new[2])
            full = number == self.k
            self.least[at : at + ROWS][full] = low[full]

    @staticmethod
    def unique(ids: np.ndarray) -> bool:
        return len(ids) < 2 or bool((ids[1:] != ids[:-1]).all())


def top_k(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "id", query_col: str = "query_id", vec: str = "embedding", model: str | None = "embedding_model", skip_self: bool = False) -> DataFrame:
    """(query_col, id_col, cosine, pos): the k most similar rows of every query, pos from 1.

    Rows and queries compare within one model and length only.  Unusable vectors
    (null, empty, non-finite, all zero) and null ids match nothing.  Ties go to the smaller id.
    Repeated ids keep their best place once, so that k different ids come out where there are k.
    A repeated query with several vectors takes each row's best cosine.
    """
    r = _key(rows, vec, model).select(F.col(id_col).cast("long").alias("id"), "space", F.col(vec).cast("array<double>").alias("v"))
    r = r.where("id is not null")
    asked = _key(queries.where(F.col(query_col).isNotNull()), vec, model).select(F.col(query_col).cast("long").alias("q"), "space", F.col(vec).cast("array<double>").alias("v"))
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    blocks = max(1, -(-size["n"] * 8 * (size["dim"] or 1) // QUERY_BYTES))
    spark = rows.sparkSession
    parts: list[DataFrame] = []
    for b in range(0, blocks, BLOCKS_A_SCAN):
        sent = []
        for turn in range(b, min(b + BLOCKS_A_SCAN, blocks)):
            pdf = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == turn).toPandas()  # about QUERY_BYTES
            held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
            for s, p in pdf.groupby("space"):
                m = np.array(p["v"].tolist(), dtype=np.float64)
                ok = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
                if ok.any():
                    held[s] = (p["q"].to_numpy()[ok], m[ok] / np.linalg.norm(m[ok], axis=1)[:, None])
            sent.append(spark.sparkContext.broadcast(held))

        def score(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            best: dict[tuple[int, str], _Best] = {}
            for pdf in batches:
                for s, p in pdf.groupby("space"):
                    asking = [(i, x.value[s]) for i, x in enumerate(sent) if s in x.value]
                    if not asking:
                        continue
                    m = np.array(p["v"].tolist(), dtype=np.float64)
                    ok = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
                    ids, m = p["id"].to_numpy()[ok], m[ok]
                    order = np.argsort(ids, kind="stable")
                    ids, m = ids[order], m[order] / np.linalg.norm(m[order], axis=1)[:, None]
                    for i, (qid, q) in asking:
                        if (i, s) not in best:
                            best[i, s] = _Best(k, qid)
                        for at in range(0, len(ids), ROWS):
                            best[i, s].add(q, ids[at : at + ROWS], m[at : at + ROWS], skip_self)
            for one in best.values():
                q, ids, cos = one.held
                yield pd.DataFrame({"q": one.qid[q], "id": ids, "cosine": cos})

        parts.append(r.mapInPandas(score, "q long, id long, cosine double"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine"), "id"))
    found = found.groupBy("q", "id").agg(F.max("cosine").alias("cosine")).withColumn("pos", place).where(F.col("pos") <= k)
    return found.select(F.col("q").alias(query_col), F.col("id").alias(id_col), "cosine", "pos")


def lens_top_k(lenses: DataFrame, memories: DataFrame, queries: DataFrame, k: int, lens_types: list[str] | None = None) -> DataFrame:
    """(query_id, id, cosine): search over lens rows of the given memories; the limit counts lens rows, so one memory may take several."""
    rows = lenses.join(memories.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
    if lens_types is not None:
        rows = rows.where(F.col("perspective").isin(lens_types))
    hit = top_k(rows, queries, k, id_col="lens_id")
    return hit.join(rows.select("lens_id", "memory_id"), "lens_id").select("query_id", F.col("memory_id").alias("id"), "cosine")


def merged_pool(literal: DataFrame, lens: DataFrame) -> DataFrame:
    """(query_id, id, cosine): the better cosine of both searches; rows found by a lens only join the pool."""
    return literal.select("query_id", "id", "cosine").unionByName(lens.select("query_id", "id", "cosine")).groupBy("query_id", "id").agg(F.max("cosine").alias("cosine"))


def near_duplicates(memories: DataFrame, asked: DataFrame, as_of: Column, threshold: float = 0.95) -> DataFrame:
    """(id, other, cosine): the nearest other active row at the threshold or more that the asked row does not already supersede."""
    pool = active(memories, as_of)
    own = asked.select(F.col("id").alias("query_id"), "embedding", "embedding_model")
    hits = top_k(pool, own, 8, skip_self=True)
    replaced = memories.select("id", "superseded_by")
    hits = hits.join(replaced, "id").where((F.col("cosine") >= threshold) & ~F.col("superseded_by").eqNullSafe(F.col("query_id")))
    first = F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))
    return hits.withColumn("n", first).where("n = 1").select(F.col("query_id").alias("id"), F.col("id").alias("other"), "cosine")


def nearest_centroid(queries: DataFrame, doorways: DataFrame, threshold: float = 0.60) -> DataFrame:
    """(query_id, key, cosine): the nearest fresh doorway, if at the threshold or more.  Equal cosines go to the smaller hash of the key."""
    fresh = doorways.where(~F.coalesce("stale", F.lit(False)))
    numbered = fresh.select(F.xxhash64("key").alias("n"), "key", F.col("centroid").alias("embedding"))
    hits = top_k(numbered, queries, 1, id_col="n", model=None)
    return hits.where(F.col("cosine") >= threshold).join(numbered.select("n", "key"), "n").select("query_id", "key", "cosine")


def pair_cosine(pairs: DataFrame, memories: DataFrame) -> DataFrame:
    """pairs (a, b) with their cosine; null where a vector is missing or unusable."""
    v = memories.select("id", "embedding")
    both = pairs.join(v.select(F.col("id").alias("a"), F.col("embedding").alias("va")), "a").join(v.select(F.col("id").alias("b"), F.col("embedding").alias("vb")), "b")
    return both.select("a", "b", V.cosine(F.col("va"), F.col("vb")).alias("cosine"))
