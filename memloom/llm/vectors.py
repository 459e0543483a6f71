"""Permutation index over vectors: candidate search, footrule ranking and exact re-ranking.

A vector is represented by its PREFIX nearest pivots in order (its permutation)
and posted in the inverted lists of the first of them, so two vectors meet where
they share a list.  There the footrule distance of the two permutations decides
which pairs are re-ranked by the exact cosine in double precision.

Pivots are the only fitted part.  They come from a sample of at most
SAMPLE x MAX_PIVOTS vectors a space and are spread over it: a vector within
PIVOT_COSINE of a chosen one is no pivot.  A group of similar vectors, however
many rows it has, therefore gets few pivots and meets in few lists, instead of
being scattered over lists that its members do not share.  Every row is indexed.
A list beyond BLOCK rows is compared block by block in separate tasks, without the
footrule bound (it saves no work where all permutations are alike), so no list is
ever cut off and none has to fit into one task.  Spaces below SMALL rows have one
list: they are compared as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.common import binary_rows, cut, groups, rows_of_binary

PREFIX = 12
#: Lists of a row for up to 1,024 pivots; one more for every fourfold number, as neighbours share fewer of many pivots.
POSTED = 5
ROWS_A_PIVOT = 256
MIN_PIVOTS = 16
MAX_PIVOTS = 16_384
SAMPLE = 4
PIVOT_COSINE = 0.70
SMALL = 1_024
#: Largest footrule distance of a candidate, as a share of the largest possible one.
FOOTRULE = 0.85
#: Rows of a list that one task compares, and rows and columns of a tile.
BLOCK = 32_768
#: Posted rows of a task on average.
TASK_ROWS = 65_536
TILE = 512
COLUMNS = 2_048
#: Copies (two numbers each) up to which they are broadcast to be left out; beyond it the vectors themselves are shuffled.
BROADCAST_ROWS = 500_000
#: Error allowed for a cosine in single precision; candidates within it are decided in double precision.
SINGLE = 1e-5
SCALE = 1_000_000
#: Pivots that go out at once, in bytes; more spaces than fit go out one after the other.
PIVOT_BYTES = 64 << 20


def _usable(rows: np.ndarray) -> np.ndarray:
    return np.isfinite(rows).all(axis=1) & (rows != 0).any(axis=1)


def spaces(df: DataFrame, id_col: str, vec_col: str, model_col: str) -> DataFrame:
    """(id, space, vec); a space is one embedding_model at one length; rows with a null id or model belong to none."""
    return df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.col(model_col).isNotNull() & (F.size(vec_col) > 0)).select(
        F.col(id_col).cast("long").alias("id"),
        F.concat_ws("|", F.size(vec_col).cast("string"), F.col(model_col)).alias("space"),
        F.col(vec_col).cast("array<float>").alias("vec"),
    )


def posted_lists(pivots: int) -> int:
    """How many lists a row is posted in."""
    more = max(0, int(np.ceil(np.log(max(1, pivots) / 1_024) / np.log(4) - 1e-9)))
    return min(POSTED + more, PREFIX, pivots)


def spread(sample: np.ndarray, most: int, apart: float = PIVOT_COSINE) -> np.ndarray:
    """Rows of ``sample`` (unit vectors), in their order, that lie below ``apart`` to every row taken before; at most ``most``."""
    chosen = np.empty((0, sample.shape[1]), np.float32)
    for at in range(0, len(sample), 256):
        part = sample[at : at + 256]
        part = part[(part @ chosen.T < apart).all(axis=1)] if len(chosen) else part
        taken: list[int] = []
        near = part @ part.T
        for i in range(len(part)):
            if not taken or near[i, taken].max() < apart:
                taken.append(i)
        chosen = np.concatenate([chosen, part[taken]])[:most]
        if len(chosen) == most:
            break
    return chosen


def choose_pivots(vectors: DataFrame, counts: dict[str, int]) -> dict[str, np.ndarray]:
    """Pivots by space, from a sample in the order of a hash of the vector; at most SAMPLE x MAX_PIVOTS rows a space reach the driver."""
    want = {s: min(MAX_PIVOTS, max(MIN_PIVOTS, n // ROWS_A_PIVOT)) for s, n in counts.items()}
    shares = [(s, min(SCALE, SCALE * SAMPLE * want[s] // n + 1)) for s, n in counts.items()]
    share = F.broadcast(vectors.sparkSession.createDataFrame(shares, "space string, share long"))  # at most a row for SMALL rows of the table
    rank = F.pmod(F.xxhash64("vec", F.lit("pivot")), F.lit(SCALE))
    rows = vectors.join(share, "space").where(rank < F.col("share")).select("space", rank.alias("rank"), "id", "vec").toPandas().sort_values(["rank", "id"])
    out = {}
    for s, p in rows.groupby("space"):
        m = np.array(p["vec"].tolist(), dtype=np.float64)
        m = m[_usable(m)]
        if len(m):
            out[s] = spread((m / np.linalg.norm(m, axis=1)[:, None]).astype(np.float32), want[s])
    return out


def prepared(df: DataFrame, id_col: str = "id", vec_col: str = "embedding", model_col: str = "embedding_model") -> DataFrame:
    """(id, space, digest, vec, perm, posts) of every usable vector, cut off from its lineage.

    Null, empty, non-finite and all-zero vectors give no row.
    """
    vectors = spaces(df, id_col, vec_col, model_col)
    counts = {r["space"]: r["n"] for r in vectors.groupBy("space").agg(F.count("*").alias("n")).where(F.col("n") >= SMALL).collect()}
    turns: list[dict[str, int]] = [{}]
    held = 0
    for s, n in sorted(counts.items()):
        size = 4 * int(s.split("|", 1)[0]) * min(MAX_PIVOTS, max(MIN_PIVOTS, n // ROWS_A_PIVOT))
        if turns[-1] and held + size > PIVOT_BYTES:
            turns.append({})
            held = 0
        turns[-1][s] = n
        held += size
    out = None
    for i, turn in enumerate(turns):
        names = list(turn)
        own = F.col("space").isin(names)
        if i == 0:  # the small spaces, which have no pivots, go with the first turn
            own = own | ~F.col("space").isin(list(counts)) if counts else F.lit(True)
        rows = cut(_assigned(vectors.where(own), choose_pivots(vectors.where(F.col("space").isin(names)), turn) if turn else {}))
        out = rows if out is None else out.unionByName(rows)
    return out


def _assigned(vectors: DataFrame, pivots: dict[str, np.ndarray]) -> DataFrame:
    sent = vectors.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            names = batch.column("space").to_pylist()
            ids = batch.column("id").to_numpy()
            vec = batch.column("vec")
            values, offsets = vec.values.to_numpy(zero_copy_only=False), vec.offsets.to_numpy()
            by: dict[str, list[int]] = {}
            for i, s in enumerate(names):
                by.setdefault(s, []).append(i)
            for s, at in by.items():
                at = np.array(at)
                rows = values[offsets[at][:, None] + np.arange(int(s.split("|", 1)[0]))].astype(np.float32)
                ok = _usable(rows)
                rows, own = rows[ok], ids[at[ok]]
                if not len(rows):
                    continue
                p = sent.value.get(s)
                if p is None:
                    perm, q = np.zeros((len(rows), 1), dtype=np.int16), 1
                else:
                    wide = rows.astype(np.float64)
                    near = (wide / np.linalg.norm(wide, axis=1)[:, None]).astype(np.float32) @ p.T
                    m, q = min(PREFIX, len(p)), posted_lists(len(p))
                    top = np.argpartition(-near, m - 1, axis=1)[:, :m] if m < len(p) else np.tile(np.arange(m), (len(near), 1))
                    order = np.lexsort((top, -np.take_along_axis(near, top, 1)), axis=1)
                    perm = np.take_along_axis(top, order, 1).astype(np.int16)
                posts = pa.ListArray.from_arrays(pa.array(np.arange(len(perm) + 1, dtype=np.int32) * q), pa.array(perm[:, :q].astype(np.int32).ravel()))
                raw = rows + np.float32(0)  # -0.0 and 0.0 are one value
                digest = [hashlib.blake2b(r.tobytes(), digest_size=16, key=s.encode()[:64]).digest() for r in raw]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([s] * len(own)), pa.array(digest, pa.binary()), binary_rows(raw), binary_rows(perm), posts], ["id", "space", "digest", "vec", "perm", "posts"])

    return vectors.mapInArrow(assign, "id long, space string, digest binary, vec binary, perm binary, posts array<int>")


def one_vector(rows: DataFrame) -> DataFrame:
    """Rows of prepared(), one for each id; an id with several vectors keeps the one with the smallest digest."""
    if rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return rows
    kept = F.min_by(F.struct("space", "digest", "vec", "perm", "posts"), "digest").alias("r")
    return cut(rows.groupBy("id").agg(kept).select("id", "r.*"))


def units(rows: DataFrame, same: DataFrame) -> DataFrame:
    """One row for each distinct vector of a space: ``id`` is the smallest of its copies, ``copies`` their number.

    ``same`` are the copies of ``rows``, cut off from their lineage.
    """
    if same.count() <= BROADCAST_ROWS:  # the vectors stay where they are
        more, first = same.where("id <> unit").select("id"), same.where("id = unit").select("id", F.col("n").alias("copies"))
        kept = rows.join(F.broadcast(more), "id", "left_anti").join(F.broadcast(first), "id", "left")
        return kept.select("digest", "id", F.coalesce("copies", F.lit(1)).alias("copies"), "space", "vec", "perm", "posts")
    return cut(rows.groupBy("digest").agg(
        F.min("id").alias("id"), F.count("*").alias("copies"), F.first("space").alias("space"), F.first("vec").alias("vec"), F.first("perm").alias("perm"), F.first("posts").alias("posts")
    ))


def copies(rows: DataFrame) -> DataFrame:
    """(unit, id, n) of every row whose vector occurs more than once."""
    many = rows.groupBy("digest").agg(F.min("id").alias("unit"), F.count("*").alias("n")).where("n > 1")
    return rows.select("digest", "id").join(many, "digest").select("unit", "id", "n")


def _footrule_similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum over common pivots of the smaller weight, for every row of ``a`` and of ``b``.

    A pivot at place i (from 0) of m weighs m - i.  The footrule distance of two
    permutations is m(m+1) minus twice this sum.
    """
    m = a.shape[1]
    out = np.zeros((len(a), len(b)), dtype=np.int16)
    weight = np.arange(m, 0, -1, dtype=np.int16)

    def lists(x: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        flat = x.ravel()
        order = np.argsort(flat, kind="stable")
        keys, start = np.unique(flat[order], return_index=True)
        ends = [*start[1:], len(flat)]
        return {int(k): (order[s:e] // m, weight[order[s:e] % m]) for k, s, e in zip(keys, start, ends)}

    la, lb = lists(a), lists(b)
    for p, (ra, wa) in la.items():
        if p in lb:
            rb, wb = lb[p]
            out[ra[:, None], rb[None, :]] += np.minimum(wa[:, None], wb[None, :])
    return out


def _footrule_of(a: np.ndarray, b: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The same for the pairs (a[r], b[c]) only."""
    if len(r) > len(a) * len(b) // 64:
        return _footrule_similarity(a, b)[r, c]
    x, y = a[r], b[c]
    m = a.shape[1]
    out = np.zeros(len(r), dtype=np.int16)
    for i in range(m):
        out += ((y == x[:, i, None]) * np.minimum(m - i, np.arange(m, 0, -1, dtype=np.int16))).sum(axis=1, dtype=np.int16)
    return out


def _top(src: np.ndarray, dst: np.ndarray, cos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((dst, -cos, src))
    src, dst, cos = src[order], dst[order], cos[order]
    new = np.ones(len(src), dtype=bool)
    new[1:] = src[1:] != src[:-1]
    starts = np.flatnonzero(new)
    place = np.arange(len(src)) - starts[np.cumsum(new) - 1]
    keep = place < k
    return src[keep], dst[keep], cos[keep]


def unit_rows(col: pa.Array) -> np.ndarray:
    vec = rows_of_binary(col, np.float32).astype(np.float64)
    return vec / np.linalg.norm(vec, axis=1)[:, None]


def _best(near: np.ndarray, hit: np.ndarray, k: int) -> np.ndarray:
    """Of ``hit`` what may be among the k best of its row or of its column, ties included."""
    if min(near.shape) <= k or np.count_nonzero(hit) <= 4 * k * sum(near.shape):
        return hit
    by_row = near >= np.partition(near, -k, axis=1)[:, -k][:, None] - 2 * SINGLE
    by_column = near >= np.partition(near, -k, axis=0)[-k][None, :] - 2 * SINGLE
    return hit & (by_row | by_column)


def share_list(a: np.ndarray, b: np.ndarray, below: int) -> np.ndarray:
    """For the pairs (row of a, row of b): whether both are posted in one list numbered below ``below``."""
    out = np.zeros(len(a), dtype=bool)
    for i in range(a.shape[1]):
        col = a[:, i]
        out |= (col < below) & (b == col[:, None]).any(axis=1)
    return out


def _owned(post_a: np.ndarray, post_b: np.ndarray, hit: np.ndarray, this: int) -> np.ndarray:
    """Of ``hit`` the pairs that share no list before ``this``, so that a pair comes from one list only."""
    if this == 0 or post_a.shape[1] == 1:
        return hit
    if np.count_nonzero(hit) <= hit.size // 16:
        r, c = np.nonzero(hit)
        out = np.zeros_like(hit)
        keep = ~share_list(post_a[r], post_b[c], this)
        out[r[keep], c[keep]] = True
        return out
    common = np.intersect1d(post_a[post_a < this], post_b[post_b < this])
    if not len(common):
        return hit
    ones = lambda x: (x[:, :, None] == common[None, None, :]).any(axis=1).astype(np.float32)
    return hit & (ones(post_a) @ ones(post_b).T == 0)


def compare_lists(indexed: DataFrame, threshold: float, k: int, degrees: bool = False) -> DataFrame:
    """(src, dst, cos): for each row of each list its k best partners at ``threshold`` or more, both directions.

    ``indexed`` has id, space, vec, perm and posts.  A pair that shares several lists
    comes from the smallest of them.  With ``degrees`` also (src, null, n): the number
    of all rows at the threshold or more that src shares a list with, in parts.
    """
    posted = indexed.select("id", "space", "vec", "perm", F.size("posts").alias("q"), F.explode("posts").alias("list"))
    sizes = cut(posted.groupBy("space", "list").agg(F.count("*").alias("n")))
    hot = sizes.where(F.col("n") > BLOCK).select("space", "list", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    blocks = F.coalesce("blocks", F.lit(1))
    # One row for BLOCK rows of the input at most, so the broadcast is small against any of its parts.
    laid = posted.join(F.broadcast(hot), ["space", "list"], "left").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("lo"), F.greatest(x, F.col("block")).alias("hi")))
    laid = laid.select("space", "list", F.explode(cells).alias("cell"), "blocks", "block", "id", "vec", "perm", "q").select("space", "list", "cell.lo", "cell.hi", "blocks", "block", "id", "vec", "perm", "q")
    key = ["space", "list", "lo", "hi"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, key):
            if t.num_rows < 2:
                continue
            lo, hi, this, split, q = (t[x][0].as_py() for x in ("lo", "hi", "list", "blocks", "q"))
            ids = t["id"].combine_chunks().to_numpy()
            order = np.argsort(ids)
            ids = ids[order]
            block = t["block"].combine_chunks().to_numpy()[order]
            wide = unit_rows(t["vec"].combine_chunks())[order]
            vec = wide.astype(np.float32)
            perm = rows_of_binary(t["perm"].combine_chunks(), np.int16)[order]
            post = perm[:, :q]
            m = perm.shape[1]
            least = m * (m + 1) * (1 - FOOTRULE) / 2
            same = lo == hi
            left = np.arange(len(ids)) if same else np.flatnonzero(block == lo)
            right = left if same else np.flatnonzero(block == hi)
            found: list[tuple[np.ndarray, ...]] = []
            number = np.zeros(len(ids), dtype=np.int64)
            for i in range(0, len(left), TILE):
                a = left[i : i + TILE]
                for j in range(i // COLUMNS * COLUMNS if same else 0, len(right), COLUMNS):
                    b = right[j : j + COLUMNS]
                    near = vec[a] @ vec[b].T
                    if same:
                        near[a[:, None] >= b[None, :]] = -2.0
                    if degrees:
                        hit = near >= threshold + SINGLE
                        r, c = np.nonzero((near >= threshold - SINGLE) & ~hit)
                        ok = np.einsum("ij,ij->i", wide[a[r]], wide[b[c]]).round(9) >= threshold
                        hit[r[ok], c[ok]] = True
                        if hit.any():
                            owned = _owned(post[a], post[b], hit, this)
                            number[a] += owned.sum(axis=1)
                            number[b] += owned.sum(axis=0)
                    hit = near >= threshold - SINGLE
                    if not hit.any():
                        continue
                    hit = _best(near, hit, k)
                    r, c = np.nonzero(_owned(post[a], post[b], hit, this))
                    if split == 1 and m > 1:
                        near_by = _footrule_of(perm[a], perm[b], r, c) >= least
                        r, c = r[near_by], c[near_by]
                    cos = np.einsum("ij,ij->i", wide[a[r]], wide[b[c]]).round(9)
                    keep = cos >= threshold
                    x, y, cos = ids[a[r[keep]]], ids[b[c[keep]]], cos[keep]
                    found += [(x, y, cos), (y, x, cos)]
                    if sum(len(f[0]) for f in found[1:]) > 4 * k * len(ids):
                        found = [_top(*map(np.concatenate, zip(*found)), k)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _top(*map(np.concatenate, zip(*found)), k)], ["src", "dst", "cos"])
            some = np.flatnonzero(number)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.nulls(len(some), pa.int64()), pa.array(number[some].astype(np.float64))], ["src", "dst", "cos"])

    spark = indexed.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, (sizes.agg(F.sum("n")).first()[0] or 0) // TASK_ROWS)
    return laid.repartition(tasks, *key).sortWithinPartitions(*key).mapInArrow(compare, "src long, dst long, cos double")


def best_links(found: DataFrame, k: int) -> DataFrame:
    """(src, dst, cos): the k best of each src over all lists, ties to the smaller dst."""
    best = Window.partitionBy("src").orderBy(F.desc("cos"), "dst")
    return found.where("dst is not null").withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("src", "dst", "cos")


def nearest(df: DataFrame, k: int = 5, threshold: float = 0.80, id_col: str = "id", vec_col: str = "embedding", model_col: str = "embedding_model") -> DataFrame:
    """(id, neighbour, cos, place): the k most similar rows of every usable vector, at ``threshold`` or more, found by the index.

    Only vectors of one embedding_model and one length compare; cosine in double
    precision, rounded to 9 decimals; ties go to the smaller id.  Exact copies are
    searched once and expanded to at most k partners a row.  Unusable vectors
    (null, empty, non-finite, all zero, null model) give no row; an id with several
    vectors takes part with one of them; an empty table gives an empty result.
    """
    usable = one_vector(prepared(df, id_col, vec_col, model_col))
    same = cut(copies(usable))
    near = cut(best_links(compare_lists(units(usable, same), threshold, k), k).select(F.col("src").alias("unit"), F.col("dst").alias("other"), "cos"))
    by_id = Window.partitionBy("unit").orderBy("id")
    few = cut(same.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k + 1).select("unit", "id"))
    more = few.where("id > unit")
    pool = (
        near.unionByName(near.join(more.select(F.col("unit").alias("other"), "id"), "other").select("unit", F.col("id").alias("other"), "cos"))
        .unionByName(few.select("unit", F.col("id").alias("other"), F.lit(1.0).alias("cos")))
    )
    best = Window.partitionBy("unit").orderBy(F.desc("cos"), "other")
    ranked = pool.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    members = same.select("unit", "id")
    rows = ranked.join(members, "unit", "left").select(F.coalesce("id", "unit").alias("id"), "other", "cos").where(F.col("id") != F.col("other"))
    last = Window.partitionBy("id").orderBy(F.desc("cos"), "other")
    return rows.withColumn("place", F.row_number().over(last)).where(F.col("place") <= k).select("id", F.col("other").alias("neighbour"), "cos", "place")


def nearest_pairs(neighbours: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b, where one is among the other's neighbours."""
    return neighbours.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
