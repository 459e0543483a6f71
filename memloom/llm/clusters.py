"""Clusters of mutually similar records: reciprocal-nearest-neighbour average linkage.

The sparse graph links each distinct vector with its LINKS most similar ones at the
threshold or more, found by the permutation index.  Each round merges every pair of
clusters that are each other's best partner among the linked ones, all in parallel.
The linkage of two clusters is the average cosine over all pairs of their records,
linked or not: the product of the sums of their unit vectors by the product of their
sizes, so no pair is ever listed.  Clusters merge while it is at the threshold or more.

When no linked pair is left that may merge, the clusters that may have partners the
graph does not show (a member had more than LINKS partners) are looked up again by
their mean vectors, and the rounds go on with the pairs found.  An average at the
threshold needs means whose cosine reaches it, so the look-up misses none but for the
recall of the index.

A closed cluster is checked where it was put together: every two members exactly, and
the number of partners each member has inside against all that the index shows it.

Merges of one connected component never depend on another one, so components of up
to LOCAL_NODES nodes run their rounds inside one task; larger ones run the same
rounds as jobs over the whole cluster.  The results are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm import vectors
from memloom.llm.common import cut, groups, rows_of_binary

LINKS = 32
#: Nodes of a component that one task may hold: two dense matrices of 2,000 x 2,000.
LOCAL_NODES = 2_000
#: Rows of a cluster that one task compares with others of it.
BLOCK = 4_096


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); root is the smallest node of its component.

    Each round every node takes the smallest of its neighbours and itself, and the
    graph is contracted; a clique is done after one round.
    """
    left = cut(edges.select("a", "b").where("a <> b"))
    roots = left.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root"))
    while not left.isEmpty():
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy("a").agg(F.min("b").alias("m")).where("m < a").select(F.col("a").alias("root"), "m"))
        roots = cut(roots.join(low, "root", "left").select("node", F.coalesce("m", "root").alias("root")))
        la, lb = low.select(F.col("root").alias("a"), F.col("m").alias("ma")), low.select(F.col("root").alias("b"), F.col("m").alias("mb"))
        x, y = F.coalesce("ma", "a"), F.coalesce("mb", "b")
        left = cut(left.join(la, "a", "left").join(lb, "b", "left").where(x != y).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct())
    return roots


def rounds(sums: np.ndarray, size: np.ndarray, near: np.ndarray, threshold: float) -> np.ndarray:
    """The root of every node of one component (nodes in the order of their ids); the same rounds as ``link``.

    ``sums`` are the sums of the nodes' unit vectors, ``near`` says which nodes are linked.
    """
    total, size, near = sums @ sums.T, size.astype(np.float64), near.copy()
    root, live = np.arange(len(size)), np.arange(len(size))
    complete = False
    while len(live) > 1:
        avg = (total / size[:, None] / size[None, :]).round(9)
        np.fill_diagonal(avg, -9.0)
        best_of = np.where(near, avg, -9.0)
        best = best_of.argmax(axis=1)
        here = np.arange(len(live))
        i = np.flatnonzero((best_of.max(axis=1) >= threshold) & (best[best] == here) & (here < best))
        if not len(i):
            if complete:
                break
            near, complete = avg >= threshold, True
            continue
        complete = False
        j = best[i]
        for m in (total, near):
            m[i] += m[j]
            m[:, i] += m[:, j]
        size[i] += size[j]
        to = np.arange(len(root))
        to[live[j]] = live[i]
        root = to[root]
        keep = np.ones(len(live), dtype=bool)
        keep[j] = False
        total, near, size, live = total[keep][:, keep], near[keep][:, keep], size[keep], live[keep]
    return root


def _product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, avg): the average cosine over all pairs, from the sizes na, nb and the sums sa, sb."""
    for batch in batches:
        if not batch.num_rows:
            continue
        width = np.array([len(x) for x in batch.column("sa").to_pylist()])
        out = np.empty(batch.num_rows)
        for w in np.unique(width):  # a pair lies within one space, whose vectors have one length
            at = np.flatnonzero(width == w)
            x, y = (rows_of_binary(batch.column(c).take(pa.array(at)), np.float64) for c in ("sa", "sb"))
            out[at] = np.einsum("ij,ij->i", x, y)
        avg = (out / batch.column("na").to_numpy() / batch.column("nb").to_numpy()).round(9)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(avg)], ["a", "b", "avg"])


def _average(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, avg) of the edges (a, b), from the nodes' (node, n, sums)."""
    both = edges.join(nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sums").alias("sa")), "a").join(nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sums").alias("sb")), "b")
    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_product, "a long, b long, avg double")


def _weighed(rows: DataFrame) -> DataFrame:
    """(node, space, n, sums) of the rows (node, space, n, vec): their unit vectors times their numbers of copies."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [_sums(v, n).tobytes() for v, n in zip(b.column("vec").to_pylist(), b.column("n").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("space"), b.column("n"), pa.array(sums, pa.binary())], ["node", "space", "n", "sums"])

    return rows.select("node", "space", "n", "vec").mapInArrow(weigh, "node long, space string, n long, sums binary")


def _sums(vec: bytes, n: int) -> np.ndarray:
    v = np.frombuffer(vec, np.float32).astype(np.float64)
    return v / np.linalg.norm(v) * n


def _added(rows: DataFrame) -> DataFrame:
    """(node, space, n, sums): sizes and sums of the rows of each node added up, first within each part of the input."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, str, int, np.ndarray] | None = None
        for b in batches:
            out = []
            for node, space, n, sums in zip(*[b.column(x).to_pylist() for x in ("node", "space", "n", "sums")]):
                vec = np.frombuffer(sums, np.float64)
                if held is not None and held[0] == node:
                    held = (node, space, held[2] + n, held[3] + vec)
                else:
                    if held is not None:
                        out.append(held)
                    held = (node, space, n, vec)
            if out:
                yield batch(out)
        if held is not None:
            yield batch([held])

    def batch(rows: list) -> pa.RecordBatch:
        node, space, n, sums = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(space), pa.array(n, pa.int64()), pa.array([x.tobytes() for x in sums], pa.binary())], ["node", "space", "n", "sums"])

    kind = "node long, space string, n long, sums binary"
    part = rows.select("node", "space", "n", "sums").sortWithinPartitions("node").mapInArrow(add, kind)
    return part.repartition("node").sortWithinPartitions("node").mapInArrow(add, kind)


def _merged(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """nodes (node, space, n, sums) after the merges (node, root)."""
    return _added(nodes.join(roots, "node", "left").select(F.coalesce("root", "node").alias("node"), "space", "n", "sums"))


def _followed(absorbed: DataFrame | None, step: DataFrame) -> DataFrame:
    """(node, root) of all merges so far and one more step."""
    if absorbed is None:
        return step
    moved = absorbed.join(step.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return moved.unionByName(step)


def link(nodes: DataFrame, edges: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Rounds as jobs: (node, root) of every node merged into another one, and the nodes that are left.

    nodes has node, space, n, sums; edges a < b.  Ties between partners go to the smaller
    id.  The state is cut off each round; the loop ends with the first round that merges
    nothing.
    """
    nodes, edges, absorbed = cut(nodes), cut(edges), None
    while True:
        open_ = cut(_average(edges, nodes).where(F.col("avg") >= threshold))
        both = open_.select(F.col("a").alias("x"), F.struct("avg", (-F.col("b")).alias("y")).alias("p")).unionByName(open_.select(F.col("b").alias("x"), F.struct("avg", (-F.col("a")).alias("y")).alias("p")))
        best = both.groupBy("x").agg((-F.max("p")["y"]).alias("y"))
        step = best.groupBy(F.least("x", "y").alias("root"), F.greatest("x", "y").alias("node")).agg(F.count("*").alias("n")).where("n = 2").select("node", "root")
        step = cut(step)
        if step.isEmpty():
            return (absorbed if absorbed is not None else step), nodes
        absorbed = cut(_followed(absorbed, step))
        nodes = cut(_merged(nodes, step))
        ra, rb = step.select(F.col("node").alias("a"), F.col("root").alias("ra")), step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        x, y = F.coalesce("ra", "a"), F.coalesce("rb", "b")
        edges = cut(edges.join(ra, "a", "left").join(rb, "b", "left").where(x != y).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct())


def _inside(unit: np.ndarray, post: np.ndarray, threshold: float) -> np.ndarray | None:
    """How many others of one cluster the index shows each member; None where a pair is below the threshold."""
    seen = np.zeros(len(unit), dtype=np.int64)
    for i in range(0, len(unit), vectors.TILE):
        a = np.arange(i, min(i + vectors.TILE, len(unit)))
        others = a[:, None] < np.arange(len(unit))[None, :]
        if ((unit[a] @ unit.T).round(9) < threshold)[others].any():
            return None
        r, c = np.nonzero(others)
        r = a[r]
        share = vectors.share_list(post[r], post[c], 1 << 15)
        seen += np.bincount(r[share], minlength=len(unit)) + np.bincount(c[share], minlength=len(unit))
    return seen


def linkage(units: DataFrame, edges: DataFrame, degrees: DataFrame, threshold: float, local_nodes: int = LOCAL_NODES) -> DataFrame:
    """(node, root, avg, seen, whole) of every node with an edge.

    units has unit, space, copies, vec, perm, q; edges a < b; degrees unit, partners.
    avg: average cosine to the records of its cluster.  whole: every two members are at
    the threshold or more; seen: how many of the others the index shows.  avg, seen and
    whole are null where a cluster was not put together inside one task.
    """
    roots = components(edges)
    sizes = roots.groupBy("root").agg(F.count("*").alias("k"))
    big = cut(sizes.where(F.col("k") > local_nodes).select("root"))
    # A node with more partners than links may have a cluster partner that the edges do not show.
    info = cut(roots.join(degrees.select(F.col("unit").alias("node"), (F.col("partners") > LINKS).alias("open")), "node", "left").fillna(False, ["open"]))
    placed = units.select(F.col("unit").alias("node"), "space", F.col("copies").alias("n"), "vec", "perm", "q").join(info, "node")
    tagged = edges.join(roots.select(F.col("node").alias("a"), "root"), "a")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    small = (
        placed.join(F.broadcast(big), "root", "left_anti").select("root", F.lit(0).alias("kind"), F.col("node").alias("a"), none("long", "b"), "space", "n", "vec", "perm", "q", "open")
        .unionByName(tagged.join(F.broadcast(big), "root", "left_anti").select("root", F.lit(1).alias("kind"), "a", "b", none("string", "space"), none("long", "n"), none("binary", "vec"), none("binary", "perm"), none("int", "q"), none("boolean", "open")))
    )  # fmt: skip  # a big component has more than LOCAL_NODES nodes, so ``big`` has a row for each of these at most

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["root"]):
            border = int(np.searchsorted(t["kind"].combine_chunks().to_numpy(), 1))
            own, links = t.slice(0, border), t.slice(border)
            ids = own["a"].combine_chunks().to_numpy()  # in order
            near = np.zeros((border, border), dtype=bool)
            i, j = np.searchsorted(ids, links["a"].combine_chunks().to_numpy()), np.searchsorted(ids, links["b"].combine_chunks().to_numpy())
            near[i, j] = near[j, i] = True
            size, unit = own["n"].combine_chunks().to_numpy(), vectors.unit_rows(own["vec"].combine_chunks())
            post = rows_of_binary(own["perm"].combine_chunks(), np.int16)[:, : own["q"][0].as_py()]
            open_, space = np.array(own["open"].to_pylist()), own["space"][0].as_py()
            root = rounds(unit * size[:, None], size, near, threshold)
            avg, seen, whole = np.empty(border), np.zeros(border, dtype=np.int64), np.ones(border, dtype=bool)
            number, sums = np.zeros(border, dtype=np.int64), [None] * border
            for at in np.unique(root):
                here = np.flatnonzero(root == at)
                total = (unit[here] * size[here, None]).sum(axis=0)
                number[at] = size[here].sum()
                avg[here] = unit[here] @ total / number[at]
                if open_[here].any():
                    sums[at] = total.tobytes()
                inside = _inside(unit[here], post[here], threshold)
                if inside is None:
                    whole[here] = False
                else:
                    seen[here] = inside
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(ids[root]), pa.array(avg), pa.array(seen), pa.array(whole), pa.array([space] * border), pa.array(number), pa.array(sums, pa.binary())],
                ["node", "root", "avg", "seen", "whole", "space", "n", "sums"],
            )

    solved = cut(small.repartition("root").sortWithinPartitions("root", "kind", "a").mapInArrow(solve, "node long, root long, avg double, seen long, whole boolean, space string, n long, sums binary"))
    # Clusters that may have a partner the edges do not show: with their sizes and sums.
    hidden = solved.where("sums is not null").select("node", "space", "n", "sums")
    state = solved.select("node", "root", "avg", "seen", "whole")
    if not big.isEmpty():
        mine = cut(_weighed(placed.join(F.broadcast(big), "root", "left_semi")))
        far, left = link(mine, tagged.join(F.broadcast(big), "root", "left_semi").select("a", "b"), threshold)
        far = mine.select("node").join(far, "node", "left").withColumn("root", F.coalesce("root", "node"))
        wanting = far.join(info.where("open").select("node"), "node", "left_semi").select(F.col("root").alias("node")).distinct()
        hidden = hidden.unionByName(left.join(wanting, "node", "left_semi"))
        state = state.unionByName(far.select("node", "root", none("double", "avg"), none("long", "seen"), none("boolean", "whole")))
    hidden, up = cut(hidden), None
    while not hidden.isEmpty():
        step, hidden = link(hidden, _similar_means(hidden, threshold), threshold)
        if step.isEmpty():
            break
        up = cut(_followed(up, step))
    if up is not None:
        moved = up.select(F.col("node").alias("root"), F.col("root").alias("to")).unionByName(up.select("root", F.col("root").alias("to")).distinct())
        kept = F.col("to").isNull()
        state = state.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"), *[F.when(kept, F.col(c)).alias(c) for c in ("avg", "seen", "whole")])
    return cut(state)


def _similar_means(nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the LINKS nearest clusters of each by the cosine of their means, at the threshold or more."""

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = [np.frombuffer(x, np.float64) / n for x, n in zip(b.column("sums").to_pylist(), b.column("n").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("space"), pa.array([v.astype(np.float32) for v in vec], pa.list_(pa.float32()))], ["id", "model", "v"])

    index = vectors.prepared(nodes.mapInArrow(means, "id long, model string, v array<float>"), "id", "v", "model")
    # Equal means are one unit of the index; single precision is met by a threshold a little lower.
    same = cut(vectors.copies(index))
    near = vectors.best_links(vectors.compare_lists(vectors.units(index, same), threshold - 1e-5, LINKS), LINKS)
    pairs = near.select(F.col("src").alias("x"), F.col("dst").alias("y")).unionByName(same.select(F.col("unit").alias("x"), F.col("id").alias("y")))
    return pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


class Links:
    """The indexed vectors and their sparse graph.

    usable: (id, space, digest, vec, perm, posts).  links: (a, b), a < b.  degrees: (unit,
    partners), the number of all distinct vectors at the threshold that the index shows.
    same: (unit, id, n) of the copies.
    """

    def __init__(self, df: DataFrame, threshold: float, id_col: str = "id", vec_col: str = "embedding", model_col: str = "embedding_model") -> None:
        self.threshold = threshold
        self.usable = vectors.one_vector(vectors.prepared(df, id_col, vec_col, model_col))
        self.same = cut(vectors.copies(self.usable))
        self.distinct = vectors.units(self.usable, self.same)
        found = cut(vectors.compare_lists(self.distinct, threshold, LINKS, degrees=True))
        self.degrees = cut(found.where("dst is null").groupBy(F.col("src").alias("unit")).agg(F.sum("cos").cast("long").alias("partners")))
        self.links = cut(vectors.best_links(found, LINKS).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())

    def units(self) -> DataFrame:
        """(unit, space, copies, vec, perm, q) of every distinct vector."""
        return self.distinct.select(F.col("id").alias("unit"), "space", "copies", "vec", "perm", F.size("posts").alias("q"))

    def members(self) -> DataFrame:
        """(unit, root, copies, avg, seen, whole, partners) of every distinct vector with a link or a copy."""
        state = linkage(self.units(), self.links, self.degrees, self.threshold).withColumnRenamed("node", "unit")
        many = self.same.where("id = unit").select("unit", F.col("n").alias("copies"))
        alone = many.select("unit").join(state, "unit", "left_anti").select("unit", F.col("unit").alias("root"), F.lit(1.0).alias("avg"), F.lit(0).cast("long").alias("seen"), F.lit(True).alias("whole"))
        return state.unionByName(alone).join(many, "unit", "left").join(self.degrees, "unit", "left").fillna(1, ["copies"]).fillna(0, ["partners"])

    def rows(self, members: DataFrame) -> DataFrame:
        """(root, unit, id): the members (root, unit) with every copy of their vectors."""
        return members.select("root", "unit").join(self.same.select("unit", "id"), "unit", "left").select("root", "unit", F.coalesce("id", "unit").alias("id"))


def clusters(df: DataFrame, threshold: float = 0.80, typical: int = 3, label_col: str = "subject", **cols: str) -> DataFrame:
    """(cluster_id, size, typical): clusters of two records or more.

    cluster_id is the smallest id; typical lists up to ``typical`` records as
    (id, label), those with the highest average cosine to the records of the cluster
    first, ties to the smaller id.  Records without a usable vector, or without a
    partner, are in no cluster; an id with several vectors takes part with one of them.
    """
    g = Links(df, threshold, **cols)
    members = cut(g.members())
    far = members.where("avg is null").select("unit", "root")  # put together by jobs: their averages from the sums
    own = cut(g.units().join(far, "unit").select(F.col("unit").alias("node"), "root", "space", F.col("copies").alias("n"), "vec"))
    whole = cut(_added(_weighed(own.select(F.col("root").alias("node"), "space", "n", "vec"))))
    both = _weighed(own).join(own.select("node", "root"), "node").select("root", F.col("node").alias("a"), F.col("n").alias("na"), F.col("sums").alias("sa")).join(whole.select(F.col("node").alias("root"), F.col("n").alias("nb"), F.col("sums").alias("sb")), "root")
    late = both.select(F.col("root").alias("b"), "a", "na", "nb", "sa", "sb").mapInArrow(_product, "a long, b long, avg double").select(F.col("a").alias("unit"), F.col("b").alias("root"), "avg")
    near = members.where("avg is not null").select("unit", "root", "avg").unionByName(late)
    several = members.groupBy("root").agg(F.sum("copies").alias("records")).where("records > 1").select("root")
    near = cut(near.join(several, "root", "left_semi"))
    rows = g.rows(near).join(near.select("unit", "avg"), "unit").select("root", "id", "avg")
    size = rows.groupBy("root").agg(F.count("*").alias("size"), F.min("id").alias("cluster_id"))
    order = Window.partitionBy("root").orderBy(F.desc(F.round("avg", 8)), "id")
    top = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= typical)
    id_col = cols.get("id_col", "id")
    labels = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label")).groupBy("id").agg(F.min("label").alias("label"))
    top = top.join(labels, "id", "left").groupBy("root").agg(F.array_sort(F.collect_list(F.struct("place", "id", "label"))).alias("t"))
    return size.join(top, "root").select("cluster_id", "size", F.transform("t", lambda x: F.struct(x["id"].alias("id"), x["label"].alias("label"))).alias("typical"))


def _in_cells(rows: DataFrame, sizes: DataFrame, by: str) -> DataFrame:
    """rows (root, ...) with block, and one row for each cell (lo, hi) of blocks that the row takes part in; sizes has root, n."""
    laid = rows.join(sizes.select("root", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "root").withColumn("block", F.pmod(F.xxhash64(by, F.lit("cell")), F.col("blocks")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("lo"), F.greatest(x, F.col("block")).alias("hi")))
    return laid.select(*rows.columns, "block", F.explode(cells).alias("cell")).select(*rows.columns, "block", "cell.lo", "cell.hi")


def _checked(members: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """(root, unit, n): for each member (root, unit, vec, perm, q) how many others of its cluster the index shows it; a null unit where a pair is below the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["root", "lo", "hi"]):
            root, lo, hi, q = (t[x][0].as_py() for x in ("root", "lo", "hi", "q"))
            units, block = t["unit"].combine_chunks().to_numpy(), t["block"].combine_chunks().to_numpy()
            vec, post = vectors.unit_rows(t["vec"].combine_chunks()), rows_of_binary(t["perm"].combine_chunks(), np.int16)[:, :q]
            left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
            seen, closed = np.zeros(len(units), dtype=np.int64), True
            for i in range(0, len(left), vectors.TILE):
                a = left[i : i + vectors.TILE]
                others = (a[:, None] < right[None, :]) if lo == hi else np.ones((len(a), len(right)), dtype=bool)
                if ((vec[a] @ vec[right].T).round(9) < threshold)[others].any():
                    closed = False
                    break
                r, c = np.nonzero(others)
                share = vectors.share_list(post[a[r]], post[right[c]], 1 << 15)
                seen += np.bincount(a[r[share]], minlength=len(units)) + np.bincount(right[c[share]], minlength=len(units))
            if closed:
                yield pa.RecordBatch.from_arrays([pa.array([root] * len(units)), pa.array(units), pa.array(seen)], ["root", "unit", "n"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array([root]), pa.nulls(1, pa.int64()), pa.array([1])], ["root", "unit", "n"])

    laid = _in_cells(members.select("root", "unit", "vec", "perm", "q"), sizes, "unit")
    return laid.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi").mapInArrow(check, "root long, unit long, n long")


def closed_pairs(df: DataFrame, threshold: float = 0.80, least: int = 3, **cols: str) -> DataFrame:
    """(id_a, id_b): all pairs of the clusters of ``least`` records or more that are closed.

    Closed: every two members at the threshold or more, and no record outside reaches it
    with a member.  The linkage gives such a group as one cluster, since the average of
    any two parts of it is at the threshold or more and with anything else below.  An
    exact check of the pairs inside follows; a member with more partners at the
    threshold than the index shows inside has one outside.
    """
    g = Links(df, threshold, **cols)
    members = cut(g.members())
    size = members.groupBy("root").agg(F.sum("copies").alias("records"), F.count("*").alias("n"), F.count_if(F.col("whole").isNull()).alias("open"), F.min(F.coalesce("whole", F.lit(True))).alias("whole"))
    size = cut(size.where((F.col("records") >= least) & F.col("whole")))
    known = members.select("root", "unit", "partners", "seen").join(size.where("open = 0").select("root"), "root", "left_semi")
    late = size.where("open > 0")
    if not late.isEmpty():  # clusters put together by jobs are checked in blocks
        own = members.select("root", "unit", "partners").join(late.select("root"), "root", "left_semi")
        inside = cut(_checked(g.units().join(own, "unit"), late, threshold))
        counted = inside.where("unit is not null").groupBy("root", "unit").agg(F.sum("n").alias("seen"))
        good = own.join(inside.where("unit is null").select("root").distinct(), "root", "left_anti")
        known = known.unionByName(good.join(counted, ["root", "unit"]).select("root", "unit", "partners", "seen"))
    known = cut(known)
    closed = known.groupBy("root").agg(F.max(F.col("partners") > F.col("seen")).alias("outside")).where("not outside").select("root").join(size, "root")
    rows = cut(g.rows(known.select("root", "unit").join(closed, "root", "left_semi")).select("root", "id"))
    cells = _in_cells(rows, closed.select("root", F.col("records").alias("n")), "id")
    a = cells.where(F.col("block") == F.col("lo")).select("root", "lo", "hi", F.col("id").alias("x"))
    b = cells.where(F.col("block") == F.col("hi")).select("root", "lo", "hi", F.col("id").alias("y"))
    return a.join(b, ["root", "lo", "hi"]).where("lo < hi or x < y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
