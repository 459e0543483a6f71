import random

import numpy as np
import pytest

from memloom.llm import clusters, vectors

KIND = "id long, embedding array<float>, embedding_model string, subject string, extra string"


def _rows(seed=1, groups=12, dim=16):
    rnd = np.random.default_rng(seed)
    rows, i = [], 1
    for g in range(groups):
        centre = rnd.normal(size=dim)
        for _ in range(int(rnd.integers(1, 9))):
            v = centre + rnd.normal(size=dim) * (0.05 if g % 3 else 0.45)
            rows.append((i, (v * rnd.uniform(0.5, 3)).astype("float32").tolist(), "m", f"s{i}", "x"))
            i += 1
    copy = rows[3]
    rows += [(i + k, copy[1], "m", f"c{k}", "x") for k in range(9)]
    rows += [(i + 20, None, None, None, None), (i + 21, [0.0] * dim, "m", "zero", None), (i + 22, [float("nan")] * dim, "m", None, None), (i + 23, [float("inf")] + [1.0] * (dim - 1), "m", None, None), (i + 24, copy[1], "other", "n", None), (i + 25, copy[1][:5], "m", "short", None), (i + 26, [], "m", "empty", None), (None, copy[1], "m", "no id", None), (i + 27, copy[1], None, "no model", None)]
    random.Random(seed).shuffle(rows)
    return rows


def _alike(rows):
    """{id: [(cosine, other)]} of all usable pairs at 0.80 or more."""
    rows = [r for r in rows if r[0] is not None]
    good = [(i, np.array(v, dtype=np.float32).astype(float), m) for i, v, m, *_ in rows if v and m]
    good = [x for x in good if np.isfinite(x[1]).all() and (x[1] != 0).any()]
    out = {}
    for i, v, m in good:
        for j, w, n in good:
            if i != j and m == n and len(v) == len(w):
                c = round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 9)
                if c >= 0.8:
                    out.setdefault(i, []).append((-c, j))
    return {k: sorted(v) for k, v in out.items()}


def test_nearest_equals_brute_force(spark):
    rows = _rows()
    want = {tuple(sorted((i, j))) for i, l in _alike(rows).items() for _, j in l[:5]}
    df = spark.createDataFrame(rows, KIND)
    near = vectors.nearest(df)
    got = {(r["id_a"], r["id_b"]) for r in vectors.nearest_pairs(near).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    assert all(r["place"] <= 5 for r in near.collect())


@pytest.mark.parametrize("block", [vectors.BLOCK, 3])
def test_hot_lists_in_blocks_give_the_same(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "TILE", 2)
    rows = _rows(5)
    want = {tuple(sorted((i, j))) for i, l in _alike(rows).items() for _, j in l[:5]}
    got = {(r["id_a"], r["id_b"]) for r in vectors.nearest_pairs(vectors.nearest(spark.createDataFrame(rows, KIND))).collect()}
    assert len(got ^ want) <= 0.05 * len(want)


def test_distinct_vectors_move_only_where_copies_are_many(spark, monkeypatch):
    rows = vectors.one_vector(vectors.prepared(spark.createDataFrame(_rows(7), KIND)))
    same = vectors.cut(vectors.copies(rows))
    near = vectors.units(rows, same)
    assert "hashpartitioning" not in near._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(vectors, "BROADCAST_ROWS", 0)
    by = ("digest", "id", "copies", "space", "vec", "perm", "posts")
    a, b = ({tuple(map(str, r)) for r in x.select(*by).collect()} for x in (near, vectors.units(rows, same)))
    assert a == b and len(a) == near.count() < rows.count()


def test_footrule_similarity():
    rnd = np.random.default_rng(0)
    a, b = (np.array([rnd.permutation(20)[:8] for _ in range(6)], dtype=np.int32) for _ in range(2))
    sim = vectors._footrule_similarity(a, b)
    for i in range(6):
        for j in range(6):
            place = lambda row, p: list(row).index(p) if p in row else 8
            foot = sum(abs(place(a[i], p) - place(b[j], p)) for p in range(20))
            assert foot == 8 * 9 - 2 * sim[i, j]


def _closed(rows):
    alike = {k: {j for _, j in v} for k, v in _alike(rows).items()}
    out, seen = set(), set()
    for i in alike:
        if i in seen:
            continue
        comp, todo = {i}, [i]
        while todo:
            for j in alike[todo.pop()]:
                if j not in comp:
                    comp.add(j)
                    todo.append(j)
        seen |= comp
        if len(comp) >= 3 and all(len(alike[x]) == len(comp) - 1 for x in comp):
            out |= {(a, b) for a in comp for b in comp if a < b}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_closed_clusters_equal_brute_force(spark, seed):
    rows = _rows(seed)
    got = {(r["id_a"], r["id_b"]) for r in clusters.closed_pairs(spark.createDataFrame(rows, KIND)).collect()}
    assert got == _closed(rows)


def test_clusters_have_size_and_typical_members(spark):
    rows = [(1, [1.0, 0.0], "m", "a", None), (2, [1.0, 0.1], "m", "b", None), (3, [1.0, 0.2], "m", "c", None), (9, [0.0, 1.0], "m", "alone", None), (4, [-1.0, 0.0], "m", None, None), (5, [-1.0, 0.0], "m", None, None)]
    got = {r["cluster_id"]: (r["size"], [tuple(t) for t in r["typical"]]) for r in clusters.clusters(spark.createDataFrame(rows, KIND), typical=2).collect()}
    assert got == {1: (3, [(2, "b"), (3, "c")]), 4: (2, [(4, None), (5, None)])}


def _linkage(vecs, weights, threshold):
    """Average linkage over all pairs, one best merge at a time."""
    unit = vecs / np.linalg.norm(vecs, axis=1)[:, None]
    parts = [[i] for i in range(len(vecs))]
    while True:
        best = None
        for x in range(len(parts)):
            for y in range(x + 1, len(parts)):
                a, b = ((unit[p] * weights[p][:, None]).sum(axis=0) / weights[p].sum() for p in (parts[x], parts[y]))
                avg = round(float(a @ b), 9)
                if avg >= threshold and (best is None or avg > best[0]):
                    best = (avg, x, y)
        if best is None:
            return {tuple(sorted(p)) for p in parts if len(p) > 1}
        parts[best[1]] += parts.pop(best[2])


def _chain(seed, n=40, dim=6):
    """Vectors along drifting paths: components, single linkage and average linkage differ."""
    rnd = np.random.default_rng(seed)
    out = [rnd.normal(size=dim)]
    for i in range(n - 1):
        out.append(rnd.normal(size=dim) if i % 10 == 9 else out[-1] / np.linalg.norm(out[-1]) + rnd.normal(size=dim) * 0.18)
    return np.array(out).astype("float32")


def _parts(rows, roots):
    up = {r["node"]: r["root"] for r in roots.collect()}
    out = {}
    for i in rows:
        out.setdefault(up.get(i, i), []).append(i)
    return {tuple(sorted(p)) for p in out.values() if len(p) > 1}


@pytest.mark.parametrize(("seed", "local", "links"), [(1, 2000, 32), (2, 0, 32), (3, 2000, 3)])
def test_average_linkage_equals_brute_force(spark, monkeypatch, seed, local, links):
    monkeypatch.setattr(clusters, "LINKS", links)
    v = _chain(seed)
    df = spark.createDataFrame([(i, x.tolist(), "m") for i, x in enumerate(v)], "id long, embedding array<float>, embedding_model string")
    g = clusters.Links(df, 0.8)
    got = _parts(range(len(v)), clusters.linkage(g.units(), g.links, g.degrees, 0.8, local_nodes=local))
    want = _linkage(v.astype(float), np.ones(len(v)), 0.8)
    together = {tuple(sorted(x)) for x in _parts(range(len(v)), clusters.components(g.links))}
    assert got == want and got != together


def test_a_mean_below_the_threshold_stops_a_merge(spark):
    # Pairs {0, 1} and {2, 3}; only 1 and 2 reach 0.80 across, so components join all four.
    at = [0.0, 0.1, 0.7, 0.95]
    rows = [(i, [float(np.cos(x)), float(np.sin(x))], "m", f"s{i}", None) for i, x in enumerate(at)]
    got = {r["cluster_id"]: r["size"] for r in clusters.clusters(spark.createDataFrame(rows, KIND)).collect()}
    assert got == {0: 2, 2: 2}


def test_clusters_in_blocks_give_the_same(spark, monkeypatch):
    rows = _rows(6)
    want = {tuple(r) for r in clusters.closed_pairs(spark.createDataFrame(rows, KIND)).collect()}
    monkeypatch.setattr(clusters, "BLOCK", 2)
    assert {tuple(r) for r in clusters.closed_pairs(spark.createDataFrame(rows, KIND)).collect()} == want == _closed(rows)


def test_repeated_ids_take_part_once(spark):
    rows = [(1, [1.0, 0.0], "m", "a", None), (1, [1.0, 0.0], "m", "a", None), (1, [0.0, 1.0], "m", "b", None), (2, [1.0, 0.1], "m", "c", None), (3, [0.1, 1.0], "m", "d", None)]
    df = spark.createDataFrame(rows, KIND)
    assert vectors.nearest(df).where("id = neighbour").isEmpty() and clusters.clusters(df).agg({"size": "sum"}).first()[0] <= 3


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 12)] + [(20, 21), (30, 30)], "a long, b long")
    assert {r["node"]: r["root"] for r in clusters.components(edges).collect()} == {**{i: 1 for i in range(1, 13)}, 20: 20, 21: 20}


def test_empty_tables(spark):
    df = spark.createDataFrame([], KIND)
    assert vectors.nearest(df).count() == 0 and clusters.closed_pairs(df).count() == 0 and clusters.clusters(df).count() == 0
    nulls = spark.createDataFrame([(1, None, None, None, None), (None, None, "m", None, None)], KIND)
    assert vectors.nearest(nulls).count() == 0


def test_neighbours_in_one_hot_group_are_all_found(spark):
    rnd = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    hot = unit(rnd.normal(size=64)) * 0.85**0.5 + unit(rnd.normal(size=(2000, 64))) * 0.15**0.5
    v = np.concatenate([hot, rnd.normal(size=(4000, 64))]).astype("float32")
    df = spark.createDataFrame([(i, x.tolist(), "m") for i, x in enumerate(v)], "id long, embedding array<float>, embedding_model string")
    u = unit(v.astype(float))
    cos = (u @ u.T).round(9)
    np.fill_diagonal(cos, -1)
    want = {(min(i, int(j)), max(i, int(j))) for i in range(len(v)) for j in np.lexsort((np.arange(len(v)), -cos[i]))[:5] if cos[i, j] >= 0.8}
    got = {(r["id_a"], r["id_b"]) for r in vectors.nearest_pairs(vectors.nearest(df)).collect()}
    assert len(want) > 5000 and len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)


def test_pivots_lie_apart():
    rnd = np.random.default_rng(5)
    unit = lambda x: (x / np.linalg.norm(x, axis=-1, keepdims=True)).astype(np.float32)
    rows = unit(np.concatenate([rnd.normal(size=64) + 0.2 * rnd.normal(size=(900, 64)), rnd.normal(size=(600, 64))]))
    p = vectors.spread(rows, 400)
    near = p @ p.T
    np.fill_diagonal(near, 0)
    assert len(p) == 400 and near.max() < vectors.PIVOT_COSINE


@pytest.mark.xfail(reason="the index misses some single links at 0.81 to the outside; exact only where every two vectors were compared")
def test_a_cluster_with_any_link_to_the_outside_is_open(spark):
    rnd = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centre, side = unit(rnd.normal(size=(3200, 64))), rnd.normal(size=(3200, 64))
    side = unit(side - (side * centre).sum(axis=1)[:, None] * centre)
    outside = 0.81 * centre + (1 - 0.81**2) ** 0.5 * side  # at 0.81 to the first member
    v = np.concatenate([centre, centre - 0.1 * side, centre - 0.2 * side, outside, np.eye(64)[:1] + [[0.0] * 63 + [0.1 * i] for i in range(3)]]).astype("float32")
    df = spark.createDataFrame([(i, x.tolist(), "m") for i, x in enumerate(v)], "id long, embedding array<float>, embedding_model string")
    assert {(r["id_a"], r["id_b"]) for r in clusters.closed_pairs(df).collect()} == {(12800, 12801), (12800, 12802), (12801, 12802)}
