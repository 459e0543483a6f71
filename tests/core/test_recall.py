import random

import pytest
from pyspark.sql import functions as F

from memloom.operators import rank, search, select
from memloom.sources import schema

def now():
    return F.lit("2024-03-01 00:00:00").cast("timestamp")
VEC = "id long, embedding array<float>, embedding_model string"


def _field(spark, scores):
    return spark.createDataFrame([(1, i, i, float(s)) for i, s in enumerate(scores, 1)], "query_id long, id long, pos int, score double")


@pytest.mark.parametrize(("scores", "limit", "kept", "gap"), [
    ([0.7421, 0.7280, 0.7272, 0.4956, 0.4599, 0.4583, 0.4524, 0.4351], 5, 3, True),
    ([0.7421, 0.7280, 0.7272, 0.4956, 0.4599, 0.4583, 0.4524, 0.4351], 8, 3, True),
    ([0.7005, 0.7004, 0.7003, 0.7002, 0.7001, 0.7000], 5, 5, False),
    ([0.75 - i * 1e-3 for i in range(8)] + [0.20] * 6, 5, 5, False),
    ([0.5], 5, 1, False),
])
def test_collapse_golden_fields(spark, scores, limit, kept, gap):
    rows = select.collapse(_field(spark, scores), limit).collect()
    assert len(rows) == kept and all((r["gap"] is not None) == gap for r in rows)


def _python_collapse(scores, limit):
    span = (scores[0] - scores[-1]) or 1.0
    best = None
    for i in range(1, min(limit + 1, len(scores))):
        drop = scores[i - 1] - scores[i]
        if drop >= 0.05 * abs(scores[0]) and (best is None or drop / span > best[0]):
            best = (drop / span, i)
    return min(best[1], limit) if best and best[0] >= 0.18 else min(limit, len(scores))


def test_collapse_equals_plain_python(spark):
    rnd = random.Random(1)
    fields = [sorted((round(rnd.random(), 3) for _ in range(rnd.randint(1, 12))), reverse=True) for _ in range(40)]
    rows = [(q, i, i, s) for q, f in enumerate(fields) for i, s in enumerate(f, 1)]
    got = {r["query_id"]: r["count"] for r in select.collapse(spark.createDataFrame(rows, "query_id long, id long, pos int, score double"), 5).groupBy("query_id").count().collect()}
    assert got == {q: _python_collapse(f, 5) for q, f in enumerate(fields)}


def test_level_pick_equals_plain_python(spark):
    rnd = random.Random(2)
    members = {i: rnd.sample(range(1, 13), rnd.randint(2, 4)) for i in (10, 11, 12)}
    ranked, want = [], {}
    for q in range(25):
        order = rnd.sample(range(1, 13), 8)
        ranked += [(q, i, p, 1.0 - p / 100) for p, i in enumerate(order, 1)]
        covered, kept = set(), []
        for i in order:
            if i in covered or set(members.get(i, ())) & set(kept):
                continue
            kept.append(i)
            covered |= set(members.get(i, ()))
        want[q] = kept
    df = spark.createDataFrame(ranked, "query_id long, id long, pos int, score double")
    derived = spark.createDataFrame([(i, members.get(i)) for i in range(1, 13)], "id long, derived_from array<long>")
    got = {}
    for r in select.level_pick(df, derived).orderBy("query_id", "pos").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == want


def test_serendipity_keeps_the_top_and_repeats(spark):
    rows = [(1, i, i, 1.0 - i / 100, 1.0 - i / 100) for i in range(1, 31)]
    df = spark.createDataFrame(rows, "query_id long, id long, pos int, score double, cosine double")
    first = sorted((r["pos"], r["id"], r["serendipity"]) for r in select.serendipity(df, 5, 0.5, seed=3).collect())
    assert first == sorted((r["pos"], r["id"], r["serendipity"]) for r in select.serendipity(df, 5, 0.5, seed=3).collect())
    assert len(first) == 5 and first[0][:2] == (1, 1) and sum(s for *_, s in first) == 2
    assert all(not r["serendipity"] for r in select.serendipity(df.where("pos <= 5"), 5, 0.5).collect())


@pytest.mark.parametrize("mode", ["rank", "max", "log"])
def test_normalised_weights(spark, mode):
    weights = [0.0] * 12 + [0.05, 0.1, 0.2, 0.4, 4.8, 5.8, None]
    df = spark.createDataFrame([(1, w) for w in weights], "q long, w double").withColumn("n", rank.normalised(F.col("w"), ["q"], mode))
    got = sorted((r["w"] or 0.0, r["n"]) for r in df.collect())
    assert all(0 <= n <= 1 for _, n in got) and got[-1][1] == 1.0
    middle = next(n for w, n in got if w == 0.4)
    assert (0.5 < middle < 1) if mode == "rank" else middle < 0.4
    assert spark.createDataFrame([(1, 0.0)], "q long, w double").select(rank.normalised(F.col("w"), ["q"], mode).alias("n")).first()["n"] == 0.0


def test_unknown_policy_terms_fail():
    with pytest.raises(ValueError, match="unknown policy"):
        rank.Policy().override(use_bonsu=1.0)


def test_search_skips_unusable_vectors_and_breaks_ties_by_id(spark):
    rows = [(1, [1.0, 0.0], "m"), (2, [2.0, 0.0], "m"), (3, None, "m"), (4, [0.0, 0.0], "m"), (5, [float("nan"), 1.0], "m"), (6, [1.0, 0.0, 0.0], "m"), (7, [1.0, 0.0], "n"), (8, [0.0, 1.0], "m"), (9, [1.0, 0.0], None), (2, [2.0, 0.0], "m")]
    df = spark.createDataFrame(rows, VEC)
    asked = spark.createDataFrame([(100, [1.0, 0.0], "m"), (101, None, "m"), (102, [0.0, 0.0], "m")], "query_id long, embedding array<float>, embedding_model string")
    got = [(r["query_id"], r["id"], r["pos"], r["cosine"]) for r in search.top_k(df, asked, 3).orderBy("query_id", "pos").collect()]
    assert got == [(100, 1, 1, 1.0), (100, 2, 2, 1.0), (100, 8, 3, 0.0)]
    assert search.top_k(df.limit(0), asked, 3).count() == 0 and search.top_k(df, asked.limit(0), 3).count() == 0


def test_search_in_several_query_blocks(spark, monkeypatch):
    rows = [(i, [float(i % 5) + 1, float(i % 7)], "m") for i in range(1, 60)]
    df = spark.createDataFrame(rows, VEC)
    asked = df.withColumnRenamed("id", "query_id")
    want = sorted(map(tuple, search.top_k(df, asked, 4).collect()))
    monkeypatch.setattr(search, "QUERY_BYTES", 100)
    monkeypatch.setattr(search, "BLOCKS_A_SCAN", 3)
    monkeypatch.setattr(search, "ROWS", 5)
    assert sorted(map(tuple, search.top_k(df, asked, 4).collect())) == want


def test_repeated_ids_take_one_place(spark):
    rows = [(1, [1.0, 0.01 * i], "m") for i in range(20)] + [(2, [1.0, 0.5], "m"), (3, [0.5, 1.0], "m"), (4, [-1.0, 0.0], "m")]
    asked = spark.createDataFrame([(100, [1.0, 0.0], "m")], "query_id long, embedding array<float>, embedding_model string")
    got = search.top_k(spark.createDataFrame(rows, VEC).coalesce(1), asked, 3).orderBy("pos").collect()
    assert [(r["id"], r["pos"]) for r in got] == [(1, 1), (2, 2), (3, 3)] and got[0]["cosine"] == 1.0


def test_filters_resolve_aliases_and_keep_null_origins(spark):
    m = spark.createDataFrame([(1, "a", "x", None), (2, "b", "x", "recycle"), (3, "a", "y", "discovery")], "id long, project string, tier string, origin string")
    aliases = spark.createDataFrame([("AA", "a")], "alias string, canonical string")
    assert {r["id"] for r in search.narrowed(m, aliases, project="AA").collect()} == {1, 3}
    assert {r["id"] for r in search.narrowed(m, aliases, project="b", tiers="x").collect()} == {2}
    assert {r["id"] for r in m.where(search.not_recycled(F.col("origin"))).collect()} == {1, 3}


def test_schema_round_trip(spark):
    df = spark.createDataFrame([], schema.MEMORIES)
    assert search.active(df, now()).count() == 0 and schema.violations(df).count() == 0


def test_near_projects_may_start_with_another_letter(spark):
    import difflib

    from memloom.operators import projects

    known, typed = ["orchard-observer", "hidden-library", "copper-bridge", "mill"], ["0rchard observer", "repo hidden library", "copper bridges", "mills", "unlike"]
    registry = spark.createDataFrame([(k, k, None, None) for k in known], "slug string, display_name string, notes string, created_at timestamp")
    names = spark.createDataFrame([(t,) for t in typed], "project string")
    aliases = spark.createDataFrame([], "alias string, canonical string, created_at timestamp")
    got = {(r["slug"], r["near"]) for r in projects.ensured(registry, names, aliases, now())[1].collect()}
    assert got == {(s, k) for s in (t.replace(" ", "-") for t in typed) for k in known if difflib.SequenceMatcher(None, s, k).ratio() >= 0.82} and ("0rchard-observer", "orchard-observer") in got
