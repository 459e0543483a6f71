import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from memloom.operators import doorways, evaluate, events, graph, ingest, jsonfold, lifecycle, loops, projects, quality, topics
from memloom.plans import maintain
from memloom.sources import providers, schema, state
from memloom.sources.state import State

def now():
    return F.lit("2024-03-01 00:00:00").cast("timestamp")
T = dt.datetime(2024, 1, 1)


def memories(spark, rows):
    """Rows as dicts; missing columns are null."""
    names = [f.split(" ")[0] for f in spark.createDataFrame([], schema.MEMORIES).columns]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema.MEMORIES)


def test_activation_equals_plain_python(spark):
    rnd = random.Random(4)
    edges = {(rnd.randrange(10), rnd.randrange(10)): rnd.random() for _ in range(30)}
    edges = {k: v for k, v in edges.items() if k[0] != k[1]}
    df = spark.createDataFrame([(a, b, "semantic", s) for (a, b), s in edges.items()], "from_id long, to_id long, link_type string, strength double")
    m = memories(spark, [{"id": i, "archived": i == 9} for i in range(10)])
    total, frontier = {}, {0: 1.0}
    for hop in range(2):
        new = {}
        for n, level in frontier.items():
            for (a, b), s in edges.items():
                for x, y in ((a, b), (b, a)):
                    p = level * s * 0.5 ** (hop + 1)
                    if x == n and p >= 1e-4:
                        new[y] = new.get(y, 0) + p
        frontier = new
        for k, v in new.items():
            total[k] = total.get(k, 0) + v
    total.pop(0, None)
    want = {k: v for k, v in sorted(total.items(), key=lambda x: -x[1])[:10] if k != 9}
    got = {r["id"]: r["activation"] for r in graph.activate(df, spark.createDataFrame([(1, 0)], "group long, node long"), m).collect()}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}


def test_compaction_in_parts_restarts_or_continues_the_series(spark):
    log = spark.createDataFrame([(i, 1, 2, "semantic", 1.0, T) for i in range(4)] + [(9, 3, 3, "semantic", 1.0, T), (10, 1, None, "semantic", 1.0, T)], schema.LOG)
    first, rest = log.where("id < 2"), log.where("id >= 2")
    whole = graph.compact(log).first()
    assert whole["hop_count"] == 4 and whole["strength"] == pytest.approx(1 / 2 + 1 / 3 + 1 / 4 + 1 / 5)
    assert graph.compact(rest, graph.compact(first), continue_series=True).first()["strength"] == pytest.approx(whole["strength"])
    assert graph.compact(rest, graph.compact(first)).first()["strength"] == pytest.approx(2 * (1 / 2 + 1 / 3))


def test_strengthen_used_failed(spark):
    m = memories(spark, [{"id": 1, "access_count": 0, "weight": 0.0}, {"id": 2, "access_count": 3, "weight": 0.02}])
    hit = spark.createDataFrame([(1,), (1,)], "id long")
    r = {x["id"]: x for x in lifecycle.strengthen(m, hit, now()).collect()}
    assert r[1]["weight"] == pytest.approx(1 / 2 + 1 / 3) and r[1]["access_count"] == 2 and r[2]["weight"] == 0.02
    u = {x["id"]: x for x in lifecycle.used(m, hit).collect()}
    assert u[1]["success_count"] == 1 and u[1]["weight"] == pytest.approx(0.5)
    f = {x["id"]: x for x in lifecycle.failed(m, spark.createDataFrame([(2,)], "id long")).collect()}
    assert f[2]["weight"] == 0.0 and f[2]["fail_count"] == 1


def test_decay_archives_and_age_alone_closes_nothing(spark):
    m = memories(spark, [{"id": 1, "access_count": 1, "weight": 0.005, "last_accessed": T}, {"id": 2, "access_count": 0, "weight": 0.0, "created_at": T - dt.timedelta(days=400)}, {"id": 3}])
    assert {r["id"]: r["archived"] for r in lifecycle.decay_nodes(m, now()).collect()} == {1: True, 2: False, 3: False}
    assert {r["id"]: r["archived"] for r in lifecycle.archive_unused(m, now()).collect()} == {1: False, 2: True, 3: False}
    lp = spark.createDataFrame([(1, "a", None, "Open", T, None, None, None), (2, "b", None, "closed", T, None, None, "x")], schema.LOOPS)
    aged = {r["memory_id"]: r["status"] for r in loops.aged_out(lp, now()).collect()}
    assert aged == {1: "dismissed", 2: "closed"}
    assert loops.closed_one(loops.closed_one(lp, 1, "done", now()), 1, "again", now()).where("memory_id = 1").first()["close_reason"] == "done"


def test_upsert_refreshes_keeps_and_numbers(spark):
    m = memories(spark, [{"id": 1, "node_key": "k", "body": "old", "project": "p", "archived": True, "subject": "s"}, {"id": 2, "node_key": None, "body": "x"}])
    new = memories(spark, [{"id": 7, "node_key": "k", "body": "newer", "project": "q"}, {"id": 6, "node_key": "k", "body": "new"}, {"id": 8, "node_key": "z", "body": "z1"}, {"id": 9, "body": "free"}])
    out = {r["id"]: r for r in ingest.upsert(m, new).collect()}
    assert sorted(out) == [1, 2, 3, 4]
    assert (out[1]["body"], out[1]["project"], out[1]["archived"], out[1]["subject"]) == ("newer", "p", False, "s")
    assert {out[3]["body"], out[4]["body"]} == {"z1", "free"}


def test_exchanges_once(spark):
    m = memories(spark, [{"id": 2, "exchange_id": "a"}, {"id": 1, "exchange_id": "a"}, {"id": 3}, {"id": 4, "exchange_id": "b"}])
    assert {r["id"] for r in ingest.first_of_exchange(m, memories(spark, [{"id": 99, "exchange_id": "b"}])).collect()} == {1, 3}


def test_fold_and_unfold(spark):
    whole = {"shop": {"name": "x", "open": True, "tables": 4, "days": ["mo", {"tu": None}], "empty": {}}}
    rows = spark.createDataFrame([(1, json.dumps(whole)), (2, "{"), (3, None), (4, "5"), (5, '{"k": "[REDACTED_PRIVATE_KEY]"}')], "id long, j string")
    leaves = jsonfold.fold(rows, "id", "j")
    assert {r["path"]: r["value"] for r in leaves.where("id = 1").collect()} == {"shop.name": '"x"', "shop.open": "true", "shop.tables": "4", "shop.days[0]": '"mo"', "shop.days[1].tu": "null"}
    back = {r["id"]: r for r in jsonfold.unfold(leaves, "id").collect()}
    assert json.loads(back[1]["json"]) == {"shop": {"name": "x", "open": True, "tables": 4, "days": ["mo", {"tu": None}]}} and json.loads(back[4]["json"]) == 5
    assert back[5]["redacted"] == ["k"] and set(back) == {1, 4, 5}
    assert jsonfold.fold(rows, "id", "j", max_nodes=2).where("id = 1").count() == 2
    deep = "".join('{"a": [' for _ in range(12)) + "7" + "]}" * 12
    got = jsonfold.fold(spark.createDataFrame([(1, deep)], "id long, j string"), "id", "j").collect()
    assert [(r["path"], r["value"]) for r in got] == [(".".join(["a[0]"] * 12), "7")]
    assert jsonfold.steps("a.b[0][12].c") == ["a", "b", 0, 12, "c"]


def test_projects(spark):
    p = spark.createDataFrame([("alpha-beta", "Alpha Beta", None, T)], "slug string, display_name string, notes string, created_at timestamp")
    a = spark.createDataFrame([("AB", "alpha-beta", T), ("alpha-bet", "alpha-beta", T)], "alias string, canonical string, created_at timestamp")
    names = spark.createDataFrame([(1, "AB"), (2, "Alpha  Bet"), (3, "alpha beta"), (4, "nope"), (5, None), (6, "alpha-betas")], "id long, project string")
    assert {r["id"]: r["canonical"] for r in projects.resolved(names, p, a).collect()} == {1: "alpha-beta", 2: "alpha-beta", 3: "alpha-beta", 4: None, 5: None, 6: None}
    all_, near = projects.ensured(p, names, a, now())
    assert {r["slug"] for r in all_.collect()} == {"alpha-beta", "nope", "alpha-betas"} and {r["slug"] for r in near.collect()} == {"alpha-betas"}
    texts = spark.createDataFrame([(1, "x", "about alpha-beta", None), (2, "x", "alphabeta AB.", None), (3, "x", "cab", "own")], "id long, subject string, body string, project string")
    vocab = projects.vocabulary(p, a.where("false").unionByName(spark.createDataFrame([("ABC", "alpha-beta", T)], a.schema)))
    assert {(r["id"], r["canonical"]) for r in projects.mentions(texts, vocab).collect()} == {(1, "alpha-beta")}
    terms = spark.createDataFrame([("one two three four five six seven", "long"), ("a\\eb", "quoted"), ("проект", "letters"), ("_mill", "mark")], "term string, canonical string")
    said = spark.createDataFrame([(1, "One two three four five six SEVEN.", None), (2, None, "x a\\Eb y"), (3, "Проект", ""), (4, "old_mill", None), (5, "seven six", "a b"), (None, "one", None)], "id long, subject string, body string")
    assert {(r["id"], r["canonical"]) for r in projects.mentions(said, terms).collect()} == {(1, "long"), (2, "quoted"), (3, "letters")}
    assert {r["id"]: (r["primary"], r["method"]) for r in projects.classified(texts, vocab).collect()} == {1: ("alpha-beta", "context"), 2: (None, "fallback"), 3: ("own", "context")}
    links = spark.createDataFrame([(1, "p", "odd", 0.5), (1, "p", "mentions", 0.9), (1, "p", "primary", 0.1)], "memory_id long, project string, role string, confidence double")
    got = [(r["role"], r["confidence"]) for r in projects.links_of(projects.linked(links.limit(0), links), spark.createDataFrame([(1,)], "id long")).orderBy("n").collect()]
    assert got == [("primary", 0.1), ("mentions", 0.9)]


def test_events_are_three_valued(spark):
    shown = [(1, 1, 0.9), (2, 3, 0.4)]
    e = spark.createDataFrame([(1, T, "q", None, "s", "cli", shown, None, None, None), (2, T, "q", None, "s", "cli", shown, [], None, None), (2, T, "q", None, "s", "cli", shown, [], None, None), (3, T, "q", None, "s", "cli", [], [1], None, None)], schema.EVENTS)
    f = events.funnel(e).first()
    assert (f["total"], f["judged"], f["nothing_used"], f["used_rows"], f["ready"]) == (3, 2, 1, 1, False)
    marked = events.attributed(events.once(e), spark.createDataFrame([(1, [2, 1, 2], "explicit")], "id long, used array<long>, how string"), now())
    assert marked.where("id = 1").first()["used"] == [1, 2] and events.waiting(marked, now()).count() == 0
    assert events.funnel(e.limit(0)).first()["total"] == 0


def test_doorways_merge_age_and_promote(spark):
    m = memories(spark, [{"id": i, "subject": f"Boat Shed {i}", "project": "p", "embedding": [1.0, float(i)], "created_at": T} for i in range(1, 5)])
    sets = spark.createDataFrame([(1, [2, 1], 0.3), (2, [1, 2], 0.2), (3, [3], 0.5), (4, [3, 4], 0.1), (5, [1, 2], 0.4)], "query_id long, member_ids array<long>, cut_gap double")
    d = doorways.recorded(None, sets, m, now())
    assert [(r["query_count"], r["centroid"], r["member_ids"]) for r in d.collect()] == [(3, [1.0, 1.5], [1, 2])]
    again = doorways.recorded(d, sets.limit(1), m, now())
    assert again.first()["query_count"] == 4 and not doorways.aged(again, m).first()["stale"]
    named = doorways.named(again, m, budget=1)
    assert named.first()["name"] == "boat-shed-1"
    new, members = doorways.promoted(named, spark.createDataFrame([], schema.TOPICS), m)
    assert new.first()["project"] == "p" and members.count() == 2
    assert doorways.promoted(named, new, m)[0].count() == 0


def test_watermarks_are_apart_and_never_go_back(spark):
    m = memories(spark, [{"id": i, "project": "a" if i % 2 else "b"} for i in range(1, 9)] + [{"id": 20, "origin": "recycle"}])
    marks = spark.createDataFrame([("a", 5)], "project string, last_id long")
    assert {r["id"] for r in topics.unread(m, marks).collect()} == {2, 4, 6, 7, 8}
    back = topics.advanced(marks, spark.createDataFrame([("a", 3), ("b", 4)], "mark_of string, id long"))
    assert {r["project"]: r["last_id"] for r in back.collect()} == {"a": 5, "b": 4}


def test_summaries_are_written_once(spark):
    m = memories(spark, [{"id": i, "subject": f"s{i}", "weight": float(i)} for i in range(1, 36)])
    tags = spark.createDataFrame([("t", i) for i in range(1, 36)], "slug string, id long")
    members = topics.summary_members(tags, m)
    due = topics.due_summaries(members, m)
    rows = topics.summary_rows(due, now())
    assert rows.first()["derived_from"] == list(range(6, 36))
    written = memories(spark, [{"id": 99, "node_key": "topic|t", "derived_from": list(range(6, 36)), "origin": "recycle", "created_at": T}])
    assert topics.due_summaries(members, m.unionByName(written)).count() == 0


def test_dream_twice_changes_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    m = memories(spark, [{"id": i, "project": "p", "subject": "s", "body": "the boat shed here"} for i in range(1, 5)])
    empty = State({"memories": m, "doorways": spark.createDataFrame([], schema.DOORWAYS), "topics": spark.createDataFrame([], schema.TOPICS), "tags": spark.createDataFrame([], "slug string, id long"), "marks": spark.createDataFrame([], "project string, last_id long")})
    extract = lambda rows: rows.select("mark_of", "batch_no", "id", F.lit("Boat Shed").alias("term"))
    once, report = maintain.dream(empty, now(), extract, providers.Budget(5))
    state.save(once, spark, root)  # a pass starts from a saved version
    once = state.load(spark, root)
    assert report.counts["unread"] == 4 and once["tags"].count() == 4
    written = {r["node_key"].split("|")[0]: r for r in once["summaries"].collect()}
    stored = once["memories"].where("id > 4").collect()
    assert len(stored) == len(written) and "topic" in written and {r["origin"] for r in stored} == {"recycle"} and once["memories"].count() == 4 + len(written)
    twice, report = maintain.dream(once, now(), extract, providers.Budget(5))
    assert report.counts["unread"] == 0 and twice["tags"].count() == 4 and twice["memories"].count() == once["memories"].count()


def test_versions_switch_whole(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    assert state.load(spark, root).version == 0
    s = State({"memories": memories(spark, [{"id": 1, "project": "p"}])})
    assert state.save(s, spark, root) == 1
    loaded = state.load(spark, root)
    grown = loaded.changed(memories=loaded["memories"].unionByName(memories(spark, [{"id": 2}])))
    assert state.save(grown, spark, root, {"memories": ["project"]}) == 2
    assert state.load(spark, root)["memories"].count() == 2 and state.load(spark, root, 1)["memories"].count() == 1


def test_quality_warnings(spark):
    rows = [{"id": i, "subject": f"release check run of day {i}", "project": "p"} for i in range(1, 10)] + [{"id": 20, "subject": "A quite distinctive subject", "project": "p"}, {"id": 21, "subject": "gs://bucket/some/long/path"}, {"id": 22, "subject": None, "project": "p", "body": "x" * 2500}]
    w = {}
    for r in quality.warnings(memories(spark, rows), now()).collect():
        w.setdefault(r["id"], []).append(r["code"])
    assert w[1] == ["templated_subject"] and 20 not in w and w[21] == ["weak_subject", "no_project"] and w[22] == ["weak_subject", "long_body"]


def test_models_do_not_mix(spark):
    m = memories(spark, [{"id": 1, "embedding_model": "a"}, {"id": 2}])
    assert quality.assert_one_model(m, "a").count() == 2
    with pytest.raises(Exception, match="another model"):
        quality.assert_one_model(m, "b").collect()


def test_bootstrap_and_overlap(spark):
    import numpy as np

    assert evaluate.no_lift(np.array([])) == 1.0
    assert evaluate.no_lift(np.array([1] * 10), 50) == 0.0 and evaluate.no_lift(np.array([0] * 5), 50) == 1.0
    state, states = evaluate.LCG_START, []
    for _ in range(37):
        state = (evaluate.LCG_FACTOR * state + evaluate.LCG_STEP) % 2**64
        states.append(state)
    assert [int(x) for x in evaluate._draws(37)] == states
    cases = spark.createDataFrame([(g, i, i, False, g == "up" or i % 2 == 0) for g in ("up", "half") for i in range(8)], "g string, a int, b int, cold boolean, warm boolean")
    got = {r["g"]: (r["n"], r["cold"], r["warm"], r["no_lift"]) for r in evaluate.lift_test(cases, "g", 100).collect()}
    assert got["up"] == (8, 0.0, 1.0, 0.0) and got["half"][:3] == (8, 0.0, 0.5)
    q = spark.createDataFrame([(1, "the market street façade repair", "Market Street façade job"), (2, "who owns it", "other")], "id long, question string, answer string")
    assert {r["id"]: r["kept"] for r in evaluate.overlap_gate(q).collect()} == {1: False, 2: True}


def test_providers(spark):
    e = providers.HashEmbedder().embed(spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "id long, t string"), "t")
    got = {r["id"]: r["embedding"] for r in e.collect()}
    assert sum(x * x for x in got[1]) == pytest.approx(1.0) and got[2] is None and got[3] is None
    assert providers.answer_text([{"type": "text", "text": "x"}], "end_turn") == "x" and providers.answer_text([{"type": "text", "text": "x"}], "max_tokens") is None
    b = providers.Budget(3)
    assert (b.take(2), b.take(2), b.take()) == (2, 1, 0)


def test_export_numbers_rows_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "ID_RANGE", 3)
    m = memories(spark, [{"id": i} for i in (2, 3, 7, 20)])
    links = spark.createDataFrame([(2, 20), (20, 3), (20, 2), (20, 99)], "from_id long, to_id long")
    assert {r["place"]: r["links"] for r in evaluate.export_index(m, links).collect()} == {0: [3], 1: [], 2: [], 3: [0, 1]}
