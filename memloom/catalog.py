"""The registered queries of the core.  Every query runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.functions import clock, keys, text, vector
from memloom.operators import doorways, evaluate, events, graph, ingest, jsonfold, lifecycle, loops, projects, quality, rank, recall, search, seeds, select, topics
from memloom.sources import providers, schema
from memloom.sources.state import State, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def as_of():
    """The fixed moment that all queries look from."""
    return F.lit("2024-03-01 00:00:00").cast("timestamp")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def _memories(spark: SparkSession, d: str) -> DataFrame:
    return tables(spark, d, "memories")[0]


def _asked(m: DataFrame) -> DataFrame:
    """The stated query set: every row whose id is divisible by 20."""
    return m.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding", "embedding_model")


def _pool(m: DataFrame, k: int = 40) -> DataFrame:
    return search.top_k(search.active(m, as_of()), _asked(m), k).select("query_id", "id", "cosine")


def _lenses(m: DataFrame) -> DataFrame:
    """A lens for every fourth row: the vector of the row after it."""
    after = m.select((F.col("id") - 1).alias("id"), "embedding", "embedding_model")
    return m.where("id % 4 = 0").select("id").join(after, "id").select(F.col("id").alias("lens_id"), F.col("id").alias("memory_id"), F.when(F.col("id") % 3 == 0, "thematic").when(F.col("id") % 3 == 1, "questions").otherwise("vantages").alias("perspective"), "embedding", "embedding_model")


# Scans and recall


@query
def active_rows(spark, d):
    return search.active(_memories(spark, d), as_of()).groupBy("tier").agg(F.count("*").alias("n"))


@query
def recall_topk(spark, d):
    m = _memories(spark, d)
    return search.top_k(search.active(m, as_of()), _asked(m), 10).select("query_id", "id", F.round("cosine", 6).alias("cosine"), "pos")


@query
def recall_filtered(spark, d):
    m, a = tables(spark, d, "memories", "project_aliases")
    pool = search.narrowed(search.active(m, as_of()), a, tiers=["curated", "insight"], noun_type="place").where(search.not_recycled(F.col("origin")))
    return search.top_k(pool, _asked(m), 5).select("query_id", "id", F.round("cosine", 6).alias("cosine"), "pos")


@query
def recall_multi_query(spark, d):
    m = _memories(spark, d)
    return rank.placed(rank.scored(_pool(m), m, as_of()), limit=10).select("query_id", "id", "score", "pos")


@query
def recall_success_term(spark, d):
    m = _memories(spark, d)
    return rank.placed(rank.scored(_pool(m), m, as_of(), rank.LADDER["success"]), limit=5).select("query_id", "id", "score", "pos")


@query
def recall_lens_merge(spark, d):
    m = _memories(spark, d)
    pool = search.active(m, as_of())
    both = search.merged_pool(_pool(m, 20), search.lens_top_k(_lenses(m), pool, _asked(m), 20))
    return both.select("query_id", "id", F.round("cosine", 6).alias("cosine"))


@query
def recall_collapse(spark, d):
    m = _memories(spark, d)
    ranked = rank.placed(rank.scored(_pool(m, 60), m, as_of()))
    return select.collapse(ranked, 5).select("query_id", "id", "pos", "score", F.round("gap", 4).alias("gap"))


@query
def recall_level_pick(spark, d):
    m = _memories(spark, d)
    return select.level_pick(rank.placed(rank.scored(_pool(m), m, as_of())), m).select("query_id", "id", "pos", "score")


@query
def recall_serendipity(spark, d):
    m = _memories(spark, d)
    return select.serendipity(rank.placed(rank.scored(_pool(m, 60), m, as_of())), 5, 0.5).select("query_id", "id", "pos", "serendipity")


@query
def recall_end_to_end(spark, d):
    m = _memories(spark, d)
    return recall.recall(m, _asked(m), as_of(), limit=5, lenses=_lenses(m)).select("query_id", "id", "pos", "score", "status")


@query
def recall_deltas(spark, d):
    m = _memories(spark, d)
    left = recall.deltas(recall.recall(m, _asked(m), as_of(), limit=5), m)
    return left.weights.select("id", "times", F.round("gain", 6).alias("gain"))


@query
def recall_with_associations(spark, d):
    m, log = tables(spark, d, "memories", "memory_links")
    hits = recall.recall(m, _asked(m), as_of(), limit=5)
    return recall.with_associations(hits, graph.compact(log), m)


@query
def recall_by_node_types(spark, d):
    m = _memories(spark, d)
    return recall.by_node_types(m, _asked(m), ["fact", "anchor", "faq"], as_of(), top_k=6).select("query_id", "id", "pos", "score")


@query
def prompt_blocks(spark, d):
    m = _memories(spark, d)
    hits = recall.recall(m, _asked(m), as_of(), limit=12).select("query_id", "id", "pos", "status")
    return providers.prompt_blocks(hits.join(m.select("id", "node_type", "subject", "body"), "id"))


@query
def rank_norm_modes(spark, d):
    m = _memories(spark, d).select("id", "tier", "weight")
    return m.select("id", *[F.round(rank.normalised(F.col("weight"), ["tier"], mode), 6).alias(f"by_{mode}") for mode in ("rank", "max", "log")])


@query
def recency_buckets(spark, d):
    m = _memories(spark, d)
    return m.groupBy(F.round(clock.recency(F.col("last_accessed"), as_of()), 4).alias("recency")).agg(F.count("*").alias("n"))


@query
def temporal_status_sweep(spark, d):
    m = _memories(spark, d)
    return m.groupBy(clock.temporal_status(F.col("temporal_anchor_start"), F.col("temporal_anchor_end"), F.to_date(as_of())).alias("status")).agg(F.count("*").alias("n"))


@query
def due_for_retensing(spark, d):
    return lifecycle.due_for_retensing(_memories(spark, d), as_of())


@query
def near_duplicates(spark, d):
    m = _memories(spark, d)
    return search.near_duplicates(m, m.where("id % 20 = 0"), as_of()).select("id", "other", F.round("cosine", 6).alias("cosine"))


@query
def label_vector_centroids(spark, d):
    e = tables(spark, d, "embeddings")[0]
    c = vector.centroid(e, ["label"])
    return c.select("label", "members", F.posexplode("centroid").alias("pos", "x")).select("label", "members", "pos", F.round("x", 6).alias("x"))


@query
def doorway_match(spark, d):
    e = tables(spark, d, "embeddings")[0]
    ways = vector.centroid(e, ["label"]).select(F.col("label").cast("string").alias("key"), "centroid", F.lit(False).alias("stale"))
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return search.nearest_centroid(asked, ways, 0.3).select("query_id", "key", F.round("cosine", 6).alias("cosine"))


# Graph


@query
def edge_compaction(spark, d):
    e = graph.compact(tables(spark, d, "memory_links")[0])
    return e.select("from_id", "to_id", "link_type", F.round("strength", 6).alias("strength"), "hop_count", F.unix_micros("last_walked").alias("last_walked"))


@query
def edge_merge(spark, d):
    """The log's first half compacted, then the second half merged into it."""
    log = tables(spark, d, "memory_links")[0]
    e = graph.compact(log.where("id % 2 = 1"), graph.compact(log.where("id % 2 = 0")))
    return e.select("from_id", "to_id", "link_type", F.round("strength", 6).alias("strength"), "hop_count")


@query
def edge_decay_prune(spark, d):
    e = graph.decay_and_prune(graph.compact(tables(spark, d, "memory_links")[0]), as_of())
    return e.select("from_id", "to_id", "link_type", F.round("strength", 6).alias("strength"))


@query
def spreading_activation(spark, d):
    m, log = tables(spark, d, "memories", "memory_links")
    found = m.where("id % 20 = 0").select(F.col("id").alias("group"), F.col("id").alias("node"))
    return graph.activate(graph.compact(log), found, m).select(F.col("group").alias("seed"), "id", "activation")


@query
def supersession_edges(spark, d):
    m, log = tables(spark, d, "memories", "memory_links")
    return graph.supersession_edges(log, m)


@query
def co_recall_pairs(spark, d):
    return graph.session_chains(events.once(tables(spark, d, "recall_events")[0]))


@query
def edge_statistics(spark, d):
    return graph.statistics(graph.compact(tables(spark, d, "memory_links")[0]))


@query
def direct_links(spark, d):
    m, log = tables(spark, d, "memories", "memory_links")
    pairs = evaluate.citation_cases(m).select(F.col("query_id").alias("a"), F.col("expected").alias("b"))
    return graph.directly_linked(pairs, graph.compact(log))


@query
def scoped_edge_reset(spark, d):
    m, log = tables(spark, d, "memories", "memory_links")
    return graph.without_scope(graph.compact(log), m, "marble-passport").groupBy("link_type").agg(F.count("*").alias("n"))


# Lifecycle


@query
def strengthen_batch(spark, d):
    m, ev = tables(spark, d, "memories", "recall_events")
    shown = events.once(ev).select(F.explode("shown").alias("s")).select(F.col("s.id").alias("id"))
    out = lifecycle.strengthen(m, shown, as_of())
    return out.select("id", "access_count", F.round("weight", 6).alias("weight"))


@query
def used_fail_feedback(spark, d):
    m, ev = tables(spark, d, "memories", "recall_events")
    judged = events.once(ev).where("used is not null")
    good = judged.select(F.explode("used").alias("id"))
    bad = judged.where(F.size("used") == 0).select(F.explode("shown").alias("s")).select(F.col("s.id").alias("id"))
    out = lifecycle.failed(lifecycle.used(m, good), bad)
    return out.select("id", "success_count", "fail_count", F.round("weight", 6).alias("weight"))


@query
def node_decay_archive(spark, d):
    out = lifecycle.decay_nodes(_memories(spark, d), as_of())
    return out.select("id", "archived", F.round("weight", 6).alias("weight"))


@query
def never_accessed_archive(spark, d):
    return lifecycle.archive_unused(_memories(spark, d), as_of()).groupBy("archived").agg(F.count("*").alias("n"))


@query
def consolidated(spark, d):
    from memloom.plans import maintain

    m, log = tables(spark, d, "memories", "memory_links")
    return maintain.consolidate(State({"memories": m, "log": log}), as_of())[1]


@query
def list_by_entity(spark, d):
    """The people attached through source sessions count as entities here: the contributor."""
    m = _memories(spark, d)
    attached = lifecycle.attach(m.select(F.col("id").alias("memory_id"), F.col("contributor").alias("entity")).where("entity is not null"), m.select(F.col("id").alias("memory_id"), F.col("person").alias("entity")).where("entity is not null"))
    return lifecycle.by_entity(m, attached, "agent-16").select("id", "subject")


@query
def forget_project(spark, d):
    m, lp = tables(spark, d, "memories", "open_loops")
    kept, children = lifecycle.forget(m, {"loops": (lp, "memory_id")}, "marble-passport", confirmed=True)
    return kept.agg(F.count("*").alias("memories")).join(children["loops"].agg(F.count("*").alias("loops")))


@query
def supersede_pairs(spark, d):
    m = _memories(spark, d)
    pairs = m.where("superseded_by is not null").select(F.col("superseded_by").alias("old"), F.col("id").alias("new"))
    return lifecycle.supersede(m, pairs).where("superseded_by is not null").select("id", "superseded_by")


# Ingest, text, keys, JSON


@query
def exchange_first(spark, d):
    return ingest.first_of_exchange(_memories(spark, d)).select("id", "exchange_id")


@query
def exchange_pairing(spark, d):
    docs = tables(spark, d, "documents")[0].where("text is not null")
    pairs = ingest.paired_turns(ingest.dialogue_turns(docs, "doc_id", "text"))
    return pairs.select("conv_id", "turn", F.length("prompt").alias("prompt_chars"), F.length("answer").alias("answer_chars"))


@query
def captured_exchanges(spark, d):
    docs = tables(spark, d, "documents")[0].where("text is not null")
    pairs = ingest.paired_turns(ingest.dialogue_turns(docs, "doc_id", "text")).withColumns({"url": F.concat(F.lit("doc:"), F.col("conv_id")), "title": F.lit(None).cast("string")})
    pairs = pairs.withColumn("exchange_id", keys.exchange_id(F.col("url"), F.col("prompt"), F.col("answer")))
    return ingest.exchange_memories(pairs).select("exchange_id", "subject", F.md5("body").alias("body_md5"), "tier")


@query
def ingest_verdicts(spark, d):
    m = _memories(spark, d)
    body = F.when(F.col("id") % 7 == 0, "").when(F.col("id") % 7 == 1, "{").when(F.col("id") % 7 == 2, '{"prompt": " "}').otherwise(F.to_json(F.struct(F.col("subject").alias("prompt"), F.col("body").alias("answer"))))
    return ingest.accepted(m.select("id", body.alias("payload"))).groupBy("verdict").agg(F.count("*").alias("n"))


@query
def upsert_by_key(spark, d):
    m = _memories(spark, d)
    stored = lifecycle.latest(m.where("id % 3 > 0 and node_key is not null"), ["node_key"], ["id"]).unionByName(m.where("id % 3 > 0 and node_key is null"))
    out = ingest.upsert(stored, m.where("id % 3 = 0"))
    return out.select("node_key", F.md5("body").alias("body_md5"), "project", "archived")


@query
def redaction_counts(spark, d):
    return ingest.redaction_report(tables(spark, d, "documents")[0], ("text",), "client")


@query
def redaction_counts_save(spark, d):
    return ingest.redaction_report(_memories(spark, d), profile="save")


@query
def node_keys(spark, d):
    return _memories(spark, d).select("id", keys.node_key(F.col("person"), F.col("subject"), F.col("body")).alias("key"))


@query
def wikilink_pairs(spark, d):
    return _memories(spark, d).select("id", F.explode(text.wikilinks(F.col("body"))).alias("cited"))


@query
def previews(spark, d):
    return _memories(spark, d).select("id", text.preview(F.col("recall_form"), F.col("body")).alias("preview"))


@query
def sentence_trims(spark, d):
    return _memories(spark, d).select("id", text.trim_sentence(F.col("body"), 400).alias("trimmed"))


@query
def topic_slugs(spark, d):
    return _memories(spark, d).select("id", text.topic_slug(F.coalesce("subject", F.lit(""))).alias("slug"))


@query
def noun_types(spark, d):
    return _memories(spark, d).groupBy(text.noun_type(F.col("person"), F.col("subject"), F.col("body")).alias("noun_type")).agg(F.count("*").alias("n"))


@query
def gap_categories(spark, d):
    m = _memories(spark, d)
    return seeds.gaps(m.where("tier is not null"), "tier").select("tier", F.array_join(F.array_sort("missing"), ",").alias("missing"))


@query
def json_fold(spark, d):
    return jsonfold.fold(_memories(spark, d), "id", "metadata_json")


@query
def json_unfold(spark, d):
    leaves = jsonfold.fold(_memories(spark, d), "id", "metadata_json")
    return jsonfold.unfold(leaves, "id").select("id", "json")


# Doorways and topics


def _shown_sets(ev: DataFrame) -> DataFrame:
    ids = F.array_sort(F.array_distinct(F.slice(F.transform("shown", lambda s: s["id"]), 1, 3)))
    return events.once(ev).select(F.col("id").alias("query_id"), ids.alias("member_ids"), F.lit(0.2).alias("cut_gap"))


@query
def doorway_keys(spark, d):
    sets = _shown_sets(tables(spark, d, "recall_events")[0]).where(F.size("member_ids") >= 2)
    return sets.groupBy(keys.set_key(F.col("member_ids")).alias("key")).agg(F.count("*").alias("n"))


@query
def doorway_centroids(spark, d):
    m, ev = tables(spark, d, "memories", "recall_events")
    ways = doorways.recorded(None, _shown_sets(ev), m, as_of())
    # F.round loses the sign of a mean that rounds to zero and rounds the shortest decimal form instead of the value; SQL does neither.
    rounded = lambda x: F.signum(x) * (F.round(F.abs(x) * 1e5) / 1e5)
    return ways.where("centroid is not null").select("key", "query_count", F.transform("centroid", rounded).alias("centroid"))


@query
def doorway_staleness(spark, d):
    m, ev = tables(spark, d, "memories", "recall_events")
    formed = F.to_timestamp(F.lit("2024-02-10 00:00:00"))
    ways = doorways.recorded(None, _shown_sets(ev), m, as_of()).withColumn("formed_at", F.when(F.substring("key", 1, 1) < "8", formed).otherwise(as_of()))
    return doorways.aged(ways, m).groupBy("stale").agg(F.count("*").alias("n"))


@query
def dominant_project(spark, d):
    return doorways.dominant(_memories(spark, d).where("person is not null"), "person", "project")


def _topics(m: DataFrame) -> DataFrame:
    """Two-word things of the subjects, as topics of their project."""
    pair = F.regexp_extract(F.lower(F.coalesce("subject", F.lit(""))), r"(boat shed|tide gauge|bell tower|water tower|ice rink|browser hook|lock table|retry loop)", 1)
    return m.select("project", F.regexp_replace(pair, " ", "-").alias("slug")).where("slug <> '' and project is not null").groupBy("slug").agg(F.min("project").alias("project"))


@query
def topic_backfill(spark, d):
    m = _memories(spark, d)
    return topics.backfilled(_topics(m), m.select(F.lit("").alias("slug"), "id").limit(0), m, per_topic=400)


@query
def topic_member_top30(spark, d):
    m = _memories(spark, d)
    tags = m.where("project is not null").select(F.col("project").alias("slug"), "id")
    s = topics.summary_members(tags, m)
    return s.select("slug", "size", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query
def topic_extraction_batches(spark, d):
    m = _memories(spark, d)
    marks = m.where("id % 3 = 0").groupBy(F.coalesce("project", F.lit("")).alias("project")).agg((F.max("id") / 2).cast("long").alias("last_id"))
    read = topics.next_batches(topics.unread(m, marks), 40, 1)
    return read.groupBy("mark_of").agg(F.count("*").alias("n"), F.max("id").alias("last_id"))


@query
def topic_repeats(spark, d):
    m = _memories(spark, d)
    read = topics.next_batches(topics.unread(m, m.select(F.lit("").alias("project"), "id").limit(0).select("project", F.col("id").alias("last_id"))), 40, 1000)
    terms = read.select("mark_of", "batch_no", "id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("body"), F.lit(r"\b(boat shed|tide gauge|bell tower|water tower|ice rink)\b"), F.lit(1)))).alias("term"))
    return topics.repeated_slugs(terms)


@query
def watermarks(spark, d):
    m = _memories(spark, d)
    old = m.where("id % 2 = 0").groupBy(F.coalesce("project", F.lit("")).alias("project")).agg(F.max("id").alias("last_id"))
    read = m.where("id % 2 = 1").select(F.coalesce("project", F.lit("")).alias("mark_of"), "id")
    return topics.advanced(old, read)


@query
def period_groups(spark, d):
    m = _memories(spark, d)
    g = topics.period_groups(m, F.to_timestamp(F.lit("2024-01-15 00:00:00")), hours=24 * 365, least=2, most=60, newest=1000)
    return g.select("hour", "n", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


# Loops, events, quality, projects, seeds


@query
def open_loop_candidates(spark, d):
    m, lp = tables(spark, d, "memories", "open_loops")
    return loops.candidates(m, lp, as_of(), since_days=400, budget=40).select("id")


@query
def open_loop_outstanding(spark, d):
    m, lp = tables(spark, d, "memories", "open_loops")
    return loops.outstanding(lp, m, limit=None).select("memory_id", "cited")


@query
def open_loop_sweep(spark, d):
    m, lp = tables(spark, d, "memories", "open_loops")
    out = loops.closed_by_successor(loops.aged_out(lp, as_of()), m, as_of())
    return out.groupBy("status", "close_reason").agg(F.count("*").alias("n"))


@query
def loop_statistics(spark, d):
    return loops.statistics(tables(spark, d, "open_loops")[0], as_of())


@query
def event_funnel(spark, d):
    return events.funnel(tables(spark, d, "recall_events")[0])


@query
def event_shown_ranks(spark, d):
    return events.shown_ranks(tables(spark, d, "recall_events")[0]).groupBy("rank").agg(F.count("*").alias("shown"), F.count_if("was_used").alias("used"))


@query
def events_waiting(spark, d):
    return events.waiting(tables(spark, d, "recall_events")[0], as_of(), older_than_seconds=3600).select("id")


@query
def repeated_injections(spark, d):
    return events.repeated_in_session(tables(spark, d, "recall_events")[0]).agg(F.sum("shown").alias("shown"), F.sum("repeated").alias("repeated"))


@query
def template_subjects(spark, d):
    return quality.template_siblings(_memories(spark, d)).where(F.col("siblings") >= quality.TEMPLATE_AT)


@query
def weak_subjects(spark, d):
    return _memories(spark, d).groupBy(quality.weak_subject(F.col("subject")).alias("weakness")).agg(F.count("*").alias("n"))


@query
def quality_warnings(spark, d):
    m = _memories(spark, d)
    return quality.warnings(m, as_of(), searched=m.where("id % 20 = 0")).groupBy("code").agg(F.count("*").alias("n"))


@query
def vector_models(spark, d):
    return quality.models(_memories(spark, d))


@query
def vocabulary_violations(spark, d):
    return schema.violations(_memories(spark, d)).groupBy("rule").agg(F.count("*").alias("n"))


@query
def project_alias_resolution(spark, d):
    lp, p, a = tables(spark, d, "open_loops", "projects", "project_aliases")
    return projects.resolved(lp, p, a).select("memory_id", "canonical")


@query
def project_mentions(spark, d):
    m, p, a = tables(spark, d, "memories", "projects", "project_aliases")
    return projects.mentions(m, projects.vocabulary(p, a)).groupBy("canonical").agg(F.count("*").alias("n"))


@query
def project_classification(spark, d):
    m, p, a = tables(spark, d, "memories", "projects", "project_aliases")
    return projects.classified(m, projects.vocabulary(p, a)).groupBy("method").agg(F.count("*").alias("n"), F.count("primary").alias("with_project"))


@query
def project_near_matches(spark, d):
    lp, p, a = tables(spark, d, "open_loops", "projects", "project_aliases")
    return projects.ensured(p, lp.select("project"), a, as_of())[1]


@query
def seed_compile(spark, d):
    m, log = tables(spark, d, "memories", "memory_links")
    people = m.where("person is not null").select(F.col("person").alias("entity")).distinct()
    s = seeds.compiled(m, graph.compact(log), None, people, as_of())
    return s.select("entity", "version", F.size("payload.rows").alias("rows"), F.col("payload.weights.total").alias("total"), F.array_join("payload.gaps", ",").alias("gaps"))


# Evaluation


@query
def citation_cases(spark, d):
    return evaluate.citation_cases(_memories(spark, d))


@query
def pair_cosine_split(spark, d):
    m = _memories(spark, d)
    return evaluate.difficulty(evaluate.citation_cases(m), m).select("query_id", "expected", F.round("cosine", 6).alias("cosine"), "hard")


@query
def policy_ladder(spark, d):
    m = _memories(spark, d)
    return evaluate.ladder(m, evaluate.citation_cases(m), as_of())


@query
def lens_bench(spark, d):
    m = _memories(spark, d)
    return evaluate.lens_bench(m, _lenses(m), evaluate.citation_cases(m), as_of())


@query
def use_signal_readiness(spark, d):
    m = _memories(spark, d)
    return evaluate.use_signal_readiness(m, evaluate.citation_cases(m), as_of())


@query
def period_summaries(spark, d):
    m = _memories(spark, d)
    due = topics.period_groups(m, F.to_timestamp(F.lit("2024-01-15 00:00:00")), hours=24 * 365, least=2, most=60, newest=1000)
    return topics.period_rows(due, m, as_of()).select("node_key", "subject", "body", F.size("derived_from").alias("members"))


@query
def policy_changes(spark, d):
    """Cases that move between plain similarity and the shipped policy."""
    m = _memories(spark, d)
    cases = evaluate.citation_cases(m)
    asked = m.join(cases.select(F.col("query_id").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("query_id"), "embedding", "embedding_model")
    pool = search.top_k(search.active(m, as_of()), asked, 40, skip_self=True).select("query_id", "id", "cosine")
    best = [evaluate.case_scores(rank.placed(rank.scored(pool, m, as_of(), p), limit=10), cases) for p in (rank.PURE_COSINE, rank.Policy())]
    return evaluate.changed_cases(*best)


@query
def health_probe(spark, d):
    return evaluate.health_probe(_memories(spark, d), as_of())


@query
def association_bench(spark, d):
    m, log = tables(spark, d, "memories", "memory_links")
    pairs = evaluate.citation_cases(m).select(F.col("query_id").alias("a"), F.col("expected").alias("b"))
    asked = m.join(pairs.select(F.col("a").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("query_id"), "embedding", "embedding_model")
    ranked = search.top_k(search.active(m, as_of()), asked, 10, skip_self=True)
    r = evaluate.association_pairs(pairs, ranked, graph.compact(log), m)
    return r.agg(F.count("*").alias("n"), F.count_if("cold").alias("cold"), F.count_if("warm").alias("warm"), F.count_if("covered").alias("covered"))


@query
def overlap_gate(spark, d):
    m = _memories(spark, d)
    cases = evaluate.citation_cases(m).join(m.select(F.col("id").alias("query_id"), F.col("subject").alias("question")), "query_id").join(m.select(F.col("id").alias("expected"), F.col("subject").alias("answer")), "expected")
    return evaluate.overlap_gate(cases).groupBy("kept").agg(F.count("*").alias("n"))


@query
def subject_index(spark, d):
    m = _memories(spark, d)
    return evaluate.by_subject(m.select("subject").distinct(), m).agg(F.count("*").alias("n"), F.sum("id").alias("total"))


@query
def lens_todo(spark, d):
    m = _memories(spark, d)
    return providers.lens_rows(m, _lenses(m), ("thematic", "questions")).groupBy("perspective").agg(F.count("*").alias("n"))


@query
def short_forms(spark, d):
    return providers.short_forms(_memories(spark, d), 1_000_000)


# Event stream in batch form


@query
def hourly_events(spark, d):
    e = tables(spark, d, "events")[0].withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(clock.hour_label(F.col("ts")).alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


@query
def event_walks(spark, d):
    """Consecutive different event types of each user, as edges with their harmonic strength."""
    e = tables(spark, d, "events")[0]
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = e.withColumn("to", F.lead("event_type").over(w)).where("to is not null and to <> event_type")
    walks = steps.groupBy(F.col("event_type").alias("from_type"), F.col("to").alias("to_type")).agg(F.count("*").alias("walks"))
    return walks.select("from_type", "to_type", "walks", F.round(clock.diminishing(F.lit(0), F.col("walks")), 6).alias("strength"))


@query
def event_props_fold(spark, d):
    e = tables(spark, d, "events")[0]
    return jsonfold.fold(e, "event_id", "props")


# Volume tests of the generic pieces on the star schema


@query
def top_orders_of_customers(spark, d):
    o = tables(spark, d, "orders")[0]
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return o.withColumn("place", n).where("place <= 3").select("o_custkey", "o_orderkey", "place")


@query
def main_supplier_of_parts(spark, d):
    return doorways.dominant(tables(spark, d, "lineitem")[0], "l_partkey", "l_suppkey")


@query
def co_ordered_parts(spark, d):
    """Consecutive parts of an order as walks, compacted."""
    li = tables(spark, d, "lineitem")[0]
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    walks = li.withColumn("to_part", F.lead("l_partkey").over(w)).where("to_part is not null and to_part <> l_partkey")
    return walks.groupBy(F.col("l_partkey").alias("from_part"), "to_part").agg(F.count("*").alias("walks"))
