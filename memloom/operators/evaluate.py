"""Evaluation of recall on the corpus's own citations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import clock, text
from memloom.operators import graph, rank, search
from memloom.sources.schema import LENSES


def citation_cases(memories: DataFrame) -> DataFrame:
    """(query_id, expected): live rows that cite another live row, one row for each cited id."""
    live = memories.where(~F.coalesce("archived", F.lit(False)) & F.col("embedding").isNotNull())
    cites = live.select(F.col("id").alias("query_id"), F.explode(text.wikilinks(F.col("body"))).alias("expected")).where("query_id <> expected")
    return cites.join(live.select(F.col("id").alias("expected")), "expected", "left_semi").select("query_id", "expected")


def difficulty(cases: DataFrame, memories: DataFrame) -> DataFrame:
    """cases with cosine and ``hard``: below the exact median of all pairs."""
    pairs = search.pair_cosine(cases.select(F.col("query_id").alias("a"), F.col("expected").alias("b")), memories).where("cosine is not null")
    median = pairs.agg(F.percentile("cosine", F.lit(0.5)).alias("median"))
    return pairs.join(F.broadcast(median)).select(F.col("a").alias("query_id"), F.col("b").alias("expected"), "cosine", (F.col("cosine") < F.col("median")).alias("hard"))


def case_scores(ranked: DataFrame, cases: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(by, expected, found, best): how many expected rows a query found, and the best place of one (null if none)."""
    hits = cases.join(ranked.select(*by, F.col("id").alias("expected"), "pos"), [*(["query_id"] if "query_id" in by else []), "expected"], "left")
    return hits.groupBy(*by).agg(F.count_distinct("expected").alias("expected"), F.count("pos").alias("found"), F.min("pos").alias("best"))


def metrics(scores: DataFrame, by: tuple[str, ...] = (), ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """hit@k, mean reciprocal rank, share of expected rows found, number of cases."""
    hit = [F.round(F.avg(F.coalesce(F.col("best") <= k, F.lit(False)).cast("double")), 6).alias(f"hit_{k}") for k in ks]
    return scores.groupBy(*by).agg(F.count("*").alias("n"), *hit, F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("best"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(F.col("found") / F.col("expected")), 6).alias("recall_all"))


def ladder(memories: DataFrame, cases: DataFrame, as_of: Column, policies: dict[str, rank.Policy] = rank.LADDER, limit: int = 10) -> DataFrame:
    """Metrics of every policy over all cases, from one search: only the scoring differs between the rungs."""
    asked = memories.join(cases.select(F.col("query_id").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("query_id"), "embedding", "embedding_model")
    pool = search.top_k(search.active(memories, as_of), asked, limit * 4, skip_self=True).select("query_id", "id", "cosine")
    # One join and one ranking for all rungs: their scores are columns of the same row until then.
    rows = rank.with_history(pool, memories, as_of)
    for mode in {p.normalise for p in policies.values()}:
        rows = rows.withColumn(f"wn_{mode}", rank.normalised(F.col("weight"), ["query_id"], mode))
    rungs = [F.struct(F.lit(name).alias("policy"), rank.score(p, F.col(f"wn_{p.normalise}"), clock.recency(F.col("last_accessed"), as_of, p.recency_days)).alias("score")) for name, p in policies.items()]
    rows = rows.select("query_id", "id", "cosine", F.explode(F.array(*rungs)).alias("r")).select("query_id", "id", "cosine", "r.policy", "r.score")
    ranked = rank.placed(rows, ("policy", "query_id"), limit).select("policy", "query_id", "id", "pos")
    names = memories.sparkSession.createDataFrame([(n,) for n in policies], "policy string")
    every = cases.join(F.broadcast(names))
    hits = every.join(ranked.select("policy", "query_id", F.col("id").alias("expected"), "pos"), ["policy", "query_id", "expected"], "left")
    scores = hits.groupBy("policy", "query_id").agg(F.count_distinct("expected").alias("expected"), F.count("pos").alias("found"), F.min("pos").alias("best"))
    return metrics(scores, ("policy",))


def lens_bench(memories: DataFrame, lenses: DataFrame, cases: DataFrame, as_of: Column, limit: int = 10, types: tuple[str, ...] = LENSES) -> DataFrame:
    """Metrics of recall without lenses, with all and with each type alone, by ``lenses``.

    Only cases with an expected row that has a lens count, as all others would dilute the
    difference; status and supersession take no part in the score.
    """
    held = lenses.where(F.col("embedding").isNotNull()).select(F.col("memory_id").alias("expected")).distinct()
    cases = cases.join(cases.join(held, "expected", "left_semi").select("query_id").distinct(), "query_id", "left_semi")
    asked = memories.join(cases.select(F.col("query_id").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("query_id"), "embedding", "embedding_model")
    live = search.active(memories, as_of)
    literal = search.top_k(live, asked, limit * 4, skip_self=True).select("query_id", "id", "cosine")
    every = search.lens_top_k(lenses, live, asked, limit * 4, list(types))
    pools = {"none": literal, "all": search.merged_pool(literal, every)}
    pools |= {t: search.merged_pool(literal, search.lens_top_k(lenses, live, asked, limit * 4, [t])) for t in types}
    policy = rank.Policy(temporal=False, supersession=False)
    ranked = None
    for name, pool in pools.items():
        part = rank.placed(rank.scored(pool.where("id <> query_id"), memories, as_of, policy), limit=limit).select(F.lit(name).alias("lenses"), "query_id", "id", "pos")
        ranked = part if ranked is None else ranked.unionByName(part)
    rungs = F.broadcast(memories.sparkSession.createDataFrame([(n,) for n in pools], "lenses string"))
    hits = cases.join(rungs).join(ranked.select("lenses", "query_id", F.col("id").alias("expected"), "pos"), ["lenses", "query_id", "expected"], "left")
    scores = hits.groupBy("lenses", "query_id").agg(F.count_distinct("expected").alias("expected"), F.count("pos").alias("found"), F.min("pos").alias("best"))
    return metrics(scores, ("lenses",))


def use_signal_readiness(memories: DataFrame, cases: DataFrame, as_of: Column, limit: int = 10, bonus: float = 0.3) -> DataFrame:
    """One row (n, better, worse, changed, marked, verdict): what the success term changes among the cases, and whether that can be judged.

    marked counts the live rows with a success.  verdict: ``answerable`` where more cases
    get better than worse, ``harmful`` where some change but not for the better, ``not
    answerable`` where none changes, ``no cases`` without cases.
    """
    asked = memories.join(cases.select(F.col("query_id").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("query_id"), "embedding", "embedding_model")
    pool = search.top_k(search.active(memories, as_of), asked, limit * 4, skip_self=True).select("query_id", "id", "cosine")
    off, on = (case_scores(rank.placed(rank.scored(pool, memories, as_of, rank.Policy(success_bonus=b)), limit=limit), cases) for b in (0.0, bonus))
    marked = memories.where(~F.coalesce("archived", F.lit(False)) & (F.col("success_count") > 0)).agg(F.count("*").alias("marked"))
    verdict = F.when(F.col("n") == 0, "no cases").when(F.col("changed") == 0, "not answerable").when(F.col("better") > F.col("worse"), "answerable").otherwise("harmful")
    return changed_cases(off, on).join(F.broadcast(marked)).withColumn("verdict", verdict)


def changed_cases(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: cases of two runs (query_id, best) that got better, worse, or moved at all; no hit ranks after every hit."""
    both = a.select("query_id", F.coalesce("best", F.lit(1 << 30)).alias("x")).join(b.select("query_id", F.coalesce("best", F.lit(1 << 30)).alias("y")), "query_id")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("y") < F.col("x")).alias("better"), F.count_if(F.col("y") > F.col("x")).alias("worse"), F.count_if(F.col("y") != F.col("x")).alias("changed"))


def health_probe(memories: DataFrame, as_of: Column, sample: int = 20, top: int = 10, seed: int = 0, floor: float = 0.60) -> DataFrame:
    """One row: does a curated row come back for its own vector?  A seeded sample; fails below ``floor``."""
    ok = (F.col("tier") == "curated") & (F.length("subject") > 20) & ~F.col("subject").rlike(text.URLISH)
    chosen = search.active(memories, as_of).where(ok).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample)
    asked = chosen.select(F.col("id").alias("query_id"), "embedding", "embedding_model")
    hits = search.top_k(search.active(memories, as_of), asked, top).where("query_id = id")
    rate = F.count("pos") / F.count("*")
    return asked.select("query_id").join(hits.select("query_id", "pos"), "query_id", "left").agg(F.count("*").alias("n"), F.round(rate, 6).alias("hit_rate"), F.coalesce(rate >= floor, F.lit(False)).alias("healthy"))


def association_pairs(pairs: DataFrame, ranked: DataFrame, edges: DataFrame, memories: DataFrame, top: int = 10) -> DataFrame:
    """pairs (a, b) with cold (b among the top of a), warm (or activated from a's top hit), covered (a direct edge)."""
    seeds = ranked.where("pos = 1").select(F.col("query_id").alias("group"), F.col("id").alias("node"))
    extra = graph.activate(edges, seeds, memories).select(F.col("group").alias("a"), F.col("id").alias("b")).withColumn("act", F.lit(True))
    cold = ranked.where(F.col("pos") <= top).select(F.col("query_id").alias("a"), F.col("id").alias("b")).withColumn("hit", F.lit(True))
    linked = graph.directly_linked(pairs, edges)
    r = pairs.join(cold, ["a", "b"], "left").join(extra, ["a", "b"], "left").join(linked, ["a", "b"])
    c = F.coalesce("hit", F.lit(False))
    return r.select("a", "b", c.alias("cold"), (c | F.coalesce("act", F.lit(False))).alias("warm"), F.col("linked").alias("covered"))


ID_RANGE = 65_536
#: Start and step of the fixed generator (fixed values).
LCG_START, LCG_FACTOR, LCG_STEP = 0x2545F4914F6CDD1D, 6364136223846793005, 1442695040888963407


def _draws(turns: int) -> np.ndarray:
    """The first ``turns`` states of the fixed generator; known states are doubled in number by one jump ahead."""
    states = np.array([(LCG_FACTOR * LCG_START + LCG_STEP) % 2**64], dtype=np.uint64)
    factor, step = LCG_FACTOR, LCG_STEP  # of a jump over len(states) draws
    while len(states) < turns:
        with np.errstate(over="ignore"):
            states = np.concatenate([states, states * np.uint64(factor) + np.uint64(step)])
        step = (factor * step + step) % 2**64
        factor = factor * factor % 2**64
    return states[:turns]


def no_lift(gains: np.ndarray, resamples: int = 2000) -> float:
    """Share of paired resamples whose summed gain is not positive; 1 without cases."""
    cases = len(gains)
    if not cases:
        return 1.0
    picks = (_draws(resamples * cases) >> np.uint64(11)) % np.uint64(cases)
    return float((np.asarray(gains)[picks.astype(np.int64)].reshape(resamples, cases).sum(axis=1) <= 0).mean())


def lift_test(cases: DataFrame, by: str, resamples: int = 2000) -> DataFrame:
    """(by, n, cold, warm, no_lift) of each group of cases (a, b, cold, warm): hit rates and the share of resamples without lift.

    Groups run in parallel; within one, the cases are taken in the order of (a, b).
    """

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["a", "b"])
        gains = pdf["warm"].astype(int).to_numpy() - pdf["cold"].astype(int).to_numpy()
        return pd.DataFrame([(pdf[by].iloc[0], len(pdf), pdf["cold"].mean(), pdf["warm"].mean(), no_lift(gains, resamples))])

    kind = dict(cases.dtypes)[by]
    return cases.select(by, "a", "b", "cold", "warm").groupBy(by).applyInPandas(test, f"{by} {kind}, n long, cold double, warm double, no_lift double")


def overlap_gate(questions: DataFrame, most: int = 3, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """questions (id, question, answer) with shared words and ``kept``: fewer than ``most`` distinctive words in common."""
    shared = F.array_sort(F.array_intersect(text.distinctive(F.col("question"), stopwords), text.distinctive(F.col("answer"), stopwords)))
    return questions.withColumn("shared", shared).withColumn("kept", F.size("shared") < most)


def by_subject(names: DataFrame, memories: DataFrame) -> DataFrame:
    """names (subject) with the id of the only row of that subject; subjects that several rows share are dropped."""
    once = memories.groupBy("subject").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").drop("n")
    return names.join(once, "subject")


def export_index(memories: DataFrame, links: DataFrame) -> DataFrame:
    """(place, subject, body, links): rows by place from 0 in the order of ids, links as places."""
    # Ranges of ids are counted first, so that no task has to number all rows.
    ranged = memories.select("id", "subject", "body", F.floor(F.col("id") / F.lit(ID_RANGE)).alias("range"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranged.groupBy("range").agg(F.count("*").alias("n")).select("range", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy("id"))
    placed = ranged.withColumn("inside", inside).join(ranges, "range").select("id", "subject", "body", (F.col("before") + F.col("inside") - 1).alias("place"))
    to = links.select("from_id", "to_id").distinct().join(placed.select(F.col("id").alias("to_id"), F.col("place").alias("to")), "to_id")
    return placed.join(to.groupBy(F.col("from_id").alias("id")).agg(F.sort_array(F.collect_list("to")).alias("links")), "id", "left").select("place", "subject", "body", F.coalesce("links", F.array().cast("array<long>")).alias("links"))
