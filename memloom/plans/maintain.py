"""Consolidation of the whole state: ageing, topics, summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.operators import doorways, graph, ingest, lifecycle, loops, topics
from memloom.sources.providers import Budget
from memloom.sources.state import State


@dataclass
class Report:
    """What a pass did, by stage."""

    counts: dict[str, int]


def consolidate(state: State, as_of: Column, decay: float = 0.95, days: int = 7) -> tuple[State, DataFrame]:
    """Node decay, then log compaction and edge decay, then the archive of unused rows; with one row of counts.

    Decay is for each pass, not for each day.
    """
    before = state["memories"].agg(F.count_if(F.coalesce("archived", F.lit(False))).alias("archived_before"))
    aged = lifecycle.decay_nodes(state["memories"], as_of, decay, days)
    edges = graph.decay_and_prune(graph.compact(state["log"], state.tables.get("edges")), as_of, decay, days)
    done = lifecycle.archive_unused(aged, as_of)
    counts = done.agg(F.count("*").alias("rows"), F.count_if("archived").alias("archived")).join(before).join(edges.agg(F.count("*").alias("edges")))
    return state.changed(memories=done, edges=edges, log=state["log"].limit(0)), counts


def with_summaries(memories: DataFrame, rows: DataFrame) -> DataFrame:
    """The memories with the summaries as rows of their own; a summary that one replaces is archived and names its successor."""
    blank = [F.lit(None).cast(kind).alias(c) for c, kind in memories.dtypes if c not in rows.columns and c not in ("id", "archived", "weight", "access_count")]
    new = rows.withColumn("id", F.xxhash64("node_key")).select("*", *blank, F.lit(False).alias("archived"), F.lit(1.0).alias("weight"), F.lit(0).cast("long").alias("access_count"))
    new = ingest.with_new_ids(new, memories)
    gone = new.where("replaces is not null").groupBy(F.col("replaces").alias("id")).agg(F.max("id").alias("_by"))
    kept = memories.join(gone, "id", "left").withColumns({"superseded_by": F.coalesce("_by", "superseded_by"), "archived": F.when(F.col("_by").isNotNull(), F.lit(True)).otherwise(F.col("archived"))})
    return kept.select(*memories.columns).unionByName(new.select(*[F.col(c).cast(kind).alias(c) for c, kind in memories.dtypes]))


def dream(state: State, as_of: Column, extractor, budget: Budget, batch: int = 40, consolidate_too: bool = False) -> tuple[State, Report]:
    """One offline pass: age doorways; if rows are unread, read batches and tag them; backfill; refresh; write summaries of topics and hours.

    The state that comes in is never changed, so an error anywhere leaves it as it was.
    With ``consolidate_too`` the result is consolidated last.  Save the state between two
    passes: each reads the memories several times.

    ``extractor`` maps (mark_of, batch_no, id, subject, body) to (mark_of, batch_no, id,
    term); each batch costs one call of the budget.  Without unread rows only promotion
    and backfill run.  A batch that was not asked leaves its mark where it is.
    """
    memories = state["memories"]
    ways = doorways.aged(state["doorways"], memories)
    ways = doorways.named(ways, memories, budget.left)
    new_topics, promoted = doorways.promoted(ways, state["topics"], memories)
    known = state["topics"].select("slug", "name", "project", "centroid").unionByName(new_topics.select("slug", "name", "project", "centroid"))
    tags = state["tags"].select("slug", "id").unionByName(promoted).distinct()
    marks = state["marks"]
    fresh = topics.unread(memories, marks)
    counts = {"unread": fresh.count()}
    if counts["unread"]:
        projects = fresh.select("mark_of").distinct().count()
        rounds = max(1, budget.take(budget.left) // max(1, projects))
        read = topics.next_batches(fresh, batch, rounds)
        proposed = extractor(read.select("mark_of", "batch_no", "id", "subject", "body"))
        found = topics.repeated_slugs(proposed)
        seen = found.join(memories.select("id", "project"), "id")
        extra = doorways.dominant(seen, "slug", "project")
        add = found.select("slug").distinct().join(known.select("slug"), "slug", "left_anti").join(extra, "slug", "left").select("slug", F.col("slug").alias("name"), "project", F.lit(None).cast("array<double>").alias("centroid"))
        known = known.unionByName(add)
        tags = tags.unionByName(found.select("slug", "id")).distinct()
        marks = topics.advanced(marks, read)
    tags = tags.unionByName(topics.backfilled(known, tags, memories)).distinct()
    out = state.changed(doorways=ways, topics=known, tags=tags, marks=marks)
    if counts["unread"]:
        due = topics.due_summaries(topics.summary_members(tags, memories), memories)
        hours = topics.period_groups(memories, as_of, newest=min(2, budget.take(2)))
        written = topics.summary_rows(due, as_of).unionByName(topics.period_rows(hours, memories, as_of))
        out = out.changed(summaries=written, memories=with_summaries(memories, written), doorways=doorways.of_periods(ways, hours, memories, as_of))
    if consolidate_too:
        out, _ = consolidate(out, as_of)
    return out, Report(counts)


def close_loops(state: State, as_of: Column) -> State:
    """Loops of replaced rows close; old ones are dismissed; age alone closes nothing."""
    return state.changed(loops=loops.closed_by_successor(loops.aged_out(state["loops"], as_of), state["memories"], as_of))
