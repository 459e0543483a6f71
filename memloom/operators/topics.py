"""Topics: watermarked reading, extraction, backfill, and summaries of topics and hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import clock, text
from memloom.functions.vector import centroid
from memloom.operators.search import not_recycled


def unread(memories: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows beyond their project's mark; a null project has its own mark ''.  Recycled rows are never read."""
    m = memories.withColumn("mark_of", F.coalesce("project", F.lit("")))
    m = m.join(marks.select(F.col("project").alias("mark_of"), "last_id"), "mark_of", "left")
    return m.where((F.col("id") > F.coalesce("last_id", F.lit(0))) & not_recycled(F.col("origin")) & ~F.coalesce("archived", F.lit(False))).drop("last_id")


def advanced(marks: DataFrame, read: DataFrame) -> DataFrame:
    """Marks after reading (mark_of, id); a mark never goes back."""
    new = read.groupBy(F.col("mark_of").alias("project")).agg(F.max("id").alias("last_id"))
    return marks.select("project", "last_id").unionByName(new).groupBy("project").agg(F.max("last_id").alias("last_id"))


def next_batches(rows: DataFrame, batch: int = 40, rounds: int = 1) -> DataFrame:
    """The next ``rounds`` batches of each project, in the order of ids, with ``batch_no`` from 0; projects take turns."""
    n = F.row_number().over(Window.partitionBy("mark_of").orderBy("id"))
    return rows.withColumn("batch_no", F.floor((n - 1) / F.lit(batch)).cast("int")).where(F.col("batch_no") < rounds)


def repeated_slugs(proposed: DataFrame, least: int = 2) -> DataFrame:
    """Proposals (mark_of, batch_no, id, term) whose slug occurs at least ``least`` times in its batch."""
    p = proposed.withColumn("slug", text.topic_slug(F.col("term"))).where("slug <> ''")
    seen = F.count("*").over(Window.partitionBy("mark_of", "batch_no", "slug"))
    return p.withColumn("seen", seen).where(F.col("seen") >= least).select("mark_of", "batch_no", "id", "slug").distinct()


def backfilled(topics: DataFrame, tags: DataFrame, memories: DataFrame, per_topic: int = 400, shortest: int = 4) -> DataFrame:
    """New tags (slug, id): live rows of the topic's project whose subject or body contains the topic's words as written.

    Words of the slug joined by blanks, of at least ``shortest`` characters; at most
    ``per_topic`` new tags a topic, the lowest ids first.  A term of several words holds
    two characters, a blank and two characters; texts and terms meet on these, then the
    whole term is looked for.  Terms of one word are compared with their project's rows.
    """
    terms = topics.select("slug", "project", F.regexp_replace("slug", "-", " ").alias("term")).where(F.length("term") >= shortest)
    border = F.regexp_extract("term", r"(\S{2} \S{2})", 1)
    terms = terms.withColumn("key", F.nullif(border, F.lit("")))
    full = F.lower(F.concat_ws(" ", F.coalesce("subject", F.lit("")), F.coalesce("body", F.lit(""))))
    rows = memories.where(~F.coalesce("archived", F.lit(False)) & not_recycled(F.col("origin"))).select("id", "project", full.alias("text"))
    keyed = rows.select("id", "project", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?=(\S{2} \S{2}))"), F.lit(1)))).alias("key"))
    met = keyed.join(terms.where("key is not null"), ["key", "project"]).select("id", "slug", "term")  # texts join the hits only
    by_word = met.join(rows.select("id", "text"), "id").where(F.col("text").contains(F.col("term"))).select("slug", "id")
    by_project = rows.join(terms.where("key is null").drop("key"), "project").where(F.col("text").contains(F.col("term"))).select("slug", "id")
    new = by_word.unionByName(by_project).distinct().join(tags.select("slug", "id"), ["slug", "id"], "left_anti")
    return new.withColumn("n", F.row_number().over(Window.partitionBy("slug").orderBy("id"))).where(F.col("n") <= per_topic).drop("n")


def refreshed(topics: DataFrame, tags: DataFrame, memories: DataFrame) -> DataFrame:
    """Topics with the centroid and the number of their members."""
    t = tags.select("slug", "id").distinct().join(memories.select("id", "embedding"), "id")
    size = t.groupBy("slug").agg(F.count("*").alias("members"))
    return topics.drop("centroid", "members").join(centroid(t, ["slug"]).select("slug", "centroid"), "slug", "left").join(size, "slug", "left").fillna(0, ["members"])


def summary_members(tags: DataFrame, memories: DataFrame, top: int = 30, least: int = 3) -> DataFrame:
    """(slug, members, subjects): the ``top`` heaviest live members of topics with at least ``least``."""
    live = memories.where(~F.coalesce("archived", F.lit(False)) & not_recycled(F.col("origin"))).select("id", "weight", "subject")
    t = tags.select("slug", "id").distinct().join(live, "id")
    place = F.row_number().over(Window.partitionBy("slug").orderBy(F.desc_nulls_last("weight"), "id"))
    t = t.withColumn("n", F.count("*").over(Window.partitionBy("slug"))).withColumn("p", place).where((F.col("n") >= least) & (F.col("p") <= top))
    return t.groupBy("slug").agg(F.sort_array(F.collect_list("id")).alias("members"), F.transform(F.array_sort(F.collect_list(F.struct("p", "subject"))), lambda x: x["subject"]).alias("subjects"), F.first("n").alias("size"))


def due_summaries(members: DataFrame, memories: DataFrame, limit: int = 3) -> DataFrame:
    """Topics whose member set differs from that of their latest live summary, the largest first; with the id it would replace."""
    written = memories.where(~F.coalesce("archived", F.lit(False)) & F.col("node_key").startswith("topic|")).select(F.regexp_replace("node_key", r"^topic\|", "").alias("slug"), F.struct("created_at", "id", "derived_from").alias("s"))
    last = written.groupBy("slug").agg(F.max("s").alias("s")).select("slug", F.col("s.id").alias("replaces"), F.array_sort("s.derived_from").alias("before"))
    due = members.join(last, "slug", "left").where(~F.coalesce("before", F.array().cast("array<long>")).eqNullSafe(F.col("members")))
    return due.orderBy(F.desc("size"), "slug").limit(limit)


def summary_rows(due: DataFrame, as_of: Column) -> DataFrame:
    """Rows to write for topics: one line a member, one level above them."""
    body = F.concat(F.lit("Topic "), F.col("slug"), F.lit(":\n"), F.array_join(F.transform("subjects", lambda s: F.concat(F.lit("- "), F.coalesce(s, F.lit("")))), "\n"))
    return due.select(F.concat(F.lit("topic|"), F.col("slug")).alias("node_key"), F.col("slug").alias("subject"), body.alias("body"), F.col("members").alias("derived_from"), F.lit(1).alias("derived_depth"), F.lit("insight").alias("tier"), F.lit("recycle").alias("origin"), as_of.alias("created_at"), "replaces")


def period_rows(due: DataFrame, memories: DataFrame, as_of: Column, shown: int = 40) -> DataFrame:
    """Rows to write for hours (hour, members): the projects touched and one line for each of the first ``shown`` members."""
    line = F.concat(F.lit("- ["), F.col("id"), F.lit("] "), F.coalesce("project", F.lit("(none)")), F.lit(": "), F.coalesce("subject", F.lit("")))
    first = due.select("hour", F.posexplode(F.slice("members", 1, shown)).alias("place", "id")).join(memories.select("id", "project", "subject"), "id")
    lines = first.groupBy("hour").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"), F.array_sort(F.collect_set(F.coalesce("project", F.lit("(none)")))).alias("projects"))
    body = F.concat(F.lit("Projects touched: "), F.array_join("projects", ", "), F.lit("\n\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    return due.join(lines, "hour").select(
        F.concat(F.lit("period|"), F.col("hour")).alias("node_key"), F.concat(F.lit("Session summary: "), F.col("hour")).alias("subject"), body.alias("body"), F.col("members").alias("derived_from"),
        F.lit(1).alias("derived_depth"), F.lit("insight").alias("tier"), F.lit("recycle").alias("origin"), as_of.alias("created_at"), F.lit(None).cast("long").alias("replaces"),
    )


def period_groups(memories: DataFrame, as_of: Column, hours: int = 48, least: int = 4, most: int = 60, newest: int = 2, project: str | None = None) -> DataFrame:
    """(hour, members, n): hours of the last ``hours`` with ``least`` to ``most`` rows, the newest first, that have no summary yet."""
    rows = memories.where(not_recycled(F.col("origin")) & ~F.coalesce("archived", F.lit(False)) & (F.col("created_at") >= as_of - F.make_dt_interval(hours=F.lit(hours))) & (F.col("created_at") <= as_of))
    if project is not None:
        rows = rows.where(F.col("project") == project)
    rows = rows.select("id", clock.hour_label(F.col("created_at")).alias("hour"))
    done = memories.where(F.col("node_key").startswith("period|")).select(F.regexp_replace("node_key", r"^period\|", "").alias("hour"))
    # Hours are counted first, so that a bulk import is never gathered into one row.
    hours_due = rows.groupBy("hour").agg(F.count("*").alias("n")).where((F.col("n") >= least) & (F.col("n") <= most)).join(done, "hour", "left_anti").orderBy(F.desc("hour")).limit(newest)
    return rows.join(F.broadcast(hours_due), "hour").groupBy("hour").agg(F.sort_array(F.collect_list("id")).alias("members"), F.first("n").alias("n")).orderBy(F.desc("hour"))
