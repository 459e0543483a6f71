"""Ingest: redact, key, deduplicate, pair exchanges, upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import keys, text
from memloom.operators.lifecycle import latest

MAX_BYTES = 512 * 1024


def accepted(posts: DataFrame, body: str = "payload", schema: str = "url string, title string, prompt string, answer string, exchange_id string") -> DataFrame:
    """JSON posts parsed into columns with ``verdict``: stored, empty (nothing to write), malformed or too_large."""
    size = F.octet_length(F.coalesce(F.col(body), F.lit("")))
    parsed = posts.withColumn("p", F.from_json(body, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    p = parsed.select("*", "p.*")
    blank = (F.trim(F.coalesce("prompt", F.lit(""))) == "") & (F.trim(F.coalesce("answer", F.lit(""))) == "")
    broken = F.try_parse_json(F.col(body)).isNull()
    p = p.withColumn("verdict", F.when(size < 1, "empty").when(size > MAX_BYTES, "too_large").when(broken, "malformed").when(blank, "empty").otherwise("stored"))
    return p.withColumn("exchange_id", F.coalesce("exchange_id", keys.exchange_id(F.col("url"), F.col("prompt"), F.col("answer")))).drop("p")


def exchange_memories(exchanges: DataFrame) -> DataFrame:
    """(exchange_id, subject, body, origin, tier) of captured exchanges with url, title, prompt, answer."""
    prompt = F.coalesce("prompt", F.lit(""))
    short = F.concat(F.substring(prompt, 1, 70), F.when(F.length(prompt) > 70, "…").otherwise(""))
    subject = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.nullif(F.trim(short), F.lit("")), F.lit("captured exchange"))
    body = F.concat(F.lit("Q: "), prompt, F.lit("\n\nA: "), F.coalesce("answer", F.lit("")))
    return exchanges.select("exchange_id", text.redact(subject, "ingest").alias("subject"), text.redact(body, "ingest").alias("body"), F.lit("discovery").alias("origin"), F.lit("transcript").alias("tier"))


def first_of_exchange(rows: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One row for each exchange_id, the smallest id first; rows of exchanges already stored go; rows without one stay."""
    named = latest(rows.where(F.col("exchange_id").isNotNull()), ["exchange_id"], ["id"])
    if stored is not None:
        named = named.join(stored.select("exchange_id").where(F.col("exchange_id").isNotNull()).distinct(), "exchange_id", "left_anti")
    return named.unionByName(rows.where(F.col("exchange_id").isNull()))


def paired_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, prompt, answer): each user turn with the next assistant turn after it; turns without one go."""
    # Read backwards the frame only grows, so a conversation costs one pass.
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, -1)
    answer = F.last(F.when(F.col("role") == "assistant", F.col("text")), ignorenulls=True).over(w)
    return turns.withColumn("answer", answer).where("role = 'user' and answer is not null").select("conv_id", "turn", F.col("text").alias("prompt"), "answer")


def dialogue_turns(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(conv_id, turn, role, text): turns of a text written as ``user:`` / ``assistant:`` or ``Q:`` / ``A:`` paragraphs."""
    part = F.explode(F.transform(F.split(text_col, r"\n\n(?=(?:user|assistant|Q|A): )"), lambda x, i: F.struct(i.alias("turn"), x.alias("x"))))
    p = rows.select(F.col(id_col).alias("conv_id"), part.alias("p")).select("conv_id", "p.turn", F.regexp_extract("p.x", r"^(user|assistant|Q|A): ", 1).alias("mark"), F.regexp_replace("p.x", r"^(user|assistant|Q|A): ", "").alias("text"))
    role = F.when(F.col("mark").isin("user", "Q"), "user").when(F.col("mark").isin("assistant", "A"), "assistant")
    return p.withColumn("role", role).where("role is not null").select("conv_id", "turn", "role", "text")


def prepared(rows: DataFrame) -> DataFrame:
    """Incoming rows redacted, keyed and classified, with the redaction version."""
    clean = rows.withColumns({"subject": text.redact(F.col("subject")), "body": text.redact(F.col("body")), "redaction_version": F.lit(text.REDACTION_VERSION)})
    clean = clean.withColumn("node_key", keys.node_key(F.col("person"), F.col("subject"), F.col("body")))
    return clean.withColumn("noun_type", F.coalesce("noun_type", text.noun_type(F.col("person"), F.col("subject"), F.col("body")))) if "noun_type" in rows.columns else clean.withColumn("noun_type", text.noun_type(F.col("person"), F.col("subject"), F.col("body")))


def upsert(memories: DataFrame, incoming: DataFrame, refreshed: tuple[str, ...] = ("body", "source_links", "embedding", "embedding_model", "temporal_anchor_start", "temporal_anchor_end")) -> DataFrame:
    """The state after ``incoming``: rows of a known node_key refresh the stored one, all others are new.

    A refreshed row keeps its id, subject, tier and other columns, keeps a project it
    has, and is taken out of the archive.  Of several incoming rows with one key the
    largest id wins; new rows get ids after the largest stored one.
    """
    last = latest(incoming.where(F.col("node_key").isNotNull()), ["node_key"], [F.desc("id")])
    stored = memories.alias("m")
    fresh = last.select("node_key", *[F.col(c).alias(f"n_{c}") for c in refreshed], F.col("project").alias("n_project"), F.lit(True).alias("n_hit"))
    kept = stored.join(fresh, "node_key", "left")
    hit = F.coalesce("n_hit", F.lit(False))
    cols = {c: F.when(hit, F.col(f"n_{c}")).otherwise(F.col(c)) for c in refreshed}
    cols |= {"project": F.coalesce("project", "n_project"), "archived": F.when(hit, F.lit(False)).otherwise(F.coalesce("archived", F.lit(False)))}
    kept = kept.withColumns(cols).select(*memories.columns)
    known = memories.select("node_key").where(F.col("node_key").isNotNull()).distinct()
    new = last.join(known, "node_key", "left_anti").unionByName(incoming.where(F.col("node_key").isNull()))
    return kept.unionByName(with_new_ids(new, memories).select(*memories.columns))


def with_new_ids(new: DataFrame, memories: DataFrame) -> DataFrame:
    """Consecutive ids after the largest stored one: by a hash part of the incoming id, then by that id, so no single task numbers all rows."""
    top = memories.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    part = F.pmod(F.xxhash64("id"), F.lit(64))
    sized = new.withColumn("_part", part)
    before = sized.groupBy("_part").agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).drop("_n")  # 64 rows
    place = F.row_number().over(Window.partitionBy("_part").orderBy("id"))
    rows = sized.withColumn("_place", place).join(F.broadcast(before), "_part").join(F.broadcast(top))
    return rows.withColumn("id", F.col("top") + F.coalesce("_before", F.lit(0)) + F.col("_place")).drop("_part", "_place", "_before", "top")


def redaction_report(rows: DataFrame, columns: tuple[str, ...] = ("subject", "body"), profile: str = "save") -> DataFrame:
    """(label, n): placeholders that redaction leaves in the columns."""
    found = F.regexp_extract_all(text.redact(F.concat_ws("\n", *columns), profile), F.lit(r"(\[REDACTED[^\]]*\])"), F.lit(1))
    return rows.select(F.explode(found).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


