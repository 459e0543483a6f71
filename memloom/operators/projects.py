"""The project registry: aliases, near matches, links, classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import text
from memloom.operators.lifecycle import latest

#: Roles of a link in their order (fixed values).
ROLES = ("primary", "origin", "applies-to", "mentions")
BROADCAST_ROWS = 100_000


def _dim(df: DataFrame) -> DataFrame:
    """A registry table, broadcast while it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def resolved(rows: DataFrame, projects: DataFrame, aliases: DataFrame, column: str = "project", out: str = "canonical") -> DataFrame:
    """rows with ``out``: the alias as typed, else its slug as an alias, else a project of that slug, else null."""
    known = latest(aliases, ["alias"], ["created_at", "canonical"]).select("alias", "canonical")
    r = rows.withColumn("_slug", text.project_slug(F.col(column)))
    r = r.join(_dim(known.select(F.col("alias").alias(column), F.col("canonical").alias("_a"))), column, "left")
    r = r.join(_dim(known.select(F.col("alias").alias("_slug"), F.col("canonical").alias("_b"))), "_slug", "left")
    r = r.join(_dim(projects.select(F.col("slug").alias("_slug"), F.col("slug").alias("_c")).distinct()), "_slug", "left")
    return r.withColumn(out, F.coalesce("_a", "_b", "_c")).drop("_slug", "_a", "_b", "_c")


def _may_reach(a: Column, b: Column, ratio: float) -> Column:
    """Whether the sequence ratio can be ``ratio`` or more: twice the letters in common, over both lengths, bounds it from above."""
    both = F.length(a) + F.length(b)
    count = lambda x, c: F.length(x) - F.length(F.replace(x, c, F.lit("")))
    common = F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda n, c: n + F.least(count(a, c), count(b, c)))
    return F.when(2 * F.least(F.length(a), F.length(b)) < F.lit(ratio - 1e-9) * both, F.lit(False)).otherwise(2 * common >= F.lit(ratio - 1e-9) * both)


def ensured(projects: DataFrame, names: DataFrame, aliases: DataFrame, as_of: Column, column: str = "project", ratio: float = 0.82) -> tuple[DataFrame, DataFrame]:
    """The registry with the unknown names registered under their slugs, and (slug, near, ratio) of suspiciously close ones.

    Every new slug meets every registered one; length and letters in common leave out only pairs that cannot reach ``ratio``.
    """
    open_ = resolved(names.where(F.col(column).isNotNull() & (F.trim(column) != "")), projects, aliases, column).where(F.col("canonical").isNull())
    new = latest(open_.withColumn("slug", text.project_slug(F.col(column))).select("slug", F.col(column).alias("display_name")), ["slug"], ["display_name"])
    pairs = new.select("slug").crossJoin(_dim(projects.select(F.col("slug").alias("near")).distinct())).where("slug <> near").where(_may_reach(F.col("slug"), F.col("near"), ratio))
    near = pairs.withColumn("ratio", text.sequence_ratio(F.col("slug"), F.col("near"))).where(F.col("ratio") >= ratio).select("slug", "near", F.round("ratio", 6).alias("ratio"))
    added = new.withColumn("notes", F.lit(None).cast("string")).withColumn("created_at", as_of)
    return projects.select("slug", "display_name", "notes", "created_at").unionByName(added.select("slug", "display_name", "notes", "created_at")), near


def with_alias(aliases: DataFrame, new: DataFrame) -> DataFrame:
    """Aliases after an upsert: the last entry of an alias wins."""
    both = aliases.select("alias", "canonical", "created_at", F.lit(0).alias("turn")).unionByName(new.select("alias", "canonical", "created_at", F.lit(1).alias("turn")))
    return latest(both, ["alias"], [F.desc("turn"), F.desc("created_at"), "canonical"]).drop("turn")


def linked(links: DataFrame, new: DataFrame) -> DataFrame:
    """(memory_id, project, role, confidence) after an upsert on memory, project and role; an unknown role counts as a mention."""
    role = F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise("mentions")
    both = links.withColumn("turn", F.lit(0)).unionByName(new.withColumn("turn", F.lit(1))).withColumn("role", role)
    return latest(both, ["memory_id", "project", "role"], [F.desc("turn"), F.desc("confidence")]).drop("turn")


def links_of(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Links of the given memories in the order of roles."""
    place = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role"))
    return links.join(ids.select(F.col("id").alias("memory_id")), "memory_id", "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("memory_id").orderBy(place, "project")))


def vocabulary(projects: DataFrame, aliases: DataFrame) -> DataFrame:
    """(term, canonical) of slugs, display names and aliases of three letters or more; the first entry of a term wins."""
    parts = [
        projects.select(F.lower("slug").alias("term"), F.col("slug").alias("canonical"), F.lit(0).alias("turn")),
        projects.select(F.lower("display_name").alias("term"), F.col("slug").alias("canonical"), F.lit(1).alias("turn")),
        aliases.select(F.lower("alias").alias("term"), "canonical", F.lit(2).alias("turn")),
    ]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2]).where(F.length("term") >= 3)
    return latest(both, ["term"], ["turn", "canonical"]).select("term", "canonical")


def mentions(rows: DataFrame, vocab: DataFrame, id_col: str = "id", text_cols: tuple[str, ...] = ("subject", "body")) -> DataFrame:
    """(id, canonical): terms of any length that stand in the text, not next to an ASCII letter or digit.

    A term can only stand where each of its runs of ASCII letters and digits is a whole
    run of the text.  Texts meet terms on the longest run of a term and are then
    verified, so the work follows the texts and not texts times terms; a term without
    such a run meets all texts.  Null texts count as empty, rows without an id are left out.
    """
    runs = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("([a-z0-9]+)"), F.lit(1)))
    full = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in text_cols]))
    longest = F.array_sort(runs(F.col("term")), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).otherwise(F.lit(1)))
    t = vocab.select("term", "canonical", F.coalesce(F.get(longest, F.lit(0)), F.lit("")).alias("key"))
    r = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), full.alias("text"))
    hit = r.select("id", F.explode(F.concat(F.array(F.lit("")), runs(F.col("text")))).alias("key")).join(_dim(t), "key").select("id", "term", "canonical")
    quoted = F.concat(F.lit("\\Q"), F.replace("term", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    stands = F.col("text").contains(F.col("term")) & F.regexp_like("text", F.concat(F.lit("(?<![a-z0-9])"), quoted, F.lit("(?![a-z0-9])")))
    return hit.join(r, "id").where(stands).select("id", "canonical").distinct()


def classified(rows: DataFrame, vocab: DataFrame, id_col: str = "id", active: str = "project", judge: DataFrame | None = None) -> DataFrame:
    """(id, primary, method, also): the project a row belongs to.

    Only the active project named, or none: active.  No active one and a single
    candidate: that one.  Otherwise the answers of ``judge`` (id, primary) if it names a
    known project, else the active one.
    """
    m = mentions(rows, vocab, id_col).groupBy("id").agg(F.sort_array(F.collect_set("canonical")).alias("c"))
    r = rows.select(F.col(id_col).alias("id"), F.col(active).alias("a")).join(m, "id", "left").withColumn("c", F.coalesce("c", F.array().cast("array<string>")))
    others = F.filter("c", lambda x: ~x.eqNullSafe(F.col("a")))
    simple = F.when(F.col("a").isNotNull() & (F.size(others) == 0), F.col("a")).when(F.col("a").isNull() & (F.size("c") == 1), F.get("c", F.lit(0)))
    r = r.withColumn("s", simple)
    if judge is not None:
        known = judge.join(vocab.select(F.col("canonical").alias("primary")).distinct(), "primary", "left_semi").select("id", F.col("primary").alias("j"))
        r = r.join(known, "id", "left")
    else:
        r = r.withColumn("j", F.lit(None).cast("string"))
    primary = F.coalesce("s", "j", "a")
    method = F.when(F.col("s").isNotNull(), "context").when(F.col("j").isNotNull(), "judge").otherwise("fallback")
    return r.select("id", primary.alias("primary"), method.alias("method"), F.filter("c", lambda x: ~x.eqNullSafe(primary)).alias("also"))
