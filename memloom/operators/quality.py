"""Advisory checks on rows as they are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions import text
from memloom.operators import search

TEMPLATE_AT, PREFIX, LEAST_PREFIX, WEAK, LONG = 5, 40, 12, 15, 2000


def template_siblings(memories: DataFrame, consistent: bool = True) -> DataFrame:
    """(id, siblings): how many other rows share the subject's prefix once digits are levelled.

    ``consistent`` levels digits before cutting on both sides; otherwise the stored side
    is cut first, then levelled.
    """
    mine = text.norm_prefix(F.col("subject"), PREFIX)
    other = mine if consistent else F.regexp_replace(F.substring(F.trim(F.coalesce("subject", F.lit(""))), 1, PREFIX), r"\d+", "#")
    counts = memories.groupBy(other.alias("prefix")).agg(F.count("*").alias("n"))
    rows = memories.select("id", mine.alias("prefix"), other.alias("own"))
    return rows.join(counts, "prefix", "left").select("id", F.when(F.length("prefix") >= LEAST_PREFIX, F.coalesce("n", F.lit(0)) - (F.col("own") == F.col("prefix")).cast("int")).otherwise(0).alias("siblings"))


def weak_subject(subject: Column) -> Column:
    """short, url-like, or null if neither."""
    s = F.trim(F.coalesce(subject, F.lit("")))
    return F.when(F.length(s) < WEAK, "short").when(s.rlike(text.URLISH), "url-like")


def warnings(memories: DataFrame, as_of: Column, asked: DataFrame | None = None, searched: DataFrame | None = None) -> DataFrame:
    """(id, n, code): the warnings of the asked rows (all if None), in the order of the checks.

    Near duplicates are looked for from the rows of ``searched`` only (the asked ones if
    ``asked`` is given and it is not), as each of them is a search over all.
    """
    rows = memories if asked is None else memories.join(asked.select("id"), "id", "left_semi")
    w = rows.join(template_siblings(memories), "id", "left")
    searched = rows if searched is None and asked is not None else searched
    near = search.near_duplicates(memories, searched, as_of).select("id", "other") if searched is not None else rows.select("id", F.lit(None).cast("long").alias("other")).limit(0)
    w = w.join(near, "id", "left")
    checks = [
        ("templated_subject", F.coalesce(F.col("siblings") >= TEMPLATE_AT, F.lit(False))),
        ("near_duplicate", F.col("other").isNotNull()),
        ("weak_subject", weak_subject(F.col("subject")).isNotNull()),
        ("no_project", F.col("project").isNull()),
        ("long_body", F.coalesce(F.length("body") > LONG, F.lit(False))),
    ]
    codes = F.filter(F.array(*[F.when(c, F.struct(F.lit(i).alias("n"), F.lit(code).alias("code"))) for i, (code, c) in enumerate(checks, 1)]), lambda x: x.isNotNull())
    return w.select("id", F.explode(codes).alias("w")).select("id", "w.n", "w.code")


def assert_one_model(memories: DataFrame, model: str) -> DataFrame:
    """The rows, but reading them fails where a vector comes from another model."""
    other = F.col("embedding_model").isNotNull() & (F.col("embedding_model") != model)
    return memories.where(F.when(other, F.raise_error(F.concat(F.lit("vector of another model: "), F.col("embedding_model"))).cast("boolean")).otherwise(F.lit(True)))


def models(memories: DataFrame) -> DataFrame:
    """(embedding_model, dimensions, n) of the stored vectors."""
    return memories.where(F.col("embedding").isNotNull()).groupBy("embedding_model", F.size("embedding").alias("dimensions")).agg(F.count("*").alias("n"))
