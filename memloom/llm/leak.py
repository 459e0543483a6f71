"""Evaluation passages inside training texts: prefix-filtered set join on word shingles.

An item leaks where a text holds an unbroken run of RUN words of it.  Such a
window has RUN - SHINGLE + 1 shingles of SHINGLE words, and a text that holds the
window holds all of them.  With full containment one necessary prefix token of
each window is enough: its rarest shingle by its number of places in all texts.
A window with a shingle that no text holds cannot leak and is dropped.  Texts
are joined on these tokens, the place of the shingle in the window gives where
the window would start in the text (positional bound), which must leave room for
RUN words (length bound), and the words there are compared one by one.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from memloom.llm.common import cut

RUN = 12
SHINGLE = 5
#: Rows up to which item shingles (one long each) or chosen prefixes (four numbers each) are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000

_WORD = re.compile(r"[^\W_]+")


@F.pandas_udf(StringType())
def plain_words(text: pd.Series) -> pd.Series:
    """Words by a blank: letters or digits after NFKD, without combining marks, lower-cased."""

    def one(t: str | None) -> str:
        if t is None:
            return ""
        if not t.isascii():
            t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
        return " ".join(_WORD.findall(t.lower()))

    return text.map(one)


def _words(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), plain_words(F.col(text_col)).alias("line")).where(F.length("line") > 0)


def _shingles(words: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(words, i + 1, F.lit(size))).alias("s")))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast while its own rows are few."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, windows): texts that hold at least one window of an item, and how many different ones.

    Null, empty and shorter texts hold none; repeated rows count once; empty tables
    give an empty result.
    """
    long_enough = F.size(F.split("line", " ")) >= RUN
    texts = cut(_words(docs, doc_id, text_col).where(long_enough))
    sources = _words(items, item_id, text_col).where(long_enough).withColumn("w", F.split("line", " "))
    windows = sources.select(F.col("id").alias("item"), F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - RUN), lambda i: F.slice("w", i + 1, F.lit(RUN)))).alias("words"))
    # Items share windows; each different one has a number of its own and is searched once.
    windows = windows.groupBy("words").agg(F.collect_set("item").alias("items")).withColumn("window", F.monotonically_increasing_id())
    windows = cut(windows)
    parts = cut(windows.select("window", F.explode(_shingles(F.col("words"), SHINGLE)).alias("p")).select("window", "p.at", "p.s"))
    tokens = parts.select("s").distinct()
    here = texts.select("id", F.split("line", " ").alias("w")).select("id", F.explode(_shingles(F.col("w"), SHINGLE)).alias("p")).select("id", F.col("p.at").alias("place"), "p.s")
    hits = cut(here.join(_small(tokens), "s"))
    held = hits.groupBy("s").agg(F.count("*").alias("texts"))
    by = Window.partitionBy("window")
    ranked = parts.join(held, "s", "left").withColumn("least", F.min(F.coalesce("texts", F.lit(0))).over(by)).withColumn("order", F.row_number().over(by.orderBy("texts", "s", "at")))
    prefix = cut(ranked.where("least > 0 and order = 1").select("window", "at", "s"))
    places = hits.join(_small(prefix), "s").select("id", "window", (F.col("place") - F.col("at")).alias("start")).where("start >= 0")
    there = places.join(texts.select("id", F.split("line", " ").alias("w")), "id").where(F.col("start") + RUN <= F.size("w")).select("id", "window", F.slice("w", F.col("start") + 1, F.lit(RUN)).alias("words"))
    checked = there.join(windows, ["window", "words"]).select("id", "window", F.explode("items").alias("item"))
    return checked.groupBy(F.col("id").alias("doc_id"), F.col("item").alias("item_id")).agg(F.count_distinct("window").alias("windows"))
