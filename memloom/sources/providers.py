"""Interfaces to models.  Nothing here calls out; defaults are deterministic.

A provider gets a frame and returns one.  By contract null means not asked, and an
empty answer means asked and nothing found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import text


class Embedder(Protocol):
    model: str
    dimensions: int

    def embed(self, rows: DataFrame, text_col: str, out: str = "embedding") -> DataFrame: ...


@dataclass(frozen=True)
class HashEmbedder:
    """Signed hashed words, of unit length: a stand-in for a model in tests and offline use.  Empty texts get null."""

    model: str = "hash-64"
    dimensions: int = 64

    def embed(self, rows: DataFrame, text_col: str, out: str = "embedding") -> DataFrame:
        size = self.dimensions

        def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                made = []
                for t in pdf[text_col]:
                    v = np.zeros(size)
                    for w in (t or "").lower().split():
                        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                        v[h % size] += 1.0 if h >> 63 else -1.0
                    n = np.linalg.norm(v)
                    made.append((v / n).astype("float32") if n else None)
                yield pdf.assign(**{out: made})

        return rows.mapInPandas(vectors, ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes if c != out), f"`{out}` array<float>"])) if out not in rows.columns else self.embed(rows.drop(out), text_col, out)


def checked_dimensions(rows: DataFrame, size: int, vec: str = "embedding") -> DataFrame:
    """The rows, but reading them fails where a vector has another length."""
    ok = F.col(vec).isNull() | (F.size(vec) == size)
    return rows.where(F.when(~ok, F.raise_error(F.lit("vector of another length")).cast("boolean")).otherwise(F.lit(True)))


@dataclass
class Budget:
    """Calls that may still be made."""

    left: int

    def take(self, wanted: int = 1) -> int:
        granted = max(0, min(self.left, wanted))
        self.left -= granted
        return granted


def answer_text(blocks: Iterable[dict[str, str]], stop: str | None) -> str | None:
    """Joined text blocks of a finished answer; null for a cut, refused, paused or empty one."""
    if stop not in (None, "end_turn", "stop_sequence"):
        return None
    joined = "".join(b.get("text", "") for b in blocks if b.get("type") == "text").strip()
    return joined or None


def short_forms(memories: DataFrame, budget: int, answers: DataFrame | None = None, target: int = 400) -> DataFrame:
    """(id, recall_form): long rows of the knowledge tiers without a short form, the most used first.

    ``answers`` (id, form) come from a model; without them the start of the body serves.
    A form that is not shorter than the body is rejected.
    """
    due = memories.where((F.length("body") > target) & F.col("tier").isin("curated", "insight", "decision", "project") & F.col("recall_form").isNull() & ~F.coalesce("archived", F.lit(False)))
    due = due.orderBy(F.desc_nulls_last("weight"), F.desc("created_at"), "id").limit(budget).select("id", "body")
    due = due.join(answers.select("id", "form"), "id") if answers is not None else due.withColumn("form", F.col("body"))
    form = text.trim_sentence(F.col("form"), target)
    return due.withColumn("recall_form", form).where((F.length("recall_form") > 0) & (F.length("recall_form") < F.length("body"))).select("id", "recall_form")


def lens_rows(memories: DataFrame, lenses: DataFrame, wanted: tuple[str, ...], batch: int | None = None) -> DataFrame:
    """(id, perspective): lenses still to be made, for rows that lack any of ``wanted``, in the order of ids."""
    have = lenses.where(F.col("perspective").isin(*wanted)).groupBy("memory_id").agg(F.collect_set("perspective").alias("have"))
    open_ = memories.where(~F.coalesce("archived", F.lit(False))).select("id").join(have.select(F.col("memory_id").alias("id"), "have"), "id", "left")
    missing = F.array_except(F.array(*[F.lit(w) for w in wanted]), F.coalesce("have", F.array().cast("array<string>")))
    open_ = open_.withColumn("missing", missing).where(F.size("missing") > 0)
    if batch is not None:
        open_ = open_.orderBy("id").limit(batch)
    return open_.select("id", F.explode("missing").alias("perspective"))


def prompt_blocks(rows: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, prompt): rows with node_type, subject, body, status and pos as text: 8 facts, 5 anchors, 4 sentiments, 3 questions at most."""
    most = {"fact": ("Facts", 8), "anchor": ("Anchors", 5), "sentiment": ("Sentiments", 4), "faq": ("Questions", 3)}
    r = rows.where(F.col("node_type").isin(*most)).withColumn("n", F.row_number().over(Window.partitionBy(by, "node_type").orderBy("pos")))
    cap = F.create_map(*[x for k, (_, n) in most.items() for x in (F.lit(k), F.lit(n))])
    order = F.create_map(*[x for i, k in enumerate(most) for x in (F.lit(k), F.lit(i))])
    hint = F.when(F.col("status") == "past", " (past)").when(F.col("status") == "upcoming", " (upcoming)").when(F.col("status") == "current", " (now)").otherwise("")
    r = r.where(F.col("n") <= cap[F.col("node_type")]).withColumn("line", F.concat(F.lit("- "), text.flatten_clip(F.col("body"), 220), hint)).withColumn("o", order[F.col("node_type")])
    title = F.create_map(*[x for k, (t, _) in most.items() for x in (F.lit(k), F.lit(t))])
    block = r.groupBy(by, "node_type", "o").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    return block.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", F.concat(title[F.col("node_type")], F.lit(":\n"), F.col("lines")).alias("t")))), lambda x: x["t"]), "\n\n").alias("prompt"))
