"""Keyword-stuffed pages and link lists.

A text is cut into segments (lines, then sentences; short neighbours together).
Corpus counts over all different texts give the pointwise mutual information
(PMI) of neighbouring words, with the text's own words left out; copies, and
texts that differ in case, digits or marks only, count once.  A segment is spam when

* it is a list of links or hash tags by its form,
* collocations or words that the text repeats far beyond their corpus rate cover
  most of it (excessively repeated collocations), or
* it is no sentence (hardly any function words) and its neighbouring words are
  incoherent by PMI or come from a few repeated terms (word salad).

Tables, code, logs and JSON are set aside by their form.  A text is a case when
spam segments hold more than half of its characters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import cut

#: Common function words of the four languages (fixed values).
FUNCTION_WORDS = frozenset("""
a an the of to in on at by for from with and or but not no is are was were be been it its this that these those as if then than there
has have had do does did will would should can cannot could may we our you your he she they their i my who what which when where how so
because while after before into over under between about only once
der die das den dem des ein eine einen einem einer und oder aber nicht ist sind war waren wird werden hat haben hatte im am an auf aus
bei mit nach von vom zu zum zur für um es er sie wir ihr sich als wie wenn dass ob noch nur kaum etwa bis seit ohne danach niemand so oft
le la les un une du de et ou mais ne pas est sont était ont au aux en dans sur par pour avec sans ce cette ces il elle nous vous ils que
qui si après avant depuis jusqu rien jamais plus son sa ses leur l d n s
el los las una unos unas del y o pero es son era fue ha han al con sin por para su sus se lo como tras antes desde hasta nunca pese sigue
muy más este esta ni
""".split())  # fmt: skip

_ANCHOR = re.compile(r"<a\s[^>]*>(.*?)</a>", re.S | re.I)
_MARKDOWN = re.compile(r"\[([^\]]*)\]\([^)]*\)")
_URL = re.compile(r"(?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)*\.(?:example(?:\.\w+)?|test|invalid|com|net|org|info|biz|shop|io)\b(?:/\S*)?", re.I)
_LINK = "\x01"
_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"(?:^|\s)#\w")

SHORT = 8
LINK_WORDS = 6
MIN_REPEATS = 4
PAIR_RATE, WORD_RATE, LIFT = 0.012, 0.02, 5.0
FUNCTION_SHARE = 0.08
INCOHERENT_PMI, INCOHERENT_SHARE, FEW_TERMS = 1.0, 0.03, 0.10


def _kind(line: str) -> str:
    words, links = _WORD.findall(line), line.count(_LINK)
    if links and len(words) <= LINK_WORDS * links:
        return "link"
    tags = len(_TAG.findall(line))
    if tags >= 3 and tags >= 0.5 * len(line.split()):
        return "tag"
    digits, letters = sum(c.isdigit() for c in line), sum(c.isalpha() for c in line)
    marks = len(re.findall(r'[{}\[\]();=<"\\/_]', line))
    if re.fullmatch(r"\|.*\|", line) or re.match(r"\d{4}-\d\d-\d\dT", line) or marks > 0.08 * len(line) or digits > 0.25 * (digits + letters):
        return "data"
    return "text"


def segments(text: str) -> list[tuple[str, int, list[str]]]:
    """(kind, characters, words) of each segment."""
    for pattern in (_ANCHOR, _MARKDOWN):
        text = pattern.sub(lambda m: f" {_LINK} {m.group(1)} ", text)
    text = _URL.sub(f" {_LINK} ", text.replace("\x00", " "))
    text = re.sub(rf"\n\s*(?={_LINK})", " ", text)  # a link on a line of its own belongs to the line before
    out: list[tuple[str, int, list[str], bool]] = []
    for raw in text.split("\n"):
        line = raw.strip()
        if not line:
            continue
        kind = "data" if raw.startswith(("    ", "\t")) and _LINK not in raw else _kind(line)  # indented as code is
        for part in re.split(r"(?<=[.?!])\s+", line) if kind == "text" else [line]:
            words = _WORD.findall(part.lower())
            short = kind == "text" and len(words) < SHORT
            if short and out and out[-1][0] == "text" and out[-1][3]:
                out[-1] = (kind, out[-1][1] + 1 + len(part), out[-1][2] + words, True)
            else:
                out.append((kind, len(part), words, short))
    return [x[:3] for x in out]


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for doc, text in zip(pdf["id"], pdf["text"]):
            parts = segments(text)
            plain = [w for kind, _, w in parts if kind == "text"]
            singles = Counter(x for w in plain for x in w)
            pairs = Counter(p for w in plain for p in zip(w, w[1:]))
            total = sum(singles.values())
            for at, (kind, chars, words) in enumerate(parts):
                text_like = kind == "text"
                share = sum(w in FUNCTION_WORDS for w in words) / max(1, len(words))
                rows.append((doc, at, kind, chars, words if text_like else [], [singles[w] for w in words] if text_like else [], [pairs[p] for p in zip(words, words[1:])] if text_like else [], [w not in FUNCTION_WORDS for w in words] if text_like else [], total, share))
        yield pd.DataFrame(rows, columns=["id", "at", "kind", "chars", "words", "own", "own2", "content", "total", "function"])


def score_segments(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, at, kind, chars, function, repeated, incoherent, pmi): every segment with its measures."""
    texts = df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where((F.trim(F.coalesce("text", F.lit(""))) != "") & F.col("doc").isNotNull()).withColumn("id", F.xxhash64("text"))
    docs = cut(texts.select("doc", "id").distinct())
    once = texts.groupBy("id").agg(F.first("text").alias("text"))
    parts = cut(once.mapInPandas(_split, "id long, at int, kind string, chars int, words array<string>, own array<int>, own2 array<int>, content array<boolean>, total int, function double"))
    letters = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}]+", " "))
    alike = F.when(letters == "", F.col("id")).otherwise(F.xxhash64(letters))
    counted = cut(once.select("id", alike.alias("alike")).groupBy("alike").agg(F.min("id").alias("id")).select("id"))
    plain = parts.where((F.col("kind") == "text") & (F.size("words") > 0))
    corpus = plain.join(counted, "id", "left_semi")
    single = corpus.select(F.explode(F.transform("words", lambda w: F.xxhash64(w))).alias("w")).groupBy("w").agg(F.count("*").alias("c"))
    pair_hash = F.transform(F.sequence(F.lit(0), F.size("words") - 2), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1)))
    doubles = plain.where(F.size("words") > 1)
    double = corpus.where(F.size("words") > 1).select(F.explode(pair_hash).alias("p")).groupBy("p").agg(F.count("*").alias("c2"))
    single, double = cut(single), cut(double)
    n1, n2 = single.agg(F.sum("c")).first()[0] or 1, double.agg(F.sum("c2")).first()[0] or 1

    loose = F.col("function") <= FUNCTION_SHARE
    asked = doubles.select(
        "id", "at", "total", loose.alias("loose"),
        F.explode(F.transform(F.sequence(F.lit(0), F.size("words") - 2), lambda i: F.struct(i.alias("i"), F.get("own2", i).alias("o"), F.xxhash64(F.get("words", i), F.get("words", i + 1)).alias("p"), F.xxhash64(F.get("words", i)).alias("w1"), F.xxhash64(F.get("words", i + 1)).alias("w2"), F.get("own", i).alias("o1"), F.get("own", i + 1).alias("o2"), F.get("content", i).alias("k1"), F.get("content", i + 1).alias("k2")))).alias("x"),
    ).select("id", "at", "total", "loose", "x.*")
    frequent = (F.col("o") >= MIN_REPEATS) & (F.col("o") > F.lit(PAIR_RATE) * F.col("total"))
    asked = cut(asked.where(frequent | F.col("loose")).join(double, "p", "left").drop("p").withColumn("c2", F.greatest("c2", "o")))
    lifted = F.col("o") / F.col("total") >= F.lit(LIFT / n2) * (F.col("c2") - F.col("o") + 1)
    by_pair = asked.where(frequent & lifted).select("id", "at", F.explode(F.filter(F.array(F.when(F.col("k1"), F.col("i")), F.when(F.col("k2"), F.col("i") + 1)), lambda i: i.isNotNull())).alias("i"))
    words = plain.select("id", "at", "total", F.explode(F.transform("words", lambda w, i: F.struct(i.alias("i"), F.get("own", i).alias("o"), F.get("content", i).alias("k"), F.xxhash64(w).alias("w")))).alias("x")).select("id", "at", "total", "x.*")
    often = words.where(F.col("k") & (F.col("o") >= MIN_REPEATS) & (F.col("o") >= F.lit(WORD_RATE) * F.col("total"))).join(single, "w", "left").withColumn("c", F.greatest("c", "o"))
    by_word = often.where(F.col("o") / F.col("total") >= F.lit(LIFT / n1) * (F.col("c") - F.col("o") + 1)).select("id", "at", "i")
    covered = by_pair.unionByName(by_word).groupBy("id", "at").agg(F.count_distinct("i").alias("covered"))

    s1, s2 = single.select(F.col("w").alias("w1"), F.col("c").alias("c1")), single.select(F.col("w").alias("w2"), F.col("c").alias("cc"))
    alone = F.col("c2") <= F.col("o")  # no other text has these neighbours
    pmi = F.when(alone, F.lit(-3.0)).otherwise(F.greatest(F.lit(-3.0), F.log2((F.col("c2") - F.col("o") + 0.05) * F.lit(float(n1)) / ((F.col("c1") - F.col("o1") + 1) * (F.col("cc") - F.col("o2") + 1)))))
    salad = asked.where("loose").join(s1, "w1", "left").join(s2, "w2", "left").withColumns({"c1": F.greatest("c1", "o1"), "cc": F.greatest("cc", "o2")}).groupBy("id", "at").agg(F.avg(pmi).alias("pmi"), F.avg((pmi < INCOHERENT_PMI).cast("double")).alias("incoherent"))
    measured = parts.select("id", "at", "kind", "chars", "function", F.size("words").alias("n")).join(covered, ["id", "at"], "left").join(salad, ["id", "at"], "left")
    measured = measured.withColumn("repeated", F.coalesce(F.col("covered") / (F.col("n") * (1 - F.col("function"))), F.lit(0.0)))
    return docs.join(measured, "id").drop("id").withColumnRenamed("doc", "id")


def spam_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, share): the texts whose larger part is spam, with the share of their characters in spam segments.

    Null, empty, blank and one-word texts are no cases, nor are rows without an id.  Repeated rows of one id
    count together and come out once; an empty table gives an empty result.
    """
    s = score_segments(df, id_col, text_col)
    repeats = ((F.col("repeated") >= 0.4) & (F.col("function") <= 0.1)) | ((F.col("repeated") >= 0.55) & (F.col("function") <= 0.2)) | (F.col("repeated") >= 0.8)
    no_sentence = (F.col("n") >= SHORT) & (F.col("function") <= FUNCTION_SHARE)
    salad = no_sentence & ((F.coalesce("incoherent", F.lit(0.0)) >= INCOHERENT_SHARE) | (F.coalesce("pmi", F.lit(9.0)) < INCOHERENT_PMI) | (F.col("repeated") >= FEW_TERMS))
    bad = F.col("kind").isin("link", "tag") | ((F.col("kind") == "text") & (repeats | salad))
    share = F.sum(F.when(bad, F.col("chars")).otherwise(0)) / F.sum("chars")
    many_words = F.sum(F.when(F.col("kind") == "text", F.col("n")).otherwise(2)) > 1
    found = s.groupBy("id").agg(share.alias("share"), many_words.alias("many")).where("share > 0.5 and many")
    return found.select(F.col("id").alias(id_col), "share")
