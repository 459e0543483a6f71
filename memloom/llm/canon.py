"""Mapping freely typed values to a reference list.

The distinct values are normalised, then looked up in an inverted index of the
character n-grams of all reference strings (names and their aliases).  The score
is the weighted cosine of the n-grams, with weights from the rarity of a gram
among the references.  Candidates at MIN_COSINE or more then pass an exact check
of edit distances, word by word or over the joined words, and the best one is
accepted where it leads every other canonical value by MARGIN.  The FIRST nearest
candidates are checked first; where they leave the answer open, all others are.
"""

from __future__ import annotations

import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from memloom.llm.common import cut

UNMATCHED = "unmatched"
MIN_COSINE = 0.15
MARGIN = 0.02
FIRST = 8
#: Weight of a gram that no reference has, as a share of the weight of one that a single reference has: most come from slips.
UNSEEN = 0.5
WORD_EDITS = 0.45
JOINED_EDITS = 0.20
SHORTENED = 0.70
#: Words people wrap around a name (fixed values).
WRAPPING = frozenset("a an the my our project proj repo repository team old new name formerly aka phase see re".split())
#: Digits typed for letters (fixed values).
DIGIT_LETTERS = str.maketrans({"0": "o", "1": "l", "3": "e", "5": "s", "4": "a", "7": "t"})


def _norm(value: str | None) -> str:
    if value is None:
        return ""
    text = re.sub(r"(?<=[a-zß-ÿ])(?=[A-Z])", " ", unicodedata.normalize("NFKC", value))
    text = re.sub(r"(?<=\S)\s*\([^()]*\)\s*$", "", text)  # a remark in brackets after the name
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    words = []
    for w in re.findall(r"[^\W_]+", text):
        if any(c.isalpha() for c in w):
            words.append(w.translate(DIGIT_LETTERS) if any(c.isdigit() for c in w) else w)
    kept = [w for w in words if w not in WRAPPING]
    return " ".join(kept or words)


@F.pandas_udf(StringType())
def normal(values: pd.Series) -> pd.Series:
    """Words in lower case without accents, wrapping words and bare numbers, joined by a blank."""
    return values.map(_norm)


def _grams(norm: Column) -> Column:
    padded = F.transform(F.split(norm, " "), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    by = lambda n: F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - (n - 1), F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))))
    return F.filter(F.array_distinct(F.concat(by(2), by(3))), lambda g: F.length(g) > 1)


def _orders(words: Column) -> Column:
    """The words joined in each order, for two or three words; otherwise forward and backward."""
    w = lambda *at: F.concat(*[F.get(words, i) for i in at])
    three = F.array(w(0, 1, 2), w(0, 2, 1), w(1, 0, 2), w(1, 2, 0), w(2, 0, 1), w(2, 1, 0))
    return F.when(F.size(words) == 3, three).otherwise(F.array(F.array_join(words, ""), F.array_join(F.reverse(words), "")))


def _edits(a: Column, b: Column) -> Column:
    """Edit distance in which a swap of letters counts about one."""
    letters = lambda x: F.array_join(F.array_sort(F.split(x, "")), "")
    return (F.levenshtein(a, b) + F.levenshtein(letters(a), letters(b))) / 2


def references(names: DataFrame, aliases: DataFrame, name_col: str, alias_col: str, target_col: str) -> DataFrame:
    """(canonical, norm): every way to write each canonical value; alias targets may be loosely spelled."""
    own = names.select(F.col(name_col).alias("canonical"), normal(F.col(name_col)).alias("norm")).where("norm <> ''").dropDuplicates()
    known = aliases.select(normal(F.col(alias_col)).alias("norm"), normal(F.col(target_col)).alias("t")).where("norm <> ''")
    glued = own.select("canonical", F.regexp_replace("norm", " ", "").alias("k"))
    joined = known.withColumn("k", F.regexp_replace("t", " ", "")).join(glued, "k").select("canonical", "norm")
    return own.unionByName(joined).distinct()


def match(values: DataFrame, refs: DataFrame, value_col: str) -> DataFrame:
    """(value, canonical, score) of every distinct non-blank value; canonical is UNMATCHED where none is accepted.

    Ties between canonical values are left unmatched.  Null and blank values have
    no row; an empty reference list leaves every value unmatched.
    """
    plain = values.select(F.col(value_col).alias("value")).where(F.col("value").isNotNull() & (F.regexp_replace("value", r"(?U)\s+", "") != "")).distinct()
    normed = cut(plain.withColumn("norm", normal("value")))
    asked = normed.select("norm").where("norm <> ''").distinct()
    refs = cut(refs)
    texts = refs.select("norm").distinct()
    number = texts.count()
    grams = texts.select(F.col("norm").alias("ref"), F.explode(_grams(F.col("norm"))).alias("g"))
    weight = grams.groupBy("g").agg(F.log(F.lit(1.0 + number) / F.count("*")).alias("w"))
    rarest = UNSEEN * math.log(1.0 + number)
    posted = cut(grams.join(weight, "g"))
    ref_norm = posted.groupBy("ref").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("rn"))
    mine = asked.select("norm", F.explode(_grams(F.col("norm"))).alias("g")).join(weight, "g", "left").withColumn("w", F.coalesce("w", F.lit(rarest)))
    mine = cut(mine)
    value_norm = mine.groupBy("norm").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("vn"))
    dots = mine.join(posted.select("g", "ref"), "g").groupBy("norm", "ref").agg(F.sum(F.col("w") * F.col("w")).alias("dot"))
    scored = dots.join(ref_norm, "ref").join(value_norm, "norm").select("norm", "ref", (F.col("dot") / F.col("rn") / F.col("vn")).alias("cos")).where(F.col("cos") >= MIN_COSINE)
    best = Window.partitionBy("norm").orderBy(F.desc("cos"), "ref")
    scored = cut(scored.withColumn("place", F.row_number().over(best)))
    vw, rw = F.split("norm", " "), F.split("ref", " ")
    joined, whole = F.array_join(F.split("norm", " "), ""), _orders(rw)
    word = lambda a, b: F.when((F.length(a) >= 3) & b.startswith(a), F.lit(0.0)).otherwise(_edits(a, b) / F.length(b))
    worst = lambda xs, ys, turn: F.array_max(F.transform(xs, lambda x: F.array_min(F.transform(ys, lambda y: word(y, x) if turn else word(x, y)))))
    by_word = (F.size(vw) == F.size(rw)) & (worst(rw, vw, True) <= WORD_EDITS) & (worst(vw, rw, False) <= WORD_EDITS)
    by_whole = F.array_min(F.transform(whole, lambda o: _edits(joined, o) / F.length(o))) <= JOINED_EDITS
    short = F.exists(whole, lambda o: o.startswith(joined) & (F.length(joined) >= F.length(o) * SHORTENED))
    # Edits are at least the difference in length, which is cheap to look at first.
    shorter, longer = F.length(joined), F.length(F.replace("ref", F.lit(" "), F.lit("")))
    by_whole = (F.abs(shorter - longer) <= F.lit(JOINED_EDITS + 1e-9) * longer) & by_whole
    fits = F.when(F.length("ref") <= 5, F.col("norm") == F.col("ref")).otherwise(by_word | by_whole | short)
    lead = Window.partitionBy("norm").orderBy(F.desc("score"), "canonical")

    def leaders(near: DataFrame) -> DataFrame:
        good = near.join(refs.select(F.col("norm").alias("ref"), "canonical"), "ref").groupBy("norm", "canonical").agg(F.max("cos").alias("score"))
        return good.withColumn("place", F.row_number().over(lead)).withColumn("next", F.lead("score").over(lead)).where("place = 1")

    # What follows the FIRST candidates has a cosine of at most theirs: it changes nothing where the leader is further ahead, or is tied already.
    early = cut(scored.where(F.col("place") <= FIRST).where(fits).select("norm", "ref", "cos"))
    floor = scored.where(F.col("place") == FIRST).select("norm", F.col("cos").alias("floor"))
    led = leaders(early)
    decided = led.join(floor, "norm").where((F.col("score") - F.col("floor") >= MARGIN) | (F.col("score") - F.col("next") < MARGIN)).select("norm")
    late = scored.where(F.col("place") > FIRST).join(decided, "norm", "left_anti").where(fits).select("norm", "ref", "cos")
    first = leaders(early.unionByName(late))
    sure = first.where(F.col("next").isNull() | (F.col("score") - F.col("next") >= MARGIN)).select("norm", "canonical", "score")
    return normed.join(sure, "norm", "left").select("value", F.coalesce("canonical", F.lit(UNMATCHED)).alias("canonical"), "score")


def canonical_rows(rows: DataFrame, names: DataFrame, aliases: DataFrame, id_col: str = "memory_id", value_col: str = "project", name_col: str = "slug", alias_col: str = "alias", target_col: str = "canonical") -> DataFrame:
    """(id_col, canonical) of every row whose value is neither null nor blank; rows repeated as a whole come out once."""
    found = match(rows, references(names, aliases, name_col, alias_col, target_col), value_col)
    typed = rows.select(id_col, F.col(value_col).alias("value")).where(F.col("value").isNotNull())
    return typed.join(found.select("value", F.col("canonical").alias("canonical")), "value").select(id_col, "canonical").distinct()
