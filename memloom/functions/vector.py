"""Vectors as array<float>; all arithmetic in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """Not null, not empty, every value finite, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where the lengths differ or a vector is unusable."""
    return F.when((F.size(a) == F.size(b)) & usable(a) & usable(b), dot(a, b) / F.sqrt(dot(a, a)) / F.sqrt(dot(b, b)))


def centroid(df: DataFrame, by: list[str], vec: str = "embedding") -> DataFrame:
    """(by, centroid, members): the element-wise mean of the usable vectors of each group.

    Sums are formed per position before the shuffle; only one row for each group and
    position moves.
    """
    ok = df.where(usable(F.col(vec)))
    flat = ok.select(*by, F.posexplode(vec).alias("pos", "x"))
    mean = flat.groupBy(*by, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("members"))
    return mean.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"), F.max("members").alias("members"))
