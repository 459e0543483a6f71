"""Time: every function takes the moment to look from as ``as_of``; nothing reads the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def older_than(ts: Column, as_of: Column, days: float) -> Column:
    return ts < as_of - F.make_dt_interval(secs=F.lit(days * 86400.0))


def days_since(ts: Column, as_of: Column) -> Column:
    """Whole days, rounded down; not a difference of calendar dates."""
    return F.floor((F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(86_400_000_000.0))


def recency(ts: Column, as_of: Column, span_days: int = 60) -> Column:
    """1 just now, falling in a line to 0 after ``span_days``; 0 if never."""
    return F.when(ts.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - days_since(ts, as_of) / F.lit(float(span_days))))


def temporal_status(start: Column, end: Column, today: Column) -> Column:
    """upcoming, current or past; null without a start; the end defaults to the start, both inclusive."""
    last = F.coalesce(end, start)
    return F.when(start.isNull(), F.lit(None).cast("string")).when(today < start, "upcoming").when(today > last, "past").otherwise("current")


def hour_label(ts: Column) -> Column:
    return F.date_format(F.date_trunc("hour", ts), "yyyy-MM-dd'T'HH")


def diminishing(count: Column, times: Column | int = 1) -> Column:
    """Weight gained by ``times`` further uses after ``count``: the sum of 1 / (count + 2 + i)."""
    n = times if isinstance(times, Column) else F.lit(times)
    steps = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(F.array().cast("array<long>"))
    return F.aggregate(steps, F.lit(0.0), lambda s, i: s + F.lit(1.0) / (count + 2 + i))
