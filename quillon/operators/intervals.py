"""Joins of points with intervals by buckets: equality of a bucket and a residual range, no cross join, nothing unfolded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _number(c: Column, kind: str) -> Column:
    """A day, time or whole number as a whole number that keeps the order."""
    return F.unix_date(c).cast("long") if kind == "date" else F.unix_micros(c) if kind == "timestamp" else c.cast("long")


def interval_join(points: DataFrame, intervals: DataFrame, at: str, start: str, stop: str, keys: list[str] | None = None, how: str = "inner") -> DataFrame:
    """points joined with the intervals (start to stop, both included) that hold their value of `at` and agree on keys.

    An interval belongs to the level at which buckets are as long as it is or up to twice that, so it lies in two
    buckets at most, however long it is; a point looks into one bucket of each level that occurs. Levels are as few as
    the powers of two up to the longest interval, so what is shuffled does not grow with the intervals' lengths.
    Intervals without a start, without a stop or with a stop before the start hold nothing. how: inner, left_semi or left_anti.
    A file's size says little about its rows in buckets, so neither side is broadcast by it; points that are few whatever
    the input may be marked with F.broadcast.
    """
    if how not in ("inner", "left_semi", "left_anti"):
        raise ValueError("how must be inner, left_semi or left_anti")
    keys = list(keys or [])
    kinds = dict(points.dtypes) | dict(intervals.dtypes)
    low, high = _number(F.col(start), kinds[start]), _number(F.col(stop), kinds[stop])
    spans = intervals.withColumn("_lo", low).withColumn("_hi", high).where("_lo <= _hi")
    # Buckets of 2^level are no shorter than the interval: level is the number of binary digits of its length.
    spans = spans.withColumn("_level", F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(F.length(F.bin(F.col("_hi") - F.col("_lo")))).cast("int"))
    # One small number a level, 63 at most.
    levels = sorted(r[0] for r in spans.select("_level").distinct().collect())
    # Shifting to the right rounds down, also below zero.
    first, last = F.expr("shiftright(_lo, _level)"), F.expr("shiftright(_hi, _level)")
    spans = spans.withColumn("_bucket", F.explode(F.array_distinct(F.array(first, last))))
    value = _number(F.col(at), kinds[at])
    looks = points.withColumn("_v", value)
    buckets = [F.struct(F.lit(k).cast("int").alias("_level"), F.shiftright("_v", k).alias("_bucket")) for k in levels]
    looks = looks.withColumn("_look", F.explode(F.array(*buckets)) if buckets else F.lit(None).cast("struct<_level:int,_bucket:bigint>"))
    a, b = looks.alias("a"), spans.select(*keys, "_level", "_bucket", "_lo", "_hi", *[c for c in intervals.columns if c not in keys]).hint("merge").alias("b")
    on = (F.col("a._look._level") == F.col("b._level")) & (F.col("a._look._bucket") == F.col("b._bucket")) & F.col("a._v").between(F.col("b._lo"), F.col("b._hi"))
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    if how == "inner":
        return a.join(b, on).select(*[F.col(f"a.{c}") for c in points.columns], *[F.col(f"b.{c}") for c in intervals.columns if c not in keys])
    # A point looks into several buckets, so what it finds is gathered by its own number.
    marked = points.withColumn("_id", F.monotonically_increasing_id())
    hits = interval_join(marked, intervals.select(*keys, start, stop), at, start, stop, keys).select("_id").distinct()
    return marked.join(hits.hint("merge"), "_id", how).select(*points.columns)
