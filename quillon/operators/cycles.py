"""Market cycles, for reading results against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: First day, last day (none: open, not yet confirmed), direction.
CYCLES = (
    ("2013-06-25", "2015-06-12", "up"),
    ("2015-06-12", "2016-01-28", "down"),
    ("2016-01-28", "2017-11-13", "up"),
    ("2017-11-13", "2018-10-18", "down"),
    ("2018-10-18", "2021-12-13", "up"),
    ("2021-12-13", "2024-02-05", "down"),
    ("2024-02-05", None, "up"),
)


def cycle_table(spark: SparkSession, cycles: tuple = CYCLES) -> DataFrame:
    """(start, stop, direction, provisional): a handful of rows."""
    rows = spark.createDataFrame([(a, b, d, b is None) for a, b, d in cycles], "start string, stop string, direction string, provisional boolean")
    return rows.withColumns({c: F.to_date(c) for c in ("start", "stop")})


def cycles_of(daily: DataFrame, cycles: DataFrame) -> DataFrame:
    """cycles cut to the days of daily, an open one to the last of them; those outside go."""
    span = daily.agg(F.min("day").alias("_lo"), F.max("day").alias("_hi"))
    out = cycles.join(F.broadcast(span), F.lit(True), "cross")
    out = out.withColumn("start", F.greatest("start", "_lo")).withColumn("stop", F.least(F.coalesce("stop", "_hi"), "_hi"))
    return out.where("start <= stop").drop("_lo", "_hi")
