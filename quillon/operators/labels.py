"""Forward labels, sample windows and blocks of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.rules import divide, finite
from quillon.functions.texts import as_day


def forward_open_return(panel: DataFrame, horizon: int = 1, name: str = "fwd") -> DataFrame:
    """Open to open: bought at the next day's open and sold horizon days later."""
    if isinstance(horizon, bool) or not isinstance(horizon, int) or horizon < 1:
        raise ValueError("the horizon must be a whole number of 1 or more")
    ahead = W.partitionBy("code").orderBy("t")
    # Columns of their own: a window function is computed each time it is named, and the quotient names its sides often.
    panel = panel.withColumns({"_bought": F.lead("o", 1).over(ahead), "_sold": F.lead("o", horizon + 1).over(ahead)})
    return panel.withColumn(name, finite(divide(F.col("_sold"), F.col("_bought")) - 1)).drop("_bought", "_sold")


def sample_window(rows: DataFrame, first=None, last=None, horizon: int = 1, calendar: DataFrame | None = None, zone: str | None = None) -> DataFrame:
    """Days from first to last; a bounded window loses its last horizon + 1 days, whose labels lie beyond it.

    The days, one small row each, are looked at on the driver, so what stays is a filter between two days that can reach
    a scan. calendar: a table of the days, where reading them from rows would compute more than that. A window that is
    empty, the wrong way round or too short for one label is an error.
    """
    if first is None and last is None:
        return rows
    lo, hi = (None if x is None else as_day(x, zone) for x in (first, last))
    if lo is not None and hi is not None and lo > hi:
        raise ValueError("the window's first day comes after its last")
    days = sorted(r.day for r in (calendar if calendar is not None else rows).select("day").distinct().collect())
    days = [d for d in days if (lo is None or d >= lo) and (hi is None or d <= hi)]
    if len(days) < horizon + 2:
        raise ValueError(f"the window has {len(days)} days; a label needs {horizon + 2}")
    return rows.where(F.col("day").between(F.lit(days[0]), F.lit(days[-(horizon + 2)])))


def blocks(daily: DataFrame, size: int, by: list[str] | None = None) -> DataFrame:
    """Adds block (from 0) and block_end, the last day of each run of size rows in order of t; an incomplete tail goes."""
    keys = list(by or [])
    order = W.partitionBy(*(keys or [F.lit(1)])).orderBy("t")
    numbered = daily.withColumn("block", F.floor((F.row_number().over(order) - 1) / size).cast("int"))
    whole = W.partitionBy(*keys, "block")
    return numbered.withColumn("_n", F.count(F.lit(1)).over(whole)).where(F.col("_n") == size).withColumn("block_end", F.max("day").over(whole)).drop("_n")
