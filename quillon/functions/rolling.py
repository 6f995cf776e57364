"""Functions over time (trailing rows of a code) and over codes (one day), as window columns on the dense panel.

The panel's days are numbered without gaps (t). A window of w rows ends at the current row. Except where said otherwise a value needs max(1, w // 2) finite rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillon.functions.rules import divide, finite, no_nan


def _trail(w: int):
    return W.partitionBy("code").orderBy("t").rowsBetween(-(w - 1), 0)


def _so_far():
    return W.partitionBy("code").orderBy("t").rowsBetween(W.unboundedPreceding, 0)


def _gated(x: Column, w: int, value, least: int | None = None) -> Column:
    y, over = finite(x), _trail(w)
    return F.when(F.count(y).over(over) >= (max(1, w // 2) if least is None else least), value(y, over))


def ts_mean(x: Column, w: int) -> Column:
    return _gated(x, w, lambda y, o: F.avg(y).over(o))


def ts_std(x: Column, w: int) -> Column:
    return _gated(x, w, lambda y, o: F.stddev_pop(y).over(o))


def ts_sum(x: Column, w: int) -> Column:
    return _gated(x, w, lambda y, o: F.sum(y).over(o))


def ts_min(x: Column, w: int) -> Column:
    return _gated(x, w, lambda y, o: F.min(y).over(o))


def ts_max(x: Column, w: int) -> Column:
    return _gated(x, w, lambda y, o: F.max(y).over(o))


def ts_median(x: Column, w: int) -> Column:
    return _gated(x, w, lambda y, o: F.percentile(y, F.lit(0.5)).over(o))


def ts_product(x: Column, w: int) -> Column:
    """Any missing row makes the product missing; rows before the first count as one."""
    y, o = finite(x), _trail(w)
    n = F.count(y).over(o)
    return F.when((n == F.count(F.lit(1)).over(o)) & (n >= max(1, w // 2)), F.product(y).over(o))


def ts_count(condition: Column, w: int) -> Column:
    o = _trail(w)
    return F.when(F.count(F.lit(1)).over(o) >= max(1, w // 2), F.sum(condition.cast("double")).over(o))


def _both(x: Column, y: Column) -> tuple[Column, Column]:
    ok = finite(x).isNotNull() & finite(y).isNotNull()
    return F.when(ok, x), F.when(ok, y)


def ts_cov(x: Column, y: Column, w: int) -> Column:
    (a, b), o = _both(x, y), _trail(w)
    return F.when(F.count(a).over(o) >= max(2, w // 2), F.covar_pop(a, b).over(o))


def ts_corr(x: Column, y: Column, w: int) -> Column:
    """Pearson correlation of the rows finite in both; missing where either side is constant."""
    (a, b), o = _both(x, y), _trail(w)
    moves = (F.max(a).over(o) > F.min(a).over(o)) & (F.max(b).over(o) > F.min(b).over(o))
    spread = F.stddev_pop(a).over(o) * F.stddev_pop(b).over(o)
    return F.when((F.count(a).over(o) >= max(2, w // 2)) & moves & (spread > 0), F.covar_pop(a, b).over(o) / spread)


def ts_rank(x: Column, w: int) -> Column:
    """The average-tie rank of the newest row among its window's, over their number. Holds the window's values for a row."""
    y = finite(x)
    seen = F.collect_list(y).over(_trail(w))
    return F.when(
        y.isNotNull(),
        F.transform(
            F.array(F.struct(seen.alias("a"), y.alias("y"))),
            lambda s: F.when(F.size(s["a"]) >= max(1, w // 2), (F.size(F.filter(s["a"], lambda v: v < s["y"])) + (F.size(F.filter(s["a"], lambda v: v == s["y"])) + 1) / 2) / F.size(s["a"])),
        )[0],
    )


def _place(x: Column, w: int, sign: int) -> Column:
    y, o = finite(x), _trail(w)
    at = F.min(F.when(y.isNotNull(), F.struct((sign * y).alias("v"), F.col("t").alias("t")))).over(o)["t"]
    return F.when(F.count(y).over(o) >= max(1, w // 2), (at - F.greatest(F.col("t") - w + 1, F.lit(0)) + 1).cast("double"))


def ts_argmax(x: Column, w: int) -> Column:
    """The place of the largest row, 1 for the oldest; the oldest of equals."""
    return _place(x, w, -1)


def ts_argmin(x: Column, w: int) -> Column:
    return _place(x, w, 1)


def delay(x: Column, p: int) -> Column:
    return F.lag(x, p).over(W.partitionBy("code").orderBy("t"))


def delta(x: Column, p: int) -> Column:
    return no_nan(x - delay(x, p))


def pct(x: Column, p: int) -> Column:
    return no_nan(divide(x, delay(x, p)) - 1)


def _weighted(x: Column, w: int, base: Column, least: int | None) -> Column:
    y, o = finite(x), _trail(w)
    s = F.col("t").cast("double")
    top = F.sum(y * s).over(o) - base * F.sum(y).over(o)
    under = F.sum(F.when(y.isNotNull(), s)).over(o) - base * F.count(y).over(o)
    gate = under > 0 if least is None else F.count(y).over(o) >= least
    return F.when(gate & (under > 0), top / under)


def decay_linear(x: Column, w: int) -> Column:
    """Weights 1 for the oldest real row up to the newest; missing rows lose value and weight."""
    return _weighted(x, w, F.greatest(F.col("t") - w, F.lit(-1)).cast("double"), max(1, w // 2))


def run_decay(x: Column, w: int) -> Column:
    """Weights w for the newest row, w - 1 before it and so on, also at the start; one finite row is enough."""
    return x if w == 1 else _weighted(x, w, (F.col("t") - w).cast("double"), None)


def ts_linear_reg_slope(x: Column, w: int) -> Column:
    return _gated(x, w, lambda y, o: F.regr_slope(y, F.col("t").cast("double")).over(o), max(2, w // 2))


def ts_cum_sum(x: Column) -> Column:
    return no_nan(F.when(x.isNotNull(), F.sum(x).over(_so_far())))


def ts_accumulate_positive_return(x: Column) -> Column:
    """A state that starts at 1 and is multiplied by x - 1 where x > 1; missing for good from the first missing row."""
    o = _so_far()
    return F.when(F.count(x).over(o) == F.count(F.lit(1)).over(o), F.product(F.when(x > 1, x - 1).otherwise(F.lit(1.0))).over(o))


#: Rows that one step of a scan folds; a scan has three levels, so histories of SCAN ** 3 rows fold SCAN values a level.
SCAN = 16


def affine_scan(frame: DataFrame, a: Column, b: Column, name: str, by: tuple[str, ...] = ("code",), at: str = "t") -> DataFrame:
    """frame with name added: y = a * y_before + b along each key's rows, where a row's `at` counts from 0 without gaps.

    Steps of the form y -> a y + b can be put together before y is known, in any grouping. Each row has the steps of its
    block of SCAN rows up to itself put together, then the whole blocks before it, then the blocks of blocks: a
    fold of SCAN values at most on each of the lower levels, no array that grows with a key's rows but on the last, where it has one
    value for SCAN ** 2 rows. All levels are windows of one partitioning. The first row's y_before counts as 0.
    """
    kept = frame.columns
    frame = frame.withColumn("_m", F.struct(a.cast("double").alias("a"), b.cast("double").alias("b")))
    none = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    then = lambda m, n: F.struct((n["a"] * m["a"]).alias("a"), (n["a"] * m["b"] + n["b"]).alias("b"))
    over = lambda blocks: W.partitionBy(*by, *blocks).orderBy(at)
    frame = frame.withColumns({"_b0": F.floor(F.col(at) / SCAN), "_b1": F.floor(F.col(at) / SCAN**2)})
    own = F.aggregate(F.collect_list("_m").over(over(["_b0"]).rowsBetween(W.unboundedPreceding, 0)), none, then)
    frame = frame.withColumn("_p", own).withColumns({"_e0": F.coalesce(F.lead("_b0").over(over([])) != F.col("_b0"), F.lit(True)), "_e1": F.coalesce(F.lead("_b1").over(over([])) != F.col("_b1"), F.lit(True))})
    for ends, blocks in (("_e0", ["_b1"]), ("_e1", [])):
        whole = F.collect_list(F.when(F.col(ends), F.col("_p"))).over(over(blocks).rowsBetween(W.unboundedPreceding, -1))
        frame = frame.withColumn("_w", F.aggregate(whole, none, then)).withColumn("_p", then(F.col("_w"), F.col("_p")))
    return frame.select(*kept, F.col("_p.b").alias(name))


def ewm(frame: DataFrame, x: Column, n: float, m: float, name: str) -> DataFrame:
    """frame with name added: a mean that moves by m / n toward each finite x; weights fade across gaps.

    At a finite row, g rows after the last one, the old mean weighs (1 - m / n) ^ g and the new value m / n: a step of
    affine_scan. Other rows keep the mean.
    """
    alpha = m / n
    kept = frame.columns
    order = W.partitionBy("code").orderBy("t")
    frame = frame.withColumn("_y", finite(x)).withColumn("_t0", F.last(F.when(F.col("_y").isNotNull(), F.col("t")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)))
    old = F.pow(F.lit(1 - alpha), F.col("t") - F.col("_t0"))
    first, there = F.col("_t0").isNull(), F.col("_y").isNotNull()
    a = F.when(~there, 1.0).when(first, 0.0).otherwise(old / (old + alpha))
    b = F.when(~there, 0.0).when(first, F.col("_y")).otherwise(alpha * F.col("_y") / (old + alpha))
    frame = affine_scan(frame, a, b, "_ewm")
    return frame.select(*kept, F.when(there | ~first, F.col("_ewm")).alias(name))


#: Functions whose window is kept in order by `slide`, for windows of more than SLIDE_FROM rows.
SLIDING, SLIDE_FROM = ("ts_median", "ts_rank"), 40


def _slid(values: np.ndarray, w: int, kind: str) -> list[float | None]:
    """ts_median or ts_rank of one code's rows in order: the window's finite values stay sorted, so that a row costs two
    searches of log w steps."""
    kept: list[float] = []
    out: list[float | None] = []
    ok = np.isfinite(values).tolist()
    values = values.tolist()
    least = max(1, w // 2)
    for i, x in enumerate(values):
        if i >= w and ok[i - w]:
            del kept[bisect_left(kept, values[i - w])]
        if ok[i]:
            insort(kept, x)
        n = len(kept)
        if n < least or kind == "ts_rank" and not ok[i]:
            out.append(None)
        elif kind == "ts_median":
            out.append(kept[n // 2] if n % 2 else (kept[n // 2 - 1] + kept[n // 2]) / 2)
        else:
            low, high = bisect_left(kept, x), bisect_right(kept, x)
            out.append((low + (high - low + 1) / 2) / n)
    return out


def slide(frame: DataFrame, name: str, kind: str, x: Column, w: int) -> DataFrame:
    """frame with name added: ts_median or ts_rank of x over w rows. A task holds one code's rows, as many as there are days."""
    schema = frame.select("*", x.cast("double").alias("_v"))
    wanted = StructType([*frame.schema.fields, StructField(name, DoubleType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        values = table.column("_v").to_numpy().astype(float)
        return table.drop_columns(["_v"]).append_column(name, pa.array(_slid(values, w, kind), pa.float64()))

    return schema.groupBy("code").applyInArrow(run, wanted)


def _day(*more: Column):
    return W.partitionBy("t", *more)


def average_rank(x: Column, *by: str | Column) -> Column:
    """Ranks from 1 within by; equal values share the mean of their ranks. One sort serves both ends of a tie."""
    order = W.partitionBy(*by).orderBy(x)
    return (F.rank().over(order) + F.count(F.lit(1)).over(order.rangeBetween(W.unboundedPreceding, W.currentRow))) / 2


def rank_cs(x: Column) -> Column:
    """Average-tie rank of a day's values over their number; infinite values rank too."""
    missing = x.isNull()
    return F.when(~missing, average_rank(x, "t", missing) / F.count(x).over(_day(missing)))


def winsorize_cs(x: Column, lo: float, hi: float) -> Column:
    q = F.percentile(x, F.array(F.lit(lo), F.lit(hi))).over(_day())
    return F.when(x.isNotNull(), F.least(F.greatest(x, q[0]), q[1]))


def zscore_cs(x: Column) -> Column:
    spread = F.stddev_pop(x).over(_day())
    return no_nan(F.when(spread > 0, (x - F.avg(x).over(_day())) / spread))


def scale_cs(x: Column, a: float) -> Column:
    total = F.sum(F.abs(x)).over(_day())
    return no_nan(F.when(total != 0, x * a / total))


def mad_winsorize_cs(x: Column, middle: Column, width: float, spread: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, middle - width * spread), middle + width * spread))
