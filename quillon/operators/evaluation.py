"""Evaluation methods on (t, day, code, factor, fwd) and on the small daily tables that come of them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.rolling import affine_scan, average_rank, rank_cs
from quillon.functions.rules import finite, is_finite
from quillon.operators.labels import blocks
from quillon.sources import scratch

YEAR = 252
BUY_COST, SELL_COST = 0.00125, 0.00175


def pairs(rows: DataFrame) -> DataFrame:
    """Rows whose factor and label are both there."""
    return rows.where(F.col("factor").isNotNull() & F.col("fwd").isNotNull())


def rank_sums(rows: DataFrame, by: tuple[str, ...] = ("t", "day"), factor: str = "factor", label: str = "fwd") -> DataFrame:
    """(by, n, va, vb, cov): sums over the ranks of the days' pairs, times n and centred; days of fewer than 3 pairs go."""
    ranked = rows.where(is_finite(F.col(factor)) & is_finite(F.col(label)))
    ranked = ranked.withColumn("_a", average_rank(F.col(factor), *by)).withColumn("_b", average_rank(F.col(label), *by))
    a, b = F.col("_a"), F.col("_b")
    sums = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(a).alias("sa"), F.sum(b).alias("sb"), F.sum(a * a).alias("saa"), F.sum(b * b).alias("sbb"), F.sum(a * b).alias("sab"))
    return sums.where("n >= 3").select(*by, "n", F.expr("n * saa - sa * sa").alias("va"), F.expr("n * sbb - sb * sb").alias("vb"), F.expr("n * sab - sa * sb").alias("cov"))


def rank_ic(rows: DataFrame, by: tuple[str, ...] = ("t", "day")) -> DataFrame:
    """(t, day, ic, n): each day's rank correlation of factor and label; days of fewer than 3 pairs or constant ranks go."""
    return rank_sums(rows, by).where("va > 0 and vb > 0").select(*by, (F.col("cov") / F.sqrt(F.col("va") * F.col("vb"))).alias("ic"), "n")


def _ranks(x: np.ndarray) -> np.ndarray:
    """Average-tie ranks less their mean."""
    _, at, counts = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - (counts - 1) / 2)[at] - (len(x) + 1) / 2


def rank_ics(rows: DataFrame, names: list[str]) -> DataFrame:
    """(name, t, day, ic, n) of several factors that stand side by side in rows, as rank_ic gives for each of them.

    Days are shuffled once for all factors, and not sorted by any: a task ranks one day's numbers in memory.
    """
    texts = pa.array(names, pa.string())

    def run(key: tuple, table: pa.Table) -> pa.Table:
        numbers = lambda c: table.column(c).to_numpy().astype(float)
        label, ics, many = numbers("_label"), np.full(len(names), np.nan), np.zeros(len(names), np.int64)
        for i in range(len(names)):
            x = numbers(f"_x{i}")
            ok = np.isfinite(x) & np.isfinite(label)
            many[i] = ok.sum()
            if many[i] >= 3:
                a, b = _ranks(x[ok]), _ranks(label[ok])
                va, vb = a @ a, b @ b
                if va > 0 and vb > 0:
                    ics[i] = a @ b / np.sqrt(va * vb)
        out = pa.table({"name": texts, "t": pa.array([key[0].as_py()] * len(names), pa.int32()), "day": pa.array([key[1].as_py()] * len(names), pa.date32()), "ic": ics, "n": many})
        return out.filter(pa.array(np.isfinite(ics)))

    cells = rows.select(F.col("t").cast("int").alias("t"), F.col("day").cast("date").alias("day"), finite(F.col("fwd")).cast("double").alias("_label"), *[finite(F.col(c)).cast("double").alias(f"_x{i}") for i, c in enumerate(names)])
    return cells.where("_label is not null").groupBy("t", "day").applyInArrow(run, "name string, t int, day date, ic double, n long")


def ic_summary(rows: DataFrame) -> DataFrame:
    """One row: days with an IC, pairs of all days with 3 or more, and the first and last day with an IC."""
    ok = F.expr("va > 0 and vb > 0")
    return rank_sums(rows).agg(F.sum(ok.cast("long")).alias("ic_count"), F.sum("n").alias("pair_count"), F.min(F.when(ok, F.col("day"))).alias("start_day"), F.max(F.when(ok, F.col("day"))).alias("end_day"))


def calc_ic(frame: DataFrame, factor_name: str = "score", label_name: str = "f1") -> DataFrame:
    """(day, ic) of a long table, every day of it; ic is missing where it is not defined."""
    missing = {"day", factor_name, label_name} - set(frame.columns)
    if missing:
        raise KeyError(f"no columns {sorted(missing)}")
    got = rank_sums(frame, ("day",), factor_name, label_name)
    got = got.select("day", F.when((F.col("va") > 0) & (F.col("vb") > 0), F.col("cov") / F.sqrt(F.col("va") * F.col("vb"))).alias("ic"))
    return frame.select("day").distinct().join(got, "day", "left")


def get_ic_info(frame: DataFrame, factor_name: str, label_name: str) -> DataFrame:
    """One row: mean and standard deviation of calc_ic, and the absolute value of their ratio."""
    return icir(calc_ic(frame, factor_name, label_name)).select("ic_mean", "ic_std", F.abs("icir").alias("abs_ir"))


def assign_quantile(frame: DataFrame, factor_name: str = "score", n_quantiles: int = 10, tie: str = "code") -> DataFrame:
    """frame with group (1 for the smallest) in each day of all rows with a factor; ties in order of the column tie."""
    if isinstance(n_quantiles, bool) or n_quantiles < 1 or int(n_quantiles) != n_quantiles:
        raise ValueError("the number of groups must be a whole number of 1 or more")
    x = finite(F.col(factor_name))
    place = F.row_number().over(W.partitionBy("day", x.isNull()).orderBy(x, tie))
    count = F.count(x).over(W.partitionBy("day", x.isNull()))
    return frame.withColumn("group", F.when(x.isNotNull(), F.floor((place - 1) * int(n_quantiles) / count) + 1).cast("int"))


def calc_group_returns(frame: DataFrame, group_col: str = "group", ret_col: str = "f1", n_quantiles: int | None = None) -> DataFrame:
    """(day, G1, ..., GN): equal-weighted returns, a column for each group. A group that never occurs is an error if n_quantiles is given."""
    rows = frame.where(F.col(group_col).isNotNull() & F.col(ret_col).isNotNull())
    # One small row a day and group, stored: which groups there are is asked of it, and frame is computed once.
    means = scratch.stored(rows.groupBy("day", group_col).agg(F.avg(ret_col).alias("_mean")), "group_returns")
    there = sorted(int(r[0]) for r in means.select(group_col).distinct().collect())
    missing = sorted(set(range(1, (n_quantiles or 0) + 1)) - set(there))
    if missing:
        scratch.forget(means)
        raise ValueError(f"no rows in groups {missing}")
    out = means.groupBy("day").pivot(group_col, there).agg(F.first("_mean"))
    return out.select("day", *[F.col(f"`{g}`").alias(f"G{g}") for g in there])


def evaluate_wide(factor_wide: DataFrame, open_wide: DataFrame, horizon: int = 1, n_quantiles: int = 10, decay: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """IC, group returns and the summary of both from two wide tables (see panel.wide_to_long); opens give days and codes."""
    from quillon.functions.rolling import run_decay
    from quillon.operators.labels import forward_open_return
    from quillon.sources.panel import numbered_days, wide_to_long

    if isinstance(n_quantiles, bool) or not isinstance(n_quantiles, int) or n_quantiles < 1:
        raise ValueError("the number of groups must be a whole number of 1 or more")
    if isinstance(decay, bool) or not isinstance(decay, int) or decay < 1:
        raise ValueError("decay must be a whole number of 1 or more")
    opens = wide_to_long(open_wide, "o").join(F.broadcast(numbered_days(open_wide)), "day")
    rows = opens.join(wide_to_long(factor_wide, "factor"), ["day", "code"], "left")
    rows = forward_open_return(rows.withColumn("factor", run_decay(finite(F.col("factor")), decay)), horizon)
    return rank_ic(rows), quantile_returns(rows, n_quantiles), ic_summary(rows)


def icir(daily: DataFrame) -> DataFrame:
    """One row: count, mean, standard deviation, their ratio and the share of positive days."""
    out = daily.agg(F.count("ic").alias("ic_count"), F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), F.avg((F.col("ic") > 0).cast("double")).alias("positive_ratio"))
    return out.withColumn("icir", F.when(F.col("ic_std") > 0, F.col("ic_mean") / F.col("ic_std")))


def quantile_members(rows: DataFrame, n_groups: int) -> DataFrame:
    """Adds grp (1 for the smallest factors) on days of n_groups pairs or more; ties in order of code."""
    day = W.partitionBy("t")
    rows = pairs(rows).withColumn("_n", F.count(F.lit(1)).over(day)).where(F.col("_n") >= n_groups)
    rows = rows.withColumn("_r", F.row_number().over(day.orderBy("factor", "code")))
    return rows.withColumn("grp", (F.floor((F.col("_r") - 1) * n_groups / F.col("_n")) + 1).cast("int")).drop("_r", "_n")


def quantile_returns(rows: DataFrame, n_groups: int) -> DataFrame:
    """(t, day, grp, ret): equal-weighted label of each group."""
    return quantile_members(rows, n_groups).groupBy("t", "day", "grp").agg(F.avg("fwd").alias("ret"))


def cumulative(returns: DataFrame) -> DataFrame:
    """(t, day, grp, cum): compounded returns, a missing one counting as none."""
    so_far = W.partitionBy("grp").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    return returns.select("t", "day", "grp", (F.product(1 + F.coalesce("ret", F.lit(0.0))).over(so_far) - 1).alias("cum"))


def net_returns(rows: DataFrame, n_groups: int, buy: float = BUY_COST, sell: float = SELL_COST) -> DataFrame:
    """(t, day, grp, gross, turnover, cost, ret) after trading from the weights of the last day that had any.

    A code is in one group a day, so its trades follow from its own neighbouring rows: what it buys from the row before,
    what it sells from the row after. Nothing is joined but the small calendar.
    """
    members = quantile_members(rows, n_groups)
    weights = members.withColumn("w", 1 / F.count(F.lit(1)).over(W.partitionBy("t", "grp"))).select("t", "day", "grp", "code", "w", "fwd")
    days = members.select("t", "day").distinct().withColumn("d", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("t")))
    days = days.withColumn("last", F.max("d").over(W.partitionBy(F.lit(1))))
    now = weights.join(F.broadcast(days.drop("day")), "t")
    order = W.partitionBy("code").orderBy("d")
    near = lambda f, step: F.when((f("d").over(order) == F.col("d") + step) & (f("grp").over(order) == F.col("grp")), f("w").over(order))
    now = now.withColumn("w0", F.coalesce(near(F.lag, -1), F.lit(0.0))).withColumn("stays", near(F.lead, 1).isNotNull())
    bought = F.struct(F.col("d"), F.greatest(F.col("w") - F.col("w0"), F.lit(0.0)).alias("b"), F.greatest(F.col("w0") - F.col("w"), F.lit(0.0)).alias("s"), F.col("fwd"))
    left = F.when(~F.col("stays") & (F.col("d") < F.col("last")), F.struct((F.col("d") + 1).alias("d"), F.lit(0.0).alias("b"), F.col("w").alias("s"), F.lit(None).cast("double").alias("fwd")))
    moves = now.select("grp", F.explode(F.array_compact(F.array(bought, left))).alias("m")).groupBy("m.d", "grp")
    traded = moves.agg(F.sum("m.b").alias("bought"), F.sum("m.s").alias("sold"), F.avg("m.fwd").alias("gross")).where("gross is not null")
    cost = F.col("bought") * buy + F.col("sold") * sell
    out = traded.join(F.broadcast(days), "d")
    return out.select("t", "day", "grp", "gross", ((F.col("bought") + F.col("sold")) / 2).alias("turnover"), cost.alias("cost"), (F.col("gross") - cost).alias("ret"))


def _annual(wealth: Column, n: Column) -> Column:
    return F.when((wealth >= 0) & (n > 0), F.pow(wealth, YEAR / n) - 1)


def top_daily(returns: DataFrame, n_groups: int) -> DataFrame:
    """(t, day, top, lower_mean, lower_max, beats_mean, beats_all): the top group against those below it."""
    top, low = F.col("grp") == n_groups, F.col("grp") < n_groups
    out = returns.groupBy("t", "day").agg(F.max(F.when(top, F.col("ret"))).alias("top"), F.avg(F.when(low, F.col("ret"))).alias("lower_mean"), F.max(F.when(low, F.col("ret"))).alias("lower_max"))
    return out.withColumn("beats_mean", F.col("top") > F.col("lower_mean")).withColumn("beats_all", F.col("top") > F.col("lower_max"))


def top_summary(returns: DataFrame, n_groups: int) -> DataFrame:
    """One row about the top group over the whole sample."""
    daily = top_daily(returns, n_groups)
    means = returns.groupBy("grp").agg(F.avg("ret").alias("m")).agg(F.max(F.when(F.col("grp") == n_groups, F.col("m"))).alias("top_mean"), F.max(F.when(F.col("grp") < n_groups, F.col("m"))).alias("best_lower_mean"))
    out = daily.agg(F.count(F.lit(1)).alias("days"), F.avg(F.col("beats_mean").cast("double")).alias("win_rate_mean"), F.avg(F.col("beats_all").cast("double")).alias("win_rate_all"), F.product(1 + F.coalesce("top", F.lit(0.0))).alias("wealth"))
    out = out.join(F.broadcast(means), F.lit(True), "cross")
    return out.select("days", "win_rate_mean", "win_rate_all", (F.col("wealth") - 1).alias("top_cumulative"), _annual(F.col("wealth"), F.col("days")).alias("annualized"), (F.col("top_mean") > F.col("best_lower_mean")).alias("above_every_lower"))


def top_leadership(returns: DataFrame, n_groups: int, size: int = 60) -> DataFrame:
    """(block, first_day, block_end, top_ret, best_lower, best_lower_grp, leads) for each full block of size days."""
    cut = blocks(returns, size, ["grp"])
    got = cut.groupBy("block", "grp").agg(F.min("day").alias("first_day"), F.max("day").alias("block_end"), (F.product(1 + F.coalesce("ret", F.lit(0.0))) - 1).alias("ret"))
    best = F.max(F.when(F.col("grp") < n_groups, F.struct("ret", -F.col("grp"))))
    got = got.groupBy("block").agg(F.min("first_day").alias("first_day"), F.max("block_end").alias("block_end"), F.max(F.when(F.col("grp") == n_groups, F.col("ret"))).alias("top_ret"), best.alias("b"))
    return got.select("block", "first_day", "block_end", "top_ret", F.col("b.ret").alias("best_lower"), (-F.col("b.col2")).alias("best_lower_grp"), (F.col("top_ret") >= F.col("b.ret")).alias("leads"))


def rolling_sharpe(returns: DataFrame, size: int) -> DataFrame:
    """(grp, block, block_end, sharpe) over blocks of size days; a block without spread, or with a gap, is missing."""
    cut = blocks(returns, size, ["grp"]).groupBy("grp", "block", "block_end").agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"), F.count("ret").alias("n"))
    return cut.select("grp", "block", "block_end", F.when((F.col("n") == size) & (F.col("s") > 0), F.col("m") / F.col("s") * math.sqrt(YEAR)).alias("sharpe"))


def sharpe_summary(sharpe: DataFrame) -> DataFrame:
    return sharpe.groupBy("grp").agg(F.avg((F.col("sharpe") > 0).cast("double")).alias("positive_share"), F.min("sharpe").alias("worst"), F.percentile("sharpe", F.lit(0.5)).alias("middle"))


def _drawdown(returns: DataFrame, keys: list[str]) -> DataFrame:
    """Adds dd: wealth over its peak so far, 1 at the start, less 1."""
    so_far = W.partitionBy(*keys).orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    out = returns.withColumn("wealth", F.product(1 + F.col("ret")).over(so_far))
    return out.withColumn("dd", F.col("wealth") / F.greatest(F.max("wealth").over(so_far), F.lit(1.0)) - 1)


def rolling_drawdown(returns: DataFrame, size: int) -> DataFrame:
    """(grp, block, block_end, drawdown): the worst of each block; a gap makes it missing."""
    cut = _drawdown(blocks(returns, size, ["grp"]), ["grp", "block"])
    return cut.groupBy("grp", "block", "block_end").agg(F.when(F.count("ret") == size, F.min("dd")).alias("drawdown"))


def drawdown_summary(drawdown: DataFrame) -> DataFrame:
    """(grp, worst, middle) of the blocks' drawdowns."""
    return drawdown.groupBy("grp").agg(F.min("drawdown").alias("worst"), F.percentile("drawdown", F.lit(0.5)).alias("middle"))


def fitness(net: DataFrame, n_groups: int) -> DataFrame:
    """(year, annualized, sharpe, max_drawdown, turnover, fitness) of the top group in each calendar year."""
    top = net.where(F.col("grp") == n_groups).withColumn("year", F.year("day"))
    rows = _drawdown(top, ["year"])
    out = rows.groupBy("year").agg(F.count("ret").alias("n"), F.product(1 + F.col("ret")).alias("wealth"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"), F.min("dd").alias("worst"), F.avg("turnover").alias("turnover"))
    out = out.select("year", _annual(F.col("wealth"), F.col("n")).alias("annualized"), F.when(F.col("s") > 0, F.col("m") / F.col("s") * math.sqrt(YEAR)).alias("sharpe"), F.least(-F.col("worst"), F.lit(1.0)).alias("max_drawdown"), "turnover")
    lost = F.when(F.col("max_drawdown") < 1, F.col("max_drawdown") / F.pow(1 - F.col("max_drawdown"), 2))
    return out.withColumn("fitness", F.col("sharpe") * F.sqrt(F.abs("annualized") / F.greatest("turnover", F.lit(0.125))) - lost)


def peak_decay(daily: DataFrame, size: int = 60, step: int = 10) -> DataFrame:
    """(t, day, mean_ic) of windows of size days of the daily table, step apart."""
    order = W.partitionBy(F.lit(1)).orderBy("t")
    out = daily.withColumn("_k", F.row_number().over(order)).withColumn("mean_ic", F.avg("ic").over(order.rowsBetween(-(size - 1), 0)))
    return out.where((F.col("_k") >= size) & ((F.col("_k") - size) % step == 0)).select("t", "day", "mean_ic")


def fitness_summary(yearly: DataFrame) -> DataFrame:
    """One row: the mean of the years that have a fitness, and how many they are."""
    return yearly.agg(F.avg("fitness").alias("fitness"), F.count("fitness").alias("years"))


def opens_for(rows: DataFrame, sample: DataFrame, horizon: int = 1) -> DataFrame:
    """Of rows of the whole calendar, those whose opens a sample may trade at: up to the end of the window it was cut from."""
    last = sample.agg(F.max("t")).first()[0]
    return rows.where(F.col("t") <= F.lit(-1 if last is None else last + horizon + 1))


#: Signal days and horizons of a piece, which one task holds for all codes; cells of a table of days by codes made at once.
SIGNALS_AT_ONCE, HORIZONS_AT_ONCE, CELLS_AT_ONCE = 16, 32, 2**21


def _rank_correlations(values: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The rank correlation of values with each row of labels over the cells finite in both; nan where it is not defined.

    Values are sorted once: the rank of one among some of the cells follows from how many of those stand before its ties
    and up to their end.
    """
    order = np.argsort(values)
    order = order[np.isfinite(values[order])]
    v, out = values[order], np.full(len(labels), np.nan)
    if len(v) < 3:
        return out
    starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    sizes = np.diff(np.append(starts, len(v)))
    for k, row in enumerate(labels):
        y = row[order]
        there = np.isfinite(y)
        upto = np.concatenate([[0], np.cumsum(there)])
        n = int(upto[-1])
        if n < 3:
            continue
        a = np.repeat((upto[starts] + upto[starts + sizes] + 1) / 2, sizes)[there] - (n + 1) / 2
        y = y[there]
        at = np.argsort(y)
        y = y[at]
        ties = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1]]))
        many = np.diff(np.append(ties, n))
        b = np.repeat(ties + (many + 1) / 2, many) - (n + 1) / 2
        va, vb = a @ a, b @ b
        if va > 0 and vb > 0:
            out[k] = (a[at] @ b) / np.sqrt(va * vb)
    return out


def horizon_decay(rows: DataFrame, first: int = 20, last: int = 252, opens: DataFrame | None = None) -> DataFrame:
    """(horizon, mean_ic, n_days) for labels of each horizon, on the days that have an IC at every horizon.

    opens: (t, code, o) of the days that may be traded on, those of rows by default; a sample gives those up to its end.
    Only days early enough for the longest horizon can count; that there is none is an error.

    A code's values are one row, cut into pieces of SIGNALS_AT_ONCE signal days and HORIZONS_AT_ONCE horizons. A piece
    holds the factor and the entry of its days and the opens that its labels reach, of all codes: as many numbers a code
    whatever the calendar, so tasks are as many as pieces and none holds a code's whole series beside all others.
    """
    if not 1 <= first <= last:
        raise ValueError("the horizons must be whole numbers of 1 or more, the first no larger than the last")
    begin, end = F.min(F.when(F.col("factor").isNotNull(), F.col("t"))).alias("begin"), F.max("t").alias("end")
    ends = (rows.agg(begin, end) if opens is None else rows.agg(begin).crossJoin(opens.agg(end))).first()
    if ends.begin is None or ends.end is None or ends.begin + 1 + last > ends.end:
        raise ValueError(f"no signal day supports the horizon of {last} days")
    begin, end, days, many = ends.begin, ends.end, SIGNALS_AT_ONCE, HORIZONS_AT_ONCE
    final = end - last - 1
    value, price = F.when(F.col("t") <= final, finite(F.col("factor").cast("double"))), finite(F.col("o").cast("double"))
    none = F.lit(None).cast("double")
    if opens is None:
        cells = rows.select("code", "t", value.alias("factor"), price.alias("o"))
    else:
        cells = rows.select("code", "t", value.alias("factor"), none.alias("o")).unionByName(opens.select("code", "t", none.alias("factor"), price.alias("o")))
    cells = cells.where((F.col("t") >= begin) & (F.col("factor").isNotNull() | F.col("o").isNotNull()))
    series = cells.groupBy("code").agg(*[F.collect_list(F.when(F.col(c).isNotNull(), F.struct("t", F.col(c).alias("x")))).alias(c) for c in ("factor", "o")]).where(F.size("factor") > 0).select("factor", "o")
    spans = [(s, h) for s in range(begin, final + 1, days) for h in range(first, last + 1, many)]

    def dense(lists: pa.ListArray, width: int) -> np.ndarray:
        """A row of width days from begin for each list of (t, x)."""
        out, flat = np.full((len(lists), width), np.nan), lists.flatten()
        at = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        out[at, flat.field("t").to_numpy() - begin] = flat.field("x").to_numpy(zero_copy_only=False)
        return out

    def as_list(x: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).reshape(-1)))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = end - begin + 1
        # Room behind the end, where the last pieces look at days that no label of theirs reaches.
        room = days + many
        step = max(1, CELLS_AT_ONCE // (width + room))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                f, o = (dense(part.column(c), width + room) for c in range(2))
                for k, (s, h) in enumerate(spans):
                    i = s - begin
                    keep = np.isfinite(f[:, i : i + days]).any(axis=1)
                    if keep.any():
                        arrays = [as_list(x) for x in (f[keep, i : i + days], o[keep, i + 1 : i + 1 + days], o[keep, i + 1 + h : i + h + days + many])]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(int(keep.sum()), k, np.int32)), *arrays], ["piece", "factor", "entry", "leave"])

    def curves(table: pa.Table) -> pa.Table:
        s0, h0 = spans[table.column("piece")[0].as_py()]
        n = table.num_rows
        # Days by codes; a column at a time, so that its lists can go.
        factor, entry, leave = (np.concatenate([np.ascontiguousarray(c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1).T) for c in table.column(name).chunks], axis=1) for name in ("factor", "entry", "leave"))
        out_t, out_h, out_ic = [], [], []
        step = max(1, CELLS_AT_ONCE // n)
        for k in range(min(days, final + 1 - s0)):
            there = np.isfinite(factor[k]) & np.isfinite(entry[k]) & (entry[k] != 0)
            x, start = factor[k][there], entry[k][there]
            for j in range(0, min(many, last + 1 - h0), step):
                to = min(j + step, many, last + 1 - h0)
                ic = _rank_correlations(x, np.round(leave[k + j : k + to, there] / start - 1, 9))
                good = np.flatnonzero(np.isfinite(ic))
                out_t += [s0 + k] * len(good)
                out_h += (good + h0 + j).tolist()
                out_ic += ic[good].tolist()
        return pa.table({"t": pa.array(out_t, pa.int32()), "horizon": pa.array(out_h, pa.int32()), "ic": pa.array(out_ic, pa.float64())})

    cut = series.mapInArrow(pieces, "piece int, factor array<double>, entry array<double>, leave array<double>")
    daily = cut.groupBy("piece").applyInArrow(curves, "t int, horizon int, ic double")
    daily = daily.withColumn("_k", F.count(F.lit(1)).over(W.partitionBy("t"))).where(F.col("_k") == last - first + 1)
    return daily.groupBy("horizon").agg(F.avg("ic").alias("mean_ic"), F.count(F.lit(1)).alias("n_days"))


#: Autocovariances that are worked out at first; series that need more get all of theirs.
LAGS_AT_FIRST = 48


def _normal_tails(x: Column) -> Column:
    """The chance of a standard normal beyond x on either side, by Simpson's rule over twelve deviations; 0 beyond 38."""
    n, h = 2000, 12 / 2000
    density = lambda k: F.exp(-F.pow(F.abs(x) + k * h, 2) / 2)
    total = F.aggregate(F.sequence(F.lit(0), F.lit(n)), F.lit(0.0), lambda acc, k: acc + density(k) * F.when((k == 0) | (k == n), 1.0).when(k % 2 == 1, 4.0).otherwise(2.0))
    return F.when(F.abs(x) > 38, 0.0).otherwise(2 * total * h / 3 / math.sqrt(2 * math.pi))


def newey_west(daily: DataFrame, by: tuple[str, ...] = (), horizon: int = 1) -> DataFrame:
    """(by, n, mean, lag, se, t, p) of the daily series (by, t, ic) of many factors at once: significance with autocorrelation.

    A factor's series, a number a day, is one row of an array, and everything else follows inside that row: the
    autocovariances, the lag (the last before three in a row lie within two standard errors of zero, horizon - 1 at
    least), the weighted sum. Series of fewer than three values, or all equal, are left out.
    """
    series = daily.where(finite(F.col("ic")).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("t", "ic"))).alias("s"))
    series = series.select(*by, F.transform("s", lambda r: r["ic"]).alias("x")).withColumn("n", F.size("x"))
    series = series.where((F.col("n") >= 3) & (F.array_max("x") > F.array_min("x")))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v)
    series = series.withColumn("mean", add("x") / F.col("n")).withColumn("d", F.transform("x", lambda v: v - F.col("mean")))

    def covariances(last: Column) -> Column:
        one = lambda k: add(F.zip_with(F.slice("d", 1, F.col("n") - k), F.slice("d", k + 1, F.col("n") - k), lambda a, b: a * b)) / F.col("n")
        return F.transform(F.sequence(F.lit(0), last), one)

    def found(cov: str) -> Column:
        quiet = lambda k: F.abs(F.col(cov)[k] / F.col(cov)[0]) <= 2 / F.sqrt("n")
        most = F.size(cov) - 3
        return F.when(most >= 1, F.get(F.filter(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda k: quiet(k) & quiet(k + 1) & quiet(k + 2)), F.lit(0)) - 1)

    series = series.withColumn("cov", covariances(F.least(F.col("n") - 1, F.lit(LAGS_AT_FIRST)))).withColumn("lag", found("cov"))
    whole = F.col("lag").isNull() & (F.size("cov") < F.col("n")) | (F.lit(horizon) > F.size("cov"))
    series = series.withColumn("cov", F.when(whole, covariances(F.col("n") - 1)).otherwise(F.col("cov"))).withColumn("lag", F.when(F.col("lag").isNull(), found("cov")).otherwise(F.col("lag")))
    lag = F.least(F.greatest(F.coalesce("lag", F.col("n") - 1), F.lit(horizon - 1)), F.col("n") - 1)
    series = series.withColumn("lag", lag.cast("int"))
    weighted = F.aggregate(F.sequence(F.lit(0), F.col("lag")), F.lit(0.0), lambda acc, k: acc + F.when(k == 0, F.col("cov")[0]).otherwise(2 * (1 - k / (F.col("lag") + 1)) * F.col("cov")[k]))
    series = series.withColumn("se", F.sqrt(F.greatest(weighted, F.lit(0.0)) / F.col("n")))
    t = F.when(F.col("se") > 0, F.col("mean") / F.col("se")).otherwise(F.signum("mean") * float("inf"))
    return series.withColumn("t", t).select(*by, "n", "mean", "lag", "se", "t", _normal_tails(F.col("t")).alias("p"))


CURVES = ("kalman", "low_pass", "fourier")


def trend_table(daily: DataFrame, by: tuple[str, ...] = (), period: int = 31, ratio: float = 0.01) -> DataFrame:
    """(by, t, day, ic, kalman, low_pass, fourier) of the days of (by, t, day, ic): three smooth versions of each series.

    kalman: a local level whose variance over the noise's is ratio, at the gain at which it settles. low_pass: a
    second-order recursion on two past states and three past inputs, which begins with the first three inputs; its two
    roots are equal, so it is one first-order recursion after another. fourier: what waves of period days or longer make
    up of the whole series (it looks ahead). Recursions are scans (see affine_scan), and a series, a number a day, is an array where
    the waves are summed. A series of fewer than four days is left out.
    """
    series = daily.where(finite(F.col("ic")).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("t", "day", "ic"))).alias("s"))
    series = series.withColumn("n", F.size("s")).where("n >= 4")
    turn = lambda k, i: 2 * math.pi * k * i / F.col("n")
    wave = lambda k, f: F.aggregate(F.transform("s", lambda r, i: r["ic"] * f(turn(k, i))), F.lit(0.0), lambda acc, v: acc + v)
    waves = F.transform(F.sequence(F.lit(0), F.floor(F.col("n") / period).cast("int")), lambda k: F.struct(wave(k, F.cos).alias("re"), wave(k, F.sin).alias("im")))
    rows = series.withColumn("w", waves).select(*by, "n", "w", F.posexplode("s").alias("i", "r")).select(*by, "n", "w", "i", "r.*")
    part = lambda v, k: F.when(k == 0, v["re"]).otherwise(2 * (v["re"] * F.cos(turn(k, F.col("i"))) + v["im"] * F.sin(turn(k, F.col("i")))))
    rows = rows.withColumn("fourier", F.aggregate(F.transform("w", part), F.lit(0.0), lambda acc, v: acc + v) / F.col("n")).drop("w", "n")
    keys = by or ("_all",)
    rows = rows if by else rows.withColumn("_all", F.lit(0))
    start = F.col("i") == 0
    spread = (ratio + math.sqrt(ratio * ratio + 4 * ratio)) / 2
    gain = spread / (spread + 1)
    rows = affine_scan(rows, F.when(start, 0.0).otherwise(1 - gain), F.when(start, F.col("ic")).otherwise(gain * F.col("ic")), "kalman", keys, "i")
    # y(i) = 2 r y(i-1) - r^2 y(i-2) + u(i) is z(i) = r z(i-1) + u(i) with z(i) = y(i) - r y(i-1).
    a, order = 2 / period, W.partitionBy(*keys).orderBy("i")
    r, back = 1 - a, lambda k: F.lag("ic", k).over(order)
    rows = rows.withColumn("_u", (a - a * a / 4) * back(1) + a * a / 2 * back(2) - (a - 3 * a * a / 4) * back(3)).withColumn("_z0", F.col("ic") - r * back(1))
    rows = affine_scan(rows, F.when(F.col("i") <= 2, 0.0).otherwise(r), F.when(F.col("i") <= 2, F.coalesce("_z0", F.lit(0.0))).otherwise(F.col("_u")), "_z", keys, "i")
    rows = affine_scan(rows, F.when(F.col("i") <= 2, 0.0).otherwise(r), F.when(F.col("i") <= 2, F.col("ic")).otherwise(F.col("_z")), "low_pass", keys, "i")
    return rows.select(*by, "t", "day", "ic", *CURVES)


def trend_means(filtered: DataFrame, size: int = 10, step: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, t, day, kalman, low_pass, fourier): means of whole overlapping runs of size rows, step apart, by their last day."""
    if not 1 <= step <= size:
        raise ValueError("step must lie between 1 and size")
    order = W.partitionBy(*(by or (F.lit(1),))).orderBy("t")
    out = filtered.select(*by, "t", "day", F.row_number().over(order).alias("_k"), *[F.avg(c).over(order.rowsBetween(-(size - 1), 0)).alias(c) for c in CURVES])
    return out.where((F.col("_k") >= size) & ((F.col("_k") - size) % step == 0)).drop("_k")


def trend_summary(filtered: DataFrame) -> DataFrame:
    """One row: the days, and each curve's first and last value and the difference."""
    ends = [e for c in CURVES for e in (F.min_by(c, "t").alias(f"{c}_start"), F.max_by(c, "t").alias(f"{c}_final"), (F.max_by(c, "t") - F.min_by(c, "t")).alias(f"{c}_change"))]
    return filtered.agg(F.count(F.lit(1)).alias("days"), *ends)


def spearman(rows: DataFrame) -> DataFrame:
    """rank_cs of factor and label, for looking at single pairs."""
    return pairs(rows).withColumn("factor_rank", rank_cs(F.col("factor"))).withColumn("fwd_rank", rank_cs(F.col("fwd")))
