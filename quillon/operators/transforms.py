"""Transforms of the factor: neutralization, outliers, and cells that cannot be traded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.rolling import zscore_cs
from quillon.functions.rules import finite

#: Below this share of its raw spread, a regressor counts as not moving.
FLAT = 1e-12
EDGE = 0.002


def industry_neutralize(rows: DataFrame, least: int = 3) -> DataFrame:
    """factor less its mean in the day's industry; industries of fewer than least values, and none, go missing."""
    group = W.partitionBy("t", "industry")
    ok = F.col("industry").isNotNull() & (F.count("factor").over(group) >= least)
    return rows.withColumn("factor", F.when(ok, F.col("factor") - F.avg("factor").over(group)))


def _log_cap(rows: DataFrame) -> DataFrame:
    good = F.col("factor").isNotNull() & (F.col("cap") > 0) & finite(F.col("cap")).isNotNull()
    return rows.withColumn("_x", F.when(good, F.ln(F.when(F.col("cap") > 0, F.col("cap"))))).withColumn("_y", F.when(good, F.col("factor")))


def cap_neutralize(rows: DataFrame, least: int = 3) -> DataFrame:
    """The day's residuals of factor on 1 and log cap; days on which cap hardly differs are only demeaned."""
    day = W.partitionBy("t")
    rows = _log_cap(rows)
    var = F.var_pop("_x").over(day)
    slope = F.when(var > FLAT * (1 + F.pow(F.avg("_x").over(day), 2)), F.covar_pop("_x", "_y").over(day) / var).otherwise(0.0)
    rows = rows.withColumn("_slope", slope).withColumn("_n", F.count("_y").over(day))
    out = F.col("_y") - F.avg("_y").over(day) - F.col("_slope") * (F.col("_x") - F.avg("_x").over(day))
    return rows.withColumn("factor", F.when(F.col("_n") >= least, out)).drop("_x", "_y", "_slope", "_n")


def industry_cap_neutralize(rows: DataFrame, with_beta: bool = False) -> DataFrame:
    """The day's residuals of factor on log cap and a dummy for each industry.

    Both sides are demeaned within industry first, so one slope a day is left to find. Days with no more values than
    parameters go missing.
    """
    rows = _log_cap(rows)
    rows = rows.withColumns({c: F.when(F.col("industry").isNotNull(), F.col(c)) for c in ("_x", "_y")})
    group, day = W.partitionBy("t", "industry"), W.partitionBy("t")
    rows = rows.withColumn("_dx", F.col("_x") - F.avg("_x").over(group)).withColumn("_dy", F.col("_y") - F.avg("_y").over(group))
    rows = rows.withColumn("_first", (F.row_number().over(group.orderBy(F.col("_y").isNull(), "code")) == 1) & F.col("_y").isNotNull())
    sxx, sxy = F.sum(F.col("_dx") * F.col("_dx")).over(day), F.sum(F.col("_dx") * F.col("_dy")).over(day)
    moves = sxx > FLAT * F.sum(F.col("_x") * F.col("_x")).over(day)
    rank = F.sum(F.col("_first").cast("int")).over(day) + moves.cast("int")
    rows = rows.withColumn("_slope", F.when(moves, sxy / sxx).otherwise(0.0)).withColumn("_ok", F.count("_y").over(day) > rank)
    rows = rows.withColumn("factor", F.when(F.col("_ok"), F.col("_dy") - F.col("_slope") * F.col("_dx")))
    if with_beta:
        rows = rows.withColumn("beta", F.when(F.col("_ok") & moves, F.col("_slope")))
    return rows.drop("_x", "_y", "_dx", "_dy", "_first", "_slope", "_ok")


def cap_betas(rows: DataFrame) -> DataFrame:
    """(t, n, beta): each day's residuals and the slope on log cap beside industries; missing where it is not determined."""
    return industry_cap_neutralize(rows, with_beta=True).groupBy("t").agg(F.count("factor").alias("n"), F.max("beta").alias("beta"))


def mad_winsorize(rows: DataFrame, width: float = 5.0) -> DataFrame:
    """factor clipped to the day's median plus or minus width times the median distance from it."""
    day = W.partitionBy("t")
    half = F.lit(0.5)
    rows = rows.withColumn("_m", F.percentile("factor", half).over(day)).withColumn("_d", F.abs(F.col("factor") - F.col("_m")))
    rows = rows.withColumn("_s", F.percentile("_d", half).over(day))
    clipped = F.least(F.greatest("factor", F.col("_m") - width * F.col("_s")), F.col("_m") + width * F.col("_s"))
    return rows.withColumn("factor", F.when(F.col("factor").isNotNull(), clipped)).drop("_m", "_d", "_s")


def style_neutralize(rows: DataFrame, styles: list[str]) -> DataFrame:
    """The day's residuals of factor on an intercept and the styles; needs len(styles) + 3 complete rows.

    Styles are made orthogonal one after the other and taken out of the factor, all by sums over the day. One that does
    not move, or not beyond those before it, changes nothing, as in least squares.
    """
    day, names = W.partitionBy("t"), [f"_z{i}" for i in range(len(styles))]
    whole = finite(F.col("factor")).isNotNull()
    for c in styles:
        whole = whole & finite(F.col(c)).isNotNull()
    kept = rows.columns
    rows = rows.withColumns({z: F.when(whole, F.col(c)) for z, c in zip(names, styles)} | {"_y": F.when(whole, F.col("factor"))})
    rows = rows.withColumn("_n", F.count("_y").over(day))
    rows = rows.withColumns({c: F.col(c) - F.avg(c).over(day) for c in [*names, "_y"]})
    rows = rows.withColumns({f"{z}v": F.sum(F.col(z) * F.col(z)).over(day) for z in names})
    for i, z in enumerate(names):
        later = [*names[i + 1 :], "_y"]
        square = F.sum(F.col(z) * F.col(z)).over(day)
        share = lambda c: F.when(square > FLAT * F.col(f"{z}v"), F.sum(F.col(z) * F.col(c)).over(day) / square).otherwise(0.0)  # noqa: B023, E731
        rows = rows.withColumns({f"{c}b": share(c) for c in later})
        rows = rows.withColumns({c: F.col(c) - F.col(f"{c}b") * F.col(z) for c in later}).drop(*[f"{c}b" for c in later])
    rows = rows.withColumn("factor", F.when(F.col("_n") >= len(styles) + 3, F.col("_y")))
    return rows.select(*kept)


#: The styles by name, as expressions; logarithms of what is not positive are missing.
STYLES = {
    "log_cap": "log(where(cap > 0, cap, np.nan))",
    "return_20": "pct(c, 20)",
    "log_amount_20": "log(where(ts_mean(amt, 20) > 0, ts_mean(amt, 20), np.nan))",
    "volatility_20": "ts_std(pct(c, 1), 20)",
}
MODES = ("paper_local", "market_cap", "market_cap_industry", "none")


def with_styles(panel: DataFrame, styles: tuple[str, ...] = tuple(STYLES)) -> DataFrame:
    """panel with a column for each style."""
    from quillon.plans.expression import factor

    for name in styles:
        panel = factor(panel, STYLES[name], name)
    return panel


def preprocess(rows: DataFrame, mode: str) -> DataFrame:
    """factor as a search prepares it: masked (paper_local only), winsorized, residualized and z-scored; "none" leaves it.

    rows hold the panel's columns; the styles a mode needs are added by with_styles, on full history.
    """
    if mode not in MODES:
        raise ValueError(f"the mode must be one of {MODES}")
    if mode == "none":
        return rows
    kept = rows.columns
    if mode == "paper_local":
        rows = mask_untradable(rows).select(*kept)
    rows = mad_winsorize(rows)
    if mode == "market_cap_industry":
        small = F.count("factor").over(W.partitionBy("t", "industry")) < 3
        rows = industry_cap_neutralize(rows.withColumn("industry", F.when(~small, F.col("industry"))))
    else:
        rows = style_neutralize(rows, list(STYLES) if mode == "paper_local" else ["log_cap"])
    return rows.withColumn("factor", zscore_cs(F.col("factor"))).select(*kept)


def styles_of(mode: str) -> tuple[str, ...]:
    return tuple(STYLES) if mode == "paper_local" else ("log_cap",) if mode == "market_cap" else ()


REASONS = ("blocked", "limit_up", "limit_down", "special", "leaving", "signal_special", "entry_special", "signal_leaving", "entry_leaving", "no_trade")


def with_reasons(rows: DataFrame) -> DataFrame:
    """Adds _entry: why a position cannot be entered the next day, whether or not the factor asks for one.

    special and leaving say so for either day; signal_ and entry_ say which. The limit is the entry day's. Looks at the
    next row of the full calendar, so it must run before the sample is cut. The last day has no next.
    """
    kept = rows.columns
    ahead = W.partitionBy("code").orderBy("t")
    lead = lambda c: F.lead(c).over(ahead)
    rows = rows.withColumns({"_has": F.lead("t").over(ahead).isNotNull(), "_o": lead("o"), "_amt": lead("amt"), "_lim": lead("limit"), "_st": lead("st"), "_del": lead("delisting")})
    no = F.lit(False)
    true = lambda c: F.coalesce(c, no)
    gap = finite(F.when(F.col("c") != 0, F.col("_o") / F.col("c") - 1))
    rows = rows.withColumns({"signal_special": true(F.col("st")), "entry_special": true(F.col("_st")), "signal_leaving": true(F.col("delisting")), "entry_leaving": true(F.col("_del"))})
    rows = rows.withColumns(
        {
            "special": F.col("signal_special") | F.col("entry_special"),
            "leaving": F.col("signal_leaving") | F.col("entry_leaving"),
            "limit_up": true((F.col("_lim") > 0) & (gap >= F.col("_lim") - EDGE)),
            "limit_down": true((F.col("_lim") > 0) & (gap <= -F.col("_lim") + EDGE)),
            "no_trade": F.col("_has") & ~F.coalesce(finite(F.col("_amt")) > 0, no),
        }
    )
    rows = rows.withColumn("blocked", F.col("special") | F.col("leaving") | F.col("limit_up") | F.col("limit_down") | F.col("no_trade"))
    return rows.select(*kept, F.struct(*REASONS).alias("_entry"))


def tradability(rows: DataFrame) -> DataFrame:
    """Adds the reasons of with_reasons as columns, for cells that have a factor. Rows without _entry get it first."""
    rows = rows if "_entry" in rows.columns else with_reasons(rows)
    return rows.withColumns({c: F.col("factor").isNotNull() & F.col(f"_entry.{c}") for c in REASONS})


def mask_untradable(rows: DataFrame) -> DataFrame:
    """rows with the factor taken away where a position cannot be entered."""
    flagged = tradability(rows)
    return flagged.withColumn("factor", F.when(~F.col("blocked"), F.col("factor"))).select(*rows.columns)


def tradability_daily(flagged: DataFrame) -> DataFrame:
    """(t, day, n_factor, n_blocked, ...): each day's cells with a factor and those of each reason, which overlap."""
    return flagged.groupBy("t", "day").agg(F.count("factor").alias("n_factor"), *[F.sum(F.col(c).cast("long")).alias(f"n_{c}") for c in REASONS])


def tradability_summary(flagged: DataFrame) -> DataFrame:
    """One row: tradability_daily summed up, the share of cells and the number of days with any blocked."""
    names = ["n_factor", *[f"n_{c}" for c in REASONS]]
    out = tradability_daily(flagged).agg(*[F.sum(c).alias(c) for c in names], F.sum((F.col("n_blocked") > 0).cast("long")).alias("days_blocked"))
    return out.withColumn("blocked_share", F.when(F.col("n_factor") > 0, F.col("n_blocked") / F.col("n_factor")))
