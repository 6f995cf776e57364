"""The engine's queries by name, each (spark, sf_dir) -> DataFrame, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import texts
from quillon.operators import evaluation as ev
from quillon.operators import correlation, cycles, labels, maintenance, models, research, service, transforms
from quillon.plans.expression import factor
from quillon.sources import panel as source
from quillon.sources import scratch
from quillon.sources.panel import weekly_panel

FACTOR = "(c - o) / ((h - l) + 0.001)"
GROUPS = 10

PANEL_SQL = """
weekly AS (
  SELECT CAST(floor(date_diff('day', DATE '1995-01-02', CAST(l_shipdate AS DATE)) / 7.0) AS INTEGER) AS t, l_suppkey,
    max(l_extendedprice / l_quantity) AS h, min(l_extendedprice / l_quantity) AS l,
    CAST(sum(CAST(l_extendedprice / l_quantity AS DECIMAL(24,9))) AS DOUBLE) / count(*) AS o,
    CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS vol, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amt,
    bool_or(l_returnflag = 'R' AND l_tax >= 0.08) AS st, bool_or(l_linestatus = 'F' AND l_tax = 0 AND l_discount = 0) AS delisting
  FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2),
cells AS (
  SELECT t, DATE '1995-01-02' + t * 7 AS day, lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, amt / vol AS c, o, h, l, vol, amt, (h + l) / 2 AS vwap,
    s_acctbal * (amt / vol) AS cap, CAST(0.1 AS DOUBLE) * (l_suppkey % 3 + 1) AS "limit", st, delisting,
    CASE WHEN s_nationkey % 11 <> 0 THEN CAST(n_regionkey AS VARCHAR) END AS industry
  FROM weekly LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey),
cal AS (SELECT CAST(row_number() OVER (ORDER BY day) - 1 AS INTEGER) AS t, day FROM (SELECT DISTINCT day FROM cells)),
panel AS (
  SELECT d.t, d.day, k.code, c, o, h, l, vol, amt, vwap, cap, "limit", coalesce(st, false) AS st, coalesce(delisting, false) AS delisting, industry
  FROM cal d CROSS JOIN (SELECT DISTINCT code FROM cells) k LEFT JOIN (SELECT * EXCLUDE (t) FROM cells) x ON x.day = d.day AND x.code = k.code)
"""
EVAL_SQL = (
    PANEL_SQL
    + """,
f AS (
  SELECT *, round((c - o) / ((h - l) + 0.001), 9) AS factor,
    round(CASE WHEN lead(o, 1) OVER a <> 0 THEN lead(o, 2) OVER a / lead(o, 1) OVER a - 1 END, 9) AS fwd
  FROM panel WINDOW a AS (PARTITION BY code ORDER BY t)),
p AS (SELECT * FROM f WHERE factor IS NOT NULL AND fwd IS NOT NULL)
"""
)
IC_SQL = """
r AS (SELECT t, day, rank() OVER (PARTITION BY t ORDER BY factor) + (count(*) OVER (PARTITION BY t, factor) - 1) / 2.0::DOUBLE AS a,
  rank() OVER (PARTITION BY t ORDER BY fwd) + (count(*) OVER (PARTITION BY t, fwd) - 1) / 2.0::DOUBLE AS b FROM p),
m AS (SELECT t, day, count(*) AS n, sum(a) AS sa, sum(b) AS sb, sum(a * a) AS saa, sum(b * b) AS sbb, sum(a * b) AS sab FROM r GROUP BY t, day),
ic AS (SELECT t, day, (n * sab - sa * sb) / sqrt((n * saa - sa * sa) * (n * sbb - sb * sb)) AS ic, n FROM m
  WHERE n >= 3 AND n * saa - sa * sa > 0 AND n * sbb - sb * sb > 0)
"""
GROUPS_SQL = f"""
q AS (SELECT *, CAST(floor((rn - 1) * {GROUPS} / cnt) + 1 AS INTEGER) AS grp FROM (
  SELECT *, row_number() OVER (PARTITION BY t ORDER BY factor, code) AS rn, count(*) OVER (PARTITION BY t) AS cnt FROM p) WHERE cnt >= {GROUPS}),
g AS (SELECT t, day, grp, avg(fwd) AS ret FROM q GROUP BY t, day, grp)
"""
NET_SQL = """
w AS (SELECT t, day, grp, code, fwd, 1.0::DOUBLE / count(*) OVER (PARTITION BY t, grp) AS w FROM q),
dd AS (SELECT t, row_number() OVER (ORDER BY t) AS d FROM (SELECT DISTINCT t FROM w)),
wd AS (SELECT d, grp, code, w FROM w JOIN dd USING (t)),
mv AS (SELECT coalesce(x.d, y.d) AS d, coalesce(x.grp, y.grp) AS grp, coalesce(x.w, 0) - coalesce(y.w, 0) AS move
  FROM wd x FULL JOIN (SELECT d + 1 AS d, grp, code, w FROM wd WHERE d < (SELECT max(d) FROM dd)) y ON x.d = y.d AND x.grp = y.grp AND x.code = y.code),
tr AS (SELECT d, grp, sum(greatest(move, 0)) AS bought, sum(greatest(-move, 0)) AS sold FROM mv GROUP BY d, grp),
net AS (SELECT g.t, g.day, g.grp, g.ret AS gross, (bought + sold) / 2 AS turnover, bought * 0.00125 + sold * 0.00175 AS cost,
  g.ret - (bought * 0.00125 + sold * 0.00175) AS ret FROM g JOIN dd USING (t) JOIN tr ON tr.d = dd.d AND tr.grp = g.grp)
"""
W5 = "(PARTITION BY code ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
UP = "(PARTITION BY code ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

#: name: (expression, SQL of its value over the panel).
EXPRESSIONS: dict[str, tuple[str, str]] = {
    **{f"ts_{k}": (f"ts_{k}(c, 5)", f"CASE WHEN count(c) OVER w >= 2 THEN {sql}(c) OVER w END") for k, sql in {"mean": "avg", "std": "stddev_pop", "sum": "sum", "min": "min", "max": "max", "median": "median"}.items()},
    "ts_product": ("ts_product(c / o, 5)", "CASE WHEN count(c / o) OVER w = count(*) OVER w AND count(c / o) OVER w >= 2 THEN product(c / o) OVER w END"),
    "ts_count": ("ts_count(c > o, 5)", "CASE WHEN count(*) OVER w >= 2 THEN CAST(sum(CASE WHEN c > o THEN 1 ELSE 0 END) OVER w AS DOUBLE) END"),
    "ts_corr": ("ts_corr(c, vol, 5)", "CASE WHEN count(c) OVER w >= 2 AND max(c) OVER w > min(c) OVER w AND max(vol) OVER w > min(vol) OVER w THEN covar_pop(c, vol) OVER w / (stddev_pop(c) OVER w * stddev_pop(vol) OVER w) END"),
    "ts_cov": ("ts_cov(c / 1000, vol, 5)", "CASE WHEN count(c) OVER w >= 2 THEN covar_pop(c / 1000, vol) OVER w END"),
    "ts_rank": ("ts_rank(c, 5)", "CASE WHEN c IS NOT NULL AND count(c) OVER w >= 2 THEN (len(list_filter(list(c) FILTER (WHERE c IS NOT NULL) OVER w, lambda v: v < c)) + (len(list_filter(list(c) FILTER (WHERE c IS NOT NULL) OVER w, lambda v: v = c)) + 1) / 2.0::DOUBLE) / count(c) OVER w END"),
    "ts_argmax": ("ts_argmax(c, 5)", "CASE WHEN count(c) OVER w >= 2 THEN CAST(list_position(list(c) OVER w, max(c) OVER w) AS DOUBLE) END"),
    "ts_argmin": ("ts_argmin(c, 5)", "CASE WHEN count(c) OVER w >= 2 THEN CAST(list_position(list(c) OVER w, min(c) OVER w) AS DOUBLE) END"),
    "delay": ("delay(c, 3)", "lag(c, 3) OVER (PARTITION BY code ORDER BY t)"),
    "delta": ("delta(c, 3)", "c - lag(c, 3) OVER (PARTITION BY code ORDER BY t)"),
    "pct": ("pct(c, 3)", "c / lag(c, 3) OVER (PARTITION BY code ORDER BY t) - 1"),
    "decay_linear": ("decay_linear(c, 5)", "CASE WHEN count(c) OVER w >= 2 THEN list_sum(list_transform(range(1, len(list(c) OVER w) + 1), lambda i: i * (list(c) OVER w)[i])) / list_sum(list_transform(range(1, len(list(c) OVER w) + 1), lambda i: CASE WHEN (list(c) OVER w)[i] IS NULL THEN 0 ELSE i END)) END"),
    "ts_linear_reg_slope": ("ts_linear_reg_slope(c, 5)", "CASE WHEN count(c) OVER w >= 2 THEN regr_slope(c, t) OVER w END"),
    "ts_cum_sum": ("ts_cum_sum(c / 1000)", "CASE WHEN c IS NOT NULL THEN sum(c / 1000) OVER u END"),
    "ts_accumulate_positive_return": ("ts_accumulate_positive_return(c / o)", "CASE WHEN count(c) OVER u = count(*) OVER u THEN product(CASE WHEN c / o > 1 THEN c / o - 1 ELSE 1 END) OVER u END"),
    "adv": ("adv(amt, 5)", "CASE WHEN count(amt) OVER w >= 2 THEN avg(amt) OVER w END"),
    "rank_cs": ("rank_cs(c)", "CASE WHEN c IS NOT NULL THEN (rank() OVER (PARTITION BY t, c IS NULL ORDER BY c) + (count(*) OVER (PARTITION BY t, c) - 1) / 2.0::DOUBLE) / count(c) OVER (PARTITION BY t) END"),
    "winsorize_cs": ("winsorize_cs(c, 0.05, 0.95)", "CASE WHEN c IS NOT NULL THEN least(greatest(c, quantile_cont(c, 0.05) OVER (PARTITION BY t)), quantile_cont(c, 0.95) OVER (PARTITION BY t)) END"),
    "zscore_cs": ("zscore_cs(c)", "(c - avg(c) OVER (PARTITION BY t)) / nullif(stddev_pop(c) OVER (PARTITION BY t), 0)"),
    "scale_cs": ("scale_cs(c - o, 2)", "(c - o) * 2 / nullif(sum(abs(c - o)) OVER (PARTITION BY t), 0)"),
    "elementwise_math": ("log(c) + sqrt(vol) + log1p(amt) + abs(c - o) + sign(c - o) + exp((c - o) / c)", "ln(c) + sqrt(vol) + ln(1 + amt) + abs(c - o) + sign(c - o) + exp((c - o) / c)"),
    "elementwise_choice": ("where(c > o, elementwise_max(h - c, o - l), elementwise_min(h - c, o - l)) + signed_power(c - o, 0.5)", "CASE WHEN c > o THEN greatest(h - c, o - l) ELSE least(h - c, o - l) END + sign(c - o) * pow(abs(c - o), 0.5)"),
    "comparison_rules": ("(c < o) * -1 + (c != o) * 2 + ((c >= o) & ~(st == 1)) * 4", "CAST(CASE WHEN c < o THEN -1 ELSE 0 END + CASE WHEN c = o THEN 0 ELSE 2 END + CASE WHEN c >= o AND NOT st THEN 4 ELSE 0 END AS DOUBLE)"),
    "flags_or": ("((c > o) | ~(vol > 30)) * 1 + ((c > o) & (vol > 30)) * 2", "CAST(CASE WHEN coalesce(c > o, false) OR NOT coalesce(vol > 30, false) THEN 1 ELSE 0 END + CASE WHEN c > o AND vol > 30 THEN 2 ELSE 0 END AS DOUBLE)"),
    "numpy_attributes": (
        "np.clip(c, 1000, 1500) + np.maximum(c, o) - np.minimum(c, o) + np.where(np.isnan(c), np.nan, np.abs(c - o)) + np.sign(c - o) * np.sqrt(vol) + np.exp((c - o) / c) + np.log1p(vol) + np.log(c) + np.where(np.isfinite(o), 1, 0) + np.where(c < np.inf, 1, 0)",
        "least(greatest(c, 1000), 1500) + greatest(c, o) - least(c, o) + abs(c - o) + sign(c - o) * sqrt(vol) + exp((c - o) / c) + ln(1 + vol) + ln(c) + CASE WHEN o IS NULL THEN 0 ELSE 1 END + 1",
    ),
    "arithmetic_rules": ("c // 7 + vol % 5 + c ** 0.5 - (0 - o) / (1 + st)", "floor(c / 7) + vol % 5 + pow(c, 0.5) - (0 - o) / (1 + CASE WHEN st THEN 1 ELSE 0 END)"),
}

SHIFT = 1.23456e-8
Query = Callable[[SparkSession, str], DataFrame]


def r6(c, name: str):
    """Rounded for comparing engines: a little is added so that no short decimal is a tie, a zero takes the sign from a zero."""
    return (F.round(c + SHIFT, 6) + 0.0).alias(name)


def _r(sql: str, name: str) -> str:
    return f"round(({sql}) + {SHIFT!r}::DOUBLE, 6) + 0.0 AS {name}"


def _expression(text: str) -> Query:
    return lambda spark, d: factor(weekly_panel(spark, d), text).select("t", "code", r6(F.col("factor"), "v"))


def _expression_sql(sql: str) -> str:
    return f"WITH {PANEL_SQL} SELECT t, code, {_r(f'CAST({sql} AS DOUBLE)', 'v')} FROM panel WINDOW w AS {W5}, u AS {UP}"


def evaluated(spark: SparkSession, d: str, text: str = FACTOR, horizon: int = 1) -> DataFrame:
    """The panel with factor and label, rounded to nine places before anything ranks them."""
    rows = labels.forward_open_return(factor(weekly_panel(spark, d), text), horizon)
    return rows.withColumn("factor", F.round("factor", 9)).withColumn("fwd", F.round("fwd", 9))


def rank_ic_query(spark: SparkSession, d: str) -> DataFrame:
    return ev.rank_ic(evaluated(spark, d)).select("t", "day", F.round("ic", 9).alias("ic"), "n")


def _returns(spark, d):
    return ev.quantile_returns(evaluated(spark, d), GROUPS)


def _net(spark, d):
    return ev.net_returns(evaluated(spark, d), GROUPS)


def _icir(spark, d):
    return ev.icir(ev.rank_ic(evaluated(spark, d))).select("ic_count", *[r6(F.col(c), c) for c in ("ic_mean", "ic_std", "positive_ratio", "icir")])


def _sharpe(spark, d):
    return ev.rolling_sharpe(_returns(spark, d), 20).select("grp", "block", "block_end", r6(F.col("sharpe"), "sharpe"))


def _sharpe_summary(spark, d):
    return ev.sharpe_summary(ev.rolling_sharpe(_returns(spark, d), 60)).select("grp", *[r6(F.col(c), c) for c in ("positive_share", "worst", "middle")])


def _drawdown(spark, d):
    return ev.rolling_drawdown(_returns(spark, d), 60).select("grp", "block", "block_end", r6(F.col("drawdown"), "drawdown"))


def _fitness(spark, d):
    return ev.fitness(_net(spark, d), GROUPS).select("year", *[r6(F.col(c), c) for c in ("sharpe", "max_drawdown", "turnover")], r6(F.ln(1 + F.col("annualized")), "log_annualized"), r6(F.signum("fitness") * F.log1p(F.abs("fitness")), "signed_log_fitness"))


def _leadership(spark, d):
    out = ev.top_leadership(_returns(spark, d), GROUPS)
    return out.select("block", "first_day", "block_end", r6(F.ln(1 + F.col("top_ret")), "top_log"), r6(F.ln(1 + F.col("best_lower")), "best_lower_log"), "best_lower_grp", "leads")


def _top(spark, d):
    return ev.top_summary(_returns(spark, d), GROUPS).select("days", *[r6(F.col(c), c) for c in ("win_rate_mean", "win_rate_all")], r6(F.ln(1 + F.col("top_cumulative")), "top_log"), r6(F.ln(1 + F.col("annualized")), "log_annualized"), "above_every_lower")


def _peak(spark, d):
    return ev.peak_decay(ev.rank_ic(evaluated(spark, d))).select("t", "day", r6(F.col("mean_ic"), "mean_ic"))


def _horizons(spark, d):
    rows = evaluated(spark, d)
    return ev.horizon_decay(rows).select("horizon", r6(F.col("mean_ic"), "mean_ic"), "n_days")


def _newey_west(spark, d):
    return ev.newey_west(ev.rank_ic(evaluated(spark, d))).select("lag", *[r6(F.col(c), c) for c in ("mean", "se", "t", "p")])


def _trend(spark, d):
    return ev.trend_table(ev.rank_ic(evaluated(spark, d))).select("t", "day", *[r6(F.col(c), c) for c in ("ic", *ev.CURVES)])


def _trend_means(spark, d):
    return ev.trend_means(ev.trend_table(ev.rank_ic(evaluated(spark, d)))).select("t", "day", *[r6(F.col(c), c) for c in ev.CURVES])


def _ic_summary(spark, d):
    return ev.ic_summary(evaluated(spark, d))


def _calc_ic(spark, d):
    return ev.calc_ic(evaluated(spark, d), "factor", "fwd").select("day", r6(F.col("ic"), "ic"))


def _ic_info(spark, d):
    return ev.get_ic_info(evaluated(spark, d), "factor", "fwd").select(*[r6(F.col(c), c) for c in ("ic_mean", "ic_std", "abs_ir")])


def _assigned(spark, d):
    return ev.assign_quantile(evaluated(spark, d).select("day", "code", "factor", "fwd"), "factor", 5)


def _group_returns(spark, d):
    out = ev.calc_group_returns(_assigned(spark, d), "group", "fwd", 5)
    return out.select("day", *[r6(F.col(f"G{g}"), f"g{g}") for g in range(1, 6)])


def _evaluate_wide(spark, d):
    panel = factor(weekly_panel(spark, d), FACTOR).select("day", "code", "o", F.round("factor", 9).alias("factor"))
    wide = lambda c: source.long_to_wide(panel, c)
    ic, groups, _ = ev.evaluate_wide(wide("factor"), wide("o"), 1, 5)
    return groups.join(ic.select("t", "ic"), "t", "left").select("t", "grp", r6(F.col("ret"), "ret"), r6(F.col("ic"), "ic"))


def _drawdown_summary(spark, d):
    return ev.drawdown_summary(ev.rolling_drawdown(_returns(spark, d), 60)).select("grp", *[r6(F.col(c), c) for c in ("worst", "middle")])


def _fitness_mean(spark, d):
    return ev.fitness_summary(ev.fitness(_net(spark, d), GROUPS)).select("years", r6(F.signum("fitness") * F.log1p(F.abs("fitness")), "signed_log_fitness"))


def _plot(spark, d):
    wide = ev.cumulative(_returns(spark, d)).groupBy("day").pivot("grp", list(range(1, GROUPS + 1))).agg(F.first("cum"))
    return wide.select("day", *[r6(F.ln(1 + F.col(f"`{g}`")), f"log_g{g}") for g in range(1, GROUPS + 1)])


CYCLE_ROWS = (("1993-01-01", "1996-05-01", "up"), ("1996-05-01", "1999-02-03", "down"), ("1999-02-03", None, "up"), ("2030-01-01", None, "down"))


def _cycles(spark, d):
    return cycles.cycles_of(ev.rank_ic(evaluated(spark, d)), cycles.cycle_table(spark, CYCLE_ROWS))


def _transformed(f) -> Query:
    return lambda spark, d: f(evaluated(spark, d)).select("t", "code", r6(F.col("factor"), "v"))


def _tradability(spark, d):
    return transforms.tradability(evaluated(spark, d)).where("blocked").select("t", "code", *[c for c in transforms.REASONS if c != "blocked"])


def _tradability_summary(spark, d):
    out = transforms.tradability_summary(transforms.tradability(evaluated(spark, d)))
    return out.select(*[c for c in out.columns if c != "blocked_share"], r6(F.col("blocked_share"), "blocked_share"))


def _holdings(spark, d):
    out = research.holdings(evaluated(spark, d), GROUPS)
    return out.select("t", "code", "position", "factor_rank", "entry_st", "entry_delisting", r6(F.col("weight"), "weight"), "entry_day", r6(F.col("entry_open"), "entry_open"), "exit_day", r6(F.col("exit_open"), "exit_open"), r6(F.col("fwd"), "fwd"))


def _holding_summary(spark, d):
    rows = evaluated(spark, d)
    out = research.holding_summary(research.holdings(rows, GROUPS), ev.net_returns(rows, GROUPS), GROUPS)
    return out.select("t", "positions", *[r6(F.col(c), c) for c in ("weight", "gross", "cost", "net")], "reconciles")


MATRIX = {"f1": "c - o", "f2": "pct(c, 1)", "f3": "h - l", "f4": "log(vol)"}


def _matrix(spark, d):
    return correlation.matrix(correlation.exposures(weekly_panel(spark, d), MATRIX), list(MATRIX)).select("f1", "f2", "n", r6(F.col("rho"), "rho"))


def _matrix_row(spark, d):
    """A matrix of three factors to which a fourth is added, and what is too close to it."""
    wide = correlation.exposures(weekly_panel(spark, d), MATRIX)
    known = correlation.matrix(wide, ["f1", "f2", "f3"])
    return correlation.violations(correlation.with_row(known, wide, list(MATRIX), "f4"), 0.02).select("f1", "f2", "n", r6(F.col("rho"), "rho"))


def _block_matrix(spark, d):
    return correlation.block_matrix(correlation.exposures(weekly_panel(spark, d), MATRIX), list(MATRIX)).select("f1", "f2", "block", "n", r6(F.col("rho"), "rho"))


EXPO_SQL = PANEL_SQL + """,
e0 AS (SELECT t, code, c - o AS f1, c / lag(c, 1) OVER (PARTITION BY code ORDER BY t) - 1 AS f2, h - l AS f3, ln(vol) AS f4 FROM panel),
e AS (SELECT t, code, 'f1' AS factor_id, f1 AS x FROM e0 UNION ALL SELECT t, code, 'f2', f2 FROM e0 UNION ALL SELECT t, code, 'f3', f3 FROM e0 UNION ALL SELECT t, code, 'f4', f4 FROM e0)
"""


TERMS = {"move": "c - o", "volume": "vol"}


def _trained(model: str) -> Query:
    def run(spark, d):
        got = models.train(weekly_panel(spark, d), TERMS, model, {"ridge_alpha": 0.001})
        row = [(got["weights"]["move"] * 1000, got["weights"]["volume"] * 1000, got["mse"], got["r2"] * 1000, got["condition"], int(got["days"]), int(got["pairs"]))]
        out = spark.createDataFrame(row, "move double, volume double, mse double, r2 double, condition double, days long, pairs long")
        return out.select(*[r6(F.col(c), c) for c in ("move", "volume", "mse", "r2", "condition")], "days", "pairs")

    return run


def _blend(spark, d):
    text = models.blend("manual_weights", TERMS, {"move": 0.75, "volume": -0.25})
    return factor(weekly_panel(spark, d), text).select("t", "code", r6(F.col("factor"), "v"))


def _market_caps(spark, d):
    rows = weekly_panel(spark, d, ("t", "day", "code", "cap"))
    values = rows.where("cap is not null and cap > 0").select(F.col("day").cast("string").alias("day"), F.col("code").cast("int").cast("string").alias("code"), F.col("cap").alias("values"))
    return maintenance.market_cap_cells(values, rows).select("day", "code", r6(F.col("cap"), "cap"))


def _true_cells(spark, d):
    rows = weekly_panel(spark, d, ("t", "day", "code", "st"))
    return maintenance.true_cells(rows.where("st").select("day", F.col("code").cast("int").cast("string").alias("code"), "st"), "st", rows).select("day", "code", "st")


def _repaired(spark, d):
    rows = weekly_panel(spark, d).where("c is not null")
    history = rows.where("day < date '1998-01-05' and st").select("day", "code")
    market = rows.where("day >= date '1998-01-05'").select("day", "code", (F.col("l") * (1 + F.col("vol") / 400)).alias("limit_up"), F.col("l").alias("pre_close"), F.when(F.col("delisting"), 4).when(F.col("st"), 1).alias("event"))
    names = rows.select("code", F.lit("plain").alias("name")).distinct()
    return maintenance.repaired_tail(history, market, names, "2000-01-03")


def _metric_maps(spark, d):
    rows = ev.rank_ic(evaluated(spark, d)).groupBy(F.year("day").alias("year")).agg(F.count("ic").cast("double").alias("days"), F.max("n").cast("double").alias("pairs"), F.lit(None).cast("double").alias("none"))
    text = rows.select("year", texts.metric_map(["days", "pairs", "none"]).alias("details"))
    return text.select("year", texts.metric_of(F.col("details"), "days").alias("days"), texts.metric_of(F.col("details"), "none").alias("none"), F.size(F.json_object_keys("details")).alias("n"))


def _industry_cells(spark, d):
    rows = weekly_panel(spark, d, ("t", "day", "code", "industry"))
    # The checks read it as well as the result.
    return source.industry_cells(scratch.stored(source.long_to_wide(rows, "industry"), "industry_wide"))


def _references(spark, d):
    suppliers = spark.read.parquet(f"{d}/supplier.parquet").select(texts.normalized_code(F.col("s_suppkey")).alias("code"), "s_name", "s_suppkey", "s_nationkey")
    some = suppliers.select("code", F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).alias("name"))
    aliases = suppliers.where("s_suppkey % 2 = 0").select("code", F.concat(F.lit("alias "), "code").alias("name"))
    nations = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").cast("string").alias("industry"), F.col("n_name").alias("industry_name"))
    return maintenance.holding_references(some, aliases, suppliers.join(nations, "s_nationkey").select("code", "industry", "industry_name"))


def _preprocessed(mode: str) -> Query:
    def run(spark, d):
        rows = transforms.with_styles(evaluated(spark, d), transforms.styles_of(mode))
        return transforms.preprocess(rows, mode).select("t", "code", r6(F.col("factor"), "v"))

    return run


def _betas(spark, d):
    return transforms.cap_betas(evaluated(spark, d)).select("t", "n", r6(F.col("beta"), "beta"))


def _limit_ratio(spark, d):
    return maintenance.limit_ratio(weekly_panel(spark, d)).select("t", "code", "ratio")


def _carried(spark, d):
    rows = weekly_panel(spark, d).withColumn("observed", F.when(F.col("st"), True).when(F.col("vol") > 60, False))
    return maintenance.carried_status(rows).select("t", "code", "status")


def _upsert(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    news = orders.where("o_orderkey % 10 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1).dropDuplicates(["o_orderkey"])
    return maintenance.upsert(orders.where("o_orderkey % 3 <> 1"), news, ["o_orderkey"])


def _intervals(spark, d):
    events = spark.read.parquet(f"{d}/orders.parquet").where("o_orderstatus in ('F', 'O')")
    events = events.groupBy(F.col("o_custkey").alias("code"), F.col("o_orderdate").cast("date").alias("start")).agg(F.min(F.when(F.col("o_orderstatus") == "F", 6).otherwise(7)).alias("state"))
    calendar = weekly_panel(spark, d, ("t", "day", "code")).select("day").distinct()
    spans = maintenance.status_intervals(events, 6, 7, "2001-12-31")
    return maintenance.interval_days(spans, calendar).groupBy("day").agg(F.count(F.lit(1)).alias("n_codes"))


def _rebase(spark, d):
    rows = weekly_panel(spark, d).where("c is not null").select("day", "code", "o", "h", "l", "c", "vol", "amt")
    old, new = rows.where("day < date '2000-01-03'"), rows.where("day >= date '2000-01-03'").withColumn("suspended", F.col("vol") < 5)
    last = F.row_number().over(W.partitionBy("code").orderBy(F.col("day").desc()))
    boundary = old.withColumn("k", last).where("k = 1").select("code", F.col("c").alias("old_close"), F.col("o").alias("pre_close"), F.lit(1.1).alias("adj"))
    out = maintenance.rebased_merge(old, new, boundary)
    return out.select("day", "code", r6(F.col("o"), "o"), r6(F.col("c"), "c"), r6(F.col("vwap"), "vwap"))


def _coverage(spark, d):
    return maintenance.coverage(weekly_panel(spark, d))


def _latest(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    return maintenance.latest(orders.groupBy("o_orderkey", "o_custkey", "o_orderdate").agg(F.max("o_totalprice").alias("o_totalprice")), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", r6(F.col("o_totalprice"), "o_totalprice"))


def _timing(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("stage"), F.col("value").alias("seconds"))
    out = maintenance.timing_report(events)
    return out.select("stage", "runs", *[r6(F.col(c), c) for c in ("total", "middle", "p95", "slowest")])


def _panel(spark, d):
    out = weekly_panel(spark, d)
    return out.select("t", "day", "code", *[r6(F.col(c), c) for c in ("c", "o", "h", "l", "vol", "amt", "vwap", "cap", "limit")], "st", "delisting", "industry")


def _label(spark, d):
    return labels.forward_open_return(weekly_panel(spark, d), 2).select("t", "code", r6(F.col("fwd"), "fwd"))


def _window(spark, d):
    rows = labels.sample_window(evaluated(spark, d), "1997-01-06", "1997-12-29", 1)
    return rows.groupBy("day").agg(F.count("fwd").alias("n"))


def _decay(spark, d):
    return factor(weekly_panel(spark, d), "c", decay=5).select("t", "code", r6(F.col("factor"), "v"))


def _sma(spark, d):
    return factor(weekly_panel(spark, d), "ts_sma(c, 5, 2)").select("t", "code", r6(F.col("factor"), "v"))


CAUSAL = "rank_cs(ts_mean(c, 5))"


def _looking_ahead(panel: DataFrame) -> DataFrame:
    """What no expression can say: the next day's close."""
    return panel.withColumn("factor", F.lead("c").over(W.partitionBy("code").orderBy("t")))


def _causality(check) -> Query:
    """A causal factor and one that looks a day ahead, on the same days."""

    def run(spark, d):
        # The days and ten frames are built from the panel: it is kept by code and in order, so that none sums or sorts lines again.
        panel = weekly_panel(spark, d, ("t", "day", "code", "c")).select("t", "code", "c").sortWithinPartitions("code", "t").persist()
        at = research.checkpoints(factor(panel, CAUSAL))
        out = check(panel, CAUSAL, at).withColumn("kind", F.lit("causal")).unionByName(check(panel, _looking_ahead, at).withColumn("kind", F.lit("ahead")))
        # A row a checked day, computed before the panel goes.
        found = spark.createDataFrame(out.collect(), out.schema)
        panel.unpersist()
        return found

    return run


def _styles(spark, d):
    panel = factor(factor(evaluated(spark, d), "ts_mean(amt, 20)", "s1"), "pct(c, 5)", "s2")
    return transforms.style_neutralize(panel.select("t", "code", "factor", "s1", "s2"), ["s1", "s2"]).select("t", "code", r6(F.col("factor"), "v"))


def _alpha(spark, d):
    return factor(weekly_panel(spark, d), "-1 * ts_corr(rank_cs(delta(vol, 2)), rank_cs((c - o) / o), 6)").select("t", "code", r6(F.col("factor"), "v"))


def _orders(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet")


def _job_status(spark, d):
    status = F.when(F.col("o_orderkey") % 17 == 0, "failed").when(F.col("o_orderkey") % 5 == 0, "cancelled").when(F.col("o_orderkey") % 3 == 0, "skipped").when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "P", "running").when(F.col("o_custkey") % 2 == 0, "queued").otherwise("succeeded")
    return service.job_status(_orders(spark, d).select(F.col("o_custkey").alias("job"), status.alias("status")))


def _tagged(spark, d):
    tags = _orders(spark, d).select(F.col("o_custkey").alias("factor"), F.col("o_orderpriority").alias("tag"))
    # Full-width figures: the compatibility form of a tag is what counts.
    tags = tags.withColumn("tag", F.when(F.col("factor") % 2 == 0, F.concat(F.lit(" "), F.translate("tag", "12-", "\uff11\uff12\uff0d"))).otherwise(F.col("tag")))
    return service.tagged(tags, ["1-Urgent", " 2-HIGH "], "all")


def _page(spark, d):
    rows = research.holdings(evaluated(spark, d), GROUPS)
    names = spark.read.parquet(f"{d}/supplier.parquet").select(texts.normalized_code(F.col("s_suppkey")).alias("code"), F.col("s_name").alias("name"))
    industries = spark.read.parquet(f"{d}/region.parquet").select(F.col("r_regionkey").cast("string").alias("industry"), F.col("r_name").alias("industry_name"))
    out = service.holdings_page(rows, "1996-12-02", names, industries, 2, 5)
    return out.select("t", "code", "position", r6(F.col("weight"), "weight"), "name", "industry_name")


def _compare_runs(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").groupBy(F.pmod("user_id", F.lit(3)).cast("string").alias("run"), F.col("event_type").alias("metric")).agg(F.max("value").alias("value"))
    out = service.compared(rows, ["0", "1", "2"])
    return out.select("metric", *[r6(F.col(f"`{k}`"), f"run_{k}") for k in range(3)])


def _periods(spark, d):
    orders = _orders(spark, d).groupBy(F.col("o_custkey").alias("name")).agg(F.min(F.col("o_orderdate").cast("date")).alias("start"), F.max(F.col("o_orderdate").cast("date")).alias("stop"))
    return service.clipped_periods(orders, "1996-01-01", "1997-12-31")


def _special(spark, d):
    rows = weekly_panel(spark, d).where("c is not null")
    rows = rows.select("t", "day", "code", (F.col("l") * (1 + F.col("vol") / 400)).alias("limit_up"), F.col("l").alias("pre_close"), F.when(F.col("delisting"), 4).when(F.col("st"), 1).alias("event"))
    return service_status(rows)


def service_status(rows: DataFrame) -> DataFrame:
    """What the limits and events of each day say, carried forward."""
    seen = maintenance.special_from_limits(rows, "2000-01-03")
    return maintenance.carried_status(seen).select("t", "code", "observed", "status")


def queries() -> dict[str, Query]:
    return {
        "panel_weekly": _panel,
        **{name: _expression(text) for name, (text, _) in EXPRESSIONS.items()},
        "run_decay": _decay,
        "ts_sma": _sma,
        "nested_alpha": _alpha,
        "forward_label": _label,
        "sample_window": _window,
        "rank_ic": rank_ic_query,
        "rank_icir": _icir,
        "quantile_returns": lambda s, d: _returns(s, d).select("t", "day", "grp", r6(F.col("ret"), "ret")),
        "quantile_cumulative": lambda s, d: ev.cumulative(_returns(s, d)).select("t", "grp", r6(F.ln(1 + F.col("cum")), "log_wealth")),
        "quantile_net_returns": lambda s, d: _net(s, d).select("t", "grp", *[r6(F.col(c), c) for c in ("gross", "turnover", "cost", "ret")]),
        "top_quantile_performance": _top,
        "top_quantile_leadership": _leadership,
        "rolling_sharpe": _sharpe,
        "rolling_sharpe_summary": _sharpe_summary,
        "rolling_drawdown": _drawdown,
        "fitness": _fitness,
        "newey_west_ic_significance": _newey_west,
        "ic_peak_decay": _peak,
        "ic_trend_filter": _trend,
        "ic_trend_means": _trend_means,
        "rank_ic_summary": _ic_summary,
        "calc_ic": _calc_ic,
        "get_ic_info": _ic_info,
        "assign_quantile": lambda s, d: _assigned(s, d).select("day", "code", "group"),
        "calc_group_returns": _group_returns,
        "evaluate_wide": _evaluate_wide,
        "rolling_drawdown_summary": _drawdown_summary,
        "fitness_summary": _fitness_mean,
        "quantile_plot": _plot,
        "cycle_context": _cycles,
        "ic_horizon_decay": _horizons,
        "tradability_filter": _tradability,
        "tradability_summary": _tradability_summary,
        "market_cap_neutralize": _transformed(transforms.cap_neutralize),
        "industry_neutralize": _transformed(transforms.industry_neutralize),
        "industry_market_cap_neutralize": _transformed(transforms.industry_cap_neutralize),
        "median_mad_winsorize": _transformed(transforms.mad_winsorize),
        "style_neutralize": _styles,
        "preprocess_paper_local": _preprocessed("paper_local"),
        "preprocess_market_cap": _preprocessed("market_cap"),
        "preprocess_market_cap_industry": _preprocessed("market_cap_industry"),
        "industry_market_cap_betas": _betas,
        "prefix_truncation_consistency": _causality(research.prefix_truncation),
        "future_data_perturbation": _causality(research.future_perturbation),
        "holding_audit": _holdings,
        "holding_audit_summary": _holding_summary,
        "factor_correlation": _matrix,
        "factor_block_correlation": _block_matrix,
        "factor_correlation_row": _matrix_row,
        "rank_ridge": _trained("rank_ridge"),
        "winsorized_zscore_ridge": _trained("winsorized_zscore_ridge"),
        "manual_weights": _blend,
        "market_cap_cells": _market_caps,
        "true_status_cells": _true_cells,
        "repaired_status_tail": _repaired,
        "metric_maps": _metric_maps,
        "industry_cells": _industry_cells,
        "holding_references": _references,
        "limit_ratio": _limit_ratio,
        "carried_status": _carried,
        "upsert": _upsert,
        "interval_days": _intervals,
        "rebased_merge": _rebase,
        "industry_coverage": _coverage,
        "latest_run": _latest,
        "job_status": _job_status,
        "tagged_factors": _tagged,
        "holdings_page": _page,
        "compared_runs": _compare_runs,
        "clipped_periods": _periods,
        "special_status": _special,
        "timeline": lambda s, d: service.timeline(weekly_panel(s, d, ("t", "day", "code"))),
        "timing_report": _timing,
    }


def oracle_sql() -> dict[str, str]:
    q, n = f"WITH {EVAL_SQL}, {GROUPS_SQL}", f"WITH {EVAL_SQL}, {GROUPS_SQL}, {NET_SQL}"
    ic = f"WITH {EVAL_SQL}, {IC_SQL}"
    block = lambda size: f"bl AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY grp, block) AS k, max(day) OVER (PARTITION BY grp, block) AS block_end FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY grp ORDER BY t) - 1) / {size}) AS INTEGER) AS block FROM g)) WHERE k = {size})"
    sharpe = "avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252)"
    days = f"""{PANEL_SQL}, ok AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT t FROM (SELECT t, count(c) OVER {W5} AS k FROM panel) WHERE k >= 2)),
            cp AS (SELECT t FROM ok WHERE i IN (0, round((n - 1) / 3.0), round(2 * (n - 1) / 3.0), n - 1)), ks AS (SELECT count(DISTINCT code) AS cells FROM panel)"""
    z = f"{ic}, z AS (SELECT row_number() OVER (ORDER BY t) AS i, t, day, ic, avg(ic) OVER () AS m, count(*) OVER () AS n FROM ic)"
    trend = z.replace("WITH ", "WITH RECURSIVE ", 1) + """,
            g AS (SELECT (0.01 + sqrt(0.0001 + 0.04)) / 2 AS p, 2.0::DOUBLE / 31 AS a),
            zz AS MATERIALIZED (SELECT *, lag(ic, 1) OVER o AS x1, lag(ic, 2) OVER o AS x2, lag(ic, 3) OVER o AS x3 FROM z WINDOW o AS (ORDER BY i)),
            rec AS (SELECT i, ic AS kalman, ic AS low_pass, CAST(NULL AS DOUBLE) AS before FROM zz WHERE i = 1 UNION ALL
              SELECT q.i, kalman + p / (p + 1) * (q.ic - kalman), CASE WHEN q.i <= 3 THEN q.ic ELSE 2 * (1 - a) * low_pass - (1 - a) * (1 - a) * before + (a - a * a / 4) * x1 + a * a / 2 * x2 - (a - 3 * a * a / 4) * x3 END, low_pass FROM rec JOIN zz q ON q.i = rec.i + 1, g),
            wave AS MATERIALIZED (SELECT k, sum(ic * cos(2 * pi() * k * (i - 1) / n)) AS re, -sum(ic * sin(2 * pi() * k * (i - 1) / n)) AS im FROM z, (SELECT unnest(range(0, 40)) AS k) WHERE k * 31 <= n GROUP BY k),
            fourier AS (SELECT i, sum(CASE WHEN k = 0 THEN re ELSE 2 * (re * cos(2 * pi() * k * (i - 1) / n) - im * sin(2 * pi() * k * (i - 1) / n)) END) / max(n) AS fourier FROM z, wave GROUP BY i),
            curves AS (SELECT z.i, z.t, z.day, z.ic, kalman, low_pass, fourier FROM z JOIN rec USING (i) JOIN fourier USING (i))"""
    mad = "wi AS (SELECT * EXCLUDE (factor, m, s), CASE WHEN factor IS NOT NULL THEN least(greatest(factor, m - 5 * s), m + 5 * s) END AS factor FROM (SELECT *, median(abs(factor - m)) OVER (PARTITION BY t) AS s FROM (SELECT *, median(factor) OVER (PARTITION BY t) AS m FROM {})))"
    zscored = f"SELECT t, code, {_r('(v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0)', 'v')} FROM {{}} WINDOW w AS (PARTITION BY t)"

    def residual(table: str, styles: dict[str, str]) -> str:
        """CTEs that end in res (t, code, v): y of table with the styles taken out one after the other."""
        names = list(styles)
        whole = " AND ".join(["factor IS NOT NULL", *[f"({x}) IS NOT NULL" for x in styles.values()]])
        out = [f"g0 AS (SELECT t, code, {', '.join(f'CASE WHEN {whole} THEN {x} END AS {k}' for k, x in styles.items())}, CASE WHEN {whole} THEN factor END AS y FROM {table})"]
        out.append(f"g1 AS (SELECT t, code, count(y) OVER w AS n, {', '.join(f'{k} - avg({k}) OVER w AS {k}' for k in [*names, 'y'])} FROM g0 WINDOW w AS (PARTITION BY t))")
        for i, k in enumerate(names):
            left = [*names[i + 1 :], "y"]
            out.append(f"g{i + 2} AS (SELECT t, code, n, {', '.join(f'{x} - sum({k} * {x}) OVER w / nullif(sum({k} * {k}) OVER w, 0) * {k} AS {x}' for x in left)} FROM g{i + 1} WINDOW w AS (PARTITION BY t))")
        return ", ".join(out) + f", res AS (SELECT t, code, CASE WHEN n >= {len(names) + 3} THEN y END AS v FROM g{len(names) + 1})"

    reasons = f"""tr0 AS (SELECT *, lead(t) OVER w IS NOT NULL AS has, lead(o) OVER w AS o1, lead(amt) OVER w AS amt1, lead("limit") OVER w AS lim1, coalesce(lead(st) OVER w, false) AS st1, coalesce(lead(delisting) OVER w, false) AS del1 FROM f WINDOW w AS (PARTITION BY code ORDER BY t)),
            tr AS (SELECT *, factor IS NOT NULL AS live, st AS s0, delisting AS d0, coalesce(lim1 > 0 AND o1 / nullif(c, 0) - 1 >= lim1 - 0.002, false) AS up1, coalesce(lim1 > 0 AND o1 / nullif(c, 0) - 1 <= -lim1 + 0.002, false) AS down1, has AND NOT coalesce(amt1 > 0, false) AS none1 FROM tr0),
            tb AS (SELECT * EXCLUDE (live), live, live AND (s0 OR st1) AS special, live AND (d0 OR del1) AS leaving, live AND up1 AS limit_up, live AND down1 AS limit_down, live AND none1 AS no_trade, live AND s0 AS signal_special, live AND st1 AS entry_special, live AND d0 AS signal_leaving, live AND del1 AS entry_leaving,
              live AND (s0 OR st1 OR d0 OR del1 OR up1 OR down1 OR none1) AS blocked FROM tr)"""
    styled = f"""sty AS (SELECT *, ln(CASE WHEN cap > 0 THEN cap END) AS log_cap, c / lag(c, 20) OVER k - 1 AS return_20, ln(CASE WHEN count(amt) OVER k20 >= 10 AND avg(amt) OVER k20 > 0 THEN avg(amt) OVER k20 END) AS log_amount_20, CASE WHEN count(r1) OVER k20 >= 10 THEN stddev_pop(r1) OVER k20 END AS volatility_20
            FROM (SELECT *, c / lag(c, 1) OVER (PARTITION BY code ORDER BY t) - 1 AS r1 FROM {{}}) WINDOW k AS (PARTITION BY code ORDER BY t), k20 AS (PARTITION BY code ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""

    def ridge(features: str) -> str:
        return f"""WITH {EVAL_SQL}, lab AS (SELECT *, CASE WHEN lead(o, 1) OVER a <> 0 THEN lead(o, 2) OVER a / lead(o, 1) OVER a - 1 END AS y0 FROM panel WINDOW a AS (PARTITION BY code ORDER BY t)), {features},
            b AS (SELECT t, a - avg(a) OVER w AS a, b - avg(b) OVER w AS b, y0 - avg(y0) OVER w AS y, count(*) OVER w AS n FROM fe WHERE a IS NOT NULL AND b IS NOT NULL AND y0 IS NOT NULL WINDOW w AS (PARTITION BY t)),
            m AS (SELECT count(DISTINCT t) AS days, count(*) AS pairs, sum(a * a / n) / count(DISTINCT t) AS aa, sum(a * b / n) / count(DISTINCT t) AS ab, sum(b * b / n) / count(DISTINCT t) AS bb, sum(a * y / n) / count(DISTINCT t) AS ay, sum(b * y / n) / count(DISTINCT t) AS cy, sum(y * y / n) / count(DISTINCT t) AS yy FROM b WHERE n >= 3),
            s AS (SELECT *, (ay * (bb + 0.001) - cy * ab) / ((aa + 0.001) * (bb + 0.001) - ab * ab) AS w1, (cy * (aa + 0.001) - ay * ab) / ((aa + 0.001) * (bb + 0.001) - ab * ab) AS w2, sqrt((aa - bb) * (aa - bb) + 4 * ab * ab) AS gap FROM m),
            e AS (SELECT *, yy - 2 * (w1 * ay + w2 * cy) + w1 * w1 * aa + 2 * w1 * w2 * ab + w2 * w2 * bb AS mse FROM s)
            SELECT {_r('w1 * 1000', 'move')}, {_r('w2 * 1000', 'volume')}, {_r('mse', 'mse')}, {_r('(1 - mse / yy) * 1000', 'r2')}, {_r('(aa + bb + gap) / (aa + bb - gap)', 'condition')}, days, pairs FROM e"""

    fit_rows = f"""{n}, y AS (SELECT *, year(day) AS year FROM net WHERE grp = {GROUPS}),
            v AS (SELECT *, product(1 + ret) OVER (PARTITION BY year ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS wealth FROM y),
            z AS (SELECT *, wealth / greatest(max(wealth) OVER (PARTITION BY year ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) - 1 AS dd FROM v),
            s AS (SELECT CAST(year AS INTEGER) AS year, pow(product(1 + ret), 252.0::DOUBLE / count(*)) - 1 AS annualized, {sharpe} AS sharpe, least(-min(dd), 1) AS max_drawdown, avg(turnover) AS turnover FROM z GROUP BY year)
            SELECT fit_columns FROM (SELECT *, sharpe * sqrt(abs(annualized) / greatest(turnover, 0.125)) - CASE WHEN max_drawdown < 1 THEN max_drawdown / pow(1 - max_drawdown, 2) END AS fit FROM s)"""
    flat = "SELECT t, code, CASE WHEN factor IS NOT NULL AND cap > 0 THEN ln(cap) END AS x, CASE WHEN factor IS NOT NULL AND cap > 0 THEN factor END AS y"
    return {
        "panel_weekly": f"WITH {PANEL_SQL} SELECT t, day, code, {', '.join(_r(c, c) for c in ('c', 'o', 'h', 'l', 'vol', 'amt', 'vwap', 'cap'))}, {_r(chr(34) + 'limit' + chr(34), chr(34) + 'limit' + chr(34))}, st, delisting, industry FROM panel",
        **{name: _expression_sql(sql) for name, (_, sql) in EXPRESSIONS.items()},
        "run_decay": f"WITH {PANEL_SQL}, a AS (SELECT t, code, list(c) OVER {W5} AS v FROM panel) SELECT t, code, {_r('CASE WHEN list_count(v) > 0 THEN list_sum(list_transform(range(1, len(v) + 1), lambda i: (5 - len(v) + i) * v[i])) / list_sum(list_transform(range(1, len(v) + 1), lambda i: CASE WHEN v[i] IS NULL THEN 0 ELSE 5 - len(v) + i END)) END', 'v')} FROM a",
        "nested_alpha": f"""WITH {PANEL_SQL}, a AS (SELECT t, code, vol - lag(vol, 2) OVER (PARTITION BY code ORDER BY t) AS x, (c - o) / o AS y FROM panel),
            b AS (SELECT t, code, CASE WHEN x IS NOT NULL THEN (rank() OVER (PARTITION BY t, x IS NULL ORDER BY x) + (count(*) OVER (PARTITION BY t, x) - 1) / 2.0::DOUBLE) / count(x) OVER (PARTITION BY t) END AS x,
              CASE WHEN y IS NOT NULL THEN (rank() OVER (PARTITION BY t, y IS NULL ORDER BY y) + (count(*) OVER (PARTITION BY t, y) - 1) / 2.0::DOUBLE) / count(y) OVER (PARTITION BY t) END AS y FROM a),
            d AS (SELECT t, code, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN x END AS x, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN y END AS y FROM b)
            SELECT t, code, {_r('CASE WHEN count(x) OVER w >= 3 AND max(x) OVER w > min(x) OVER w AND max(y) OVER w > min(y) OVER w THEN -1 * covar_pop(x, y) OVER w / (stddev_pop(x) OVER w * stddev_pop(y) OVER w) END', 'v')} FROM d WINDOW w AS (PARTITION BY code ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""",
        "forward_label": f"WITH {PANEL_SQL} SELECT t, code, {_r('lead(o, 3) OVER a / nullif(lead(o, 1) OVER a, 0) - 1', 'fwd')} FROM panel WINDOW a AS (PARTITION BY code ORDER BY t)",
        "sample_window": f"WITH {EVAL_SQL}, d AS (SELECT day, row_number() OVER (ORDER BY day DESC) AS k FROM (SELECT DISTINCT day FROM f WHERE day BETWEEN DATE '1997-01-06' AND DATE '1997-12-29')) SELECT day, count(fwd) AS n FROM f JOIN d USING (day) WHERE k > 2 GROUP BY day",
        "rank_ic": f"{ic} SELECT t, day, round(ic, 9) AS ic, n FROM ic",
        "rank_icir": f"{ic} SELECT count(ic) AS ic_count, {_r('avg(ic)', 'ic_mean')}, {_r('stddev_samp(ic)', 'ic_std')}, {_r('avg(CASE WHEN ic > 0 THEN 1.0::DOUBLE ELSE 0 END)', 'positive_ratio')}, {_r('avg(ic) / nullif(stddev_samp(ic), 0)', 'icir')} FROM ic",
        "quantile_returns": f"{q} SELECT t, day, grp, {_r('ret', 'ret')} FROM g",
        "quantile_cumulative": f"{q} SELECT t, grp, {_r('ln(product(1 + ret) OVER (PARTITION BY grp ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))', 'log_wealth')} FROM g",
        "quantile_net_returns": f"{n} SELECT t, grp, {', '.join(_r(c, c) for c in ('gross', 'turnover', 'cost', 'ret'))} FROM net",
        "top_quantile_performance": f"""{q}, d AS (SELECT t, max(ret) FILTER (WHERE grp = {GROUPS}) AS top, avg(ret) FILTER (WHERE grp < {GROUPS}) AS lo, max(ret) FILTER (WHERE grp < {GROUPS}) AS hi FROM g GROUP BY t),
            k AS (SELECT grp, avg(ret) AS m FROM g GROUP BY grp)
            SELECT count(*) AS days, {_r('avg(CASE WHEN top > lo THEN 1.0::DOUBLE WHEN top <= lo THEN 0 END)', 'win_rate_mean')}, {_r('avg(CASE WHEN top > hi THEN 1.0::DOUBLE WHEN top <= hi THEN 0 END)', 'win_rate_all')}, {_r('ln(product(1 + coalesce(top, 0)))', 'top_log')}, {_r('ln(product(1 + coalesce(top, 0))) * 252.0::DOUBLE / count(*)', 'log_annualized')},
              (SELECT max(m) FILTER (WHERE grp = {GROUPS}) > max(m) FILTER (WHERE grp < {GROUPS}) FROM k) AS above_every_lower FROM d""",
        "top_quantile_leadership": f"""{q}, {block(60)}, b AS (SELECT block, grp, min(day) AS first_day, max(day) AS block_end, product(1 + ret) - 1 AS ret FROM bl GROUP BY block, grp),
            x AS (SELECT block, min(first_day) AS first_day, max(block_end) AS block_end, max(ret) FILTER (WHERE grp = {GROUPS}) AS top_ret, max(ret) FILTER (WHERE grp < {GROUPS}) AS best FROM b GROUP BY block)
            SELECT x.block, x.first_day, x.block_end, {_r('ln(1 + top_ret)', 'top_log')}, {_r('ln(1 + best)', 'best_lower_log')}, (SELECT min(grp) FROM b WHERE b.block = x.block AND b.grp < {GROUPS} AND b.ret = x.best) AS best_lower_grp, top_ret >= best AS leads FROM x""",
        "rolling_sharpe": f"{q}, {block(20)} SELECT grp, block, block_end, {_r(sharpe, 'sharpe')} FROM bl GROUP BY grp, block, block_end",
        "rolling_sharpe_summary": f"{q}, {block(60)}, s AS (SELECT grp, {sharpe} AS sharpe FROM bl GROUP BY grp, block) SELECT grp, {_r('avg(CASE WHEN sharpe > 0 THEN 1.0::DOUBLE WHEN sharpe <= 0 THEN 0 END)', 'positive_share')}, {_r('min(sharpe)', 'worst')}, {_r('median(sharpe)', 'middle')} FROM s GROUP BY grp",
        "rolling_drawdown": f"{q}, {block(60)}, v AS (SELECT *, product(1 + ret) OVER (PARTITION BY grp, block ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS wealth FROM bl), p2 AS (SELECT *, wealth / greatest(max(wealth) OVER (PARTITION BY grp, block ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) - 1 AS dd FROM v) SELECT grp, block, block_end, {_r('min(dd)', 'drawdown')} FROM p2 GROUP BY grp, block, block_end",
        "fitness": fit_rows.replace("SELECT fit_columns", f"SELECT year, {', '.join(_r(c, c) for c in ('sharpe', 'max_drawdown', 'turnover'))}, {_r('ln(1 + annualized)', 'log_annualized')}, {_r('sign(fit) * ln(1 + abs(fit))', 'signed_log_fitness')}"),
        "fitness_summary": f"SELECT count(x) AS years, {_r('sign(avg(x)) * ln(1 + abs(avg(x)))', 'signed_log_fitness')} FROM (SELECT fit AS x FROM ({fit_rows.replace('SELECT fit_columns', 'SELECT fit')}))",
        "ic_peak_decay": f"{ic}, k AS (SELECT *, row_number() OVER (ORDER BY t) AS rn, avg(ic) OVER (ORDER BY t ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS m FROM ic) SELECT t, day, {_r('m', 'mean_ic')} FROM k WHERE rn >= 60 AND (rn - 60) % 10 = 0",
        "ic_horizon_decay": f"""WITH {EVAL_SQL}, hz AS (SELECT CAST(unnest(range(20, 253)) AS INTEGER) AS horizon), last AS (SELECT max(t) - 253 AS t1 FROM panel),
            s AS (SELECT a.t, a.code, horizon, a.factor, round(b.o / x.o - 1, 9) AS fwd FROM f a JOIN last ON a.t <= t1 JOIN hz ON true JOIN f x ON x.code = a.code AND x.t = a.t + 1 JOIN f b ON b.code = a.code AND b.t = a.t + 1 + horizon WHERE a.factor IS NOT NULL AND x.o <> 0 AND b.o IS NOT NULL),
            r AS (SELECT horizon, t, rank() OVER (PARTITION BY horizon, t ORDER BY factor) + (count(*) OVER (PARTITION BY horizon, t, factor) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY horizon, t ORDER BY fwd) + (count(*) OVER (PARTITION BY horizon, t, fwd) - 1) / 2.0::DOUBLE AS b FROM s),
            i AS (SELECT horizon, t, corr(a, b) AS ic FROM r GROUP BY horizon, t HAVING count(*) >= 3 AND max(a) > min(a) AND max(b) > min(b)),
            k AS (SELECT *, count(*) OVER (PARTITION BY t) AS k FROM i) SELECT horizon, {_r('avg(ic)', 'mean_ic')}, count(*) AS n_days FROM k WHERE k = 233 GROUP BY horizon""",
        "newey_west_ic_significance": f"""{z}, cv AS (SELECT b.i - a.i AS k, sum((a.ic - a.m) * (b.ic - b.m)) / max(a.n) AS g, max(a.n) AS n, max(a.m) AS m FROM z a JOIN z b ON b.i >= a.i GROUP BY 1),
            qt AS (SELECT *, abs(g / first_value(g) OVER (ORDER BY k)) <= 2 / sqrt(n) AS q FROM cv), q3 AS (SELECT *, q AND lead(q, 1) OVER (ORDER BY k) AND lead(q, 2) OVER (ORDER BY k) AS run FROM qt),
            lg AS (SELECT coalesce(min(k) FILTER (WHERE run AND k BETWEEN 1 AND n - 3) - 1, max(n) - 1) AS lag FROM q3),
            se AS (SELECT CAST(max(lag) AS INTEGER) AS lag, max(m) AS mean, sqrt(greatest(sum(CASE WHEN k = 0 THEN g WHEN k <= lag THEN 2 * (1 - k / (lag + 1.0::DOUBLE)) * g ELSE 0 END), 0) / max(n)) AS se FROM cv, lg),
            tt AS (SELECT *, mean / se AS t FROM se)
            SELECT lag, {_r('mean', 'mean')}, {_r('se', 'se')}, {_r('t', 't')}, {_r('(SELECT 2 * sum(exp(-(abs(t) + x * 0.003) * (abs(t) + x * 0.003) / 2) * CASE WHEN x IN (0, 4000) THEN 1 WHEN x % 2 = 1 THEN 4 ELSE 2 END) * 0.003 / 3 / sqrt(2 * pi()) FROM (SELECT unnest(range(0, 4001)) AS x))', 'p')} FROM tt""",
        "ic_trend_filter": f"{trend} SELECT t, day, {', '.join(_r(c, c) for c in ('ic', *ev.CURVES))} FROM curves",
        "ic_trend_means": f"{trend} SELECT t, day, {', '.join(_r(c, c) for c in ev.CURVES)} FROM (SELECT i, t, day, {', '.join(f'avg({c}) OVER (ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS {c}' for c in ev.CURVES)} FROM curves) WHERE i >= 10 AND (i - 10) % 5 = 0",
        "rank_ic_summary": f"{ic} SELECT (SELECT count(*) FROM ic) AS ic_count, (SELECT CAST(sum(n) AS BIGINT) FROM m WHERE n >= 3) AS pair_count, (SELECT min(day) FROM ic) AS start_day, (SELECT max(day) FROM ic) AS end_day",
        "calc_ic": f"{ic} SELECT c.day, {_r('ic', 'ic')} FROM cal c LEFT JOIN ic USING (day)",
        "get_ic_info": f"{ic} SELECT {_r('avg(ic)', 'ic_mean')}, {_r('stddev_samp(ic)', 'ic_std')}, {_r('abs(avg(ic) / stddev_samp(ic))', 'abs_ir')} FROM ic",
        **{
            name: f"WITH {EVAL_SQL}, gr AS (SELECT day, code, fwd, CASE WHEN factor IS NOT NULL THEN CAST(floor((row_number() OVER (PARTITION BY t, factor IS NULL ORDER BY factor, code) - 1) * 5 / count(factor) OVER (PARTITION BY t)) + 1 AS INTEGER) END AS grp FROM f) {rest}"
            for name, rest in {
                "assign_quantile": 'SELECT day, code, grp AS "group" FROM gr',
                "calc_group_returns": "SELECT day, " + ", ".join(_r(f"avg(fwd) FILTER (WHERE grp = {g})", f"g{g}") for g in range(1, 6)) + " FROM gr WHERE grp IS NOT NULL AND fwd IS NOT NULL GROUP BY day",
            }.items()
        },
        "evaluate_wide": f"""WITH {PANEL_SQL}, x0 AS (SELECT t, day, code, o, round((c - o) / ((h - l) + 0.001), 9) AS x FROM panel),
            f AS (SELECT t, day, code, x AS factor, CASE WHEN lead(o, 1) OVER a <> 0 THEN lead(o, 2) OVER a / lead(o, 1) OVER a - 1 END AS fwd FROM x0 WINDOW a AS (PARTITION BY code ORDER BY t)),
            p AS (SELECT * FROM f WHERE factor IS NOT NULL AND fwd IS NOT NULL), {IC_SQL}, q AS (SELECT *, CAST(floor((rn - 1) * 5 / cnt) + 1 AS INTEGER) AS grp FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY factor, code) AS rn, count(*) OVER (PARTITION BY t) AS cnt FROM p) WHERE cnt >= 5)
            SELECT q.t, grp, {_r('avg(fwd)', 'ret')}, {_r('any_value(ic)', 'ic')} FROM q LEFT JOIN ic USING (t) GROUP BY q.t, grp""",
        "rolling_drawdown_summary": f"{q}, {block(60)}, v AS (SELECT *, product(1 + ret) OVER (PARTITION BY grp, block ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS wealth FROM bl), p2 AS (SELECT *, wealth / greatest(max(wealth) OVER (PARTITION BY grp, block ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) - 1 AS dd FROM v), p3 AS (SELECT grp, block, min(dd) AS drawdown FROM p2 GROUP BY grp, block) SELECT grp, {_r('min(drawdown)', 'worst')}, {_r('median(drawdown)', 'middle')} FROM p3 GROUP BY grp",
        "quantile_plot": f"{q}, cu AS (SELECT t, day, grp, ln(product(1 + ret) OVER (PARTITION BY grp ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS lw FROM g) SELECT day, {', '.join(_r(f'max(lw) FILTER (WHERE grp = {g})', f'log_g{g}') for g in range(1, GROUPS + 1))} FROM cu GROUP BY day",
        "cycle_context": f"""{ic}, sp AS (SELECT min(day) AS lo, max(day) AS hi FROM ic), cy AS (SELECT CAST(a AS DATE) AS a, CAST(b AS DATE) AS b, d FROM (VALUES {', '.join(f"('{x}', {'NULL' if y is None else chr(39) + y + chr(39)}, '{w}')" for x, y, w in CYCLE_ROWS)}) v(a, b, d))
            SELECT greatest(a, lo) AS start, least(coalesce(b, hi), hi) AS stop, d AS direction, b IS NULL AS provisional FROM cy, sp WHERE greatest(a, lo) <= least(coalesce(b, hi), hi)""",
        "ts_sma": f"""WITH RECURSIVE {PANEL_SQL}, pm AS MATERIALIZED (SELECT t, code, c FROM panel),
            sm AS (SELECT t, code, c AS y, 1.0::DOUBLE AS old FROM pm WHERE t = 0 UNION ALL SELECT p.t, p.code, CASE WHEN p.c IS NULL THEN y WHEN y IS NULL THEN p.c ELSE (old * 0.6 * y + 0.4 * p.c) / (old * 0.6 + 0.4) END, CASE WHEN p.c IS NOT NULL OR y IS NULL THEN 1 ELSE old * 0.6 END FROM sm JOIN pm p ON p.code = sm.code AND p.t = sm.t + 1)
            SELECT t, code, {_r('y', 'v')} FROM sm""",
        "style_neutralize": f"WITH {EVAL_SQL}, sy AS (SELECT *, CASE WHEN count(amt) OVER k20 >= 10 THEN avg(amt) OVER k20 END AS s1, c / lag(c, 5) OVER (PARTITION BY code ORDER BY t) - 1 AS s2 FROM f WINDOW k20 AS (PARTITION BY code ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), {residual('sy', {'a1': 's1', 'a2': 's2'})} SELECT t, code, {_r('v', 'v')} FROM res",
        "preprocess_paper_local": f"WITH {EVAL_SQL}, {styled.format('f')}, {reasons.replace('FROM f WINDOW', 'FROM sty WINDOW')}, ma AS (SELECT * EXCLUDE (factor), CASE WHEN NOT blocked THEN factor END AS factor FROM tb), {mad.format('ma')}, {residual('wi', {'a1': 'log_cap', 'a2': 'return_20', 'a3': 'log_amount_20', 'a4': 'volatility_20'})} {zscored.format('res')}",
        "preprocess_market_cap": f"WITH {EVAL_SQL}, {mad.format('f')}, {residual('wi', {'a1': 'ln(CASE WHEN cap > 0 THEN cap END)'})} {zscored.format('res')}",
        **{
            name: f"""WITH {EVAL_SQL}, {source_rows}, aa AS ({flat}, industry FROM {rows_of}), ab AS (SELECT t, code, industry, CASE WHEN industry IS NOT NULL THEN x END AS x, CASE WHEN industry IS NOT NULL THEN y END AS y FROM aa),
            ad AS (SELECT t, code, y, CASE WHEN y IS NOT NULL THEN industry END AS ind, x - avg(x) OVER g AS dx, y - avg(y) OVER g AS dy FROM ab WINDOW g AS (PARTITION BY t, industry)),
            asl AS (SELECT t, sum(dx * dy) / sum(dx * dx) AS slope, count(y) AS n, count(DISTINCT ind) + 1 AS k FROM ad GROUP BY t),
            res AS (SELECT t, code, CASE WHEN n > k THEN dy - slope * dx END AS v, CASE WHEN n > k THEN slope END AS slope FROM ad JOIN asl USING (t)) {rest}"""
            for name, (source_rows, rows_of, rest) in {
                "preprocess_market_cap_industry": (mad.format("f") + ", wj AS (SELECT * EXCLUDE (industry), CASE WHEN count(factor) OVER (PARTITION BY t, industry) >= 3 THEN industry END AS industry FROM wi)", "wj", zscored.format("res")),
                "industry_market_cap_betas": ("fx AS (SELECT * FROM f)", "fx", f"SELECT t, count(v) AS n, {_r('max(slope)', 'beta')} FROM res GROUP BY t"),
            }.items()
        },
        "holding_audit_summary": f"{n}, hs AS (SELECT t, count(*) AS positions, 1.0::DOUBLE / count(*) AS weight, avg(fwd) AS gross FROM q WHERE grp = {GROUPS} GROUP BY t) SELECT hs.t, positions, {_r('weight', 'weight')}, {_r('hs.gross', 'gross')}, {_r('cost', 'cost')}, {_r('ret', 'net')}, abs(hs.gross - cost - ret) <= 1e-12 AS reconciles FROM hs JOIN net ON net.t = hs.t AND net.grp = {GROUPS}",
        "tradability_filter": f"WITH {EVAL_SQL}, {reasons} SELECT t, code, {', '.join(c for c in transforms.REASONS if c != 'blocked')} FROM tb WHERE blocked",
        "tradability_summary": f"WITH {EVAL_SQL}, {reasons} SELECT count(*) FILTER (WHERE live) AS n_factor, {', '.join(f'count(*) FILTER (WHERE {c}) AS n_{c}' for c in transforms.REASONS)}, count(DISTINCT t) FILTER (WHERE blocked) AS days_blocked, {_r('count(*) FILTER (WHERE blocked) / count(*) FILTER (WHERE live)::DOUBLE', 'blocked_share')} FROM tb",
        "market_cap_neutralize": f"WITH {EVAL_SQL}, a AS ({flat} FROM f) SELECT t, code, {_r('CASE WHEN count(y) OVER w >= 3 THEN y - avg(y) OVER w - covar_pop(x, y) OVER w / var_pop(x) OVER w * (x - avg(x) OVER w) END', 'v')} FROM a WINDOW w AS (PARTITION BY t)",
        "industry_neutralize": f"WITH {EVAL_SQL} SELECT t, code, {_r('CASE WHEN industry IS NOT NULL AND count(factor) OVER w >= 3 THEN factor - avg(factor) OVER w END', 'v')} FROM f WINDOW w AS (PARTITION BY t, industry)",
        "industry_market_cap_neutralize": f"""WITH {EVAL_SQL}, a AS ({flat}, industry FROM f), b AS (SELECT t, code, industry, CASE WHEN industry IS NOT NULL THEN x END AS x, CASE WHEN industry IS NOT NULL THEN y END AS y FROM a),
            d AS (SELECT t, code, y, CASE WHEN y IS NOT NULL THEN industry END AS ind, x - avg(x) OVER g AS dx, y - avg(y) OVER g AS dy FROM b WINDOW g AS (PARTITION BY t, industry)),
            s AS (SELECT t, sum(dx * dy) / sum(dx * dx) AS slope, count(y) AS n, count(DISTINCT ind) + 1 AS k FROM d GROUP BY t)
            SELECT t, code, {_r('CASE WHEN n > k THEN dy - slope * dx END', 'v')} FROM d JOIN s USING (t)""",
        "median_mad_winsorize": f"WITH {EVAL_SQL}, a AS (SELECT t, code, factor, median(factor) OVER (PARTITION BY t) AS m FROM f), b AS (SELECT *, median(abs(factor - m)) OVER (PARTITION BY t) AS s FROM a) SELECT t, code, {_r('CASE WHEN factor IS NOT NULL THEN least(greatest(factor, m - 5 * s), m + 5 * s) END', 'v')} FROM b",
        **{
            name: f"""WITH {days} SELECT 'causal' AS kind, t, cells, CAST(0 AS BIGINT) AS changed FROM cp, ks UNION ALL SELECT 'ahead', cp.t, any_value(cells), count(x.c) FROM cp LEFT JOIN panel x ON x.t = cp.t + 1, ks GROUP BY cp.t"""
            for name in ("prefix_truncation_consistency", "future_data_perturbation")
        },
        "holding_audit": f"""{q}, h AS (SELECT t, code, lead(day, 1) OVER a AS entry_day, lead(o, 1) OVER a AS entry_open, lead(day, 2) OVER a AS exit_day, lead(o, 2) OVER a AS exit_open, coalesce(lead(st) OVER a, false) AS entry_st, coalesce(lead(delisting) OVER a, false) AS entry_delisting FROM f WINDOW a AS (PARTITION BY code ORDER BY t))
            SELECT t, code, CAST(row_number() OVER (PARTITION BY t ORDER BY factor DESC, code DESC) AS INTEGER) AS position, CAST(rn AS INTEGER) AS factor_rank, entry_st, entry_delisting, {_r('1.0::DOUBLE / count(*) OVER (PARTITION BY t)', 'weight')}, entry_day, {_r('entry_open', 'entry_open')}, exit_day, {_r('exit_open', 'exit_open')}, {_r('fwd', 'fwd')} FROM (SELECT * FROM q WHERE grp = {GROUPS}) JOIN h USING (t, code)""",
        "factor_correlation": f"WITH {EXPO_SQL} SELECT a.factor_id AS f1, b.factor_id AS f2, count(*) AS n, {_r('corr(a.x, b.x)', 'rho')} FROM e a JOIN e b ON a.t = b.t AND a.code = b.code AND a.factor_id < b.factor_id WHERE a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY 1, 2",
        "factor_block_correlation": f"""WITH {EXPO_SQL}, d AS (SELECT t, CAST(floor((row_number() OVER (ORDER BY t) - 1) / 60) AS INTEGER) AS block FROM (SELECT DISTINCT t FROM e)), d2 AS (SELECT t, block FROM d QUALIFY count(*) OVER (PARTITION BY block) = 60)
            SELECT a.factor_id AS f1, b.factor_id AS f2, block, count(*) AS n, {_r('corr(a.x, b.x)', 'rho')} FROM e a JOIN e b ON a.t = b.t AND a.code = b.code AND a.factor_id < b.factor_id JOIN d2 ON d2.t = a.t WHERE a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY 1, 2, 3""",
        "factor_correlation_row": f"WITH {EXPO_SQL} SELECT * FROM (SELECT a.factor_id AS f1, b.factor_id AS f2, count(*) AS n, {_r('corr(a.x, b.x)', 'rho')} FROM e a JOIN e b ON a.t = b.t AND a.code = b.code AND a.factor_id < b.factor_id WHERE a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY 1, 2) WHERE abs(rho) >= 0.02",
        "rank_ridge": ridge("""fe AS (SELECT t, y0, CASE WHEN c IS NOT NULL THEN (rank() OVER (PARTITION BY t, c IS NULL ORDER BY c - o) + (count(*) OVER (PARTITION BY t, c - o) - 1) / 2.0::DOUBLE) / count(c) OVER (PARTITION BY t) END AS a,
              CASE WHEN vol IS NOT NULL THEN (rank() OVER (PARTITION BY t, c IS NULL ORDER BY vol) + (count(*) OVER (PARTITION BY t, vol) - 1) / 2.0::DOUBLE) / count(c) OVER (PARTITION BY t) END AS b FROM lab)"""),
        "winsorized_zscore_ridge": ridge("""fw AS (SELECT t, y0, CASE WHEN c IS NOT NULL THEN least(greatest(c - o, quantile_cont(c - o, 0.01) OVER w), quantile_cont(c - o, 0.99) OVER w) END AS a, CASE WHEN vol IS NOT NULL THEN least(greatest(vol, quantile_cont(vol, 0.01) OVER w), quantile_cont(vol, 0.99) OVER w) END AS b FROM lab WINDOW w AS (PARTITION BY t)),
            fe AS (SELECT t, y0, (a - avg(a) OVER w) / nullif(stddev_pop(a) OVER w, 0) AS a, (b - avg(b) OVER w) / nullif(stddev_pop(b) OVER w, 0) AS b FROM fw WINDOW w AS (PARTITION BY t))"""),
        "manual_weights": f"WITH {PANEL_SQL} SELECT t, code, {_r('CASE WHEN c IS NOT NULL THEN 0.75 * (rank() OVER (PARTITION BY t, c IS NULL ORDER BY c - o) + (count(*) OVER (PARTITION BY t, c - o) - 1) / 2.0::DOUBLE) / count(c) OVER (PARTITION BY t) - 0.25 * (rank() OVER (PARTITION BY t, c IS NULL ORDER BY vol) + (count(*) OVER (PARTITION BY t, vol) - 1) / 2.0::DOUBLE) / count(c) OVER (PARTITION BY t) END', 'v')} FROM panel",
        "market_cap_cells": f"WITH {PANEL_SQL} SELECT day, code, {_r('CASE WHEN cap > 0 THEN cap END', 'cap')} FROM panel",
        "true_status_cells": f"WITH {PANEL_SQL} SELECT day, code, st FROM panel WHERE st",
        "repaired_status_tail": f"""WITH {PANEL_SQL}, x AS (SELECT day, code, l * (1 + vol / 400) AS up, l, st, CASE WHEN delisting THEN 4 WHEN st THEN 1 END AS event FROM panel WHERE c IS NOT NULL), ed AS (SELECT max(day) AS edge FROM x WHERE day < DATE '1998-01-05' AND st),
            ob AS (SELECT day, code, true AS observed FROM x, ed WHERE day = edge AND st UNION ALL SELECT day, code, CASE WHEN event IS NOT NULL THEN event <> 1 WHEN day < DATE '2000-01-03' AND NOT (code LIKE '30%' OR code LIKE '68%' OR code LIKE '4%' OR code LIKE '8%') AND (up / l - 1) * 100 BETWEEN 3.5 AND 6.5 THEN true
              WHEN day < DATE '2000-01-03' AND NOT (code LIKE '30%' OR code LIKE '68%' OR code LIKE '4%' OR code LIKE '8%') AND (up / l - 1) * 100 BETWEEN 8.5 AND 11.5 THEN false END FROM x WHERE day >= DATE '1998-01-05'),
            ca AS (SELECT day, code, coalesce(last_value(observed IGNORE NULLS) OVER (PARTITION BY code ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS status FROM ob)
            SELECT day, code, true AS status FROM x WHERE day < DATE '1998-01-05' AND st UNION ALL SELECT day, code, status FROM ca WHERE day >= DATE '1998-01-05' AND status""",
        "metric_maps": f"{ic} SELECT CAST(year(day) AS INTEGER) AS year, CAST(count(*) AS DOUBLE) AS days, CAST(NULL AS DOUBLE) AS none, 2 AS n FROM ic GROUP BY 1",
        "industry_cells": f"WITH {PANEL_SQL} SELECT day, code, industry FROM panel WHERE industry IS NOT NULL",
        "holding_references": "SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, CASE WHEN s_suppkey % 3 <> 0 THEN s_name WHEN s_suppkey % 2 = 0 THEN 'alias ' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') END AS name, CAST(n_regionkey AS VARCHAR) AS industry, n_name AS industry_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey",
        "limit_ratio": f"""WITH {PANEL_SQL}, a AS (SELECT t, code, c, count(c) OVER (PARTITION BY code ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k, min(CASE WHEN c IS NOT NULL THEN t END) OVER (PARTITION BY code) AS first FROM panel)
            SELECT t, code, CASE WHEN first > 0 AND c IS NOT NULL AND k <= 5 THEN NULL WHEN code LIKE '30%' OR code LIKE '68%' THEN 0.2::DOUBLE WHEN code LIKE '4%' OR code LIKE '8%' OR code LIKE '92%' THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END AS ratio FROM a""",
        "carried_status": f"WITH {PANEL_SQL} SELECT t, code, coalesce(last_value(CASE WHEN st THEN true WHEN vol > 60 THEN false END IGNORE NULLS) OVER (PARTITION BY code ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS status FROM panel",
        "upsert": "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 1 AND o_orderkey % 10 <> 0 UNION ALL SELECT o_orderkey, o_custkey, o_totalprice + 1, o_orderstatus FROM orders WHERE o_orderkey % 10 = 0",
        "interval_days": f"""WITH {PANEL_SQL}, e AS (SELECT o_custkey AS code, CAST(o_orderdate AS DATE) AS start, min(CASE WHEN o_orderstatus = 'F' THEN 6 ELSE 7 END) AS state FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2),
            i AS (SELECT code, start, state, coalesce(lead(start) OVER (PARTITION BY code ORDER BY start) - 1, DATE '2001-12-31') AS stop FROM e)
            SELECT d.day, count(DISTINCT i.code) AS n_codes FROM (SELECT DISTINCT day FROM cells) d JOIN i ON state = 6 AND d.day BETWEEN i.start AND i.stop GROUP BY d.day""",
        "rebased_merge": f"""WITH {PANEL_SQL}, x AS (SELECT * FROM panel WHERE c IS NOT NULL), b AS (SELECT code, o * 1.1 / c AS k FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY day DESC) AS rn FROM x WHERE day < DATE '2000-01-03') WHERE rn = 1)
            SELECT day, code, {_r('o * coalesce(k, 1)', 'o')}, {_r('c * coalesce(k, 1)', 'c')}, {_r('(h * coalesce(k, 1) + l * coalesce(k, 1)) / 2', 'vwap')} FROM x LEFT JOIN b USING (code) WHERE day < DATE '2000-01-03'
            UNION ALL SELECT day, code, {_r('CASE WHEN vol >= 5 THEN o END', 'o')}, {_r('CASE WHEN vol >= 5 THEN c END', 'c')}, {_r('CASE WHEN vol >= 5 THEN (h + l) / 2 END', 'vwap')} FROM x WHERE day >= DATE '2000-01-03'""",
        "industry_coverage": f"WITH {PANEL_SQL} SELECT industry, min(day) AS first_day, max(day) AS last_day, count(DISTINCT code) AS n_codes, count(*) AS n FROM panel WHERE industry IS NOT NULL AND c IS NOT NULL GROUP BY industry",
        "latest_run": f"WITH a AS (SELECT o_orderkey, o_custkey, o_orderdate, max(o_totalprice) AS p FROM orders GROUP BY 1, 2, 3) SELECT o_custkey, o_orderkey, {_r('p', 'o_totalprice')} FROM a QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
        "job_status": """WITH r AS (SELECT o_custkey AS job, CASE WHEN o_orderkey % 17 = 0 THEN 'failed' WHEN o_orderkey % 5 = 0 THEN 'cancelled' WHEN o_orderkey % 3 = 0 THEN 'skipped' WHEN o_orderstatus = 'F' THEN 'succeeded' WHEN o_orderstatus = 'P' THEN 'running' WHEN o_custkey % 2 = 0 THEN 'queued' ELSE 'succeeded' END AS status FROM orders)
            SELECT job, count(*) AS n, count(*) FILTER (WHERE status NOT IN ('queued', 'running')) AS n_ended, count(*) FILTER (WHERE status = 'failed') AS n_failed,
              CASE WHEN bool_or(status = 'running') THEN 'running' WHEN bool_or(status = 'queued') THEN 'queued' WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'cancelled') THEN 'cancelled' ELSE 'succeeded' END AS status FROM r GROUP BY job""",
        "tagged_factors": "SELECT o_custkey AS factor FROM orders WHERE lower(trim(o_orderpriority)) IN ('1-urgent', '2-high') GROUP BY o_custkey HAVING count(DISTINCT lower(trim(o_orderpriority))) = 2",
        "holdings_page": f"""{q}, h AS (SELECT t, code, industry, CAST(row_number() OVER (PARTITION BY t ORDER BY factor DESC, code DESC) AS INTEGER) AS position, 1.0::DOUBLE / count(*) OVER (PARTITION BY t) AS weight FROM q WHERE grp = {GROUPS} AND day = DATE '1996-12-02')
            SELECT t, code, position, {_r('weight', 'weight')}, s_name AS name, r_name AS industry_name FROM h LEFT JOIN supplier ON lpad(CAST(s_suppkey AS VARCHAR), 6, '0') = code LEFT JOIN region ON CAST(r_regionkey AS VARCHAR) = industry WHERE position BETWEEN 3 AND 7""",
        "compared_runs": f"SELECT event_type AS metric, {', '.join(_r(f'max(value) FILTER (WHERE user_id % 3 = {k})', f'run_{k}') for k in range(3))} FROM events GROUP BY event_type",
        "clipped_periods": "SELECT name, greatest(start, DATE '1996-01-01') AS start, least(stop, DATE '1997-12-31') AS stop FROM (SELECT o_custkey AS name, CAST(min(o_orderdate) AS DATE) AS start, CAST(max(o_orderdate) AS DATE) AS stop FROM orders GROUP BY 1) WHERE start <= DATE '1997-12-31' AND stop >= DATE '1996-01-01'",
        "special_status": f"""WITH {PANEL_SQL}, a AS (SELECT t, day, code, l * (1 + vol / 400) AS up, l, CASE WHEN delisting THEN 4 WHEN st THEN 1 END AS event FROM panel WHERE c IS NOT NULL),
            b AS (SELECT t, code, CASE WHEN event IS NOT NULL THEN event <> 1 WHEN day < DATE '2000-01-03' AND NOT (code LIKE '30%' OR code LIKE '68%' OR code LIKE '4%' OR code LIKE '8%') AND (up / l - 1) * 100 BETWEEN 3.5 AND 6.5 THEN true
              WHEN day < DATE '2000-01-03' AND NOT (code LIKE '30%' OR code LIKE '68%' OR code LIKE '4%' OR code LIKE '8%') AND (up / l - 1) * 100 BETWEEN 8.5 AND 11.5 THEN false END AS observed FROM a)
            SELECT t, code, observed, coalesce(last_value(observed IGNORE NULLS) OVER (PARTITION BY code ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS status FROM b""",
        "timeline": f"WITH {PANEL_SQL} SELECT DISTINCT day FROM cells",
        "timing_report": f"SELECT event_type AS stage, count(*) AS runs, {_r('sum(value)', 'total')}, {_r('median(value)', 'middle')}, {_r('quantile_cont(value, 0.95)', 'p95')}, {_r('max(value)', 'slowest')} FROM events GROUP BY event_type",
    }
