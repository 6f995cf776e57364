"""Queries over several factors, bounded samples and stored tables, each (spark, sf_dir) -> DataFrame, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon import queries as q
from quillon.operators import correlation, intervals, labels, maintenance, research, search, standards
from quillon.operators import evaluation as ev
from quillon.plans.expression import factor, factors
from quillon.queries import EVAL_SQL, GROUPS, GROUPS_SQL, IC_SQL, MATRIX, NET_SQL, PANEL_SQL, _r, evaluated, r6
from quillon.sources import scratch
from quillon.sources.panel import weekly_panel

#: Related expressions, as a generation of a search has them, and their SQL over the panel.
POPULATION = {
    "ts_mean(c, 5) - c": "CASE WHEN count(c) OVER w >= 2 THEN avg(c) OVER w END - c",
    "c - ts_mean(c, 5)": "c - CASE WHEN count(c) OVER w >= 2 THEN avg(c) OVER w END",
    "ts_mean(c, 5) / ts_std(c, 5)": "CASE WHEN count(c) OVER w >= 2 THEN avg(c) OVER w / nullif(stddev_pop(c) OVER w, 0) END",
    "vol * (ts_mean(c, 5) - c)": "vol * (CASE WHEN count(c) OVER w >= 2 THEN avg(c) OVER w END - c)",
    "delay(c, 3) - ts_max(c, 5)": "lag(c, 3) OVER (PARTITION BY code ORDER BY t) - CASE WHEN count(c) OVER w >= 2 THEN max(c) OVER w END",
    "ts_max(c, 5) + delay(c, 3)": "CASE WHEN count(c) OVER w >= 2 THEN max(c) OVER w END + lag(c, 3) OVER (PARTITION BY code ORDER BY t)",
}
#: Factors that the studies of many factors look at.
FOUR = {"shape": ("(c - o) / ((h - l) + 0.001)", "(c - o) / ((h - l) + 0.001)"), "volume": ("vol", "vol"), "price": ("c / o", "c / o"), "range": ("h - l", "h - l")}
#: Bounds of the sample, neither of which is a day of the panel.
FIRST, LAST = "1996-01-03", "1996-12-28"
LEVEL, LEAST_IC, LEAST_SHARPE, LEAST_RETURN = 0.05, 0.0, 1.0, 0.30


def _population(spark, d):
    rows = labels.forward_open_return(weekly_panel(spark, d), 1).withColumn("fwd", F.round("fwd", 9)).select("t", "day", "code", "c", "vol", "fwd")
    out = search.evaluate_population(rows.persist(), dict(enumerate(POPULATION)))
    return out.select("expr_id", "n_days", r6(F.col("mean_ic"), "mean_ic"), r6(F.col("ic_std"), "ic_std"), "pairs")


def _population_sql() -> str:
    one = lambda k, x: rf"""SELECT * FROM (WITH {EVAL_SQL.replace('round((c - o) / ((h - l) + 0.001), 9) AS factor', f'round({x}, 9) AS factor').replace('WINDOW a AS (PARTITION BY code ORDER BY t)', f'WINDOW a AS (PARTITION BY code ORDER BY t), w AS {q.W5}')}, {IC_SQL}
        SELECT {k} AS expr_id, count(*) AS n_days, {_r('avg(ic)', 'mean_ic')}, {_r('stddev_samp(ic)', 'ic_std')}, CAST(sum(n) AS BIGINT) AS pairs FROM ic)"""  # noqa: E731
    return " UNION ALL ".join(one(k, x) for k, x in enumerate(POPULATION.values()))


def _four(spark, d) -> DataFrame:
    """(name, t, day, ic) of the four factors."""
    rows = labels.forward_open_return(factors(weekly_panel(spark, d), {k: x for k, (x, _) in FOUR.items()}), 1).withColumn("fwd", F.round("fwd", 9))
    return ev.rank_ics(rows.withColumns({k: F.round(k, 9) for k in FOUR}), list(FOUR))


def _retargeted(sql: str, columns: str) -> str:
    """SQL about the usual factor, as a union over the four."""
    usual = "round((c - o) / ((h - l) + 0.001), 9) AS factor"
    return " UNION ALL ".join(f"SELECT '{name}' AS name, {columns} FROM ({sql.replace(usual, f'round({x}, 9) AS factor')})" for name, (_, x) in FOUR.items())


def _newey_west(spark, d):
    out = ev.newey_west(_four(spark, d), ("name",))
    return out.select("name", "lag", *[r6(F.col(c), c) for c in ("mean", "se", "t", "p")])


def _trends(spark, d):
    out = ev.trend_table(_four(spark, d), ("name",))
    return out.select("name", "t", *[r6(F.col(c), c) for c in ev.CURVES])


def _gates(spark, d):
    """Both standards over two of the factors: what the gates look at, and what they say."""
    panel = scratch.stored(weekly_panel(spark, d), "panel")
    rows = []
    for name, (text, _) in list(FOUR.items())[:2]:
        for r in standards.run_standards(panel, text, n_groups=GROUPS):
            m = r["metrics"]
            rows.append((name, r["standard"], r["passed"], m.get("ic_mean"), m.get("nw_p"), m.get("above_every_lower"), m.get("sharpe_60_median"), m.get("annualized")))
    scratch.forget(panel)
    out = spark.createDataFrame(rows, "name string, standard string, passed boolean, ic_mean double, nw_p double, leads boolean, sharpe double, annualized double")
    return out.select("name", "standard", "passed", r6(F.col("ic_mean"), "ic_mean"), r6(F.col("nw_p"), "nw_p"), "leads", r6(F.col("sharpe"), "sharpe"), r6(F.when(F.col("annualized") > -0.9, F.ln(1 + F.col("annualized"))), "log_annualized"))


def _gates_sql() -> str:
    base = q.oracle_sql()
    flat = "SELECT t, code, CASE WHEN factor IS NOT NULL AND cap > 0 THEN ln(cap) END AS x, CASE WHEN factor IS NOT NULL AND cap > 0 THEN factor END AS y"
    raw = EVAL_SQL.replace("round(CASE WHEN lead(o, 1) OVER a <> 0 THEN lead(o, 2) OVER a / lead(o, 1) OVER a - 1 END, 9) AS fwd", "CASE WHEN lead(o, 1) OVER a <> 0 THEN lead(o, 2) OVER a / lead(o, 1) OVER a - 1 END AS fwd")
    neutral = f"""na AS ({flat}, industry FROM f), nb AS (SELECT t, code, industry, CASE WHEN industry IS NOT NULL THEN x END AS x, CASE WHEN industry IS NOT NULL THEN y END AS y FROM na),
        nd AS (SELECT t, code, y, CASE WHEN y IS NOT NULL THEN industry END AS ind, x - avg(x) OVER g AS dx, y - avg(y) OVER g AS dy FROM nb WINDOW g AS (PARTITION BY t, industry)),
        ns AS (SELECT t, sum(dx * dy) / sum(dx * dx) AS slope, count(y) AS n, count(DISTINCT ind) + 1 AS k FROM nd GROUP BY t),
        nz AS (SELECT f.* EXCLUDE (factor), CASE WHEN ns.n > k THEN dy - slope * dx END AS factor FROM f JOIN nd USING (t, code) JOIN ns USING (t))"""
    tested = "p AS (SELECT * FROM f WHERE factor IS NOT NULL AND fwd IS NOT NULL)"
    ic = raw.replace(tested, f"{neutral}, p AS (SELECT * FROM nz WHERE factor IS NOT NULL AND fwd IS NOT NULL)")
    text = base["newey_west_ic_significance"]
    significance = text[text.index("z AS (") : text.rindex("SELECT lag,")]
    tail = text[text.index("(SELECT 2 * sum(exp(") : text.index("(SELECT unnest(range(0, 4001)) AS x))") + len("(SELECT unnest(range(0, 4001)) AS x))")]
    trade = base["tradability_filter"]
    reasons = trade[trade.index("tr0 AS") : trade.index("SELECT t, code, limit_up")].replace("FROM f WINDOW", "FROM nz WINDOW")
    reasons = re.sub(r"\btr\b", "marks", reasons)
    profit = raw.replace(tested, f"{neutral}, {reasons}, p AS (SELECT * FROM tb WHERE NOT blocked AND factor IS NOT NULL AND fwd IS NOT NULL)")
    blocks = "bl AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY block) AS k FROM (SELECT ret, CAST(floor((row_number() OVER (ORDER BY t) - 1) / 60) AS INTEGER) AS block FROM net WHERE grp = 10)) WHERE k = 60)"
    one = f"""SELECT 'ic_test' AS standard, ic_mean > {LEAST_IC} AND p < {LEVEL} AS passed, {_r('ic_mean', 'ic_mean')}, {_r('p', 'nw_p')}, CAST(NULL AS BOOLEAN) AS leads, CAST(NULL AS DOUBLE) AS sharpe, CAST(NULL AS DOUBLE) AS log_annualized
          FROM (WITH {ic}, {IC_SQL}, {significance} SELECT mean AS ic_mean, {tail} AS p FROM tt)
        UNION ALL SELECT 'profitability_test', leads AND (coalesce(sharpe >= {LEAST_SHARPE}, false) OR coalesce(exp(la) - 1 > {LEAST_RETURN}, false)), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), leads, {_r('sharpe', 'sharpe')}, {_r('CASE WHEN la > ln(0.1) THEN la END', 'la')}
          FROM (WITH {profit}, {GROUPS_SQL}, {NET_SQL}, {blocks}, gm AS (SELECT grp, avg(ret) AS m FROM net GROUP BY grp)
            SELECT (SELECT max(m) FILTER (WHERE grp = {GROUPS}) > max(m) FILTER (WHERE grp < {GROUPS}) FROM gm) AS leads, (SELECT median(s) FROM (SELECT avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252) AS s FROM bl GROUP BY block)) AS sharpe,
              (SELECT ln(product(1 + ret)) * 252.0::DOUBLE / (SELECT count(DISTINCT t) FROM net) FROM net WHERE grp = {GROUPS}) AS la)"""
    usual = "round((c - o) / ((h - l) + 0.001), 9) AS factor"
    return " UNION ALL ".join(f"SELECT '{name}' AS name, * FROM ({one.replace(usual, f'{x} AS factor')})" for name, (_, x) in list(FOUR.items())[:2])


def _sample(spark, d) -> tuple[DataFrame, DataFrame]:
    """The whole rows, with trades, and the sample of them."""
    rows = research.with_trades(evaluated(spark, d))
    return rows, labels.sample_window(rows, FIRST, LAST, 1)


def _held(spark, d):
    out = research.holdings(_sample(spark, d)[1], GROUPS)
    return out.select("t", "code", "position", "factor_rank", "entry_day", r6(F.col("entry_open"), "entry_open"), "exit_day", r6(F.col("exit_open"), "exit_open"), "entry_st", "entry_delisting", r6(F.col("fwd"), "fwd"))


def _held_sql() -> str:
    kept = f"day BETWEEN DATE '{FIRST}' AND (SELECT day FROM cal WHERE day <= DATE '{LAST}' ORDER BY day DESC LIMIT 1 OFFSET 2)"
    return f"""WITH {EVAL_SQL.replace('WHERE factor IS NOT NULL AND fwd IS NOT NULL', f'WHERE factor IS NOT NULL AND fwd IS NOT NULL AND {kept}')}, {GROUPS_SQL},
        h AS (SELECT t, code, lead(day, 1) OVER a AS entry_day, lead(o, 1) OVER a AS entry_open, lead(day, 2) OVER a AS exit_day, lead(o, 2) OVER a AS exit_open, coalesce(lead(st) OVER a, false) AS entry_st, coalesce(lead(delisting) OVER a, false) AS entry_delisting FROM f WINDOW a AS (PARTITION BY code ORDER BY t))
        SELECT t, code, CAST(row_number() OVER (PARTITION BY t ORDER BY factor DESC, code DESC) AS INTEGER) AS position, CAST(rn AS INTEGER) AS factor_rank, entry_day, {_r('entry_open', 'entry_open')}, exit_day, {_r('exit_open', 'exit_open')}, entry_st, entry_delisting, {_r('fwd', 'fwd')} FROM (SELECT * FROM q WHERE grp = {GROUPS}) JOIN h USING (t, code)"""


def _horizons(spark, d):
    rows, sample = _sample(spark, d)
    out = ev.horizon_decay(sample, 1, 3, ev.opens_for(rows, sample, 1))
    return out.select("horizon", r6(F.col("mean_ic"), "mean_ic"), "n_days")


def _horizons_sql() -> str:
    return f"""WITH {EVAL_SQL}, hz AS (SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS horizon), lim AS (SELECT min(t) AS t0, max(t) AS t1 FROM cal WHERE day BETWEEN DATE '{FIRST}' AND DATE '{LAST}'),
        s AS (SELECT a.t, a.code, horizon, a.factor, round(b.o / x.o - 1, 9) AS fwd FROM f a JOIN lim ON a.t BETWEEN t0 AND t1 - 4 JOIN hz ON true JOIN f x ON x.code = a.code AND x.t = a.t + 1 JOIN f b ON b.code = a.code AND b.t = a.t + 1 + horizon WHERE a.factor IS NOT NULL AND x.o <> 0 AND b.o IS NOT NULL),
        r AS (SELECT horizon, t, rank() OVER (PARTITION BY horizon, t ORDER BY factor) + (count(*) OVER (PARTITION BY horizon, t, factor) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY horizon, t ORDER BY fwd) + (count(*) OVER (PARTITION BY horizon, t, fwd) - 1) / 2.0::DOUBLE AS b FROM s),
        i AS (SELECT horizon, t, corr(a, b) AS ic FROM r GROUP BY horizon, t HAVING count(*) >= 3 AND max(a) > min(a) AND max(b) > min(b)),
        k AS (SELECT *, count(*) OVER (PARTITION BY t) AS k FROM i) SELECT horizon, {_r('avg(ic)', 'mean_ic')}, count(*) AS n_days FROM k WHERE k = 3 GROUP BY horizon"""


def _gram(spark, d):
    return correlation.gram(correlation.exposures(weekly_panel(spark, d), MATRIX), list(MATRIX)).select("f1", "f2", "n", r6(F.col("rho"), "rho"))


def _spans(spark, d) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return orders.select(F.col("o_custkey").alias("code"), F.col("o_orderkey").alias("span"), F.col("o_orderdate").cast("date").alias("start"), F.expr("date_add(cast(o_orderdate as date), cast(o_orderkey % 400 - 20 as int))").alias("stop"))


def _interval_join(spark, d):
    """How many spans of its customer hold each order's day, and the largest of them."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("code"), F.col("o_orderkey").alias("point"), F.col("o_orderdate").cast("date").alias("day"))
    found = intervals.interval_join(orders, _spans(spark, d), "day", "start", "stop", ["code"])
    return found.groupBy("point").agg(F.count(F.lit(1)).alias("n"), F.max("span").alias("last_span"))


def _increments(spark, d):
    """Prices in four increments that are written once each, read on the newest base."""
    rows = weekly_panel(spark, d).where("c is not null").select("day", "code", "o", "h", "l", "c", "vol", "amt").persist()
    first = W.partitionBy("code").orderBy("day")
    store, edges = maintenance.RebasedPrices(spark, scratch.folder(spark, "rebased")), ["1900-01-01", "1995-07-03", "1997-01-06", "1999-06-07", "2900-01-01"]
    for lo, hi in zip(edges, edges[1:]):
        part = rows.where((F.col("day") >= F.lit(lo).cast("date")) & (F.col("day") < F.lit(hi).cast("date")))
        part = part.withColumn("pre_close", F.when(F.row_number().over(first) == 1, F.col("o") * 1.1)).withColumn("adj", F.lit(1.0)).withColumn("suspended", F.col("vol") < 5)
        store.add(part)
    return store.scan().select("day", "code", *[r6(F.ln(c), c) for c in ("o", "c", "vwap")])


def _increments_sql() -> str:
    """Steps one after the other: each increment moves all rows before it by its first price over the last price so far."""
    parts = [f"WITH {PANEL_SQL}, x AS (SELECT day, code, o, h, l, c, vol, CASE WHEN day < DATE '1995-07-03' THEN 0 WHEN day < DATE '1997-01-06' THEN 1 WHEN day < DATE '1999-06-07' THEN 2 ELSE 3 END AS inc FROM panel WHERE c IS NOT NULL), m0 AS (SELECT day, code, inc, CASE WHEN vol >= 5 THEN o END AS o, CASE WHEN vol >= 5 THEN h END AS h, CASE WHEN vol >= 5 THEN l END AS l, CASE WHEN vol >= 5 THEN c END AS c FROM x)"]
    for k in (1, 2, 3):
        parts.append(f"k{k} AS (SELECT code, pre / last AS k FROM (SELECT code, arg_max(c, day) AS last FROM m{k - 1} WHERE inc < {k} AND c IS NOT NULL GROUP BY code) JOIN (SELECT code, arg_min(o, day) * 1.1 AS pre FROM x WHERE inc = {k} GROUP BY code) USING (code) WHERE last <> 0 AND pre > 0)")
        parts.append(f"m{k} AS (SELECT day, code, inc, o * f AS o, h * f AS h, l * f AS l, c * f AS c FROM (SELECT m{k - 1}.*, CASE WHEN inc < {k} THEN coalesce(k, 1) ELSE 1 END AS f FROM m{k - 1} LEFT JOIN k{k} USING (code)))")
    return ", ".join(parts) + f" SELECT day, code, {_r('ln(o)', 'o')}, {_r('ln(c)', 'c')}, {_r('ln((h + l) / 2)', 'vwap')} FROM m3"


def _gate_table(spark, d):
    """Each customer's numbers against conditions, all of which must hold."""
    orders = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_custkey").alias("factor")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("o_totalprice").alias("price"), F.max(F.when(F.col("o_orderstatus") == "P", 1.0)).alias("open"))
    conditions = [{"metric": "n", "op": "gte", "value": 5}, {"metric": "price", "op": "between", "value": 100000, "upper": 200000}, {"metric": "open", "op": "gt", "value": 0}]
    return research.gate_columns(orders, conditions).select("factor", "passed_n", "passed_price", "passed_open", "passed")


def _admitted(spark, d):
    """Which of the candidates a library takes in, in order: those too like a member are refused."""
    panel = weekly_panel(spark, d).persist()
    kept: dict[str, str] = {}
    library, rows = research.Library(0.9), []
    for name, text in (("gap", "c - o"), ("same", "2 * (c - o)"), ("volume", "vol"), ("rank", "c - o + vol / 1000"), ("range", "h - l")):
        pairs = [tuple(sorted((name, k))) for k in kept]
        found = correlation.pearson(correlation.exposures(panel, kept | {name: text}), pairs).collect() if pairs else []
        ok, clash = library.admit(name, text, {(r.f2 if r.f1 == name else r.f1): r.rho for r in found})
        kept |= {name: text} if ok else {}
        rows.append((name, ok, ",".join(clash)))
    return spark.createDataFrame(rows, "name string, admitted boolean, clashes string")


def _admitted_sql() -> str:
    e = {"gap": "c - o", "same": "2 * (c - o)", "volume": "vol", "rank": "c - o + vol / 1000", "range": "h - l"}
    near = lambda a, b: f"(SELECT abs(corr({e[a]}, {e[b]})) >= 0.9 FROM panel)"
    return f"""WITH {PANEL_SQL}, m AS (SELECT {near('gap', 'same')} AS a, {near('gap', 'volume')} AS b, {near('gap', 'rank')} AS c, {near('volume', 'rank')} AS d, {near('gap', 'range')} AS e, {near('volume', 'range')} AS f, {near('rank', 'range')} AS g)
        SELECT 'gap' AS name, true AS admitted, '' AS clashes UNION ALL SELECT 'same', NOT a, CASE WHEN a THEN 'gap' ELSE '' END FROM m UNION ALL SELECT 'volume', NOT b, CASE WHEN b THEN 'gap' ELSE '' END FROM m
        UNION ALL SELECT 'rank', NOT (c OR d), concat_ws(',', CASE WHEN c THEN 'gap' END, CASE WHEN d AND NOT b THEN 'volume' END) FROM m
        UNION ALL SELECT 'range', NOT (e OR (f AND NOT b) OR (g AND NOT (c OR d))), concat_ws(',', CASE WHEN e THEN 'gap' END, CASE WHEN g AND NOT (c OR d) THEN 'rank' END, CASE WHEN f AND NOT b THEN 'volume' END) FROM m"""


def _long(text: str) -> q.Query:
    return lambda spark, d: factor(weekly_panel(spark, d), text).select("t", "code", r6(F.col("factor"), "v"))


W60 = "(PARTITION BY code ORDER BY t ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"


def queries() -> dict[str, q.Query]:
    return {
        "population_ic": _population,
        "newey_west_factors": _newey_west,
        "ic_trend_factors": _trends,
        "standard_gates": _gates,
        "holding_audit_window": _held,
        "ic_horizon_decay_window": _horizons,
        "factor_correlation_tiles": _gram,
        "interval_join": _interval_join,
        "rebased_increments": _increments,
        "metric_gate": _gate_table,
        "factor_admission": _admitted,
        "ts_median_long": _long("ts_median(c, 60)"),
        "ts_rank_long": _long("ts_rank(vol, 60)"),
    }


def oracle_sql() -> dict[str, str]:
    base = q.oracle_sql()
    long = lambda x: f"WITH {PANEL_SQL} SELECT t, code, {_r(f'CAST({x} AS DOUBLE)', 'v')} FROM panel WINDOW w AS {W60}"
    return {
        "population_ic": _population_sql(),
        "newey_west_factors": _retargeted(base["newey_west_ic_significance"], "lag, mean, se, t, p"),
        "ic_trend_factors": _retargeted(base["ic_trend_filter"], "t, kalman, low_pass, fourier"),
        "standard_gates": _gates_sql(),
        "holding_audit_window": _held_sql(),
        "ic_horizon_decay_window": _horizons_sql(),
        "factor_correlation_tiles": base["factor_correlation"],
        "interval_join": """WITH p AS (SELECT o_custkey AS code, o_orderkey AS point, CAST(o_orderdate AS DATE) AS day FROM orders), s AS (SELECT o_custkey AS code, o_orderkey AS span, CAST(o_orderdate AS DATE) AS start, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 - 20 AS INTEGER) AS stop FROM orders)
            SELECT point, count(*) AS n, max(span) AS last_span FROM p JOIN s ON p.code = s.code AND day BETWEEN start AND stop GROUP BY point""",
        "rebased_increments": _increments_sql(),
        "metric_gate": """WITH k AS (SELECT o_custkey AS factor, count(*) AS n, avg(o_totalprice) AS price, bool_or(o_orderstatus = 'P') AS open FROM orders GROUP BY 1)
            SELECT factor, n >= 5 AS passed_n, price BETWEEN 100000 AND 200000 AS passed_price, open AS passed_open, n >= 5 AND price BETWEEN 100000 AND 200000 AND open AS passed FROM k""",
        "factor_admission": _admitted_sql(),
        "ts_median_long": long("CASE WHEN count(c) OVER w >= 30 THEN median(c) OVER w END"),
        "ts_rank_long": long("CASE WHEN vol IS NOT NULL AND count(vol) OVER w >= 30 THEN (len(list_filter(list(vol) FILTER (WHERE vol IS NOT NULL) OVER w, lambda v: v < vol)) + (len(list_filter(list(vol) FILTER (WHERE vol IS NOT NULL) OVER w, lambda v: v = vol)) + 1) / 2.0::DOUBLE) / count(vol) OVER w END"),
    }
