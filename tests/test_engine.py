"""The expression language and the operators against plain Python and pandas."""

import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import texts
from quillon.operators import correlation, cycles, labels, maintenance, models, pipeline, research, search, transforms
from quillon.operators import evaluation as ev
from quillon.plans.expression import ExpressionError, canonical, factor, operators_of, parse, symbols_of
from quillon.sources import panel as source
from quillon.sources import store

T, CODES = 40, ["plain", "lead", "inner", "none", "sparse", "infs", "ties", "zeros", "flat", "rise"]
INF = float("inf")


def adversarial(seed=7):
    rng = np.random.RandomState(seed)
    x = pd.DataFrame(rng.randn(T, len(CODES)), columns=CODES)
    x.loc[:8, "lead"] = np.nan
    x.loc[15:22, "inner"] = np.nan
    x["none"] = np.nan
    x.loc[rng.rand(T) < 0.7, "sparse"] = np.nan
    x.loc[[5, 20], "infs"] = [INF, -INF]
    x["ties"] = rng.randint(0, 3, T)
    x["zeros"] = np.where(rng.rand(T) < 0.3, 0.0, x["zeros"])
    x["flat"] = 2.0
    x["rise"] = np.arange(T, dtype=float)
    return x


@pytest.fixture(scope="module")
def wide():
    return adversarial(), adversarial(11)


@pytest.fixture(scope="module")
def panel(spark, wide):
    c, o = wide
    rows = [(t, code, *(None if math.isnan(v) else float(v) for v in (c[code][t], o[code][t]))) for code in CODES for t in range(T)]
    return spark.createDataFrame(rows, "t int, code string, c double, o double").withColumn("st", F.col("t") % 7 == 0).cache()


def result(panel, text, name="factor"):
    got = factor(panel, text).select("t", "code", name).toPandas()
    return got.pivot(index="t", columns="code", values=name).reindex(columns=CODES).astype(float)


def same(got, expected):
    e = expected.replace([INF, -INF], np.nan).astype(float)
    assert (got.isna().to_numpy() == e.isna().to_numpy()).all(), got.isna().sum() - e.isna().sum()
    assert np.nanmax(np.abs(got.to_numpy() - e.to_numpy()), initial=0) < 1e-9


@pytest.mark.parametrize("w", [1, 2, 3, 5, 20, 41])
def test_rolling(panel, wide, w):
    c, o = (x.replace([INF, -INF], np.nan) for x in wide)
    least = max(1, w // 2)
    roll = c.rolling(w, min_periods=least)
    for name, expected in {"mean": roll.mean(), "std": roll.std(ddof=0), "sum": roll.sum(), "min": roll.min(), "max": roll.max(), "median": roll.median(), "rank": roll.rank(pct=True)}.items():
        same(result(panel, f"ts_{name}(c, {w})"), expected if name != "rank" else expected.where(c.notna()))

    def each(f):
        out = pd.DataFrame(np.nan, index=c.index, columns=CODES)
        for code in CODES:
            for t in range(T):
                out.loc[t, code] = f(c[code].to_numpy()[max(0, t - w + 1) : t + 1])
        return out

    enough = lambda v: np.isfinite(v).sum() >= least
    same(result(panel, f"ts_product(c, {w})"), each(lambda v: np.prod(v) if np.isfinite(v).all() and enough(v) else np.nan))
    same(result(panel, f"ts_argmax(c, {w})"), each(lambda v: np.nanargmax(v) + 1 if enough(v) else np.nan))
    same(result(panel, f"ts_argmin(c, {w})"), each(lambda v: np.nanargmin(v) + 1 if enough(v) else np.nan))
    weighted = lambda v, k: np.nansum(v * k) / k[np.isfinite(v)].sum()
    same(result(panel, f"decay_linear(c, {w})"), each(lambda v: weighted(v, np.arange(1, len(v) + 1)) if enough(v) else np.nan))
    if w > 1:
        same(result(panel, f"ts_linear_reg_slope(c, {w})"), each(lambda v: np.polyfit(np.flatnonzero(np.isfinite(v)), v[np.isfinite(v)], 1)[0] if np.isfinite(v).sum() >= max(2, w // 2) else np.nan))
        x, y = c.where(o.notna()), o.where(c.notna())
        least2 = max(2, w // 2)
        cov = (x * y).rolling(w, min_periods=least2).mean() - x.rolling(w, min_periods=least2).mean() * y.rolling(w, min_periods=least2).mean()
        same(result(panel, f"ts_cov(c, o, {w})"), cov)


def test_count_sums_states_and_sma(panel, wide):
    raw, o = wide
    c = raw.replace([INF, -INF], np.nan)
    flag = (raw > o).astype(float)
    same(result(panel, "ts_count(c > o, 5)"), flag.rolling(5, min_periods=2).sum())
    same(result(panel, "ts_sma(c, 5, 2)"), c.ewm(alpha=0.4, adjust=False).mean())
    state = pd.DataFrame(index=raw.index, columns=CODES, dtype=float)
    for code in CODES:
        s = 1.0
        for t, v in enumerate(raw[code]):
            s = np.nan if np.isnan(v) or np.isnan(s) else s * (v - 1) if v > 1 else s
            state.loc[t, code] = s
    same(result(panel, "ts_accumulate_positive_return(c)"), state)


def test_shifts_keep_infinity_inside(panel, wide):
    raw, _ = wide
    same(result(panel, "where(delay(c, 1) > 1000, 1, 0)"), (raw.shift(1) > 1000).astype(float))
    same(result(panel, "delta(c, 2)"), raw - raw.shift(2))


def test_days(panel, wide):
    raw, _ = wide
    same(result(panel, "rank_cs(c)"), raw.rank(axis=1, pct=True))
    clean = raw.drop(columns="infs")
    sub = panel.where("code <> 'infs'")
    q = lambda p: clean.quantile(p, axis=1)
    got = factor(sub, "winsorize_cs(c, 0.1, 0.9)").select("t", "code", "factor").toPandas().pivot(index="t", columns="code", values="factor").reindex(columns=clean.columns)
    expected = clean.clip(q(0.1), q(0.9), axis=0)
    assert np.nanmax(np.abs(got.to_numpy(float) - expected.to_numpy())) < 1e-9 and (got.isna().to_numpy() == expected.isna().to_numpy()).all()


def test_elementwise_rules(spark):
    rows = spark.createDataFrame([(0, "a", 1.0, 0.0), (0, "b", -1.0, 0.0), (0, "c", 0.0, 0.0), (0, "d", None, 2.0), (0, "e", -7.0, 2.0), (0, "f", 0.0, 3.0)], "t int, code string, c double, o double").withColumn("st", F.lit(False))

    def values(text):
        return {r.code: r.factor for r in factor(rows, text).collect()}

    assert values("where(c / o > 1000, 1, 0)") == {"a": 1, "b": 0, "c": 0, "d": 0, "e": 0, "f": 0}
    assert values("c / o") == {"a": None, "b": None, "c": None, "d": None, "e": -3.5, "f": 0}
    assert values("(c != o) * 1")["d"] == 1 and values("(c < o) * -1")["d"] == 0
    assert values("c % o")["e"] == 1.0 and values("c % o")["a"] is None and values("c // o")["e"] == -4
    assert values("sqrt(c)")["b"] is None and values("where(log(c) < -1000, 1, 0)")["c"] == 1 and values("c ** 0.5")["b"] is None
    assert values("elementwise_max(c, o)")["d"] is None and values("where(c, 1, 0)")["d"] == 1
    assert values("np.maximum(c, o) + (~(st == 1)) * 1")["a"] == 2


def test_language_is_closed():
    for bad in ("c.abs()", "__import__('os')", "np.load(c)", "c and o", "1 < c < 2", "[c]", "lambda: c", "foo(c)", "'a'", "industry", "ts_mean(*c)", "f(**c)", "x"):
        with pytest.raises(ExpressionError):
            parse(bad)
    assert symbols_of("rank_cs(c) + ts_mean(vol, 5)") == ["c", "vol"] and operators_of("rank_cs(np.log(c))") == ["np.log", "rank_cs"]
    assert canonical("o + c * 1") == canonical("(c + o) + 0") and canonical("rank_cs(rank_cs(c))") == "rank_cs(c)" and canonical("c / c") == "c / c" and canonical("--c") == "c"


def test_compile_errors(panel):
    for bad in ("1 + 2", "ts_mean(c, 0)", "(c > o) - (o > c)", "c & o", "winsorize_cs(c, 0.9, 0.1)", "ts_mean(c)", "1 / 0 * c"):
        with pytest.raises(ExpressionError):
            factor(panel, bad)
    with pytest.raises(ExpressionError):
        factor(panel, "c", decay=True)


def test_causal_functions_do_not_look_ahead(panel):
    texts = ["ts_count(c > o, 5)", "ts_linear_reg_slope(c, 5)", "ts_cum_sum(c)", "ts_accumulate_positive_return(c)", "ts_rank(ts_mean(c, 3), 5)", "rank_cs(ts_corr(c, o, 6))"]
    for text in texts:
        assert all(r.changed == 0 for r in research.prefix_truncation(panel, text, [9, 25]).collect())
        assert all(r.changed == 0 for r in research.future_perturbation(panel, text, [25]).collect())


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.RandomState(4)
    out = [(t, pd.Timestamp("2020-01-01").date() + pd.Timedelta(days=t), f"{k:06d}", float(rng.randint(0, 9)), float(0.01 * rng.randn()), float(np.exp(rng.randn() + 10)), str(k % 3)) for t in range(130) for k in range(24)]
    return spark.createDataFrame(out, "t int, day date, code string, factor double, fwd double, cap double, industry string").cache()


def test_rank_ic_and_quantiles(rows):
    p = rows.toPandas()
    got = {r.t: r.ic for r in ev.rank_ic(rows).collect()}
    for t, g in p.groupby("t"):
        assert abs(got[t] - g["factor"].rank().corr(g["fwd"].rank())) < 1e-12
    members = ev.quantile_members(rows, 5).toPandas()
    for t, g in members.groupby("t"):
        g = g.sort_values(["factor", "code"]).reset_index(drop=True)
        assert (g["grp"] == np.floor(np.arange(len(g)) * 5 / len(g)).astype(int) + 1).all()


def test_turnover_of_a_swap(spark):
    day = pd.Timestamp("2020-01-01").date()
    two = spark.createDataFrame([(0, day, "a", 1.0, 0.0), (0, day, "b", 2.0, 0.0), (1, day, "a", 2.0, 0.0), (1, day, "b", 1.0, 0.0)], "t int, day date, code string, factor double, fwd double")
    got = {(r.t, r.grp): r.cost for r in ev.net_returns(two, 2).collect()}
    assert {k: round(v, 8) for k, v in got.items()} == {(0, 1): 0.00125, (0, 2): 0.00125, (1, 1): 0.003, (1, 2): 0.003}


def test_neutralizers_match_least_squares(rows):
    got = transforms.industry_cap_neutralize(rows).toPandas().merge(rows.toPandas(), on=["t", "code"], suffixes=("", "_raw"))
    for _, g in got.groupby("t"):
        a = np.column_stack([np.log(g["cap"]), pd.get_dummies(g["industry"]).to_numpy(float)])
        r = g["factor_raw"] - a @ np.linalg.lstsq(a, g["factor_raw"], rcond=None)[0]
        assert np.abs(r - g["factor"]).max() < 1e-9
    got = transforms.cap_neutralize(rows).toPandas().merge(rows.toPandas(), on=["t", "code"], suffixes=("", "_raw"))
    for _, g in got.groupby("t"):
        a = np.column_stack([np.ones(len(g)), np.log(g["cap"])])
        assert np.abs(g["factor_raw"] - a @ np.linalg.lstsq(a, g["factor_raw"], rcond=None)[0] - g["factor"]).max() < 1e-9


def test_ridge_recovers_weights(spark, rows):
    made = rows.withColumn("a", F.randn(1)).withColumn("b", F.randn(2)).withColumn("fwd", 0.02 * F.col("a") - 0.01 * F.col("b")).cache()
    got = models.ridge(made, ["a", "b"], 1e-12)
    assert abs(got["weights"]["a"] - 0.02) < 1e-10 and abs(got["weights"]["b"] + 0.01) < 1e-10 and got["r2"] > 0.999999


def test_correlation_survives_large_scales(spark):
    rng = random.Random(1)
    data = [(f, t, "x", v * s) for t in range(50) for v in [rng.gauss(0, 1)] for f, s in (("a", 1e300), ("b", -3e-300), ("c", 1.0))]
    wide = correlation.as_wide(spark.createDataFrame(data, "factor_id string, t int, code string, x double"), ["a", "b", "c"]).withColumn("flat", F.lit(2.0))
    got = {(r.f1, r.f2): r.rho for r in correlation.matrix(wide, ["a", "b", "c", "flat"]).collect()}
    assert abs(got[("a", "b")] + 1) < 1e-9 and abs(got[("a", "c")] - 1) < 1e-9 and got[("a", "flat")] is None
    assert correlation.block_matrix(wide, ["a", "b", "c"], 60).count() == 0 and correlation.block_matrix(wide, ["a", "b", "c"], 25).count() == 6


def test_many_pairs_go_in_several_passes(spark, monkeypatch):
    rng = np.random.RandomState(3)
    x = rng.randn(200, 5)
    wide = spark.createDataFrame([(int(t), "x", *map(float, v)) for t, v in enumerate(x)], "t int, code string, a double, b double, c double, d double, e double")
    monkeypatch.setattr(correlation, "PAIRS_AT_ONCE", 3)
    got = {(r.f1, r.f2): r.rho for r in correlation.matrix(wide, list("abcde")).collect()}
    assert len(got) == 10 and all(abs(got[(a, b)] - np.corrcoef(x[:, ord(a) - 97], x[:, ord(b) - 97])[0, 1]) < 1e-12 for a, b in got)
    some = correlation.matrix(wide, ["a", "b"])
    assert {(r.f1, r.f2): round(r.rho, 12) for r in correlation.with_row(some, wide, ["a", "b", "c"], "c").collect()} == {k: round(v, 12) for k, v in got.items() if set(k) <= set("abc")}


def test_a_stored_library_admits_once_and_knows_when_its_matrix_is_old(spark, tmp_path):
    rng = np.random.RandomState(2)
    rows = spark.createDataFrame([(t, f"{k:06d}", *map(float, rng.randn(3))) for t in range(30) for k in range(8)], "t int, code string, c double, o double, vol double")
    files = {s: str(tmp_path / s) for s in ("c", "o", "vol")}
    for s in files:
        rows.select("t", "code", F.col(s).alias("values")).write.parquet(files[s])
    library = correlation.StoredLibrary(spark, str(tmp_path / "library"))
    assert library.admit("a", "c", rows, files) == correlation.Admission(True, False)
    assert library.admit("b", "o", rows, files, notes="x").admitted and library.valid(files)
    assert library.admit("b", "o", rows, files) == correlation.Admission(False, True)
    close = library.admit("near", "c + o * 0.01", rows, files)
    assert not close.admitted and close.violations[0][0] == "a" and set(library.factors()) == {"a", "b"}
    for bad in (("b", "c"), ("", "c"), ("flat", "c * 0"), ("x", "foo(c)")):
        with pytest.raises(ValueError):
            library.admit(*bad, rows, files)
    assert [r["number"] for r in library.registry.get()["factors"]] == [1, 2]
    rows.select("t", "code", F.col("o").alias("values")).write.mode("overwrite").parquet(files["o"])
    assert not library.valid(files) and library.matrix(rows, files).count() == 1 and library.valid(files)


def test_models_check_their_parameters_and_write_what_they_fit(spark):
    assert models.parameters_of(None) == {"ridge_alpha": 1e-6, "winsor_lower_quantile": 0.01, "winsor_upper_quantile": 0.99}
    for bad in (("nothing", {}), ("rank_ridge", {"winsor_lower_quantile": 0.1}), ("rank_ridge", {"ridge_alpha": -1}), ("rank_ridge", {"ridge_alpha": "x"}), (None, {"winsor_upper_quantile": 0.5})):
        with pytest.raises(ValueError):
            models.parameters_of(*bad)
    for weights in ({"a": 0.0}, {"a": math.inf}, {"b": 1.0}, {}):
        with pytest.raises(ValueError):
            models.blend("rank_ridge", {"a": "c"}, weights)
    rng = np.random.RandomState(8)
    skill = rng.randn(80, 12)
    price = np.exp(np.cumsum(0.01 * np.vstack([np.zeros((2, 12)), skill[:-2]]), axis=0))
    start = pd.Timestamp("2020-01-01").date()
    panel = spark.createDataFrame([(t, start + pd.Timedelta(days=t), f"{k:06d}", float(skill[t, k]), float(price[t, k]), float(rng.randn())) for t in range(80) for k in range(12)], "t int, day date, code string, c double, o double, vol double").cache()
    for name in ("rank_ridge", None):
        got = models.train(panel, {"skill": "c", "noise": "vol"}, name, first="2020-01-05", last="2020-03-01")
        assert got["weights"]["skill"] > 20 * abs(got["weights"]["noise"]) and got["r2"] > 0.8 and got["days"] == 55
        value = {(r.t, r.code): r.factor for r in factor(panel, got["expression"]).collect()}
        assert sum(value[(t, c)] is not None for t in range(80) for c in ("000001", "000005")) == 160
    with pytest.raises(ValueError):
        models.train(panel, {"a": "c"}, "manual_weights")


def test_gates_funnel_library_and_registry():
    assert research.gate({"x": 1.0, "y": None}, [{"metric": "x", "op": "gte", "value": 1}, {"metric": "y", "op": "lt", "value": 9}])[0] is False
    assert research.gate({"x": 1.0}, [{"metric": "x", "op": "between", "value": 0, "upper": 2}, {"metric": "z", "op": "gt", "value": 0}], "any")[0] is True
    assert research.ic_gate({"prefix_passed": True, "ic_mean": 0.1, "nw_p": 0.01}) and not research.ic_gate({"prefix_passed": 1, "ic_mean": 0.1, "nw_p": 0.01})
    assert research.profit_gate({"above_every_lower": True, "annualized": 0.4}) and not research.profit_gate({"above_every_lower": False, "annualized": 0.4})
    calls = []

    def run(name, stage):
        calls.append((name, stage))
        if name == "bad":
            raise RuntimeError("no executors left")
        if name == "worse":
            raise ValueError("no such factor")
        return {"changed": 0, "nw_p": 0.01 if name == "good" else 0.5}

    done = {}
    with pytest.raises(RuntimeError):
        research.funnel(["bad"], run)
    calls.clear()
    log = research.funnel(["good", "weak", "worse"], run, done)
    assert [x["factor"] for x in log if x["stage"] == "portfolio"] == ["good"] and len(calls) == len(done)
    research.funnel(["good"], run, done)
    assert len(calls) == len(done)
    library = research.Library()
    assert library.admit("a", "c", {})[0] and library.admit("b", "o", {"a": -0.8}) == (False, ["a"]) and library.admit("a", "c", {"a": 1.0})[0]
    assert library.replaces({"signature": 1, "sharpe_median": 2, "fitness": 1}, [{"signature": 1, "sharpe_median": 2, "fitness": 0.5}])
    batch = {"schema_version": 1, "factors": [{"number": 1, "factor_name": "f_1", "expression": "c - o", "required_symbols": ["o", "c"]}, {"number": 2, "factor_name": "f_2", "expression": "c", "required_symbols": ["c"]}]}
    factors = research.registry_batch(json.dumps(batch))
    assert [x["number"] for x in research.select_factors(factors, "f_2,1-1")] == [1, 2]
    with pytest.raises(ValueError):
        research.select_factors(factors, "7")


def test_methods_resolve_and_version(rows):
    assert pipeline.resolve(["rank_icir"]) == ["rank_ic", "rank_icir"]
    assert pipeline.resolve(["quantile_net_returns", "rolling_sharpe"]) == ["quantile_net_returns", "rolling_sharpe"]
    assert pipeline.resolve("default") == list(pipeline.DEFAULT) and len(pipeline.METHODS) == 22
    assert pipeline.resolve("holding_audit") == ["industry_market_cap_neutralize", "tradability_filter", "quantile_net_returns", "holding_audit"]
    # Net returns come after the plot that asked for gross ones, so plots are gross and what follows is net.
    assert pipeline.resolve(["quantile_plot", "fitness", "rolling_sharpe"]) == ["quantile_returns", "quantile_cumulative", "quantile_plot", "quantile_net_returns", "fitness", "rolling_sharpe"]
    with pytest.raises(ValueError):
        pipeline.run_methods(pipeline.State(rows, 5, 1), ["rank_icir"])
    with pytest.raises(ValueError):
        pipeline.resolve(["nothing"])
    pipeline.METHODS["loop_a"] = pipeline.Method(lambda s: None, ("loop_b",))
    pipeline.METHODS["loop_b"] = pipeline.Method(lambda s: None, ("loop_a",))
    try:
        with pytest.raises(ValueError, match="need each other"):
            pipeline.resolve(["loop_a"])
    finally:
        del pipeline.METHODS["loop_a"], pipeline.METHODS["loop_b"]
    twice = pipeline.run_methods(pipeline.State(rows, 5, 1), ["rank_ic", "market_cap_neutralize", "rank_ic", "rank_icir"])
    assert {"ic", "ic__2", "icir"} <= set(twice.outputs)
    state = pipeline.State(rows, 5, 1)
    for name in ("quantile_returns", "quantile_cumulative", "quantile_net_returns", "rolling_sharpe", "fitness", "rank_ic", "rank_icir", "newey_west_ic_significance"):
        pipeline.METHODS[name].run(state)
    assert {"group_returns", "group_returns__2", "cumulative", "sharpe_20", "newey_west"} <= set(state.outputs)
    assert state.latest("group_returns") is state.outputs["group_returns__2"]
    assert "cap" in pipeline.needed_columns("c - o", ["market_cap_neutralize", "rank_ic"])


def test_newey_west_of_many_series(spark):
    rng = np.random.RandomState(4)
    walk = np.cumsum(rng.randn(300)) / 10
    made = {"waves": [0.01 * math.sin(k / 3) + 0.02 for k in range(80)], "noise": list(0.01 + rng.randn(400)), "slow": list(walk), "three": [1.0, 2.0, 4.0], "two": [1.0, 2.0], "flat": [1.0] * 9}
    daily = spark.createDataFrame([(n, 3 * t, float(x)) for n, xs in made.items() for t, x in enumerate(xs)], "name string, t int, ic double")
    for horizon in (1, 60):
        got = {r.name: r for r in ev.newey_west(daily, ("name",), horizon).collect()}
        assert set(got) == {"waves", "noise", "slow", "three"}
        for name, r in got.items():
            x = np.array(made[name])
            n, d = len(x), x - x.mean()
            cov = [d[: n - k] @ d[k:] / n for k in range(n)]
            quiet = [abs(c / cov[0]) <= 2 / math.sqrt(n) for c in cov]
            lag = next((k - 1 for k in range(1, n - 2) if quiet[k] and quiet[k + 1] and quiet[k + 2]), n - 1)
            lag = min(max(lag, horizon - 1), n - 1)
            lrv = cov[0] + 2 * sum((1 - k / (lag + 1)) * cov[k] for k in range(1, lag + 1))
            assert (r.lag, r.n) == (lag, n) and abs(r.mean - x.mean()) < 1e-12 and abs(r.se - math.sqrt(max(lrv, 0) / n)) < 1e-9
            assert r.se == 0 or abs(r.p - math.erfc(abs(r.t) / math.sqrt(2))) < 1e-9
    assert got["slow"].lag > ev.LAGS_AT_FIRST


def test_trend_curves_of_many_series(spark):
    rng = np.random.RandomState(1)
    made = {"long": rng.randn(333), "short": rng.randn(40), "flat": np.full(50, 0.3), "four": rng.randn(4), "three": rng.randn(3)}
    day = pd.Timestamp("2020-01-01").date()
    daily = spark.createDataFrame([(n, t, day + pd.Timedelta(days=t), float(x)) for n, xs in made.items() for t, x in enumerate(xs)], "name string, t int, day date, ic double")
    got = ev.trend_table(daily, ("name",)).toPandas().sort_values("t")
    assert set(got["name"]) == {"long", "short", "flat", "four"}
    for name, rows in got.groupby("name"):
        y, n = made[name], len(made[name])
        p = (0.01 + math.sqrt(0.0001 + 0.04)) / 2
        level, kalman, low, a = y[0], [], list(y[:3]), 2 / 31
        for i, v in enumerate(y):
            level += p / (p + 1) * (v - level)
            kalman.append(level)
            if i >= 3:
                low.append(2 * (1 - a) * low[-1] - (1 - a) ** 2 * low[-2] + (a - a * a / 4) * y[i - 1] + a * a / 2 * y[i - 2] - (a - 3 * a * a / 4) * y[i - 3])
        wave = np.fft.rfft(y)
        wave[np.fft.rfftfreq(n) > 1 / 31] = 0
        for c, want in (("kalman", kalman), ("low_pass", low), ("fourier", np.fft.irfft(wave, n))):
            assert np.abs(rows[c].to_numpy() - want).max() < 1e-9, (name, c)


def test_days_are_numbered_without_gaps(spark):
    day = lambda k: pd.Timestamp("2024-01-01").date() + pd.Timedelta(days=k)
    cells = spark.createDataFrame([(7 * k, day(k), "a", float(v)) for k, v in zip((0, 1, 4, 5, 6), (9, 1, 2, 3, 4))], "t int, day date, code string, c double")
    panel = source.densify(cells).cache()
    assert sorted(r.t for r in panel.collect()) == [0, 1, 2, 3, 4]
    value = lambda x: {r.t: r.factor for r in factor(panel, x).collect()}
    assert abs(value("decay_linear(c, 3)")[2] - (9 + 2 * 1 + 3 * 2) / 6) < 1e-12 and value("ts_argmax(c, 3)")[3] == 3.0 and value("ts_argmax(c, 3)")[2] == 1.0
    assert value("delay(c, 1)")[2] == 1.0


def test_horizons_match_single_labels(spark):
    rng = np.random.RandomState(5)
    rows = spark.createDataFrame([(t, pd.Timestamp("2020-01-01").date() + pd.Timedelta(days=t), f"{k:03d}", float(rng.randn()), float(np.exp(rng.randn()))) for t in range(40) for k in range(6)], "t int, day date, code string, factor double, o double").withColumn("o", F.when((F.col("t") != 20) | (F.col("code") != "001"), F.col("o"))).cache()
    got = {r.horizon: (r.mean_ic, r.n_days) for r in ev.horizon_decay(rows, 3, 6).collect()}
    p = rows.toPandas()
    o, f = p.pivot(index="t", columns="code", values="o"), p.pivot(index="t", columns="code", values="factor")
    ic = {h: pd.Series({t: f.loc[t].where((o.shift(-1 - h) / o.shift(-1)).loc[t].notna()).rank().corr((o.shift(-1 - h) / o.shift(-1)).loc[t].rank()) for t in range(40)}) for h in range(3, 7)}
    common = pd.DataFrame(ic).dropna().index
    assert {h: n for h, (_, n) in got.items()} == {h: len(common) for h in range(3, 7)}
    assert all(abs(got[h][0] - ic[h][common].mean()) < 1e-9 for h in ic)


def test_causality_checks_find_a_look_ahead(panel):
    ahead = lambda frame: frame.withColumn("factor", F.lead("c").over(W.partitionBy("code").orderBy("t")))
    at = research.checkpoints(factor(panel, "ts_mean(c, 3)"))
    assert len(at) == 4 and at[-1] == T - 1
    for check in (research.prefix_truncation, research.future_perturbation):
        found = {r.t: r.changed for r in check(panel.withColumn("c", F.when(F.abs("c") < 1e9, F.col("c"))), ahead, at).collect()}
        assert found[T - 1] == 0 and all(found[t] > 3 for t in at[1:-1])


def test_the_tradability_filter_sees_the_day_after_the_sample_wherever_it_stands(spark):
    day = lambda k: pd.Timestamp("2024-01-01").date() + pd.Timedelta(days=k)
    rows = [(t, day(t), f"{k:06d}", 10.0 + k, 10.0 + k, 1.0, 0.1, t == 5 and k == 0, False, float(k), str(k % 2)) for t in range(12) for k in range(6)]
    panel = spark.createDataFrame(rows, "t int, day date, code string, c double, o double, amt double, limit double, st boolean, delisting boolean, cap double, industry string").cache()
    for order in (["tradability_filter", "rank_ic"], ["rank_ic", "tradability_filter"]):
        state = pipeline.evaluate(panel, "c", order, 2, 1, last="2024-01-07")
        assert state.latest("tradability_summary")["n_blocked"] == 1 and state.latest("tradability_summary")["n_entry_special"] == 1
        assert state.rows.where("t = 4 and code = '000000' and factor is null").count() == 1 and state.rows.agg(F.max("t")).first()[0] == 4


def test_holdings_reconcile_or_are_refused(rows, tmp_path):
    full = rows.withColumns({"o": F.lit(1.0), "limit": F.lit(0.1), "st": F.lit(False), "delisting": F.lit(False)})
    held, net = research.holdings(full, 5), ev.net_returns(full, 5)
    summary = research.write_holdings(held, net, 5, str(tmp_path / "held"))
    assert summary.where("reconciles").count() == 130 and full.sparkSession.read.parquet(str(tmp_path / "held")).count() == held.count()
    with pytest.raises(ValueError):
        research.write_holdings(held, net.withColumn("cost", F.col("cost") + 1e-6), 5, str(tmp_path / "other"))


def test_batches_resume_and_keep_errors(spark, tmp_path):
    rng = np.random.RandomState(6)
    start = pd.Timestamp("2020-01-01").date()
    panel = spark.createDataFrame([(t, start + pd.Timedelta(days=t), f"{k:06d}", *map(float, np.exp(rng.randn(3)))) for t in range(70) for k in range(8)], "t int, day date, code string, c double, o double, cap double")
    log = str(tmp_path / "log.jsonl")
    first = pipeline.run_batch(spark, panel, {"a": "c", "flat": "c * 0"}, ["newey_west_ic_significance"], log=log)
    assert [r["status"] for r in first] == ["completed", "failed"] and "three values" in first[1]["error"]
    again = pipeline.run_batch(spark, panel, {"a": "c", "b": "o"}, ["newey_west_ic_significance"], log=log)
    assert again[0]["reused"] and "reused" not in again[1] and {r["factor"] for r in store.read_lines(spark, log)} == {"a", "b", "flat"}
    assert not pipeline.run_batch(spark, panel, {"a": "c"}, ["newey_west_ic_significance"], log=log, horizon=2)[0].get("reused")
    stages = pipeline.run_funnel(spark, panel, {"a": "c"}, str(tmp_path / "funnel"))
    assert stages[0]["stage"] == "causality" and stages[0]["passed"] and stages[1]["stage"] == "ic"


def test_frames_given_by_files_are_checked(spark, tmp_path):
    day = lambda k: pd.Timestamp("2024-01-01").date() + pd.Timedelta(days=k)
    long = spark.createDataFrame([("2024-01-01", " 1 ", " A "), ("2024-01-02", "2", " ")], "trade_date string, security_code string, industry_l1_code string")
    assert [(str(r.day), r.code, r.industry) for r in source.industry_cells(long).collect()] == [("2024-01-01", "000001", "A")]
    for bad in (long.union(long), long.withColumn("security_code", F.lit("x1"))):
        with pytest.raises(ValueError):
            source.industry_cells(bad)
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    for k in range(2):
        source.write_panel(table.where(f"k > {k}"), str(tmp_path / "t"))
        assert spark.read.parquet(str(tmp_path / "t")).count() == 2 - k
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
    maintenance.upsert_csv(table, str(tmp_path / "m.csv"), ["k"])
    maintenance.upsert_csv(spark.createDataFrame([(2, "z"), (3, "c")], "k int, v string"), str(tmp_path / "m.csv"), ["k"])
    assert sorted((r.k, r.v) for r in spark.read.csv(str(tmp_path / "m.csv"), header=True).collect()) == [("1", "a"), ("2", "z"), ("3", "c")]
    axes = spark.createDataFrame([(day(0), "000001"), (day(1), "000001")], "day date, code string")
    caps = lambda rows: maintenance.market_cap_cells(spark.createDataFrame(rows, "day date, code string, values double"), axes)
    assert sorted((r.day, r.cap) for r in caps([(day(0), "1", 2.0), (day(5), "1", 3.0)]).collect()) == [(day(0), 2.0), (day(1), None)]
    for bad in ([(day(0), "1", -1.0)], [(day(0), "1", math.inf)], [(day(0), "1", 1.0), (day(0), "000001", 1.0)]):
        with pytest.raises(ValueError):
            caps(bad)
    flags = lambda rows: maintenance.true_cells(spark.createDataFrame(rows, "day date, code string, st boolean"), "st", axes)
    assert flags([(day(0), "1", True)]).count() == 1
    for bad in ([(day(0), "1", False)], [(day(0), "1", None)], [(day(9), "1", True)], [(day(0), "2", True)], [(day(0), "1", True), (day(0), "1", True)]):
        with pytest.raises(ValueError):
            flags(bad)
    history = spark.createDataFrame([(day(0), "600001")], "day date, code string")
    market = spark.createDataFrame([(day(1), "600001", 10.5, 10.0, None), (day(1), "600002", 11.0, 10.0, None), (day(2), "600001", 11.0, 10.0, None)], "day date, code string, limit_up double, pre_close double, event int")
    plain = spark.createDataFrame([("600001", "Plain"), ("600002", "Other")], "code string, name string")
    assert sorted((r.day, r.code) for r in maintenance.repaired_tail(history, market, plain, "2026-07-06").collect()) == [(day(0), "600001"), (day(1), "600001")]
    with pytest.raises(ValueError):
        maintenance.repaired_tail(history, market, plain.withColumn("name", F.lit("*ST x")), "2026-07-06")
    old = spark.createDataFrame([(day(0), "a", 1.0, 2.0, 0.5, 2.0, 1.0, 1.0)], "day date, code string, o double, h double, l double, c double, vol double, amt double")
    new = old.withColumns({"day": F.lit(day(1)), "pre_close": F.lit(1.0), "adj": F.lit(1.0), "suspended": F.lit(False)})
    assert {(r.day, r.c) for r in maintenance.rebased_merge(old, new).collect()} == {(day(0), 1.0), (day(1), 2.0)}


def test_texts_and_days():
    import datetime

    assert texts.as_day("2024-03-01") == datetime.date(2024, 3, 1) == texts.as_day(datetime.datetime(2024, 3, 1, 5))
    assert texts.as_day("2024-03-01T20:00:00+00:00", "Asia/Shanghai") == datetime.date(2024, 3, 2)
    assert texts.normalized_tag(" \uff26\uff35\uff2c\uff2c Stra\u00dfe ") == "full strasse" and texts.normalized_tag(None) is None
    with pytest.raises(ValueError):
        texts.as_day(5)


def test_cycles_are_cut_to_the_days(spark):
    daily = spark.createDataFrame([("2018-01-02",), ("2025-06-30",)], "day string").withColumn("day", F.to_date("day"))
    got = sorted((str(r.start), str(r.stop), r.direction, r.provisional) for r in cycles.cycles_of(daily, cycles.cycle_table(spark)).collect())
    assert got == [("2018-01-02", "2018-10-18", "down", False), ("2018-10-18", "2021-12-13", "up", False), ("2021-12-13", "2024-02-05", "down", False), ("2024-02-05", "2025-06-30", "up", True)]


def test_maintenance(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert {(r.k, r.v) for r in maintenance.upsert(old, spark.createDataFrame([(2, "z"), (3, "c")], "k int, v string"), ["k"]).collect()} == {(1, "a"), (2, "z"), (3, "c")}
    assert maintenance.same_axes(old, old, "k") and not maintenance.same_axes(old, old.where("k = 1"), "k")
    with pytest.raises(ValueError):
        maintenance.unique_records(spark.createDataFrame([(1, 2.0), (1, 3.0)], "k int, v double"), ["k"], "v")
    assert maintenance.unique_records(spark.createDataFrame([(1, 2.0), (1, 2.0)], "k int, v double"), ["k"], "v").count() == 1
    frame = spark.createDataFrame([("600000", "2026-01-05", 10.5, 10.0, None), ("600001", "2026-01-05", 11.0, 10.0, None), ("300001", "2026-01-05", 10.5, 10.0, None), ("600002", "2026-01-05", 11.0, 10.0, 4)], "code string, day string, limit_up double, pre_close double, event int")
    got = {r.code: r.observed for r in maintenance.special_from_limits(frame.withColumn("day", F.to_date("day")), "2026-07-06").collect()}
    assert got == {"600000": True, "600001": False, "300001": None, "600002": True}


def test_sample_window_and_blocks(spark):
    rows = spark.createDataFrame([(t, pd.Timestamp("2020-01-01").date() + pd.Timedelta(days=t), "a", float(t)) for t in range(25)], "t int, day date, code string, ret double").withColumn("grp", F.lit(1))
    assert labels.sample_window(rows, "2020-01-05", "2020-01-12", 1).count() == 6
    assert labels.sample_window(rows).count() == 25
    for bad in (("2020-01-12", "2020-01-05"), ("2020-01-05", "2020-01-06"), ("2031-01-01", None)):
        with pytest.raises(ValueError):
            labels.sample_window(rows, *bad)
    cut = labels.blocks(rows, 10, ["grp"]).collect()
    assert len(cut) == 20 and {r.block for r in cut} == {0, 1}


def test_search_finds_a_planted_factor(spark):
    settings = search.Settings(size=20, generations=3, seed=3, fame=15, components=10, tournament=3)
    tree = search.grow(random.Random(1), 4)
    assert parse(tree.text()) is not None and tree.put((), tree) == tree
    quality = lambda texts: {t: (0.1 if "ts_mean" in t else 0.02) if "vol" in t else None for t in texts}
    fame = search.search(quality, settings)
    assert fame and fame == search.search(quality, settings) and all("vol" in x["expression"] for x in fame)
    assert [x["rank"] for x in fame] == sorted(x["rank"] for x in fame) and len(fame) <= 10
    rng = random.Random(5)
    for k in range(300):
        tree = search.mutate(rng, search.cross(rng, search.grow(rng, 4), search.grow(rng, 3)), sorted(search.CHANGES)[k % 9])
        parse(tree.text())
        assert search.Tree.read(json.loads(json.dumps(search.asdict(tree)))) == tree
    assert len(search.FUNCTIONS) == 25 and search.Tree("div", (search.Tree("c"), search.Tree("o"))).text() == "((c) / where(abs((o)) > 1e-6, (o), 1.0))"
    for bad in ({"size": 0}, {"fame": 200000}, {"components": 101}, {"changes": {"crossover": 0.5}}, {"tournament": 1001}, {"parsimony": -1}, {"mode": "x"}, {"first_depth": (5, 9)}):
        with pytest.raises(ValueError):
            search.Settings(**bad)


def test_fronts_ranks_and_spread():
    some = [{"expression": f"e{n}_{ic}", "nodes": n, "ic": ic} for n, ic in ((1, 0.1), (1, 0.05), (3, 0.1), (3, 0.2), (5, 0.15), (9, 0.3), (20, 0.31), (40, 0.32))]
    assert [x["nodes"] for x in search.front(some)] == [1, 3, 9, 20, 40]
    assert {x["nodes"] for x in search.spread(search.front(some), 3)} == {1, 9, 40}
    assert [x["rank"] for x in search.ranked(some, 8)] == [1] * 5 + [2] * 3


def test_a_campaign_goes_on_where_it_stopped(spark, rows, tmp_path):
    base = rows.select("t", "day", "code", "fwd", F.col("factor").alias("c"), F.col("cap").alias("o"))
    settings = search.Settings(size=12, generations=3, seed=2, fame=10, components=5, tournament=3)
    calls = []

    def quality(texts_):
        calls.append(len(texts_))
        return {t: 0.01 * len(t) if "c" in t else None for t in texts_}

    whole = search.Campaign(spark, str(tmp_path / "a"), settings).find(quality)
    stopped = search.Campaign(spark, str(tmp_path / "b"), settings)

    def until_second(texts_):
        if len(calls) >= 5:
            raise RuntimeError("executors lost")
        return quality(texts_)

    calls[:] = [0] * 3
    with pytest.raises(RuntimeError):
        stopped.find(until_second)
    assert store.read_json(spark, str(tmp_path / "b/checkpoint.json"))["run"]["generation"] == 2
    assert stopped.find(quality) == whole
    with pytest.raises(ValueError):
        search.Campaign(spark, str(tmp_path / "b"), search.replace(settings, seed=3)).find(quality)
    panel = base.drop("fwd")
    small = search.Campaign(spark, str(tmp_path / "c"), search.Settings(size=3, generations=1, seed=1, fame=2, components=1, tournament=1, least_days=10, first_depth=(1, 1)))
    got = small.run(panel.withColumns({c: F.col("c") for c in ("h", "l", "vol", "vwap")}), {"last": "2020-03-20"}, {"first": "2020-03-21"})
    assert len(got["found"]) <= 1 and got["passed"] == [] and all(x["status"] in ("completed", "failed") for x in got["tests"])
    store.claim(spark, str(tmp_path / "c/lock"))
    with pytest.raises(ValueError):
        small.run(panel, {}, {})


def test_population_is_scored_in_one_plan(spark, rows):
    base = rows.select("t", "day", "code", "fwd", F.col("factor").alias("c"), F.col("cap").alias("o"))
    got = {r.expr_id: r.mean_ic for r in search.population_ic(base, {0: "c", 1: "-1 * c"}).collect()}
    assert abs(got[0] + got[1]) < 1e-12
    scores = search.scorer(base, search.Settings(least_days=10))(["c", "ts_mean(c, 0)"])
    assert scores["c"]["ic"] is not None and scores["ts_mean(c, 0)"]["ic"] is None and "window" in scores["ts_mean(c, 0)"]["error"]


def test_preprocessing_matches_least_squares(spark, rows):
    made = rows.withColumns({c: F.randn(k) for k, c in enumerate(("s1", "s2"), 1)}).withColumn("s3", 2 * F.col("s1") - F.col("s2") + 1).withColumn("s4", F.lit(3.0)).cache()
    got = transforms.style_neutralize(made, ["s1", "s2", "s3", "s4"]).toPandas().merge(made.toPandas(), on=["t", "code"], suffixes=("", "_raw"))
    for _, g in got.groupby("t"):
        a = np.column_stack([np.ones(len(g)), g["s1"], g["s2"]])
        assert np.abs(g["factor_raw"] - a @ np.linalg.lstsq(a, g["factor_raw"], rcond=None)[0] - g["factor"]).max() < 1e-8
    with pytest.raises(ValueError):
        transforms.preprocess(rows, "other")
    assert transforms.preprocess(rows, "none") is rows
    days = transforms.cap_betas(rows).toPandas()
    assert len(days) == 130 and days["beta"].notna().all()


def test_streamed_cells_equal_batch(spark, tmp_path):
    from quillon.streaming.incremental import daily_cells

    rows = [((pd.Timestamp("2024-01-01") + pd.Timedelta(hours=7 * k)).to_pydatetime(), f"{k % 3:06d}", 1.0 + k, float(k % 5 + 1)) for k in range(60)]
    table = spark.createDataFrame(rows, "ts timestamp, code string, price double, quantity double")
    table.write.parquet(str(tmp_path / "in"))
    stream = daily_cells(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")))
    job = stream.writeStream.format("memory").queryName("cells").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    job.awaitTermination(120)
    assert sorted(map(tuple, spark.table("cells").collect())) == sorted(map(tuple, daily_cells(table).collect()))
