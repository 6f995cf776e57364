"""Shared plans, scans, sliding windows, tiles, interval joins and rebasing against plain versions; bounded samples."""

import datetime
import math
import random

import numpy as np
import pytest
from compare import connection, differences
from pyspark.sql import functions as F

from quillon import queries as engine
from quillon import studies
from quillon.functions import rolling, rules
from quillon.operators import correlation, intervals, maintenance, pipeline, research, search
from quillon.operators import evaluation as ev
from quillon.plans import expression
from quillon.sources import panel as panel_source
from quillon.sources.panel import weekly_panel

FOLDER = "/root/testdata/sf0.001"
DAY = datetime.date(2020, 1, 1)


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(studies.oracle_sql()))
def test_study_equals_its_sql(spark, con, name):
    assert differences(studies.queries()[name](spark, FOLDER), con, studies.oracle_sql()[name]) == []


def small_panel(spark, days=90, codes=7, seed=1):
    rng = np.random.RandomState(seed)
    some = lambda: float(rng.randint(0, 9)) if rng.rand() < 0.85 else None
    return spark.createDataFrame([(t, DAY + datetime.timedelta(days=t), f"{k:06d}", some(), some(), some()) for t in range(days) for k in range(codes)], "t int, day date, code string, c double, o double, vol double").cache()


def windows_in(frame) -> int:
    text = frame._jdf.queryExecution().optimizedPlan().toString()
    return text.count("windowspecdefinition")


def test_related_formulas_share_their_parts(spark):
    panel = small_panel(spark)
    parts = [f"ts_{f}({x}, {w})" for f in ("mean", "sum", "min", "max") for x in ("c", "vol") for w in (3, 5)]
    rng = random.Random(2)
    texts = {f"f{k}": f"{rng.choice(parts)} {rng.choice('+-*')} rank_cs({rng.choice(parts)})" for k in range(100)}
    distinct = {p for x in texts.values() for p in expression.cost_of(x)}
    alone = [windows_in(expression.factor(panel, x)) for x in list(texts.values())[:3]]
    shared = windows_in(expression.factors(panel, texts))
    # Each rolling part is a count and a value, each rank four windows; none is there twice.
    most = sum(4 if p.startswith("rank_cs") else 2 for p in distinct)
    assert len(distinct) < 40 and shared <= most and shared < 100 * min(alone) / 8
    got = expression.factors(panel, dict(list(texts.items())[:6])).toPandas().sort_values(["t", "code"])
    for name, x in list(texts.items())[:6]:
        want = expression.factor(panel, x).toPandas().sort_values(["t", "code"])["factor"].to_numpy(float)
        assert np.allclose(got[name].to_numpy(float), want, equal_nan=True)


def test_batches_hold_each_formula_once_within_their_cost():
    rng = random.Random(7)
    parts = [f"ts_{f}({x}, {w})" for f in ("mean", "rank") for x in ("c", "o", "vol") for w in range(2, 9)]
    texts = {k: f"{rng.choice(parts)} - {rng.choice(parts)}" for k in range(60)}
    cut = expression.batches(texts, 12)
    assert sorted(k for b in cut for k in b) == list(range(60)) and len(cut) > 3
    for b in cut:
        held = {}
        for k in b:
            held |= expression.cost_of(texts[k])
        assert sum(held.values()) <= 12 or len(b) == 1


def test_the_population_is_the_sum_of_its_formulas(spark):
    panel = small_panel(spark).withColumn("fwd", F.col("o") - F.col("vol"))
    texts = {0: "ts_mean(c, 3)", 1: "-1 * ts_mean(c, 3)", 2: "c * vol", 3: "vol * c", 4: "rank_cs(ts_mean(c, 3))"}
    got = {r.expr_id: r for r in search.evaluate_population(panel, texts, most=2).collect()}
    assert set(got) == set(texts) and abs(got[0].mean_ic + got[1].mean_ic) < 1e-12 and abs(got[2].mean_ic - got[3].mean_ic) < 1e-12 and abs(got[0].mean_ic - got[4].mean_ic) < 1e-12


def test_search_counts_and_breeds_the_signed_tree():
    tree = search.Tree("neg", (search.Tree("c"),))
    assert search.oriented(tree, -0.1) == search.Tree("c") and search.oriented(tree, 0.1) is tree and search.oriented(search.Tree("c"), -0.1) == tree
    fame = search.search(lambda texts: {t: -0.05 for t in texts}, search.Settings(size=10, generations=1, seed=1, fame=8, components=8, tournament=2))
    assert all(x["direction"] == -1 and x["nodes"] == pytest.approx(x["nodes"]) for x in fame) and any(x["expression"] == "-c" or not x["expression"].startswith("-") for x in fame)


def test_scan_equals_the_recursion(spark):
    rng = np.random.RandomState(3)
    rows = [(k, t, float(rng.uniform(-1, 1)), float(rng.randn())) for k, n in (("a", 1), ("b", 16), ("c", 17), ("d", 300), ("e", 600)) for t in range(n)]
    frame = spark.createDataFrame(rows, "code string, t int, a double, b double")
    got = {(r.code, r.t): r.y for r in rolling.affine_scan(frame, F.col("a"), F.col("b"), "y").collect()}
    last = {}
    for k, t, a, b in rows:
        last[k] = a * last.get(k, 0.0) + b
        assert abs(got[k, t] - last[k]) < 1e-9


@pytest.mark.parametrize("w", [1, 2, 5, 41])
def test_sliding_windows_equal_sorting_each(spark, w):
    panel = small_panel(spark, 120, 3, 5)
    frame = rolling.slide(rolling.slide(panel, "m", "ts_median", F.col("c"), w), "r", "ts_rank", F.col("c"), w).toPandas()
    assert list(frame.columns) == [*panel.columns, "m", "r"]
    for _, g in frame.sort_values("t").groupby("code"):
        c = g["c"].to_numpy(float)
        for i in range(len(c)):
            seen = c[max(0, i - w + 1) : i + 1]
            seen = seen[np.isfinite(seen)]
            enough = len(seen) >= max(1, w // 2)
            m, r = g["m"].iloc[i], g["r"].iloc[i]
            assert (math.isnan(m) and not enough) or abs(m - np.median(seen)) < 1e-12
            assert math.isnan(r) if not enough or not np.isfinite(c[i]) else abs(r - ((seen < c[i]).sum() + ((seen == c[i]).sum() + 1) / 2) / len(seen)) < 1e-12


def test_tiles_equal_pairs(spark, monkeypatch):
    rng = np.random.RandomState(4)
    x = rng.randn(400, 9) * 10.0 ** rng.randint(-3, 6, 9) + 10.0 ** rng.randint(0, 6, 9)
    x[rng.rand(*x.shape) < 0.3] = np.nan
    x[:, 7], x[2:, 8] = 5.0, np.nan
    names = [f"f{k}" for k in range(9)]
    wide = spark.createDataFrame([(t, t // 100, *(None if math.isnan(v) else float(v) for v in row)) for t, row in enumerate(x)], ", ".join(["t int", "block int", *(f"{n} double" for n in names)])).repartition(5).cache()
    monkeypatch.setattr(correlation, "TILE", 4)
    monkeypatch.setattr(correlation, "MERGED", 2)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    for by in ((), ("block",)):
        want = {tuple(r[c] for c in (*by, "f1", "f2")): (r.n, r.rho) for r in correlation.pearson(wide, pairs, by).collect()}
        got = {tuple(r[c] for c in (*by, "f1", "f2")): (r.n, r.rho) for r in correlation.gram(wide, names, *by).collect()}
        # Pairs without a common row are not listed by tiles.
        assert all(n == 0 and rho is None for k, (n, rho) in want.items() if k not in got) and set(got) <= set(want)
        for k, (n, rho) in got.items():
            assert n == want[k][0] and (rho is None) == (want[k][1] is None) and (rho is None or abs(rho - want[k][1]) < 1e-8), k


def test_interval_join_equals_comparing_all(spark):
    rng = random.Random(1)
    day = lambda k: DAY + datetime.timedelta(days=k)
    points = [(k, rng.choice("xyz"), day(rng.randint(-30, 3000))) for k in range(300)] + [(900, "x", None), (901, None, day(3))]
    spans = [(k, rng.choice("xyz"), day(a := rng.randint(-40, 3000)), day(a + rng.choice([-2, 0, 1, 2, 3, 7, 8, 100, 1023, 1024, 2900]))) for k in range(200)] + [(900, "x", None, day(5)), (901, "y", day(5), None)]
    p, s = spark.createDataFrame(points, "id int, code string, day date"), spark.createDataFrame(spans, "span int, code string, lo date, hi date")
    holds = lambda d, a, b: None not in (d, a, b) and a <= d <= b
    want = {(i, k) for i, c, d in points for k, e, a, b in spans if c == e and c is not None and holds(d, a, b)}
    got = [(r.id, r.span) for r in intervals.interval_join(p, s, "day", "lo", "hi", ["code"]).collect()]
    assert set(got) == want and len(got) == len(want)
    assert {r.id for r in intervals.interval_join(p, s, "day", "lo", "hi", ["code"], "left_anti").collect()} == {i for i, *_ in points} - {i for i, _ in want}
    assert {r.id for r in intervals.interval_join(p, s.limit(0), "day", "lo", "hi", how="left_semi").collect()} == set()
    with pytest.raises(ValueError):
        intervals.interval_join(p, s, "day", "lo", "hi", how="cross")


def test_interval_join_broadcasts_neither_side_by_the_size_of_a_file(spark, tmp_path):
    spark.range(2000).selectExpr("id as point", "id % 50 as code", "date_add(date'2024-01-01', cast(id % 90 as int)) as day").write.parquet(str(tmp_path / "p"))
    p = spark.read.parquet(str(tmp_path / "p"))
    s = p.select("code", F.col("point").alias("span"), F.col("day").alias("lo"), F.date_add("day", 9).alias("hi"))
    for how in ("inner", "left_anti"):
        plan = intervals.interval_join(p, s, "day", "lo", "hi", ["code"], how)._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    few = intervals.interval_join(F.broadcast(p), s, "day", "lo", "hi", ["code"])._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in few


def test_horizon_decay_in_small_pieces_equals_ranking_each_day(spark, monkeypatch):
    rng = np.random.RandomState(5)
    cells = [(t, f"{c:06d}", None if rng.rand() < 0.1 else float(rng.randint(6)), None if rng.rand() < 0.1 else float(rng.randint(12))) for t in range(3, 33) for c in range(40) if rng.rand() < 0.95]
    rows = spark.createDataFrame(cells, "t int, code string, factor double, o double")
    for name, value in (("SIGNALS_AT_ONCE", 4), ("HORIZONS_AT_ONCE", 3), ("CELLS_AT_ONCE", 60)):
        # Bounds of what a task holds, whatever the number of days and horizons.
        assert getattr(ev, name) > 0
        monkeypatch.setattr(ev, name, value)
    f, o, ics = {(t, c): x for t, c, x, _ in cells}, {(t, c): x for t, c, _, x in cells}, {}
    for t in range(3, 32 - 8 - 1 + 1):
        for h in range(2, 9):
            pairs = [(f[t, c], round(o[t + 1 + h, c] / o[t + 1, c] - 1, 9)) for c in {c for _, c in f} if None not in (f.get((t, c)), o.get((t + 1, c)), o.get((t + 1 + h, c))) and o[t + 1, c]]
            ranks = [[sum(y < v for y in x) + (sum(y == v for y in x) + 1) / 2 for v in x] for x in zip(*pairs)]
            ics[t, h] = np.corrcoef(*ranks)[0, 1]
    got = {r.horizon: (r.mean_ic, r.n_days) for r in ev.horizon_decay(rows, 2, 8).collect()}
    days = sorted({t for t, _ in ics if all(np.isfinite(ics[t, h]) for h in range(2, 9))})
    assert set(got) == set(range(2, 9)) and all(got[h][1] == len(days) and abs(got[h][0] - np.mean([ics[t, h] for t in days])) < 1e-9 for h in got)


def test_weekly_panel_deals_lines_once_and_by_size(spark, monkeypatch):
    from quillon.plans.expression import factor

    plan = factor(weekly_panel(spark, "/root/testdata/sf0.001"), "ts_mean(c, 5)")._jdf.queryExecution().executedPlan().toString()
    # From lines to windows over a code there is one exchange by code; cells are not joined.
    above = plan[: plan.index("Union")]
    assert above.count("Exchange") == 1 and "Join" not in above
    assert panel_source.tasks_for(spark, "/root/testdata/sf0.001/lineitem.parquet") == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(panel_source, "BYTES_A_TASK", 1000)
    assert panel_source.tasks_for(spark, "/root/testdata/sf0.001/lineitem.parquet") > 50


def test_weekly_panel_of_odd_lines_equals_its_sql(spark, tmp_path):
    con = connection("/root/testdata/sf0.001")
    for t in ("supplier", "nation"):
        con.sql(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    odd = "SELECT * REPLACE (CASE WHEN l_orderkey % 3 = 0 THEN NULL WHEN l_orderkey % 3 = 1 THEN 987654 ELSE l_suppkey END AS l_suppkey, CASE WHEN l_linenumber = 1 THEN 0 WHEN l_linenumber = 2 THEN NULL ELSE l_quantity END AS l_quantity, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_tax END AS l_tax, CASE WHEN l_linenumber = 4 THEN NULL ELSE l_extendedprice END AS l_extendedprice) FROM lineitem WHERE l_orderkey % 50 < 3"
    con.sql(f"COPY (SELECT * FROM lineitem WHERE l_orderkey % 50 >= 3 UNION ALL {odd}) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    frame = engine.queries()["panel_weekly"](spark, str(tmp_path))
    assert differences(frame, connection(str(tmp_path)), engine.oracle_sql()["panel_weekly"]) == []


def test_increments_equal_merging_and_leave_old_files_alone(spark, tmp_path):
    rng = random.Random(3)
    day = lambda k: DAY + datetime.timedelta(days=k)
    schema = "day date, code string, o double, h double, l double, c double, vol double, amt double, pre_close double, adj double, suspended boolean"
    parts = []
    for at in (0, 10, 20, 30):
        rows = [(day(t), code, *(rng.uniform(5, 15) for _ in range(4)), 1.0, 1.0, rng.uniform(5, 15) if t == at else None, 1.5 if code == "000001" else None, code == "000002" and t % 7 == 0) for t in range(at, at + 10) for code in ("000001", "000002", "000003") if not (code == "000003" and at == 20)]
        parts.append(spark.createDataFrame(rows, schema))
    kept = maintenance.RebasedPrices(spark, str(tmp_path / "prices"))
    merged, seen = None, {}
    for part in parts:
        kept.add(part)
        now = {f: f.stat().st_mtime_ns for f in (tmp_path / "prices").rglob("*.parquet")}
        assert all(now[f] == m for f, m in seen.items()) and len(now) > len(seen)
        seen = now
        first = part.drop("pre_close", "adj").withColumns({c: F.when(~F.col("suspended"), F.col(c)) for c in "ohlc"}).drop("suspended").withColumn("vwap", (F.col("h") + F.col("l")) / 2)
        merged = first if merged is None else maintenance.rebased_merge(merged.drop("vwap"), part)
    look = lambda f: {(r.day, r.code): tuple(r[c] for c in ("o", "h", "l", "c", "vwap")) for r in f.collect()}
    a, b = look(kept.scan()), look(merged)
    assert set(a) == set(b) and all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-9) for k in a for x, y in zip(a[k], b[k]))
    with pytest.raises(ValueError):
        kept.add(parts[1])


def test_bounded_samples_have_their_entries_exits_and_horizons(spark):
    panel = weekly_panel(spark, FOLDER)
    state = pipeline.evaluate(panel, "c - o", ["holding_audit"], n_groups=2, horizon=2, first="1996-01-01", last="1996-12-31", stored=True)
    held = state.latest("holdings").toPandas()
    assert len(held) and not held[["entry_day", "entry_open", "exit_day", "exit_open"]].isna().any().any()
    assert state.latest("holding_summary").where("not reconciles").count() == 0
    state.close()
    rows = pipeline.labels.forward_open_return(expression.factor(panel, "c - o"), 1)
    sample = pipeline.labels.sample_window(rows, "1996-01-01", "1996-12-31", 1)
    opens = ev.opens_for(rows, sample, 1)
    last = rows.where("day <= date '1996-12-31'").agg(F.max("t")).first()[0]
    assert opens.agg(F.max("t")).first()[0] == last
    curve = ev.horizon_decay(sample, 1, 3, opens)
    first = sample.agg(F.min("t")).first()[0]
    assert curve.count() == 3 and curve.first().n_days <= last - 4 - first + 1
    with pytest.raises(ValueError):
        ev.horizon_decay(sample, 20, 252, opens)
    with pytest.raises(ValueError):
        pipeline.evaluate(panel, "c - o", ["ic_horizon_decay"], first="1996-01-01", last="1996-12-31")


def test_gates_of_a_table_are_those_of_each_row(spark):
    rows = [("a", 1.0, True), ("b", None, True), ("c", float("inf"), False), ("d", 0.5, None)]
    table = spark.createDataFrame(rows, "factor string, x double, ok boolean")
    conditions = [{"metric": "x", "op": "gte", "value": 0.7}, {"metric": "ok", "op": "is", "value": True}]
    for match in ("all", "any"):
        got = {r.factor: r.passed for r in research.gate_columns(table, conditions, match).collect()}
        assert got == {f: research.gate({"x": x, "ok": ok}, conditions, match)[0] for f, x, ok in rows}


def test_long_windows_of_the_language_are_the_short_ones_way(spark, monkeypatch):
    panel = small_panel(spark, 70, 4, 9)
    for text in ("ts_rank(c, 50)", "ts_median(c - o, 50)", "rank_cs(ts_rank(c, 50)) + ts_median(c, 45)"):
        slid = expression.factor(panel, text).toPandas().sort_values(["t", "code"])["factor"].to_numpy(float)
        with monkeypatch.context() as m:
            m.setattr(rolling, "SLIDE_FROM", 1000)
            plain = expression.factor(panel, text).toPandas().sort_values(["t", "code"])["factor"].to_numpy(float)
        assert np.allclose(slid, plain, equal_nan=True, atol=1e-12)


def counted(spark, frame):
    """frame, and a counter of the rows of it that were computed."""
    rows = spark.sparkContext.accumulator(0)

    def tap(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    return frame.mapInArrow(tap, frame.schema), rows


def causality_computes_its_panel_once(spark, monkeypatch, name):
    panel = weekly_panel(spark, FOLDER, ("t", "day", "code", "c"))
    tapped, rows = counted(spark, panel)
    monkeypatch.setattr(engine, "weekly_panel", lambda *a: tapped)
    found = engine.queries()[name](spark, FOLDER)
    assert differences(found, connection(FOLDER), engine.oracle_sql()[name]) == []
    assert rows.value == panel.count()


def test_future_perturbation_computes_its_panel_once(spark, monkeypatch):
    causality_computes_its_panel_once(spark, monkeypatch, "future_data_perturbation")


def test_prefix_truncation_computes_its_panel_once(spark, monkeypatch):
    causality_computes_its_panel_once(spark, monkeypatch, "prefix_truncation_consistency")


def test_group_returns_compute_their_frame_once(spark):
    frame, rows = counted(spark, small_panel(spark).withColumn("group", F.when(F.col("vol") > 1, (F.col("vol") % 3 + 1).cast("int"))))
    got = {r.day: r for r in ev.calc_group_returns(frame, "group", "c", 3).collect()}
    assert rows.value == 90 * 7
    want = {(r.day, r.group): r.m for r in frame.where("group is not null and c is not null").groupBy("day", "group").agg(F.avg("c").alias("m")).collect()}
    assert {(d, g): r[f"G{g}"] for d, r in got.items() for g in (1, 2, 3) if r[f"G{g}"] is not None} == pytest.approx(want)
    with pytest.raises(ValueError, match="4"):
        ev.calc_group_returns(frame, "group", "c", 4)


def test_rank_ics_of_factors_side_by_side_equal_rank_ic_of_each(spark):
    nothing = F.lit(None).cast("double")
    rows = small_panel(spark, 40, 9, 3).withColumn("fwd", F.when(F.col("t") != 5, F.col("o"))).withColumn("endless", F.when(F.col("c") > 6, F.lit(float("inf"))).otherwise(-F.col("c")))
    rows = rows.withColumn("flat", F.lit(1.0)).withColumn("none", nothing).withColumn("few", F.when(F.col("code") < "000002", F.col("c")))
    names = ["c", "vol", "endless", "flat", "none", "few"]
    found = ev.rank_ics(rows, names)
    want = {(name, r.t, r.day): (r.n, r.ic) for name in names for r in ev.rank_ic(rows.withColumn("factor", F.col(name))).collect()}
    got = {(r.name, r.t, r.day): (r.n, r.ic) for r in found.collect()}
    assert got.keys() == want.keys() and len(got) > 100 and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in got)


def test_factors_of_a_study_are_neither_repeated_nor_sorted_by_name(spark):
    plan = studies.queries()["newey_west_factors"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    # A row a cell for all four factors, dealt by day once; no window ranks a factor.
    assert "Expand" not in plan and "rank(" not in plan


def test_a_filter_on_labels_names_them_once_and_leads_are_computed_once(spark):
    plan = ev.rank_ic(engine.evaluated(spark, FOLDER))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lead(o") == 2
    filters = [x for x in plan.split("\n") if "Filter" in x and "round(" in x]
    assert len(filters) == 1 and filters[0].count("round(") == 2


def test_finite_values_are_told_from_the_others(spark):
    numbers = [0.0, -0.0, 1.5, -1.7976931348623157e308, 1.7976931348623157e308, math.inf, -math.inf, math.nan, None]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double")
    got = {r.i: (r.ok, r.x) for r in frame.select("i", rules.is_finite(F.col("x")).alias("ok"), rules.finite(F.col("x")).alias("x")).collect()}
    assert all(got[i] == ((None, None) if x is None else (True, x) if math.isfinite(x) else (False, None)) for i, x in enumerate(numbers))
    whole = spark.createDataFrame([(-(2**63),), (5,)], "x long").select(rules.finite(F.col("x"))).collect()
    assert [r[0] for r in whole] == [-(2**63), 5]
