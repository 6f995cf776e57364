"""Service queries, the command line, and reading panels from files."""

import datetime

import pytest
from pyspark.sql import functions as F

from quillon import __main__ as cli
from quillon import queries
from quillon.operators import pipeline, service
from quillon.sources import panel as source


def test_tags_and_queue(spark):
    assert service.normalized_tag(" Ｍomentum ") == "momentum"
    tags = spark.createDataFrame([("a", "X"), ("a", "y "), ("b", "\uff38"), ("c", "z"), ("d", None)], "factor string, tag string")
    assert [r.factor for r in service.tagged(tags, ["x", "Y"]).collect()] == ["a"]
    assert sorted(r.factor for r in service.tagged(tags, ["x", "z"], "any").collect()) == ["a", "b", "c"]
    runs = spark.createDataFrame([(1, "a", "queued", 5), (2, "b", "queued", 9), (3, "b", "queued", 7), (4, "b", "succeeded", 1)], "run int, job string, status string, created int")
    jobs = spark.createDataFrame([("a", "cancelled"), ("b", "running")], "job string, status string")
    assert service.next_run(runs, jobs).first().run == 3
    daily = spark.createDataFrame([("r", 2, 0.5), ("r", 1, 0.25)], "run string, t int, ic double")
    assert [r.total for r in service.cumulative_ic(daily).orderBy("t").collect()] == [0.25, 0.75]


def test_panel_from_files(spark, tmp_path):
    day = lambda k: datetime.date(2024, 1, k)
    files = {}
    for name, rows, kind in (("c", [(day(2), "1", 1.0), (day(3), "2", 2.0)], "double"), ("o", [(day(2), "1", 3.0), (day(9), "1", 9.0)], "double"), ("st", [(day(3), "000002", True)], "boolean"), ("industry", [(day(2), "1", "I1")], "string")):
        files[name] = str(tmp_path / name)
        spark.createDataFrame(rows, f"day date, code string, values {kind}").write.parquet(files[name])
    out = {(r.t, r.code): r for r in source.read_panel(spark, files, ["st", "industry"]).collect()}
    assert set(out) == {(t, c) for t in (0, 1) for c in ("000001", "000002")}
    assert out[(0, "000001")].o == 3.0 and out[(1, "000001")].c is None and out[(1, "000002")].st and not out[(0, "000002")].st and out[(0, "000001")].industry == "I1"
    wide = spark.createDataFrame([(day(2), 1.0, None)], "day date, `000001` double, `000002` double")
    assert source.wide_to_long(wide).count() == 2
    assert source.duplicate_cells(source.wide_to_long(wide.union(wide))).count() == 2


def test_wide_tables_of_many_codes_are_maps_in_parts(spark):
    rows = spark.createDataFrame([(f"2024-01-0{d}", f"{c:06d}", None if c % 7 == 0 else f"{c}-{d}") for d in (1, 2) for c in range(2500)], "day string, code string, x string")
    wide = source.long_to_wide(rows, "x")
    # The plan's width does not grow with the codes, and no row holds more than a thousand.
    assert wide.columns == ["day", "part", "cells"] and sorted(len(r.cells) for r in wide.collect()) == [500, 500, 1000, 1000, 1000, 1000]
    assert sorted(source.wide_to_long(wide, "x").collect(), key=str) == sorted(rows.collect(), key=str)
    assert source.industry_cells(wide).count() == 2 * 2142
    with pytest.raises(ValueError):
        source.industry_cells(wide.union(wide))


@pytest.mark.parametrize("name", ["_evaluate_wide", "_industry_cells"])
def test_wide_queries_do_not_make_a_column_a_code(spark, monkeypatch, name):
    widths = []
    for at, f in ((queries.source, "industry_cells"), (queries.ev, "evaluate_wide")):
        inner = getattr(at, f)
        monkeypatch.setattr(at, f, lambda *a, inner=inner, **kw: (widths.extend(len(x.columns) for x in a if hasattr(x, "columns")), inner(*a, **kw))[1])
    assert getattr(queries, name)(spark, "/root/testdata/sf0.001").count() > 0
    assert widths and max(widths) == 3


def test_command_line(spark, capsys):
    cli.main(["--tables", "/root/testdata/sf0.001", "evaluate", "c - o", "--methods", "industry_neutralize,rank_ic,rank_icir", "--first", "1996-01-01", "--last", "1999-01-01"])
    assert "ic_mean" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["--tables", "x", "nothing"])


def test_batch_reports_failures(spark):
    rows = pipeline.evaluate_batch(spark, source.weekly_panel(spark, "/root/testdata/sf0.001"), {"good": "c - o", "bad": "foo(c)"}).collect()
    assert {r.factor_name for r in rows if r.metric == "failed"} == {"bad"} and any(r.metric == "icir.ic_mean" for r in rows if r.factor_name == "good")
    assert source.weekly_panel(spark, "/root/testdata/sf0.001").where(F.col("code").isNull()).count() == 0


def planted_panel(spark, days=260, codes=60):
    """A factor that foretells returns (c), and one that only knows the industry (vwap) in returns that follow industries too."""
    import numpy as np

    rng = np.random.RandomState(3)
    skill, fashion = rng.randn(days + 2, codes), np.repeat(rng.randn(days + 2, 4), codes // 4, axis=1)
    moves = 0.01 * skill + 0.02 * fashion
    price = np.exp(np.cumsum(np.vstack([np.zeros((2, codes)), moves[:-2]]) + 0.002 * rng.randn(days + 2, codes), axis=0))
    start = datetime.date(2020, 1, 1)
    cap = np.exp(rng.randn(codes) + 20)
    rows = [
        (t, start + datetime.timedelta(days=t), f"{k:06d}", float(price[t, k]), float(skill[t, k]), float(fashion[t, k] + 0.01 * rng.randn()), float(cap[k]), f"i{k // 15}", 100.0, 0.0, False, False)
        for t in range(days)
        for k in range(codes)
    ]
    return spark.createDataFrame(rows, "t int, day date, code string, o double, c double, vwap double, cap double, industry string, amt double, limit double, st boolean, delisting boolean").persist()


def test_standards_gate_a_planted_factor(spark):
    from quillon.operators import standards

    panel = planted_panel(spark)
    got = standards.run_standards(panel, "c", n_groups=5)
    assert [x["passed"] for x in got] == [True, True] and got[0]["metrics"]["ic_mean"] > 0.5
    assert all(c["passed"] for x in got for c in x["conditions"][:1]) and len(got[0]["conditions"]) == 3
    assert not standards.run_standard(panel, "-1 * c", "ic_test", n_groups=5)["passed"]
    # The bet on industries has a high raw IC, and nothing is left of it within industries.
    raw = pipeline.evaluate(panel, "vwap", ["rank_ic", "rank_icir"], 5).latest("icir")["ic_mean"]
    bet = standards.run_standard(panel, "vwap", "ic_test", n_groups=5)
    assert raw > 0.3 and abs(bet["metrics"]["ic_mean"]) < 0.1 and not bet["passed"]
    assert not standards.run_standard(panel, "c", "ic_test", n_groups=5, least_ic=0.99)["passed"]
    with pytest.raises(ValueError):
        standards.resolve("ic_test,ic_test")
    with pytest.raises(ValueError):
        standards.run_standard(panel, "c", "ic_test", level=1.5)


def test_the_portfolio_stage_trades_only_what_can_be_traded(spark, tmp_path):
    from quillon.operators import research

    assert research.STAGES["portfolio"][0] == "tradability_filter"
    panel = planted_panel(spark, 130, 20).withColumn("st", F.col("code") < "000010")
    log = pipeline.run_funnel(spark, panel, {"good": "c"}, str(tmp_path / "funnel"), n_groups=2)
    assert [x["stage"] for x in log] == ["causality", "ic", "cap_neutral_ic", "portfolio"] and all(x["passed"] for x in log)
    assert log[-1]["metrics"]["tradability_summary.n_special"] == 130 * 10
    none = pipeline.run_funnel(spark, panel, {"good": "c"}, str(tmp_path / "strict"), level=1e-300, n_groups=2)
    assert [x["passed"] for x in none] == [True, False]
