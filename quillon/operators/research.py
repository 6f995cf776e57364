"""Checks against looking ahead, holdings, gates, and the funnel."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.errors import AnalysisException, ArithmeticException
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.operators.correlation import THRESHOLD
from quillon.operators.evaluation import BUY_COST, SELL_COST, quantile_members
from quillon.plans.expression import factor as compile_factor
from quillon.plans.expression import symbols_of
from quillon.sources.panel import write_panel

PERTURBED = ("c", "o", "h", "l", "vol", "amt", "vwap", "cap")


Build = Callable[[DataFrame], DataFrame]


def checkpoints(full: DataFrame, count: int = 4) -> list[int]:
    """count days, spread evenly over those on which (t, code, factor) has a finite value, the first and last included."""
    days = sorted(r.t for r in full.where(F.col("factor").isNotNull()).select("t").distinct().collect())
    return sorted({days[round(x)] for x in np.linspace(0, len(days) - 1, count)}) if days else []


def _built(text: str | Build) -> Build:
    """How a panel becomes (t, code, factor): an expression, or a function of the panel."""
    return text if callable(text) else lambda panel: compile_factor(panel, text)


def _changed(full: DataFrame, others: list[tuple[int, DataFrame]]) -> DataFrame:
    """(t, cells, changed) of each day k, by the values of day k in full and in the frame built for it.

    full stands in the plan once: its rows of all those days meet the others' by day and code.
    """
    at = [k for k, _ in others]
    a = full.where(F.col("t").isin(at)).select("t", "code", F.col("factor").alias("a"))
    parts = [f.where(F.col("t") == k).select("t", "code", F.col("factor").alias("b")) for k, f in others]
    b = parts[0]
    for part in parts[1:]:
        b = b.union(part)
    close = F.abs(F.col("a") - F.col("b")) <= 1e-12 + 1e-10 * F.abs("b")
    same = (F.col("a").isNull() & F.col("b").isNull()) | F.coalesce(close, F.lit(False))
    return a.join(b, ["t", "code"], "full").groupBy("t").agg(F.count(F.lit(1)).alias("cells"), F.sum((~same).cast("long")).alias("changed"))


def _at(full: DataFrame, at: list[int] | None) -> list[int]:
    at = checkpoints(full) if at is None else at
    if not at:
        raise ValueError("no day has a finite value to check")
    return at


def prefix_truncation(panel: DataFrame, text: str | Build, at: list[int] | None = None) -> DataFrame:
    """(t, cells, changed): factor values of day t that differ when later days are cut off. A causal factor has none.

    at: the days to look at, those of checkpoints() by default.
    """
    build = _built(text)
    full = build(panel)
    return _changed(full, [(k, build(panel.where(F.col("t") <= k))) for k in _at(full, at)])


def future_perturbation(panel: DataFrame, text: str | Build, at: list[int] | None = None, seed: int = 17) -> DataFrame:
    """(t, cells, changed): factor values of day t that differ when later numbers are multiplied by lognormal noise."""
    build = _built(text)
    full = build(panel)

    def disturbed(k: int) -> DataFrame:
        noise = lambda c: F.exp(0.45 * F.sqrt(-2 * F.ln((F.pmod(F.xxhash64("code", "t", F.lit(c), F.lit(seed)), F.lit(999983)) + 1) / 999984.0)) * F.cos(F.pmod(F.xxhash64("t", "code", F.lit(c), F.lit(seed)), F.lit(6283)) / 1000.0))
        return panel.withColumns({c: F.when(F.col("t") > k, F.col(c) * noise(c)).otherwise(F.col(c)) for c in PERTURBED if c in panel.columns})

    return _changed(full, [(k, build(disturbed(k))) for k in _at(full, at)])


def with_trades(rows: DataFrame, horizon: int = 1) -> DataFrame:
    """Adds _trade: entry and exit of a position taken on each day, and what is known of the code when it is entered.

    Looks at the next rows of the full calendar, so it must run before the sample is cut.
    """
    ahead = W.partitionBy("code").orderBy("t")
    lead = lambda c, n: F.lead(c, n).over(ahead)
    no = F.lit(False)
    found = {"entry_day": lead("day", 1), "entry_open": lead("o", 1), "exit_day": lead("day", 1 + horizon), "exit_open": lead("o", 1 + horizon), "entry_st": F.coalesce(lead("st", 1), no), "entry_delisting": F.coalesce(lead("delisting", 1), no)}
    kept = rows.columns
    return rows.withColumns(found).select(*kept, F.struct(*found).alias("_trade"))


def holdings(rows: DataFrame, n_groups: int, horizon: int = 1) -> DataFrame:
    """The top group's positions of each day, with ranks, weights, entry and exit, and what is known of the code on both days.

    Of a sample, rows must have _trade (see with_trades) from before it was cut; without it, rows are the whole calendar.
    """
    rows = rows if "_trade" in rows.columns else with_trades(rows, horizon)
    rows = rows.select("*", "_trade.*")
    day = W.partitionBy("t")
    members = quantile_members(rows, n_groups).withColumn("factor_rank", F.row_number().over(day.orderBy("factor", "code")))
    top = members.where(F.col("grp") == n_groups)
    top = top.withColumn("position", F.row_number().over(day.orderBy(F.col("factor").desc(), F.col("code").desc()))).withColumn("weight", 1 / F.count(F.lit(1)).over(day))
    return top.select("t", "day", "code", F.lit(f"G{n_groups}").alias("grp"), "factor_rank", "position", "factor", "weight", "entry_day", "entry_open", "exit_day", "exit_open", "fwd", (F.col("cap") / 1e8).alias("cap_100m"), "industry", "limit", "st", "delisting", "entry_st", "entry_delisting")


def holding_summary(held: DataFrame, net: DataFrame, n_groups: int, tolerance: float = 1e-12) -> DataFrame:
    """(t, day, positions, weight, gross, cost, net, reconciles): each day's positions beside the top group's net return.

    reconciles: whether what the positions earned, less the cost, is the net return.
    """
    daily = held.groupBy("t", "day").agg(F.count(F.lit(1)).alias("positions"), F.max("weight").alias("weight"), F.avg("fwd").alias("gross"))
    top = net.where(F.col("grp") == n_groups).select("t", "cost", F.col("ret").alias("net"))
    out = daily.join(top, "t", "full")
    return out.withColumn("reconciles", F.coalesce(F.abs(F.col("gross") - F.col("cost") - F.col("net")) <= tolerance, F.lit(False)))


def write_holdings(held: DataFrame, net: DataFrame, n_groups: int, path: str) -> DataFrame:
    """Write the positions, by day, once every day's reconcile; their summary. A day that does not is an error."""
    summary = holding_summary(held, net, n_groups)
    wrong = summary.where(~F.col("reconciles")).select("t").limit(5).collect()
    if wrong:
        raise ValueError(f"positions do not reconcile with net returns on days {sorted(r.t for r in wrong)}")
    write_panel(held.repartitionByRange("t").sortWithinPartitions("t", "position"), path)
    return summary


@dataclass
class Library:
    """Admitted factors by name, in memory; a candidate too like a member is refused, the same one again changes nothing.

    correlation.StoredLibrary keeps them, and their matrix, in files.
    """

    threshold: float = THRESHOLD
    expressions: dict[str, str] = field(default_factory=dict)

    def admit(self, name: str, expression: str, correlations: dict[str, float]) -> tuple[bool, list[str]]:
        if self.expressions.get(name) == expression:
            return True, []
        clash = sorted(f for f, rho in correlations.items() if f in self.expressions and f != name and abs(rho) >= self.threshold)
        if not clash:
            self.expressions[name] = expression
        return not clash, clash

    def replaces(self, candidate: dict, incumbents: list[dict]) -> bool:
        """Whether a candidate beats every factor it clashes with: by Sharpe, then by fitness, on the same terms."""
        key = lambda x: (x["sharpe_median"], x["fitness"])
        return all(x["signature"] == candidate["signature"] and key(candidate) > key(x) for x in incumbents)


_TESTS: dict[str, Callable] = {"gte": lambda v, a, b: v >= a, "lte": lambda v, a, b: v <= a, "gt": lambda v, a, b: v > a, "lt": lambda v, a, b: v < a, "between": lambda v, a, b: a <= v <= b, "is": lambda v, a, b: v is a}


def gate(metrics: dict, conditions: list[dict], match: str = "all") -> tuple[bool, list[dict]]:
    """Whether metrics meet conditions (metric, op, value, upper), and each one's outcome; a missing metric fails."""
    out = []
    for c in conditions:
        v = metrics.get(c["metric"])
        fits = isinstance(v, bool) if c["op"] == "is" else isinstance(v, int | float) and not isinstance(v, bool) and np.isfinite(v)
        out.append({**c, "actual": v, "passed": bool(fits and _TESTS[c["op"]](v, c.get("value"), c.get("upper")))})
    return (all if match == "all" else any)(x["passed"] for x in out), out


LEVEL, LEAST_IC, LEAST_SHARPE, LEAST_RETURN = 0.05, 0.0, 1.0, 0.30


def ic_conditions(level: float = LEVEL, least_ic: float = LEAST_IC) -> list[dict]:
    """What the IC standard asks for: causal values, an IC above least_ic, significant at level."""
    if not 0 < level < 1:
        raise ValueError("the level of significance must lie between 0 and 1")
    return [{"metric": "prefix_passed", "op": "is", "value": True}, {"metric": "ic_mean", "op": "gt", "value": least_ic}, {"metric": "nw_p", "op": "lt", "value": level}]


def profit_conditions(least_sharpe: float = LEAST_SHARPE, least_return: float = LEAST_RETURN) -> list[dict]:
    """What the profitability standard asks for: the first, and one of the other two."""
    return [{"metric": "above_every_lower", "op": "is", "value": True}, {"metric": "sharpe_60_median", "op": "gte", "value": least_sharpe}, {"metric": "annualized", "op": "gt", "value": least_return}]


def ic_gate(metrics: dict, **bounds) -> bool:
    return gate(metrics, ic_conditions(**bounds))[0]


def profit_gate(metrics: dict, **bounds) -> bool:
    leads, *others = profit_conditions(**bounds)
    return gate(metrics, [leads])[0] and gate(metrics, others, "any")[0]


def significant(level: float = LEVEL) -> Callable[[dict], bool]:
    return lambda m: gate(m, [{"metric": "nw_p", "op": "lt", "value": level}])[0]


def gate_columns(table: DataFrame, conditions: list[dict], match: str = "all") -> DataFrame:
    """table, a row a factor with a column for each metric, with passed_<metric> for each condition and passed.

    The same rules as gate, for tables of any length: a missing or infinite metric fails.
    """
    tests = {"gte": lambda v, a, b: v >= a, "lte": lambda v, a, b: v <= a, "gt": lambda v, a, b: v > a, "lt": lambda v, a, b: v < a, "between": lambda v, a, b: v.between(a, b), "is": lambda v, a, b: v == a}
    kinds, found = dict(table.dtypes), {}
    for c in conditions:
        v = F.col(c["metric"])
        v = v if kinds[c["metric"]] == "boolean" else F.when(F.abs(v.cast("double")) < float("inf"), v.cast("double"))
        ok = F.coalesce(tests[c["op"]](v, c.get("value"), c.get("upper")), F.lit(False))
        found[c["metric"]] = found[c["metric"]] & ok if c["metric"] in found else ok
    every = list(found.values())
    passed = every[0]
    for ok in every[1:]:
        passed = passed & ok if match == "all" else passed | ok
    return table.withColumns({f"passed_{m}": ok for m, ok in found.items()} | {"passed": passed})


#: The funnel's stages and the methods that run on the survivors of the one before.
STAGES: dict[str, tuple[str, ...]] = {
    "causality": ("future_data_perturbation",),
    "ic": ("rank_ic", "rank_icir", "newey_west_ic_significance"),
    "cap_neutral_ic": ("market_cap_neutralize", "rank_ic", "rank_icir", "newey_west_ic_significance"),
    "portfolio": ("tradability_filter", "quantile_returns", "quantile_cumulative", "quantile_plot", "fitness", "top_quantile_performance", "rolling_sharpe", "rolling_drawdown"),
}


def funnel_gates(level: float = LEVEL) -> dict[str, Callable[[dict], bool]]:
    """What lets a factor pass each stage; the last one only gathers."""
    if not 0 < level < 1:
        raise ValueError("the level of significance must lie between 0 and 1")
    return {"causality": lambda m: m.get("changed") == 0, "ic": significant(level), "cap_neutral_ic": significant(level), "portfolio": lambda m: True}


#: Errors of a factor or its data. Anything else (lost executors, no memory, no disk) is not the factor's and goes on up.
FACTOR_ERRORS = (ValueError, KeyError, ArithmeticError, AnalysisException, ArithmeticException)


def funnel(names: list[str], evaluate: Callable[[str, str], dict], done: dict | None = None, level: float = LEVEL) -> list[dict]:
    """Stage by stage over the survivors. done holds results of an earlier run by (factor, stage), which are not redone."""
    log, alive, done = [], list(names), done if done is not None else {}
    for stage, passes in funnel_gates(level).items():
        kept = []
        for name in alive:
            if (name, stage) not in done:
                try:
                    done[(name, stage)] = {"status": "completed", **evaluate(name, stage)}
                except FACTOR_ERRORS as e:
                    done[(name, stage)] = {"status": "failed", "error": f"{type(e).__name__}: {e}"}
            result = done[(name, stage)]
            ok = result["status"] == "completed" and passes(result)
            log.append({"factor": name, "stage": stage, "passed": ok, **result})
            if ok:
                kept.append(name)
        alive = kept
    return log


def registry_batch(text: str) -> list[dict]:
    """Factors of a JSON batch, checked: unique numbers and names, names that are identifiers, expressions that parse."""
    batch = json.loads(text)
    if batch.get("schema_version") != 1:
        raise ValueError("schema_version must be 1")
    seen: set = set()
    for x in batch["factors"]:
        if not str(x["factor_name"]).isidentifier() or x["factor_name"] in seen or x["number"] in seen:
            raise ValueError(f"bad or repeated factor {x['factor_name']}")
        if sorted(x["required_symbols"]) != symbols_of(x["expression"]):
            raise ValueError(f"{x['factor_name']} lists other symbols than it reads")
        seen |= {x["factor_name"], x["number"]}
    return batch["factors"]


def select_factors(factors: list[dict], wanted: str) -> list[dict]:
    """Factors by numbers, ranges and names, as in "1,3-5,alpha_9"."""
    numbers, names = set(), set()
    for part in filter(None, (p.strip() for p in wanted.split(","))):
        lo, dash, hi = part.partition("-")
        if lo.isdigit() and (hi.isdigit() if dash else True):
            numbers |= set(range(int(lo), int(hi or lo) + 1))
        else:
            names.add(part)
    out = [x for x in factors if x["number"] in numbers or x["factor_name"] in names]
    missing = (numbers - {x["number"] for x in factors}) | (names - {x["factor_name"] for x in factors})
    if missing:
        raise ValueError(f"no such factor: {sorted(map(str, missing))}")
    return out


COSTS = {"buy": BUY_COST, "sell": SELL_COST}
