"""Standards: fixed method lists with a gate, run on one factor and one sample."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from quillon.operators import pipeline, research
from quillon.sources import scratch


@dataclass(frozen=True)
class Standard:
    methods: tuple[str, ...]
    gate: Callable[..., bool]
    #: The gate's conditions, by the same bounds.
    conditions: Callable[..., list[dict]]


#: The methods of each standard, in their order. Factors are neutralized before anything is measured,
#: and what cannot be traded goes before portfolios are formed.
STANDARDS: dict[str, Standard] = {
    "ic_test": Standard(("prefix_truncation_consistency", "industry_market_cap_neutralize", "rank_ic", "rank_icir", "newey_west_ic_significance", "ic_trend_filter", "ic_peak_decay"), research.ic_gate, research.ic_conditions),
    "profitability_test": Standard(("industry_market_cap_neutralize", "tradability_filter", "quantile_net_returns", "fitness", "quantile_cumulative", "quantile_plot", "rolling_sharpe", "rolling_drawdown", "top_quantile_performance", "cycle_context"), research.profit_gate, research.profit_conditions),
}


def resolve(names: str | Iterable[str] | None = None) -> list[str]:
    """Names of standards, all by default; unknown and repeated ones are errors."""
    wanted = list(STANDARDS) if names in (None, "all") else [n.strip() for n in (names.split(",") if isinstance(names, str) else names)]
    wanted = [n for n in wanted if n]
    unknown = [n for n in wanted if n not in STANDARDS]
    if not wanted or unknown or len(set(wanted)) < len(wanted):
        raise ValueError(f"standards must be some of {list(STANDARDS)}, each once; not {unknown or wanted}")
    return wanted


def metrics_of(state: pipeline.State) -> dict:
    """The numbers that gates look at, of those that the state holds."""
    out: dict = {}
    if "icir" in state.outputs:
        out |= state.latest("icir")
    if "newey_west" in state.outputs:
        got = state.latest("newey_west")
        out |= {"nw_p": got["p"], "nw_t": got["t"], "nw_lag": got["lag"]}
    if "prefix_truncation_consistency_summary" in state.outputs:
        out["prefix_passed"] = state.latest("prefix_truncation_consistency_summary")["changed"] == 0
    if "top" in state.outputs:
        out |= state.latest("top")
    if "sharpe_60_top" in state.outputs:
        out["sharpe_60_median"] = state.latest("sharpe_60_top").get("middle")
    if "fitness_summary" in state.outputs:
        out |= state.latest("fitness_summary")
    return out


def run_standard(panel: DataFrame, text: str, name: str, n_groups: int = 10, horizon: int = 1, first=None, last=None, decay: int = 1, **bounds) -> dict:
    """Metrics of a standard, its gate's conditions one by one, and whether it lets the factor through.

    bounds: those of the standard's gate (level, least_ic; least_sharpe, least_return).
    """
    standard = STANDARDS[resolve(name)[0]]
    conditions = standard.conditions(**bounds)
    state = pipeline.evaluate(panel, text, standard.methods, n_groups, horizon, decay, first=first, last=last, stored=True)
    try:
        metrics = metrics_of(state)
    finally:
        state.close()
    return {"standard": name, "passed": standard.gate(metrics, **bounds), "conditions": research.gate(metrics, conditions)[1], "metrics": metrics}


def run_standards(panel: DataFrame, text: str, names: str | Iterable[str] | None = None, bounds: dict[str, dict] | None = None, **kw) -> list[dict]:
    """Several standards in order, over a panel that is read once. bounds: those of each standard by name."""
    wanted = resolve(names)
    columns = sorted({c for n in wanted for c in pipeline.needed_columns(text, STANDARDS[n].methods)})
    shared = scratch.stored(panel.select(*[c for c in columns if c in panel.columns]), "panel")
    try:
        return [run_standard(shared, text, n, **kw, **(bounds or {}).get(n, {})) for n in wanted]
    finally:
        scratch.forget(shared)
