"""Named evaluation methods, run in order over a state that transforms may change, for one factor or a batch."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import cycles, labels, research, transforms
from quillon.operators import evaluation as ev
from quillon.plans.expression import factor, parse, symbols_of
from quillon.sources import scratch, store

WINDOWS = (20, 60, 252)


@dataclass
class State:
    rows: DataFrame
    n_groups: int
    horizon: int
    outputs: dict[str, object] = field(default_factory=dict)
    #: What checks against looking ahead compile again: the whole panel and the expression.
    panel: DataFrame | None = None
    text: str = ""
    decay: int = 1
    #: Where holdings are written; they are only computed if there is none.
    folder: str | None = None
    #: Rows of the whole calendar, from before the sample was cut.
    full: DataFrame | None = None
    #: Whether rows and tables are stored when they are made, so that what reads them next does not compute them again.
    stored: bool = False
    kept: list[DataFrame] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.rows = self.keep(self.rows)

    def keep(self, table: DataFrame) -> DataFrame:
        """The table, written and read again if the state stores: later plans begin there, and lost executors cost nothing."""
        if self.stored:
            table = scratch.stored(table, "state")
            self.kept.append(table)
        return table

    def close(self) -> None:
        """Delete what was stored; outputs that are tables can no longer be read."""
        scratch.forget(*self.kept)
        self.kept.clear()

    def put(self, name: str, value: object) -> None:
        """A repeated name gets a version: ic, ic__2, ..."""
        value = self.keep(value) if isinstance(value, DataFrame) else value
        n = 1
        while (name if n == 1 else f"{name}__{n}") in self.outputs:
            n += 1
        self.outputs[name if n == 1 else f"{name}__{n}"] = value

    def latest(self, name: str):
        versions = [k for k in self.outputs if k == name or k.startswith(f"{name}__")]
        if not versions:
            raise KeyError(f"{name} has not been computed")
        return self.outputs[max(versions, key=lambda k: int(k.partition("__")[2] or 1))]


@dataclass(frozen=True)
class Method:
    run: Callable[[State], None]
    requires: tuple[str, ...] = ()
    provides: tuple[str, ...] = ()
    symbols: tuple[str, ...] = ()


METHODS: dict[str, Method] = {}


def method(name: str, requires: tuple[str, ...] = (), provides: str = "", symbols: tuple[str, ...] = ()):
    """Registers an evaluation method. provides: what else it may stand in for when another method requires that."""

    def add(f):
        METHODS[name] = Method(f, requires, (name, provides) if provides else (name,), symbols)
        return f

    return add


def _first(df: DataFrame) -> dict:
    row = df.first()
    return row.asDict() if row else {}


@method("rank_ic")
def _ic(s: State) -> None:
    s.put("ic", ev.rank_ic(s.rows))
    s.put("ic_summary", _first(ev.ic_summary(s.rows)))


method("rank_icir", ("rank_ic",))(lambda s: s.put("icir", _first(ev.icir(s.latest("ic")))))
method("quantile_returns")(lambda s: s.put("group_returns", ev.quantile_returns(s.rows, s.n_groups)))
method("quantile_cumulative", ("quantile_returns",))(lambda s: s.put("cumulative", ev.cumulative(s.latest("group_returns"))))
method("ic_peak_decay", ("rank_ic",))(lambda s: s.put("peak_decay", ev.peak_decay(s.latest("ic"))))
method("cycle_context", ("quantile_plot",))(lambda s: s.put("cycles", cycles.cycles_of(s.latest("plot"), cycles.cycle_table(s.rows.sparkSession))))


@method("ic_horizon_decay")
def _horizons(s: State) -> None:
    """The curve, and what a summary says of it. Opens may come from the horizon's days after the sample, no later."""
    opens = s.rows if s.full is None else ev.opens_for(s.full, s.rows, s.horizon)
    curve = s.keep(ev.horizon_decay(s.rows, opens=opens))
    s.put("horizon_decay", curve)
    found = _first(curve.agg(F.count(F.lit(1)).alias("horizons"), F.max("n_days").alias("common_days"), F.min_by("mean_ic", "horizon").alias("first_mean_ic"), F.max_by("mean_ic", "horizon").alias("last_mean_ic")))
    if not found["horizons"]:
        raise ValueError("no signal day has a rank IC at every horizon")
    s.put("horizon_decay_summary", found)


@method("quantile_plot", ("quantile_cumulative",))
def _plot(s: State) -> None:
    """What a plot shows, a column for each group; drawing is left to whoever looks at it."""
    wide = s.latest("cumulative").groupBy("day").pivot("grp", list(range(1, s.n_groups + 1))).agg(F.first("cum"))
    s.put("plot", wide.select("day", *[F.col(f"`{g}`").alias(f"G{g}") for g in range(1, s.n_groups + 1)]).orderBy("day"))


@method("quantile_net_returns", provides="quantile_returns")
def _net(s: State) -> None:
    net = ev.net_returns(s.rows, s.n_groups)
    s.put("net", net)
    s.put("group_returns", net.select("t", "day", "grp", "ret"))


@method("top_quantile_performance", ("quantile_returns",))
def _top(s: State) -> None:
    s.put("top", _first(ev.top_summary(s.latest("group_returns"), s.n_groups)))
    s.put("leadership", ev.top_leadership(s.latest("group_returns"), s.n_groups))


def _top_row(s: State, table: DataFrame) -> dict:
    return _first(table.where(F.col("grp") == s.n_groups).drop("grp"))


@method("rolling_sharpe", ("quantile_returns",))
def _sharpe(s: State) -> None:
    for size in WINDOWS:
        s.put(f"sharpe_{size}", ev.rolling_sharpe(s.latest("group_returns"), size))
        s.put(f"sharpe_{size}_top", _top_row(s, ev.sharpe_summary(s.latest(f"sharpe_{size}"))))


@method("rolling_drawdown", ("quantile_returns",))
def _drawdown(s: State) -> None:
    for size in WINDOWS:
        s.put(f"drawdown_{size}", ev.rolling_drawdown(s.latest("group_returns"), size))
        s.put(f"drawdown_{size}_top", _top_row(s, ev.drawdown_summary(s.latest(f"drawdown_{size}"))))


@method("fitness", ("quantile_net_returns",))
def _fitness(s: State) -> None:
    s.put("fitness", ev.fitness(s.latest("net"), s.n_groups))
    s.put("fitness_summary", _first(ev.fitness_summary(s.latest("fitness"))))


@method("newey_west_ic_significance", ("rank_ic",))
def _newey_west(s: State) -> None:
    found = _first(ev.newey_west(s.latest("ic"), horizon=s.horizon))
    if not found:
        raise ValueError("three values of the IC that are not all equal are needed")
    s.put("newey_west", found)


@method("ic_trend_filter", ("rank_ic",))
def _trend(s: State) -> None:
    s.put("trend", ev.trend_table(s.latest("ic")))
    s.put("trend_mean_10", ev.trend_means(s.latest("trend")))
    s.put("trend_summary", _first(ev.trend_summary(s.latest("trend"))))
    if not s.latest("trend_summary").get("days"):
        raise ValueError("four days with an IC are needed")


@method("tradability_filter", symbols=("c", "o", "amt", "limit", "st", "delisting"))
def _tradability(s: State) -> None:
    flagged = transforms.tradability(s.rows)
    s.put("tradability", transforms.tradability_daily(flagged))
    s.put("tradability_summary", _first(transforms.tradability_summary(flagged)))
    s.rows = s.keep(transforms.mask_untradable(s.rows))


def _transform(name: str, f, symbols: tuple[str, ...]) -> None:
    def run(s: State) -> None:
        s.rows = s.keep(f(s.rows))

    METHODS[name] = Method(run, (), (name,), symbols)


_transform("market_cap_neutralize", transforms.cap_neutralize, ("cap",))
_transform("industry_neutralize", transforms.industry_neutralize, ("industry",))
_transform("industry_market_cap_neutralize", transforms.industry_cap_neutralize, ("industry", "cap"))


def _causality(name: str, check) -> None:
    def run(s: State) -> None:
        if s.panel is None or not s.text:
            raise ValueError(f"{name} needs the panel and the expression")
        found = check(s.panel, lambda panel: factor(panel, s.text, decay=s.decay))
        s.put(name, found)
        s.put(f"{name}_summary", _first(found.agg(F.count(F.lit(1)).alias("checkpoints"), F.sum("cells").alias("cells"), F.sum("changed").alias("changed"))))

    METHODS[name] = Method(run)


_causality("future_data_perturbation", research.future_perturbation)
_causality("prefix_truncation_consistency", research.prefix_truncation)


@method("holding_audit", ("industry_market_cap_neutralize", "tradability_filter", "quantile_net_returns"), symbols=("cap", "industry", "limit", "o", "st", "delisting"))
def _holdings(s: State) -> None:
    held = research.holdings(s.rows, s.n_groups, s.horizon)
    s.put("holdings", held)
    summary = research.write_holdings(held, s.latest("net"), s.n_groups, s.folder) if s.folder else research.holding_summary(held, s.latest("net"), s.n_groups)
    s.put("holding_summary", summary)


DEFAULT = ("rank_ic", "rank_icir", "quantile_returns", "quantile_cumulative", "quantile_plot")


def resolve(names: str | Iterable[str] | None = DEFAULT) -> list[str]:
    """The methods in order, with those they need before them, each once. A method that ran may stand in for a need."""
    wanted = [n.strip() for n in (names.split(",") if isinstance(names, str) else names or DEFAULT)]
    wanted = list(DEFAULT) if [n for n in wanted if n] in ([], ["default"]) else [n for n in wanted if n]
    out: list[str] = []
    provided: set[str] = set()

    def add(name: str, above: tuple[str, ...], asked: bool) -> None:
        if name in above:
            raise ValueError(f"{' -> '.join((*above, name))}: methods need each other")
        if name not in METHODS:
            raise ValueError(f"unknown method {name!r}; there are {sorted(METHODS)}")
        if name in out or name in provided and not asked:
            return
        for need in METHODS[name].requires:
            add(need, (*above, name), False)
        out.append(name)
        provided.update(METHODS[name].provides)

    for n in wanted:
        add(n, (), True)
    return out


def run_methods(state: State, names: Iterable[str]) -> State:
    """The methods exactly as given, repeats and all; what one needs must have run before it."""
    names, ran = list(names), set()
    if not names:
        raise ValueError("one method at least is needed")
    for n in names:
        missing = sorted(set(METHODS[n].requires) - ran)
        if missing:
            raise ValueError(f"{n} needs {missing} to run before it")
        METHODS[n].run(state)
        ran.update(METHODS[n].provides)
    return state


def needed_columns(text: str, methods: Iterable[str]) -> list[str]:
    """The panel's columns that an evaluation reads: what a scan must fetch."""
    return sorted({"t", "day", "code", "o", *symbols_of(text), *(c for m in resolve(methods) for c in METHODS[m].symbols)})


def evaluate(panel: DataFrame, text: str, methods: str | Iterable[str] = DEFAULT, n_groups: int = 10, horizon: int = 1, decay: int = 1, first=None, last=None, repeats: bool = False, folder: str | None = None, stored: bool = False) -> State:
    """One factor through the methods: expression, label, trades and reasons against them on full history, then the sample window.

    repeats: run the methods as they are listed, without adding or merging any. stored: keep rows and tables once they
    are computed, until the state is closed.
    """
    names = list(methods) if repeats else resolve(methods)
    panel = panel.select(*[c for c in needed_columns(text, names) if c in panel.columns])
    rows = labels.forward_open_return(factor(panel, text, decay=decay), horizon)
    # These look at the next days, so they are told before the sample is cut, wherever the method stands.
    if "tradability_filter" in names:
        rows = transforms.with_reasons(rows)
    if "holding_audit" in names:
        rows = research.with_trades(rows, horizon)
    full = rows
    rows = labels.sample_window(rows, first, last, horizon, calendar=panel)
    state = State(rows, n_groups, horizon, panel=panel, text=text, decay=decay, folder=folder, full=full, stored=stored)
    try:
        return run_methods(state, names)
    except BaseException:
        state.close()
        raise


def metrics_of(state: State) -> dict[str, float | None]:
    """The numbers among a state's outputs, as name.key."""
    out: dict[str, float | None] = {}
    for name, value in state.outputs.items():
        for k, v in value.items() if isinstance(value, dict) else ():
            if v is None or isinstance(v, bool | int | float):
                out[f"{name}.{k}"] = None if v is None or not math.isfinite(v) else float(v)
    return out


def run_batch(spark: SparkSession, panel: DataFrame, factors: dict[str, str], methods: str | Iterable[str] = ("rank_ic", "rank_icir"), log: str | None = None, rerun: bool = False, **settings) -> list[dict]:
    """Each factor's record (name, terms, status, seconds, metrics or error), over one panel that is read once: stored here
    unless the caller has stored it.

    log: a file of records. Those of a completed factor with the same expression, methods and settings are not redone.
    A factor that fails leaves its error and the others go on; errors of the cluster stop the batch, which can be resumed.
    """
    names = resolve(methods)
    for text in factors.values():
        parse(text)
    old = [] if log is None else store.read_lines(spark, log)
    terms = {n: {"expression": x, "methods": names, **{k: None if v is None else str(v) for k, v in sorted(settings.items())}} for n, x in factors.items()}
    done = {} if rerun else {r["factor"]: r for r in old if r["status"] == "completed" and r["factor"] in terms and r["terms"] == terms[r["factor"]]}
    todo = [n for n in factors if n not in done]
    columns = sorted({c for n in todo for c in needed_columns(factors[n], names)})
    shared = panel.select(*[c for c in columns if c in panel.columns])
    shared = shared.persist() if todo and not panel.is_cached else shared
    out = []
    try:
        for name in factors:
            if name in done:
                out.append({**done[name], "reused": True})
                continue
            began = time.time()
            try:
                state = evaluate(shared, factors[name], names, stored=True, **settings)
                record = {"status": "completed", "metrics": metrics_of(state)}
                state.close()
            except research.FACTOR_ERRORS as e:
                record = {"status": "failed", "error": f"{type(e).__name__}: {str(e)[:2000]}"}
            out.append({"factor": name, "terms": terms[name], "seconds": round(time.time() - began, 3), **record})
            if log is not None:
                kept = [r for r in old if r["factor"] not in {x["factor"] for x in out}]
                store.write_lines(spark, log, [*kept, *({k: v for k, v in r.items() if k != "reused"} for r in out)])
    finally:
        if shared.is_cached:
            shared.unpersist()
    return out


def evaluate_batch(spark: SparkSession, panel: DataFrame, factors: dict[str, str], methods: str | Iterable[str] = ("rank_ic", "rank_icir"), **settings) -> DataFrame:
    """(factor_name, metric, value, error) of many factors over one panel; one that fails has the metric "failed"."""
    bad = {}
    for name, text in factors.items():
        try:
            parse(text)
        except ValueError as e:
            bad[name] = str(e)
    rows: list[tuple] = [(n, "failed", 1.0, e) for n, e in bad.items()]
    for r in run_batch(spark, panel, {n: x for n, x in factors.items() if n not in bad}, methods, **settings) if len(bad) < len(factors) else ():
        rows += [(r["factor"], k, v, None) for k, v in r["metrics"].items()] if r["status"] == "completed" else [(r["factor"], "failed", 1.0, r["error"])]
    return spark.createDataFrame(rows, "factor_name string, metric string, value double, error string")


def run_funnel(spark: SparkSession, panel: DataFrame, factors: dict[str, str], folder: str, level: float = research.LEVEL, **settings) -> list[dict]:
    """The funnel over factors, stage by stage, kept in folder: a stage's results that match are not computed again.

    The panel is stored once for all factors and stages. level: of significance, at the two stages that test it.
    """
    columns = sorted({c for x in factors.values() for m in research.STAGES.values() for c in needed_columns(x, m)})
    shared = panel.select(*[c for c in columns if c in panel.columns]).persist()

    def one(name: str, stage: str) -> dict:
        record = run_batch(spark, shared, {name: factors[name]}, research.STAGES[stage], log=f"{folder.rstrip('/')}/{stage}/{name}.jsonl", **settings)[0]
        if record["status"] != "completed":
            raise ValueError(record["error"])
        m = record["metrics"]
        return {"changed": m.get("future_data_perturbation_summary.changed"), "nw_p": m.get("newey_west.p"), "metrics": m}

    try:
        log = research.funnel(list(factors), one, level=level)
    finally:
        shared.unpersist()
    store.write_lines(spark, f"{folder.rstrip('/')}/summary.jsonl", log)
    return log
