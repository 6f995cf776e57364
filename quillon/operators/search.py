"""Genetic search for expressions: trees, variation, and scoring of a whole population in one plan."""

from __future__ import annotations

import json
import random
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.rules import finite
from quillon.operators import labels, standards, transforms
from quillon.operators.evaluation import rank_ic
from quillon.operators.research import FACTOR_ERRORS
from quillon.plans.expression import ExpressionError, batches, canonical, factors, parse
from quillon.sources import store

#: What trees are made of.
TERMINALS = ("c", "o", "h", "l", "vol", "vwap", "pct(c, 1)")
WINDOWS = (2, 3, 5, 10, 20, 40, 60)
EXPONENTS = (0.5, 1.5, 2.0)
#: Name: (number of panels, kind of parameter, how it is written). Division and inverses are protected: by 1
#: where the divisor is below 1e-6.
FUNCTIONS: dict[str, tuple[int, str, str]] = {
    "add": (2, "", "({0} + {1})"),
    "sub": (2, "", "({0} - {1})"),
    "mul": (2, "", "({0} * {1})"),
    "div": (2, "", "({0} / where(abs({1}) > 1e-6, {1}, 1.0))"),
    "abs": (1, "", "abs({0})"),
    "sqrt": (1, "", "sqrt(abs({0}))"),
    "log": (1, "", "log(abs({0}) + 1e-6)"),
    "inv": (1, "", "(1.0 / where(abs({0}) > 1e-6, {0}, 1.0))"),
    "neg": (1, "", "(-{0})"),
    "rank_cs": (1, "", "rank_cs({0})"),
    "delay": (1, "window", "delay({0}, {p})"),
    "delta": (1, "window", "delta({0}, {p})"),
    "ts_corr": (2, "window", "ts_corr({0}, {1}, {p})"),
    "ts_cov": (2, "window", "ts_cov({0}, {1}, {p})"),
    "scale_cs": (1, "", "scale_cs({0}, 1.0)"),
    "signed_power": (1, "exponent", "signed_power({0}, {p})"),
    "decay_linear": (1, "window", "decay_linear({0}, {p})"),
    "ts_min": (1, "window", "ts_min({0}, {p})"),
    "ts_max": (1, "window", "ts_max({0}, {p})"),
    "ts_argmin": (1, "window", "ts_argmin({0}, {p})"),
    "ts_argmax": (1, "window", "ts_argmax({0}, {p})"),
    "ts_rank": (1, "window", "ts_rank({0}, {p})"),
    "ts_sum": (1, "window", "ts_sum({0}, {p})"),
    "ts_product": (1, "window", "ts_product({0}, {p})"),
    "ts_std": (1, "window", "ts_std({0}, {p})"),
}


@dataclass(frozen=True)
class Tree:
    """A function with its children and parameter, a terminal, or a constant (a name that is a number)."""

    name: str
    children: tuple[Tree, ...] = ()
    parameter: float = 0

    @property
    def size(self) -> int:
        return 1 + sum(c.size for c in self.children)

    @property
    def depth(self) -> int:
        """Steps to the farthest leaf."""
        return max((1 + c.depth for c in self.children), default=0)

    @property
    def reads_data(self) -> bool:
        return self.name in TERMINALS if not self.children else any(c.reads_data for c in self.children)

    def text(self) -> str:
        return self.name if not self.children else FUNCTIONS[self.name][2].format(*(f"({c.text()})" for c in self.children), p=f"{self.parameter:.12g}")

    def nodes(self, path: tuple[int, ...] = ()) -> list[tuple[int, ...]]:
        return [path, *(p for i, c in enumerate(self.children) for p in c.nodes((*path, i)))]

    def at(self, path: tuple[int, ...]) -> Tree:
        return self if not path else self.children[path[0]].at(path[1:])

    def put(self, path: tuple[int, ...], tree: Tree) -> Tree:
        if not path:
            return tree
        return replace(self, children=tuple(c.put(path[1:], tree) if i == path[0] else c for i, c in enumerate(self.children)))

    @classmethod
    def read(cls, x: dict) -> Tree:
        return cls(x["name"], tuple(map(cls.read, x["children"])), x["parameter"])


CHANGES = {"crossover": 0.25, "subtree": 0.18, "delete": 0.12, "insert": 0.12, "point": 0.10, "window": 0.08, "constant": 0.05, "hoist": 0.05, "random": 0.05}


@dataclass(frozen=True)
class Settings:
    size: int = 1000
    generations: int = 3
    seed: int = 1
    elite: int = 1
    tournament: int = 20
    changes: dict[str, float] = field(default_factory=lambda: dict(CHANGES))
    parsimony: float = 0.0001
    least_days: int = 60
    fame: int = 100
    components: int = 100
    first_depth: tuple[int, int] = (1, 4)
    constants: tuple[float, float] | None = (-1.0, 1.0)
    #: Depth and nodes allowed in each generation; the last holds from there on.
    limits: tuple[tuple[int, int], ...] = ((4, 31), (6, 63), (8, 127))
    mode: str = "none"

    def __post_init__(self) -> None:
        for name in ("size", "generations", "elite", "tournament", "fame", "components", "least_days"):
            v = getattr(self, name)
            if isinstance(v, bool) or int(v) != v or v < 1:
                raise ValueError(f"{name} must be a whole number of 1 or more")
        if not 1 <= self.first_depth[0] <= self.first_depth[1] <= self.limits[-1][0]:
            raise ValueError("first_depth must be a range within the last limit")
        if max(self.tournament, self.elite) > self.size:
            raise ValueError("tournament and elite cannot exceed size")
        if not self.components <= self.fame <= self.size * self.generations:
            raise ValueError("components, fame and size times generations must not fall")
        if set(self.changes) - set(CHANGES) or any(not 0 <= p <= 1 for p in self.changes.values()) or abs(sum(self.changes.values()) - 1) > 1e-9:
            raise ValueError(f"changes must be shares of {sorted(CHANGES)} that sum to one")
        if self.parsimony < 0 or self.mode not in transforms.MODES:
            raise ValueError("parsimony must not be negative, mode one of transforms.MODES")


def _leaf(rng: random.Random, settings: Settings) -> Tree:
    if settings.constants and rng.random() < 1 / (len(TERMINALS) + 1):
        return Tree(f"{rng.uniform(*settings.constants):.12g}")
    return Tree(rng.choice(TERMINALS))


def _parameter(rng: random.Random, kind: str) -> float:
    return rng.choice(WINDOWS) if kind == "window" else rng.choice(EXPONENTS) if kind == "exponent" else 0


def grow(rng: random.Random, depth: int, full: bool = False, settings: Settings | None = None) -> Tree:
    """A random tree of at most depth steps; full: of exactly as many."""
    settings = settings or Settings()
    if depth < 1 or (not full and rng.random() < 0.3):
        return _leaf(rng, settings)
    name = rng.choice(list(FUNCTIONS))
    n, kind, _ = FUNCTIONS[name]
    return Tree(name, tuple(grow(rng, depth - 1, full, settings) for _ in range(n)), _parameter(rng, kind))


def mutate(rng: random.Random, tree: Tree, kind: str, settings: Settings | None = None) -> Tree:
    """A new subtree, another parameter, constant or function of the same kind, a node less, a node more, or a part alone."""
    settings = settings or Settings()
    paths = tree.nodes()
    if kind in ("window", "constant"):
        fits = (lambda x: x.children and FUNCTIONS[x.name][1]) if kind == "window" else (lambda x: not x.children and x.name not in TERMINALS)
        paths = [p for p in paths if fits(tree.at(p))]
        if not paths:
            kind, paths = "subtree", tree.nodes()
    path = rng.choice(paths)
    node = tree.at(path)
    if kind == "window":
        return tree.put(path, replace(node, parameter=_parameter(rng, FUNCTIONS[node.name][1])))
    if kind == "constant":
        lo, hi = settings.constants or (-1.0, 1.0)
        return tree.put(path, Tree(f"{min(hi, max(lo, float(node.name) + rng.gauss(0, (hi - lo) / 10))):.12g}"))
    if kind == "point" and node.children:
        same = [f for f, (n, k, _) in FUNCTIONS.items() if (n, k) == FUNCTIONS[node.name][:2]]
        return tree.put(path, replace(node, name=rng.choice(same)))
    if kind == "point":
        return tree.put(path, _leaf(rng, settings))
    if kind == "delete" and node.children:
        return tree.put(path, rng.choice(node.children))
    if kind == "insert":
        name = rng.choice([f for f, (n, _, _) in FUNCTIONS.items() if n == 1])
        return tree.put(path, Tree(name, (node,), _parameter(rng, FUNCTIONS[name][1])))
    if kind == "hoist":
        return node
    return tree.put(path, grow(rng, 3, settings=settings))


def cross(rng: random.Random, a: Tree, b: Tree) -> Tree:
    return a.put(rng.choice(a.nodes()), b.at(rng.choice(b.nodes())))


#: What the distinct parts of the expressions of one plan may cost together: a window each, more for those that are dear.
PLAN_COST = 160


def oriented(tree: Tree, ic: float) -> Tree:
    """The tree whose IC is not negative: itself, or its negation, which of a negation is what stands in it."""
    if ic >= 0:
        return tree
    return tree.children[0] if tree.name == "neg" else Tree("neg", (tree,))


def population_ic(panel: DataFrame, expressions: dict[int, str], mode: str = "none", days: DataFrame | None = None) -> DataFrame:
    """(expr_id, n_days, mean_ic, ic_std, pairs) of all expressions in one plan over one panel that has fwd.

    Parts that expressions share are computed once. mode: how transforms.preprocess prepares each factor; the panel then
    has _entry and the mode's styles. days: the sample, applied once the factors are computed on full history.
    """
    wide = factors(panel, {f"_f{k}": text for k, text in expressions.items()})
    wide = wide if days is None else wide.join(F.broadcast(days.select("day")), "day", "left_semi")
    names = [f"_f{k}" for k in expressions]
    if mode == "none":
        rows = wide.select("t", "code", "fwd", *names).unpivot(["t", "code", "fwd"], names, "expr", "factor")
    else:
        rows = None
        for n in names:
            part = transforms.preprocess(wide.withColumn("factor", F.col(n)).drop(*names), mode).select("t", "code", "fwd", F.lit(n).alias("expr"), "factor")
            rows = part if rows is None else rows.unionByName(part)
    rows = rows.withColumn("expr_id", F.substring("expr", 3, 9).cast("int")).withColumn("factor", F.round(finite(F.col("factor")), 9))
    daily = rank_ic(rows, ("expr_id", "t"))
    return daily.groupBy("expr_id").agg(F.count("ic").alias("n_days"), F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("ic_std"), F.sum("n").alias("pairs"))


def evaluate_population(panel: DataFrame, expressions: dict[int, str], mode: str = "none", days: DataFrame | None = None, most: int = PLAN_COST) -> DataFrame:
    """population_ic of any number of expressions: cut into plans by what their distinct parts cost, related ones together.

    The panel is read by every plan: give it stored.
    """
    out = None
    for part in batches(expressions, most):
        found = population_ic(panel, part, mode, days)
        out = found if out is None else out.unionByName(found)
    return out


def context(panel: DataFrame, settings: Settings, horizon: int = 1, first=None, last=None) -> tuple[DataFrame, DataFrame | None]:
    """What every expression of a search is scored on: the panel with label, reasons and styles, and the sample's days."""
    rows = labels.forward_open_return(panel, horizon)
    if settings.mode == "paper_local":
        rows = transforms.with_reasons(rows)
    rows = transforms.with_styles(rows, transforms.styles_of(settings.mode))
    days = None
    if first is not None or last is not None:
        days = labels.sample_window(panel.select("day").distinct(), first, last, horizon)
    return rows.persist(), days


def scorer(panel: DataFrame, settings: Settings, most: int = PLAN_COST, days: DataFrame | None = None) -> Callable[[list[str]], dict[str, dict]]:
    """A function from expressions to results (ic, days, std, pairs, or error); one that cannot be computed does not stop the others.

    Expressions that share parts are scored in one plan, as many as cost `most` together. Only errors of an expression become results; those of the cluster go on up, and the search can be resumed.
    """

    def evaluate(texts: list[str]) -> dict[str, dict]:
        out: dict[str, dict] = {}
        able = []
        for t in texts:
            try:
                parse(t)
                able.append(t)
            except ExpressionError as e:
                out[t] = {"ic": None, "error": f"ExpressionError: {str(e)[:500]}"}
        for some in batches(dict(enumerate(able)), most):
            part = dict(enumerate(some.values()))
            try:
                rows = {r.expr_id: r for r in population_ic(panel, part, settings.mode, days).collect()}
            except FACTOR_ERRORS as e:
                if len(part) > 1:
                    for t in part.values():
                        out |= evaluate([t])
                else:
                    out[part[0]] = {"ic": None, "error": f"{type(e).__name__}: {str(e)[:500]}"}
                continue
            for k, t in part.items():
                r = rows.get(k)
                enough = r is not None and r.n_days >= settings.least_days
                out[t] = {"ic": r.mean_ic, "days": r.n_days, "std": r.ic_std, "pairs": r.pairs, "error": ""} if enough else {"ic": None, "error": f"an IC on {r.n_days if r else 0} days, {settings.least_days} are needed"}
        return out

    return evaluate


def front(scored: list[dict]) -> list[dict]:
    """Those that no other beats in both IC and size."""
    out, best = [], float("-inf")
    for x in sorted(scored, key=lambda x: (x["nodes"], -x["ic"], x["expression"])):
        if x["ic"] > best or out and x["ic"] == best and x["nodes"] == out[-1]["nodes"]:
            out.append(x)
            best = x["ic"]
    return out


def spread(scored: list[dict], limit: int) -> list[dict]:
    """At most limit of scored: the best, and the others spread evenly over the sizes."""
    order = sorted(scored, key=lambda x: (x["nodes"], -x["ic"], x["expression"]))
    if len(order) <= limit:
        return order
    best = min(order, key=lambda x: (-x["ic"], x["nodes"], x["expression"]))
    places = [order[round(k * (len(order) - 1) / max(1, limit - 1))] for k in range(limit)]
    rest = sorted(order, key=lambda x: (-x["ic"], x["nodes"], x["expression"]))
    kept = {x["expression"]: x for x in [best, *places, *rest][::-1]}
    first = list(dict.fromkeys(x["expression"] for x in [best, *places, *rest]))[:limit]
    return [kept[e] for e in first]


def ranked(scored: list[dict], limit: int) -> list[dict]:
    """At most limit of scored by falling rank, with rank: 1 on the front, 2 on that of the rest, and so on."""
    left, out, rank = {x["expression"]: x for x in scored}, [], 0
    while left and len(out) < limit:
        rank += 1
        now = front(list(left.values()))
        chosen = sorted(spread(now, limit - len(out)), key=lambda x: (-x["ic"], x["nodes"], x["expression"]))
        out += [{**x, "rank": rank} for x in chosen]
        for x in now:
            del left[x["expression"]]
    return out


@dataclass
class Run:
    """Where a search stands: all of it can be written down and gone on from."""

    generation: int = 0
    people: list[Tree] = field(default_factory=list)
    fame: dict[str, dict] = field(default_factory=dict)
    random: tuple | None = None

    def written(self) -> dict:
        return {"generation": self.generation, "people": [asdict(p) for p in self.people], "fame": self.fame, "random": self.random}

    @classmethod
    def read(cls, x: dict) -> Run:
        state = (x["random"][0], tuple(x["random"][1]), x["random"][2]) if x["random"] else None
        return cls(x["generation"], list(map(Tree.read, x["people"])), x["fame"], state)


def _result(value) -> dict:
    return value if isinstance(value, dict) else {"ic": value, "error": "" if value is not None else "no value"}


def search(evaluate: Callable[[list[str]], dict], settings: Settings, cache: dict[str, dict] | None = None, run: Run | None = None, after: Callable[[Run, dict], None] | None = None) -> list[dict]:
    """The hall of fame by Pareto rank: expressions signed so that their IC is positive. cache holds results by canonical text.

    run: where to go on from. after: called with the run and the results once a generation is done.
    """
    rng = random.Random(settings.seed)
    cache, run = cache if cache is not None else {}, run or Run()
    if run.random:
        rng.setstate(run.random)
    if not run.people and not run.generation:
        lo, hi = settings.first_depth
        run.people = [grow(rng, rng.randint(lo, hi), i % 2 == 0, settings) for i in range(settings.size)]
    names, shares = zip(*settings.changes.items())
    while run.generation < settings.generations:
        depth, most = settings.limits[min(run.generation, len(settings.limits) - 1)]
        keys = {canonical(p.text()): p for p in run.people if p.size <= most and p.depth <= depth and p.reads_data}
        cache |= {k: _result(v) for k, v in evaluate([k for k in keys if k not in cache]).items()}
        scored = []
        for key, p in keys.items():
            ic = cache[key].get("ic") if key in cache else None
            if ic is not None:
                # What is scored, kept and bred from is the tree with its sign: one that was negated loses that node.
                signed = oriented(p, ic)
                scored.append((abs(ic) - settings.parsimony * signed.size, key, signed))
                run.fame[key] = {"expression": canonical(signed.text()), "raw": key, "direction": 1 if ic >= 0 else -1, "ic": abs(ic), "nodes": signed.size}
        run.fame = {x["raw"]: {k: v for k, v in x.items() if k != "rank"} for x in ranked(list(run.fame.values()), settings.fame)}
        scored.sort(key=lambda x: (-x[0], x[1]))
        pick = lambda: min(rng.sample(scored, min(settings.tournament, len(scored))), key=lambda x: (-x[0], x[1]))[2]  # noqa: B023, E731
        people = [p for *_, p in scored[: settings.elite]]
        while len(people) < settings.size:
            kind = rng.choices(names, shares)[0]
            child = cross(rng, pick(), pick()) if scored and kind == "crossover" else mutate(rng, pick(), kind, settings) if scored and kind != "random" else grow(rng, settings.first_depth[1], settings=settings)
            people.append(child)
        run.people, run.generation, run.random = people, run.generation + 1, rng.getstate()
        if after:
            after(run, cache)
    return ranked(list(run.fame.values()), settings.components)


class Campaign:
    """A search kept in a folder: checkpoint, results of all expressions, and tests of what it found. One holds it at a time."""

    def __init__(self, spark: SparkSession, folder: str, settings: Settings):
        self.spark, self.folder, self.settings = spark, folder.rstrip("/"), settings

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def cache(self) -> dict[str, dict]:
        return {x["expression"]: {k: v for k, v in x.items() if k != "expression"} for x in store.read_lines(self.spark, self._path("results.jsonl"))}

    def find(self, evaluate: Callable[[list[str]], dict]) -> list[dict]:
        """Go on from the checkpoint, if it is of the same settings, to the end of the search."""
        wanted = json.loads(json.dumps(asdict(self.settings)))
        kept = store.read_json(self.spark, self._path("checkpoint.json"))
        if kept and kept["settings"] != wanted:
            raise ValueError("the folder holds a search with other settings")

        def after(run: Run, cache: dict) -> None:
            store.write_lines(self.spark, self._path("results.jsonl"), ({"expression": k, **v} for k, v in sorted(cache.items())))
            store.write_json(self.spark, self._path("checkpoint.json"), {"settings": wanted, "run": run.written()})

        return search(evaluate, self.settings, self.cache(), Run.read(kept["run"]) if kept else None, after)

    def test(self, panel: DataFrame, found: list[dict], names: str = "candidate", **sample) -> list[dict]:
        """Each find on another sample: profitability, and the IC standard for those that pass it. Tests done are kept."""
        out = []
        for k, x in enumerate(found, 1):
            path = self._path(f"tests/{names}_{k}.json")
            old = store.read_json(self.spark, path)
            if old and old["expression"] == x["expression"] and old["status"] == "completed":
                out.append(old)
                continue
            record = {"name": f"{names}_{k}", "expression": x["expression"], "raw": x["raw"], "direction": x["direction"], "profitable": False, "ic_passed": None, "passed": False}
            try:
                first = standards.run_standard(panel, x["expression"], "profitability_test", **sample)
                record |= {"profitable": first["passed"], "profitability": first["metrics"]}
                if first["passed"]:
                    second = standards.run_standard(panel, x["expression"], "ic_test", **sample)
                    record |= {"ic_passed": second["passed"], "ic": second["metrics"], "passed": second["passed"]}
                record["status"] = "completed"
            except FACTOR_ERRORS as e:
                record |= {"status": "failed", "error": f"{type(e).__name__}: {str(e)[:2000]}"}
            record = json.loads(json.dumps(record, default=str).replace("NaN", "null").replace("-Infinity", "null").replace("Infinity", "null"))
            store.write_json(self.spark, path, record)
            out.append(record)
        return out

    def run(self, panel: DataFrame, train: dict, test: dict, horizon: int = 1) -> dict:
        """Search on the days of train (first, last), test on those of test; what passed both standards."""
        lock = self._path("lock")
        if not store.claim(self.spark, lock):
            raise ValueError(f"{lock} is there: another run holds the folder, or one ended without giving it back")
        try:
            rows, days = context(panel, self.settings, horizon, **train)
            found = self.find(scorer(rows, self.settings, days=days))
            rows.unpersist()
            tests = self.test(panel, found, horizon=horizon, **test)
            summary = {"found": found, "tests": tests, "passed": [x["expression"] for x in tests if x["passed"]]}
            store.write_json(self.spark, self._path("summary.json"), summary)
            return summary
        finally:
            store.release(self.spark, lock)
