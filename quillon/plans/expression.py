"""The expression language over a panel: Python syntax, a closed set of names, compiled to DataFrame columns.

Python's own parser reads the text and nothing is evaluated. Each rolling or cross-sectional call becomes a named
column, so windows never nest; equal sub-expressions become one column, also across expressions that are compiled
together. Columns are not added one by one but in rounds: all that are ready and share a partitioning at once, so that
the plan changes between codes and days as seldom as the expressions allow.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import rolling as R
from quillon.functions import rules as E

SYMBOLS = ("c", "o", "h", "l", "vol", "amt", "vwap", "cap", "limit", "st")
NUMPY = ("abs", "clip", "exp", "inf", "isfinite", "isnan", "log", "log1p", "maximum", "minimum", "nan", "sign", "sqrt", "where")
_BINARY = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.FloorDiv: "//", ast.Mod: "%", ast.Pow: "**", ast.BitAnd: "&", ast.BitOr: "|"}
_COMPARE = {ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Eq: "==", ast.NotEq: "!="}

#: Rolling functions by name: how many panels and how many whole numbers they take.
TIME = {
    "ts_mean": (1, 1), "ts_std": (1, 1), "ts_sum": (1, 1), "ts_min": (1, 1), "ts_max": (1, 1), "ts_median": (1, 1), "ts_product": (1, 1), "ts_count": (1, 1),
    "ts_corr": (2, 1), "ts_cov": (2, 1), "ts_rank": (1, 1), "ts_argmax": (1, 1), "ts_argmin": (1, 1), "delay": (1, 1), "delta": (1, 1), "pct": (1, 1),
    "decay_linear": (1, 1), "ts_linear_reg_slope": (1, 1), "ts_cum_sum": (1, 0), "ts_accumulate_positive_return": (1, 0),
}
DAY = {"rank_cs": 0, "winsorize_cs": 2, "zscore_cs": 0, "scale_cs": 1}
PLAIN = ("abs", "log", "log1p", "sqrt", "exp", "sign", "signed_power", "where", "elementwise_min", "elementwise_max")
OPERATORS = (*TIME, *DAY, *PLAIN, "ts_sma", "adv")


class ExpressionError(ValueError):
    """The text is not an expression of this language."""


@dataclass(frozen=True)
class Value:
    """A panel of numbers or of flags, or one number."""

    column: Column | None
    kind: str
    number: float = 0.0
    #: Whether the column is one of the frame's, so that naming it twice costs nothing.
    simple: bool = False

    @property
    def as_number(self) -> Column:
        if self.kind == "scalar":
            return F.lit(float(self.number)) if not math.isnan(self.number) else F.lit(None).cast("double")
        return self.column.cast("double") if self.kind == "flag" else self.column


def parse(text: str) -> ast.expr:
    """The syntax tree of an allowed expression."""
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise ExpressionError(f"not an expression: {text}") from e
    allowed = (ast.BinOp, ast.UnaryOp, ast.Compare, ast.Call, ast.Name, ast.Constant, ast.Attribute, ast.Load, ast.keyword, ast.operator, ast.unaryop, ast.cmpop)
    for node in ast.walk(tree):
        if not isinstance(node, allowed):
            raise ExpressionError(f"{type(node).__name__} is not allowed")
        if isinstance(node, ast.Compare) and len(node.ops) > 1:
            raise ExpressionError("chained comparisons are not allowed")
        if isinstance(node, ast.Attribute) and not (isinstance(node.value, ast.Name) and node.value.id == "np" and node.attr in NUMPY):
            raise ExpressionError("only attributes of np from the list are allowed")
        if isinstance(node, ast.keyword) and node.arg is None:
            raise ExpressionError("** arguments are not allowed")
        if isinstance(node, ast.Name) and node.id not in (*SYMBOLS, *OPERATORS, "np"):
            raise ExpressionError(f"unknown name {node.id}")
        if isinstance(node, ast.Constant) and (isinstance(node.value, str | bytes | complex) or node.value is None):
            raise ExpressionError("only numbers are allowed as constants")
    return tree


def symbols_of(text: str) -> list[str]:
    """The panel's columns that an expression reads."""
    return sorted({n.id for n in ast.walk(parse(text)) if isinstance(n, ast.Name) and n.id in SYMBOLS})


def operators_of(text: str) -> list[str]:
    found = set()
    for n in ast.walk(parse(text)):
        if isinstance(n, ast.Call):
            found.add(n.func.id if isinstance(n.func, ast.Name) else f"np.{n.func.attr}")
    return sorted(found)


def _whole(v: Value) -> int:
    if v.kind != "scalar" or math.isnan(v.number) or math.floor(v.number) < 1:
        raise ExpressionError("a window or lag must be a number of 1 or more")
    return int(math.floor(v.number))


@dataclass
class Step:
    """A column to be added: of the row alone (plain), over a code's rows (code) or a day's (day)."""

    name: str
    kind: str
    needs: frozenset[str]
    column: Column | None = None
    #: For code steps that are no window: frame -> frame with the column.
    build: Callable[[DataFrame], DataFrame] | None = None


class Compiler:
    """Gathers the columns that expressions over a panel need, each once, and adds them in rounds."""

    def __init__(self, panel: DataFrame):
        self.panel = panel
        self.steps: list[Step] = []
        self.done: dict[str, tuple[Value, frozenset[str]]] = {}
        self._open: list[set[str]] = [set()]

    def _add(self, kind: str, column: Column | None = None, build=None) -> Column:
        name = f"_x{len(self.panel.columns) + len(self.steps)}"
        self.steps.append(Step(name, kind, frozenset(self._open[-1]), column, build and (lambda frame: build(frame, name))))
        self._open[-1].add(name)
        return F.col(name)

    def _named(self, column: Column, kind: str = "plain") -> Column:
        return self._add(kind, column)

    def _once(self, v: Value) -> Value:
        """The same value as a column of the frame: for rules that name their operands several times."""
        return v if v.simple or v.kind == "scalar" else Value(self._named(v.column), v.kind, simple=True)

    def value(self, node: ast.expr) -> Value:
        key = ast.dump(node)
        if key not in self.done:
            self._open.append(set())
            found = self._value(node)
            self.done[key] = (found, frozenset(self._open.pop()))
        found, needs = self.done[key]
        self._open[-1] |= needs
        return found

    def frame(self) -> DataFrame:
        """The panel with all columns gathered so far."""
        out, left = self.panel, list(self.steps)
        have, kind = set(), "code"
        while left:
            ready = [s for s in left if s.needs <= have]
            now = [s for s in ready if s.kind == "plain"] or [s for s in ready if s.kind == kind]
            if not now:
                kind = "day" if kind == "code" else "code"
                continue
            columns = {s.name: s.column for s in now if s.column is not None}
            out = out.withColumns(columns) if columns else out
            for s in now:
                out = s.build(out) if s.build else out
            have |= {s.name for s in now}
            left = [s for s in left if s.name not in have]
        return out

    def _value(self, node: ast.expr) -> Value:
        if isinstance(node, ast.Constant):
            return Value(None, "scalar", float(node.value))
        if isinstance(node, ast.Name):
            if node.id not in SYMBOLS:
                raise ExpressionError(f"{node.id} must be called")
            return Value(F.col(node.id), "flag" if node.id == "st" else "number", simple=True)
        if isinstance(node, ast.Attribute):
            if node.attr not in ("inf", "nan"):
                raise ExpressionError(f"np.{node.attr} must be called")
            return Value(None, "scalar", float(node.attr))
        if isinstance(node, ast.UnaryOp):
            return self._unary(node)
        if isinstance(node, ast.BinOp):
            return self._binary(_BINARY.get(type(node.op)), self.value(node.left), self.value(node.right))
        if isinstance(node, ast.Compare):
            if type(node.ops[0]) not in _COMPARE:
                raise ExpressionError("membership comparisons are not allowed")
            a, b = self.value(node.left), self.value(node.comparators[0])
            return Value(E.compare(_COMPARE[type(node.ops[0])], a.as_number, b.as_number), "flag")
        return self._call(node)

    def _unary(self, node: ast.UnaryOp) -> Value:
        v = self.value(node.operand)
        if isinstance(node.op, ast.Invert):
            if v.kind != "flag":
                raise ExpressionError("~ needs flags")
            return Value(~v.column, "flag")
        if isinstance(node.op, ast.Not):
            raise ExpressionError("use ~ instead of not")
        sign = -1 if isinstance(node.op, ast.USub) else 1
        return Value(None, "scalar", sign * v.number) if v.kind == "scalar" else Value(sign * v.as_number, "number")

    def _binary(self, op: str | None, a: Value, b: Value) -> Value:
        if op in ("&", "|"):
            if "flag" != a.kind or "flag" != b.kind:
                raise ExpressionError(f"{op} needs flags on both sides")
            return Value(a.column & b.column if op == "&" else a.column | b.column, "flag")
        if op is None or (op == "-" and a.kind == b.kind == "flag"):
            raise ExpressionError("this operation is not defined")
        if a.kind == b.kind == "scalar":
            try:
                x, y = a.number, b.number
                return Value(None, "scalar", {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y, "//": lambda: x // y, "%": lambda: x % y, "**": lambda: x**y}[op]())
            except ZeroDivisionError as e:
                raise ExpressionError("division of numbers by zero") from e
        if op in ("/", "//", "%"):
            a, b = self._once(a), self._once(b)
        x, y = a.as_number, b.as_number
        plain = {"+": lambda: E.no_nan(x + y), "-": lambda: E.no_nan(x - y), "*": lambda: E.no_nan(x * y), "/": lambda: E.divide(x, y), "//": lambda: E.floor_divide(x, y), "%": lambda: E.modulo(x, y), "**": lambda: E.power(x, y)}
        return Value(plain[op](), "number")

    def _arguments(self, node: ast.Call, names: tuple[str, ...]) -> list[Value]:
        values = dict(zip(names, map(self.value, node.args)))
        if len(node.args) > len(names):
            raise ExpressionError("too many arguments")
        for k in node.keywords:
            if k.arg not in names or k.arg in values:
                raise ExpressionError(f"unknown or repeated argument {k.arg}")
            values[k.arg] = self.value(k.value)
        return [values[n] for n in names if n in values]

    def _call(self, node: ast.Call) -> Value:
        name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr
        if name in TIME:
            panels, numbers = TIME[name]
            args = self._arguments(node, (("x", "y")[:panels]) + (("w",) if numbers else ()))
            if len(args) != panels + numbers:
                raise ExpressionError(f"{name} takes {panels + numbers} arguments")
            if name == "ts_count":
                columns = [args[0].column if args[0].kind == "flag" else args[0].as_number != 0]
            else:
                columns = [a.as_number for a in args[:panels]]
            columns = [self._named(c) for c in columns]
            numbers = [_whole(a) for a in args[panels:]]
            if name in R.SLIDING and numbers[0] > R.SLIDE_FROM:
                return Value(self._add("code", build=lambda frame, new: R.slide(frame, new, name, columns[0], numbers[0])), "number", simple=True)
            return Value(self._named(getattr(R, name)(*columns, *numbers), "code"), "number", simple=True)
        if name == "adv":
            x, w = self._arguments(node, ("x", "w"))
            return Value(self._named(R.ts_mean(self._named(x.as_number), _whole(w)), "code"), "number", simple=True)
        if name == "ts_sma":
            x, n, m = self._arguments(node, ("x", "n", "m"))
            if not 0 < m.number <= n.number:
                raise ExpressionError("ts_sma needs 0 < m <= n")
            return Value(self._add("code", build=lambda frame, new: R.ewm(frame, x.as_number, n.number, m.number, new)), "number", simple=True)
        if name in DAY:
            args = self._arguments(node, ("x", "lo", "hi") if name == "winsorize_cs" else ("x", "a"))
            numbers = [a.number for a in args[1:]] or ([1.0] if name == "scale_cs" else [])
            if name == "winsorize_cs" and not (len(numbers) == 2 and 0 <= numbers[0] < numbers[1] <= 1):
                raise ExpressionError("winsorize_cs needs 0 <= lo < hi <= 1")
            return Value(self._named(getattr(R, name)(self._named(args[0].as_number), *numbers[: {"winsorize_cs": 2, "scale_cs": 1}.get(name, 0)]), "day"), "number", simple=True)
        args = [self._once(a) for a in self._arguments(node, ("a", "b", "c"))]
        x = [a.as_number for a in args]
        if name == "where":
            return Value(E.choose(args[0].column if args[0].kind == "flag" else x[0], args[0].kind == "flag", x[1], x[2]), "number")
        if name in ("isnan", "isfinite"):
            return Value(x[0].isNull() if name == "isnan" else E.finite(x[0]).isNotNull(), "flag")
        if name == "clip":
            return Value(F.when(x[0].isNotNull(), F.least(F.greatest(x[0], x[1]), x[2])), "number")
        two = {"signed_power": E.signed_power, "elementwise_min": E.minimum, "elementwise_max": E.maximum, "minimum": E.minimum, "maximum": E.maximum}
        if name in two:
            return Value(two[name](*x), "number")
        one = {"abs": F.abs, "log": E.log, "log1p": E.log1p, "sqrt": E.sqrt, "exp": F.exp, "sign": E.sign}
        return Value(one[name](x[0]), "number")


def factors(panel: DataFrame, texts: dict[str, str], decay: int = 1, shared: bool = True) -> DataFrame:
    """The panel with the finished value of each expression by name, in one plan that computes equal parts once.

    A finished value has no infinity and the run's linear decay. shared: compare parts in their normal form, so that
    a + b and b + a are one.
    """
    if isinstance(decay, bool) or not isinstance(decay, int) or decay < 1:
        raise ExpressionError("decay must be a whole number of 1 or more")
    compiler = Compiler(panel)
    values = {name: compiler.value(parse(canonical(text)) if shared else parse(text)) for name, text in texts.items()}
    if any(v.kind == "scalar" for v in values.values()):
        raise ExpressionError("the expression must depend on the panel")
    frame = compiler.frame().withColumns({name: E.finite(v.as_number) for name, v in values.items()})
    if decay > 1:
        frame = frame.withColumns({name: R.run_decay(F.col(name), decay) for name in texts})
    return frame.select(*[c for c in panel.columns if c not in texts], *texts)


def factor(panel: DataFrame, text: str, name: str = "factor", decay: int = 1) -> DataFrame:
    """The panel with one expression's finished value, computed exactly as it is written."""
    return factors(panel, {name: text}, decay, shared=False)


def cost_of(text: str) -> dict[str, int]:
    """The rolling and cross-sectional parts of an expression, in normal form, and what each costs: windows by size."""
    out: dict[str, int] = {}
    for n in ast.walk(parse(canonical(text))):
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in (*TIME, *DAY, "ts_sma", "adv"):
            out[ast.unparse(n)] = 4 if n.func.id in ("ts_median", "ts_rank", "ts_sma") else 1
    return out


def batches(texts: dict, most: int) -> list[dict]:
    """texts in batches whose distinct rolling and cross-sectional parts cost at most `most`; one alone may cost more.

    Each goes where it shares most: the batch to which it adds least, of those that have room.
    """
    out: list[tuple[dict, dict[str, int]]] = []
    costs = {k: cost_of(x) for k, x in texts.items()}
    for k in sorted(texts, key=lambda k: (-sum(costs[k].values()), str(k))):
        own = costs[k]
        fits = []
        for i, (_, held) in enumerate(out):
            added = sum(c for part, c in own.items() if part not in held)
            if sum(held.values()) + added <= most:
                fits.append((added, i))
        if fits and (min(fits)[0] < sum(own.values()) or len(fits) == len(out)):
            members, held = out[min(fits)[1]]
        else:
            members, held = {}, {}
            out.append((members, held))
        members[k] = texts[k]
        held |= own
    return [members for members, _ in out]


def canonical(text: str) -> str:
    """A normal form that equal expressions share: constants folded, neutral elements and double signs gone, ranks of
    ranks merged, sides of commutative operations in order. x / x and the like stay: they matter for missing values."""

    def fold(n: ast.expr) -> ast.expr:
        if isinstance(n, ast.UnaryOp):
            x = fold(n.operand)
            if isinstance(n.op, ast.UAdd):
                return x
            if isinstance(n.op, ast.USub) and isinstance(x, ast.UnaryOp) and isinstance(x.op, ast.USub):
                return x.operand
            return ast.UnaryOp(n.op, x)
        if isinstance(n, ast.BinOp):
            a, b = fold(n.left), fold(n.right)
            va, vb = (x.value if isinstance(x, ast.Constant) else None for x in (a, b))
            if va is not None and vb is not None and type(n.op) in (ast.Add, ast.Sub, ast.Mult):
                return ast.Constant({ast.Add: va + vb, ast.Sub: va - vb, ast.Mult: va * vb}[type(n.op)])
            if isinstance(n.op, ast.Add) and va == 0 or isinstance(n.op, ast.Mult) and va == 1:
                return b
            if isinstance(n.op, ast.Add | ast.Sub) and vb == 0 or isinstance(n.op, ast.Mult | ast.Div) and vb == 1:
                return a
            if isinstance(n.op, ast.Add | ast.Mult) and ast.unparse(b) < ast.unparse(a):
                a, b = b, a
            return ast.BinOp(a, n.op, b)
        if isinstance(n, ast.Compare):
            return ast.Compare(fold(n.left), n.ops, [fold(x) for x in n.comparators])
        if isinstance(n, ast.Call):
            args = [fold(x) for x in n.args]
            if isinstance(n.func, ast.Name) and n.func.id == "rank_cs" and args and isinstance(args[0], ast.Call) and isinstance(args[0].func, ast.Name) and args[0].func.id == "rank_cs":
                return args[0]
            return ast.Call(n.func, args, [ast.keyword(k.arg, fold(k.value)) for k in n.keywords])
        return n

    return ast.unparse(ast.fix_missing_locations(ast.Expression(fold(parse(text)))))
