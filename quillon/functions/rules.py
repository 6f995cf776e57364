"""Elementwise functions under the rules of panels.

Missing is null, never NaN. Infinity may appear in the middle of an expression: division by zero gives it, rolling
functions take it as missing, ranks and shifts keep it, and the finished factor drops it. Comparisons with missing are
false, "not equal" is true.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LARGEST = 1.7976931348623157e308
INF = float("inf")


def no_nan(x: Column) -> Column:
    # Names x once: chains of operations would double with each link otherwise.
    return F.nanvl(x, F.lit(None).cast("double"))


def is_finite(x: Column) -> Column:
    """True or false, null for missing. Names x once: a filter repeats what a column stands for each time it is named."""
    return F.abs(x.cast("double")) <= LARGEST


def finite(x: Column) -> Column:
    return F.when(is_finite(x), x)


def divide(a: Column, b: Column) -> Column:
    # The zero branches come first, so the quotient is never taken there (it would be an error).
    quotient = F.when((b == 0) & (a > 0), INF).when((b == 0) & (a < 0), -INF).when((b != 0), a / b)
    return no_nan(quotient)


def floor_divide(a: Column, b: Column) -> Column:
    q = divide(a, b)
    return F.when(q.isin(INF, -INF), q).otherwise(F.floor(F.when(finite(q).isNotNull(), q)).cast("double"))


def modulo(a: Column, b: Column) -> Column:
    """The remainder with the divisor's sign; missing for a zero divisor."""
    r = F.when(b != 0, a % b)
    return no_nan(F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r))


def power(a: Column, b: Column) -> Column:
    return no_nan(F.pow(a, b))


def log(x: Column) -> Column:
    return F.when(x == 0, -INF).otherwise(F.ln(x))


def log1p(x: Column) -> Column:
    return F.when(x == -1, -INF).otherwise(F.log1p(x))


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def sign(x: Column) -> Column:
    return F.signum(x)


def signed_power(x: Column, a: Column) -> Column:
    return no_nan(F.signum(x) * F.pow(F.abs(x), a))


def minimum(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def maximum(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def choose(condition: Column, is_flag: bool, a: Column, b: Column) -> Column:
    """A missing number as condition counts as true, a missing flag as false."""
    holds = F.coalesce(condition, F.lit(False)) if is_flag else condition.isNull() | (condition != 0)
    return F.when(holds, a).otherwise(b)


def compare(op: str, a: Column, b: Column) -> Column:
    result = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": a == b, "!=": a != b}[op]
    return F.coalesce(result, F.lit(op == "!="))
