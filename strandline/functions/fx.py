"""Formula functions as Spark Columns with IEEE double rules for missing values.

A missing number is NULL (or NaN).  Arithmetic keeps it missing; comparisons with it are false except
`ne`; results are stored as NULL when not finite.  Comparisons return booleans whose plain conjuncts
still reach the parquet scan; `flag` turns them into 1.0 / 0.0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
EXACT_INTEGER = 2.0**53


def num(c: Column | str | float) -> Column:
    """Operand as a double; plain numbers become literals, strings name columns."""
    if isinstance(c, Column):
        return c.cast("double")
    return F.col(c).cast("double") if isinstance(c, str) else F.lit(float(c))


def once(c, formula) -> Column:
    """formula(c) with a compound operand named once, as the one element of an array: formulas that repeat their
    operand would otherwise grow by a power with every level of nesting."""
    a = num(c)
    if not isinstance(c, Column) or "(" not in str(c):
        return formula(a)
    return F.get(F.transform(F.array(a), formula), F.lit(0))


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != INF)


def finite(c: Column) -> Column:
    """NULL unless a finite number."""
    return F.when(~F.isnan(c) & (F.abs(c) != INF), c)


stored = finite


def as_nan(c: Column) -> Column:
    """Missing as NaN, so that it poisons sums the IEEE way."""
    return F.coalesce(c.cast("double"), F.lit(float("nan")))


def neg(a) -> Column:
    return -num(a)


def add(a, b) -> Column:
    return num(a) + num(b)


def sub(a, b) -> Column:
    return num(a) - num(b)


def mul(a, b) -> Column:
    return num(a) * num(b)


def div(a, b) -> Column:
    """a / b where a zero divisor gives an infinity or NaN instead of an error."""
    return once(b, lambda y: once(a, lambda x: F.when(y == 0, x * F.pow(y, F.lit(-1.0))).otherwise(F.try_divide(x, y))))


def power(a, b) -> Column:
    return once(b, lambda y: once(a, lambda x: F.when((y == 0) | (x == 1), F.lit(1.0)).otherwise(F.pow(x, y))))


def gt(a, b) -> Column:
    return once(a, lambda x: (x > num(b)) & ~F.isnan(x))


def lt(a, b) -> Column:
    return once(b, lambda y: (num(a) < y) & ~F.isnan(y))


def ge(a, b) -> Column:
    return once(a, lambda x: (x >= num(b)) & ~F.isnan(x))


def le(a, b) -> Column:
    return once(b, lambda y: (num(a) <= y) & ~F.isnan(y))


def eq(a, b) -> Column:
    return once(a, lambda x: (x == num(b)) & ~F.isnan(x))


def ne(a, b) -> Column:
    return once(a, lambda x: F.coalesce((x != num(b)) | F.isnan(x), F.lit(True)))


def truthy(a) -> Column:
    """A number used as a condition inside and / or: missing counts as true."""
    return once(a, lambda x: F.coalesce((x != 0) | F.isnan(x), F.lit(True)))


def and_(*conds: Column) -> Column:
    return reduce(lambda x, y: x & y, conds)


def or_(*conds: Column) -> Column:
    return reduce(lambda x, y: x | y, [F.coalesce(c, F.lit(False)) for c in conds])


def flag(cond: Column) -> Column:
    return F.coalesce(cond.cast("double"), F.lit(0.0))


def keep(a) -> Column:
    """A number used as a whole filter: finite and not zero."""
    return once(a, lambda x: is_finite(x) & (x != 0))


def sqrt(a) -> Column:
    return F.sqrt(num(a))


def abs_(a) -> Column:
    return F.abs(num(a))


def sin(a) -> Column:
    return F.sin(num(a))


def cos(a) -> Column:
    return F.cos(num(a))


def tan(a) -> Column:
    return F.tan(num(a))


def asin(a) -> Column:
    return F.asin(num(a))


def acos(a) -> Column:
    return F.acos(num(a))


def atan(a) -> Column:
    return F.atan(num(a))


def atan2(y, x) -> Column:
    return F.atan2(num(y), num(x))


def hypot(a, b) -> Column:
    return F.hypot(num(a), num(b))


def exp(a) -> Column:
    return F.exp(num(a))


def _log(a, fn) -> Column:
    return once(a, lambda x: F.when(x == 0, F.lit(-INF)).when(x < 0, F.lit(float("nan"))).otherwise(fn(x)))


def ln(a) -> Column:
    return _log(a, F.ln)


def log10(a) -> Column:
    return _log(a, F.log10)


def _whole(a, fn) -> Column:

    def formula(x: Column) -> Column:
        big = F.isnan(x) | (F.abs(x) >= EXACT_INTEGER)
        return F.when(big, x).otherwise(fn(F.when(~big, x)).cast("double"))

    return once(a, formula)


def floor(a) -> Column:
    return _whole(a, F.floor)


def ceil(a) -> Column:
    return _whole(a, F.ceil)


def round_(a) -> Column:
    """Halves away from zero."""
    return _whole(a, F.round)


def sign(a) -> Column:
    """+1 for zero, -1 for negative zero."""
    zero = lambda x: F.when(F.pow(x, F.lit(-1.0)) < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return once(a, lambda x: F.when(x == 0, zero(x)).otherwise(F.signum(x)))


def deg(a) -> Column:
    return F.degrees(num(a))


def rad(a) -> Column:
    return F.radians(num(a))


def _present(a) -> Column:
    return F.nanvl(num(a), F.lit(None).cast("double"))


def least(*args) -> Column:
    """Smallest present argument; +inf when none is."""
    return F.least(F.lit(INF), F.lit(INF), *[_present(a) for a in args])


def greatest(*args) -> Column:
    return F.greatest(F.lit(-INF), F.lit(-INF), *[_present(a) for a in args])
