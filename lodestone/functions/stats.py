"""Statistics from exact integer moments, the same in any order of summation.

Built-in stddev and corr depend on the order of partial sums in their last
digits, and corr divides by zero on a constant group under ANSI mode. These
forms sum integers as DECIMAL and divide once.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def _sum(x: Column, over: WindowSpec | None) -> Column:
    s = F.sum(x.cast("decimal(38,0)"))
    return s.over(over) if over is not None else s


def _n(x: Column, over: WindowSpec | None) -> Column:
    n = F.count(x)
    return n.over(over) if over is not None else n


def mean(x: Column, over: WindowSpec | None = None) -> Column:
    """Sum over count, as double; null without values."""
    s = F.sum(x)
    return F.try_divide((s.over(over) if over is not None else s).cast("double"), _n(x, over).cast("double"))


def stddev(x: Column, over: WindowSpec | None = None) -> Column:
    """Sample standard deviation of integers; null below two values."""
    n = _n(x, over).cast("decimal(19,0)")
    return stddev_of(n, _sum(x, over), _sum(x * x, over))


def stddev_of(n: Column, s: Column, ss: Column) -> Column:
    """From a count, a sum and a sum of squares."""
    spread = (n * ss - s * s).cast("double")
    return F.sqrt(F.try_divide(spread, (n * (n - 1)).cast("double")))


def corr(x: Column, y: Column) -> Column:
    """Pearson correlation of integers; null for a constant side."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return corr_of(F.count(x).cast("decimal(19,0)"), _sum(x, None), _sum(y, None), _sum(x * x, None), _sum(y * y, None), _sum(x * y, None))


def corr_of(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    vx, vy, cov = ((n * a - b * c).cast("double") for a, b, c in ((sxx, sx, sx), (syy, sy, sy), (sxy, sx, sy)))
    return F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy))


def whole(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys)
