"""Column helpers shared by the operators (all built-in expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..log import micros


def r6(c: Column) -> Column:
    """Round doubles to 6 decimals (the cross-engine comparison rule)."""
    return F.round(c.cast("double"), 6)


def us_between(a: Column, b: Column) -> Column:
    """b - a in integer microseconds."""
    return micros(b) - micros(a)


def seconds_between(a: Column, b: Column) -> Column:
    """b - a in seconds as double (divided last, from exact microseconds)."""
    return us_between(a, b) / F.lit(1_000_000.0)


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL when den is 0 (ANSI-safe)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def exact_mean_std(x_us: Column, scale: float = 1_000_000.0) -> tuple[Column, Column]:
    """Mean and sample std of an integer column from exact sums, divided last.

    sum(x) and sum(x^2) are kept as DECIMAL(38,0), so the result does not
    depend on the order in which partial sums arrive; both engines then do
    the same few double operations. std is NULL for one value.
    """
    x = x_us.cast("decimal(38,0)")
    return mean_std_of_sums(F.count(x_us), F.sum(x), F.sum(x * x), scale)


def mean_std_of_sums(n: Column, s1: Column, s2: Column, scale: float = 1_000_000.0) -> tuple[Column, Column]:
    """Mean and sample std (6 decimals) from a count and exact DECIMAL(38,0) sums.

    The squares are centred on a whole number q near the mean before they
    are divided: sum (x - q)^2 = s2 - q (2 s1 - n q), in which no term grows
    beyond about twice s2. It holds while sum(x^2) stays below 5e37: some
    1e11 steps of 120 days in microseconds.
    """
    big = lambda c: c.cast("decimal(38,0)")
    q = big(F.floor(F.try_divide(s1.cast("double"), n.cast("double"))).cast("long"))
    around = (big(s2) - q * (big(s1) + (big(s1) - big(n) * q))).cast("double")
    off = (big(s1) - big(n) * q).cast("double")
    mean = F.try_divide(s1.cast("double"), n.cast("double")) / F.lit(scale)
    var = F.try_divide(around - F.try_divide(off * off, n.cast("double")), (n - 1).cast("double"))
    return mean, F.when(n > 1, r6(F.sqrt(F.greatest(var, F.lit(0.0))) / F.lit(scale)))
