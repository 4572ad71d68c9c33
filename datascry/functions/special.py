"""Tail probabilities and false-discovery adjustment, evaluated in the JVM.

The continued fractions run as a fold over a fixed sequence, so p-values stay in
the plan beside the statistics they belong to.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_TINY, _STEPS = 1e-300, 300
INF = float("inf")


def lgamma(x: Column) -> Column:
    """Log-gamma for x > 0: Stirling's series after moving x up by eight."""
    up = x + 8.0
    series = (
        (up - 0.5) * F.log(up)
        - up
        + 0.5 * math.log(2 * math.pi)
        + F.lit(1.0) / (12.0 * up)
        - F.lit(1.0) / (360.0 * up * up * up)
        + F.lit(1.0) / (1260.0 * F.pow(up, 5))
        - F.lit(1.0) / (1680.0 * F.pow(up, 7))
    )
    down = sum((F.log(x + float(i)) for i in range(1, 8)), F.log(x))
    return series - down


def _nonzero(x: Column) -> Column:
    return F.when(F.abs(x) < _TINY, F.lit(_TINY)).otherwise(x)


def _beta_fraction(x: Column, a: Column, b: Column) -> Column:
    """Lentz evaluation of the incomplete beta's continued fraction."""

    def step(acc: Column, k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        even = m * (b - m) * x / ((a + 2.0 * m - 1.0) * (a + 2.0 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2.0 * m) * (a + 2.0 * m + 1.0))
        # terms beyond convergence multiply by one
        t = F.when(k % 2 == 0, even).otherwise(odd)
        d = F.lit(1.0) / _nonzero(1.0 + t * acc["d"])
        c = _nonzero(1.0 + t / acc["c"])
        return F.struct((acc["f"] * c * d).alias("f"), c.alias("c"), d.alias("d"))

    d0 = F.lit(1.0) / _nonzero(1.0 - (a + b) * x / (a + 1.0))
    start = F.struct(d0.alias("f"), F.lit(1.0).alias("c"), d0.alias("d"))
    return F.aggregate(F.sequence(F.lit(2), F.lit(_STEPS)), start, step)["f"]


def _with(fn: Callable[..., Column], *args: Column) -> Column:
    """``fn(*args)`` with each argument evaluated once, however often it is used.

    The arguments become a struct that a lambda reads, so their expressions are
    not copied into the plan wherever the formula mentions them.
    """
    names = [f"a{i}" for i in range(len(args))]
    held = F.struct(*[a.cast("double").alias(n) for n, a in zip(names, args, strict=True)])
    return F.get(F.transform(F.array(held), lambda s: fn(*[s[n] for n in names])), F.lit(0))


def _unit(p: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))


def _inc_beta(x: Column, a: Column, b: Column) -> Column:
    front = F.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * F.log(x) + b * F.log(1.0 - x))
    near = front * _beta_fraction(x, a, b) / a
    far = 1.0 - front * _beta_fraction(1.0 - x, b, a) / b
    inside = F.when(x < (a + 1.0) / (a + b + 2.0), near).otherwise(far)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inside)


def inc_beta(x: Column, a: Column, b: Column) -> Column:
    """Regularised incomplete beta, by whichever side converges."""
    return _with(_inc_beta, x, a, b)


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t; infinite t gives 0."""

    def p(t: Column, df: Column) -> Column:
        tail = inc_beta(df / (df + t * t), df / 2.0, F.lit(0.5))
        return F.when(F.abs(t) == INF, 0.0).when((df > 0) & ~F.isnan(t), _unit(tail))

    return _with(p, t, df)


def f_p(f: Column, d1: Column, d2: Column) -> Column:
    """Upper tail of the F distribution; infinite F gives 0."""

    def p(f: Column, d1: Column, d2: Column) -> Column:
        tail = inc_beta(d2 / (d2 + d1 * f), d2 / 2.0, d1 / 2.0)
        return F.when(f == INF, 0.0).when(f <= 0, 1.0).otherwise(_unit(tail))

    return _with(p, f, d1, d2)


def _chi2_p(x: Column, k: Column) -> Column:
    s, h = k / 2.0, x / 2.0
    front = F.exp(s * F.log(h) - h - lgamma(s))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(1000)),
        F.struct((F.lit(1.0) / s).alias("sum"), (F.lit(1.0) / s).alias("term")),
        lambda acc, n: F.struct((acc["sum"] + acc["term"] * h / (s + n)).alias("sum"), (acc["term"] * h / (s + n)).alias("term")),
    )["sum"]

    def step(acc: Column, n: Column) -> Column:
        an = -n.cast("double") * (n - s)
        base = h + 2.0 * n + 1.0 - s
        d = F.lit(1.0) / _nonzero(an * acc["d"] + base)
        c = _nonzero(base + an / acc["c"])
        return F.struct((acc["f"] * c * d).alias("f"), c.alias("c"), d.alias("d"))

    d0 = F.lit(1.0) / _nonzero(h + 1.0 - s)
    fraction = F.aggregate(
        F.sequence(F.lit(1), F.lit(_STEPS)), F.struct(d0.alias("f"), F.lit(1.0 / _TINY).alias("c"), d0.alias("d")), step
    )["f"]
    tail = F.when(h < s + 1.0, 1.0 - front * series).otherwise(front * fraction)
    return F.when(h <= 0, 1.0).otherwise(_unit(tail))


def chi2_p(x: Column, k: Column) -> Column:
    """Upper tail of chi-square with k degrees of freedom."""
    return _with(_chi2_p, x, k)


def corr_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation; none below four pairs."""

    def p(r: Column, n: Column) -> Column:
        t = r * F.sqrt(F.try_divide(n - 2, F.greatest(F.lit(1e-12), 1.0 - r * r)))
        return F.when(n >= 4, student_p(t, n - 2))

    return F.when(r.isNotNull(), _with(p, r, n))


def adjust(df: DataFrame, p: str = "p", to: str = "p_adj", family: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg within each family; missing p stay missing.

    The family is a list of test results, one per pair or group of columns, and
    so small whatever the table's size.
    """
    by = [F.col(c) for c in family or []] or [F.lit(0)]
    counted = F.col(p).isNotNull() & ~F.isnan(p)
    up = W.partitionBy(*by, counted).orderBy(F.col(p).asc())
    rank = F.row_number().over(up)
    m = F.count(F.lit(1)).over(W.partitionBy(*by, counted))
    out = df.withColumn("_rank", rank).withColumn("_m", m)
    down = W.partitionBy(*by, counted).orderBy(F.col(p).desc(), F.col("_rank").desc()).rowsBetween(W.unboundedPreceding, 0)
    q = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(down))
    return out.withColumn(to, F.when(counted, q)).drop("_rank", "_m")
