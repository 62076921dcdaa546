"""Special functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Relative change of a converged continued fraction.
TOLERANCE = 1e-13
#: Arguments are shifted up to here before the asymptotic series of the gamma ratio.
SHIFT = 20
#: Degrees of freedom beyond which the normal limit helps.
LARGE = 1e6


def _log_gamma_ratio(a: Column) -> Column:
    """log of gamma(a + 1/2) / gamma(a) for a > 0.

    From the asymptotic series at a + SHIFT, and the recurrence of gamma down to a. The
    difference of two log-gammas would cancel for large a.
    """
    z = a + F.lit(float(SHIFT))
    series = F.log(z) / 2 - 1 / (8 * z) + 1 / (192 * F.pow(z, F.lit(3.0))) - 1 / (640 * F.pow(z, F.lit(5.0))) + F.lit(17 / 14336) / F.pow(z, F.lit(7.0))
    down = F.aggregate(F.sequence(F.lit(0), F.lit(SHIFT - 1)), F.lit(0.0), lambda s, i: s - F.log1p(0.5 / (a + i)))
    return series + down


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, evaluated forwards by Lentz's method.

    It needs a number of steps in the order of the root of the larger argument; a row whose
    fraction has not settled by then fails the query.
    """
    steps = F.ceil(6 * F.sqrt(F.greatest(a, b))).cast("int") + 200
    first = 1 / (1 - (a + b) * x / (a + 1))
    start = F.struct(a.alias("a"), b.alias("b"), x.alias("x"), F.lit(1.0).alias("c"), first.alias("d"), first.alias("f"), F.lit(0.0).alias("e"))

    def step(s: Column, m: Column) -> Column:
        own_a, own_b, own_x = s["a"], s["b"], s["x"]
        even = m * (own_b - m) * own_x / ((own_a + 2 * m - 1) * (own_a + 2 * m))
        odd = -(own_a + m) * (own_a + own_b + m) * own_x / ((own_a + 2 * m) * (own_a + 2 * m + 1))
        d1, c1 = 1 / (1 + even * s["d"]), 1 + even / s["c"]
        d2, c2 = 1 / (1 + odd * d1), 1 + odd / c1
        moved = F.struct(
            own_a.alias("a"), own_b.alias("b"), own_x.alias("x"), c2.alias("c"), d2.alias("d"), (s["f"] * c1 * d1 * c2 * d2).alias("f"), F.abs(c2 * d2 - 1).alias("e"),
        )
        return F.when((m > 1) & (s["e"] < TOLERANCE), s).otherwise(moved)

    def settled(s: Column) -> Column:
        return F.when(s["e"] < 1e-10, s["f"]).otherwise(F.raise_error(F.lit("the incomplete beta function did not converge")).cast("double"))

    return F.aggregate(F.transform(F.sequence(F.lit(1), steps), lambda i: i.cast("double")), start, step, settled)


def _normal_square(square: Column, freedom: Column) -> Column:
    """The square of the normal deviate with the same tail as a t of this square, up to a relative error of the order of 1 / freedom²."""
    return freedom * F.log1p(square / freedom) * F.pow((8 * freedom + 1) / (8 * freedom + 3), F.lit(2.0))


def student_two_sided(t: Column, freedom: Column) -> Column:
    """P(|T| >= |t|) of Student's distribution, the regularised incomplete beta function of freedom / (freedom + t²).

    Beyond ``LARGE`` degrees of freedom the fraction would cancel; there the tail is that of the t with
    ``LARGE`` degrees that has the same normal deviate. Null for a null t or a freedom that is not positive.
    """
    t, freedom = t.cast("double"), freedom.cast("double")
    shrink = ((8 * LARGE + 1) / (8 * LARGE + 3)) ** 2
    square = F.when(freedom > LARGE, LARGE * F.expm1(_normal_square(t * t, freedom) / (shrink * LARGE))).otherwise(t * t)
    freedom_used = F.least(freedom, F.lit(LARGE))
    a, half = freedom_used / 2, F.lit(0.5)
    x, rest = freedom_used / (freedom_used + square), square / (freedom_used + square)
    mirrored = x > (a + 1) / (a + 2.5)
    front = F.exp(_log_gamma_ratio(a) - F.lit(math.log(math.pi) / 2) - a * F.log1p(square / freedom_used) + F.log(rest) / 2)
    fraction = _beta_fraction(F.when(mirrored, half).otherwise(a), F.when(mirrored, a).otherwise(half), F.when(mirrored, rest).otherwise(x))
    area = front * fraction / F.when(mirrored, half).otherwise(a)
    value = F.when(mirrored, 1 - area).otherwise(area)
    return F.when(t.isNull() | ~F.coalesce(freedom > 0, F.lit(False)), None).when(t == 0, 1.0).otherwise(value)
