"""Statistics that Spark has no function for, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of the continued fraction; it has settled long before for the arguments that tests give.
STEPS = 200
# Lanczos' coefficients (g = 7) of the logarithm of the gamma function.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: Column) -> Column:
    """The logarithm of gamma of x, for x of 0.5 and above."""
    z = x - 1
    series = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        series = series + F.lit(c) / (z + i)
    t = z + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.log(t) - t + F.log(series)


def incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function of x (0 to 1), by its continued fraction (Lentz), for a and b of 0.5 and above."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    turn = x > (a + 1) / (a + b + 2)  # beyond it the fraction of the other side settles faster
    y, p, q = F.when(turn, 1 - x).otherwise(x), F.when(turn, b).otherwise(a), F.when(turn, a).otherwise(b)
    apart = lambda v: F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)
    given = F.struct(y.alias("y"), p.alias("p"), q.alias("q"))
    d0 = 1 / apart(1 - (p + q) * y / (p + 1))
    start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"), given.alias("v"))

    def half(s: Column, term: Column) -> Column:
        d, c = 1 / apart(1 + term * s["d"]), apart(1 + term / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"), s["v"].alias("v"))

    def step(s: Column, m: Column) -> Column:
        # two terms of the fraction in turn: which of them, from a number that counts both
        k = F.floor((m + 1) / 2).cast("double")
        y, p, q = s["v"]["y"], s["v"]["p"], s["v"]["q"]
        even = k * (q - k) * y / ((p + 2 * k - 1) * (p + 2 * k))
        odd = -(p + k) * (p + q + k) * y / ((p + 2 * k) * (p + 2 * k + 1))
        return half(s, F.when(m % 2 == 1, even).otherwise(odd))

    h = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)["h"]
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(turn, 1 - front * h / p).otherwise(front * h / p)


def student_p(t: Column, degrees: Column) -> Column:
    """The chance of a t so far from 0, on either side, with so many degrees of freedom."""
    n = degrees.cast("double")
    return incomplete_beta(n / (n + t * t), n / 2, F.lit(0.5))


def slope_p(r: Column, n: Column) -> Column:
    """The p-value of a fitted slope, from the correlation of n points: 0 where they lie on a line, null for fewer than 3."""
    degrees = (n - 2).cast("double")
    t = r * F.sqrt(degrees / F.nullif(1 - r * r, F.lit(0.0)))
    return F.when(n > 2, F.coalesce(student_p(t, degrees), F.lit(0.0)))
