"""Probabilities, categories and scores as column expressions; the normal CDF also as SQL text for any engine."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: W. J. Cody's rational approximations of erf and erfc (Math. Comp. 23, 1969), the last coefficient of A, C and P leads.
A = [3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3, 1.85777706184603153e-1]
B = [2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3]
C = [5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3, 2.15311535474403846e-8]
D = [1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3]
P = [3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2]
Q = [2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3]


def _horner_sql(coefficients: list[float], z: str) -> str:
    return reduce(lambda acc, c: f"({acc} * {z} + {c!r}e0)" if "e" not in repr(c) else f"({acc} * {z} + {c!r})", coefficients[1:], f"{coefficients[0]!r}" + ("" if "e" in repr(coefficients[0]) else "e0"))


def normal_cdf_sql(x: str) -> str:
    """The standard normal CDF of an SQL expression, as text that Spark and DuckDB both take."""
    y = f"(abs({x}) / sqrt(2e0))"
    small = f"{y} * {_horner_sql([A[4], *A[:4]], f'({y}*{y})')} / {_horner_sql([1.0, *B], f'({y}*{y})')}"
    middle = f"(1e0 - exp(-({y}*{y})) * {_horner_sql([C[8], *C[:8]], y)} / {_horner_sql([1.0, *D], y)})"
    w = f"(1e0/({y}*{y}))"
    large = f"(1e0 - exp(-({y}*{y})) / {y} * ({1 / math.sqrt(math.pi)!r}e0 - {w} * {_horner_sql([P[5], *P[:5]], w)} / {_horner_sql([1.0, *Q], w)}))"
    return f"(5e-1 + 5e-1 * sign({x}) * (CASE WHEN {y} <= 0.46875e0 THEN {small} WHEN {y} <= 4e0 THEN {middle} ELSE {large} END))"


def normal_cdf(x: Column, spark_name: str = "_x") -> Column:
    """The standard normal CDF, JVM-side (no erf exists there)."""
    poly = lambda cs, z: reduce(lambda acc, c: acc * z + c, cs[1:], F.lit(cs[0]))
    y = F.abs(x) / math.sqrt(2)
    z, w = y * y, 1.0 / F.greatest(y * y, F.lit(1e-300))
    small = y * poly([A[4], *A[:4]], z) / poly([1.0, *B], z)
    middle = 1.0 - F.exp(-z) * poly([C[8], *C[:8]], y) / poly([1.0, *D], y)
    large = 1.0 - F.exp(-z) / F.greatest(y, F.lit(1e-300)) * (1 / math.sqrt(math.pi) - w * poly([P[5], *P[:5]], w) / poly([1.0, *Q], w))
    return 0.5 + 0.5 * F.signum(x) * F.when(y <= 0.46875, small).when(y <= 4, middle).otherwise(large)


def tercile(y: Column, t33: Column, t67: Column) -> Column:
    """0 below the first edge, 1 below the second, else 2."""
    return F.when(t33 > y, 0).when(t67 > y, 1).otherwise(2)


def tercile_closed(y: Column, q33: Column, q67: Column) -> Column:
    """The other convention: 0 up to and with the first edge, 2 from the second on, else 1."""
    return F.when(y <= q33, 0).when(y >= q67, 2).otherwise(1)


def with_terciles(rows: DataFrame, mean: Column, sigma: Column, t33: Column, t67: Column, name: str = "p") -> DataFrame:
    """rows with the three probabilities of a normal forecast as an array.

    The cumulative ones are columns of a step of their own, so that each is generated once however often the next steps use it.
    """
    sigma = F.greatest(sigma, F.lit(1e-9))
    rows = rows.withColumns({"_lo": normal_cdf((t33 - mean) / sigma), "_hi": normal_cdf((t67 - mean) / sigma)})
    return rows.withColumn(name, F.array(*renormalised([F.col("_lo"), F.col("_hi") - F.col("_lo"), 1 - F.col("_hi")]))).drop("_lo", "_hi")


def renormalised(p: list[Column], floor: float = 1e-9) -> list[Column]:
    """Probabilities held within floor and 1, then scaled to sum to 1."""
    held = [F.greatest(F.lit(floor), F.least(F.lit(1.0), x)) for x in p]
    total = reduce(lambda a, b: a + b, held)
    return [x / total for x in held]


def rps(p0: Column, p1: Column, category: Column) -> Column:
    """Ranked probability score of three categories: half the sum of squared differences of the cumulative probabilities."""
    first = p0 - (category <= 0).cast("double")
    second = p0 + p1 - (category <= 1).cast("double")
    return 0.5 * (first * first + second * second)


def skill(score: Column, reference: Column) -> Column:
    """1 - sum(score) / sum(reference): sums first, then their ratio."""
    return 1 - F.try_divide(F.sum(score), F.sum(reference))


def hit(p: Column, category: Column) -> Column:
    """Whether the most probable category (the first of equals) happened."""
    return (F.array_position(p, F.array_max(p)) - 1 == category).cast("double")


def t_quantile(p: float, df: int) -> float:
    """Quantile of Student's t, by bisection of its distribution function (driver side)."""
    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def t_two_sided(t: Column, df: Column) -> Column:
    """The two-sided p of Student's t for whole degrees of freedom, from the finite sum of its distribution; null below one degree."""
    angle = F.atan(F.abs(t) / F.sqrt(df))
    c2, odd = F.pow(F.cos(angle), F.lit(2)), F.pmod(df, F.lit(2)) == 1
    terms = F.greatest(F.when(odd, (df - 3) / 2).otherwise((df - 2) / 2), F.lit(0)).cast("int")
    steps = F.slice(F.sequence(F.lit(1), terms + 1), F.lit(1), terms)
    ratio = lambda j: F.when(odd, 2 * j / (2 * j + 1.0)).otherwise((2 * j - 1) / (2.0 * j))
    first = F.when(odd, F.cos(angle)).otherwise(F.lit(1.0))
    pair = F.array(first, first)  # the last term and the sum
    total = F.aggregate(steps, pair, lambda made, j: F.array(made[0] * c2 * ratio(j), made[1] + made[0] * c2 * ratio(j)))[1]
    inside = F.when(df == 1, 2 * angle / F.pi()).when(odd, 2 / F.pi() * (angle + F.sin(angle) * total)).otherwise(F.sin(angle) * total)
    return F.when(df >= 1, F.greatest(1 - inside, F.lit(0.0)))


def t_cdf(t: float, df: float) -> float:
    """Distribution function of Student's t, by the incomplete beta's continued fraction."""
    x = df / (df + t * t)
    tail = 0.5 * _beta_inc(df / 2, 0.5, x)
    return 1 - tail if t > 0 else tail


def _beta_inc(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + num * d), 1 + num / c
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h
