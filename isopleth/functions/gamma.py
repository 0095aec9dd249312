"""The regularised incomplete gamma function and Bernoulli-Gamma percentiles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the series and steps of the continued fraction; coefficients of Lanczos' approximation (g = 7, fixed values).
TERMS = 200
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(a: Column) -> Column:
    """The logarithm of the gamma function for a > 0, by Lanczos' sum of a itself: log G(a + 1) - log a."""
    total = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        total = total + F.lit(c) / (a + k)
    t = a + 7.5
    return 0.9189385332046727 + (a + 0.5) * F.log(t) - t + F.log(total) - F.log(a)


def gamma_p(a: Column, x: Column, terms: int = TERMS) -> Column:
    """P(a, x): the share of a gamma distribution of shape a and scale 1 below x; by the series below a + 1, by the continued fraction above."""
    steps = F.sequence(F.lit(1), F.lit(terms))
    front = F.exp(a * F.log(F.greatest(x, F.lit(1e-300))) - x - log_gamma(a))
    series = F.aggregate(steps, F.array(1 / a, 1 / a), lambda s, n: F.array(s[0] * x / (a + n), s[1] + s[0] * x / (a + n)))[1]
    # Lentz: b, c, d and the product h
    b0 = x + 1 - a
    tiny = F.lit(1e-300)
    safe = lambda v: F.when(F.abs(v) < 1e-300, tiny).otherwise(v)

    def step(s: Column, n: Column) -> Column:
        an, b = -n * (n - a), b0 + 2 * n
        d, c = 1 / safe(an * s[1] + b), safe(b + an / s[0])
        return F.array(c, d, s[2] * c * d)

    first = 1 / safe(b0)
    fraction = F.aggregate(steps, F.array(F.lit(1e300), first, first), lambda s, n: step(s, n))[2]
    return F.when(x <= 0, 0.0).when(x < a + 1, front * series).otherwise(1 - front * fraction)


def gamma_moments(v: Column) -> tuple[Column, Column, Column]:
    """Aggregates (dry, shape, scale): the share of values that aren't over 0, and the moments' shape and scale of the others."""
    wet = F.when(v > 0, v)
    dry = 1 - F.count(wet) / F.nullif(F.count(v), F.lit(0))
    mean, var = F.avg(wet), F.nullif(F.var_pop(wet), F.lit(0.0))
    return dry, mean * mean / var, var / mean


def bernoulli_gamma(v: Column, dry: Column, shape: Column, scale: Column) -> Column:
    """The percentile (0 to 1) of v in a mixture of zeros and a gamma distribution: half the dry mass at 0, null where there is no fit."""
    wet = dry + (1 - dry) * gamma_p(shape, v / scale)
    return F.when(v <= 0, dry / 2).otherwise(wet)
