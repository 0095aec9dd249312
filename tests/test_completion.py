"""Completed seasons and gamma percentiles against loops and numerical integration."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from isopleth.functions import gamma
from isopleth.operators import completion


@pytest.mark.parametrize("past_only", [False, True])
def test_nearest_years_are_exact(spark, past_only):
    rng = np.random.default_rng(8)
    years, months = range(1980, 2012), [11, 12, 1, 2, 3]
    v = {(c, y, m): float(rng.integers(0, 6)) for c in range(3) for y in years for m in range(1, 13)}
    del v[0, 1990, 12], v[1, 2000, 3]
    frame = spark.createDataFrame([(*k, x) for k, x in v.items()] + [(2, 1985, 1, None)], "cell int, year int, month int, v double").dropDuplicates(["cell", "year", "month"])
    seasons = completion.partial_seasons(frame, ["cell"], months, 3)
    held = {(r.cell, r.year): (list(r["head"]), r.rest) for r in seasons.collect()}
    value = lambda c, y, m: v.get((c, y + (m < 11), m))
    got_null = {(c, y) for c, y in held if (c, y) == (2, 1984)}
    for c in range(3):
        for y in years:
            head, rest = [value(c, y, m) for m in months[:3]], [value(c, y, m) for m in months[3:]]
            if None in head:
                assert (c, y) not in held
            elif (c, y) not in got_null and (c, y) in held:
                assert held[c, y] == (head, None if None in rest else sum(rest))
    near = completion.nearest_years(seasons, ["cell"], 4, past_only).collect()
    want = set()
    for (c, y), (head, _) in held.items():
        ds = sorted((math.dist(head, h), z) for (k, z), (h, r) in held.items() if k == c and r is not None and (z < y if past_only else z != y))
        want |= {(c, y, z, i + 1) for i, (_, z) in enumerate(ds[:4])}
    assert {(r.cell, r.year, r.donor, r.place) for r in near} == want
    table = spark.createDataFrame(near)
    done = {(r.cell, r.year): r for r in completion.completed(seasons, table, ["cell"]).collect()}
    low = {(r.cell, r.year): r.below_q for r in completion.frequency_below(seasons, table, ["cell"], {"q": 0.4}).collect()}
    for (c, y), r in done.items():
        rests = [held[c, z][1] for k, t, z, _ in want if (k, t) == (c, y)]
        edge = np.quantile([sum(h) + q for (k, _), (h, q) in held.items() if k == c and q is not None], 0.4)
        assert (r.total, r.spread, r.n) == pytest.approx((sum(held[c, y][0]) + np.mean(rests), np.std(rests), len(rests)))
        assert low[c, y] == pytest.approx(np.mean([sum(held[c, y][0]) + q < edge for q in rests]))


def test_gamma_against_integration(spark):
    cases = [(a, x) for a in (0.3, 0.9, 1.0, 2.5, 7.0, 40.0) for x in (0.0, 1e-3, 0.2, 1.0, 2.4, 6.9, 8.2, 35.0, 60.0)]
    frame = spark.createDataFrame(cases, "a double, x double")
    nodes, weights = np.polynomial.legendre.leggauss(400)
    for r in frame.withColumns({"p": gamma.gamma_p(F.col("a"), F.col("x")), "l": gamma.log_gamma(F.col("a"))}).collect():
        assert r.l == pytest.approx(math.lgamma(r.a), abs=1e-12)
        # t = x u^(k / a) takes the singularity at 0 out of the integral and leaves six derivatives
        u, k = (nodes + 1) / 2, math.ceil(6 * r.a)
        want = float((weights / 2 * k * u ** (k - 1) * np.exp(-r.x * u ** (k / r.a))).sum() * math.exp(r.a * math.log(r.x) - math.lgamma(r.a + 1))) if r.x else 0.0
        assert r.p == pytest.approx(want, abs=1e-9)


def test_percentiles_with_dry_mass(spark):
    rows = [("a", v) for v in (0.0, 0.0, 1.0, 2.0, 4.0)] + [("b", 3.0), ("c", 0.0), ("c", None)]
    frame = spark.createDataFrame(rows, "g string, v double")
    dry, shape, scale = gamma.gamma_moments(F.col("v"))
    fits = {r.g: r for r in frame.groupBy("g").agg(dry.alias("dry"), shape.alias("shape"), scale.alias("scale")).collect()}
    m, s2 = np.mean([1, 2, 4]), np.var([1, 2, 4])
    assert (fits["a"].dry, fits["a"].shape, fits["a"].scale) == pytest.approx((0.4, m * m / s2, s2 / m)) and fits["b"].shape is None and fits["c"].dry == 1
    got = frame.where("g = 'a'").withColumn("p", gamma.bernoulli_gamma(F.col("v"), F.lit(0.4), F.lit(2.0), F.lit(1.5))).collect()
    for r in got:
        z = r.v / 1.5
        assert r.p == pytest.approx(0.4 + 0.6 * (1 - math.exp(-z) * (1 + z)) if r.v else 0.2)
