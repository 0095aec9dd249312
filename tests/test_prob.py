import math

import pytest
from pyspark.sql import functions as F

from isopleth.functions import prob


def test_normal_cdf_equals_erf(spark):
    rows = spark.range(-600, 601).select((F.col("id") / 100.0).alias("x"))
    got = rows.select("x", prob.normal_cdf(F.col("x")).alias("a"), F.expr(prob.normal_cdf_sql("x")).alias("b")).collect()
    for r in got:
        want = 0.5 * (1 + math.erf(r.x / math.sqrt(2)))
        assert abs(r.a - want) < 1e-14 and abs(r.b - want) < 1e-14


def test_t_quantile():
    assert prob.t_quantile(0.9, 10) == pytest.approx(1.372184, abs=1e-6)
    assert prob.t_quantile(0.975, 1) == pytest.approx(12.706205, abs=1e-5)
    assert prob.t_cdf(-2.0, 7) == pytest.approx(0.0428, abs=1e-4)


def test_climatology_scores_zero(spark):
    third = F.lit(1 / 3)
    rows = spark.range(30).select((F.col("id") % 3).alias("obs"))
    scored = rows.select(prob.rps(third, third, F.col("obs")).alias("s"))
    assert abs(scored.agg(prob.skill(F.col("s"), F.col("s")).alias("k")).first().k) < 1e-12


def test_two_tercile_conventions_differ_at_the_edges(spark):
    e = spark.range(1).select(prob.tercile(F.lit(1.0), F.lit(1.0), F.lit(2.0)).alias("a"), prob.tercile_closed(F.lit(1.0), F.lit(1.0), F.lit(2.0)).alias("b")).first()
    assert (e.a, e.b) == (1, 0)
