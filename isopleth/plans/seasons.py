"""Queries over completed seasons and Bernoulli-Gamma percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isopleth.functions import gamma
from isopleth.operators import completion
from isopleth.sources.io import written
from isopleth.sources.panels import month_panel, table

from .base import R, query
from .stats import rounded

MONTHS, KNOWN, NEAR = [3, 4, 5, 6, 7, 8], 3, 3

#: Seasons, all pairs of years, and the nearest of them.
PAIRS = """m AS (SELECT cell, year, max(v) FILTER (month = 3) AS a, max(v) FILTER (month = 4) AS b, max(v) FILTER (month = 5) AS c,
      CASE WHEN count(*) FILTER (month BETWEEN 6 AND 8) = 3 THEN sum(v) FILTER (month BETWEEN 6 AND 8) END AS rest FROM pm GROUP BY cell, year),
s AS (SELECT * FROM m WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL),
d AS (SELECT x.cell, x.year, y.year AS donor, x.a + x.b + x.c AS known, y.rest, sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2 + (x.c - y.c) ** 2) AS d FROM s x JOIN s y ON x.cell = y.cell AND x.year <> y.year AND y.rest IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY cell, year ORDER BY d, donor) AS place FROM d QUALIFY place <= 3)"""  # fmt: skip


def partial(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(seasons, near): March to August of each cell, of which three months are known, and the three nearest other years."""
    s = written(completion.partial_seasons(month_panel(spark, sf), ["cell"], MONTHS, KNOWN), "seasons")
    return s, completion.nearest_years(s, ["cell"], NEAR)


@query("c1_analog_years", f"WITH {PAIRS} SELECT cell, year::INT AS year, donor::INT AS donor, place::INT AS place, {R('d')} AS d FROM n", "pm")
def c1(spark, sf):
    return rounded(partial(spark, sf)[1], ["cell", "year", "donor", "place"], ["d"])


@query("c2_completed_seasons", f"WITH {PAIRS} SELECT cell, year::INT AS year, {R('any_value(known)')} AS known, {R('any_value(known) + avg(rest)')} AS total, {R('stddev_pop(rest)')} AS spread, count(*) AS n FROM n GROUP BY cell, year", "pm")
def c2(spark, sf):
    s, near = partial(spark, sf)
    return rounded(completion.completed(s, near, ["cell"]), ["cell", "year", "n"], ["known", "total", "spread"])


@query("c3_frequency_below", f"""WITH {PAIRS}, q AS (SELECT cell, quantile_cont(a + b + c + rest, 0.21) AS q21, quantile_cont(a + b + c + rest, 0.33) AS q33 FROM s WHERE rest IS NOT NULL GROUP BY cell)
SELECT cell, year::INT AS year, {R('avg((known + rest < q21)::INT)')} AS below_21, {R('avg((known + rest < q33)::INT)')} AS below_33 FROM n JOIN q USING (cell) GROUP BY cell, year""", "pm")  # fmt: skip
def c3(spark, sf):
    s, near = partial(spark, sf)
    return rounded(completion.frequency_below(s, near, ["cell"], {"21": 0.21, "33": 0.33}), ["cell", "year"], ["below_21", "below_33"])


@query("b1_bernoulli_gamma", f"""WITH f AS (SELECT l_returnflag AS mode, 1 - count(*) FILTER (l_tax > 0) / count(*) AS dry, avg(l_tax) FILTER (l_tax > 0) AS m, var_pop(l_tax) FILTER (l_tax > 0) AS s2 FROM lineitem GROUP BY 1),
v AS (SELECT DISTINCT l_returnflag AS mode, l_tax AS tax FROM lineitem), g AS (SELECT mode, tax, dry, m * m / s2 AS a, tax * m / s2 AS x FROM v JOIN f USING (mode)),
p AS (SELECT mode, tax, dry, sum(CASE WHEN x > 0 THEN exp(a * ln(x) - x + k * ln(x) - lgamma(a + k + 1)) ELSE 0 END) AS p FROM g, range(0, 200) t(k) GROUP BY ALL)
SELECT mode, tax, {R('CASE WHEN tax <= 0 THEN dry / 2 ELSE dry + (1 - dry) * p END', 8)} AS percentile FROM p""")  # fmt: skip
def b1(spark, sf):
    """Percentiles of each tax within its return flag: shares of zeros, and a gamma distribution of the rest by moments."""
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("mode"), F.col("l_tax").alias("tax"))
    dry, shape, scale = gamma.gamma_moments(F.col("tax"))
    fits = rows.groupBy("mode").agg(dry.alias("dry"), shape.alias("shape"), scale.alias("scale"))
    out = rows.distinct().join(fits, "mode").select("mode", "tax", gamma.bernoulli_gamma(F.col("tax"), F.col("dry"), F.col("shape"), F.col("scale")).alias("percentile"))
    return out.select("mode", "tax", (F.round("percentile", 8) + 0.0).alias("percentile"))
