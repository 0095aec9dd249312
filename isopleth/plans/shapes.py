"""Queries over polygons: hulls of the labels' vectors in two dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isopleth.operators import polygons
from isopleth.sources.panels import table

from .base import R, query
from .stats import rounded

#: Side of a grid cell.
STEP = 0.05

XY = "p AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS v FROM embeddings)"
EDGES = XY + """, c AS (SELECT DISTINCT label, x, y FROM p),
e AS (SELECT a.label, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM c a JOIN c b ON a.label = b.label AND (a.x <> b.x OR a.y <> b.y)
      WHERE NOT EXISTS (SELECT 1 FROM c r WHERE r.label = a.label AND (b.x - a.x) * (r.y - a.y) - (b.y - a.y) * (r.x - a.x) < 0))"""  # fmt: skip
CELLS = EDGES + f""", f AS (SELECT label, min(floor(least(y1, y2) / {STEP}))::BIGINT AS low FROM e WHERE x1 <> x2 GROUP BY label),
s AS (SELECT e.*, f.low, ix, greatest(least(x1, x2), ix * {STEP}) AS a, least(greatest(x1, x2), (ix + 1) * {STEP}) AS b, (y2 - y1) / (x2 - x1) AS m
      FROM e JOIN f USING (label), unnest(range(floor(least(x1, x2) / {STEP})::BIGINT, floor(greatest(x1, x2) / {STEP})::BIGINT + 1)) AS q(ix) WHERE x1 <> x2),
t AS (SELECT label, ix, b - a AS width, y1 + m * (a - x1) AS ya, y1 + m * (b - x1) AS yb, CASE WHEN x2 > x1 THEN -1e0 ELSE 1e0 END AS sign, low FROM s WHERE b > a),
u AS (SELECT label, ix, iy, width, sign, ya - iy * {STEP} AS ua, yb - iy * {STEP} AS ub FROM t, unnest(range(low, greatest(low, floor(greatest(ya, yb) / {STEP})::BIGINT) + 1)) AS q(iy)),
w AS (SELECT label, ix, iy, sum(sign * width * CASE WHEN abs(ub - ua) < 1e-12 THEN least(greatest(ua, 0), {STEP}) ELSE
      ((CASE WHEN ub <= 0 THEN 0 WHEN ub <= {STEP} THEN ub * ub / 2 ELSE {STEP} * ub - {STEP * STEP} / 2 END)
       - (CASE WHEN ua <= 0 THEN 0 WHEN ua <= {STEP} THEN ua * ua / 2 ELSE {STEP} * ua - {STEP * STEP} / 2 END)) / (ub - ua) END) AS area FROM u GROUP BY label, ix, iy)"""  # fmt: skip


def plane(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, label, x, y, v): the first three dimensions of the vectors."""
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", "label", *[F.get(e, F.lit(k)).cast("double").alias(n) for k, n in enumerate("xyv")])


def rings(spark: SparkSession, sf: str) -> DataFrame:
    return polygons.convex_hulls(plane(spark, sf), "label")


@query("z1_convex_hulls", f"WITH {EDGES} SELECT label, count(*) AS corners, {R('sum(x1 * y2 - x2 * y1) / 2')} AS area FROM e GROUP BY label")
def z1(spark, sf):
    return rounded(polygons.ring_area(rings(spark, sf), "label"), ["label", "corners"], ["area"])


@query("z2_points_in_polygons", f"""WITH {EDGES}, h AS (SELECT p.vec_id, e.label, count(*) AS n FROM p JOIN e ON (y1 > p.y) <> (y2 > p.y) AND p.x < (x2 - x1) * (p.y - y1) / (y2 - y1) + x1 GROUP BY 1, 2)
SELECT label, count(*) AS inside FROM h WHERE n % 2 = 1 GROUP BY label""")  # fmt: skip
def z2(spark, sf):
    """How many vectors of any label lie in each label's hull."""
    return polygons.points_in_polygons(plane(spark, sf).select("vec_id", "x", "y"), rings(spark, sf), "label", STEP).groupBy("label").agg(F.count("*").alias("inside"))


@query("z3_zonal_means", f"""WITH {CELLS}, g AS (SELECT floor(x / {STEP})::BIGINT AS ix, floor(y / {STEP})::BIGINT AS iy, avg(v) AS v FROM p GROUP BY 1, 2)
SELECT label, count(*) AS cells, {R('sum(area)')} AS area, {R('sum(area * v) / sum(area)')} AS mean FROM w JOIN g USING (ix, iy) WHERE area > {1e-12 * STEP * STEP} GROUP BY label""")  # fmt: skip
def z3(spark, sf):
    """Means of a grid of the third dimension over the hulls, by the area of each cell inside."""
    at = lambda c: F.floor(F.col(c) / STEP).cast("long")
    grid = plane(spark, sf).groupBy(at("x").alias("ix"), at("y").alias("iy")).agg(F.avg("v").alias("v"))
    return rounded(polygons.zonal_means(grid, polygons.cell_weights(rings(spark, sf), "label", STEP), "label"), ["label", "cells"], ["area", "mean"])
