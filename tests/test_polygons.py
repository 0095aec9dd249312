"""Hulls, points in polygons and areas in cells against loops over points and clipped polygons."""

import numpy as np
import pytest

from isopleth.operators import polygons

SHAPES = {"L": [(0.1, 0.1), (2.3, 0.1), (2.3, 0.9), (1.0, 0.9), (1.0, 3.2), (0.1, 3.2)], "tri": [(-1.4, -0.7), (0.6, -0.2), (-0.3, 1.9)], "big": [(-40.0, -30.0), (41.0, -29.5), (39.0, 31.0), (-38.0, 30.0)]}


@pytest.fixture(scope="module")
def shapes(spark):
    return spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in r]) for k, r in SHAPES.items()], f"name string, ring {polygons.RING}")


def inside(ring, x, y):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def clipped_area(ring, x0, y0, side):
    """Sutherland-Hodgman against the four sides, then the shoelace sum."""
    for axis, bound, sign in ((0, x0, 1), (0, x0 + side, -1), (1, y0, 1), (1, y0 + side, -1)):
        out = []
        for a, b in zip(ring, ring[1:] + ring[:1]):
            da, db = sign * (a[axis] - bound), sign * (b[axis] - bound)
            if da >= 0:
                out.append(a)
            if (da >= 0) != (db >= 0):
                t = da / (da - db)
                out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
        ring = out
        if not ring:
            return 0.0
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def test_hulls_of_hulls_are_hulls(spark):
    rng = np.random.default_rng(0)
    rows = [(k % 4, float(x), float(y)) for k, (x, y) in enumerate(rng.integers(-20, 20, size=(900, 2)))] + [(9, 1.0, 1.0), (9, 1.0, 1.0), (8, 0.0, 0.0), (8, 2.0, 2.0), (8, 1.0, 1.0), (0, None, 3.0), (None, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "g int, x double, y double").repartition(7)
    for held in (10_000, 1):
        got = {r.g: [(p.x, p.y) for p in r.ring] for r in polygons.convex_hulls(frame, "g", held).collect()}
        assert set(got) == {0, 1, 2, 3, 8, 9} and got[9] == [(1.0, 1.0)] and got[8] == [(0.0, 0.0), (2.0, 2.0)]
        for g in range(4):
            own = {(x, y) for k, x, y in rows if k == g and x is not None}
            side = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
            want = {a for a in own for b in own if a != b and all(side(a, b, p) > 0 or side(a, b, p) == 0 and (p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1]) >= 0 for p in own) and all(side(a, b, p) != 0 or (p[0] - a[0]) ** 2 + (p[1] - a[1]) ** 2 <= (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2 for p in own)}
            assert set(got[g]) == want and all(side(a, b, c) > 0 for a, b, c in zip(got[g], got[g][1:] + got[g][:1], got[g][2:] + got[g][:2]))
    assert polygons.convex_hulls(frame.where("g > 100"), "g").count() == 0


def test_points_lie_in_polygons_of_many_buckets(spark, shapes):
    rng = np.random.default_rng(1)
    rows = [(k, float(x), float(y)) for k, (x, y) in enumerate(np.vstack([rng.uniform(-3, 4, size=(400, 2)), rng.uniform(-50, 50, size=(200, 2))]))] + [(900, 0.1, 0.1), (901, 1.0, 0.9), (902, None, 0.0)]
    frame = spark.createDataFrame(rows, "id int, x double, y double")
    want = sorted((i, name) for i, x, y in rows if x is not None for name, ring in SHAPES.items() if inside(ring, x, y))
    for step in (0.5, 7.0):
        assert sorted((r.id, r.name) for r in polygons.points_in_polygons(frame, shapes, "name", step).collect()) == want


def test_areas_in_cells_are_those_of_clipped_polygons(spark, shapes):
    got = {(r.name, r.ix, r.iy): r.area for r in polygons.cell_weights(shapes, "name", 0.5).where("name <> 'big'").collect()}
    want = {(n, i, j): a for n in ("L", "tri") for i in range(-8, 9) for j in range(-8, 9) if (a := clipped_area(SHAPES[n], i * 0.5, j * 0.5, 0.5)) > 1e-9}
    assert set(k for k, a in got.items() if a > 1e-9) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    areas = {r.name: r.area for r in polygons.ring_area(shapes, "name").collect()}
    sums = {r.name: r.s for r in polygons.cell_weights(shapes, "name", 3.0).groupBy("name").agg({"area": "sum"}).withColumnRenamed("sum(area)", "s").collect()}
    assert sums == pytest.approx(areas)
    grid = spark.createDataFrame([(0, 0, 2.0), (0, 1, 4.0), (1, 0, None)], "ix int, iy int, v double")
    r = polygons.zonal_means(grid, polygons.cell_weights(shapes, "name", 1.0), "name").where("name = 'L'").first()
    a, b = clipped_area(SHAPES["L"], 0, 0, 1.0), clipped_area(SHAPES["L"], 0, 1, 1.0)
    assert (r.cells, r.area, r.mean) == (2, pytest.approx(a + b), pytest.approx((2 * a + 4 * b) / (a + b)))
