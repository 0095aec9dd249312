"""Polygons: convex hulls of groups, points in polygons, and means of a grid over the parts of its cells that lie in a polygon.

A polygon is a column ``ring``, an array of its corners (x, y) in counter-clockwise order, the first not repeated. Edges,
bands and grid cells are rows, so a polygon of any size is dealt to many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RING = "array<struct<x: double, y: double>>"


def hull(x: np.ndarray, y: np.ndarray) -> list[tuple[float, float]]:
    """The corners of the convex hull of points, counter-clockwise from the leftmost (lowest of equals); points on edges are no corners."""
    points = sorted(set(zip(x.tolist(), y.tolist(), strict=True)))
    if len(points) < 3:
        return points

    def chain(run: Iterator) -> list:
        out: list[tuple[float, float]] = []
        for p in run:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(iter(points)) + chain(reversed(points))


def convex_hulls(points: DataFrame, key: str, keys_held: int = 10_000) -> DataFrame:
    """(key, ring): the convex hull of each group of points (key, x, y).

    Tasks keep a hull of what they have seen of each group, and hulls of hulls are made after the shuffle, so a group's
    points are never gathered. Points with a missing coordinate are left out; two or fewer distinct points are their own hull.
    """
    schema = f"{key} {dict(points.dtypes)[key]}, xs array<double>, ys array<double>"

    def row(value, ring: list, kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([value], kind), pa.array([[p[0] for p in ring]], pa.list_(pa.float64())), pa.array([[p[1] for p in ring]], pa.list_(pa.float64()))], [key, "xs", "ys"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        kind = None
        for batch in batches:
            kind = batch.schema.field(key).type
            names = batch.column(key).to_numpy(zero_copy_only=False)
            x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
            order = np.argsort(names, kind="stable")
            cuts = np.flatnonzero(names[order][1:] != names[order][:-1]) + 1
            for part in np.split(order, cuts) if len(order) else []:
                name = batch.column(key)[int(part[0])].as_py()
                old = held.get(name, [])
                held[name] = hull(np.r_[[p[0] for p in old], x[part]], np.r_[[p[1] for p in old], y[part]])
            if len(held) > keys_held:
                yield from (row(k, r, kind) for k, r in held.items())
                held = {}
        yield from (row(k, r, kind) for k, r in held.items())

    def merged(table: pa.Table) -> pa.Table:
        x, y = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("xs", "ys"))
        return pa.Table.from_batches([row(table.column(key)[0].as_py(), hull(x, y), table.schema.field(key).type)])

    ok = points.where(F.col(key).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()).select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    rings = ok.mapInArrow(partial, schema).groupBy(key).applyInArrow(merged, schema)
    return rings.select(key, F.arrays_zip(F.col("xs").alias("x"), F.col("ys").alias("y")).cast(RING).alias("ring"))


def edges(polygons: DataFrame, key: str) -> DataFrame:
    """(key, x1, y1, x2, y2): a row an edge of the rings."""
    after = F.concat(F.slice("ring", 2, F.greatest(F.size("ring") - 1, F.lit(0))), F.slice("ring", 1, 1))
    rows = polygons.select(key, F.explode(F.zip_with("ring", after, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))).alias("e"))
    return rows.select(key, "e.*")


def ring_area(polygons: DataFrame, key: str) -> DataFrame:
    """(key, corners, area) by the shoelace sum of the edges."""
    twice = F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))
    return edges(polygons, key).groupBy(key).agg(F.count("*").alias("corners"), (twice / 2).alias("area"))


def _crossed(e: Column, x: Column, y: Column) -> Column:
    """Whether a ray to the right of a point crosses an edge; an edge holds its lower end and not its upper."""
    at = (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]
    return ((e["y1"] > y) != (e["y2"] > y)) & (x < at)


def points_in_polygons(points: DataFrame, polygons: DataFrame, key: str, step: float) -> DataFrame:
    """The rows of points (x, y, ...) with the key of each polygon (key, ring) that they lie in, by ray casting; a point may lie in many.

    Polygons are cut into bands of height ``step`` and these into buckets; a bucket holds the edges of its band that aren't
    all to its left. Points meet the buckets that they lie in by a join on the bucket's place, so neither points nor
    polygons are compared pair by pair, and a polygon over many buckets is many rows.
    """
    place = lambda c: F.floor(c / step).cast("long")
    rows = edges(polygons, key).withColumn("by", F.explode(F.sequence(place(F.least("y1", "y2")), place(F.greatest("y1", "y2")))))
    bands = rows.groupBy(key, "by").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("band"), F.min(F.least("x1", "x2")).alias("lo"), F.max(F.greatest("x1", "x2")).alias("hi"))
    buckets = bands.withColumn("bx", F.explode(F.sequence(place(F.col("lo")), place(F.col("hi")))))
    buckets = buckets.select(key, "bx", "by", F.filter("band", lambda e: F.greatest(e["x1"], e["x2"]) >= F.col("bx") * step).alias("band"))
    placed = points.where("x IS NOT NULL AND y IS NOT NULL").withColumns({"bx": place(F.col("x")), "by": place(F.col("y"))})
    hits = F.size(F.filter("band", lambda e: _crossed(e, F.col("x"), F.col("y"))))
    return placed.join(buckets, ["bx", "by"]).where(hits % 2 == 1).select(*points.columns, key)


def _filled(t: Column, h: float) -> Column:
    """The integral of a height cut to 0 .. h, from 0 to t."""
    return F.when(t <= 0, 0.0).when(t <= h, t * t / 2).otherwise(h * t - h * h / 2)


def cell_weights(polygons: DataFrame, key: str, step: float) -> DataFrame:
    """(key, ix, iy, area): the area of each polygon inside each cell of a grid of squares of side ``step``.

    By Green's theorem the area is a sum over edges: each adds, with its sign, the area between it and the floor of a cell,
    cut to the cell. So a polygon is never clipped as a whole: edges are cut to columns, and sums are made by cell.
    """
    place = lambda c: F.floor(c / step).cast("long")
    rows = edges(polygons, key).where("x1 <> x2")
    floor = rows.groupBy(key).agg(F.min(place(F.least("y1", "y2"))).alias("low"))
    cut = rows.withColumn("ix", F.explode(F.sequence(place(F.least("x1", "x2")), place(F.greatest("x1", "x2"))))).join(floor, key)
    a = F.greatest(F.least("x1", "x2"), F.col("ix") * step)
    b = F.least(F.greatest("x1", "x2"), (F.col("ix") + 1) * step)
    slope = (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))
    cut = cut.withColumns({"width": b - a, "ya": F.col("y1") + slope * (a - F.col("x1")), "yb": F.col("y1") + slope * (b - F.col("x1")), "sign": F.when(F.col("x2") > F.col("x1"), -1.0).otherwise(1.0)}).where("width > 0")
    cells = cut.withColumn("iy", F.explode(F.sequence(F.col("low"), F.greatest(F.col("low"), place(F.greatest("ya", "yb"))))))
    ua, ub = F.col("ya") - F.col("iy") * step, F.col("yb") - F.col("iy") * step
    mean = F.when(F.abs(ub - ua) < 1e-12, F.least(F.greatest(ua, F.lit(0.0)), F.lit(step))).otherwise((_filled(ub, step) - _filled(ua, step)) / F.nullif(ub - ua, F.lit(0.0)))
    out = cells.groupBy(key, "ix", "iy").agg(F.sum(F.col("sign") * F.col("width") * mean).alias("area"))
    return out.where(F.col("area") > 1e-12 * step * step)


def zonal_means(grid: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """(key, cells, area, mean): means of grid (ix, iy, v) over each polygon, cells weighted by the area inside; cells without a value don't count."""
    rows = weights.join(grid.where("v IS NOT NULL"), ["ix", "iy"])
    return rows.groupBy(key).agg(F.count("*").alias("cells"), F.sum("area").alias("area"), F.try_divide(F.sum(F.col("area") * F.col("v")), F.sum("area")).alias("mean"))
