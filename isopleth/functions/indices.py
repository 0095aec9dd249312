"""Named composite indices of box series, as column expressions over a row that has the boxes as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isopleth.functions.scalar import area_weight, in_box, with_stats

#: Sea-surface boxes (south, north, west, east), those of the indices first, then those of teleconnections (an eastern end
#: over 360 wraps); weights of the composite of three parts.
BOXES = {
    "nino34": (-5.0, 5.0, 190.0, 240.0),
    "iod_w": (-10.0, 10.0, 50.0, 70.0),
    "iod_e": (-10.0, 0.0, 90.0, 110.0),
    "wpac": (-5.0, 5.0, 130.0, 150.0),
    "wv": (5.0, 20.0, 130.0, 170.0),
    "atl3": (-3.0, 3.0, 340.0, 360.0),
    "tna": (5.5, 23.5, 302.5, 345.0),
    "tsa": (-20.0, 0.0, 330.0, 370.0),
    "wep": (-15.0, 20.0, 120.0, 160.0),
    "wnp": (20.0, 35.0, 160.0, 210.0),
    "wsp": (-30.0, -15.0, 155.0, 210.0),
}
COMPOSITE = {"const": 12.0, "iod": 323.0, "wpac": -193.0, "nino34": 94.0}


def iod(west: Column, east: Column) -> Column:
    return west - east


def gradient(near: Column, far: Column) -> Column:
    """Difference of two (standardised) boxes."""
    return near - far


def composite(iod_: Column, wpac: Column, nino34: Column) -> Column:
    return F.lit(COMPOSITE["const"]) + COMPOSITE["iod"] * iod_ + COMPOSITE["wpac"] * wpac + COMPOSITE["nino34"] * nino34


#: Indices by name: functions of two dictionaries of the boxes' columns, plain and standardised by training years.
INDICES = {
    "nino34": lambda v, z: v["nino34"],
    "iod": lambda v, z: iod(v["iod_w"], v["iod_e"]),
    "wpg": lambda v, z: gradient(z["wpac"], z["nino34"]),
    "wvg": lambda v, z: gradient(z["nino34"], z["wv"]),
    "iwhg": lambda v, z: composite(iod(v["iod_w"], v["iod_e"]), v["wpac"], v["nino34"]),
}
#: Boxes that the indices need, and groups of the indices.
INDEX_BOXES = ["nino34", "iod_w", "iod_e", "wpac", "wv"]
GROUPS = {"nino34": "one box", "iod": "dipole", "wpg": "gradient", "wvg": "gradient", "iwhg": "composite"}


def box_series(grid: DataFrame, boxes: dict[str, tuple[float, float, float, float]], first: int, last: int) -> DataFrame:
    """(box, year, month, v): monthly anomalies of the area means of boxes over a grid (lat, lon, year, month, v), from the months' means of a base period."""
    inside = F.array(*[F.when(in_box(F.col("lat"), F.col("lon"), *edges), F.lit(name)) for name, edges in boxes.items()])
    rows = grid.withColumn("box", F.explode(F.array_compact(inside))).where("v IS NOT NULL")
    w = area_weight(F.col("lat"))
    mean = rows.groupBy("box", "year", "month").agg((F.sum(w * F.col("v")) / F.sum(w)).alias("m"))
    based = with_stats(mean, ["box", "month"], _clim=F.avg(F.when(F.col("year").between(first, last), F.col("m"))))
    return based.select("box", "year", "month", (F.col("m") - F.col("_clim")).alias("v"))


def wide(series: DataFrame, boxes: list[str], by: list[str]) -> DataFrame:
    """Long box series (box, by, v) with a column for each box."""
    return series.groupBy(*by).pivot("box", boxes).agg(F.first("v"))


def spec(kind: str, first: Column, second: Column | None = None) -> Column:
    """A generic index: one box, or the first less the second."""
    return first if kind == "box" else first - second
