"""Reductions of long-form fields (cell, lat, lon, year, month, v): climatologies, anomalies, area means, season totals, grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isopleth.functions.calendar import abs_month, month_length, preseason, season_year
from isopleth.functions.scalar import area_weight, with_stats


def climatology(field: DataFrame, first: int, last: int) -> DataFrame:
    """(cell, month, clim): the mean of each calendar month over a base period."""
    return field.where(F.col("year").between(first, last)).groupBy("cell", "month").agg(F.avg("v").alias("clim"))


def anomaly(field: DataFrame, first: int, last: int) -> DataFrame:
    """field with ``anom``, the value less its base-period calendar-month mean, in one pass over (cell, month)."""
    w = Window.partitionBy("cell", "month")
    return field.withColumn("anom", F.col("v") - F.avg(F.when(F.col("year").between(first, last), F.col("v"))).over(w))


def valid_cells(clim: DataFrame, least: float = 1e-3) -> DataFrame:
    """(cell): cells with all twelve months and an annual sum over ``least``."""
    return clim.where(F.col("clim").isNotNull()).groupBy("cell").agg(F.count("clim").alias("n"), F.sum("clim").alias("s")).where((F.col("n") == 12) & (F.col("s") > least)).select("cell")


def area_mean(field: DataFrame, by: list[str], weighted: bool = True, value: str = "v") -> DataFrame:
    """(by, mean): mean over cells that have a value, weighted by the cosine of latitude or not."""
    w = area_weight(F.col("lat")) if weighted else F.lit(1.0)
    v = F.col(value)
    return field.groupBy(*by).agg(F.try_divide(F.sum(w * v), F.sum(F.when(v.isNotNull(), w))).alias("mean"))


def season_totals(field: DataFrame, months: list[int], by: list[str], day_weighted: bool = False, value: str = "v") -> DataFrame:
    """(by, season_year, total): sums over a window of months, labelled by the year of its last; only complete seasons.

    A month whose value is null for any row of the group spoils its season.
    """
    rows = field.where(F.col("month").isin(months)).withColumn("season_year", season_year(F.col("year"), F.col("month"), months))
    v = F.col(value) * month_length(F.col("month")) if day_weighted else F.col(value)
    out = rows.groupBy(*by, "season_year").agg(F.sum(v).alias("total"), F.count_distinct("month").alias("n"), F.count_if(F.col(value).isNull()).alias("bad"))
    return out.where((F.col("n") == len(months)) & (F.col("bad") == 0)).drop("n", "bad")


def calendar_totals(field: DataFrame, months: list[int], by: list[str], how: str = "sum") -> DataFrame:
    """(by, year, total): the older reduction, by calendar year without wrapping, of whatever months there are."""
    return field.where(F.col("month").isin(months)).groupBy(*by, "year").agg((F.sum if how == "sum" else F.avg)("v").alias("total"))


def preseason_mean(series: DataFrame, seasons: DataFrame, months: list[int], gap: int, width: int, by: list[str], strict: bool = True) -> DataFrame:
    """(by, season_year, x): mean of the ``width`` months that end gap + 1 before the window starts.

    ``strict``: any missing month makes it null; otherwise the mean is of what there is. seasons has season_year.
    """
    wanted = seasons.select("season_year").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    wanted = wanted.withColumn("am", preseason(F.col("season_year"), months, gap) - F.col("k"))
    rows = series.withColumn("am", abs_month(F.col("year"), F.col("month"))).join(F.broadcast(wanted), "am")
    mean = F.avg("v")
    return rows.groupBy(*by, "season_year").agg((F.when(F.count("v") == width, mean) if strict else mean).alias("x"))


def ensemble_mean(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, v): mean over members within each model, then over models, so that large ensembles don't outweigh small ones."""
    return rows.groupBy(*by, "model").agg(F.avg("v").alias("v")).groupBy(*by).agg(F.avg("v").alias("v"))


def coarsen(grid: DataFrame, rows: int, columns: int | None = None) -> DataFrame:
    """(i, j, v): means of blocks of rows by columns (as many, if not said) of a grid (i, j, v) by index.

    Ragged edge blocks are dropped by the grid's extent, not by missing values.
    """
    columns = columns or rows
    extent = grid.agg((F.floor((F.max("i") + 1) / rows)).alias("ni"), F.floor((F.max("j") + 1) / columns).alias("nj"))
    block = grid.groupBy(F.floor(F.col("i") / rows).cast("int").alias("i"), F.floor(F.col("j") / columns).cast("int").alias("j")).agg(F.avg("v").alias("v"))
    return block.join(F.broadcast(extent), (F.col("i") < F.col("ni")) & (F.col("j") < F.col("nj"))).select("i", "j", "v")


def bilinear(grid: DataFrame, points: DataFrame) -> DataFrame:
    """(id, v): a unit-step grid (i, j, v) sampled at points (id, y, x); outside the hull or next to a missing cell: null."""
    corner = points.select("id", "y", "x", F.floor("y").cast("int").alias("i0"), F.floor("x").cast("int").alias("j0"))
    moves = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    four = corner.select("*", F.explode(moves).alias("m")).select("id", (F.col("i0") + F.col("m.a")).alias("i"), (F.col("j0") + F.col("m.b")).alias("j"), ((1 - F.abs(F.col("y") - F.col("i0") - F.col("m.a"))) * (1 - F.abs(F.col("x") - F.col("j0") - F.col("m.b")))).alias("w"))
    got = four.where("w > 0").join(grid, ["i", "j"], "left").groupBy("id")
    return got.agg(F.when(F.count_if(F.col("v").isNull()) == 0, F.sum(F.col("w") * F.col("v"))).alias("v"))


def doy_climatology(daily: DataFrame, width: int = 31, days: int = 366, by: Sequence[str] = ("cell",)) -> DataFrame:
    """(by, doy, clim): day-of-year means (by, doy, v) smoothed by a centred window that wraps round the year."""
    mean = daily.groupBy(*by, "doy").agg(F.avg("v").alias("v"))
    three = mean.select(*by, "doy", "v", F.explode(F.array(F.lit(-days), F.lit(0), F.lit(days))).alias("shift")).withColumn("at", F.col("doy") + F.col("shift"))
    w = Window.partitionBy(*by).orderBy("at").rangeBetween(-(width // 2), width // 2)
    return three.withColumn("clim", F.avg("v").over(w)).where("shift = 0").select(*by, "doy", "clim")


def bimodality(clim: DataFrame) -> DataFrame:
    """(cell, a1, a2, ratio): amplitudes of the first two harmonics of the annual cycle, and a2 over a1."""

    def amplitude(k: int) -> Column:
        angle = F.lit(2 * k) * F.pi() * (F.col("month") - 1) / 12
        c, s = F.sum(F.col("clim") * F.cos(angle)), F.sum(F.col("clim") * F.sin(angle))
        return F.sqrt(c * c + s * s) * 2 / 12

    out = clim.groupBy("cell").agg(amplitude(1).alias("a1"), amplitude(2).alias("a2"))
    return out.withColumn("ratio", F.col("a2") / (F.col("a1") + 1e-6))


def zscore(rows: DataFrame, by: list[str], value: str = "v", train: Column | None = None) -> DataFrame:
    """rows with ``z``: over the whole group, or by the mean and deviation of its training rows. A deviation of 0 gives null."""
    v = F.col(value) if train is None else F.when(train, F.col(value))
    out = with_stats(rows, by, _m=F.avg(v), _s=F.nullif(F.stddev_pop(v), F.lit(0.0)))
    return out.withColumn("z", (F.col(value) - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def composites(series: DataFrame, field: DataFrame, least: int = 3) -> DataFrame:
    """(cell, low, high, diff): means of field (cell, year, v) over the lowest and the highest third of the years of series (year, y).

    The series is one value a year, so that ranking it in one task and broadcasting the marks are bounded by the record's length.
    """
    w = Window.partitionBy(F.lit(1))
    ranked = series.select("year", F.row_number().over(w.orderBy("y", "year")).alias("r"), F.count("*").over(w).alias("n"))
    third = F.greatest(F.lit(least), F.floor(F.col("n") / 3))
    marked = ranked.select("year", (F.col("r") <= third).alias("is_low"), (F.col("r") > F.col("n") - third).alias("is_high"))
    out = field.join(F.broadcast(marked), "year").groupBy("cell").agg(F.avg(F.when(F.col("is_low"), F.col("v"))).alias("low"), F.avg(F.when(F.col("is_high"), F.col("v"))).alias("high"))
    return out.withColumn("diff", F.col("high") - F.col("low"))


def bands(field: DataFrame, dim: DataFrame) -> DataFrame:
    """field joined to each of the (overlapping) latitude bands (band, lat_s, lat_n) that hold its latitude; the bands are few."""
    return field.join(F.broadcast(dim), F.col("lat").between(F.col("lat_s"), F.col("lat_n")))


def wet_cells(means: DataFrame, share: float = 0.45) -> DataFrame:
    """Rows of (band, cell, mean) with at least a share of their band's largest mean."""
    return means.withColumn("top", F.max("mean").over(Window.partitionBy("band"))).where(F.col("mean") >= share * F.col("top")).drop("top")


def common_years(rows: DataFrame, item: str, year: str = "year", value: str = "v") -> DataFrame:
    """(year): years in which every item has a value."""
    full = rows.where(F.col(value).isNotNull())
    total = full.agg(F.count_distinct(item).alias("k"))
    return full.groupBy(year).agg(F.count_distinct(item).alias("n")).join(F.broadcast(total), F.col("n") == F.col("k")).select(year)
