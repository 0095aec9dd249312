"""Rolling issuances: lead windows, calibration by hindcasts, verification against later observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isopleth.functions.prob import t_quantile
from isopleth.functions.scalar import corr

from .regress import interval, loyo, ols


def lead_window_mean(daily: DataFrame, windows: DataFrame, by: list[str], value: str = "v", day: str = "day") -> DataFrame:
    """(by, window, v): means over the (overlapping) lead windows; a window with a missing day is refused, never shortened.

    The windows are a handful of rows, so the range join is against a broadcast table.
    """
    rows = daily.join(F.broadcast(windows), F.col(day).between(F.col("first_day"), F.col("last_day")))
    out = rows.groupBy(*by, "window", "first_day", "last_day").agg(F.avg(value).alias("v"), F.count_distinct(F.when(F.col(value).isNotNull(), F.col(day))).alias("n"))
    return out.where(F.col("n") == F.col("last_day") - F.col("first_day") + 1).select(*by, "window", "v")


def missing_days(daily: DataFrame, windows: DataFrame, day: str = "day") -> DataFrame:
    """(window, day): days that the windows ask for and that nobody observed."""
    return windows.select("window", F.explode(F.sequence("first_day", "last_day")).alias(day)).join(daily.select(day).distinct(), day, "left_anti").select("window", day)


def require(rows: DataFrame, bad: Column, message: str) -> DataFrame:
    """rows, failing the job where ``bad`` holds."""
    return rows.where(F.when(bad, F.raise_error(F.lit(message)).isNull()).otherwise(F.lit(True)))


def anchor(daily: DataFrame, init: int, days: int, by: list[str], value: str = "v") -> DataFrame:
    """(by, anchor): the mean of the days + 1 values up to and with day ``init``."""
    return daily.where(F.col("day").between(init - days, init)).groupBy(*by).agg(F.avg(value).alias("anchor"))


def calibrate(hindcast: DataFrame, forecast: DataFrame, by: list[str], level: float = 0.8) -> DataFrame:
    """(by, raw, calibrated, lo, hi, slope, n, loyo_r, loyo_rmse, z_vs_training): the forecast through the hindcasts' regression.

    hindcast: (by, year, x, y) of model and observation; forecast: (by, raw).
    """
    fits = interval(ols(hindcast, by).join(forecast, by), F.col("raw"), level)
    left_out = loyo(hindcast, by).groupBy(*by).agg(corr("y", "loo").alias("loyo_r"), F.sqrt(F.avg(F.pow(F.col("y") - F.col("loo"), F.lit(2)))).alias("loyo_rmse"), F.stddev_pop("x").alias("sx"))
    out = fits.join(left_out, by)
    return out.select(*by, "raw", F.col("pred").alias("calibrated"), (F.col("pred") - F.col("half_width")).alias("lo"), (F.col("pred") + F.col("half_width")).alias("hi"), "slope", "n", "loyo_r", "loyo_rmse", F.try_divide(F.col("raw") - F.col("xbar"), F.col("sx")).alias("z_vs_training"))


def dipole(hindcast: DataFrame, forecast: DataFrame, west: str, east: str, level: float = 0.8) -> DataFrame:
    """(window, dipole, half_width, n): west less east, its interval from the residuals' difference (n - 2), the mean leverage and Student's t.

    hindcast: (pole, window, year, x, y); forecast: (pole, window, raw).
    """
    by = ["pole", "window"]
    fits = ols(hindcast, by)
    resid = hindcast.join(fits, by).select(*by, "year", (F.col("y") - F.col("intercept") - F.col("slope") * F.col("x")).alias("e"))
    pair = resid.groupBy("window", "year").agg(F.max(F.when(F.col("pole") == west, F.col("e"))).alias("w"), F.max(F.when(F.col("pole") == east, F.col("e"))).alias("e")).where("w IS NOT NULL AND e IS NOT NULL")
    sd = pair.groupBy("window").agg(F.sqrt(F.sum(F.pow(F.col("w") - F.col("e"), F.lit(2))) / F.greatest(F.lit(1), F.count("*") - 2)).alias("sd"), F.count("*").alias("m"))
    now = interval(fits.join(forecast, by), F.col("raw"), level).groupBy("window").agg((F.max(F.when(F.col("pole") == west, F.col("pred"))) - F.max(F.when(F.col("pole") == east, F.col("pred")))).alias("dipole"), F.avg("leverage").alias("lev"))
    sizes = sorted(r[0] for r in sd.select("m").distinct().collect())
    table = F.create_map(*[F.lit(x) for n in sizes for x in (n, t_quantile(0.5 + level / 2, max(1, n - 2)))]) if sizes else F.lit(None).cast("map<bigint,double>")
    return now.join(sd, "window").select("window", "dipole", (table[F.col("m")] * F.col("sd") * F.sqrt(1 + F.col("lev"))).alias("half_width"), F.col("m").alias("n"))


def verify(issued: DataFrame, observed: DataFrame) -> DataFrame:
    """(init, window, error, inside, abs_over_ci): issued rows (init, window, calibrated, anomaly, ci, obs_clim) against later window means.

    The climatology is the issued row's own, else the calibrated value less its anomaly; windows not yet observed have no row.
    """
    rows = issued.join(observed.select("init", "window", F.col("v").alias("obs")), ["init", "window"])
    clim = F.coalesce("obs_clim", F.col("calibrated") - F.col("anomaly"))
    error = F.col("calibrated") - F.col("obs")
    return rows.select("init", "window", error.alias("error"), (F.abs(error) <= F.col("ci")).alias("inside"), (F.abs(error) / F.col("ci")).alias("abs_over_ci"), (F.col("obs") - clim).alias("obs_anomaly"))


def interval_coverage(verified: DataFrame, by: list[str]) -> DataFrame:
    """(by, coverage, n, mean_abs_over_ci): pooled over rows, sums before ratios."""
    return verified.groupBy(*by).agg((F.count_if("inside") / F.count("*")).alias("coverage"), F.count("*").alias("n"), F.avg("abs_over_ci").alias("mean_abs_over_ci"))


def dispersion(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, sd_ratio, implied_slope) of model x against observation y, sample deviations."""
    return pairs.groupBy(*by).agg((F.stddev_samp("x") / F.nullif(F.stddev_samp("y"), F.lit(0.0))).alias("sd_ratio"), (corr("x", "y") * F.stddev_samp("y") / F.nullif(F.stddev_samp("x"), F.lit(0.0))).alias("implied_slope"))


def newest_with_hindcast(inits: DataFrame, hindcasts: DataFrame) -> DataFrame:
    """(init): the newest start on an odd day of the month for which a reforecast exists."""
    return inits.where(F.dayofmonth("init") % 2 == 1).join(hindcasts.select("init").distinct(), "init", "left_semi").agg(F.max("init").alias("init"))


def revised(stored: DataFrame, fresh: DataFrame, keys: list[str], since: Column) -> DataFrame:
    """What holds after a revision: fresh rows from ``since`` on replace all stored ones, older rows stay."""
    return stored.where(~since).unionByName(fresh.where(since)).select(stored.columns)


def running_mean(rows: DataFrame, by: list[str], at: str, days: int, value: str = "v") -> DataFrame:
    """rows with ``mean``, the mean of the last days + 1 positions, by value of the position, not by row."""
    w = Window.partitionBy(*by).orderBy(at).rangeBetween(-days, 0)
    return rows.withColumn("mean", F.avg(value).over(w))
