"""Secondary benchmarks over zones: fixed-mean and gridded scoring, zones against latitude bands, persistence sensitivity, expert overlap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isopleth.functions.prob import rps, t_two_sided, tercile, with_terciles
from isopleth.functions.scalar import corr, with_stats

from .inference import gap_interval, williams
from .regress import loyo, loyo_skill, split_fit


def fixed_mean(rows: DataFrame) -> DataFrame:
    """(fold, year, pred, sigma, obs_mean): zone predictions averaged by area and re-scaled to the area mean by a training regression.

    rows: (fold, zone, w, year, is_train, x, y). sigma comes from predictions that leave each training year out of both regressions.
    """

    def line(x, y):
        b = np.cov(x, y, ddof=0)[0, 1] / x.var() if x.var() > 0 else 0.0
        return b, y.mean() - b * x.mean()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = (pdf.pivot(index="year", columns="zone", values=v) for v in ("x", "y"))
        w = pdf.groupby("zone")["w"].first().reindex(x.columns).to_numpy()
        w = w / w.sum()
        train = pdf.groupby("year")["is_train"].first().reindex(x.index).to_numpy()
        x, y = x.to_numpy(), y.to_numpy()
        target = y @ w

        def predict(fit: np.ndarray, at: np.ndarray) -> np.ndarray:
            lines = [line(x[fit, z], y[fit, z]) for z in range(x.shape[1])]
            mean = lambda k: sum(w[z] * (lines[z][0] * x[k, z] + lines[z][1]) for z in range(x.shape[1]))
            b, a = line(mean(fit), target[fit])
            return a + b * mean(at)

        fit, test = np.flatnonzero(train), np.flatnonzero(~train)
        left = np.array([target[i] - predict(fit[fit != i], np.array([i]))[0] for i in fit])
        years = np.array(sorted(pdf["year"].unique()))
        return pd.DataFrame({"fold": pdf["fold"].iloc[0], "year": years[test], "pred": predict(fit, test), "sigma": max(1e-9, left.std()), "obs_mean": target[test]})

    return rows.groupBy("fold").applyInPandas(one, "fold int, year int, pred double, sigma double, obs_mean double")


def gridded(cells: DataFrame, signal: DataFrame) -> DataFrame:
    """(fold, rpss, n): every cell scored on its own terciles with its zone's predictor. cells: (fold, cell, zone, year, is_train, y); signal: (fold, zone, year, x)."""
    by = ["fold", "cell"]
    rows = split_fit(cells.join(signal, ["fold", "zone", "year"]), by, F.col("is_train"))
    y = F.when(F.col("is_train"), F.col("y"))
    rows = with_stats(rows, by, t33=F.percentile(y, F.lit(1 / 3)), t67=F.percentile(y, F.lit(2 / 3))).where("NOT is_train AND pred IS NOT NULL")
    rows = with_terciles(rows, F.col("pred"), F.col("sigma"), F.col("t33"), F.col("t67"))
    obs, third = tercile(F.col("y"), F.col("t33"), F.col("t67")), F.lit(1 / 3)
    s = rows.select("fold", rps(F.get("p", F.lit(0)), F.get("p", F.lit(1)), obs).alias("f"), rps(third, third, obs).alias("c"))
    return s.groupBy("fold").agg((1 - F.try_divide(F.sum("f"), F.sum("c"))).alias("rpss"), F.count("*").alias("n"))


def zones_against_bands(scores: DataFrame, sizes: DataFrame, least: int, share: float) -> DataFrame:
    """(kind, unit, best): largest absolute correlation of each zone or band; zones need enough cells and a share of the bands' mean level.

    scores: (kind, unit, predictor, r); sizes: (kind, unit, n, level).
    """
    bar = sizes.where("kind = 'band'").agg(F.avg("level").alias("bar"))
    ok = sizes.crossJoin(F.broadcast(bar)).where((F.col("kind") == "band") | (F.col("n") >= least) & (F.col("level") >= share * F.col("bar"))).select("kind", "unit")
    return scores.join(ok, ["kind", "unit"], "left_semi").groupBy("kind", "unit").agg(F.max(F.abs("r")).alias("best"))


def persistence_sensitivity(rows: DataFrame, draws: DataFrame, by: list[str], level: float = 0.8) -> DataFrame:
    """(by, days, model_r, model_rmse, persist_r, gain, t, p, lo, hi, n): a model against persistence over several lengths, all by left-out predictions.

    rows: (by, days, place, model, anchor, y). The correlations, the test of their difference (Williams, n - 3 degrees,
    two-sided) and the interval of the gain on shared draws belong to one statistic: predictions that leave their own
    place out. A length whose anchor is missing at a place does without it; under five places there is no p.
    """
    keys = [*by, "days"]
    base = rows.groupBy(*by, "place").agg(F.first("model").alias("x"), F.first("y").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    model = loyo(base, by).select(*by, "place", F.col("loo").alias("m"))
    skill = loyo_skill(base, by).select(*by, F.col("loo_r").alias("model_r"), F.col("loo_rmse").alias("model_rmse"))
    anchored = rows.where("anchor IS NOT NULL AND y IS NOT NULL").select(*keys, "place", F.col("anchor").alias("x"), "y")
    both = loyo(anchored, keys).select(*keys, "place", "y", F.col("loo").alias("p")).join(model, [*by, "place"])
    found = both.groupBy(*keys).agg(corr("m", "p").alias("r12"), F.count(F.col("m") + F.col("p")).alias("n"))
    found = found.join(loyo_skill(anchored, keys).select(*keys, F.col("loo_r").alias("r2")), keys).join(skill, by).withColumn("r1", F.col("model_r"))
    tested = williams(found).withColumn("p", F.when(F.col("t").isNotNull(), t_two_sided(F.col("t"), F.col("n") - 3)))
    interval = gap_interval(both.select(*keys, "place", F.col("m").alias("x1"), F.col("p").alias("x2"), "y"), draws, keys, level)
    out = tested.join(interval, keys, "left")
    return out.select(*keys, "model_r", "model_rmse", F.col("r2").alias("persist_r"), (F.col("model_r") - F.col("r2")).alias("gain"), "t", "p", "lo", "hi", "n")


def persistence_table(rows: DataFrame, draws: DataFrame, by: list[str], days: tuple[int, ...] = (7, 14, 30), level: float = 0.8) -> DataFrame:
    """persistence_sensitivity() with a row a group: (by, model_r, model_rmse, and persist{d}_r, gain{d}, p{d}, gain{d}_lo, gain{d}_hi of each length)."""
    long = persistence_sensitivity(rows, draws, by, level)
    of = lambda d, c, name: F.max(F.when(F.col("days") == d, F.col(c))).alias(name)
    wide = [of(d, c, n) for d in days for c, n in (("persist_r", f"persist{d}_r"), ("gain", f"gain{d}"), ("p", f"p{d}"), ("lo", f"gain{d}_lo"), ("hi", f"gain{d}_hi"))]
    return long.groupBy(*by).agg(F.max("model_r").alias("model_r"), F.max("model_rmse").alias("model_rmse"), *wide)


def expert_overlap(parts: DataFrame, experts: DataFrame) -> DataFrame:
    """(zone, region, of_zone, of_region): shares of a zone in an expert's region and of the region in the zone. Both: (cell, name)."""
    both = parts.join(experts, "cell").groupBy("zone", "region").agg(F.count("*").alias("n"))
    z, r = parts.groupBy("zone").agg(F.count("*").alias("nz")), experts.groupBy("region").agg(F.count("*").alias("nr"))
    return both.join(z, "zone").join(r, "region").select("zone", "region", (F.col("n") / F.col("nz")).alias("of_zone"), (F.col("n") / F.col("nr")).alias("of_region"))


def _normal(*parts: Column) -> Column:
    """A standard normal number made of a hash of the parts, the same whenever it is evaluated."""
    unit = lambda k: (F.shiftrightunsigned(F.xxhash64(F.lit(k), *parts), 11) + 1) / 2.0**53
    return F.sqrt(-2 * F.log(unit("radius"))) * F.cos(2 * F.pi() * unit("angle"))


def two_zone_field(spark: SparkSession, years: int = 30, rows: int = 8, columns: int = 10, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """A planted field (cell, lat, lon, year, month, v) of two zones, and the box series (box, year, month, v) that drive them.

    The western half has one rainy season (August) driven by box "a", the eastern two (April, November) driven by "b"; "c"
    drives nothing. A box has one value a year and a little noise by month. Made by hashes in Spark, at any size.
    """
    seed_ = F.lit(seed)
    month = spark.range(1, 13).select(F.col("id").cast("int").alias("month"))
    year = spark.range(1981, 1981 + years).select(F.col("id").cast("int").alias("year"))
    drive = lambda box: _normal(seed_, F.lit(box), F.col("year"))
    cells = spark.range(rows * columns).select(F.col("id").cast("int").alias("cell"), (-5 + 17.0 * F.floor(F.col("id") / columns) / max(1, rows - 1)).alias("lat"), (33 + 19.0 * (F.col("id") % columns) / max(1, columns - 1)).alias("lon"))
    grid = cells.crossJoin(F.broadcast(year.crossJoin(month)))  # the months of a record
    bump = lambda at, width: F.exp(-F.pow(F.col("month") - at, F.lit(2)) / (2 * width * width))
    west = F.col("lon") < 42.5
    base = F.when(west, bump(8, 1.2)).otherwise(bump(4, 1.1) + bump(11, 1.1))
    v = base * (1 + 0.55 * F.when(west, drive("a")).otherwise(drive("b"))) * 5 + 0.25 * _normal(seed_, F.col("cell"), F.col("year"), F.col("month"))
    boxes = spark.createDataFrame([("a",), ("b",), ("c",)], "box string").crossJoin(year).crossJoin(month)
    series = boxes.select("box", "year", "month", (_normal(seed_, F.col("box"), F.col("year")) + 0.05 * _normal(seed_, F.col("box"), F.col("year"), F.col("month"))).alias("v"))
    return grid.select("cell", "lat", "lon", "year", "month", F.greatest(F.lit(0.01), v).alias("v")), series
