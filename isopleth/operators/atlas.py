"""The walk-forward atlas: select a predictor for every zone and window, forecast terciles, score, pool, adjudicate.

``replicate`` is just another key, so all permutation replicates are one job.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isopleth.functions.calendar import abs_month, month_length, wraps_col
from isopleth.functions.prob import rps, tercile, with_terciles
from isopleth.functions.scalar import area_weight, with_stats
from isopleth.sources.io import written

from .discovery import zone_means, zone_windows
from .inference import donors

KEYS = ["replicate", "fold", "zone", "window"]

#: Probabilistic metrics by name: (forecast scores, keys) -> one row per key.
METRICS: dict[str, Callable[[DataFrame, list[str]], DataFrame]] = {}


def register_metric(name: str):
    def keep(f):
        METRICS[name] = f
        return f

    return keep


def folds(spark: SparkSession, splits: list[tuple[list[int], list[int]]]) -> DataFrame:
    """(fold, year, is_train) of lists of training and test years."""
    rows = [(k, int(y), flag) for k, (a, b) in enumerate(splits) for years, flag in ((a, True), (b, False)) for y in years]
    return spark.createDataFrame(rows, "fold int, year int, is_train boolean")


def edges(rows: DataFrame, by: list[str], train: Column) -> DataFrame:
    """rows with t33 and t67, linear-interpolated thirds of the training values of y."""
    y = F.when(train, F.col("y"))
    return with_stats(rows, by, t33=F.percentile(y, F.lit(1 / 3)), t67=F.percentile(y, F.lit(2 / 3)))


def supported(rows: DataFrame, least: int = 10) -> DataFrame:
    """Rows (KEYS, key, year, is_train, x, y) of the years that all zones and keys of a fold's window have; windows with fewer
    than ``least`` training years or without a test year are left out."""
    by = ["replicate", "fold", "window"]
    have = rows.where("x IS NOT NULL AND y IS NOT NULL")
    each = have.groupBy(*by, "year", "is_train").agg(F.count("*").alias("n"))
    most = rows.select(*by, "zone", "key").distinct().groupBy(*by).agg(F.count("*").alias("most"))
    good = each.join(most, by).where("n = most").drop("n", "most")
    enough = good.groupBy(*by).agg(F.count_if("is_train").alias("a"), F.count_if(~F.col("is_train")).alias("b")).where((F.col("a") >= least) & (F.col("b") > 0)).select(*by)
    return have.join(good.join(enough, by).select(*by, "year"), [*by, "year"], "left_semi")


def left_out_errors(train: DataFrame, by: list[str]) -> DataFrame:
    """(by, loyo_mse, sigma, vy, slope, icpt, n_train) of y on x, each year predicted without itself; constant x has an infinite error."""
    s = train.groupBy(*by).agg(F.count("y").alias("n"), F.avg("x").alias("mx"), F.var_pop("y").alias("vy"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("icpt"), F.nullif(F.regr_sxx("y", "x"), F.lit(0.0)).alias("sxx"))
    e = (F.col("y") - F.col("icpt") - F.col("slope") * F.col("x")) / F.greatest(1 - 1 / F.col("n") - F.pow(F.col("x") - F.col("mx"), F.lit(2)) / F.col("sxx"), F.lit(1e-12))
    first = [F.first(c).alias(c) for c in ("vy", "slope", "icpt")]
    return train.join(s, by).groupBy(*by).agg(F.coalesce(F.avg(e * e), F.lit(float("inf"))).alias("loyo_mse"), F.stddev_pop(e).alias("sigma"), *first, F.first("n").alias("n_train"))


def select(rows: DataFrame) -> DataFrame:
    """Rows of the chosen key of each replicate, fold, zone and window: the least left-out error in training, the first key of equals.

    rows: KEYS, key, year, is_train, x, y.
    """
    by = [*KEYS, "key"]
    loo = left_out_errors(rows.where("is_train"), by)
    best = loo.withColumn("k", F.row_number().over(Window.partitionBy(*KEYS).orderBy("loyo_mse", "key"))).where("k = 1").drop("k", "vy")
    return rows.join(best, by)


def select_shared(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """As select(), with one key for all zones of a fold's window: the least weighted sum of error over variance (each at most 1e6)."""
    by = [*KEYS, "key"]
    loo = left_out_errors(rows.where("is_train"), by)
    ratio = F.least(F.lit(1e6), F.col("loyo_mse") / F.coalesce(F.nullif("vy", F.lit(0.0)), F.lit(1.0)))
    shared = ["replicate", "fold", "window"]
    total = loo.join(weights.select("fold", "zone", "window", "weight"), ["fold", "zone", "window"]).groupBy(*shared, "key").agg(F.sum(F.col("weight") * ratio).alias("cost"))
    best = total.withColumn("k", F.row_number().over(Window.partitionBy(*shared).orderBy("cost", "key"))).where("k = 1").select(*shared, "key")
    return rows.join(loo.drop("vy").join(best, [*shared, "key"], "left_semi"), by)


def score(chosen: DataFrame) -> DataFrame:
    """(KEYS, year, key, n_train, loyo_mse, p, obs, rps_f, rps_c) of the test years of select()'s rows; no fit has equal thirds."""
    rows = edges(chosen, KEYS, F.col("is_train")).where("NOT is_train")
    third = F.lit(1 / 3)
    mean, sigma = F.col("icpt") + F.col("slope") * F.col("x"), F.col("sigma")
    rows = with_terciles(rows, mean, sigma, F.col("t33"), F.col("t67"), "_p")
    rows = rows.withColumn("p", F.when(F.col("loyo_mse") < float("inf"), F.col("_p")).otherwise(F.array(third, third, third)))
    rows = rows.withColumn("obs", tercile(F.col("y"), F.col("t33"), F.col("t67")))
    return rows.select(*KEYS, "year", "key", "n_train", "loyo_mse", "p", "obs", rps(F.get("p", F.lit(0)), F.get("p", F.lit(1)), F.col("obs")).alias("rps_f"), rps(third, third, F.col("obs")).alias("rps_c"))


def climatological(scores: DataFrame) -> DataFrame:
    """The scores of the climatology arm: equal thirds for everything that was scored."""
    third = F.lit(1 / 3)
    return scores.withColumns({"p": F.array(third, third, third), "rps_f": F.col("rps_c"), "loyo_mse": F.lit(None).cast("double"), "key": F.lit("climatology")})


def forecast_windows(found: DataFrame, parts: DataFrame, forced: dict[str, list[int]]) -> DataFrame:
    """(fold, zone, window, months, total, discovered): the zones' own windows, and forced ones for zones that lack their label."""
    own = found.select("fold", "zone", F.col("label").alias("window"), "months", "total", F.lit(True).alias("discovered"))
    if not forced:
        return own
    table = parts.sparkSession.createDataFrame(list(forced.items()), "window string, months array<int>")
    more = parts.select("fold", "zone").distinct().crossJoin(F.broadcast(table)).join(own, ["fold", "zone", "window"], "left_anti")  # a handful of rows
    return own.unionByName(more.select("fold", "zone", "window", "months", F.lit(None).cast("double").alias("total"), F.lit(False).alias("discovered")))


def window_weights(parts: DataFrame, windows: DataFrame, cells: DataFrame, rule: str = "equal") -> DataFrame:
    """windows with ``zone_share``, a zone's share of its fold's area, and ``weight``: that share over the zone's discovered
    windows, equally or by rainfall (``total``); a forced window carries the whole share. cells: (cell, w)."""
    area = parts.join(cells, "cell").groupBy("fold", "zone").agg(F.sum("w").alias("a"))
    share = area.withColumn("zone_share", F.col("a") / F.sum("a").over(Window.partitionBy("fold"))).drop("a")
    w, found = Window.partitionBy("fold", "zone"), F.col("discovered")
    if rule == "equal":
        part = 1 / F.sum(found.cast("int")).over(w)
    elif rule == "rainfall":
        part = F.col("total") / F.nullif(F.sum(F.when(found, F.col("total"))).over(w), F.lit(0.0))
    else:
        raise ValueError(f"no weight rule {rule!r}")
    out = windows.withColumn("_part", F.when(found, part).otherwise(1.0)).join(share, ["fold", "zone"])
    return out.withColumn("weight", F.col("zone_share") * F.col("_part")).drop("_part")


def season_targets(means: DataFrame, windows: DataFrame) -> DataFrame:
    """(fold, zone, window, year, y): totals of discovery.zone_means() over each window's months, labelled by its last month's year; complete seasons only."""
    rows = means.join(windows.select("fold", "zone", "window", "months"), ["fold", "zone"]).where(F.array_contains("months", F.col("month")))
    late = wraps_col(F.col("months")) & (F.col("month") >= F.element_at("months", 1))
    season = rows.withColumn("season", F.col("year") + late.cast("int")).groupBy("fold", "zone", "window", "season")
    out = season.agg(F.sum(F.col("mean") * month_length(F.col("month"))).alias("y"), F.count("mean").alias("n"), F.first(F.size("months")).alias("size")).where("n = size")
    return out.select("fold", "zone", "window", F.col("season").alias("year"), "y")


def components(series: DataFrame, windows: DataFrame, gaps: list[int], width: int = 2) -> DataFrame:
    """(window, gap, box, year, v): the mean of ``width`` months of each box series (box, year, month, v) that end gap + 1 months
    before the window starts, for the season of that year; a missing month makes none."""
    wanted = windows.select("window", "months").distinct().crossJoin(series.select("year").distinct())  # both small
    wanted = wanted.withColumn("gap", F.explode(F.array(*[F.lit(g) for g in gaps]))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    first = (F.col("year") - wraps_col(F.col("months")).cast("int")) * 12 + F.element_at("months", 1) - 1
    wanted = wanted.select("window", "gap", "year", (first - 1 - F.col("gap") - F.col("k")).alias("am"))
    rows = wanted.join(series.select("box", abs_month(F.col("year"), F.col("month")).alias("am"), "v"), "am")
    return rows.groupBy("window", "gap", "box", "year").agg(F.when(F.count("v") == width, F.avg("v")).alias("v"))


def fold_predictors(parts: DataFrame, folds: DataFrame, compose: dict[str, Callable[[dict[str, Column], dict[str, Column]], Column]], boxes: list[str], leak: bool = False) -> DataFrame:
    """(fold, window, key, year, is_train, x): named indices of components, rebuilt for every fold.

    ``compose`` gets two dictionaries of the boxes' columns, plain and standardised by the fold's training years (with
    ``leak`` by all years), so that no constant of an index comes from a test year. A key is the index and the gap.
    """
    wide = parts.groupBy("window", "gap", "year").pivot("box", boxes).agg(F.first("v"))
    rows = wide.join(F.broadcast(folds), "year")  # folds times years
    w = Window.partitionBy("fold", "window", "gap")
    fitted = lambda b: F.col(b) if leak else F.when(F.col("is_train"), F.col(b))
    z = {b: F.coalesce((F.col(b) - F.avg(fitted(b)).over(w)) / F.nullif(F.stddev_pop(fitted(b)).over(w), F.lit(0.0)), F.col(b) * 0.0) for b in boxes}
    rows = rows.withColumns({f"_z_{b}": c for b, c in z.items()})
    plain, standard = {b: F.col(b) for b in boxes}, {b: F.col(f"_z_{b}") for b in boxes}
    made = F.array(*[F.struct(F.lit(name).alias("index"), f(plain, standard).alias("x")) for name, f in compose.items()])
    out = rows.select("fold", "window", "gap", "year", "is_train", F.explode(made).alias("m"))
    return out.select("fold", "window", F.concat_ws("|", F.col("m.index"), F.col("gap").cast("string")).alias("key"), "year", "is_train", F.col("m.x").alias("x"))


@dataclass(frozen=True)
class Arm:
    """Switches of an atlas run: its zones (own or pooled into one), its choice of predictors, leaks and weights."""

    name: str
    pooled: bool = False
    shared: bool = False
    climatology: bool = False
    leak: bool = False
    weights: str = "equal"


#: The arms that every null replicate has.
ARMS = (Arm("zones-specific"), Arm("zones-shared", shared=True), Arm("pooled", pooled=True), Arm("climatology", climatology=True))


def run_atlas(field: DataFrame, series: DataFrame, folds: DataFrame, parts: DataFrame, compose: dict, boxes: list[str], arms: tuple[Arm, ...] = ARMS, replicates: int = 0, forced: dict[str, list[int]] | None = None, gaps: tuple[int, ...] = (0, 1, 2, 3), least: int = 10) -> DataFrame:
    """Scores of every arm, replicate, fold, zone, window and test year, with weight, zone_share and discovered.

    field: (cell, lat, lon, year, month, v); series: (box, year, month, v); folds: (fold, year, is_train); parts: (fold, cell,
    zone) of discover(). Replicate 0 is the real run; the others give each fold's targets other years' values, one map for
    all its zones and windows, over the years that all of them have. Discovery isn't repeated. The rows that the arms share
    are written once.
    """
    cells = field.select("cell", "lat").distinct().select("cell", area_weight(F.col("lat")).alias("w"))
    out = []
    for pooled in sorted({a.pooled for a in arms}):
        zones = parts.withColumn("zone", F.lit(0)) if pooled else parts
        means = written(zone_means(field, zones), "atlas-means")
        windows = window_weights(zones, forecast_windows(zone_windows(means, folds), zones, forced or {}), cells)
        windows = written(windows, "atlas-windows")
        y = season_targets(means, windows)
        parts_x = components(series, windows, list(gaps))
        for leak in sorted({a.leak for a in arms if a.pooled == pooled}):
            x = fold_predictors(parts_x, folds, compose, boxes, leak)
            real = x.join(y, ["fold", "window", "year"]).withColumn("replicate", F.lit(0))
            usable = written(supported(real, least), "atlas-rows")
            common = usable.select("fold", "window", "year").distinct().groupBy("fold", "year").agg(F.count("*").alias("n"))
            most = usable.select("fold", "window").distinct().groupBy("fold").agg(F.count("*").alias("most"))
            places = common.join(most, "fold").where("n = most").select("fold", F.col("year").alias("place"))
            rows = usable.drop("replicate").join(places.withColumnRenamed("place", "year"), ["fold", "year"], "left_semi")
            if replicates:
                moved = donors(places, replicates, ["fold"]).withColumnRenamed("place", "year").drop("k")
                given = rows.select("fold", "zone", "window", "year", "y").distinct().withColumnRenamed("year", "donor")
                rows = rows.drop("y").join(moved, ["fold", "year"]).join(given, ["fold", "zone", "window", "donor"]).drop("donor")
            else:
                rows = rows.withColumn("replicate", F.lit(0))
            rows = written(rows.select(*KEYS, "key", "year", "is_train", "x", "y"), "atlas-moved")
            for arm in [a for a in arms if a.pooled == pooled and a.leak == leak]:
                weighted = windows if arm.weights == "equal" else window_weights(zones, windows.drop("zone_share", "weight"), cells, arm.weights)
                got = score(select_shared(rows, weighted) if arm.shared else select(rows))
                got = climatological(got) if arm.climatology else got
                out.append(got.join(weighted.select("fold", "zone", "window", "months", "weight", "zone_share", "discovered"), ["fold", "zone", "window"]).withColumn("arm", F.lit(arm.name)))
    return reduce(DataFrame.unionByName, out)


def atlas_families(scores: DataFrame, by: list[str]) -> DataFrame:
    """(family, by, rpss, n): pooled skill over the discovered windows, and over each forced label at the zones' whole area share."""
    own = scores.where("discovered").withColumn("family", F.lit("all windows"))
    label = scores.withColumn("weight", F.col("zone_share")).withColumn("family", F.col("window"))
    return pooled_skill(own.unionByName(label.join(scores.where("NOT discovered").select("window").distinct(), "window", "left_semi")), ["family", *by])


@register_metric("rpss")
def pooled_skill(scores: DataFrame, by: list[str]) -> DataFrame:
    """(by, rpss, n): 1 - weighted sum of scores over that of climatology's, never a mean of ratios."""
    w = F.col("weight")
    return scores.groupBy(*by).agg((1 - F.try_divide(F.sum(w * F.col("rps_f")), F.sum(w * F.col("rps_c")))).alias("rpss"), F.count("*").alias("n"))


@register_metric("hit_rate")
def hit_rate(scores: DataFrame, by: list[str]) -> DataFrame:
    """(by, hit_rate, n): how often the most probable category happened."""
    return scores.groupBy(*by).agg(F.avg((F.array_position("p", F.array_max("p")) - 1 == F.col("obs")).cast("double")).alias("hit_rate"), F.count("*").alias("n"))


def coverage(scores: DataFrame, by: list[str], n_folds: int) -> DataFrame:
    """(by, coverage): summed weight of the zone-windows with a scored year, a fold."""
    once = scores.groupBy(*by, "fold", "zone", "window").agg(F.first("weight").alias("weight"))
    return once.groupBy(*by).agg((F.sum("weight") / n_folds).alias("coverage"))


def fold_summary(scores: DataFrame, by: list[str]) -> DataFrame:
    """(by, mean, std, min, max) of the folds' own skill."""
    each = scores.groupBy(*by, "fold").agg((1 - F.try_divide(F.sum("rps_f"), F.sum("rps_c"))).alias("s"))
    return each.groupBy(*by).agg(F.avg("s").alias("mean"), F.stddev_pop("s").alias("std"), F.min("s").alias("min"), F.max("s").alias("max"))


def families(scores: DataFrame, by: list[str], chosen: dict[str, Column]) -> DataFrame:
    """(family, by, rpss, n): pooled skill of each family, a predicate over the same scores."""
    tagged = scores.withColumn("family", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in chosen.items()]))))
    return pooled_skill(tagged, ["family", *by])


def condition(scores: DataFrame, index: DataFrame, threshold: Callable[[Column, Column], Column]) -> DataFrame:
    """Scores of the test years whose index value passes a threshold made of the training years' mean and deviation.

    index: (fold, year, is_train, v).
    """
    stats = index.where("is_train").groupBy("fold").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    years = index.where("NOT is_train").join(F.broadcast(stats), "fold").where(threshold(F.col("m"), F.col("s")) > F.col("v")).select("fold", "year")
    return scores.join(years, ["fold", "year"], "left_semi")


def paired(scores: DataFrame, a: str, b: str) -> DataFrame:
    """(replicate, diff): skill of arm a less that of arm b in each replicate. scores: (arm, replicate, rpss)."""
    return scores.where(F.col("arm").isin(a, b)).groupBy("replicate").agg((F.max(F.when(F.col("arm") == a, F.col("rpss"))) - F.max(F.when(F.col("arm") == b, F.col("rpss")))).alias("diff"))
