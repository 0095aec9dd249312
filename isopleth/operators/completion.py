"""Seasons completed by their nearest earlier years, and how dry the completed totals are.

The part of a season that is known is a vector of months; the years whose
same months were nearest give the rest. The search is exact and doesn't
compare every pair: the distance of two vectors is at least the distance of
their means times the root of their length, so only years whose means lie
near enough can be among the nearest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def partial_seasons(rows: DataFrame, by: list[str], months: list[int], known: int) -> DataFrame:
    """(by, year, head, rest): the first ``known`` months of a season as an array, and the total of the others, of rows (by, year, month, v).

    ``months`` are in order and may wrap into the next year; a season goes by the year of its first month. Seasons with a
    missing known month are left out; ``rest`` is null where a later month is missing.
    """
    at = F.array_position(F.array(*[F.lit(m) for m in months]), F.col("month")).cast("int")
    year = F.col("year") - F.when(F.col("month") < months[0], 1).otherwise(0)
    placed = rows.where(F.col("month").isin(months) & F.col("v").isNotNull()).select(*by, year.cast("int").alias("year"), at.alias("at"), "v")
    head = F.transform(F.array_sort(F.collect_list(F.when(F.col("at") <= known, F.struct("at", "v")))), lambda s: s["v"])
    later = len(months) - known
    rest = F.when(F.count(F.when(F.col("at") > known, 1)) == later, F.coalesce(F.sum(F.when(F.col("at") > known, F.col("v"))), F.lit(0.0)))
    return placed.groupBy(*by, "year").agg(head.alias("head"), rest.alias("rest")).where(F.size("head") == known)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def nearest_years(seasons: DataFrame, by: list[str], k: int, past_only: bool = False) -> DataFrame:
    """(by, year, donor, d, place): the k nearest other years of each season by the distance of their heads; ties go to the earlier year.

    seasons: (by, year, head, rest); donors have a rest, and are earlier years where ``past_only``. A first bound is the
    k-th distance among the 2 k years that lie next to a season in the order of means (k on each side); then only years whose
    means are within that bound, over the root of the length, are compared. That drops no nearest year.
    """
    root = F.sqrt(F.size("head").cast("double"))
    mean = F.aggregate("head", F.lit(0.0), lambda s, v: s + v) / F.size("head")
    points = seasons.withColumns({"m": mean, "root": root})
    donors = points.where("rest IS NOT NULL")
    order = Window.partitionBy(*by).orderBy("m", "year")
    near = donors.select(*by, "year", "m", "head", F.row_number().over(order).alias("r"))
    # a season's place among the donors: how many have a smaller mean
    marks = points.select(*by, "year", "m", "head", F.lit(1).alias("asks"), F.lit(None).cast("int").alias("r")).unionByName(near.withColumn("asks", F.lit(0)))
    place = marks.withColumn("below", F.coalesce(F.max("r").over(Window.partitionBy(*by).orderBy("m", "asks", "year").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))).where("asks = 1").drop("r", "asks")
    ok = F.col("donor") < F.col("year") if past_only else F.col("donor") != F.col("year")
    give = near.select(*by, F.col("year").alias("donor"), F.col("head").alias("other"), "r")
    tried = place.withColumn("r", F.explode(F.sequence(F.col("below") - k, F.col("below") + k + 1))).join(give, [*by, "r"]).where(ok)
    bound = tried.withColumn("d", distance(F.col("head"), F.col("other"))).groupBy(*by, "year").agg(F.array_sort(F.collect_list("d")).alias("ds"))
    bound = bound.select(*by, "year", F.get("ds", F.lit(k - 1)).alias("bound"))  # null: fewer than k were tried, all are compared
    asked = points.join(bound, [*by, "year"], "left").select(*by, "year", "head", "m", "root", "bound")
    other = donors.select(*by, F.col("year").alias("donor"), F.col("head").alias("other"), F.col("m").alias("om"))
    within = F.col("bound").isNull() | (F.abs(F.col("m") - F.col("om")) * F.col("root") <= F.col("bound") * (1 + 1e-9) + 1e-12)
    pairs = asked.join(other, by).where(ok & within).select(*by, "year", "donor", distance(F.col("head"), F.col("other")).alias("d"))
    ranked = pairs.withColumn("place", F.row_number().over(Window.partitionBy(*by, "year").orderBy("d", "donor")))
    return ranked.where(F.col("place") <= k)


def completed(seasons: DataFrame, near: DataFrame, by: list[str]) -> DataFrame:
    """(by, year, known, total, spread, n): each season's known part, the mean of its completions by the near years' rests, and their deviation."""
    known = seasons.select(*by, "year", F.aggregate("head", F.lit(0.0), lambda s, v: s + v).alias("known"))
    rest = seasons.where("rest IS NOT NULL").select(*by, F.col("year").alias("donor"), "rest")
    sums = near.join(rest, [*by, "donor"]).groupBy(*by, "year").agg(F.avg("rest").alias("rest"), F.stddev_pop("rest").alias("spread"), F.count("*").alias("n"))
    return known.join(sums, [*by, "year"]).select(*by, "year", "known", (F.col("known") + F.col("rest")).alias("total"), "spread", "n")


def frequency_below(seasons: DataFrame, near: DataFrame, by: list[str], quantiles: dict[str, float]) -> DataFrame:
    """(by, year, below_<name>...): the share of a season's completions under each quantile of the group's whole seasons (linear between values)."""
    head = F.aggregate("head", F.lit(0.0), lambda s, v: s + v)
    whole = seasons.where("rest IS NOT NULL").select(*by, F.col("year").alias("donor"), "rest", (head + F.col("rest")).alias("total"))
    edges = whole.groupBy(*by).agg(*[F.percentile("total", q).alias(f"_{name}") for name, q in quantiles.items()])
    known = seasons.select(*by, "year", head.alias("known"))
    rows = near.join(whole.select(*by, "donor", "rest"), [*by, "donor"]).join(known, [*by, "year"]).join(edges, by)
    return rows.groupBy(*by, "year").agg(*[F.avg((F.col("known") + F.col("rest") < F.col(f"_{name}")).cast("double")).alias(f"below_{name}") for name in quantiles])
