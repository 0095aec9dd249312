"""The design tensor: enumerate configurations, rank them, choose a metric, recipes and lead curves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Leads and transforms of the tensor; its scalar predictors; its field predictors with their methods and numbers of modes.
LEADS, TRANSFORMS = [0, 1, 2, 3, 4], ["raw", "anom"]
SCALARS = [("index", f"scalar{k}", "regression", 0) for k in range(10)]
FIELDS = [("field", f"domain{d}", m, n) for d in range(4) for m, n in (("cca", 3), ("cca", 5), ("pattern", 1), ("mean", 0))]


def tensor(spark: SparkSession, targets: list[str]) -> DataFrame:
    """One row per configuration of each target: 26 predictor settings by leads by transforms, with its key."""
    kinds = spark.createDataFrame(SCALARS + FIELDS, "source string, domain string, method string, modes int")
    cross = lambda name, kind, values: spark.createDataFrame([(v,) for v in values], f"{name} {kind}")
    rows = cross_all([cross("target", "string", targets), kinds, cross("lead", "int", LEADS), cross("transform", "string", TRANSFORMS)])
    return rows.withColumn("key", F.concat_ws("|", "target", "source", "domain", "method", F.concat(F.lit("m"), "modes"), F.concat(F.lit("L"), "lead"), "transform"))


def cross_all(parts: list[DataFrame], keep: Column | None = None) -> DataFrame:
    """Every combination of small dimension tables that a predicate admits."""
    rows = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)
    return rows if keep is None else rows.where(keep)


def best(rows: DataFrame, by: list[str], metric: str, tie: str) -> DataFrame:
    """The row of the largest metric of each group, the first tie key of equals."""
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last(metric), tie)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def top(rows: DataFrame, by: list[str], metric: Column, tie: str, n: int) -> DataFrame:
    """The first n rows of each group by a metric, with their ``place``."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(metric.desc_nulls_last(), tie))).where(F.col("place") <= n)


def choose_metric(long: DataFrame, reference: str) -> DataFrame:
    """(metric, agreement, value, total): each metric's rank agreement with a reference metric over the configurations, the reference's
    value at its own best configuration, and their sum with a thousandth of the value's weight. long: (key, metric, v)."""
    from .inference import spearman

    ref = long.where(F.col("metric") == reference).select("key", F.col("v").alias("y"))
    rows = long.join(ref, "key").withColumnRenamed("v", "x")
    agree = spearman(rows, ["metric"]).select("metric", F.col("rho").alias("agreement"))
    value = best(rows, ["metric"], "x", "key").select("metric", F.col("y").alias("value"))
    return agree.join(value, "metric").withColumn("total", F.col("agreement") + 0.001 * F.col("value"))


def lead_curve(rows: DataFrame, by: list[str], metric: str) -> DataFrame:
    """(by, lead, best): the best value at each lead."""
    return rows.groupBy(*by, "lead").agg(F.max(metric).alias("best"))


def useful_lead(curve: DataFrame, by: list[str], bar: float) -> DataFrame:
    """(by, useful_lead): the longest lead whose best value reaches the bar; null if none does."""
    return curve.groupBy(*by).agg(F.max(F.when(F.col("best") >= bar, F.col("lead"))).alias("useful_lead"))


def leads_wide(rows: DataFrame, by: str, metric: str, leads: list[int]) -> DataFrame:
    """A column of best values for each lead."""
    return rows.groupBy(by).pivot("lead", leads).agg(F.max(metric)).select(by, *[F.col(str(x)).alias(f"lead{x}") for x in leads])


def ordered_distinct(rows: DataFrame, value: str, at: str) -> DataFrame:
    """(value, at): each value once, with its first position."""
    return rows.groupBy(value).agg(F.min(at).alias(at))


def recipe_text(columns: list[str]) -> Column:
    return F.concat_ws(" / ", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in columns])
