"""Gridded and panel views of the driver's tables: the reference's own inputs are rasters that aren't at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isopleth.functions.calendar import abs_month


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession) -> DataFrame:
    """The 25 cells with their pseudo places: (cell, lat, lon, w)."""
    c = spark.range(25).select(F.col("id").cast("int").alias("cell"))
    c = c.select("cell", (F.lit(2.5) * (F.col("cell") - 12)).alias("lat"), (F.lit(14.4) * F.col("cell")).alias("lon"))
    return c.withColumn("w", F.cos(F.radians("lat")))


def whole_cents(v: str):
    """Millions of a sum of amounts, added up as whole cents: the same in any order of the rows."""
    return F.sum(F.round(F.col(v) * 100).cast("long")) / 1e8


def month_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, year, month, v): order value in millions by customers' nation and month."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("int").alias("cell"))
    rows = o.join(c, o.o_custkey == c.c_custkey)
    return rows.groupBy("cell", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(whole_cents("o_totalprice").alias("v"))


def week_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, period, v): order value in millions by cell and week since 1995-01-01."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("int").alias("cell"))
    week = F.floor(F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")) / 7).cast("int")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy("cell", week.alias("period")).agg(whole_cents("o_totalprice").alias("v"))


def day_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, member, day, v): mean event value by type, member (user modulo 10) and day 1 to 30 of January 2024."""
    e = table(spark, sf_dir, "events")
    day = (F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1).cast("int")
    return e.groupBy(F.col("event_type").alias("cell"), F.pmod("user_id", F.lit(10)).cast("int").alias("member"), day.alias("day")).agg(F.avg("value").alias("v"))


#: DuckDB SQL of the same panels, as common table expressions.
CELLS_SQL = "dim AS (SELECT cell, 2.5e0 * (cell - 12) AS lat, 14.4e0 * cell AS lon, cos(radians(2.5e0 * (cell - 12))) AS w FROM (SELECT unnest(range(0, 25))::INT AS cell))"
MONTH_SQL = "pm AS (SELECT c_nationkey::INT AS cell, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, sum(round(o_totalprice * 100)::BIGINT) / 1e8 AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)"
WEEK_SQL = "pw AS (SELECT c_nationkey::INT AS cell, floor(date_diff('day', DATE '1995-01-01', o_orderdate::DATE) / 7)::INT AS period, sum(round(o_totalprice * 100)::BIGINT) / 1e8 AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"
DAY_SQL = "pd AS (SELECT event_type AS cell, (user_id % 10)::INT AS member, (date_diff('day', DATE '2024-01-01', ts::DATE) + 1)::INT AS day, avg(value) AS v FROM events GROUP BY 1, 2, 3)"


def with_abs(panel: DataFrame) -> DataFrame:
    return panel.withColumn("am", abs_month(F.col("year"), F.col("month")))
