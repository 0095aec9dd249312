"""Functions for SQL users, defined in SQL so that they stay inside the optimiser."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .prob import normal_cdf_sql


def register(spark: SparkSession) -> None:
    """Temporary functions normal_cdf(x), rps3(p0, p1, obs) and season_year(year, month, last)."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION normal_cdf(x DOUBLE) RETURNS DOUBLE RETURN {normal_cdf_sql('x')}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION rps3(p0 DOUBLE, p1 DOUBLE, obs INT) RETURNS DOUBLE RETURN 5e-1 * (power(p0 - CAST(obs <= 0 AS INT), 2) + power(p0 + p1 - CAST(obs <= 1 AS INT), 2))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION season_year(y INT, m INT, last INT) RETURNS INT RETURN y + CAST(m > last AS INT)")
