"""Places of rows in the order of their group, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch


def numbered(rows: DataFrame, group: list[str], order: list[Column], name: str, scratch: Scratch) -> DataFrame:
    """rows with ``name``: the place from 1 on in the row's group by ``order``.

    Rows are dealt to tasks by ranges of group and order, so a hot group is
    cut into as many ranges as it needs; a row's place is its place in its
    range and the sizes of the group's earlier ranges.
    """
    dealt = rows.repartitionByRange(*[F.col(g) for g in group], *order) if group else rows.repartitionByRange(*order)
    dealt = scratch.write(dealt.withColumn("_range", F.spark_partition_id()), name)
    sizes = dealt.groupBy("_range", *group).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_range", *group, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range", *group).orderBy(*order)
    placed = dealt.withColumn("_place", F.row_number().over(inside)).join(before, ["_range", *group])
    return placed.select(*rows.columns, (F.col("_before") + F.col("_place")).alias(name))
