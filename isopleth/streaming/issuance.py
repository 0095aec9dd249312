"""Rolling issuances as streams: per-issuance partitions, idempotent batches, complete windows only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def issue(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Appends each micro-batch's new keys to the table at path, partitioned by ``init``. A batch that is run again adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        new = batch.dropDuplicates(keys)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            new = new.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
        new.write.mode("append").partitionBy("init").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_means(daily: DataFrame, span: str, n_days: int, late: str = "14 days", day: str | None = None) -> DataFrame:
    """(cell, window, v): means of tumbling windows of a stream (ts, cell, v), given once the watermark has passed them and only if every day is there.

    The days of a window that have come are kept as a set, of at most as many dates as the span has; they are the dates
    of ts, or of another column where ts is not the time itself.
    """
    rows = daily.withWatermark("ts", late).groupBy("cell", F.window("ts", span)).agg(F.avg("v").alias("v"), F.size(F.collect_set(F.to_date(day or "ts"))).alias("days"))
    return rows.where(F.col("days") == n_days).select("cell", F.col("window.start").alias("start"), "v")


def rescore(path: str, fresh: DataFrame, day: str, last: str, days: int = 14) -> None:
    """Overwrites the partitions of the last ``days`` days with fresh rows: revisions replace, where a watermark would drop them."""
    recent = fresh.where(F.col(day) > F.date_sub(F.lit(last).cast("date"), days))
    recent.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
