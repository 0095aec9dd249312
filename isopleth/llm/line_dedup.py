"""Line dedup over levelled sorted runs of line hashes (DataFrame functions only).

Documents arrive in batches. A batch's distinct line keys become one sorted
run of 128-bit hashes. The batch is merge-anti-joined with every run that
exists: what is left are the keys whose first holder is in this batch. The
run then gets its own rows: how many documents of the batch hold the key and,
for first-seen keys only, their holder. When a level has ``fanout`` runs they
are merged into one run of the next level, so the number of runs to probe
stays logarithmic in the number of batches.

Runs are bucketed and sorted by hash, so neither the probes nor the
compactions shuffle a run again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, delete

#: The white space that a key loses at both ends, and the letters that it lower-cases.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = -(2**63)
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z lower-cased; other letters stay.

    ``lower`` is much faster than ``translate`` and does the same to ASCII lines.
    """
    bare = F.trim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


#: Bytes of documents for each bucket of a run and for each batch, beyond the least number of either; most buckets that Spark allows.
BUCKET_BYTES, BATCH_BYTES, MOST_BUCKETS, LEAST_BATCHES = 1 << 30, 4 << 40, 100_000, 4


def plan_bytes(df: DataFrame) -> int:
    """The planner's estimate of a table's size, from its files' sizes; no job runs. 0 where it knows nothing (rows that aren't from files)."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 60 else 0


class LineRuns:
    """The levelled runs. ``add`` takes a batch of (h1, h2, id), later batches having the smaller ids."""

    def __init__(self, spark: SparkSession, fanout: int = 2, n_bytes: int = 0):
        self.spark, self.fanout = spark, fanout
        self.buckets = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // BUCKET_BYTES)))
        self.scratch = Scratch(spark, "line-runs")
        self.levels: list[list[str]] = []
        self._tag = uuid.uuid4().hex[:12]
        self._n = 0

    def _store(self, df: DataFrame) -> str:
        self._n += 1
        name = f"line_run_{self._tag}_{self._n}"
        (
            df.repartition(self.buckets, *HASH).write.option("path", f"{self.scratch.path}/{name}").option("compression", "zstd")
            .bucketBy(self.buckets, *HASH).sortBy(*HASH).saveAsTable(name)
        )
        return name

    def _forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(self.spark, f"{self.scratch.path}/{name}")

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _merged(self, names: list[str]) -> DataFrame:
        """One run of several: keys are unique in a run, so two runs merge by a full outer sort-merge join of their buckets."""
        rows = self.spark.table(names[0])
        for name in names[1:]:
            other = self.spark.table(name).select(*HASH, F.col("n").alias("n2"), F.col("top").alias("top2")).hint("merge")
            rows = rows.join(other, HASH, "full_outer").select(*HASH, (F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n"), F.greatest("top", "top2").alias("top"))
        return rows

    def add(self, batch: DataFrame) -> None:
        """Anti-joins the batch with the runs, adds its run and compacts full levels."""
        own = batch.select(*HASH, "id").distinct().groupBy(*HASH).agg(F.count("id").alias("n"), F.max("id").alias("top"))
        fresh = own = self.scratch.write(own, "own")
        for name in self.runs():
            fresh = fresh.join(self.spark.table(name).select(*HASH).hint("merge"), HASH, "left_anti")
        rows = fresh.select(*HASH, F.lit(0).cast("long").alias("n"), "top").unionByName(own.select(*HASH, "n", F.lit(None).cast("long").alias("top")))
        stored = self._store(rows.groupBy(*HASH).agg(F.sum("n").alias("n"), F.max("top").alias("top")))
        self.scratch.drop(own)
        level = 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(stored)
            if len(self.levels[level]) < self.fanout:
                return
            full, self.levels[level] = self.levels[level], []
            stored = self._store(self._merged(full))
            for name in full:
                self._forget(name)
            level += 1

    def close(self) -> None:
        """Drops all runs."""
        for name in self.runs():
            self._forget(name)
        self.levels = []

    def keys(self) -> DataFrame:
        """(h1, h2, n, top): over all batches, the number of documents with the key and the largest id among them."""
        if not self.runs():
            return self.spark.createDataFrame([], "h1 long, h2 long, n long, top long")
        return self._merged(self.runs())


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, n_batches: int | None = None, fanout: int = 2, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Drops repeated lines. A row per input row: (doc_id, n_lines, n_dropped, kept_text), with ``carry`` a struct ``carried`` of the row's other columns too.

    A key (see ``line_key``) of at least ``min_chars`` code points that at
    least ``min_docs`` documents hold stays only in the document with the
    largest id, all its lines there included. Hashes are 128 bits wide.

    Null or empty texts are one empty line and keep it. A null id counts as
    one document whose id is below all others. Rows with one id are one
    document for the count; each such row is returned. Lines that repeat in
    one document alone stay. A document that loses every line keeps the empty
    text. Very long texts are split whole, by the JVM. An empty table gives an
    empty result. Other columns are ignored, whatever their names.

    The number of buckets of a run and, unless said, of batches grows with the
    size of the table.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "line-dedup")
    n_bytes = plan_bytes(docs)
    n_batches = n_batches or max(LEAST_BATCHES, min(64, -(-n_bytes // BATCH_BYTES)))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *([F.struct(*[F.col(c) for c in docs.columns if c != text_col]).alias("carried")] if carry else []))
    more = ["carried"] if carry else []
    base = base.select("*", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("rid"))
    cuts = sorted(set(base.agg(F.percentile_approx("id", [k / n_batches for k in range(1, n_batches)], 1000)).first()[0] or []))
    batch = F.lit(0)
    for cut in cuts:
        batch = batch + (F.col("id") <= cut).cast("int")
    lines = base.select("id", "rid", batch.alias("batch"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.select("id", "rid", "batch", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    keys = scratch.write(keys.select("id", "rid", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "batch"), "keys", ["batch"])
    runs = LineRuns(spark, fanout, n_bytes)
    for k in range(len(cuts) + 1):
        runs.add(keys.where(F.col("batch") == k))
    # a plain table, not the runs' buckets: adaptive execution splits a very common line's rows only where both sides are shuffled
    common = scratch.write(runs.keys().where(F.col("n") >= min_docs), "common")
    runs.close()
    dropped = keys.join(common, HASH).where(F.col("id") != F.col("top")).groupBy("id", "rid").agg(F.collect_set("pos").alias("lost"))
    split = base.join(dropped, ["id", "rid"], "left").select(*more, "doc_id", "text", "lost", F.split("text", "\n", -1).alias("lines"))
    # "lines" is used more than once in the next step, so the optimizer doesn't fold the split into the function over the kept positions
    kept = split.select(*more, "doc_id", "text", "lines", F.size("lines").cast("long").alias("n_lines"), F.when(F.col("lost").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "lost")).alias("kept"))
    kept = kept.select(*more, "doc_id", "n_lines", F.when(F.col("kept").isNull(), 0).otherwise(F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), "text", "lines", "kept")
    return kept.select(*more, "doc_id", "n_lines", "n_dropped", F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join(F.transform("kept", lambda i: F.get(F.col("lines"), i)), "\n")).alias("kept_text"))
