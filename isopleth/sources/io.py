"""Readers, writers and guards: tolerant scans, restartable appends, refusal of degenerate tables, content hashes."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isopleth.functions.scalar import clean, number


def shared_folder(spark: SparkSession, name: str) -> str:
    """The name of a new folder that the driver and all executors share, deleted at the session's end.

    It lies under spark.checkpoint.dir; where that is unset, a local session has a default and any other one is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file:///tmp/checkpoints/isopleth"
    parent = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(parent)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return f"{parent}/{name}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """rows, written once to a new shared folder and read back: what several branches of a plan start from."""
    path = shared_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def read_field(spark: SparkSession, path: str, schema: T.StructType, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """A field (cell, lat, lon, year, month, v) with a fixed schema, NaN as null, cut to a box (south, north, west, east) in the scan.

    An empty selection fails the job that reads it, rather than giving nothing: one that counts a column's values is part of the plan.
    """
    rows = spark.read.schema(schema).parquet(path)
    if box:
        rows = rows.where(F.col("lat").between(box[0], box[1]) & F.col("lon").between(box[2], box[3]))
        rows = _only_if(rows, rows.agg(F.count("lat").alias("n")), F.col("n") == 0, f"no cell of {path} lies in {box}")
    return rows.withColumn("v", clean(F.col("v")))


def _only_if(rows: DataFrame, facts: DataFrame, bad: Column, message: str) -> DataFrame:
    """rows, the job failing where ``bad`` holds for the one row of facts."""
    ok = facts.select(F.when(bad, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)).alias("_ok"))
    return rows.crossJoin(F.broadcast(ok)).where("_ok").drop("_ok")  # one row on the other side


def read_family(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """All files of a folder that match a pattern, with ``member`` from the file's stem."""
    rows = spark.read.option("pathGlobFilter", pattern).parquet(folder)
    return rows.withColumn("member", F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1))


def read_csv(spark: SparkSession, path: str, schema: str, required: list[str] = (), nulls: str = "None") -> DataFrame:
    """A CSV with a header and a fixed schema; rows without a required value are dropped."""
    return spark.read.csv(path, schema=schema, header=True, nullValue=nulls).dropna(subset=list(required) or None, how="any" if required else "all")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a JSON-lines file: lines that don't parse, or that report an error, are counted apart."""
    raw = spark.read.text(path).select("value", F.from_json("value", schema + ", error string, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("value", "r.*")
    bad = F.col("_corrupt").isNotNull() | F.col("error").isNotNull()
    return raw.where(~bad).drop("value", "error", "_corrupt"), raw.where(bad).select("value", "error")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=True)


def pipe_table(lines: DataFrame) -> DataFrame:
    """(pos, cells) of the rows of Markdown tables in lines (pos, value), separators left out."""
    rows = lines.where(F.trim("value").startswith("|") & ~F.col("value").rlike(r"^\s*\|[\s|:-]*\|\s*$"))
    inner = F.regexp_replace(F.trim("value"), r"^\||\|$", "")
    return rows.select("pos", F.transform(F.split(inner, r"\|"), lambda c: F.trim(c)).alias("cells"))


def cell_number(cells: Column, k: int) -> Column:
    return number(F.get(cells, F.lit(k)))


def routed(catalog: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """A catalog whose rows give way to overriding rows of the same key."""
    return catalog.join(overrides.select(key), key, "left_anti").unionByName(overrides)


def cached(spark: SparkSession, folder: str, source: DataFrame, params: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """build(source), kept under the hash of source's rows and the parameters; a second call with both alike reads it."""
    digest = content_hash(source)
    path = f"{folder}/{digest}_{params}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        build(source).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def content_hash(rows: DataFrame) -> str:
    """A hash of a table's rows that doesn't depend on their order: sums of row hashes, in one aggregation."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(rows.columns)]
    h = F.conv(F.substring(F.sha2(F.concat_ws("\1", *cols), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    got = rows.agg(F.count("*").alias("n"), F.sum(h).alias("h")).first()
    return f"{got.n:x}-{int(got.h or 0):x}"


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    rows.select(*columns).write.mode("overwrite").csv(path, header=True)


def json_rows(rows: DataFrame, digits: int = 8) -> DataFrame:
    """(json): a line per row, doubles rounded and without NaN."""
    fixed = [F.round(clean(F.col(c)), digits).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes]
    return rows.select(F.to_json(F.struct(*fixed)).alias("json"))


def append_missing(spark: SparkSession, todo: DataFrame, path: str, keys: list[str], compute: Callable[[DataFrame], DataFrame]) -> int:
    """Computes and appends only the keys of todo that the table at path lacks; returns how many those were. Safe to repeat."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        todo = todo.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    n = todo.count()
    if n:
        compute(todo).write.mode("append").parquet(path)
    return n


def guarded(rows: DataFrame, value: str, least_share: float = 0.01) -> DataFrame:
    """rows, refused (the job fails) if too few values are finite or all finite ones are equal."""
    v = clean(F.col(value))
    s = rows.agg(F.try_divide(F.count(v), F.count("*")).alias("share"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    bad = (F.coalesce("share", F.lit(0.0)) < least_share) | F.coalesce(F.col("lo") == F.col("hi"), F.lit(True))
    return _only_if(rows, s, bad, "degenerate table refused")


def covering(rows: DataFrame, boxes: dict[str, tuple[float, float, float, float]]) -> DataFrame:
    """rows (lat, lon), refused unless some latitude and some longitude lie in every box (south, north, west, east)."""
    facts = rows.agg(*[F.coalesce(F.max(c.between(a, b).cast("int")), F.lit(0)).alias(f"{axis}_{k}") for k, (s, n, w, e) in enumerate(boxes.values()) for axis, c, a, b in (("lat", F.col("lat"), s, n), ("lon", F.col("lon"), w, e))])
    bad = reduce(lambda x, y: x | y, [F.col(c) == 0 for c in facts.columns])
    return _only_if(rows, facts, bad, f"a box of {', '.join(boxes)} isn't covered: refused")


def exact_months(rows: DataFrame, first: int, last: int) -> DataFrame:
    """rows (year, month), refused unless their distinct months are all of first to last, no more and no fewer."""
    at = (F.col("year") * 12 + F.col("month") - 1).alias("at")
    facts = rows.select(at).distinct().agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    good = (F.col("n") == (last - first + 1) * 12) & (F.col("lo") == first * 12) & (F.col("hi") == last * 12 + 11)
    return _only_if(rows, facts, ~F.coalesce(good, F.lit(False)), f"months aren't those of {first} to {last}: refused")


def complete(rows: DataFrame, replicates: int, arms: int) -> DataFrame:
    """(n, n_keys, n_errors, ok) of a sweep (replicate, arm, error): exactly replicates by arms unique rows and no error."""
    s = rows.agg(F.count("*").alias("n"), F.count_distinct("replicate", "arm").alias("n_keys"), F.count_if(F.col("error").isNotNull()).alias("n_errors"))
    want = replicates * arms
    return s.withColumn("ok", (F.col("n") == want) & (F.col("n_keys") == want) & (F.col("n_errors") == 0))


def markdown_lines(rows: DataFrame, order: str) -> DataFrame:
    """(pos, value): the lines of a Markdown table of rows in the order of a column, its head and its rule first; null cells are empty."""
    line = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    body = rows.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order)) + 1).cast("long").alias("pos"), line([F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]).alias("value"))
    head = [(0, "| " + " | ".join(rows.columns) + " |"), (1, "| " + " | ".join(["---"] * len(rows.columns)) + " |")]
    return rows.sparkSession.createDataFrame(head, "pos long, value string").unionByName(body)


def write_markdown(rows: DataFrame, path: str, order: str) -> None:
    """Writes a (small) table as one Markdown file."""
    markdown_lines(rows, order).coalesce(1).sortWithinPartitions("pos").select("value").write.mode("overwrite").text(path)
