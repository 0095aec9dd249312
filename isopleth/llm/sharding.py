"""Sharding by extendible hashing.

The directory is indexed by the leading bits of a row's hash. It starts with
one bucket; only buckets over the byte limit split, on one more bit, until
every bucket fits. Sizes come from a small table of hashes and bytes; a pass
over it sums the next ``STEP`` bits of the buckets that are still too large.
The first 32 bits hash the key, the next 28 the row's id, so that a key with
very many rows is split too, once its own bits are used up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Bits of a hash; bits that a pass adds; bytes of a shard.
BITS, STEP, LIMIT = 60, 8, 16 << 20


def row_hash(key: Column, row_id: Column) -> Column:
    """60 bits: 32 of the key's MD5 and 28 of the id's (from its bit 32 on, so that a key that is the id has its first 60)."""
    text = lambda c: F.md5(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.concat(F.substring(text(key), 1, 8), F.substring(text(row_id), 9, 7)), 16, 10).cast("long")


def _prefix(h: Column, depth: Column | int) -> Column:
    return F.shiftrightunsigned(h, BITS - depth) if isinstance(depth, int) else F.expr(f"shiftrightunsigned(h, {BITS} - depth)")


def directory(sizes: DataFrame, limit: int = LIMIT, scratch: Scratch | None = None) -> DataFrame:
    """(depth, prefix, shard_bytes, shard_rows): the buckets over (h, n_bytes). Buckets at the last bit may stay too large (rows with one hash)."""
    spark = sizes.sparkSession
    scratch = scratch or Scratch(spark, "sharding")
    leaves: DataFrame | None = None
    wanted = None
    for depth in range(0, BITS, STEP):
        step = min(STEP, BITS - depth)
        rows = sizes if wanted is None else sizes.select("h", "n_bytes", _prefix(F.col("h"), depth).alias("p0")).join(wanted, "p0", "left_semi")
        cells = rows.groupBy(_prefix(F.col("h"), depth + step).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        cells = scratch.write(cells, "cells")
        levels = cells.select("b", "n", "cell", F.explode(F.sequence(F.lit(0 if depth == 0 else 1), F.lit(step))).alias("k")).select(F.expr(f"shiftrightunsigned(cell, {step} - k)").alias("prefix"), (F.col("k") + depth).alias("depth"), "b", "n")
        nodes = levels.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        nodes = scratch.write(nodes, "nodes")
        over = nodes.where(F.col("shard_bytes") > limit)
        parents = over.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        top = F.col("depth") == (0 if depth == 0 else depth + 1)
        child = nodes.withColumn("up", F.shiftrightunsigned("prefix", 1))
        reached = child.where(top).unionByName(child.where(~top).join(parents, ["depth", "up"], "left_semi").select(child.columns))
        done = reached.where((F.col("shard_bytes") <= limit) | (F.col("depth") == BITS)).select("depth", "prefix", "shard_bytes", "shard_rows")
        leaves = done if leaves is None else leaves.unionByName(done)
        wanted = over.where(F.col("depth") == depth + step).select(F.col("prefix").alias("p0"))
        if depth + step == BITS or wanted.isEmpty():
            break
    return leaves


def shard(docs: DataFrame, limit: int = LIMIT, key_col: str = "doc_id", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: (doc_id, n_bytes, shard_id, shard_depth, shard_bytes, shard_rows); shard_id is the bucket's prefix in bits.

    Every shard holds at most ``limit`` bytes of text, save where one row or
    rows with one key and id exceed it. Null and empty texts have 0 bytes;
    null keys and ids hash like empty ones. Repeated rows share a shard; rows of
    equal sizes lie where their hashes say. A very long text over the limit
    lies in a shard of its own and rows with its hash. An empty table gives an
    empty result. Other columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    rows = docs.select(F.col(id_col).alias("doc_id"), row_hash(F.col(key_col), F.col(id_col)).alias("h"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    rows = scratch.write(rows, "sizes")
    leaves = scratch.write(directory(rows.select("h", "n_bytes"), limit, scratch), "directory")
    depths = sorted(r[0] for r in leaves.select("depth").distinct().collect())  # 61 values at most
    tried = rows.select("doc_id", "h", "n_bytes", F.explode(F.lit(depths).cast("array<int>")).alias("depth")).withColumn("prefix", _prefix(F.col("h"), F.col("depth")))
    named = tried.join(leaves, ["depth", "prefix"])
    return named.select("doc_id", "n_bytes", F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0"))).alias("shard_id"), F.col("depth").alias("shard_depth"), "shard_bytes", "shard_rows")
