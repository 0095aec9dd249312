"""Mixing sources to target weights by the cube method.

A source whose target is r times its words takes every document floor(r)
times, and once more with inclusion probability r - floor(r). The cube method
decides who: probabilities move along a vector of the null space of the
balancing constraints (documents and tokens of the source), so both totals
stay as they are while one document after another reaches 0 or 1.

A source's documents are dealt to blocks. Each block streams its documents
through a flight that holds three undecided documents at a time (two
constraints leave two undecided); the undecided of all blocks are dealt to
fewer blocks, until one block a source is left, whose last two documents are
landed on the totals nearest to the balanced ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import numbered
from .scratch import Scratch

#: Weights of sources in their order, repeating; share of all words that the mix takes; times that a document may be taken.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Documents of a block of the flight.
BLOCK = 4096

SIZE = r"size(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]++', 0))"


def targets(sizes: DataFrame, scratch: Scratch, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, n_docs, target): sources by code point, null last, with ``share`` of all words dealt by weight.

    A target stops at ``most`` times its source's size; each round shares
    what is left among the sources below, by weight, as sums over the table of sources.
    """
    found = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    found = numbered(found, [], [F.col("source").asc_nulls_last()], "place", scratch)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    found = scratch.write(found.select("source", "source_size", "n_docs", weight.alias("w")), "sources")
    total = found.agg(F.sum("source_size")).first()[0] or 0
    left, free, capped = share * total, None, F.lit(False)
    while True:
        full, rest = found.agg(F.sum(F.when(capped, most * F.col("source_size")).otherwise(0)), F.sum(F.when(capped, 0.0).otherwise(F.col("w")))).first()
        left = share * total - float(full or 0)
        if not rest or rest == free:
            break
        free, capped = rest, capped | (F.lit(left) * F.col("w") / rest > most * F.col("source_size"))
    target = F.when(capped, most * F.col("source_size").cast("double")).otherwise(F.lit(left) * F.col("w") / (rest or 1.0))
    return scratch.write(found.select("source", "source_size", "n_docs", target.alias("target")), "targets")


def _draw(held: list) -> float:
    """A number in [0, 1) from the keys of the documents held."""
    x = 0
    for key, *_ in held:
        x = ((x ^ key) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64
        x ^= x >> 29
    return (x * 0xBF58476D1CE4E5B9 % 2**64 >> 11) / 2**53


def move(held: list[list]) -> None:
    """Moves the probabilities of three documents [key, size, probability, ...] along the null vector of their counts and sizes until one is decided.

    Of the two ends of the line the nearer is the likelier, in proportion, so
    expectations stay as they are; the documents' keys decide.
    """
    (_, a, *_), (_, b, *_), (_, c, *_) = held
    u = (c - b, a - c, b - a)
    if u == (0, 0, 0):
        u = (1, -1, 0)
    up = [float("inf") if not v else (1 - d[2]) / v if v > 0 else d[2] / -v for d, v in zip(held, u, strict=True)]
    down = [float("inf") if not v else d[2] / v if v > 0 else (1 - d[2]) / -v for d, v in zip(held, u, strict=True)]
    rise = _draw(held) * (min(up) + min(down)) < min(down)
    ends = up if rise else down
    by = min(ends)
    for d, v, end in zip(held, u, ends, strict=True):
        ahead = (v > 0) == rise
        d[2] = (1.0 if ahead else 0.0) if end == by else min(max(d[2] + (by if rise else -by) * v, 0.0), 1.0)


def land(held: list[list]) -> None:
    """Decides the last documents so that the tokens taken are nearest to those due, then the documents."""
    due, n = sum(d[1] * d[2] for d in held), sum(d[2] for d in held)
    best = min(product((1.0, 0.0), repeat=len(held)), key=lambda x: (abs(sum(v * d[1] for v, d in zip(x, held, strict=True)) - due), abs(sum(x) - n), x))
    for d, v in zip(held, best, strict=True):
        d[2] = v


def _flights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with their new probabilities; they come sorted by block, and three undecided ones at most are held."""
    held: list[list] = []
    block, alone = None, False
    schema = None

    def packed(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{**row, "p": p} for _, _, p, row in rows], schema=schema)

    for batch in batches:
        schema = batch.schema
        done: list[list] = []
        for row in batch.to_pylist():
            if (row["source"], row["block"]) != block:
                if alone:
                    land(held)
                done += held
                held, block, alone = [], (row["source"], row["block"]), row["blocks"] == 1
            held.append([row["key"], row["size"], row["p"], row])
            if len(held) == 3:
                move(held)
                done += [d for d in held if not 0.0 < d[2] < 1.0]
                held = [d for d in held if 0.0 < d[2] < 1.0]
        yield packed(done)
    if alone:
        land(held)
    if held:
        yield packed(held)


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """A row per input row: (doc_id, source, size, source_size, target, taken); taken is a multiple of size, ``most`` times it at the most.

    Draws hang on the doc_id alone, so reruns agree and neither the deal of
    rows to files nor their order matters. Null texts have no words and are
    taken or left like others; a null source comes last; rows of one id (a
    null id too) lie in one block and stream through it in constant memory, and
    which of several equal rows is taken can't be told. Words of very long
    texts are counted in the JVM. An empty table gives an empty result. Other
    columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    sizes = scratch.write(docs.select("doc_id", "source", F.expr(SIZE).cast("long").alias("size")), "sizes")
    goal = targets(sizes, scratch, weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = sizes.join(goal.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "n_docs").withColumn("rate", rate)
    rows = rows.select("doc_id", "source", "size", "source_size", "target", F.floor("rate").alias("times"), (F.col("rate") - F.floor("rate")).alias("p"), F.xxhash64("doc_id").alias("key"))
    decided = F.col("p").isin(0.0, 1.0)
    done, pending, level = rows.where(decided), rows.where(~decided), 0
    while True:
        level += 1
        blocks = pending.groupBy(F.col("source").alias("_source")).agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
        blocks = scratch.write(blocks, "blocks")
        widest = blocks.agg(F.max("blocks")).first()[0]
        if widest is None:
            break
        dealt = pending.join(blocks, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.lit(level), "doc_id"), "blocks"))
        dealt = dealt.repartition("source", "block").sortWithinPartitions("source", "block", F.desc("size"), "key", "doc_id")
        flown = scratch.write(dealt.mapInArrow(_flights, dealt.schema).drop("block", "blocks"), "flown")
        done, pending = done.unionByName(flown.where(decided)), flown.where(~decided)
        if widest == 1:
            break
    return done.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("times") + F.col("p").cast("long"))).alias("taken"))
