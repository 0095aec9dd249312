"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its whole text: how often each
byte and each (hashed) pair of bytes occurs, and measures of its words and
lines. Strengths are learnt from preference pairs, each a document labelled 1
over one labelled 0, by logistic loss on the difference of their features.
All labelled documents are learnt from: they are dealt to blocks by a hash of
the id, pairs are made within a block, and in each round all blocks go on from
the mean of the last round's weights (iterative parameter mixing).
The threshold is the quantile of the strengths at the labels' share of 0, and
a score is the probability that the document beats one on that threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import labelled
from .scratch import Scratch

PAIR_BUCKETS, MEASURES = 1024, 12
SIZE = 256 + PAIR_BUCKETS + MEASURES
#: Preference pairs for each preferred document; labelled rows of a block; steps of a block in a round; learning rate of each round.
RIVALS, BLOCK, STEPS, RATES = 8, 4096, 40, (0.03, 0.03, 0.02, 0.02, 0.01, 0.01, 0.005, 0.005)
#: Strengths that the driver takes at once to find the threshold.
FEW = 10_000


def features(text: str | None) -> np.ndarray:
    """The feature vector of a whole text; null and empty texts have zeros."""
    out = np.zeros(SIZE, np.float32)
    raw = np.frombuffer((text or "").encode("utf-8"), np.uint8)
    if not len(raw):
        return out
    single, pairs = np.zeros(256, np.int64), np.zeros(PAIR_BUCKETS, np.int64)
    for at in range(0, len(raw), 1 << 20):  # bounded memory for very long texts
        part = raw[at : at + (1 << 20) + 1].astype(np.uint32)
        single += np.bincount(part[: 1 << 20], minlength=256)
        pairs += np.bincount(((part[:-1] * 256 + part[1:]) * np.uint32(2654435761)) >> np.uint32(22), minlength=PAIR_BUCKETS)
    out[:256] = np.sqrt(single / len(raw))
    out[256:-MEASURES] = np.sqrt(pairs / max(1, len(raw) - 1))
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    kinds = set(words)
    letters = sum(single[65:91]) + sum(single[97:123])
    out[-MEASURES:] = [
        np.log1p(len(raw)) / 10,
        len(kinds) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        sum(map(str.isupper, words)) / n,
        sum(map(str.isalpha, words)) / n,
        min(4.0, len(raw) / n / 10),
        1 - len(set(lines)) / len(lines),
        sum(single[48:58]) / len(raw),
        sum(single[128:]) / len(raw),
        letters / len(raw),
        (np.log1p(n) - np.log1p(len(kinds))) / 4,
        1.0,
    ]
    return out


def fit(x: np.ndarray, y: np.ndarray, zero_share: float, rivals: int = RIVALS, epochs: int = 40, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and threshold. x: a row per document; y: its label; zero_share: the share of label 0 among all labels."""
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return np.zeros(x.shape[1], np.float32), 0.0 if len(bad) else -1.0
    sd = x.std(axis=0) + 1e-3
    z = x / sd
    w, m, v, step = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    a, b = np.repeat(good, rivals), rng.choice(bad, len(good) * rivals)
    for _ in range(epochs):
        order = rng.permutation(len(a))
        for at in range(0, len(order), 1024):
            k = order[at : at + 1024]
            d = z[a[k]] - z[b[k]]
            g = -(d.T @ (1 / (1 + np.exp(np.clip(d @ w, -30, 30))))) / len(k) + 1e-3 * w
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    s = z @ w
    weight = np.where(y == 0, zero_share / len(bad), (1 - zero_share) / len(good))
    order = np.argsort(s, kind="stable")
    at = int(np.searchsorted(np.cumsum(weight[order]), zero_share - 1e-9))
    at = min(at, len(s) - 2)
    return (w / sd).astype(np.float32), float((s[order[at]] + s[order[at + 1]]) / 2)


def _advanced(z: np.ndarray, y: np.ndarray, w: np.ndarray, rate: float, seed: int, rivals: int = RIVALS) -> tuple[np.ndarray, int]:
    """A block's weights after some steps of Adam on the loss of its pairs, and its number of pairs; z: scaled features."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return w, 0
    a, b = np.repeat(good, rivals), np.random.default_rng(seed).choice(bad, len(good) * rivals)
    w, m, v = w.copy(), np.zeros(len(w)), np.zeros(len(w))
    for step in range(1, STEPS + 1):
        s = z @ w.astype(np.float32)
        p = 1 / (1 + np.exp(np.clip(s[a] - s[b], -30, 30)))
        pull = np.bincount(a, p, len(y)) - np.bincount(b, p, len(y))
        g = -(pull.astype(np.float32) @ z) / len(a) + 1e-3 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w, len(a)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(block, labels, features) of each row of a table of blocks."""
    for batch in batches:
        for block, y, x in zip(*batch.columns, strict=True):
            y = np.frombuffer(y.as_py(), np.int8)
            yield block.as_py(), y, np.frombuffer(pa.decompress(x.as_py(), len(y) * SIZE * 4, codec="zstd"), np.float32).reshape(-1, SIZE)


def _by_block(blocks: DataFrame, made: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """What ``made`` gives for each block, in the order of blocks: as many rows as blocks, each of a model's size."""

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, y, x in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([made(block, y, x).astype(np.float64).tobytes()], pa.binary())], ["block", "v"])

    found = blocks.mapInArrow(mapper, "block long, v binary").toArrow().sort_by("block")
    return np.stack([np.frombuffer(x, np.float64) for x in found["v"].to_pylist()])


def fit_blocks(blocks: DataFrame, zero_share: float, scratch: Scratch) -> tuple[np.ndarray, float]:
    """Weights and threshold from all blocks, (block, y, x); the same for the same blocks, wherever they lie."""
    context = blocks.sparkSession.sparkContext
    sums = _by_block(blocks, lambda _, y, x: np.concatenate([[len(y), (y == 0).sum()], x.sum(axis=0, dtype=float), np.square(x, dtype=float).sum(axis=0)])).sum(axis=0)
    n, zeros, mean = sums[0], sums[1], sums[2 : 2 + SIZE] / sums[0]
    if zeros in (0, n):
        return np.zeros(SIZE, np.float32), 0.0 if zeros else -1.0
    sd = np.sqrt(np.maximum(sums[2 + SIZE :] / n - mean**2, 0)) + 1e-3
    w = np.zeros(SIZE)
    for turn, rate in enumerate(RATES):
        held = context.broadcast((w, sd.astype(np.float32)))

        def moved(block: int, y: np.ndarray, x: np.ndarray, held=held, turn=turn, rate=rate) -> np.ndarray:
            w, pairs = _advanced(x / held.value[1], y, held.value[0], rate, block * len(RATES) + turn)
            return np.append(w * pairs, pairs)

        total = _by_block(blocks, moved).sum(axis=0)
        w = total[:-1] / total[-1] if total[-1] else w
    weights = (w / sd).astype(np.float32)
    shared = context.broadcast(weights)

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, y, x in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array((x @ shared.value).astype(np.float64)), pa.array(y.astype(np.int64))], ["s", "y"])

    s = blocks.mapInArrow(strengths, "s double, y long").groupBy("s").agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"))
    return weights, crossing(scratch.write(s, "strengths"), zero_share / zeros, (1 - zero_share) / (n - zeros), zero_share)


def crossing(values: DataFrame, w0: float, w1: float, share: float, few: int = FEW) -> float:
    """Halfway between the least value up to which the weights reach ``share`` and the next one. values: (s, n0, n1), distinct s with rows of weight w0 and w1.

    Ranges that the driver holds are narrowed, a count of 1,024 of them at a time, until few values are left.
    """
    lo, hi, n = values.agg(F.min("s"), F.max("s"), F.count("*")).first()
    least, before0, before1 = lo, 0, 0
    while n > few:
        bin_ = F.least(F.floor((F.col("s") - F.lit(lo)) / F.lit((hi - lo) / 1024)), F.lit(1023)).alias("bin")
        bins = values.where(F.col("s").between(lo, hi)).groupBy(bin_).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.min("s").alias("lo"), F.max("s").alias("hi"), F.count("*").alias("n")).orderBy("bin").collect()
        for r in bins:
            if (before0 + r.n0) * w0 + (before1 + r.n1) * w1 >= share - 1e-9 or r is bins[-1]:
                lo, hi, n = r.lo, r.hi, r.n
                break
            before0, before1 = before0 + r.n0, before1 + r.n1
    at = lo
    for r in values.where(F.col("s").between(lo, hi)).orderBy("s").collect():
        at, before0, before1 = r.s, before0 + r.n0, before1 + r.n1
        if before0 * w0 + before1 * w1 >= share - 1e-9:
            break
    following = values.where(F.col("s") > at).agg(F.min("s")).first()[0]
    if following is None:  # the last value: halfway to the one before
        following = values.where(F.col("s") < at).agg(F.max("s")).first()[0] if at > least else at
    return float((at + following) / 2)


def learn(docs: DataFrame, labels: DataFrame, rows: Column, label: str = "quality", sample: int | None = None) -> tuple[np.ndarray, float]:
    """Fits on all labelled documents that ``rows`` admits, or on about ``sample`` a class where that is asked for.

    Up to ``BLOCK`` of them are one fit; more are fitted block by block. The
    same rows give the same model in whatever order they come. An id with
    several label rows has the largest of them. Null labels and ids are left
    out; without labels the model scores all alike.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py()).tobytes() for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(1), pa.array(x, pa.binary())], ["doc_id", "label", "x"])

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("label", "ascending"), ("x", "ascending")])  # rows that are alike in all are the same
        x = pa.compress(b"".join(table["x"].to_pylist()), codec="zstd", asbytes=True)
        return pa.table([table["block"].slice(0, 1), pa.array([table["label"].to_numpy().astype(np.int8).tobytes()], pa.binary()), pa.array([x], pa.binary())], ["block", "y", "x"])

    shares = labels.where(rows & F.col(label).isNotNull()).agg(F.avg((F.col(label) == 0).cast("double"))).first()[0]
    if sample is None:
        scratch = Scratch(docs.sparkSession, "quality")
        chosen = labels.where(rows & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
        chosen = docs.where(rows).select("doc_id", "text").join(chosen.hint("merge"), "doc_id")  # labels grow with the corpus: never broadcast
    else:
        chosen = labelled(docs, labels, label, rows, sample)
    found = chosen.select("text", "label", F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(made, "doc_id long, label int, x binary")
    if sample is None:
        found = scratch.write(found, "features")
        n = found.count()
        if n > BLOCK:
            many = F.pmod(F.xxhash64(F.lit("block"), "doc_id", F.md5("x")), F.lit(-(-n // BLOCK)))
            blocks = scratch.write(found.withColumn("block", many).groupBy("block").applyInArrow(packed, "block long, y binary, x binary"), "blocks")
            return fit_blocks(blocks, shares, scratch)
    got = found.toArrow()  # a block at the most
    if not got.num_rows:
        return np.zeros(SIZE, np.float32), 0.0
    ordered = sorted(zip(*(got[c].to_pylist() for c in ("doc_id", "label", "x"))))  # rows that are alike in all are the same
    return fit(np.frombuffer(b"".join(x for _, _, x in ordered), np.float32).reshape(-1, SIZE), np.array([y for _, y, _ in ordered]), shares)


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", out_col: str = "quality_score") -> DataFrame:
    """docs with a column ``out_col`` (0 to 1, never null), by whole texts.

    Null and empty texts get the score of all-zero features; very long texts
    are counted in parts. Ties, repeated rows and other columns stay as they
    are; a column of that name is replaced. An empty table gives an empty
    result.
    """
    w, threshold = model
    shared = docs.sparkSession.sparkContext.broadcast(w)

    @F.pandas_udf("double")
    def scored(texts):
        raw = np.array([float(features(t) @ shared.value) for t in texts])
        return pd.Series(1 / (1 + np.exp(-np.clip(raw - threshold, -30, 30))))

    return docs.withColumn(out_col, scored(F.col(text_col)))
