"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in its
(hashed) words; the document's is their noisy-or. Only document labels are
needed: the gradient of a document's loss reaches its sentences in proportion
to how much each explains the label. What is learnt then locates the
offending sentences.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import labelled, unused

BUCKETS = 1 << 17
#: Labelled rows to fit on, a class. A bucket gets a weight if it occurs in so many documents of that sample and
#: its share of documents differs between the classes by so many standard errors.
SAMPLE, LEAST_DOCS, LEAST_Z = 3000, 8, 5.0
SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]*")
WORD = re.compile(r"\w+")


class _Buckets(dict):
    """Bucket of a word, remembered; the memory starts anew when it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        out = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        return out


_BUCKETS = _Buckets()


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Buckets of all words, the number of words of each sentence that has any, and the sentences' places (code points)."""
    ids, sizes, spans = [], [], []
    for m in SENTENCE.finditer(text or ""):
        words = WORD.findall(m.group().lower())
        if words:
            ids.extend(map(_BUCKETS.__getitem__, words))
            sizes.append(len(words))
            spans.append(m.span())
    return np.array(ids, np.int32), np.array(sizes, np.int64), spans


def sentence_logits(w: np.ndarray, bias: float, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    if not len(sizes):
        return np.zeros(0)
    return bias + np.add.reduceat(w[ids], np.concatenate([[0], np.cumsum(sizes)[:-1]]))


def noisy_or(logits: np.ndarray) -> float:
    """1 minus the product of (1 - p) over the sentences."""
    return float(-np.expm1(-np.logaddexp(0, logits).sum()))


def fit(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, one_share: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias. bags: (word buckets, words of each sentence) of each document; one_share: the share of label 1 among all labels."""
    w = np.zeros(BUCKETS)
    first = {(ids.tobytes(), int(one)): k for k, ((ids, _), one) in reversed(list(enumerate(zip(bags, y))))}  # copies count once
    bags, y = [bags[k] for k in sorted(first.values())], y[sorted(first.values())]
    if not len(bags) or not y.any() or y.all():
        return w.astype(np.float32), 8.0 if len(y) and y.all() else -12.0
    df = np.zeros((2, BUCKETS), np.int64)
    for (ids, _), one in zip(bags, y):
        df[one, np.unique(ids)] += 1
    n, both = np.bincount(y, minlength=2), df.sum(axis=0)
    spread = np.sqrt(both * np.maximum(n.sum() - both, 1) * (1 / n[0] + 1 / n[1])) / n.sum()
    kept = np.flatnonzero((both >= LEAST_DOCS) & (np.abs(df[1] / n[1] - df[0] / n[0]) >= LEAST_Z * np.maximum(spread, 1e-12)))
    place = np.full(BUCKETS, len(kept))
    place[kept] = np.arange(len(kept))
    ids = place[np.concatenate([b[0] for b in bags])]
    sizes = np.concatenate([b[1] for b in bags])
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    doc = np.repeat(np.arange(len(bags)), [len(b[1]) for b in bags])
    weight = np.where(y == 1, one_share / y.sum(), (1 - one_share) / (len(y) - y.sum()))
    p = np.zeros(len(kept) + 1)
    bias = float(np.log(one_share / max(1.0, len(sizes) / len(bags))))
    m, v, mb, vb = np.zeros_like(p), np.zeros_like(p), 0.0, 0.0
    for step in range(1, rounds + 1):
        z = bias + np.bincount(sentence, p[ids], minlength=len(sizes))
        total = np.bincount(doc, np.logaddexp(0, z), minlength=len(bags))
        slope = np.where(y == 1, -1 / np.expm1(np.clip(total, 1e-6, 50)), 1.0) * weight
        gz = slope[doc] / (1 + np.exp(-np.clip(z, -30, 30)))
        g = np.bincount(ids, gz[sentence], minlength=len(p)) + 1e-6 * p
        g[-1], gb = 0.0, gz.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        p -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-5)
        bias -= 0.05 * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-5)
    w[kept] = p[:-1]
    return w.astype(np.float32), float(bias)


def learn(docs: DataFrame, labels: DataFrame, rows: Column, label: str = "toxic", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Fits on about ``sample`` labelled documents a class (a documented bound), out of those that ``rows`` admits."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [bag(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0].tobytes() for x in bags], pa.binary()), pa.array([x[1].tobytes() for x in bags], pa.binary()), b.column(1), b.column(2)], ["ids", "sizes", "label", "doc_id"])

    share = labels.where(rows & F.col(label).isNotNull()).agg(F.avg((F.col(label) != 0).cast("double"))).first()[0] or 0.0
    got = labelled(docs, labels, label, rows, sample).select("text", "label", "doc_id").mapInArrow(made, "ids binary, sizes binary, label int, doc_id long").toArrow()
    ordered = sorted(zip(*(got[c].to_pylist() for c in ("doc_id", "label", "ids", "sizes"))))  # the same whatever order the rows come in
    bags = [(np.frombuffer(a, np.int32), np.frombuffer(b, np.int64)) for _, _, a, b in ordered]
    return fit(bags, np.array([int(y != 0) for _, y, _, _ in ordered], dtype=int), share)


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", locate: float = 0.5) -> DataFrame:
    """docs with ``toxic_score`` (0 to 1, never null), ``n_sentences`` and ``offending``, an array of (start, end, score).

    ``offending`` holds the sentences of at least ``locate``, in code points.
    Null, empty and wordless texts have no sentence and score 0. Very long
    texts are scored whole, a sentence at a time. Ties and repeated rows stay;
    columns of those names are replaced, others stay. An empty table gives an
    empty result.
    """
    w, bias = model
    shared = docs.sparkSession.sparkContext.broadcast(w)

    @F.pandas_udf("struct<toxic_score: double, n_sentences: int, offending: array<struct<start: int, end: int, score: double>>>")
    def scored(texts):
        rows = []
        for t in texts:
            ids, sizes, spans = bag(t)
            z = sentence_logits(shared.value, bias, ids, sizes)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            rows.append((noisy_or(z), len(sizes), [{"start": spans[k][0], "end": spans[k][1], "score": float(p[k])} for k in np.flatnonzero(p >= locate)]))
        return pd.DataFrame(rows, columns=["toxic_score", "n_sentences", "offending"])

    made = unused(docs, "_toxic")
    out = docs.withColumn(made, scored(F.col(text_col)))
    return out.withColumns({k: F.col(made)[k] for k in ("toxic_score", "n_sentences", "offending")}).drop(made)
