"""Benchmark decontamination by latent semantic retrieval.

Every document is cut into passages, whose TF-IDF rows span a space of hashed
words. A randomised SVD of all those rows (one pass gathers the sketch) gives
the leading right singular vectors. Benchmark items and windows of all
documents meet in that latent space; windows whose cosine with an item is high
enough are candidates. So are, after them, all other windows with enough of an
item's words for a match, so that no match is lost to the space's low rank. A candidate counts if the longest common subsequence of
words holds enough of the item and of its answer (its last words), which also
finds paraphrases that keep most words in order.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Hashed features; singular vectors kept and spare ones of the sketch; words of a passage and of a step.
FEATURES, RANK, SPARE, PASSAGE, STEP = 1 << 14, 48, 8, 64, 8
#: Least cosine of a candidate; least share of an item's words, and of its answer's, in the common subsequence; the answer's share of an item.
COSINE, LCS_SHARE, ANSWER_SHARE, ANSWER = 0.6, 0.6, 0.5, 0.25
#: Features in more than this share of the passages (and in so many of them) say nothing about a passage and have no weight.
STOP_SHARE, STOP_LEAST = 0.02, 30
#: Tokens that a task handles at a time; benchmark items of a job.
CHUNK, BLOCK = 1 << 15, 512


class _Codes(dict):
    """32-bit code of a word without punctuation at its ends, in four bytes, or none if nothing is left; the memory starts anew when it is full."""

    def __missing__(self, word: str) -> bytes:
        if len(self) > 400_000:
            self.clear()
        bare = word.strip("\"'.,;:!?()[]{}<>|*%&$#+=~^_/\\-«»„“”¿¡…")
        out = self[word] = struct.pack("<I", max(1, zlib.crc32(bare.encode("utf-8", "surrogatepass")))) if bare else b""
        return out


_CODES = _Codes()


def word_codes(text: str | None) -> bytes:
    """Codes of a text's words, lower-cased, four bytes each."""
    return b"".join(map(_CODES.__getitem__, (text or "").lower().split()))


def codes(text: str | None) -> np.ndarray:
    return np.frombuffer(word_codes(text), "<u4")


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a bit per word of a."""
    where: dict[int, int] = defaultdict(int)
    for k, x in enumerate(a):
        where[x] |= 1 << k
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        if m := where.get(x, 0) & row:
            row = (row + m | row - m) & full
    return len(a) - row.bit_count()


def matches(item: list[int], window: list[int]) -> tuple[float, bool]:
    """The share of the item in the common subsequence, and whether that and its answer's share suffice."""
    share = lcs(item, window) / len(item)
    answer = item[-max(3, int(len(item) * ANSWER)) :]
    return share, share >= LCS_SHARE and lcs(answer, window) >= ANSWER_SHARE * len(answer)


def _batches(it: Iterator[pa.RecordBatch], chunk: int = CHUNK) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Ids, tokens and token counts of documents, about ``chunk`` tokens at a time and at least one document."""
    ids, parts, size = [], [], 0
    for b in it:
        for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1)):
            part = np.frombuffer(raw.as_buffer(), np.uint32)
            if len(part):
                ids.append(doc_id)
                parts.append(part)
                size += len(part)
            if size >= chunk:
                yield ids, np.concatenate(parts), np.array([len(p) for p in parts])
                ids, parts, size = [], [], 0
    if ids:
        yield ids, np.concatenate(parts), np.array([len(p) for p in parts])


def _sections(it: Iterator[pa.RecordBatch], overlap: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """As _batches, with (id, first word) for ids: long documents come in sections that share ``overlap`` words, so that every window lies whole in one."""
    for ids, t, counts in _batches(it):
        if len(t) <= 2 * CHUNK:
            yield [(i, 0) for i in ids], t, counts
            continue
        step = max(STEP, (CHUNK - overlap) // STEP * STEP) if overlap < CHUNK // 2 else -(-overlap // STEP) * STEP
        for i, end, n in zip(ids, np.cumsum(counts), counts):
            for at in range(0, max(1, n - overlap), step):
                part = t[end - n + at : min(end, end - n + at + step + overlap)]
                yield [(i, at)], part, np.array([len(part)])


def _pieces(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pieces of ``size`` tokens that each document is cut into, and each document's number of pieces."""
    many = -(-counts // size)
    turn = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return np.repeat(np.cumsum(counts) - counts, many) + turn * size, many


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, words): the codes of each whole text's words, 32 bits each."""

    def made(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([word_codes(t.as_py()) for t in b.column(1)], pa.binary())], ["doc_id", "words"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(made, "doc_id long, words binary")


def idf(words: DataFrame) -> np.ndarray:
    """Inverse document frequency of each feature over the passages of all documents."""

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(FEATURES, np.int64), 0
        for _, t, counts in _batches(it):
            starts, _ = _pieces(counts, PASSAGE)
            ends = np.append(starts[1:], len(t))
            spot = starts[:, None] + np.arange(PASSAGE)
            rows = np.where(spot < ends[:, None], (t % FEATURES).astype(np.uint16)[np.minimum(spot, len(t) - 1)], np.uint16(FEATURES))
            rows.sort(axis=1)  # a feature counts once a passage
            once = rows < FEATURES
            once[:, 1:] &= rows[:, 1:] != rows[:, :-1]
            total += np.bincount(rows[once], minlength=FEATURES)
            n += len(starts)
        keys = np.append(np.flatnonzero(total), -1)
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(np.append(total[keys[:-1]], n))], ["feature", "n"])

    found = words.mapInArrow(counted, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    at, n = found["feature"].to_numpy(), found["n"].to_numpy()
    df = np.zeros(FEATURES)
    df[at[at >= 0]] = n[at >= 0]
    total = n[at == -1].sum()
    return np.where(df > max(STOP_SHARE * total, STOP_LEAST), 0, np.log((1 + total) / (1 + df))).astype(np.float32)


def singular_vectors(words: DataFrame, weights: np.ndarray, rank: int = RANK, seed: int = 3) -> np.ndarray:
    """(FEATURES, rank): whitened right singular vectors of the TF-IDF rows of all passages, times the features' weights.

    One pass sums A'(A S) for a random S over all rows, a partial sum for each task and feature, added up by
    the engine. The rest is a fixed-rank Nystrom step on a matrix of fixed size.
    """
    width = rank + SPARE
    sketch = (np.random.default_rng(seed).standard_normal((FEATURES, width)) / np.sqrt(FEATURES)).astype(np.float32)
    shared = words.sparkSession.sparkContext.broadcast((weights, sketch))

    def summed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, s = shared.value
        s = s * w[:, None]
        total = np.zeros((width, FEATURES))
        for _, t, counts in _batches(it, 2 * CHUNK):
            starts, _ = _pieces(counts, PASSAGE)
            sizes = np.diff(np.append(starts, len(t)))
            f = (t % FEATURES).astype(np.int64)
            heavy = w[f] > 0  # the others add nothing
            f, passage = f[heavy], np.repeat(np.arange(len(starts)), sizes)[heavy]
            if not len(f):
                continue
            first = np.flatnonzero(np.diff(passage, prepend=-1))
            y = np.add.reduceat(s[f], first, axis=0) / np.square(sizes[passage[first]])[:, None]  # rows of unit total frequency
            row, y = np.cumsum(np.diff(passage, prepend=passage[0]) != 0), np.ascontiguousarray(y.T)
            for j in range(width):
                total[j] += np.bincount(f, y[j][row], minlength=FEATURES)
        total *= w
        used = np.flatnonzero(total.any(axis=0))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *[pa.array(total[j, used].astype(np.float32)) for j in range(width)]], ["feature", *[f"c{j}" for j in range(width)]])

    schema = "feature int, " + ", ".join(f"c{j} float" for j in range(width))
    found = words.mapInArrow(summed, schema).groupBy("feature").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(width)]).toArrow()
    g = np.zeros((FEATURES, width))
    g[found["feature"].to_numpy()] = np.stack([found[f"c{j}"].to_numpy() for j in range(width)], axis=1) if found.num_rows else 0
    core = sketch.T.astype(float) @ g
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > 1e-9 * max(values.max(), 1e-300)
    if not good.any():
        return np.zeros((FEATURES, rank), np.float32)
    root = g @ (vectors[:, good] / np.sqrt(values[good]))  # root root' is about A'A
    u, sigma, _ = np.linalg.svd(root, full_matrices=False)
    keep = sigma[:rank] > 1e-6 * sigma[0]
    out = np.zeros((FEATURES, rank))
    out[:, : keep.sum()] = (u[:, :rank] / np.maximum(sigma[:rank], 1e-300))[:, keep]
    return (out * weights[:, None]).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-20)


class Items:
    """A block of benchmark items (name, codes), as a task's search needs them.

    A match needs LCS_SHARE of an item's words, so it needs that many less the
    item's common words (features without weight) of its rare ones. Where that
    is one at least, an item is looked up by its rare words, else by all of
    its words: where no stretch of a window's length has so many of them,
    there is no match.
    """

    def __init__(self, items: list[tuple[str, np.ndarray]], weights: np.ndarray, latent: np.ndarray):
        self.names = [k for k, _ in items]
        self.words = [c.tolist() for _, c in items]
        self.latent = latent
        self.steps = np.array([-(-len(c) // STEP) for _, c in items])
        self.least = np.array([math.ceil(LCS_SHARE * len(c) - 1e-9) for _, c in items])  # words in common that a match needs
        self.vectors = _unit(np.stack([latent[c % FEATURES].sum(axis=0) for _, c in items]))
        self.blind = ~self.vectors.any(axis=1)
        self.kinds = [np.unique(c, return_counts=True) for _, c in items]
        rare = [weights[c % FEATURES] > 0 for _, c in items]
        some = np.array([n - int((~r).sum()) for n, r in zip(self.least, rare)])
        self.need = np.where(some >= 1, some, self.least)
        asked = [np.unique(c[r] if n >= 1 else c) for (_, c), r, n in zip(items, rare, some)]
        codes_, owner = np.concatenate(asked), np.repeat(np.arange(len(items)), [len(x) for x in asked])
        order = np.argsort(codes_, kind="stable")
        self.codes, self.first = np.unique(codes_[order], return_index=True)
        self.first, self.owner = np.append(self.first, len(order)), owner[order]
        self.flag = np.zeros(FEATURES, bool)
        self.flag[self.codes % FEATURES] = True

    def stretches(self, t: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(document, item, first, end): where in t the stretches lie that have enough of the words that the item is looked up by, and a match may be."""
        at = np.flatnonzero(self.flag[t % FEATURES])
        place = np.searchsorted(self.codes, t[at])
        ok = self.codes[np.minimum(place, len(self.codes) - 1)] == t[at]
        at, place = at[ok], place[ok]
        many = self.first[place + 1] - self.first[place]
        item = self.owner[np.repeat(self.first[place] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        at = np.repeat(at, many)
        key = np.searchsorted(ends, at, "right") * len(self.names) + item
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        last = np.arange(len(key)) + self.need[key % len(self.names)] - 1
        i = np.flatnonzero(last < len(key))
        i = i[(key[last[i]] == key[i])]
        i = i[at[last[i]] - at[i] < (self.steps[key[i] % len(self.names)] + 2) * STEP]
        if not len(i):
            return np.zeros((0, 4), np.int64)
        span = (self.steps[key[i] % len(self.names)] + 3) * STEP
        apart = at[i[1:]] - at[last[i[:-1]]] > 2 * span[1:]  # stretches far from each other are searched one by one
        new = np.flatnonzero(np.concatenate([[True], (key[i[1:]] != key[i[:-1]]) | apart]))
        span = span[new]
        return np.stack([key[i[new]] // len(self.names), key[i[new]] % len(self.names), at[i[new]] - span, np.maximum.reduceat(at[last[i]], new) + span], axis=1)

    def search(self, t: np.ndarray, counts: np.ndarray) -> dict[tuple[int, int], tuple[float, float, int]]:
        """(document, item): (cosine, share, first word) of the best matching window; documents of counts[d] words each lie in t one after another.

        A window spans as many steps as its item, and a step more on either side is searched for the subsequence.
        """
        ends = np.cumsum(counts)
        best: dict[tuple[int, int], tuple[float, float, int]] = {}
        for d, k, first, end in self.stretches(t, ends).tolist():
            begin = int(ends[d] - counts[d])
            first = max(0, (first - begin) // STEP * STEP)  # windows start at the document's steps
            words = t[begin + first : min(end, int(ends[d]))]
            at, left, right, held = self._windows(words, k)
            if not len(at):
                continue
            f = words % FEATURES
            step = np.add.reduceat(self.latent[f], np.arange(0, len(f), STEP), axis=0)
            sums = np.concatenate([np.zeros((1, step.shape[1])), np.cumsum(step, axis=0, dtype=np.float64)])
            v = sums[np.minimum(at + self.steps[k], len(sums) - 1)] - sums[at]
            cosine = v @ self.vectors[k] / np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-20)
            near = self.blind[k] | (cosine >= COSINE)  # candidates of the latent space first, then all others
            for p in (*np.flatnonzero(near).tolist(), *np.flatnonzero(~near).tolist()):
                inside = slice(left[p], right[p])
                share, ok = matches(self.words[k], words[inside][held[inside]].tolist())  # a subsequence has no other words
                if ok:
                    found = (1.0 if self.blind[k] else float(cosine[p]), share, int(first + left[p]))
                    if (d, k) not in best or (found[1], found[0], -found[2]) > (best[d, k][1], best[d, k][0], -best[d, k][2]):
                        best[d, k] = found
        return best

    def _windows(self, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First step, first word and end of the windows with enough of an item's words, each counted as often as the item has it; and which words are the item's."""
        kinds, n = self.kinds[k]
        place = np.minimum(np.searchsorted(kinds, words), len(kinds) - 1)
        held = kinds[place] == words
        upto = np.concatenate([[0], np.cumsum(held)])
        at = np.arange(max(1, -(-len(words) // STEP) - int(self.steps[k]) + 1))  # windows that the end cuts are in the one before
        left, right = np.maximum(at - 1, 0) * STEP, np.minimum((at + self.steps[k] + 1) * STEP, len(words))
        enough = np.flatnonzero(upto[right] - upto[left] >= self.least[k])
        keep = [enough[:0]]
        for cut in range(0, len(enough), 1024):
            some = enough[cut : cut + 1024]
            spot = left[some][:, None] + np.arange(int((right[some] - left[some]).max()))
            ok = spot < right[some][:, None]
            spot = np.minimum(spot, len(words) - 1)
            ok &= held[spot]
            seen = np.bincount(np.nonzero(ok)[0] * len(kinds) + place[spot[ok]], minlength=len(some) * len(kinds)).reshape(len(some), -1)
            keep.append(some[np.minimum(seen, n).sum(axis=1) >= self.least[k]])
        keep = np.concatenate(keep)
        return at[keep], left[keep], right[keep], held


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """A row per document and benchmark item found in it: (doc_id, item_id, cosine, lcs_share, at_word), the best window's.

    The benchmark is a stated query set: it is searched for in blocks of
    about ``block`` items, a job each, so that what a task holds is bounded.
    Null, empty and wordless texts and items match nothing; items of fewer
    than three words are left out. Very long texts are searched whole. Null
    ids are returned as they are; repeated rows count as one document, and
    repeated items as one. Item ids may be of any type that a string can be
    cast to. Of equally good windows the first is taken. An empty table on
    either side gives an empty result. Other columns are ignored, whatever
    their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontam")
    words = scratch.write(tokens(docs, id_col, text_col), "words")
    kind = benchmark.schema[item_col].dataType
    asked = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("item IS NOT NULL")
    blocks = max(1, math.ceil(asked.count() / block))
    asked = scratch.write(asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")), "items", ["block"])
    weights = idf(words)
    latent = singular_vectors(words, weights)
    parts = [_found(words, asked.where(F.col("block") == b), weights, latent) for b in range(blocks)]
    hits = reduce(DataFrame.unionByName, parts)
    best = F.max_by(F.struct("cosine", "lcs_share", "at_word"), F.struct("lcs_share", "cosine", -F.col("at_word")))
    return hits.groupBy("doc_id", "item").agg(best.alias("b")).select("doc_id", F.col("item").cast(kind).alias("item_id"), "b.cosine", "b.lcs_share", "b.at_word")


def _found(words: DataFrame, asked: DataFrame, weights: np.ndarray, latent: np.ndarray) -> DataFrame:
    """(doc_id, item, cosine, lcs_share, at_word) of one block of items."""
    schema = "doc_id long, item string, cosine double, lcs_share double, at_word long"
    rows = asked.select("item", "text").orderBy("item", "text").collect()  # a block of items
    items = [(r.item, c) for r in rows if len(c := codes(r.text)) >= 3]
    if not items:
        return words.sparkSession.createDataFrame([], schema)
    shared = words.sparkSession.sparkContext.broadcast((items, weights, latent))

    def found(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Items(*shared.value)
        for owner, t, counts in _sections(it, (int(search.steps.max()) + 2) * STEP):
            rows = [(*owner[d][:1], search.names[k], cosine, share, at + owner[d][1]) for (d, k), (cosine, share, at) in sorted(search.search(t, counts).items())]
            if rows:
                kinds = (pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], ["doc_id", "item", "cosine", "lcs_share", "at_word"])

    return words.mapInArrow(found, schema)
