"""SimHash near-dedup with a binary trie self-join.

Distinct fingerprints form a binary trie. Pairs of nodes are traversed
together from the root: each step adds the bits in which they differ, and a
pair is pruned when it exceeds its error budget.

Each view of a fingerprint turns some of its bits to the front as a head with
a small budget of its own, and of that head a piece first that may not differ
at all: two heads with at most two differing bits agree in one of three
pieces. Nodes below the piece are dealt to tasks without copies, and the
visits of a trie stay near-linear in the input. Only where such nodes would
have too many leaves are deeper ones dealt out, under the head's budget.

Inside a task, node pairs whose leaves are already in one component are
pruned too, so that dense groups of near copies don't expand into all pairs;
a task returns a spanning forest of the links that it found.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

SEED = 42
#: Words of a wide fingerprint; bits of all its words in which linked ones may differ; its heads that are searched.
WIDE_WORDS, WIDE_BITS, WIDE_HEADS = 8, 86, 12
#: Node pairs that a task holds in one step; leaves that a dealt node should have, and may have before nodes below the exact piece are
#: dealt out with copies; counts of trie levels that a task keeps.
FRONTIER, NODE_LEAVES, MOST_LEAVES, KEPT_COUNTS = 1 << 17, 1 << 14, 1 << 20, 1 << 26
#: Shingles and bytes that a task hashes at a time.
SHINGLES, PART_BYTES = 1 << 15, 1 << 22
_BYTE_ONES = np.uint64(0x0101010101010101)
_SPACE = re.compile(rb"[ \t-\r]")


# --- fingerprints ------------------------------------------------------------------------------------------------------


def _parts(raw: bytes) -> Iterator[bytes]:
    """A text in parts that end where a word ends."""
    at = 0
    while len(raw) - at > PART_BYTES:
        end = _SPACE.search(raw, at + PART_BYTES)
        if end is None:
            break
        yield raw[at : end.start()]
        at = end.start()
    yield raw[at:] if at else raw


def shingle_hashes(text: str | None, words_per_shingle: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of a text in order, repeats included; of the whole sequence where it has fewer words, none without words."""
    digest, carried, made = xxhash.xxh64_intdigest, [], []
    for part in _parts((text or "").encode("utf-8").lower()):
        words = carried + part.split()
        if len(words) >= words_per_shingle:
            joined = b" ".join(words)
            ends = list(accumulate((len(w) + 1 for w in words), initial=-1))  # of word i: ends[i + 1]
            made.append(np.fromiter((digest(joined[a + 1 : b], seed) for a, b in zip(ends, ends[words_per_shingle:])), np.uint64, len(words) - words_per_shingle + 1))
            carried = words[len(words) - words_per_shingle + 1 :]
        else:
            carried = words
    if not made:
        return np.array([digest(b" ".join(carried), seed)] if carried else [], np.uint64)
    return np.concatenate(made)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of each hash; the hash itself for 0."""
    if not k:
        return h
    z = h + np.uint64(0x9E3779B97F4A7C15 * k % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _majorities(h: np.ndarray, counts: np.ndarray, words: int) -> np.ndarray:
    """(documents, words): the majority of each bit over each document's hashes; every document has at least one.

    Eight bits lie in the eight bytes of a number and are counted together, at most 255 hashes at a time.
    """
    many = -(-counts // 255)
    first = np.cumsum(many) - many
    begin = np.repeat(np.cumsum(counts) - counts, many) + 255 * (np.arange(many.sum()) - np.repeat(first, many))
    out = np.empty((len(counts), words), np.uint64)
    for k in range(words):
        x, sums = _mixed(h, k), np.empty((len(begin), 8, 8), np.uint8)
        for b in range(8):
            sums[:, :, b] = np.add.reduceat((x >> np.uint64(b)) & _BYTE_ONES, begin).astype("<u8").view(np.uint8).reshape(-1, 8)
        total = np.add.reduceat(sums.reshape(-1, 64), first, axis=0, dtype=np.int64)
        out[:, k] = np.packbits(2 * total > counts[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def prints(texts: list[str | None], words_per_shingle: int = 4, words: int = 1) -> np.ndarray:
    """(texts, words): fingerprints of 64 bits a word: a bit is set where over half of the shingles' hashes have it. No word: 0."""
    out = np.zeros((len(texts), words), np.uint64)
    rows, hashes, held = [], [], 0

    def flush() -> None:
        nonlocal rows, hashes, held
        if rows:
            out[rows] = _majorities(np.concatenate(hashes), np.array([len(h) for h in hashes]), words)
        rows, hashes, held = [], [], 0

    for k, text in enumerate(texts):
        h = shingle_hashes(text, words_per_shingle)
        if len(h):
            rows.append(k)
            hashes.append(h)
            held += len(h)
        if held >= SHINGLES:
            flush()
    flush()
    return out


def names(words: int) -> list[str]:
    return [f"w{k}" for k in range(words)]


def fingerprints(docs: DataFrame, words_per_shingle: int = 4, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, w0, ...): a row per input row, a fingerprint as signed longs. Null and empty texts have 0."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = prints(b.column(1).to_pylist(), words_per_shingle, words).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(np.ascontiguousarray(made[:, k])) for k in range(words)]], ["doc_id", *names(words)])

    schema = ", ".join(f"{n} long" for n in ["doc_id", *names(words)])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(hashed, schema)


# --- the trie ----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class View:
    """A word of the fingerprint turned left by ``turn``; of its first ``head`` bits those from ``offset`` on come first, ``piece`` of them exact."""

    word: int
    turn: int
    head: int
    offset: int
    piece: int

    def seen(self, x: np.ndarray) -> np.ndarray:
        turn, head, low = np.uint64(self.turn), np.uint64(self.head), np.uint64(64 - self.head)
        x = (x << turn) | (x >> (np.uint64(64) - turn)) if self.turn else x
        top, rest = x >> low, x & np.uint64((1 << (64 - self.head)) - 1)
        if self.offset:
            top = ((top << np.uint64(self.offset)) | (top >> (head - np.uint64(self.offset)))) & np.uint64((1 << self.head) - 1)
        return (top << low) | rest

    def prefix(self, depth: int) -> Column:
        """The first ``depth`` bits (at most the head's) of the word as seen."""
        x = F.col(f"w{self.word}")
        x = F.shiftleft(x, self.turn).bitwiseOR(F.shiftrightunsigned(x, 64 - self.turn)) if self.turn else x
        top = F.shiftrightunsigned(x, 64 - self.head)
        if self.offset:
            top = F.shiftleft(top, self.offset).bitwiseOR(F.shiftrightunsigned(top, self.head - self.offset)).bitwiseAND(F.lit((1 << self.head) - 1))
        return F.shiftrightunsigned(top, self.head - depth).cast("int")


def _cut(head: int, errors: int) -> list[tuple[int, int]]:
    """(offset, length) of the pieces of a head, one more than its errors, so that one of them holds none."""
    at = [round(head * k / (errors + 1)) for k in range(errors + 2)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


@dataclass(frozen=True)
class Plan:
    """A search: views whose heads may differ in ``errors`` bits, of fingerprints that may differ in ``most`` bits in all."""

    words: int
    views: tuple[View, ...]
    errors: int
    most: int

    def budgets(self, view: View) -> list[tuple[np.ndarray, int]]:
        """Error budgets by depth and the bits of a link, from close pairs to all; what close pairs connect is pruned afterwards."""
        out = []
        for errors, most in ((0, self.most // 2), (self.errors, self.most)):
            budget = np.full(64 * self.words + 1, most)
            budget[: view.head + 1] = min(errors, most)
            budget[: view.piece + 1] = 0
            out.append((budget, most))
        return out


def narrow(max_bits: int = 4) -> Plan:
    """All pairs within max_bits (up to 5) of 64: one of the halves has at most two differing bits."""
    if not 0 <= max_bits <= 5:
        raise ValueError("two halves of a word with at most two differing bits each hold up to five")
    return Plan(1, tuple(View(0, turn, 32, o, n) for turn in (0, 32) for o, n in _cut(32, 2)), 2, max_bits)


def wide(words: int = WIDE_WORDS, max_bits: int = WIDE_BITS, heads: int = WIDE_HEADS, head: int = 24, errors: int = 2) -> Plan:
    """Pairs within max_bits of all words whose distance in one of the heads (two in a word, of up to 32 bits) is at most ``errors``.

    Unrelated fingerprints meet in a head of 24 bits with two errors once in 56,000 pairs, which is little work up to some
    hundred million documents. Beyond, heads of 32 bits with three errors meet once in 780,000 and find as many near copies
    (27 instead of 28 % a head at a similarity of 0.8), for about four times the visits.
    """
    return Plan(words, tuple(View(k % words, 32 * (k // words), head, o, n) for k in range(heads) for o, n in _cut(head, errors)), errors, max_bits)


class _Leaves:
    """Sorted fingerprints of a task, by column; counts of set bits before each place, a level of the trie at a time."""

    def __init__(self, columns: list[np.ndarray]):
        self.columns = columns
        self.ones: dict[int, np.ndarray] = {}

    def mid(self, depth: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if depth not in self.ones:
            if len(self.ones) >= max(8, KEPT_COUNTS // max(1, len(self.columns[0]))):
                self.ones.pop(next(iter(self.ones)))
            bit = (self.columns[depth >> 6] >> np.uint64(63 - (depth & 63))) & np.uint64(1)
            self.ones[depth] = np.concatenate([[0], np.cumsum(bit.astype(np.int32))]).astype(np.int32)
        c = self.ones[depth]
        return hi - (c[hi] - c[lo])

    def near(self, i: np.ndarray, j: np.ndarray, head: int, errors: int, most: int) -> np.ndarray:
        d = self.columns[0][i] ^ self.columns[0][j]
        total = np.bitwise_count(d).astype(np.int64)
        ok = (np.bitwise_count(d >> np.uint64(64 - head)) <= errors) & (total <= most)
        if len(self.columns) > 1 and ok.any():
            k = np.flatnonzero(ok)
            for c in self.columns[1:]:
                total[k] += np.bitwise_count(c[i[k]] ^ c[j[k]])
            ok = ok & (total <= most)
        return ok


def _united(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unites the components of i[k] and j[k]; parent points at roots before and after."""
    while len(i):
        a, b = parent[i], parent[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def trie_links(columns: list[np.ndarray], a: tuple[int, int], b: tuple[int, int], depth: int, err: int, plan: Plan, view: View) -> np.ndarray:
    """Joins the subtrees over places a and b (equal or apart) of sorted, distinct fingerprints; returns each leaf's component as a place.

    columns: the words, the view's as seen by it first. ``depth`` bits of each subtree are common and ``err`` of those differ between the two.
    """
    n, bits = len(columns[0]), 64 * len(columns)
    leaves, parent = _Leaves(columns), np.arange(n)
    for budget, most in plan.budgets(view):
        errors, stale = int(budget[view.head]), True
        stack = [(depth, *(np.array([v], np.int32) for v in (*a, *b, err)))]
        while stack:
            t, alo, ahi, blo, bhi, e = stack.pop()
            if stale:
                change, stale = np.concatenate([[0], np.cumsum(parent[1:] != parent[:-1])]) if n else np.zeros(0), False
            alive = np.flatnonzero((alo < ahi) & (blo < bhi) & (e <= budget[t]))
            x, y, u, v = alo[alive], ahi[alive] - 1, blo[alive], bhi[alive] - 1
            alive = alive[(change[x] != change[y]) | (change[u] != change[v]) | (parent[x] != parent[u])]  # the others are in one component
            alo, ahi, blo, bhi, e = (x[alive] for x in (alo, ahi, blo, bhi, e))
            single = ((ahi - alo) * (bhi - blo) == 1) | (t == bits)
            if single.any():
                i, j = alo[single], blo[single]
                near = leaves.near(i, j, view.head, errors, most)
                if near.any():
                    _united(parent, i[near], j[near])
                    stale = True
                alo, ahi, blo, bhi, e = (x[~single] for x in (alo, ahi, blo, bhi, e))
            if not len(alo):
                continue
            if len(alo) > FRONTIER:  # depth first, a slice at a time
                for at in range(0, len(alo), FRONTIER):
                    stack.append((t, *(x[at : at + FRONTIER] for x in (alo, ahi, blo, bhi, e))))
                continue
            amid, bmid = leaves.mid(t, alo, ahi), leaves.mid(t, blo, bhi)
            parts = [(alo, amid, blo, bmid, e), (amid, ahi, bmid, bhi, e)]
            cross = np.flatnonzero(e < budget[t + 1])
            if len(cross):
                alo, ahi, blo, bhi, e, amid, bmid = (x[cross] for x in (alo, ahi, blo, bhi, e, amid, bmid))
                mixed = alo != blo  # a node paired with itself has its mixed pair once
                parts += [(alo, amid, bmid, bhi, e + 1), (amid[mixed], ahi[mixed], blo[mixed], bmid[mixed], e[mixed] + 1)]
            stack.append((t + 1, *(np.concatenate(x) for x in zip(*parts))))
    return parent


def _masks(free: int, most: int) -> list[int]:
    """Numbers of ``free`` bits with at most ``most`` set."""
    return [sum(1 << k for k in bits) for n in range(min(free, most) + 1) for bits in combinations(range(free), n)]


def links(reps: DataFrame, plan: Plan, node_leaves: int = NODE_LEAVES) -> DataFrame:
    """(u, v) over ``node`` of distinct fingerprints (node, w0, ...): enough links to connect all that the plan finds, at most one per leaf and task."""
    columns = names(plan.words)
    n = reps.count()
    levels = lambda leaves: math.ceil(math.log2(max(1, n / leaves)))
    exact = min(view.piece for view in plan.views)
    depth = max(1, min(levels(node_leaves), max(exact, levels(node_leaves * (MOST_LEAVES // NODE_LEAVES)))))
    seen = []
    for k, view in enumerate(plan.views):
        d = min(depth, view.head)
        flips = F.array(*[F.lit(m) for m in _masks(max(0, d - view.piece), plan.errors)])
        seen.append(F.struct(F.lit(k).alias("view"), view.prefix(d).alias("p"), flips.alias("flips")))
    nodes = reps.select("node", *columns, F.explode(F.array(*seen)).alias("s")).select("node", *columns, "s.view", "s.p", F.explode("s.flips").alias("m"))
    q = F.col("p").bitwiseXOR(F.col("m"))
    dealt = nodes.select("view", F.least("p", q).alias("a"), F.greatest("p", q).alias("b"), "node", *columns)

    def joined(key: tuple, rows: pa.Table) -> pa.Table:
        k, a, b = (v.as_py() for v in key)
        view = plan.views[k]
        d = min(depth, view.head)
        words = [rows.column(c).to_numpy().view(np.uint64) for c in columns]
        ordered = [view.seen(words[view.word]), *(w for j, w in enumerate(words) if j != view.word)]
        order = np.lexsort(ordered[::-1]) if len(ordered) > 1 else np.argsort(ordered[0])
        ordered, node = [w[order] for w in ordered], rows.column("node").to_numpy()[order]
        cut = int(np.searchsorted(ordered[0], np.uint64(b << (64 - d)))) if b else 0
        ranges = ((0, len(node)),) * 2 if a == b else ((0, cut), (cut, len(node)))
        root = trie_links(ordered, *ranges, d, (a ^ b).bit_count(), plan, view)
        moved = np.flatnonzero(root != np.arange(len(node)))
        return pa.table({"u": node[moved], "v": node[root[moved]]})

    return dealt.groupBy("view", "a", "b").applyInArrow(joined, "u long, v long")


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, root): connected components by alternating large-star and small-star rounds, each written to the shared folder.

    A node's neighbours are never gathered: each round takes minima and joins them back.
    """
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    edges = scratch.write(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = state(edges)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        after = scratch.write(small, "edges")
        now = state(after)
        scratch.drop(edges)
        edges = after
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _classes(docs: DataFrame, plan: Plan, words_per_shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, w0, ..., component_id): a row per row of docs."""
    scratch, columns = Scratch(docs.sparkSession, "simhash"), names(plan.words)
    marked = scratch.write(fingerprints(docs, words_per_shingle, plan.words, id_col, text_col), "fingerprints")
    reps = marked.groupBy(*columns).agg(F.min("doc_id").alias("rep")).withColumn("node", F.monotonically_increasing_id())
    reps = scratch.write(reps, "reps")  # a node's number holds from here on
    roots = components(links(reps.drop("rep"), plan), scratch)
    named = scratch.write(reps.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "roots")
    classes = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    return marked.join(named.join(classes, "root").select(*columns, "component_id"), columns).select("doc_id", *columns, "component_id")


def near_duplicates(docs: DataFrame, max_bits: int = 4, words_per_shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: (doc_id, fp, component_id), the smallest doc_id that links of at most max_bits (up to 5) of 64 reach.

    Null, empty and blank texts have fingerprint 0 and link like any other.
    Very long texts are hashed in parts and give the fingerprint of the whole.
    Exact copies share a fingerprint and are joined once, whatever their
    number. Null ids take part and are never the smallest unless a component
    has no other (then component_id is null). Repeated rows are returned
    again. An empty table gives an empty result. Other columns are ignored,
    whatever their names.
    """
    return _classes(docs, narrow(max_bits), words_per_shingle, id_col, text_col).select("doc_id", F.col("w0").alias("fp"), "component_id")


def similar_documents(docs: DataFrame, plan: Plan | None = None, words_per_shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id), as near_duplicates, for texts whose shingles have a similarity of about 0.8 or more.

    A single 64-bit fingerprint can't tell such pairs: about 15 % of its bits differ, give or take 4.5 %. Here a
    fingerprint has eight words; two are linked if they differ in at most 86 of the 512 bits (16.8 %) and in at most two
    bits of one of twelve heads, which the tries find. README has the recall by similarity. The cases of
    near_duplicates hold here too.
    """
    return _classes(docs, plan or wide(), words_per_shingle, id_col, text_col).select("doc_id", "component_id")
