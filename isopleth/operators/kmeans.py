"""k-means of many problems at once over blocks of points: seeding and Lloyd's steps are sums over blocks, so no task holds a data set."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Payloads that are summed in one group.
FAN = 16


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x and y."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1), 0)


def race(ids: np.ndarray, weight: np.ndarray, *key: int) -> np.ndarray:
    """Keys whose largest belongs to a point drawn by weight: the first arrivals of a race, from hashes of the key and the points' identifiers."""
    h = ids.astype(np.uint64)
    for k in key:
        h = (h ^ np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    unit = ((h >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
    with np.errstate(divide="ignore"):
        return np.where(weight > 0, np.log(unit) / np.where(weight > 0, weight, 1), -np.inf)


def best_centres(x: np.ndarray, k: int, starts: int = 10, seed: int = 0, rounds: int = 100, ids: np.ndarray | None = None) -> np.ndarray:
    """The centres with the least inertia of several k-means++ starts, for points that fit into one place."""
    ids = np.arange(len(x)) if ids is None else ids
    best, least = None, np.inf
    for start in range(starts):
        centres = x[[race(ids, np.ones(len(x)), seed, start, 0).argmax()]]
        while len(centres) < k:
            keys = race(ids, distances(x, centres).min(1), seed, start, len(centres))
            centres = np.vstack([centres, x[keys.argmax()]])
        for _ in range(rounds):
            hot = np.eye(k)[distances(x, centres).argmin(1)]
            n = hot.sum(0)
            new = np.where(n[:, None] > 0, hot.T @ x / np.maximum(n, 1)[:, None], centres)
            if np.allclose(new, centres):
                break
            centres = new
        inertia = distances(x, centres).min(1).sum()
        if not start or inertia < least * (1 - 1e-9):
            best, least = centres, inertia
    return best


def lloyd(x: np.ndarray, k: int, starts: int = 10, seed: int = 0, rounds: int = 100, ids: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """(labels, inertia) of best_centres(); ``fitted`` gives the same over blocks."""
    d = distances(x, best_centres(x, k, starts, seed, rounds, ids))
    return d.argmin(1), d.min(1).sum()


def as_list(values: np.ndarray, kind: pa.DataType = pa.float64()) -> pa.Array:
    """An Arrow array of one list."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(np.ascontiguousarray(values), kind))


#: Columns of rows of payloads.
PAYLOAD = ["set", "part", "block", "payload"]
SCHEMA = "set long, part long, block long, payload array<double>"


def joined(rows: DataFrame, join: Callable, finish: Callable | None = None) -> DataFrame:
    """(set, part, block, payload): the payloads of rows (set, part, block, payload) joined pair by pair, ``FAN`` blocks a group, then those; finish(set, payload) is put in the last one's place."""

    def of(last: bool):
        def summed(table: pa.Table) -> pa.Table:
            parts = [p.values.to_numpy() for p in table.column("payload").combine_chunks()]
            total = parts[0]
            for p in parts[1:]:
                total = join(total, p)
            if last and finish:
                total = finish(table.column("set")[0].as_py(), total)
            return pa.table([table.column(c).slice(0, 1) for c in ("set", "part", "block")] + [as_list(total)], PAYLOAD)

        return summed

    rows = rows.withColumn("block", F.expr(f"block div {FAN}")).groupBy("set", "part", "block").applyInArrow(of(False), SCHEMA)
    return rows.groupBy("set", "part").applyInArrow(of(True), SCHEMA)


def gathered(rows: DataFrame) -> dict[int, np.ndarray]:
    """The payload of each set, where sets and payloads are few and small: centres, sums of columns."""
    return {r["set"]: np.array(r["payload"]) for r in rows.select("set", "payload").toArrow().to_pylist()}


@dataclass
class Blocks:
    """Points in blocks: rows (set, block, ids array<long>, x array<double>), x by rows of ``width`` values; sets are few, blocks are many.

    scale holds the mean and the factor of each column by set.
    """

    rows: DataFrame
    width: int
    scale: dict[int, tuple[np.ndarray, np.ndarray]]

    def scaler(self) -> Callable:
        """(set, values) to points; without the rows, so that tasks can have it."""
        scale, width = self.scale, self.width

        def points(name: int, x: np.ndarray) -> np.ndarray:
            mean, factor = scale[name]
            return (x.reshape(-1, width) - mean) * factor

        return points

    def each(self, made: Callable) -> DataFrame:
        """(set, part, block, payload): made(set, ids, points) of each block; blocks for which it is None give no row."""
        points = self.scaler()

        def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, block, ids, x in zip(batch.column("set").to_pylist(), batch.column("block").to_pylist(), batch.column("ids"), batch.column("x"), strict=True):
                    out = made(name, ids.values.to_numpy(), points(name, x.values.to_numpy()))
                    if out is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([0]), pa.array([block]), as_list(out)], PAYLOAD)

        return self.rows.select("set", "block", "ids", "x").mapInArrow(mapper, SCHEMA)

    def folded(self, made: Callable, join: Callable) -> dict[int, np.ndarray]:
        """made() of all blocks, joined by set."""
        return gathered(joined(self.each(made), join))


#: Points of a set that one task fits on its own.
LOCAL = 1 << 16


def fitted_apart(blocks: Blocks, seeds: dict[int, int], ks: list[int], starts: int = 10, rounds: int = 100) -> dict[int, dict[int, np.ndarray]]:
    """fitted(), a set a task: for sets of at most ``LOCAL`` points."""
    points, width = blocks.scaler(), blocks.width

    def one(table: pa.Table) -> pa.Table:
        name = table.column("set")[0].as_py()
        ids, x = table.column("ids").combine_chunks().flatten().to_numpy(), points(name, table.column("x").combine_chunks().flatten().to_numpy())
        order = np.argsort(ids)
        found = [best_centres(x[order], k, starts, seeds[name], rounds, ids[order]).ravel() for k in ks]
        return pa.table([table.column("set").slice(0, 1), as_list(np.concatenate(found))], ["set", "payload"])

    rows = blocks.rows.select("set", "ids", "x").repartition(max(8, min(len(seeds), 1024)), "set")
    best = {}
    for name, got in gathered(rows.groupBy("set").applyInArrow(one, "set long, payload array<double>")).items():
        cuts = np.cumsum([k * width for k in ks])[:-1]
        best[name] = {k: c.reshape(k, width) for k, c in zip(ks, np.split(got, cuts), strict=True)}
    return best


def fitted(blocks: Blocks, seeds: dict[int, int], ks: list[int], starts: int = 10, rounds: int = 100) -> dict[int, dict[int, np.ndarray]]:
    """The best centres by set and k. Seeding draws each next centre by squared distance, one job a centre for all sets, k and starts; a job is one Lloyd step of all that still move.

    What is broadcast and what comes back are centres: sets by k by starts by width.
    """
    context, width = blocks.rows.sparkSession.sparkContext, blocks.width
    centres: dict[tuple[int, int], np.ndarray] = {}  # of (set, start): the seeds don't hang on k, which takes the first k of them
    for step in range(max(ks)):
        held = context.broadcast((dict(centres), seeds))

        def drawn(name, ids, x, held=held, step=step):
            found, seed = held.value
            out = []
            for start in range(starts):
                weight = np.ones(len(x)) if not step else distances(x, found[name, start]).min(1)
                keys = race(ids, weight, seed[name], start, step)
                at = keys.argmax()
                out.append(np.r_[keys[at], x[at]])
            return np.concatenate(out)

        def better(a, b):
            a, b = a.reshape(starts, -1), b.reshape(starts, -1)
            return np.where(a[:, :1] >= b[:, :1], a, b).ravel()

        for name, got in blocks.folded(drawn, better).items():
            for start, row in enumerate(got.reshape(starts, -1)):
                centres[name, start] = row[None, 1:] if not step else np.vstack([centres[name, start], row[1:]])
        held.unpersist()
    now = {(name, k, start): c[:k] for (name, start), c in centres.items() for k in ks}
    moving, names = dict(now), sorted(seeds)
    for _ in range(rounds):
        if not moving:
            break
        held = context.broadcast(moving)

        def moved(name, ids, x, held=held):
            found = held.value
            out = []
            for k in ks:
                for start in range(starts):
                    c = found.get((name, k, start))
                    if c is not None:
                        hot = np.eye(k)[distances(x, c).argmin(1)]
                        out += [hot.sum(0), (hot.T @ x).ravel()]
            return np.concatenate(out) if out else None

        sums = blocks.folded(moved, np.add)
        held.unpersist()
        still = {}
        for name in names:
            at = 0
            for k in ks:
                for start in range(starts):
                    c = moving.get((name, k, start))
                    if c is not None:
                        n = sums[name][at : at + k, None]
                        total = sums[name][at + k : at + k + k * width].reshape(k, width)
                        at += k + k * width
                        new = np.where(n > 0, total / np.maximum(n, 1), c)
                        if not np.allclose(new, c):
                            now[name, k, start] = still[name, k, start] = new
        moving = still
    held = context.broadcast(now)

    def spent(name, ids, x, held=held):
        return np.array([distances(x, held.value[name, k, start]).min(1).sum() for k in ks for start in range(starts)])

    best = {}
    for name, got in blocks.folded(spent, np.add).items():
        best[name] = {}
        for k, row in zip(ks, got.reshape(len(ks), starts), strict=True):
            start = 0
            for s in range(1, starts):
                if row[s] < row[start] * (1 - 1e-9):
                    start = s
            best[name][k] = now[name, k, start]
    held.unpersist()
    return best
