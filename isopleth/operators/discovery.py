"""Homogeneous zones and their seasons: features, k-means, stability, season detection, matching across folds."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isopleth.functions.calendar import month_initials, month_length
from isopleth.sources.io import written

from .cube import area_mean
from .kmeans import LOCAL, PAYLOAD, SCHEMA, Blocks, as_list, distances, fitted, fitted_apart, gathered, joined, lloyd  # noqa: F401  lloyd is the plain form


# --- seasons -----------------------------------------------------------------------------------------------------------


def cycle(clim: DataFrame, by: list[str]) -> DataFrame:
    """(by, c): the annual cycle (month, clim) as an array of twelve; cycles with a missing month are left out."""
    out = clim.where(F.col("clim").isNotNull()).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("month", "clim"))), lambda s: s["clim"]).alias("c"))
    return out.where(F.size("c") == 12)


def _at(c: Column, m: Column) -> Column:
    """Value of a month, counted on round the year."""
    return F.get(c, F.pmod(m, F.lit(12)))


def peaks(c: Column, floor: float = 0.15) -> Column:
    """Months (0 to 11) that are not below their neighbours round the year and over a share of the largest value.

    Of peaks in neighbouring months the higher stays, of equals the earlier; going through the year merges those, then its turn.
    """
    raw = F.filter(F.sequence(F.lit(0), F.lit(11)), lambda m: (_at(c, m) >= _at(c, m - 1)) & (_at(c, m) >= _at(c, m + 1)) & (_at(c, m) > floor * F.array_max(c)))
    next_to = lambda a, b: F.pmod(b - a, F.lit(12)) == 1
    higher = lambda a, b: F.when(_at(c, a) >= _at(c, b), a).otherwise(b)

    def step(kept: Column, m: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        merged = F.concat(F.slice(kept, 1, F.greatest(F.lit(0), F.size(kept) - 1)), F.array(higher(last, m)))
        return F.when(F.coalesce(next_to(last, m), F.lit(False)), merged).otherwise(F.concat(kept, F.array(m)))

    kept = F.aggregate(raw, F.array().cast("array<int>"), step)
    first, last = F.get(kept, F.lit(0)), F.get(kept, F.size(kept) - 1)
    turned = F.concat(F.slice(kept, 2, F.greatest(F.lit(0), F.size(kept) - 2)), F.array(higher(last, first)))
    return F.array_sort(F.when((F.size(kept) > 1) & next_to(last, first), turned).otherwise(kept))


def spaced_peaks(c: Column, share: float = 0.55, apart: int = 3) -> Column:
    """Months of local maxima of at least a share of the largest value, taken by height, at least ``apart`` months from those taken."""
    order = F.transform(F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), F.lit(11)), lambda m: (_at(c, m) >= _at(c, m - 1)) & (_at(c, m) >= _at(c, m + 1)) & (_at(c, m) >= share * F.array_max(c))), lambda m: F.struct((-_at(c, m)).alias("v"), m.alias("m")))), lambda s: s["m"])
    gap = lambda a, b: F.least(F.pmod(a - b, F.lit(12)), F.pmod(b - a, F.lit(12)))
    return F.array_sort(F.aggregate(order, F.array().cast("array<int>"), lambda acc, m: F.when(F.exists(acc, lambda k: gap(k, m) < apart), acc).otherwise(F.concat(acc, F.array(m)))))


def window_sum(c: Column, start: Column, length: int) -> Column:
    total = F.lit(0.0)
    for k in range(length):
        total = total + _at(c, start + k)
    return total


def best_window(c: Column, starts: Column, length: int) -> Column:
    """The start (0 to 11) with the largest sum of ``length`` months round the year, the first of the given ones of equals."""
    scored = F.transform(starts, lambda s, i: F.struct((-window_sum(c, s, length)).alias("v"), i.alias("i"), s.alias("s")))
    return F.array_min(scored)["s"]


def window_months(start: Column, length: int) -> Column:
    """The calendar months (1 to 12) of a window that starts at a month counted from 0."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda k: F.pmod(start + k, F.lit(12)) + 1)


def seasons(cycles: DataFrame, by: list[str], most: int = 2) -> DataFrame:
    """(by, start, months, label, total): for each peak the wettest three months that hold it, equal windows once, the ``most`` wettest.

    Of equally wet windows that of the earlier peak comes first.
    """
    found = cycles.select(*by, "c", F.explode(peaks(F.col("c"))).alias("peak"))
    starts = F.transform(F.sequence(F.lit(-2), F.lit(0)), lambda k: F.pmod(F.col("peak") + k, F.lit(12)))
    placed = found.withColumn("start", best_window(F.col("c"), starts, 3)).groupBy(*by, "start").agg(F.min("peak").alias("peak"), F.first("c").alias("c"))
    scored = placed.withColumn("total", window_sum(F.col("c"), F.col("start"), 3))
    ranked = scored.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("total"), "peak"))).where(F.col("k") <= most)
    months = window_months(F.col("start"), 3)
    return ranked.select(*by, "start", months.alias("months"), month_initials(months).alias("label"), "total")


def target_windows(cycles: DataFrame, by: list[str], share: float = 0.55, apart: int = 3) -> DataFrame:
    """(by, peak, start, months, label, total): the wettest three months that hold each of the spaced peaks."""
    found = cycles.select(*by, "c", F.explode(spaced_peaks(F.col("c"), share, apart)).alias("peak"))
    starts = F.transform(F.sequence(F.lit(-2), F.lit(0)), lambda k: F.pmod(F.col("peak") + k, F.lit(12)))
    placed = found.withColumn("start", best_window(F.col("c"), starts, 3))
    months = window_months(F.col("start"), 3)
    return placed.select(*by, "peak", "start", months.alias("months"), month_initials(months).alias("label"), window_sum(F.col("c"), F.col("start"), 3).alias("total"))


def rain_window(cycles: DataFrame, by: list[str], share: float = 0.7) -> DataFrame:
    """(by, start, length, captured): the shortest window of three to six months that holds a share of the year's total, else the best of six."""
    total = F.aggregate("c", F.lit(0.0), lambda a, v: a + v)
    every = F.sequence(F.lit(0), F.lit(11))
    options = [F.struct(F.lit(n).alias("length"), best_window(F.col("c"), every, n).alias("start"), (window_sum(F.col("c"), best_window(F.col("c"), every, n), n) / F.nullif(total, F.lit(0.0))).alias("captured")) for n in range(3, 7)]
    pick = F.coalesce(F.get(F.filter(F.array(*options), lambda o: o["captured"] >= share), F.lit(0)), options[-1])
    return cycles.select(*by, pick.alias("o")).select(*by, "o.start", "o.length", "o.captured")


# --- clustering --------------------------------------------------------------------------------------------------------


def row_z(c: Column) -> Column:
    """An array less its mean, by its deviation plus 1e-6."""
    n = F.size(c)
    mean = F.aggregate(c, F.lit(0.0), lambda a, v: a + v) / n
    sd = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / n)
    return F.transform(c, lambda v: (v - mean) / (sd + 1e-6))


def gram(field: DataFrame) -> DataFrame:
    """(a, b, g): inner products of the columns of field (cell, col, v), a <= b, summed over all cells; missing values count as 0.

    The columns (months of a record) are few. Each task adds up its own cells' products and gives one row per pair of columns.
    """
    names = np.array(sorted(r[0] for r in field.select("col").distinct().collect()), dtype=np.int64)
    rows = field.where("v IS NOT NULL").groupBy("cell").agg(F.collect_list("col").alias("cols"), F.collect_list("v").alias("vs"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), len(names)))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                cols, vs = part.column(0), part.column(1)
                x = np.zeros((part.num_rows, len(names)))
                owner = np.repeat(np.arange(part.num_rows), cols.value_lengths().to_numpy())
                np.add.at(x, (owner, np.searchsorted(names, cols.flatten().to_numpy(zero_copy_only=False))), vs.flatten().to_numpy(zero_copy_only=False))
                total += x.T @ x
        i, j = np.triu_indices(len(names))
        yield pa.RecordBatch.from_arrays([pa.array(names[i].astype(np.int32)), pa.array(names[j].astype(np.int32)), pa.array(total[i, j])], ["a", "b", "g"])

    sums = rows.select(F.col("cols").cast("array<long>"), F.col("vs").cast("array<double>"))
    return sums.mapInArrow(summed, "a int, b int, g double").groupBy("a", "b").agg(F.sum("g").alias("g"))


def eof_scores(field: DataFrame, modes: int = 5) -> DataFrame:
    """(cell, mode, score): leading left singular vectors of field (cell, col, v). The Gram matrix of the (few) columns is solved on the driver."""
    g = gram(field).toPandas()
    cols = sorted({*g["a"], *g["b"]})
    at = {c: i for i, c in enumerate(cols)}
    m = np.zeros((len(cols), len(cols)))
    for a, b, v in g.itertuples(index=False):
        m[at[a], at[b]] = m[at[b], at[a]] = v
    values, vectors = np.linalg.eigh(m)
    order = np.argsort(values)[::-1][:modes]
    load = [(int(c), k, float(vectors[at[c], j] / np.sqrt(max(values[j], 1e-300)))) for k, j in enumerate(order) for c in cols]
    table = field.sparkSession.createDataFrame(load, "col int, mode int, w double")  # columns times modes
    return field.join(F.broadcast(table), "col").groupBy("cell", "mode").agg(F.sum(F.col("v") * F.col("w")).alias("score"))


def ari(a: np.ndarray, b: np.ndarray) -> float:
    """Adjusted Rand index of two labellings."""
    t = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(t, (a, b), 1)
    pairs = lambda v: (v * (v - 1) / 2).sum()
    together, sa, sb, n = pairs(t), pairs(t.sum(1)), pairs(t.sum(0)), len(a) * (len(a) - 1) / 2
    expected = sa * sb / n
    return float((together - expected) / ((sa + sb) / 2 - expected)) if (sa + sb) / 2 != expected else 1.0


def silhouettes(x: np.ndarray, labels: list[np.ndarray], block: int = 512) -> list[float]:
    """Mean Euclidean silhouette of each labelling over all rows, a block of rows against all at a time; alone in its class: 0."""
    hots = [np.eye(l.max() + 1)[l] for l in labels]  # noqa: E741
    totals = np.zeros(len(labels))
    for at in range(0, len(x), block):
        d = np.sqrt(distances(x[at : at + block], x))
        d[np.arange(len(d)), at + np.arange(len(d))] = 0
        for j, (label, hot) in enumerate(zip(labels, hots)):
            own, n = label[at : at + block], hot.sum(0)
            sums = d @ hot
            rows = np.arange(len(own))
            a = sums[rows, own] / np.maximum(n[own] - 1, 1)
            means = np.where(n > 0, sums / np.maximum(n, 1), np.inf)
            means[rows, own] = np.inf
            b = means.min(1)
            good = (n[own] > 1) & np.isfinite(b)
            totals[j] += np.where(good, (np.where(good, b, 0) - a) / np.maximum(np.maximum(a, np.where(good, b, 0)), 1e-300), 0).sum()
    return (totals / max(1, len(x))).tolist()


def squared_silhouette(points: DataFrame, by: list[str], label: str, vector: str) -> DataFrame:
    """(by, silhouette, n): mean silhouette over squared distances, from class sums: no pair of points is formed.

    A point's mean squared distance to a class is |x|^2 - 2 x m + q, m the class's mean and q its mean of |y|^2. Alone in its
    class: 0. The classes of a group are few.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    p = points.select(*by, F.col(label).alias("_l"), F.transform(vector, lambda v: v.cast("double")).alias("_x")).withColumn("_s", dot(F.col("_x"), F.col("_x"))).withColumn("_id", F.monotonically_increasing_id())
    means = p.select(*by, "_l", F.posexplode("_x").alias("_d", "_v")).groupBy(*by, "_l", "_d").agg(F.avg("_v").alias("_v"))
    m = means.groupBy(*by, "_l").agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_v"))), lambda s: s["_v"]).alias("_m"))
    q = p.groupBy(*by, "_l").agg(F.avg("_s").alias("_q"), F.count("*").alias("_n"))
    classes = m.join(q, [*by, "_l"]).groupBy(*by).agg(F.collect_list(F.struct("_l", "_m", "_q", "_n")).alias("_c"))
    far = F.transform("_c", lambda c: F.struct((c["_l"] == F.col("_l")).alias("own"), (F.col("_s") - 2 * dot(F.col("_x"), c["_m"]) + c["_q"]).alias("d"), c["_n"].alias("n")))
    rows = (p.join(classes, by) if by else p.crossJoin(F.broadcast(classes))).withColumn("_f", far)  # without keys one row on the other side
    own = F.get(F.filter("_f", lambda f: f["own"]), F.lit(0))
    a = own["d"] * own["n"] / F.nullif(own["n"] - 1, F.lit(0))
    b = F.array_min(F.transform(F.filter("_f", lambda f: ~f["own"]), lambda f: f["d"]))
    return rows.groupBy(*by).agg(F.avg(F.coalesce((b - a) / F.nullif(F.greatest(a, b), F.lit(0.0)), F.lit(0.0))).alias("silhouette"), F.count("*").alias("n"))


def year_features(m: np.ndarray, month: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shape, rest) of the rows of m (cells by months of a record), each month counted ``weight`` times: the shape of the annual cycle, and standardised anomalies times the roots of the weights."""
    w = np.where(np.isnan(m), 0.0, weight)
    filled = np.nan_to_num(m)
    hot = month[:, None] == np.arange(1, 13)
    n = w @ hot
    clim = np.where(n > 0, (w * filled) @ hot / np.where(n > 0, n, 1), np.nan)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)  # a month that isn't drawn
        shape = np.nan_to_num((clim - np.nanmean(clim, axis=1, keepdims=True)) / (np.nanstd(clim, axis=1, keepdims=True) + 1e-6))
    rest = np.where(w > 0, filled - np.nan_to_num(clim)[:, month - 1], 0.0)
    total = np.maximum(w.sum(1, keepdims=True), 1)
    mean = (w * rest).sum(1, keepdims=True) / total
    sd = np.sqrt((w * (rest - mean) ** 2).sum(1, keepdims=True) / total)
    return shape, rest / (sd + 1e-6) * np.sqrt(weight)


def loadings(g: np.ndarray, modes: int) -> np.ndarray:
    """Columns that turn rows of a matrix into its leading left singular vectors, from its Gram matrix; modes without variance give zeros."""
    values, vectors = np.linalg.eigh(g)
    values, vectors = values[::-1][:modes], vectors[:, ::-1][:, :modes]
    return np.where(values > 1e-12 * max(values[0], 1e-300), vectors / np.sqrt(np.maximum(values, 1e-300)), 0.0)


def fold_features(m: np.ndarray, month: np.ndarray, modes: int = 5, weight: np.ndarray | None = None) -> np.ndarray:
    """Features of the rows of m (cells by months of a record): the shape of the annual cycle, and the leading left singular
    vectors of standardised anomalies; each block is standardised by column and weighs the same. The plain form of what discover() makes over blocks."""
    shape, rest = year_features(m, month, np.ones(len(month)) if weight is None else weight)
    left = rest @ loadings(rest.T @ rest, modes)
    block = lambda x: (x - x.mean(0)) / (x.std(0) + 1e-9) / np.sqrt(x.shape[1])
    return np.hstack([block(shape), block(left)])


@dataclass
class Zoning:
    """What discover() finds: curve (fold, k, ari, ari_sd, silhouette), chosen (fold, k) and parts (fold, cell, zone)."""

    curve: DataFrame
    chosen: DataFrame
    parts: DataFrame


def training(field: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows of field (cell, lat, lon, year, month, v) in each fold's training years, of the cells valid in them (valid_cells)."""
    rows = field.join(F.broadcast(folds.where("is_train").select("fold", "year")), "year")
    clim = rows.groupBy("fold", "cell", "month").agg(F.avg("v").alias("clim"))
    good = clim.where("clim IS NOT NULL").groupBy("fold", "cell").agg(F.count("*").alias("n"), F.sum("clim").alias("s")).where("n = 12 AND s > 1e-3")
    return rows.join(good.select("fold", "cell"), ["fold", "cell"], "left_semi")


#: Cells of a block of a field.
BLOCK = 2048


def field_blocks(packed: DataFrame, months: dict[int, np.ndarray], block: int = BLOCK) -> DataFrame:
    """(fold, block, ids array<long>, m array<double>): the cells of packed (fold, cell, am, v) dealt to blocks, each a matrix of cells by the fold's months, NaN where a value is missing."""
    n = packed.groupBy("fold").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    dealt = packed.join(F.broadcast(n), "fold").withColumn("block", F.pmod(F.xxhash64("cell"), "n").cast("long"))  # a row a fold

    def matrix(table: pa.Table) -> pa.Table:
        table = table.sort_by("cell")
        at = months[table.column("fold")[0].as_py()]
        am, v = table.column("am").combine_chunks(), table.column("v").combine_chunks()
        m = np.full((table.num_rows, len(at)), np.nan)
        owner = np.repeat(np.arange(table.num_rows), am.value_lengths().to_numpy())
        m[owner, np.searchsorted(at, am.flatten().to_numpy())] = v.flatten().to_numpy(zero_copy_only=False)
        return pa.table([table.column("fold").slice(0, 1), table.column("block").slice(0, 1), as_list(table.column("cell").to_numpy(), pa.int64()), as_list(m.ravel())], ["fold", "block", "ids", "m"])

    dealt = dealt.select("fold", F.col("cell").cast("long").alias("cell"), "block", "am", "v")
    return dealt.groupBy("fold", "block").applyInArrow(matrix, "fold int, block long, ids array<long>, m array<double>")


def discover(field: DataFrame, folds: DataFrame, ks: range = range(2, 9), boots: int = 20, modes: int = 5, bar: float = 0.9, seed: int = 0) -> Zoning:
    """Zones of each fold from its training years alone, their number the largest whose k-means is stable under resampled years.

    A resample of years is a weight of each year, so the field is dealt to blocks of cells once a fold and never copied: a
    block's task makes the features of all resamples. Singular vectors come from Gram matrices of months by months, summed
    over blocks. k-means of up to ``LOCAL`` cells is one task a fold and resample, on its features alone; of more it is seeded
    and moved by sums over blocks for all folds, resamples and k at once. No task holds more than a block of a field, or
    two blocks of its features (LOCAL cells' features in k-means). folds: (fold, year, is_train). Zones are numbered from west to east.
    """
    rows = training(field, folds)
    series = F.array_sort(F.collect_list(F.struct((F.col("year") * 12 + F.col("month") - 1).alias("am"), F.col("v").cast("double").alias("v"))))
    packed = rows.groupBy("fold", "cell").agg(F.first("lon").alias("lon"), series.alias("s"))
    packed = written(packed.select(F.col("fold").cast("int").alias("fold"), "cell", "lon", F.transform("s", lambda x: x["am"]).alias("am"), F.transform("s", lambda x: x["v"]).alias("v")), "packed")
    months: dict[int, list[int]] = {}
    for r in packed.select("fold", F.explode("am").alias("am")).distinct().collect():  # folds by months of a record
        months.setdefault(r.fold, []).append(r.am)
    months = {f: np.array(sorted(at)) for f, at in months.items()}
    blocks = written(field_blocks(packed, months), "blocks")
    size, each = {r.fold: r.n for r in packed.groupBy("fold").agg(F.count("*").alias("n")).collect()}, boots + 1

    def weight(fold: int, boot: int) -> np.ndarray:
        year = months[fold] // 12
        years = np.unique(year)
        if not boot:
            return np.ones(len(year))
        drawn = np.random.default_rng([seed, boot]).choice(years, len(years))
        return (drawn == year[:, None]).sum(1).astype(float)

    def matrices(batch: pa.RecordBatch) -> Iterator[tuple]:
        for fold, block, ids, m in zip(batch.column("fold").to_pylist(), batch.column("block").to_pylist(), batch.column("ids"), batch.column("m"), strict=True):
            m = m.values.to_numpy().reshape(-1, len(months[fold]))
            for boot in range(each):
                yield fold * each + boot, block, ids, *year_features(m, months[fold] % 12 + 1, weight(fold, boot))

    def upper(n: int) -> tuple:
        return np.triu_indices(n)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, block, _, _, rest in matrices(batch):
                g = (rest.T @ rest)[upper(rest.shape[1])]
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([0]), pa.array([block]), as_list(g)], PAYLOAD)

    def solved(name: int, g: np.ndarray) -> np.ndarray:
        n = len(months[name // each])
        whole = np.zeros((n, n))
        whole[upper(n)] = g
        return loadings(np.triu(whole) + np.triu(whole, 1).T, modes).ravel()

    sums = blocks.mapInArrow(grams, SCHEMA)
    load = field.sparkSession.sparkContext.broadcast(gathered(joined(sums, np.add, solved)))  # folds by resamples by months by modes

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, block, ids, shape, rest in matrices(batch):
                x = np.hstack([shape, rest @ load.value[name].reshape(rest.shape[1], -1)])
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block]), as_list(ids.values.to_numpy(), pa.int64()), as_list(x.ravel())], ["set", "block", "ids", "x"])

    width = 12 + modes
    points = Blocks(written(blocks.mapInArrow(features, "set long, block long, ids array<long>, x array<double>"), "features"), width, {name: (np.zeros(width), np.ones(width)) for f in months for name in range(f * each, f * each + each)})
    totals = points.folded(lambda name, ids, x: np.r_[len(x), x.sum(0), (x * x).sum(0)], np.add)
    for name, t in totals.items():
        mean = t[1 : 1 + width] / t[0]
        sd = np.sqrt(np.maximum(t[1 + width :] / t[0] - mean * mean, 0))
        points.scale[name] = (mean, 1 / (sd + 1e-9) / np.sqrt(np.r_[np.full(12, 12), np.full(modes, modes)]))
    fit = fitted_apart if max(size.values(), default=0) <= LOCAL else fitted  # the same centres: features of few cells fit into one task, a step of many is a job
    centres = fit(points, {name: name % each for name in points.scale}, list(ks))
    centres = {name: {k: c for k, c in by.items() if k < size[name // each]} for name, by in centres.items()}

    scaled = points.scaler()

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, ids, x in zip(batch.column("set").to_pylist(), batch.column("ids"), batch.column("x"), strict=True):
                ids, x = ids.values.to_numpy(), scaled(name, x.values.to_numpy())
                for k, c in centres[name].items():
                    cols = [np.full(len(ids), name // each), np.full(len(ids), name % each), np.full(len(ids), k), ids, distances(x, c).argmin(1)]
                    yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)) for a in cols], list(LABELS))

    labels = written(points.rows.mapInArrow(labelled, ", ".join(f"{c} {t}" for c, t in LABELS.items())), "zoning")
    first = labels.where("boot = 0")
    pairs = labels.where("boot > 0").select("fold", "k", "boot", "cell", F.col("zone").alias("b")).join(first.select("fold", "k", "cell", F.col("zone").alias("a")), ["fold", "k", "cell"])
    curve = adjusted_rand(pairs, ["fold", "k", "boot"]).groupBy("fold", "k").agg(F.avg("ari").alias("ari"), F.stddev_pop("ari").alias("ari_sd"))
    real = {name: by for name, by in centres.items() if name % each == 0 and by}
    curve = curve.join(F.broadcast(block_silhouettes(points, real).withColumn("fold", (F.col("set") / each).cast("int")).drop("set")), ["fold", "k"])  # folds by k
    chosen = select_k(curve, ["fold"], bar)
    parts = first.join(chosen, ["fold", "k"]).join(packed.select("fold", "cell", "lon"), ["fold", "cell"])
    place = parts.groupBy("fold", "zone").agg(F.avg("lon").alias("m")).select("fold", "zone", (F.row_number().over(Window.partitionBy("fold").orderBy("m", "zone")) - 1).alias("place"))
    return Zoning(curve, chosen, parts.join(place, ["fold", "zone"]).select("fold", "cell", F.col("place").alias("zone")))


def block_silhouettes(points: Blocks, centres: dict[int, dict[int, np.ndarray]]) -> DataFrame:
    """(set, k, silhouette): mean Euclidean silhouettes over all points, from the distances of pairs of blocks: a task holds two blocks."""
    ks = {name: list(by) for name, by in centres.items()}
    scaled = points.scaler()
    hots = lambda name, x: np.hstack([np.eye(k)[distances(x, c).argmin(1)] for k, c in centres[name].items()])
    held = Blocks(points.rows.where(F.col("set").isin(list(centres))), points.width, points.scale)
    n = held.folded(lambda name, ids, x: hots(name, x).sum(0), np.add)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, a, b, x, y in zip(*[batch.column(c).to_pylist() for c in ("set", "a", "b")], batch.column("x"), batch.column("y"), strict=True):
                x, y = scaled(name, x.values.to_numpy()), scaled(name, y.values.to_numpy())
                d = np.sqrt(distances(x, y))
                if a == b:
                    np.fill_diagonal(d, 0)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([a]), pa.array([b]), as_list(np.hstack([d @ hots(name, y), hots(name, x)]).ravel())], PAYLOAD)

    def scored(name: int, payload: np.ndarray) -> np.ndarray:
        total = n[name]
        both = payload.reshape(-1, 2 * len(total))
        out, at = [len(both)], 0
        for k in ks[name]:
            s, hot, size = both[:, at : at + k], both[:, len(total) + at : len(total) + at + k] > 0, total[at : at + k]
            own = (hot * size).sum(1)
            a = (s * hot).sum(1) / np.maximum(own - 1, 1)
            b = np.where(hot | (size == 0), np.inf, s / np.maximum(size, 1)).min(1)
            good = (own > 1) & np.isfinite(b)
            b = np.where(good, b, 0)
            out.append(np.where(good, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0).sum())
            at += k
        return np.array(out, float)

    left, right = (held.rows.select("set", F.col("block").alias(b), F.col("x").alias(x)) for b, x in (("a", "x"), ("b", "y")))
    rows = left.join(right, "set").mapInArrow(sums, SCHEMA)
    blocks = joined(rows, np.add, scored)  # what a point's classes are is added up too: over 0 in its own
    found = gathered(joined(blocks.select("set", F.lit(0).cast("long").alias("part"), F.col("part").alias("block"), "payload"), np.add))
    return points.rows.sparkSession.createDataFrame([(s, k, float(p[1 + i] / p[0])) for s, p in found.items() for i, k in enumerate(ks[s])], "set long, k int, silhouette double")


#: Columns of the labels that discover() keeps.
LABELS = {"fold": "int", "boot": "int", "k": "int", "cell": "int", "zone": "int"}


def zone_means(field: DataFrame, parts: DataFrame) -> DataFrame:
    """(fold, zone, year, month, mean): area means of each fold's zones, of all years; one pass over the field."""
    return area_mean(field.join(parts, "cell"), ["fold", "zone", "year", "month"])


def zone_cycles(means: DataFrame, folds: DataFrame) -> DataFrame:
    """(fold, zone, month, clim): the annual cycle of each zone of zone_means() over its fold's training years, as totals of the month."""
    train = means.join(F.broadcast(folds.where("is_train").select("fold", "year")), ["fold", "year"])  # folds times years
    return train.groupBy("fold", "zone", "month").agg((F.avg("mean") * F.first(month_length(F.col("month")))).alias("clim"))


def zone_windows(means: DataFrame, folds: DataFrame) -> DataFrame:
    """(fold, zone, start, months, label, total): the seasons of each zone's cycle."""
    return seasons(cycle(zone_cycles(means, folds), ["fold", "zone"]), ["fold", "zone"])


def select_k(curve: DataFrame, by: list[str], bar: float = 0.9) -> DataFrame:
    """(by, k): the largest k whose ARI reaches the bar, else the k of the largest ARI (the smallest of equals)."""
    return curve.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("ari") >= bar, F.col("k"))), F.max_by("k", F.struct("ari", -F.col("k")))).alias("k"))


def adjusted_rand(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, ari) of labels a and b, from their contingency table."""
    c2 = lambda n: n * (n - 1) / 2.0
    t = pairs.groupBy(*by, "a", "b").agg(F.count("*").cast("double").alias("n"))
    rows = t.groupBy(*by, "a").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(c2(F.col("n"))).alias("sa"))
    cols = t.groupBy(*by, "b").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(c2(F.col("n"))).alias("sb"))
    out = t.groupBy(*by).agg(F.sum(c2(F.col("n"))).alias("s"), F.sum("n").alias("n")).join(rows, by).join(cols, by)
    expected, top = F.col("sa") * F.col("sb") / c2(F.col("n")), (F.col("sa") + F.col("sb")) / 2
    return out.select(*by, F.coalesce(F.try_divide(F.col("s") - expected, top - expected), F.lit(1.0)).alias("ari"))


def eta_squared(rows: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """(by, eta2): between-group over total sum of squares, from the groups' sums: no group's rows are gathered."""
    g = rows.where(F.col(value).isNotNull()).groupBy(*by, group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    mean = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    total = F.sum(F.col("n") * (F.col("v") + F.col("m") * F.col("m"))) - F.sum("n") * mean * mean
    within = F.sum(F.col("n") * F.col("v"))
    return g.groupBy(*by).agg(F.try_divide(total - within, total).alias("eta2"))


# --- matching ----------------------------------------------------------------------------------------------------------


def hungarian(cost: np.ndarray) -> dict[int, int]:
    """The one-to-one assignment of rows to columns of least cost, by shortest augmenting paths over potentials."""
    if cost.shape[0] > cost.shape[1]:
        return {r: c for c, r in hungarian(cost.T).items()}
    n, m = cost.shape
    u, v, owner = np.zeros(n), np.zeros(m + 1), np.full(m + 1, -1)  # column m stands for the row being placed
    for row in range(n):
        owner[m], at = row, m
        least, came, done = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while owner[at] >= 0:
            done[at] = True
            r = owner[at]
            gain = cost[r] - u[r] - v[:m]
            better = ~done[:m] & (gain < least)
            least[better], came[better] = gain[better], at
            to = int(np.where(done[:m], np.inf, least).argmin())
            step = least[to]
            u[owner[done]] += step
            v[done] -= step
            least[~done[:m]] -= step
            at = to
        while at != m:
            owner[at], at = owner[came[at]], came[at]
        owner[m] = -1
    return {int(owner[c]): c for c in range(m) if owner[c] >= 0}


def overlap(parts: DataFrame, ref: int) -> DataFrame:
    """(fold, zone, ref_zone, n): cells that each fold's zones share with those of a reference fold, 0 included."""
    refs = parts.where(F.col("fold") == ref).select("cell", F.col("zone").alias("ref_zone"))
    n = parts.join(refs, "cell").groupBy("fold", "zone", "ref_zone").agg(F.count("*").alias("n"))
    every = parts.select("fold", "zone").distinct().crossJoin(F.broadcast(refs.select("ref_zone").distinct()))  # zones: a handful
    return every.join(n, ["fold", "zone", "ref_zone"], "left").fillna(0, ["n"])


def tracks(parts: DataFrame, ref: int) -> DataFrame:
    """(ref_zone, fold, zone): each fold's zones matched one to one to the reference fold's by the most shared cells, a fold a call."""

    def matched(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot(index="zone", columns="ref_zone", values="n")
        found = hungarian(-table.to_numpy(float))
        return pd.DataFrame({"ref_zone": [table.columns[c] for c in found.values()], "fold": pdf["fold"].iloc[0], "zone": [table.index[r] for r in found]})

    return overlap(parts, ref).groupBy("fold").applyInPandas(matched, "ref_zone int, fold int, zone int")


def orphans(parts: DataFrame, matched: DataFrame, cells: DataFrame) -> DataFrame:
    """(fold, zone, n, area): zones without a track, their cells and their share of the fold's area. cells: (cell, w)."""
    area = parts.join(cells, "cell").groupBy("fold", "zone").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    area = area.withColumn("area", F.col("w") / F.sum("w").over(Window.partitionBy("fold"))).drop("w")
    return area.join(matched, ["fold", "zone"], "left_anti")


def stability_metrics(parts: DataFrame, matched: DataFrame, cells: DataFrame, ref: int) -> DataFrame:
    """(fold, orphan_area, absence_share): area of a fold's unmatched zones, and the share of reference zones that it lacks."""
    lost = orphans(parts, matched, cells).groupBy("fold").agg(F.sum("area").alias("orphan_area"))
    have = matched.groupBy("fold").agg(F.count("*").alias("k"))
    k = parts.where(F.col("fold") == ref).agg(F.count_distinct("zone").alias("k_ref"))
    rows = parts.select("fold").distinct().join(lost, "fold", "left").join(have, "fold", "left").crossJoin(F.broadcast(k))  # one row
    return rows.select("fold", F.coalesce("orphan_area", F.lit(0.0)).alias("orphan_area"), (1 - F.coalesce("k", F.lit(0)) / F.col("k_ref")).alias("absence_share"))


def aligned(parts: DataFrame, matched: DataFrame) -> DataFrame:
    """(fold, cell, zone): parts with the names of their tracks; orphans are left out."""
    return parts.join(matched, ["fold", "zone"]).select("fold", "cell", F.col("ref_zone").alias("zone"))


def track_stability(parts: DataFrame, cells: DataFrame) -> DataFrame:
    """(zone, n_folds, agreement, boundary_variation, lat_sd, lon_sd) of aligned parts: mean Jaccard of its cells in pairs of
    folds, the mean share of cells that change, and how far its (plain) centroid moves. cells: (cell, lat, lon)."""
    pairs = jaccard(parts).groupBy("zone").agg(F.avg("jaccard").alias("agreement"), F.avg(1 - F.col("jaccard")).alias("boundary_variation"))
    centre = parts.join(cells, "cell").groupBy("zone", "fold").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    moved = centre.groupBy("zone").agg(F.count("*").alias("n_folds"), F.when(F.count("*") > 1, F.stddev_pop("lat")).alias("lat_sd"), F.when(F.count("*") > 1, F.stddev_pop("lon")).alias("lon_sd"))
    return moved.join(pairs, "zone", "left").select("zone", "n_folds", "agreement", "boundary_variation", "lat_sd", "lon_sd")


def recipe_agreement(recipes: DataFrame, matched: DataFrame, groups: dict[str, str]) -> DataFrame:
    """(zone, window_exact, window_jaccard, predictor, predictor_group, lead, lead_diff) of each track over pairs of its folds.

    recipes: (fold, zone, window, index, lead), a row for each discovered window; groups names each index's group. A pair of
    folds counts for the predictors where both have the window; a window's mean comes before that over windows.
    """
    named = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])
    r = recipes.join(matched, ["fold", "zone"]).select("ref_zone", "fold", "window", "index", "lead", F.try_element_at(named, F.col("index")).alias("grp"))
    sets = r.groupBy("ref_zone", "fold").agg(F.array_sort(F.collect_set("window")).alias("ws"))
    a, b = (sets.select("ref_zone", F.col("fold").alias(f"f{k}"), F.col("ws").alias(f"w{k}")) for k in "ab")
    size = lambda f: F.size(f(F.col("wa"), F.col("wb")))
    wins = a.join(b, "ref_zone").where("fa < fb").groupBy("ref_zone").agg(F.avg((F.col("wa") == F.col("wb")).cast("double")).alias("window_exact"), F.avg(size(F.array_intersect) / size(F.array_union)).alias("window_jaccard"))
    x, y = (r.select("ref_zone", "window", *[F.col(c).alias(f"{c}_{k}") for c in ("fold", "index", "grp", "lead")]) for k in "ab")
    both = x.join(y, ["ref_zone", "window"]).where("fold_a < fold_b")
    same = lambda c: F.avg((F.col(f"{c}_a") == F.col(f"{c}_b")).cast("double")).alias(c)
    each = both.groupBy("ref_zone", "window").agg(same("index"), same("grp"), same("lead"), F.avg(F.abs(F.col("lead_a") - F.col("lead_b"))).alias("diff"))
    picks = each.groupBy("ref_zone").agg(F.avg("index").alias("predictor"), F.avg("grp").alias("predictor_group"), F.avg("lead").alias("lead"), F.avg("diff").alias("lead_diff"))
    return wins.join(picks, "ref_zone", "left").withColumnRenamed("ref_zone", "zone")


def track_skill(scores: DataFrame, matched: DataFrame) -> DataFrame:
    """(zone, rpss, n): each track's held-out skill over its discovered windows, sums before the ratio. scores: (fold, zone, rps_f, rps_c)."""
    rows = scores.join(matched, ["fold", "zone"]).groupBy("ref_zone")
    return rows.agg((1 - F.try_divide(F.sum("rps_f"), F.sum("rps_c"))).alias("rpss"), F.count("*").alias("n")).withColumnRenamed("ref_zone", "zone")


def switch_map(parts: DataFrame) -> DataFrame:
    """(cell, share): how often a cell's (aligned) zone differs between two folds; counts of zones per cell stand in for the pairs."""
    n = parts.groupBy("cell", "zone").agg(F.count("*").alias("n")).groupBy("cell").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("s"))
    return n.select("cell", F.try_divide(F.col("n") * F.col("n") - F.col("s"), F.col("n") * (F.col("n") - 1)).alias("share"))


def jaccard(parts: DataFrame) -> DataFrame:
    """(zone, fold_a, fold_b, jaccard) of a zone's cells in each pair of folds."""
    sizes = parts.groupBy("fold", "zone").agg(F.count("*").alias("n"))
    a, b = parts.select(F.col("fold").alias("fold_a"), "zone", "cell"), parts.select(F.col("fold").alias("fold_b"), "zone", "cell")
    both = a.join(b, ["zone", "cell"]).where("fold_a < fold_b").groupBy("zone", "fold_a", "fold_b").agg(F.count("*").alias("both"))
    for side in ("a", "b"):
        both = both.join(sizes.select(F.col("fold").alias(f"fold_{side}"), "zone", F.col("n").alias(f"n_{side}")), [f"fold_{side}", "zone"])
    return both.select("zone", "fold_a", "fold_b", (F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))).alias("jaccard"))
