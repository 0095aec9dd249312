"""Cross-validated canonical correlation of whole fields for several models, from Gram matrices of years by years.

A field meets Spark as one array of years a cell. The inner products of years are summed over cells; everything else
happens in the space of the field's own years: leaving a year out takes one outer product from the diagonal matrix of
variances (a downdate), and a prediction is a sum of the observed years with weights that all cells share. No task holds a field.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isopleth.functions.prob import hit, rps, skill, tercile, with_terciles
from isopleth.functions.scalar import corr, with_stats
from isopleth.sources.io import written

from .kmeans import PAYLOAD, SCHEMA, as_list, gathered, joined


def complete_cells(fields: DataFrame) -> DataFrame:
    """(g, side, cell, years, mean, v): arrays over the years that both sides of a group have, less their mean, of the cells with a value in all of them."""
    rows = fields.where("v IS NOT NULL AND NOT isnan(v)").select("g", "side", "cell", "year", F.col("v").cast("double").alias("v"))
    years = rows.select("g", "side", "year").distinct().groupBy("g", "year").agg(F.count("*").alias("sides")).where("sides = 2").select("g", "year")
    size = years.groupBy("g").agg(F.count("*").alias("n"))
    packed = rows.join(F.broadcast(years), ["g", "year"]).groupBy("g", "side", "cell").agg(F.array_sort(F.collect_list(F.struct("year", "v"))).alias("s"), F.avg("v").alias("mean"))  # years of a record
    packed = packed.join(F.broadcast(size), "g").where(F.size("s") == F.col("n"))  # a row a group
    return packed.select("g", "side", "cell", F.transform("s", lambda s: s["year"]).alias("years"), "mean", F.transform("s", lambda s: s["v"] - F.col("mean")).alias("v"))


def year_grams(packed: DataFrame) -> dict[int, np.ndarray]:
    """The inner products of years, by 2 g for side x and 2 g + 1 for side y; a task adds up its cells and gives one matrix a side."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            names = batch.column("set").to_numpy()
            for name in np.unique(names):
                part = batch.filter(pa.array(names == name)).column("v")
                x = part.flatten().to_numpy().reshape(len(part), -1)
                held[int(name)] = held.get(int(name), 0) + x.T @ x
        from pyspark import TaskContext

        for name, g in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([0]), pa.array([TaskContext.get().partitionId()]), as_list(g.ravel())], PAYLOAD)

    rows = packed.select((F.col("g") * 2 + (F.col("side") == "y").cast("long")).cast("long").alias("set"), "v").mapInArrow(summed, SCHEMA)
    return gathered(joined(rows, np.add))


def scores(gram: np.ndarray, tiny: float = 1e-13) -> tuple[np.ndarray, np.ndarray]:
    """(s, u) of centred data from its inner products of years: deviations and left singular vectors with variance."""
    n = int(round(np.sqrt(gram.size)))
    values, vectors = np.linalg.eigh(gram.reshape(n, n))
    keep = values > tiny * max(values[-1], 1e-300)
    return np.sqrt(values[keep])[::-1], vectors[:, keep][:, ::-1]


def _without(s: np.ndarray, z: np.ndarray, i: int, modes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, deviations, directions) of the scores z without year i: the variances less one outer product."""
    n = len(z)
    values, vectors = np.linalg.eigh(np.diag(s * s) - n / (n - 1) * np.outer(z[i], z[i]))
    values, vectors = values[::-1][:modes], vectors[:, ::-1][:, :modes]
    keep = values > 1e-13 * max(values[0], 1e-300)
    return -z[i] / (n - 1), np.sqrt(values[keep]), vectors[:, keep]


def left_out_weights(x: tuple, y: tuple, i: int, modes: int) -> np.ndarray:
    """Weights of the observed years' anomalies in the prediction of year i, from both sides' scores()."""
    (sx, ux), (sy, uy) = x, y
    zx, zy = ux * sx, uy * sy
    mx, dx, wx = _without(sx, zx, i, modes)
    my, dy, wy = _without(sy, zy, i, modes)
    rest = np.arange(len(zx)) != i
    left, r, right = np.linalg.svd((((zx[rest] - mx) @ wx) / dx).T @ (((zy[rest] - my) @ wy) / dy), full_matrices=False)
    at = (zx[i] - mx) @ wx / dx
    z = my + (at @ left * np.clip(r, 0, 1)) @ right * dy @ wy.T
    return (z / sy) @ uy.T


def cca_left_out(fields: DataFrame, modes: int = 3, least: int = 8) -> DataFrame:
    """(g, cell, year, y, pred): each group's observed field predicted from its model's, each year without itself.

    fields: (g, side 'x' or 'y', cell, year, v). Cells with gaps are left out; without any left on a side, or below eight
    years in common, a group gives no row. What is broadcast are a group's inner products and weights: years by years.
    """
    packed = written(complete_cells(fields), "cells")
    grams = {name: g for name, g in year_grams(packed).items() if g.size >= least * least}
    groups = sorted(name // 2 for name in grams if name % 2 == 0 and name + 1 in grams)
    spark = fields.sparkSession
    held = spark.sparkContext.broadcast({name: scores(g) for name, g in grams.items()})

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, i in zip(batch.column("g").to_pylist(), batch.column("i").to_pylist(), strict=True):
                w = left_out_weights(held.value[2 * g], held.value[2 * g + 1], i, modes)
                yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([i]), as_list(w)], ["g", "i", "w"])

    todo = spark.createDataFrame([(g, i) for g in groups for i in range(int(round(np.sqrt(grams[2 * g].size))))], "g long, i long")  # years of each group
    parts = max(1, min(64, todo.count() // 8))
    weights: dict[int, list] = {}
    for r in sorted(todo.repartition(parts).mapInArrow(solved, "g long, i long, w array<double>").toArrow().to_pylist(), key=lambda r: (r["g"], r["i"])):
        weights.setdefault(r["g"], []).append(r["w"])
    given = spark.sparkContext.broadcast({g: np.array(w) for g, w in weights.items()})

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, cell, mean, years, v in zip(*[batch.column(c).to_pylist() for c in ("g", "cell", "mean")], batch.column("years"), batch.column("v"), strict=True):
                v, n = v.values.to_numpy(), len(v)
                pred = given.value[g] @ v + mean
                yield pa.RecordBatch.from_arrays([pa.array([g] * n, pa.int32()), pa.array([cell] * n, pa.int32()), years.values, pa.array(v + mean), pa.array(pred)], ["g", "cell", "year", "y", "pred"])

    ready = packed.where(F.col("side") == "y").where(F.col("g").isin(groups)).select("g", "cell", "mean", "years", "v")
    return ready.mapInArrow(predicted, "g int, cell int, year int, y double, pred double")


def with_model_mean(preds: DataFrame, g: int = -1) -> DataFrame:
    """preds (g, cell, year, y, pred) and the mean of all models as a group of its own, over the cells and years that every model has."""
    models = preds.select("g").distinct().count()
    mean = preds.groupBy("cell", "year").agg(F.first("y").alias("y"), F.avg("pred").alias("pred"), F.count("*").alias("n")).where(F.col("n") == models)
    return preds.unionByName(mean.select(F.lit(g).alias("g"), "cell", "year", "y", "pred"))


def tercile_forecasts(preds: DataFrame) -> DataFrame:
    """preds (g, cell, year, y, pred) with probabilities ``p`` of thirds and the category ``obs`` that came.

    The spread of a year's forecast is that of the other years' left-out errors; edges are the cell's thirds over the record.
    """
    e2 = F.pow(F.col("y") - F.col("pred"), F.lit(2))
    rows = with_stats(preds, ["g", "cell"], _e=F.sum(e2), _n=F.count("*"))
    edges = preds.groupBy("g", "cell").agg(F.percentile("y", [1 / 3, 2 / 3]).alias("_q"))
    rows = rows.join(edges, ["g", "cell"]).withColumns({"sigma": F.sqrt(F.greatest(F.col("_e") - e2, F.lit(0.0)) / F.greatest(F.col("_n") - 1, F.lit(1))), "t33": F.col("_q")[0], "t67": F.col("_q")[1]})
    rows = with_terciles(rows, F.col("pred"), F.col("sigma"), F.col("t33"), F.col("t67"))
    return rows.withColumn("obs", tercile(F.col("y"), F.col("t33"), F.col("t67"))).drop("_e", "_n", "_q")


def model_table(forecasts: DataFrame) -> DataFrame:
    """(g, n, pearson, rmse, rpss, hit_rate) of tercile_forecasts(), pooled over cells and years; correlation is of departures from each cell's means."""
    third = F.lit(1 / 3)
    rows = with_stats(forecasts, ["g", "cell"], _my=F.avg("y"), _mp=F.avg("pred"))
    rows = rows.select("g", (F.col("y") - F.col("_my")).alias("a"), (F.col("pred") - F.col("_mp")).alias("b"), F.pow(F.col("y") - F.col("pred"), F.lit(2)).alias("e"), rps(F.get("p", F.lit(0)), F.get("p", F.lit(1)), F.col("obs")).alias("f"), rps(third, third, F.col("obs")).alias("c"), hit(F.col("p"), F.col("obs")).alias("hit"))
    return rows.groupBy("g").agg(F.count("*").alias("n"), corr("a", "b").alias("pearson"), F.sqrt(F.avg("e")).alias("rmse"), skill(F.col("f"), F.col("c")).alias("rpss"), F.avg("hit").alias("hit_rate"))
