"""User candidates for forecasts: plain functions from training data and test predictors to category probabilities, evaluated fold by fold."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isopleth.functions.prob import rps, tercile

#: Name -> fit_predict(train x, train y, test x) -> array (n_test, 3).
CANDIDATES: dict[str, Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]] = {}


def candidate(name: str):
    def keep(f):
        CANDIDATES[name] = f
        return f

    return keep


def load(path: str, name: str) -> str:
    """Registers ``fit_predict`` of a Python file."""
    spec = importlib.util.spec_from_file_location(f"candidate_{name}", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    CANDIDATES[name] = module.fit_predict
    return name


@candidate("climatology")
def _climatology(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.full((len(at), 3), 1 / 3)


@candidate("persistence")
def _persistence(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    edge = np.quantile(x, [1 / 3, 2 / 3])
    return np.eye(3)[np.searchsorted(edge, at)] * 0.4 + 0.2


@candidate("regression")
def _regression(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    from math import erf, sqrt

    b, a = np.polyfit(x, y, 1) if x.std() > 0 else (0.0, y.mean())
    sd = max(1e-9, float((y - a - b * x).std()))
    edge = np.quantile(y, [1 / 3, 2 / 3])
    cdf = np.array([[0.5 * (1 + erf((e - a - b * v) / sd / sqrt(2))) for e in edge] for v in at])
    return np.column_stack([cdf[:, 0], cdf[:, 1] - cdf[:, 0], 1 - cdf[:, 1]])


def evaluate(rows: DataFrame, name: str) -> DataFrame:
    """(fold, year, p, obs, rps_f, rps_c) of a candidate over rows (fold, year, is_train, x, y).

    A fold without training or without test rows has no row. A task sees a fold's training rows and the test rows' predictors; the test targets are joined to its answers afterwards. Answers of
    another shape, or whose rows don't sum to 1 within 1e-6, fail the job.
    """
    predict = CANDIDATES[name]
    train = rows.where("is_train").select("fold", "x", "y")
    test = rows.where("NOT is_train").select(F.col("fold").alias("test_fold"), F.col("year").alias("test_year"), F.col("x").alias("test_x"))

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"fold": b["test_fold"][:0], "year": b["test_year"][:0], "p": pd.Series(dtype=object)})
        p = np.asarray(predict(a["x"].to_numpy(), a["y"].to_numpy(), b["test_x"].to_numpy()), float)
        if p.shape != (len(b), 3) or not np.allclose(p.sum(axis=1), 1, atol=1e-6):
            raise ValueError(f"{name} must return rows of three probabilities")
        p = np.clip(p, 1e-9, 1)
        return pd.DataFrame({"fold": b["test_fold"], "year": b["test_year"], "p": list(p / p.sum(axis=1, keepdims=True))})

    said = train.groupBy("fold").cogroup(test.groupBy("test_fold")).applyInPandas(one, "fold int, year int, p array<double>")
    edges = train.groupBy("fold").agg(F.percentile("y", F.lit(1 / 3)).alias("t33"), F.percentile("y", F.lit(2 / 3)).alias("t67"))
    out = said.join(rows.where("NOT is_train").select("fold", "year", "y"), ["fold", "year"]).join(F.broadcast(edges), "fold")
    out = out.withColumn("obs", tercile(F.col("y"), F.col("t33"), F.col("t67")))
    third = F.lit(1 / 3)
    return out.select("fold", "year", "p", "obs", rps(F.get("p", F.lit(0)), F.get("p", F.lit(1)), F.col("obs")).alias("rps_f"), rps(third, third, F.col("obs")).alias("rps_c"))
