"""Downscaling methods by name, left-out by year; published definitions, not verified against any hidden library.

A method maps training model values x, training observations y and new model values to predictions. Per-cell methods run as one task a
cell; canonical correlation of whole fields is in multimodel.py, ``cca`` here is its plain form.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .regress import logistic

METHODS: dict[str, Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]] = {}


def method(name: str):
    def keep(f):
        METHODS[name] = f
        return f

    return keep


@method("climatology")
def _climatology(x, y, at):
    return np.full(len(at), y.mean())


@method("delta")
def _delta(x, y, at):
    """The model's anomaly on the observed mean."""
    return y.mean() + at - x.mean()


@method("regression")
def _regression(x, y, at):
    if x.std() == 0:
        return np.full(len(at), y.mean())
    b, a = np.polyfit(x, y, 1)
    return a + b * at


@method("qm")
def _quantile_map(x, y, at):
    """The observed value at the model value's empirical quantile."""
    q = (np.searchsorted(np.sort(x), at, "left") + np.searchsorted(np.sort(x), at, "right")) / 2 / len(x)
    return np.quantile(y, np.clip(q, 0, 1))


@method("dqm")
def _detrended_quantile_map(x, y, at):
    """Quantile mapping of the values less their own mean, which is put back as a shift."""
    shift = at.mean() - x.mean()
    return _quantile_map(x, y, at - shift) + shift


@method("bcsd")
def _bcsd(x, y, at):
    """Variance-matched anomalies on the observed mean (bias correction; the spatial step is a regridding done before)."""
    return y.mean() + (at - x.mean()) * (y.std() / x.std() if x.std() > 0 else 0.0)


@method("rank_analog")
def _rank_analog(x, y, at):
    """The mean observation of the three training years nearest in the model's value."""
    near = np.argsort(np.abs(x[:, None] - at), axis=0, kind="stable")[: min(3, len(x))]
    return y[near].mean(axis=0)


@method("logit")
def _logit(x, y, at):
    """The thirds' mean observations, weighted by logistic probabilities of the outer thirds."""
    edges = np.quantile(y, [1 / 3, 2 / 3])
    third = np.searchsorted(edges, y, "right")
    means = np.array([y[third == k].mean() if (third == k).any() else y.mean() for k in range(3)])
    m, sd = x.mean(), x.std() or 1.0
    outer = [1 / (1 + np.exp(-np.column_stack([np.ones(len(at)), (at - m) / sd]) @ logistic((x - m) / sd, (third == k).astype(float)))) for k in (0, 2)]
    p = np.clip(np.stack([outer[0], 1 - outer[0] - outer[1], outer[1]]), 1e-9, 1)
    return means @ (p / p.sum(axis=0))


def left_out(pairs: DataFrame, by: list[str], names: list[str], least: int = 8) -> DataFrame:
    """(by, method, year, y, pred): predictions of each year (year, x, y) by every named method without that year; short groups give none."""
    chosen = {n: METHODS[n] for n in names}

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["x", "y"])
        x, y, years, rows = pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["year"].tolist(), []
        if len(pdf) >= least:
            group = [pdf[c].iloc[0] for c in by]
            for name, f in chosen.items():
                rows += [(*group, name, years[i], float(y[i]), float(f(np.delete(x, i), np.delete(y, i), x[i : i + 1])[0])) for i in range(len(x))]
        return pd.DataFrame(rows, columns=[*by, "method", "year", "y", "pred"])

    keys = ", ".join(f"{c} {t}" for c, t in pairs.dtypes if c in by)
    return pairs.groupBy(*by).applyInPandas(one, f"{keys}, method string, year int, y double, pred double")


def cca(x: np.ndarray, y: np.ndarray, at: np.ndarray, modes: int = 3) -> np.ndarray:
    """Predictions of a field (years by cells) from another by canonical correlation of their leading EOFs."""
    mx, my = x.mean(0), y.mean(0)
    ux, sx, vx = np.linalg.svd(x - mx, full_matrices=False)
    uy, sy, vy = np.linalg.svd(y - my, full_matrices=False)
    kx, ky = (min(modes, int((s > 1e-9 * s[0]).sum())) for s in (sx, sy))
    left, r, right = np.linalg.svd(ux[:, :kx].T @ uy[:, :ky], full_matrices=False)
    score = (at - mx) @ vx[:kx].T / sx[:kx]
    return my + (score @ left * np.clip(r, 0, 1)) @ right * sy[:ky] @ vy[:ky]
