"""Canonical correlation from downdated inner products against decompositions of the fields themselves."""

import numpy as np
import pytest

from isopleth.operators import downscale, multimodel


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(4)
    n, t = 20, rng.normal(size=(20, 2))
    x = {g: t @ rng.normal(size=(2, k)) + 0.3 * rng.normal(size=(n, k)) + 5 for g, k in ((0, 30), (1, 3), (2, 11))}
    y = t @ rng.normal(size=(2, 9)) + 0.3 * rng.normal(size=(n, 9)) + 100
    rows = [(g, "x", c, 1990 + i, float(m[i, c])) for g, m in x.items() for i in range(n) for c in range(m.shape[1])]
    rows += [(g, "y", 50 + c, 1990 + i, float(y[i, c])) for g in x for i in range(n) for c in range(9)]
    rows += [(0, "x", 99, 1990, 1.0), (0, "x", 0, 2050, 1.0), (3, "x", 0, 1990, 1.0), (3, "y", 0, 1990, None), (4, "x", 0, 1991, 1.0)]
    frame = spark.createDataFrame(rows, "g int, side string, cell int, year int, v double").repartition(5)
    return x, y, frame, multimodel.cca_left_out(frame).cache()


def test_left_out_fields_equal_those_of_a_new_decomposition_a_year(made):
    x, y, _, preds = made
    got = {(r.g, r.cell, r.year): (r.y, r.pred) for r in preds.collect()}
    assert len(got) == 3 * 20 * 9
    for g, m in x.items():
        for i in range(20):
            want = downscale.cca(np.delete(m, i, 0), np.delete(y, i, 0), m[i : i + 1])[0]
            mine = [got[g, 50 + c, 1990 + i] for c in range(9)]
            assert np.allclose([p for _, p in mine], want, rtol=0, atol=1e-8) and np.allclose([v for v, _ in mine], y[i])


def test_tables_of_models_and_their_mean(made):
    _, y, _, preds = made
    p = preds.toPandas().pivot_table(index="year", columns=["g", "cell"], values="pred")
    per = {g: p[g].to_numpy() for g in range(3)}
    per[-1] = (per[0] + per[1] + per[2]) / 3
    q = np.quantile(y, [1 / 3, 2 / 3], axis=0)
    obs = np.where(y < q[0], 0, np.where(y < q[1], 1, 2))
    from math import erf

    cdf = np.vectorize(lambda z: 0.5 + 0.5 * erf(z / 2**0.5))
    for r in multimodel.model_table(multimodel.tercile_forecasts(multimodel.with_model_mean(preds))).collect():
        e2 = (y - per[r.g]) ** 2
        sigma = np.sqrt((e2.sum(0) - e2) / (len(y) - 1))
        lo, hi = cdf((q[0] - per[r.g]) / sigma), cdf((q[1] - per[r.g]) / sigma)
        score = lambda a, b: 0.5 * ((a - (obs <= 0)) ** 2 + (b - (obs <= 1)) ** 2)
        best = np.argmax(np.stack([lo, hi - lo, 1 - hi]), axis=0)
        a, b = y - y.mean(0), per[r.g] - per[r.g].mean(0)
        want = (np.corrcoef(a.ravel(), b.ravel())[0, 1], np.sqrt(e2.mean()), 1 - score(lo, hi).sum() / score(1 / 3, 2 / 3).sum(), (best == obs).mean())
        assert r.n == 180 and (r.pearson, r.rmse, r.rpss, r.hit_rate) == pytest.approx(want, abs=1e-6)
