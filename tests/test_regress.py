import numpy as np
import pytest

from isopleth.operators import regress


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    rows = [(c, 2000 + i, float(x), float(0.7 * x + rng.normal()), float(rng.normal())) for c in range(3) for i, x in enumerate(rng.normal(size=24))]
    return rows, spark.createDataFrame(rows, "cell int, year int, x double, y double, x2 double").cache()


def test_left_out_predictions_equal_refits(data):
    rows, frame = data
    got = {(r.cell, r.year): r.loo for r in regress.loyo(frame, ["cell"]).collect()}
    for c in range(3):
        x, y = (np.array([r[k] for r in rows if r[0] == c]) for k in (2, 3))
        for i in range(len(x)):
            keep = np.arange(len(x)) != i
            b, a = np.polyfit(x[keep], y[keep], 1)
            assert got[c, 2000 + i] == pytest.approx(a + b * x[i], abs=1e-10)


def test_two_predictors_equal_least_squares(data):
    rows, frame = data
    got = {r.cell: r for r in regress.two_predictor(frame.withColumnRenamed("x", "x1"), ["cell"]).collect()}
    for c in range(3):
        m = np.array([(1, r[2], r[4]) for r in rows if r[0] == c])
        want = np.linalg.lstsq(m, np.array([r[3] for r in rows if r[0] == c]), rcond=None)[0]
        assert [got[c].b0, got[c].b1, got[c].b2] == pytest.approx(want.tolist(), abs=1e-10)


def test_tendency_left_out(data):
    rows, frame = data
    got = {(r.cell, r.year): r.loo for r in regress.tendency(frame.withColumnRenamed("x", "x1"), ["cell"]).collect()}
    part = [r for r in rows if r[0] == 1]
    m, y = np.array([(1, r[2], r[4]) for r in part]), np.array([r[3] for r in part])
    keep = np.arange(len(y)) != 5
    want = m[5] @ np.linalg.lstsq(m[keep], y[keep], rcond=None)[0]
    assert got[1, 2005] == pytest.approx(want, abs=1e-9)


def test_projection_equals_patterns_made_without_the_year(spark):
    rng = np.random.default_rng(1)
    v, y = rng.normal(size=(6, 15)), rng.normal(size=15)
    f = spark.createDataFrame([(c, i, float(v[c, i])) for c in range(6) for i in range(15)], "cell int, year int, v double")
    t = spark.createDataFrame([(i, float(y[i])) for i in range(15)], "year int, y double")
    got = {r[0]: r[1] for r in regress.projection(f, t).collect()}
    for i in range(15):
        keep = np.arange(15) != i
        cov = [np.cov(v[c, keep], y[keep], ddof=0)[0, 1] for c in range(6)]
        assert got[i] == pytest.approx(sum(cov[c] * (v[c, i] - v[c, keep].mean()) for c in range(6)), abs=1e-10)


def test_combo_recovers_the_drivers(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(5, 40))
    y = x[1] - x[3] + 0.1 * rng.normal(size=40)
    rows = spark.createDataFrame([(0, j, i, float(x[j, i]), float(y[i])) for j in range(5) for i in range(40)], "g int, feature int, year int, x double, y double")
    assert regress.top_combo(rows, ["g"]).first().loo_r > 0.98


def test_arima_recovers_persistence(spark):
    rng = np.random.default_rng(3)
    v = [0.0]
    for _ in range(600):
        v.append(0.8 * v[-1] + rng.normal())
    rows = spark.createDataFrame([(0, i, float(a)) for i, a in enumerate(v)] + [(1, i, 1.0) for i in range(20)], "cell int, t int, v double")
    got = regress.arima(rows, ["cell"], 5).collect()
    assert {r.cell for r in got} == {0} and abs(got[0].phi - 0.8) < 0.12 and abs(got[0].theta) < 0.2
