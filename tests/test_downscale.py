import numpy as np

from isopleth.operators import candidates, downscale
from isopleth.operators.benchmarks import fixed_mean


def test_methods_on_a_linear_model():
    rng = np.random.default_rng(0)
    x = rng.normal(size=40)
    y = 3 + 2 * x
    at = np.array([0.3])
    assert abs(downscale.METHODS["regression"](x, y, at)[0] - 3.6) < 1e-9
    assert abs(downscale.METHODS["bcsd"](x, y, at)[0] - 3.6) < 1e-9
    assert abs(downscale.METHODS["qm"](x, y, at)[0] - 3.6) < 0.5
    assert abs(downscale.METHODS["delta"](x, y, at)[0] - (y.mean() + 0.3 - x.mean())) < 1e-12
    assert abs(downscale.METHODS["rank_analog"](x, y, at)[0] - 3.6) < 0.5
    low, mid, high = downscale.METHODS["logit"](x, y, np.array([-3.0, 0.3, 3.0]))
    thirds = [part.mean() for part in np.array_split(np.sort(y), 3)]
    assert abs(low - thirds[0]) < 0.6 and abs(high - thirds[2]) < 0.6 and low < mid < high


def test_cca_recovers_a_shared_pattern():
    rng = np.random.default_rng(1)
    t = rng.normal(size=60)
    x, y = (np.outer(t, rng.normal(size=n)) + 0.05 * rng.normal(size=(60, n)) for n in (8, 6))
    pred = np.array([downscale.cca(np.delete(x, i, 0), np.delete(y, i, 0), x[i : i + 1])[0] for i in range(60)])
    assert np.corrcoef(pred.ravel(), y.ravel())[0, 1] > 0.99


def test_left_out_is_without_the_year(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(2, 12))
    frame = spark.createDataFrame([(0, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))] + [(1, 0, 1.0, 1.0)], "cell int, year int, x double, y double")
    got = {(r.method, r.year): r.pred for r in downscale.left_out(frame, ["cell"], ["climatology", "regression"]).collect()}
    assert len(got) == 24
    assert abs(got["climatology", 3] - np.delete(y, 3).mean()) < 1e-12
    b, a = np.polyfit(np.delete(x, 5), np.delete(y, 5), 1)
    assert abs(got["regression", 5] - (a + b * x[5])) < 1e-10


def test_candidates_are_held_to_their_contract(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=40)
    y = -1.2 * x + rng.normal(size=40)
    frame = spark.createDataFrame([(0, i, i < 30, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "fold int, year int, is_train boolean, x double, y double")
    s = {n: candidates.evaluate(frame, n).selectExpr("1 - sum(rps_f) / sum(rps_c) AS s").first().s for n in ("climatology", "regression")}
    assert abs(s["climatology"]) < 1e-12 and s["regression"] > 0
    candidates.CANDIDATES["wrong"] = lambda a, b, at: np.ones((len(at), 3))
    try:
        candidates.evaluate(frame, "wrong").collect()
        raise AssertionError("rows that don't sum to one were taken")
    except Exception as e:
        assert "three probabilities" in str(e)


def test_fixed_mean_of_one_zone_is_its_regression(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=30)
    y = x + rng.normal(size=30)
    frame = spark.createDataFrame([(0, 0, 1.0, i, i < 25, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "fold int, zone int, w double, year int, is_train boolean, x double, y double")
    b, a = np.polyfit(x[:25], y[:25], 1)
    got = {r.year: r.pred for r in fixed_mean(frame).collect()}
    assert all(abs(got[i] - (a + b * x[i])) < 1e-8 for i in range(25, 30))
