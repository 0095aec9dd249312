"""Fits with errors, calibrations, daily models, candidates, guards and posts against plain versions."""

import datetime as dt

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from isopleth.functions import calendar as cal
from isopleth.functions import prob
from isopleth.functions.scalar import percent, signed, with_stats
from isopleth.operators import benchmarks, candidates, cube, inference, regress, text
from isopleth.sources import io
from isopleth.streaming import issuance


@pytest.fixture(scope="module")
def triples(spark):
    rng = np.random.default_rng(0)
    rows = [(c, 2000 + i, *map(float, (x1, x2, 0.7 * x1 - 0.2 * x2 + e))) for c in range(3) for i, (x1, x2, e) in enumerate(rng.normal(size=(24, 3)))]
    return rows, spark.createDataFrame(rows, "cell int, year int, x1 double, x2 double, y double").cache()


def least_squares(rows):
    a, y = np.array([(1, r[2], r[3]) for r in rows]), np.array([r[4] for r in rows])
    coef = np.linalg.lstsq(a, y, rcond=None)[0]
    s2 = ((y - a @ coef) ** 2).sum() / (len(y) - 3)
    return coef, np.sqrt(s2), np.sqrt(np.diag(s2 * np.linalg.inv(a.T @ a)))


def test_errors_of_two_predictors(triples):
    rows, frame = triples
    for r in regress.two_predictor(frame, ["cell"]).collect():
        coef, sd, se = least_squares([t for t in rows if t[0] == r.cell])
        assert [r.b0, r.b1, r.b2] == pytest.approx(coef.tolist()) and r.resid_sd == pytest.approx(sd)
        assert [r.se0, r.se1, r.se2] == pytest.approx(se.tolist()) and r.n == 24


def test_tendency_equals_refits(spark, triples):
    rows, frame = triples
    gap = spark.createDataFrame([(0, 2999, 1.0, None, 2.0)], frame.schema)
    got = {(r.cell, r.year): r.loo for r in regress.tendency(frame.unionByName(gap), ["cell"]).collect()}
    assert len(got) == 72
    for c, year, x1, x2, _ in rows:
        coef = least_squares([t for t in rows if t[0] == c and t[1] != year])[0]
        assert got[c, year] == pytest.approx(coef @ [1, x1, x2])
    now = spark.createDataFrame([(c, 0.5, -1.0) for c in range(3)], "cell int, x1 double, x2 double")
    for r in regress.tendency_calibration(frame, now, ["cell"]).collect():
        own = [t for t in rows if t[0] == r.cell]
        coef, _, se = least_squares(own)
        left, y = np.array([got[r.cell, t[1]] for t in own]), np.array([t[4] for t in own])
        assert r.predicted == pytest.approx(coef @ [1, 0.5, -1.0]) and r.c_t == pytest.approx(coef[2] / se[2])
        assert r.loyo_r == pytest.approx(np.corrcoef(left, y)[0, 1]) and r.loyo_rmse == pytest.approx(np.sqrt(((left - y) ** 2).mean()))


def test_statistics_of_groups_with_null_keys(spark):
    rows = [(None, 1.0), (None, 3.0), ("a", 5.0)]
    got = with_stats(spark.createDataFrame(rows, "k string, v double"), ["k"], m=F.avg("v")).collect()
    assert sorted((r.v, r.m) for r in got) == [(1.0, 2.0), (3.0, 2.0), (5.0, 5.0)]
    assert [r.m for r in with_stats(spark.createDataFrame(rows, "k string, v double"), [], m=F.avg("v")).collect()] == [3.0] * 3


def arma_covariance(phi, theta, n):
    near, far = (1 + 2 * phi * theta + theta**2) / (1 - phi**2), (1 + phi * theta) * (phi + theta) / (1 - phi**2)
    return np.array([[near if i == j else far * phi ** (abs(i - j) - 1) for j in range(n)] for i in range(n)])


def test_likelihood_is_exact_with_and_without_gaps():
    """Against the density of a normal vector, from its covariance."""
    rng = np.random.default_rng(1)
    for phi, theta in ((0.8, 0.3), (-0.5, 0.6), (0.2, -0.7), (0.0, 0.0)):
        for gaps in ((), (5, 6, 17), (0, 39)):
            x = rng.normal(size=40)
            x[list(gaps)] = np.nan
            have = np.flatnonzero(~np.isnan(x))
            g = arma_covariance(phi, theta, 41)
            part = g[np.ix_(have, have)]
            q = x[have] @ np.linalg.solve(part, x[have]) / len(have)
            got, sigma2, now = regress.arma_likelihood(x, np.array([phi]), np.array([theta]))
            assert got[0] == pytest.approx(len(have) * np.log(q) + np.linalg.slogdet(part)[1]) and sigma2[0] == pytest.approx(q)
            assert now[0] == pytest.approx(g[40, have] @ np.linalg.solve(part, x[have]))


def test_arma_is_found_and_forecast(spark):
    rng = np.random.default_rng(3)
    e = rng.normal(size=900)
    x = np.zeros(900)
    for i in range(1, 900):
        x[i] = 0.8 * x[i - 1] + e[i] + 0.4 * e[i - 1]
    rows = [(0, i, float(v) + 5) for i, v in enumerate(x) if i % 50 != 7] + [(1, i, 1.0) for i in range(20)]
    got = regress.arima(spark.createDataFrame(rows, "cell int, t int, v double"), ["cell"], 4).collect()
    assert {r.cell for r in got} == {0} and len(got) == 4
    r = got[0]
    assert abs(r.phi - 0.8) < 0.06 and abs(r.theta - 0.4) < 0.1 and abs(r.sigma - 1) < 0.08 and r.converged
    y = x + 5
    y[[i for i in range(900) if i % 50 == 7]] = np.nan
    mean = np.nanmean(y)
    best = min((regress.arma_likelihood(y - mean, np.array([p]), np.array([t]))[0][0], p, t) for p in np.arange(r.phi - 0.02, r.phi + 0.021, 0.01) for t in np.arange(r.theta - 0.02, r.theta + 0.021, 0.01))
    assert regress.arma_likelihood(y - mean, np.array([r.phi]), np.array([r.theta]))[0][0] <= best[0] + 1e-6
    now = regress.arma_likelihood(y - mean, np.array([r.phi]), np.array([r.theta]))[2][0]
    assert [g.forecast for g in sorted(got, key=lambda g: g.lead)] == pytest.approx([mean + now * r.phi**k for k in range(4)])


def test_daily_windows_see_only_the_past(spark):
    """A planted cycle with persistence: the same forecasts whatever comes on and after the init, which is itself day 1; short histories give none."""
    rng = np.random.default_rng(4)
    start, days = dt.date(2001, 1, 1), 5 * 365
    v, a = [], 0.0
    for i in range(days):
        a = 0.9 * a + rng.normal()
        v.append(20 + 5 * np.sin(2 * np.pi * (start + dt.timedelta(i)).timetuple().tm_yday / 366) + a)
    init = start + dt.timedelta(4 * 365 + 100)
    daily = lambda late: spark.createDataFrame([("x", start + dt.timedelta(i), float(v[i] + (late if start + dt.timedelta(i) >= init else 0))) for i in range(days)], "cell string, date date, v double")
    inits = spark.createDataFrame([(init,), (start + dt.timedelta(500),)], "init date")
    windows = spark.createDataFrame([("day1", 1, 1), ("week1", 1, 7), ("week2", 8, 14)], "window string, first_day int, last_day int")

    def cycle(past, by):
        return cube.doy_climatology(past.withColumn("cell", F.col("cell"))).crossJoin(past.select("init").distinct()).select(*by, "doy", "clim")

    one, two = ({r.window: (r.pred, r.n) for r in regress.arima_windows(daily(late), inits, windows, ["cell"], cycle).collect()} for late in (0, 50))
    assert set(one) == {"day1", "week1", "week2"} and one == two and one["day1"][1] == 4 * 365 + 100
    last = v[4 * 365 + 99] - (20 + 5 * np.sin(2 * np.pi * (init - dt.timedelta(1)).timetuple().tm_yday / 366))
    clim = 20 + 5 * np.sin(2 * np.pi * init.timetuple().tm_yday / 366)
    assert one["day1"][0] == pytest.approx(clim + 0.9 * last, abs=1.2)


def test_candidates(spark, tmp_path):
    rows = [(0, k, k < 12, float(k % 5), float((3 * k) % 7)) for k in range(16)] + [(1, k, True, 1.0, 1.0) for k in range(5)]
    frame = spark.createDataFrame(rows, "fold int, year int, is_train boolean, x double, y double")
    got = candidates.evaluate(frame, "climatology").collect()
    assert {(r.fold, r.year) for r in got} == {(0, k) for k in range(12, 16)} and all(r.rps_f == pytest.approx(r.rps_c) for r in got)
    path = tmp_path / "mine.py"
    path.write_text("import numpy as np\n\ndef fit_predict(x, y, at):\n    return np.tile([0.2, 0.3, 0.5], (len(at), 1))\n")
    got = candidates.evaluate(frame, candidates.load(str(path), "mine")).collect()
    assert len(got) == 4 and all(r.p == pytest.approx([0.2, 0.3, 0.5]) for r in got)


def test_persistence_is_tested_by_left_out_predictions(spark):
    """Skill, test and interval of each length, from refits without the year, as the definition says."""
    rng = np.random.default_rng(5)
    n, days = 30, (7, 14, 30)
    y = rng.normal(size=n)
    model = y + rng.normal(size=n)
    anchors = {d: 0.5 * y + rng.normal(size=n) for d in days}
    rows = spark.createDataFrame([(0, d, k, float(model[k]), float(anchors[d][k]), float(y[k])) for d in days for k in range(n)], "cell int, days int, place int, model double, anchor double, y double")
    draws = inference.resamples(rows.select("place").distinct(), 50)
    r = benchmarks.persistence_table(rows, draws, ["cell"]).first()
    left = lambda x: np.array([np.polyval(np.polyfit(np.delete(x, i), np.delete(y, i), 1), x[i]) for i in range(n)])
    pm = left(model)
    rm = np.corrcoef(pm, y)[0, 1]
    assert (r.model_r, r.model_rmse) == pytest.approx((rm, np.sqrt(np.mean((pm - y) ** 2))))
    for d in days:
        pp = left(anchors[d])
        rp, rmp = np.corrcoef(pp, y)[0, 1], np.corrcoef(pm, pp)[0, 1]
        det = np.linalg.det(np.array([[1, rm, rp], [rm, 1, rmp], [rp, rmp, 1]]))
        t = (rm - rp) * np.sqrt((n - 1) * (1 + rmp) / (2 * (n - 1) / (n - 3) * det + (rm + rp) ** 2 / 4 * (1 - rmp) ** 3))
        gains = [np.corrcoef(pm[k], y[k])[0, 1] - np.corrcoef(pp[k], y[k])[0, 1] for k in (g["place"].to_numpy() for _, g in draws.toPandas().groupby("rep"))]
        lo, hi = np.quantile(gains, [0.1, 0.9])
        got = (r[f"persist{d}_r"], r[f"gain{d}"], r[f"p{d}"], r[f"gain{d}_lo"], r[f"gain{d}_hi"])
        assert got == pytest.approx((rp, rm - rp, 2 * (1 - prob.t_cdf(abs(t), n - 3)), lo, hi))


def test_arima_comparison_on_common_inits(spark):
    """Skip reasons, the comparison and the dipole, from loops over made tables."""
    rng = np.random.default_rng(11)
    inits = [dt.date(2000 + k, 6, 1) for k in range(9)]
    pred = {(c, i): float(rng.normal()) for c in "ab" for i in inits[3:]}
    obs = {(c, i): float(rng.normal()) for c in "ab" for i in inits[:8]}
    x = {(c, i): obs[c, i] + float(rng.normal()) for c, i in obs}
    p = spark.createDataFrame([(c, i, "w", v, i.year % 2 == 0) for (c, i), v in pred.items()], "cell string, init date, window string, pred double, converged boolean")
    o = spark.createDataFrame([(c, i, "w", v) for (c, i), v in obs.items()], "cell string, init date, window string, obs double")
    m = spark.createDataFrame([(c, "w", i, x[c, i], obs[c, i]) for c, i in obs], "cell string, window string, init date, x double, y double")
    for r in regress.arima_against_model(p, o, m, ["cell"]).collect():
        own = [i for i in inits[:8]]
        xs, ys = np.array([x[r.cell, i] for i in own]), np.array([obs[r.cell, i] for i in own])
        left = np.array([np.polyval(np.polyfit(np.delete(xs, k), np.delete(ys, k), 1), xs[k]) for k in range(len(own))])[3:]
        ap, ao = np.array([pred[r.cell, i] for i in own[3:]]), ys[3:]
        want = (np.corrcoef(left, ao)[0, 1], np.sqrt(np.mean((left - ao) ** 2)), np.corrcoef(ap, ao)[0, 1], np.sqrt(np.mean((ap - ao) ** 2)))
        assert r.n == 5 and (r.model_r, r.model_rmse, r.arima_r, r.arima_rmse) == pytest.approx(want) and r.rmse_diff == pytest.approx(want[3] - want[1])
    clim = {c: np.mean([obs[c, i] for i in inits[:8]]) for c in "ab"}
    got = {r.init: r.dipole for r in regress.arima_dipole(p, o, "a", "b").collect()}
    assert got == pytest.approx({i: pred["a", i] - clim["a"] - (pred["b", i] - clim["b"]) for i in inits[3:]})
    days = [("a", dt.date(2000, 1, 1) + dt.timedelta(k), 1.0) for k in range(1500)] + [("b", dt.date(2007, 1, 1) + dt.timedelta(k), 1.0) for k in range(900)]
    daily = spark.createDataFrame(days, "cell string, date date, v double")
    status = {(r.cell, r.init.year): r.status for r in regress.arima_report(daily, spark.createDataFrame([(i,) for i in inits], "init date"), p, o, ["cell"]).collect()}
    assert status["a", 2000] == "short series" and status["a", 2002] == "short cycle" and status["a", 2005] == "scored" and status["a", 2008] == "unobserved" and status["b", 2003] == "scored"


def test_two_sided_p_of_t(spark):
    cases = [(t, df) for t in (-3.2, -0.4, 0.0, 0.7, 2.1, 12.0) for df in (1, 2, 3, 4, 5, 17, 100)]
    frame = spark.createDataFrame(cases, "t double, df int")
    for r in frame.withColumn("p", prob.t_two_sided(F.col("t"), F.col("df"))).collect():
        assert r.p == pytest.approx(2 * (1 - prob.t_cdf(abs(r.t), r.df)), abs=1e-12)


def test_logit_and_gridded(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=40)
    y = x + 0.5 * rng.normal(size=40)
    edges = np.quantile(y, [1 / 3, 2 / 3])
    obs = np.searchsorted(edges, y, "right")
    frame = spark.createDataFrame([(0, k, float(x[k]), int(obs[k])) for k in range(40)], "cell int, year int, x double, obs int")
    got = {r.year: (r.p0, r.p2) for r in regress.logit_terciles(frame, ["cell"]).collect()}
    z = (x - x.mean()) / x.std()
    for i in (0, 7, 31):
        keep = np.arange(40) != i
        for at, c in enumerate((0, 2)):
            b = np.zeros(2)
            a, t = np.column_stack([np.ones(39), z[keep]]), (obs[keep] == c).astype(float)
            for _ in range(20_000):
                b += 0.01 * (a.T @ (t - 1 / (1 + np.exp(-a @ b))) - 1e-2 * b)
            assert got[i][at] == pytest.approx(1 / (1 + np.exp(-(b[0] + b[1] * z[i]))), abs=1e-4)
    cells = spark.createDataFrame([(0, c, 0, k, k < 30, float(y[k] + c)) for c in range(2) for k in range(40)], "fold int, cell int, zone int, year int, is_train boolean, y double")
    signal = spark.createDataFrame([(0, 0, k, float(x[k])) for k in range(40)], "fold int, zone int, year int, x double")
    r = benchmarks.gridded(cells, signal).first()
    b, a = np.polyfit(x[:30], y[:30], 1)
    dx = x[:30] - x[:30].mean()
    sd = np.std((y[:30] - a - b * x[:30]) / (1 - 1 / 30 - dx**2 / (dx**2).sum()))
    q = np.quantile(y[:30], [1 / 3, 2 / 3])
    from math import erf

    f = c = 0.0
    for k in range(30, 40):
        low, high = (0.5 * (1 + erf((e - a - b * x[k]) / sd / np.sqrt(2))) for e in q)
        o = 0 if q[0] > y[k] else 1 if q[1] > y[k] else 2
        f += 0.5 * ((low - (o <= 0)) ** 2 + (high - (o <= 1)) ** 2)
        c += 0.5 * ((1 / 3 - (o <= 0)) ** 2 + (2 / 3 - (o <= 1)) ** 2)
    assert r.rpss == pytest.approx(1 - f / c, abs=1e-6) and r.n == 20


def test_guards_refuse(spark, tmp_path):
    grid = spark.createDataFrame([(float(a), float(b), 2000 + y, m, 1.0 + a) for a in (0, 10) for b in (5, 15) for y in (0, 1) for m in range(1, 13)], "lat double, lon double, year int, month int, v double")
    assert io.covering(grid, {"a": (-5, 5, 0, 10)}).count() == grid.count() == io.exact_months(grid, 2000, 2001).count()
    for bad in (lambda: io.covering(grid, {"a": (-5, 5, 0, 10), "b": (20, 30, 0, 10)}), lambda: io.exact_months(grid, 2000, 2002), lambda: io.exact_months(grid.where("month <> 5 OR year <> 2001"), 2000, 2001), lambda: io.guarded(grid.withColumn("v", F.lit(1.0)), "v"), lambda: io.guarded(grid.withColumn("v", F.when(F.col("month") == 1, F.col("v"))), "v", 0.3)):
        with pytest.raises(PySparkException, match="refused"):
            bad().collect()
    path = f"file://{tmp_path}/field"
    grid.withColumn("v", F.when(F.col("month") == 2, F.lit(float("nan"))).otherwise(F.col("v"))).write.parquet(path)
    got = io.read_field(spark, path, grid.schema, (0, 5, 0, 10))
    assert got.count() == 24 and got.where("month = 2 AND v IS NOT NULL").count() == 0
    with pytest.raises(PySparkException, match="no cell"):
        io.read_field(spark, path, grid.schema, (50, 60, 0, 10)).collect()


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        io.shared_folder(Session, "x")


def test_rescoring_replaces_recent_days_alone(spark, tmp_path):
    path = f"file://{tmp_path}/days"
    day = lambda k: f"2024-01-{k:02d}"
    rows = spark.createDataFrame([(c, float(k), day(k)) for c in "ab" for k in range(1, 21)], "cell string, v double, day string").withColumn("day", F.to_date("day"))
    rows.write.partitionBy("day").parquet(path)
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    issuance.rescore(path, rows.where("cell = 'a'").withColumn("v", F.col("v") + 100), "day", "2024-01-20", 14)
    got = sorted((r.cell, r.v) for r in spark.read.parquet(path).collect())
    assert got == sorted([(c, float(k)) for c in "ab" for k in range(1, 7)] + [("a", 100.0 + k) for k in range(7, 21)])
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before


def test_posts(spark):
    page = """<html><nav><a href="/category/nav">nav</a></nav><article><h1 class="big entry-title">Rain &amp; <i>shine</i></h1>
    <span class="posted-on">Posted on March 3, 2024March 3, 2024</span><time datetime="2024-03-03T08:00">x</time>
    <a href="/?cat=7">b area</a> <a href="https://x.org/category/a/">a area</a><a href="/category/a2">a area</a><a href="/other">c</a>
    <div class="byline">By Ada L.</div><p>Text.</p></article></html>"""
    rows = [(1, page), (2, "<h1>Only a head</h1><p>Words.<br>Authors: Bo and Cy. More</p><time>4 days ago</time>"), (3, ""), (4, None)]
    got = {r.page_id: (r.title, r.iso_date, r.date, r.author, r.categories) for r in text.posts(spark.createDataFrame(rows, "page_id int, html string")).collect()}
    assert got[1] == ("Rain & shine", "2024-03-03", "March 3, 2024", "Ada L.", ["a area", "b area", "nav"])
    assert got[2] == ("Only a head", "", "4 days ago", "Bo and Cy", [])
    assert got[3] == ("post-3", "", "", "", []) and got[4][0] == "post-4"


def test_texts_of_numbers_and_spans(spark):
    one = spark.createDataFrame([(1.234, -0.5, 0.256, dt.date(2024, 9, 28), dt.date(2024, 10, 3))], "a double, b double, c double, d date, e date")
    r = one.select(signed(F.col("a")).alias("a"), signed(F.col("b")).alias("b"), percent(F.col("c"), 1).alias("c"), cal.span_text(F.col("d"), F.date_add("d", 6)).alias("d"), cal.span_text(F.col("e"), F.date_add("e", 6)).alias("e")).first()
    assert tuple(r) == ("+1.23", "−0.50", "25.6%", "28 Sep – 4 Oct", "3 – 9 Oct")


def test_ranks_over_parts_of_a_group(spark):
    """Many values, many ties and several groups: areas and rank correlations of loops."""
    rng = np.random.default_rng(7)
    rows = [(g, int(k), float(s), int(p)) for g in range(3) for k, (s, p) in enumerate(zip(rng.integers(0, 40, 400) ** 2, rng.integers(0, 2, 400)))]
    frame = spark.createDataFrame(rows, "g int, k int, s double, p int")
    for r in inference.auc(frame, ["g"], "s", F.col("p") == 1).collect():
        pos, neg = (np.array([t[2] for t in rows if t[0] == r.g and t[3] == c]) for c in (1, 0))
        assert r.auc == pytest.approx(((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)).mean()) and (r.n_pos, r.n_neg) == (len(pos), len(neg))
    for r in inference.auc(frame, ["g"], "s", F.col("p") == 1, "k").collect():
        pos, neg = ([(t[2], t[1]) for t in rows if t[0] == r.g and t[3] == c] for c in (1, 0))
        assert r.auc == pytest.approx(np.mean([a > b for a in pos for b in neg]))
    sums = inference.running_sums(frame, ["g"], "s", ["p"], "k", bins=8).collect()
    assert len(sums) == 1200
    for r in sums[::97]:
        assert r.p_before == sum(t[3] for t in rows if t[0] == r.g and (t[2], t[1]) < (r.s, r.k))


def test_t_quantile_of_the_intervals():
    """The 90 % quantile of Student's t by integrating its density."""
    for n in (3, 10, 60):
        q = prob.t_quantile(0.9, n)
        x = np.linspace(0, q, 200_001)
        from math import gamma, pi, sqrt

        f = gamma((n + 1) / 2) / sqrt(n * pi) / gamma(n / 2) * (1 + x * x / n) ** (-(n + 1) / 2)
        assert 0.5 + ((f[1:] + f[:-1]) / 2).sum() * (x[1] - x[0]) == pytest.approx(0.9, abs=1e-6)
