"""Many small regressions at once: every statistic is a group aggregate over the regressions' keys."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isopleth.functions.prob import t_quantile
from isopleth.functions.scalar import corr, with_stats


def ols(pairs: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """(by, slope, intercept, r, resid_sd, n, xbar, sxx) of y on x; fewer than ``least`` pairs give no row. resid_sd has n - 2 in it."""
    ok = pairs.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    sse = F.regr_syy("y", "x") - F.try_divide(F.pow(F.regr_sxy("y", "x"), F.lit(2)), F.regr_sxx("y", "x"))
    out = ok.groupBy(*by).agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), corr("y", "x").alias("r"),
        F.sqrt(F.greatest(F.lit(0.0), sse) / F.greatest(F.lit(1), F.count("y") - 2)).alias("resid_sd"),
        F.count("y").alias("n"), F.avg("x").alias("xbar"), F.regr_sxx("y", "x").alias("sxx"),
    )
    return out.where(F.col("n") >= least)


def interval(fits: DataFrame, at: Column, level: float = 0.8) -> DataFrame:
    """fits with the prediction at a value of x, its leverage and the half-width of its interval (Student's t, n - 2)."""
    sizes = sorted(r[0] for r in fits.select("n").distinct().collect())  # distinct sample sizes, few
    table = F.create_map(*[F.lit(x) for n in sizes for x in (n, t_quantile(0.5 + level / 2, max(1, n - 2)))])
    lev = 1 / F.col("n") + F.pow(at - F.col("xbar"), F.lit(2)) / F.nullif(F.col("sxx"), F.lit(0.0))
    return fits.withColumns({"pred": F.col("intercept") + F.col("slope") * at, "leverage": lev, "half_width": table[F.col("n")] * F.col("resid_sd") * F.sqrt(1 + lev)})


def loyo(pairs: DataFrame, by: list[str]) -> DataFrame:
    """pairs with ``loo``, the prediction of each row by the fit to all others: y - e / (1 - h), no refit. Constant x gives null."""
    rows = with_stats(pairs, by, _n=F.count("y"), _mx=F.avg("x"), _my=F.avg("y"), _sxx=F.nullif(F.regr_sxx("y", "x"), F.lit(0.0)), _sxy=F.regr_sxy("y", "x"))
    d = F.col("x") - F.col("_mx")
    e = F.col("y") - (F.col("_my") + F.col("_sxy") / F.col("_sxx") * d)
    h = 1 / F.col("_n") + d * d / F.col("_sxx")
    return rows.withColumn("loo", F.col("y") - e / F.greatest(1 - h, F.lit(1e-12))).drop("_n", "_mx", "_my", "_sxx", "_sxy")


def loyo_skill(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, loo_r, loo_mse, loo_rmse, n): skill of the left-out predictions; constant x has an infinite error."""
    out = loyo(pairs, by).groupBy(*by).agg(corr("y", "loo").alias("loo_r"), F.avg(F.pow(F.col("y") - F.col("loo"), F.lit(2))).alias("mse"), F.count("y").alias("n"))
    return out.select(*by, "loo_r", F.coalesce("mse", F.lit(float("inf"))).alias("loo_mse"), F.sqrt("mse").alias("loo_rmse"), "n")


def detrend(rows: DataFrame, by: list[str], train: Column | None = None) -> DataFrame:
    """rows (t, v) with ``detrended``: v less the line fitted to the training rows (all, if none are named)."""
    y = F.col("v") if train is None else F.when(train, F.col("v"))
    out = with_stats(rows, by, _b=F.regr_slope(y, F.col("t")), _a=F.regr_intercept(y, F.col("t")))
    return out.withColumn("detrended", F.col("v") - (F.col("_a") + F.col("_b") * F.col("t"))).drop("_a", "_b")


def _training_line(pairs: DataFrame, by: list[str], train: Column) -> DataFrame:
    """pairs with the training rows' n_train, _mx, _my, _sxx (null if 0), _syy and _sxy."""
    x, y = F.when(train, F.col("x")), F.when(train, F.col("y"))
    return with_stats(pairs, by, n_train=F.regr_count(y, x), _mx=F.regr_avgx(y, x), _my=F.regr_avgy(y, x), _sxx=F.nullif(F.regr_sxx(y, x), F.lit(0.0)), _syy=F.regr_syy(y, x), _sxy=F.regr_sxy(y, x))


def split_fit(pairs: DataFrame, by: list[str], train: Column) -> DataFrame:
    """pairs with ``pred`` of the fit to the training rows and ``sigma``, the deviation of their left-out residuals (at least 1e-9)."""
    d = F.col("x") - F.col("_mx")
    fitted = _training_line(pairs, by, train).withColumns({"pred": F.col("_my") + F.col("_sxy") / F.col("_sxx") * d, "_h": 1 / F.col("n_train") + d * d / F.col("_sxx")})
    fitted = fitted.withColumn("_e", F.when(train, (F.col("y") - F.col("pred")) / F.greatest(1 - F.col("_h"), F.lit(1e-12))))
    return with_stats(fitted, by, sigma=F.greatest(F.stddev_pop("_e"), F.lit(1e-9))).drop("_mx", "_my", "_sxx", "_syy", "_sxy", "_h", "_e")


def grid_sigma(pairs: DataFrame, by: list[str], train: Column, least: int = 10) -> DataFrame:
    """As split_fit, with sigma of n - 2 degrees from the training residuals, and null (equal thirds) below ``least`` pairs or without spread."""
    rows = _training_line(pairs, by, train)
    n, sxx, syy, sxy = F.col("n_train"), F.col("_sxx"), F.col("_syy"), F.col("_sxy")
    good = (n >= least) & sxx.isNotNull()
    pred = F.col("_my") + sxy / sxx * (F.col("x") - F.col("_mx"))
    rows = rows.withColumns({"pred": F.when(good, pred), "sigma": F.when(good, F.sqrt(F.greatest(F.lit(0.0), syy - sxy * sxy / sxx) / F.greatest(n - 2, F.lit(1))))})
    return rows.drop("n_train", "_mx", "_my", "_sxx", "_syy", "_sxy")


def batched(features: DataFrame, targets: DataFrame, on: list[str]) -> DataFrame:
    """(feature, target, slope, r, resid_var, n) of every feature on every target: one join on the years, one aggregation of covariances."""
    rows = features.join(targets, on)
    return rows.groupBy("feature", "target").agg(F.regr_slope("y", "x").alias("slope"), corr("y", "x").alias("r"), ((F.regr_syy("y", "x") - F.try_divide(F.pow(F.regr_sxy("y", "x"), F.lit(2)), F.regr_sxx("y", "x"))) / F.count("y")).alias("resid_var"), F.count("y").alias("n"))


def _two_sums() -> dict[str, Column]:
    """Sums that the normal equations of y on x1 and x2 need: centred ones (by n), means and the count."""
    cov = {f"_{n}": F.covar_pop(a, b) for n, a, b in (("s11", "x1", "x1"), ("s22", "x2", "x2"), ("s12", "x1", "x2"), ("s1y", "x1", "y"), ("s2y", "x2", "y"), ("syy", "y", "y"))}
    return {**cov, "_m1": F.avg("x1"), "_m2": F.avg("x2"), "_my": F.avg("y"), "n": F.count("y")}


def _two_solved() -> dict[str, Column]:
    """Coefficients and (unscaled) variances of the sums' columns."""
    s11, s22, s12, s1y, s2y, syy = (F.col(f"_{c}") for c in ("s11", "s22", "s12", "s1y", "s2y", "syy"))
    det = F.nullif(s11 * s22 - s12 * s12, F.lit(0.0))
    b1, b2 = (s22 * s1y - s12 * s2y) / det, (s11 * s2y - s12 * s1y) / det
    sse = F.greatest(F.lit(0.0), F.col("n") * (syy - b1 * s1y - b2 * s2y))
    m1, m2 = F.col("_m1"), F.col("_m2")
    return {"b1": b1, "b2": b2, "b0": F.col("_my") - b1 * m1 - b2 * m2, "resid_sd": F.sqrt(sse / F.greatest(F.col("n") - 3, F.lit(1))), "_v1": s22 / (F.col("n") * det), "_v2": s11 / (F.col("n") * det), "_v0": 1 / F.col("n") + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / (F.col("n") * det), "_v12": -s12 / (F.col("n") * det)}


def two_predictor(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, b1, b2, b0, resid_sd, se1, se2, se0, n): y on x1 and x2 by the normal equations of group sums, n - 3 degrees. Rows with a missing value are left out."""
    ok = rows.where(F.col("x1").isNotNull() & F.col("x2").isNotNull() & F.col("y").isNotNull())
    s = ok.groupBy(*by).agg(*[c.alias(n) for n, c in _two_sums().items()]).withColumns(_two_solved())
    se = [(F.col("resid_sd") * F.sqrt(f"_v{k}")).alias(f"se{k}") for k in (1, 2, 0)]
    return s.select(*by, "b1", "b2", "b0", "resid_sd", *se, "n")


def tendency(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, year, y, loo): y on anchor and model change (x1, x2), each year predicted without itself by its leverage; an own fit per group.

    Without spread in both predictors loo is null.
    """
    ok = rows.where(F.col("x1").isNotNull() & F.col("x2").isNotNull() & F.col("y").isNotNull())
    fitted = with_stats(ok.select(*by, "year", "x1", "x2", "y"), by, **_two_sums()).withColumns(_two_solved())
    d1, d2 = F.col("x1") - F.col("_m1"), F.col("x2") - F.col("_m2")
    h = 1 / F.col("n") + d1 * d1 * F.col("_v1") + 2 * d1 * d2 * F.col("_v12") + d2 * d2 * F.col("_v2")
    e = F.col("y") - (F.col("b0") + F.col("b1") * F.col("x1") + F.col("b2") * F.col("x2"))
    return fitted.select(*by, "year", "y", (F.col("y") - e / F.greatest(1 - h, F.lit(1e-12))).alias("loo"))


def tendency_calibration(rows: DataFrame, now: DataFrame, by: list[str]) -> DataFrame:
    """(by, predicted, b_anchor, c_tendency, b_se, c_se, c_t, resid_sd, n, loyo_r, loyo_rmse): the forecast of ``now`` (by, x1, x2) by the fit to rows (by, year, x1, x2, y)."""
    fit = two_predictor(rows, by)
    left = tendency(rows, by).groupBy(*by).agg(corr("y", "loo").alias("loyo_r"), F.sqrt(F.avg(F.pow(F.col("y") - F.col("loo"), F.lit(2)))).alias("loyo_rmse"))
    out = fit.join(now.select(*by, "x1", "x2"), by).join(left, by)
    pred = F.col("b0") + F.col("b1") * F.col("x1") + F.col("b2") * F.col("x2")
    return out.select(*by, pred.alias("predicted"), F.col("b1").alias("b_anchor"), F.col("b2").alias("c_tendency"), F.col("se1").alias("b_se"), F.col("se2").alias("c_se"), F.try_divide("b2", "se2").alias("c_t"), "resid_sd", "n", "loyo_r", "loyo_rmse")


def calibrate_field(hindcast: DataFrame, forecast: DataFrame, by: list[str]) -> DataFrame:
    """(by, raw, calibrated, obs_climatology, slope, intercept, fit_r, loyo_r, n): observation on forecast at every cell and window, an own fit each.

    hindcast: (by, year, x, y); forecast: (by, raw).
    """
    fits = ols(hindcast, by)
    skill = loyo_skill(hindcast, by).select(*by, F.col("loo_r").alias("loyo_r"))
    mean = hindcast.groupBy(*by).agg(F.avg("y").alias("obs_climatology"))
    out = forecast.select(*by, "raw").join(fits, by).join(skill, by).join(mean, by)
    return out.select(*by, "raw", (F.col("intercept") + F.col("slope") * F.col("raw")).alias("calibrated"), "obs_climatology", "slope", "intercept", F.col("r").alias("fit_r"), "loyo_r", "n")


def projection(field: DataFrame, target: DataFrame) -> DataFrame:
    """(year, index): covariance-pattern projection of field (cell, year, v) on target (year, y), the pattern of each year made without it.

    Sums over all years, less a year's own term, give every pattern in one aggregation.
    """
    rows = with_stats(field.join(target, "year"), ["cell"], _n=F.count("v"), _sv=F.sum("v"), _sy=F.sum("y"), _svy=F.sum(F.col("v") * F.col("y")))
    m, rest = F.col("_n") - 1, (F.col("_sv") - F.col("v")) / (F.col("_n") - 1)
    cov = (F.col("_svy") - F.col("v") * F.col("y")) / m - rest * ((F.col("_sy") - F.col("y")) / m)
    return rows.withColumn("part", cov * (F.col("v") - rest)).groupBy("year").agg(F.sum("part").alias("index"))


def top_combo(rows: DataFrame, by: list[str], k: int = 2) -> DataFrame:
    """(by, loo_r, n): in each fold the k features (feature, x) most correlated with y, then least squares on them; left-out predictions' correlation."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.pivot_table(index="year", columns="feature", values="x").dropna()
        y = pdf.groupby("year")["y"].first().reindex(x.index).to_numpy()
        x = x.to_numpy()
        pred = np.full(len(y), np.nan)
        for i in range(len(y)):
            keep = np.arange(len(y)) != i
            r = np.nan_to_num([np.corrcoef(x[keep, j], y[keep])[0, 1] if x[keep, j].std() > 0 else 0.0 for j in range(x.shape[1])])
            best = np.argsort(-np.abs(r), kind="stable")[:k]
            a = np.column_stack([np.ones(keep.sum()), x[np.ix_(keep, best)]])
            pred[i] = np.r_[1.0, x[i, best]] @ np.linalg.lstsq(a, y[keep], rcond=None)[0]
        r = np.corrcoef(pred, y)[0, 1] if len(y) > 2 and pred.std() > 0 and y.std() > 0 else np.nan
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "loo_r": [r], "n": [len(y)]})

    keys = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c in by)
    return rows.groupBy(*by).applyInPandas(fit, f"{keys}, loo_r double, n int")


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Intercept and slope of y (0 or 1) on x by reweighted least squares, with a little shrinkage so that separable rows have a fit too."""
    a, b = np.column_stack([np.ones(len(x)), x]), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2), a.T @ (y - p) - 1e-2 * b)
        b += step
        if np.abs(step).max() < 1e-10:
            break
    return b


def logit_terciles(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, year, p0, p2): left-out logistic probabilities of the outer categories (obs 0 to 2) from x."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["x"].to_numpy()
        x = (x - x.mean()) / (x.std() or 1)
        out = pdf[[*by, "year"]].copy()
        for name, category in (("p0", 0), ("p2", 2)):
            y = (pdf["obs"].to_numpy() == category).astype(float)
            p = [1 / (1 + np.exp(-np.r_[1, x[i]] @ logistic(np.delete(x, i), np.delete(y, i)))) for i in range(len(x))]
            out[name] = p
        return out

    keys = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c in by)
    return rows.groupBy(*by).applyInPandas(fit, f"{keys}, year int, p0 double, p2 double")


def arma_likelihood(x: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(-2 log likelihood, variance of the shocks, next day's mean) of a zero-mean ARMA(1,1) for each of many parameter pairs.

    Exact, by the Kalman filter from the stationary state; the filter's variance settles after some days and is then held,
    which leaves a first-order recursion. Missing days (NaN) are stepped over.
    """
    n = len(x)
    p = (1 + 2 * phi * theta + theta * theta) / np.maximum(1 - phi * phi, 1e-9)  # of the state x[t], given nothing
    a, c = np.zeros_like(phi), np.full_like(phi, 1.0)  # forecast of x[t] and the part of its variance that is not the shock's
    f = p.copy()
    total, logs, seen = np.zeros_like(phi), np.zeros_like(phi), 0
    gain_state = np.zeros_like(phi)
    for t in range(n):
        if np.isnan(x[t]):
            a = phi * a if t else a
            f = np.minimum(phi * phi * f + (1 + 2 * phi * theta + theta * theta), p)
            continue
        v = x[t] - a
        total += v * v / f
        logs += np.log(f)
        seen += 1
        gain_state = (phi * f + theta) / f  # of the next state on this surprise
        a = phi * a + gain_state * v
        f = 1 + theta * theta * (1 - 1 / f) if np.any(f > 1 + 1e-10) else np.ones_like(f)
    sigma2 = total / max(seen, 1)
    return seen * np.log(np.maximum(sigma2, 1e-300)) + logs, sigma2, a


def arima(rows: DataFrame, by: list[str], horizon: int, least: int = 100) -> DataFrame:
    """(by, lead, forecast, phi, theta, sigma, converged): ARMA(1,1) by maximum likelihood on an anomaly series (t, v), then its forecasts.

    The mean is the series' own. Series with fewer than ``least`` values give none. The likelihood of all candidates of a
    search step is filtered at once; the steps halve until they are under 1e-4.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["v"]).sort_values("t")
        if len(pdf) < least:
            return pd.DataFrame({**{c: pdf[c].iloc[:0] for c in by}, "lead": [], "forecast": [], "phi": [], "theta": [], "sigma": [], "converged": []})
        t = pdf["t"].to_numpy()
        v = np.full(int(t[-1] - t[0]) + 1, np.nan)
        v[(t - t[0]).astype(int)] = pdf["v"].to_numpy()
        mean = np.nanmean(v)
        x = v - mean
        grid = np.linspace(-0.95, 0.95, 9)
        phi, theta = (g.ravel() for g in np.meshgrid(grid, grid))
        score = arma_likelihood(x, phi, theta)[0]
        best, least_score, step, rounds = (phi[score.argmin()], theta[score.argmin()]), score.min(), 0.12, 0
        offsets = np.array([(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)], float)
        while step > 1e-4 and rounds < 200:
            tried = np.clip(np.array(best) + step * offsets, -0.999, 0.999)
            score = arma_likelihood(x, tried[:, 0], tried[:, 1])[0]
            rounds += 1
            if score.min() < least_score - 1e-9:
                least_score, best = score.min(), tuple(tried[score.argmin()])
            else:
                step /= 2
        _, sigma2, now = arma_likelihood(x, np.array([best[0]]), np.array([best[1]]))
        lead = np.arange(1, horizon + 1)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * horizon for c in by}, "lead": lead, "forecast": mean + now[0] * best[0] ** (lead - 1), "phi": best[0], "theta": best[1], "sigma": float(np.sqrt(sigma2[0])), "converged": step <= 1e-4})

    keys = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c in by)
    return rows.groupBy(*by).applyInPandas(fit, f"{keys}, lead int, forecast double, phi double, theta double, sigma double, converged boolean")


def arima_windows(daily: DataFrame, inits: DataFrame, windows: DataFrame, by: list[str], cycle: Callable[[DataFrame, list[str]], DataFrame], least: int = 400, least_cycle: int = 3 * 365, prior_only: bool = True) -> DataFrame:
    """(by, init, window, pred, n, converged): statistical forecasts of lead windows from the observed series alone, day 1 being the init itself.

    daily: (by, date, v); inits: (init), a few dates; windows: (window, first_day, last_day). Each init sees only the days
    before it: its fit, of the anomalies, and its cycle (by, init, doy, clim), made by ``cycle`` from rows (by, init, date,
    doy, v) and put back on the forecast. With ``prior_only`` off the cycle is that of the whole record, which forecasts
    of past inits must not know. Inits with fewer days than the two bars are left out: arima_report() counts them.
    """
    keys = [*by, "init"]
    past = daily.join(F.broadcast(inits), F.col("date") < F.col("init")).withColumn("doy", F.dayofyear("date"))  # a few dates
    enough = past.where("v IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= (max(least, least_cycle) if prior_only else least))
    past = past.join(enough.select(*keys), keys, "left_semi")
    if prior_only:
        clim = cycle(past, keys)
    else:
        clim = cycle(daily.withColumn("doy", F.dayofyear("date")), by).join(enough.select(*keys), by)
    anomalies = past.join(clim, [*keys, "doy"]).select(*keys, F.datediff("date", F.lit("1970-01-01")).alias("t"), (F.col("v") - F.col("clim")).alias("v"))
    last = windows.agg(F.max("last_day")).first()[0]
    days = arima(anomalies, keys, last, least).withColumn("doy", F.dayofyear(F.date_add("init", F.col("lead") - 1)))
    absolute = days.join(clim, [*keys, "doy"]).select(*keys, "lead", (F.col("forecast") + F.col("clim")).alias("v"), "converged")
    spans = absolute.join(F.broadcast(windows), F.col("lead").between(F.col("first_day"), F.col("last_day")))
    out = spans.groupBy(*keys, "window", "first_day", "last_day").agg(F.avg("v").alias("pred"), F.count("*").alias("k"), F.bool_and("converged").alias("converged")).where("k = last_day - first_day + 1")
    return out.join(enough, keys).select(*keys, "window", "pred", "n", "converged")


def arima_report(daily: DataFrame, inits: DataFrame, pred: DataFrame, obs: DataFrame, by: list[str], least: int = 400, least_cycle: int = 3 * 365, prior_only: bool = True) -> DataFrame:
    """(by, init, status, converged): what became of each init of each series: scored, unobserved (no whole window), or why it was skipped.

    pred: of arima_windows(); obs: (by, init, window, obs).
    """
    keys = [*by, "init"]
    asked = daily.select(*by).distinct().crossJoin(F.broadcast(inits))  # a few dates
    past = daily.where("v IS NOT NULL").join(F.broadcast(inits), F.col("date") < F.col("init")).groupBy(*keys).agg(F.count("*").alias("n"))
    met = pred.join(obs, [*keys, "window"]).where("obs IS NOT NULL").select(*keys).distinct().withColumn("met", F.lit(True))
    fits = pred.groupBy(*keys).agg(F.bool_and("converged").alias("converged"))
    n = F.coalesce("n", F.lit(0))
    status = F.when(F.col("met"), "scored").when(n < least, "short series").when(F.lit(prior_only) & (n < least_cycle), "short cycle").when(F.col("converged").isNull(), "no forecast").otherwise("unobserved")
    return asked.join(past, keys, "left").join(fits, keys, "left").join(met, keys, "left").select(*keys, status.alias("status"), "converged")


def arima_against_model(pred: DataFrame, obs: DataFrame, model: DataFrame, by: list[str]) -> DataFrame:
    """(by, window, n, model_r, model_rmse, arima_r, arima_rmse, rmse_diff): both methods scored on the inits that both have.

    model: (by, window, init, x, y), all inits of the standing calibration: its fit leaves one init out of all of them, as in the
    forecast, but only the common ones are scored. pred and obs: as for arima_report().
    """
    keys = [*by, "window"]
    scored = pred.join(obs, [*keys, "init"]).where("pred IS NOT NULL AND obs IS NOT NULL").select(*keys, "init", "pred", "obs")
    left = loyo(model.where("x IS NOT NULL AND y IS NOT NULL"), keys).select(*keys, "init", F.col("loo").alias("m"), "y")
    rmse = lambda a, b: F.sqrt(F.avg(F.pow(F.col(a) - F.col(b), F.lit(2))))
    out = scored.join(left, [*keys, "init"]).groupBy(*keys).agg(F.count("*").alias("n"), corr("m", "y").alias("model_r"), rmse("m", "y").alias("model_rmse"), corr("pred", "obs").alias("arima_r"), rmse("pred", "obs").alias("arima_rmse"))
    return out.withColumn("rmse_diff", F.col("arima_rmse") - F.col("model_rmse"))


def arima_dipole(pred: DataFrame, obs: DataFrame, west: str, east: str, by: str = "cell") -> DataFrame:
    """(init, window, west, east, dipole): forecasts as departures from the mean of the same calendar window of the other inits' years, and the difference of two series.

    The cycle that arima_windows() puts back is smoothed over days; the tables' anomalies are against the window's own mean,
    so both poles are put on that baseline before they are subtracted.
    """
    clim = obs.where("obs IS NOT NULL").groupBy(by, "window").agg(F.avg("obs").alias("clim"))
    rows = pred.join(clim, [by, "window"]).select(by, "init", "window", (F.col("pred") - F.col("clim")).alias("a"))
    w, e = (F.max(F.when(F.col(by) == pole, F.col("a"))) for pole in (west, east))
    out = rows.where(F.col(by).isin(west, east)).groupBy("init", "window").agg(w.alias("west"), e.alias("east"))
    return out.where("west IS NOT NULL AND east IS NOT NULL").withColumn("dipole", F.col("west") - F.col("east"))


def window_skill(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, r, rmse, bias, n) of pred against obs."""
    e = F.col("pred") - F.col("obs")
    return pairs.where("pred IS NOT NULL AND obs IS NOT NULL").groupBy(*by).agg(corr("pred", "obs").alias("r"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.count("*").alias("n"))
