"""Queries over regressions, scores, inference, zones and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isopleth.functions import prob
from isopleth.functions.scalar import corr, r4, settled, with_stats
from isopleth.operators import atlas, cube, discovery, inference, regress, rolling, search, text
from isopleth.sources.panels import cells, day_panel, month_panel, table, week_panel

from .base import R, query

#: Pairs of the week panel: y of a cell, x of the next cell in the same week.
PAIRS = "pairs AS (SELECT a.cell, a.period AS year, b.v AS x, a.v AS y FROM pw a JOIN pw b ON b.cell = (a.cell + 1) % 25 AND b.period = a.period)"
LOO = f"{PAIRS}, s AS (SELECT cell, count(*) AS n, avg(x) AS mx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, nullif(regr_sxx(y, x), 0) AS sxx FROM pairs GROUP BY cell), loo AS (SELECT cell, year, x, y, y - (y - a - b * x) / greatest(1 - 1e0 / n - (x - mx) * (x - mx) / sxx, 1e-12) AS loo FROM pairs JOIN s USING (cell))"


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    w = week_panel(spark, sf)
    x = w.select(F.pmod(F.col("cell") - 1, F.lit(25)).alias("cell"), "period", F.col("v").alias("x"))
    return w.join(x, ["cell", "period"]).select("cell", F.col("period").alias("year"), "x", F.col("v").alias("y"))


def places(spark: SparkSession, sf: str) -> DataFrame:
    """(place): all weeks of the panel, for draws and donors over all of it."""
    return week_panel(spark, sf).select(F.col("period").alias("place")).distinct()


def whole_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Walk-forward folds over all weeks: the first half trains only, then come blocks of ten, the last one cut by the end."""
    last = week_panel(spark, sf).agg(F.max("period")).first()[0]
    n = 0 if last is None else last + 1
    return atlas.folds(spark, [(list(range(a)), list(range(a, min(a + 10, n)))) for a in range(max(1, n // 2), n, 10)])


def rounded(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.select(*keys, *[r4(F.col(v)).alias(v) for v in values])


@query("r1_ols", f"WITH {PAIRS} SELECT cell, {R('regr_slope(y, x)')} AS slope, {R('regr_intercept(y, x)')} AS intercept, {R('corr(y, x)')} AS r, {R('sqrt(greatest(0, regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x)) / (count(*) - 2))')} AS resid_sd, count(*) AS n FROM pairs GROUP BY cell HAVING count(*) >= 3", "pw")
def r1(spark, sf):
    return rounded(regress.ols(pairs(spark, sf), ["cell"]), ["cell", "n"], ["slope", "intercept", "r", "resid_sd"])


@query("r3_loyo_predictions", f"WITH {LOO} SELECT cell, year, {R('loo')} AS loo FROM loo", "pw")
def r3(spark, sf):
    return rounded(regress.loyo(pairs(spark, sf), ["cell"]), ["cell", "year"], ["loo"])


@query("r4_loyo_skill", f"WITH {LOO} SELECT cell, {R('corr(y, loo)')} AS loo_r, {R('avg((y - loo) * (y - loo))')} AS loo_mse, {R('sqrt(avg((y - loo) * (y - loo)))')} AS loo_rmse, count(*) AS n FROM loo GROUP BY cell", "pw")
def r4_(spark, sf):
    return rounded(regress.loyo_skill(pairs(spark, sf), ["cell"]), ["cell", "n"], ["loo_r", "loo_mse", "loo_rmse"])


@query("r5_split_fit", f"""WITH {PAIRS}, s AS (SELECT cell, count(*) AS n, avg(x) AS mx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx FROM pairs WHERE year < 200 GROUP BY cell),
e AS (SELECT cell, greatest(stddev_pop((y - a - b * x) / greatest(1 - 1e0 / n - (x - mx) * (x - mx) / sxx, 1e-12)), 1e-9) AS sigma FROM pairs JOIN s USING (cell) WHERE year < 200 GROUP BY cell)
SELECT cell, year, {R('a + b * x')} AS pred, {R('sigma')} AS sigma, n AS n_train FROM pairs JOIN s USING (cell) JOIN e USING (cell) WHERE year >= 200""", "pw")  # fmt: skip
def r5(spark, sf):
    return rounded(regress.split_fit(pairs(spark, sf), ["cell"], F.col("year") < 200).where("year >= 200"), ["cell", "year", "n_train"], ["pred", "sigma"])


@query("r6_grid_sigma", f"""WITH {PAIRS}, s AS (SELECT cell, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, sqrt(greatest(0, regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x)) / (count(*) - 2)) AS sigma FROM pairs WHERE year < 200 GROUP BY cell)
SELECT cell, year, CASE WHEN n >= 10 THEN {R('a + b * x')} END AS pred, CASE WHEN n >= 10 THEN {R('sigma')} END AS sigma FROM pairs JOIN s USING (cell)""", "pw")  # fmt: skip
def r6(spark, sf):
    return rounded(regress.grid_sigma(pairs(spark, sf), ["cell"], F.col("year") < 200), ["cell", "year"], ["pred", "sigma"])


@query("r7_batched_features", f"SELECT a.cell AS feature, b.cell AS target, {R('regr_slope(b.v, a.v)')} AS slope, {R('corr(b.v, a.v)')} AS r, {R('(regr_syy(b.v, a.v) - regr_sxy(b.v, a.v) ** 2 / regr_sxx(b.v, a.v)) / count(*)')} AS resid_var, count(*) AS n FROM pw a JOIN pw b ON a.period = b.period GROUP BY 1, 2", "pw")
def r7(spark, sf):
    w = week_panel(spark, sf)
    out = regress.batched(w.select(F.col("cell").alias("feature"), "period", F.col("v").alias("x")), w.select(F.col("cell").alias("target"), "period", F.col("v").alias("y")), ["period"])
    return rounded(out, ["feature", "target", "n"], ["slope", "r", "resid_var"])


@query("r8_detrend", f"WITH s AS (SELECT cell, regr_slope(v, period) AS b, regr_intercept(v, period) AS a FROM pw WHERE period < 200 GROUP BY cell) SELECT cell, period, {R('v - a - b * period')} AS detrended FROM pw JOIN s USING (cell)", "pw")
def r8(spark, sf):
    return rounded(regress.detrend(week_panel(spark, sf).withColumn("t", F.col("period")), ["cell"], F.col("period") < 200), ["cell", "period"], ["detrended"])


HIND = "hind AS (SELECT cell, day AS year, avg(v) FILTER (member < 5) AS x, avg(v) FILTER (member >= 5) AS y FROM pd WHERE day <= 25 GROUP BY 1, 2 HAVING x IS NOT NULL AND y IS NOT NULL)"


@query("r42_dispersion", f"WITH {HIND} SELECT cell, {R('stddev_samp(x) / nullif(stddev_samp(y), 0)')} AS sd_ratio, {R('corr(x, y) * stddev_samp(y) / nullif(stddev_samp(x), 0)')} AS implied_slope FROM hind GROUP BY cell", "pd")
def r42(spark, sf):
    halves = day_panel(spark, sf).where("day <= 25").groupBy("cell", "day").agg(F.avg(F.when(F.col("member") < 5, F.col("v"))).alias("x"), F.avg(F.when(F.col("member") >= 5, F.col("v"))).alias("y")).dropna()
    return rounded(rolling.dispersion(halves, ["cell"]), ["cell"], ["sd_ratio", "implied_slope"])


@query("j14_a24_verification", f"""WITH o AS (SELECT cell, day AS init, avg(v) AS obs FROM pd GROUP BY 1, 2), i AS (SELECT cell, init, lag(obs) OVER (PARTITION BY cell ORDER BY init) AS cal FROM o)
SELECT cell, {R("avg((abs(cal - obs) <= 1)::INT::DOUBLE)")} AS coverage, count(*) AS n, {R('avg(abs(cal - obs))')} AS mean_abs_over_ci FROM o JOIN i USING (cell, init) WHERE cal IS NOT NULL GROUP BY cell""", "pd")  # fmt: skip
def j14(spark, sf):
    o = day_panel(spark, sf).groupBy(F.col("cell").alias("window"), F.col("day").alias("init")).agg(F.avg("v").alias("v"))
    issued = o.select("window", "init", F.lag("v").over(Window.partitionBy("window").orderBy("init")).alias("calibrated"), F.lit(0.0).alias("anomaly"), F.lit(1.0).alias("ci"), F.lit(None).cast("double").alias("obs_clim")).where("calibrated IS NOT NULL")
    out = rolling.interval_coverage(rolling.verify(issued, o), ["window"]).withColumnRenamed("window", "cell")
    return rounded(out, ["cell", "n"], ["coverage", "mean_abs_over_ci"])


@query("r15_projection", f"""WITH t AS (SELECT period, sum(v) AS y FROM pw GROUP BY 1), r AS (SELECT pw.cell, pw.period, v, y FROM pw JOIN t USING (period)),
s AS (SELECT *, count(*) OVER w AS n, sum(v) OVER w AS sv, sum(y) OVER w AS sy, sum(v * y) OVER w AS svy FROM r WINDOW w AS (PARTITION BY cell))
SELECT period AS year, {R('sum(((svy - v * y) / (n - 1) - (sv - v) / (n - 1) * ((sy - y) / (n - 1))) * (v - (sv - v) / (n - 1)))')} AS "index" FROM s GROUP BY period""", "pw")  # fmt: skip
def r15(spark, sf):
    f = week_panel(spark, sf).withColumnRenamed("period", "year")
    return rounded(regress.projection(f, f.groupBy("year").agg(F.sum("v").alias("y"))), ["year"], ["index"])


@query("r17_r18_correlation_map", f"WITH t AS (SELECT period, sum(v) AS y FROM pw GROUP BY 1) SELECT cell, CASE WHEN count(*) >= 8 THEN {R('corr(v, y)')} END AS r FROM pw JOIN t USING (period) GROUP BY cell", "pw")
def r17(spark, sf):
    w = week_panel(spark, sf)
    t = w.groupBy("period").agg(F.sum("v").alias("y"))
    return w.join(t, "period").groupBy("cell").agg(F.when(F.count("*") >= 8, r4(corr("v", "y"))).alias("r"))


@query("r19_w3_spearman", f"""WITH {PAIRS}, k AS (SELECT cell, rank() OVER (PARTITION BY cell ORDER BY x) + (count(*) OVER (PARTITION BY cell, x) - 1) / 2e0 AS rx, rank() OVER (PARTITION BY cell ORDER BY y) + (count(*) OVER (PARTITION BY cell, y) - 1) / 2e0 AS ry FROM pairs)
SELECT cell, {R('corr(rx, ry)')} AS rho, count(*) AS n FROM k GROUP BY cell""", "pw")  # fmt: skip
def r19(spark, sf):
    return rounded(inference.spearman(pairs(spark, sf), ["cell"]), ["cell", "n"], ["rho"])


@query("r20_auc_average_ties", f"""WITH s AS (SELECT lang, n_chars, quality FROM documents JOIN labels USING (doc_id)), k AS (SELECT lang, quality, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2e0 AS r FROM s)
SELECT lang, {R('(sum(r * quality) - sum(quality) * (sum(quality) + 1) / 2e0) / nullif(sum(quality) * sum(1 - quality), 0)')} AS auc, sum(quality)::BIGINT AS n_pos, sum(1 - quality)::BIGINT AS n_neg FROM k GROUP BY lang""")  # fmt: skip
def r20(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return rounded(inference.auc(s, ["lang"], "n_chars", F.col("quality") == 1), ["lang", "n_pos", "n_neg"], ["auc"])


@query("r20_w2_auc_ordinal_ties", f"""WITH s AS (SELECT doc_id, lang, n_chars, quality FROM documents JOIN labels USING (doc_id)), k AS (SELECT lang, quality, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS r FROM s)
SELECT lang, {R('(sum(r * quality) - sum(quality) * (sum(quality) + 1) / 2e0) / nullif(sum(quality) * sum(1 - quality), 0)')} AS auc, sum(quality)::BIGINT AS n_pos, sum(1 - quality)::BIGINT AS n_neg FROM k GROUP BY lang""")  # fmt: skip
def r20b(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return rounded(inference.auc(s, ["lang"], "n_chars", F.col("quality") == 1, "doc_id"), ["lang", "n_pos", "n_neg"], ["auc"])


GROC = """{b}, k AS (SELECT b.*, p.lo, p.hi, (c = p.hi)::INT AS up, rank() OVER w + (count(*) OVER (PARTITION BY {g}, p.lo, p.hi, s) - 1) / 2e0 AS r FROM b JOIN (VALUES (0, 1), (0, 2), (1, 2)) p(lo, hi) ON c IN (p.lo, p.hi) WINDOW w AS (PARTITION BY {g}, p.lo, p.hi ORDER BY s)),
a AS (SELECT {g}, sum(r) FILTER (up = 1) - sum(up) * (sum(up) + 1) / 2e0 AS u, sum(up) * sum(1 - up) AS n FROM k GROUP BY {g}, lo, hi), groc AS (SELECT {g}, sum(u) / sum(n) AS groc FROM a WHERE n > 0 GROUP BY {g})"""


@query("groc_three_categories", "WITH " + GROC.format(g="g", b="b AS (SELECT o_orderpriority AS g, o_totalprice AS s, (o_orderkey % 3)::INT AS c FROM orders)") + f" SELECT g, {R('groc')} AS groc FROM groc")
def groc(spark, sf):
    s = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("g"), F.col("o_totalprice").alias("s"), (F.col("o_orderkey") % 3).alias("c"))
    return rounded(inference.groc(s, ["g"], "s", "c"), ["g"], ["groc"])


P1, P2 = prob.normal_cdf_sql("((t33 - 0.9e0 * y) / s)"), prob.normal_cdf_sql("((t67 - 0.9e0 * y) / s)")
EDGE = "e AS (SELECT cell, period, v AS y, quantile_cont(v, 1e0/3) OVER w AS t33, quantile_cont(v, 2e0/3) OVER w AS t67, stddev_pop(v) OVER w AS s FROM pw WINDOW w AS (PARTITION BY cell))"
SCORED = f"""WITH {EDGE}, c AS (SELECT *, {P1} AS c1, {P2} AS c2 FROM e), q AS (SELECT *, least(1, greatest(1e-9, c1)) AS a, least(1, greatest(1e-9, c2 - c1)) AS b, least(1, greatest(1e-9, 1 - c2)) AS d, CASE WHEN t33 > y THEN 0 WHEN t67 > y THEN 1 ELSE 2 END AS obs FROM c),
n AS (SELECT cell, period, obs, a / (a + b + d) AS p0, b / (a + b + d) AS p1 FROM q), r AS (SELECT *, 5e-1 * ((p0 - (obs <= 0)::INT) ** 2 + (p0 + p1 - (obs <= 1)::INT) ** 2) AS rf, 5e-1 * ((1e0/3 - (obs <= 0)::INT) ** 2 + (2e0/3 - (obs <= 1)::INT) ** 2) AS rc FROM n)"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    e = week_panel(spark, sf).select("cell", "period", F.col("v").alias("y"))
    e = with_stats(e, ["cell"], t33=F.percentile("y", F.lit(1 / 3)), t67=F.percentile("y", F.lit(2 / 3)), s=F.stddev_pop("y"))
    e = prob.with_terciles(e, 0.9 * F.col("y"), F.col("s"), F.col("t33"), F.col("t67"))
    q = e.select("cell", "period", "p", prob.tercile(F.col("y"), F.col("t33"), F.col("t67")).alias("obs"))
    third = F.lit(1 / 3)
    return q.select("*", prob.rps(F.get("p", F.lit(0)), F.get("p", F.lit(1)), F.col("obs")).alias("rps_f"), prob.rps(third, third, F.col("obs")).alias("rps_c"), F.lit(1.0).alias("weight"))


@query("m2_m4_m5_tercile_probabilities", f"{SCORED} SELECT cell, period, {R('p0')} AS p0, {R('p1')} AS p1, obs FROM r", "pw")
def m2(spark, sf):
    return scored(spark, sf).select("cell", "period", r4(F.get("p", F.lit(0))).alias("p0"), r4(F.get("p", F.lit(1))).alias("p1"), "obs")


@query("a14_r21_pooled_rpss", f"{SCORED} SELECT cell, {R('1 - sum(rf) / sum(rc)')} AS rpss, count(*) AS n FROM r GROUP BY cell", "pw")
def a14(spark, sf):
    return rounded(atlas.METRICS["rpss"](scored(spark, sf), ["cell"]), ["cell", "n"], ["rpss"])


@query("a16_fold_summary", f"{SCORED}, f AS (SELECT cell, period // 60 AS fold, 1 - sum(rf) / sum(rc) AS s FROM r GROUP BY 1, 2) SELECT cell, {R('avg(s)')} AS mean, {R('stddev_pop(s)')} AS std, {R('min(s)')} AS min, {R('max(s)')} AS max FROM f GROUP BY cell", "pw")
def a16(spark, sf):
    s = scored(spark, sf).withColumn("fold", F.floor(F.col("period") / 60))
    return rounded(atlas.fold_summary(s, ["cell"]), ["cell"], ["mean", "std", "min", "max"])


@query("r22_hit_rate", f"{SCORED} SELECT cell, {R('avg((CASE WHEN p0 >= p1 AND p0 >= 1 - p0 - p1 THEN 0 WHEN p1 >= 1 - p0 - p1 THEN 1 ELSE 2 END = obs)::INT::DOUBLE)')} AS hit_rate, count(*) AS n FROM r GROUP BY cell", "pw")
def r22(spark, sf):
    return rounded(atlas.METRICS["hit_rate"](scored(spark, sf), ["cell"]), ["cell", "n"], ["hit_rate"])


@query("u5_g19_families", f"{SCORED} SELECT 'early' AS family, {R('1 - sum(rf) / sum(rc)')} AS rpss, count(*) AS n FROM r WHERE period < 150 UNION ALL SELECT 'all', {R('1 - sum(rf) / sum(rc)')}, count(*) FROM r", "pw")
def u5(spark, sf):
    return rounded(atlas.families(scored(spark, sf), [], {"early": F.col("period") < 150, "all": F.lit(True)}), ["family", "n"], ["rpss"])


@query("r23_anomaly_pearson", f"WITH {PAIRS}, d AS (SELECT x - avg(x) OVER (PARTITION BY cell) AS x, y - avg(y) OVER (PARTITION BY cell) AS y FROM pairs) SELECT {R('corr(x, y)')} AS r FROM d", "pw")
def r23(spark, sf):
    w = Window.partitionBy("cell")
    d = pairs(spark, sf).select((F.col("x") - F.avg("x").over(w)).alias("x"), (F.col("y") - F.avg("y").over(w)).alias("y"))
    return d.agg(r4(corr("x", "y")).alias("r"))


@query("r25_williams", f"""WITH t AS (SELECT a.cell, corr(a.v, b.v) AS r1, corr(a.v, c.v) AS r2, corr(b.v, c.v) AS r12, count(*) AS n FROM pw a JOIN pw b ON b.cell = (a.cell + 1) % 25 AND b.period = a.period JOIN pw c ON c.cell = (a.cell + 2) % 25 AND c.period = a.period GROUP BY a.cell)
SELECT cell, {R('(r1 - r2) * sqrt((n - 1) * (1 + r12) / (2e0 * (n - 1) / (n - 3) * (1 - r1*r1 - r2*r2 - r12*r12 + 2*r1*r2*r12) + ((r1 + r2) / 2) ** 2 * (1 - r12) ** 3))')} AS t FROM t WHERE n >= 5""", "pw")  # fmt: skip
def r25(spark, sf):
    w = week_panel(spark, sf)
    shifted = lambda k, name: w.select(F.pmod(F.col("cell") - k, F.lit(25)).alias("cell"), "period", F.col("v").alias(name))
    rows = w.join(shifted(1, "x1"), ["cell", "period"]).join(shifted(2, "x2"), ["cell", "period"])
    r = rows.groupBy("cell").agg(corr("v", "x1").alias("r1"), corr("v", "x2").alias("r2"), corr("x1", "x2").alias("r12"), F.count("*").alias("n")).where("n >= 5")
    return rounded(inference.williams(r), ["cell"], ["t"])


@query("r46_logit_terciles")
def r46(spark, sf):
    p = pairs(spark, sf).join(scored(spark, sf).select("cell", F.col("period").alias("year"), "obs"), ["cell", "year"])
    return rounded(regress.logit_terciles(p, ["cell"]), ["cell", "year"], ["p0", "p2"])


@query("r45_useful_lead", f"WITH c AS (SELECT cell, month AS lead, max(v) AS best FROM pm GROUP BY 1, 2) SELECT cell, max(lead) FILTER (best >= 2) AS useful_lead FROM c GROUP BY cell", "pm")
def r45(spark, sf):
    c = search.lead_curve(month_panel(spark, sf).withColumnRenamed("month", "lead"), ["cell"], "v")
    return search.useful_lead(c, ["cell"], 2.0)


@query("a15_coverage", f"SELECT month % 2 AS fam, {R('count(DISTINCT (year, cell)) * 0.5e0 / 7')} AS coverage FROM pm GROUP BY 1", "pm")
def a15(spark, sf):
    s = month_panel(spark, sf).select((F.col("month") % 2).alias("fam"), F.col("year").alias("fold"), F.col("cell").alias("zone"), F.lit("w").alias("window"), F.lit(0.5).alias("weight"))
    return rounded(atlas.coverage(s, ["fam"], 7), ["fam"], ["coverage"])


@query("g8_select_k", "SELECT cell, coalesce(max(month) FILTER (v >= 3), arg_max(month, (v, -month))) AS k FROM (SELECT cell, month, max(v) AS v FROM pm GROUP BY 1, 2) GROUP BY cell", "pm")
def g8(spark, sf):
    curve = month_panel(spark, sf).groupBy("cell", F.col("month").alias("k")).agg(F.max("v").alias("ari"))
    return discovery.select_k(curve, ["cell"], 3.0)


@query("g9_adjusted_rand", f"""WITH p AS (SELECT label AS a, (vec_id % 7)::INT AS b FROM embeddings), t AS (SELECT a, b, count(*)::DOUBLE AS n FROM p GROUP BY 1, 2), x AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS n FROM t),
ra AS (SELECT sum(n * (n - 1) / 2) AS sa FROM (SELECT sum(n) AS n FROM t GROUP BY a)), rb AS (SELECT sum(n * (n - 1) / 2) AS sb FROM (SELECT sum(n) AS n FROM t GROUP BY b))
SELECT 0 AS g, {R('(s - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2))', 6)} AS ari FROM x, ra, rb""")  # fmt: skip
def g9(spark, sf):
    p = table(spark, sf, "embeddings").select(F.lit(0).alias("g"), F.col("label").alias("a"), (F.col("vec_id") % 7).cast("int").alias("b"))
    return discovery.adjusted_rand(p, ["g"]).select("g", r4(F.col("ari"), 6).alias("ari"))


@query("g15_eta_squared", f"""WITH e AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT *, avg(v) OVER (PARTITION BY dim) AS m, avg(v) OVER (PARTITION BY dim, label) AS gm FROM e)
SELECT dim::INT AS dim, {R('sum((gm - m) ** 2) / sum((v - m) ** 2)')} AS eta2 FROM m GROUP BY dim""")  # fmt: skip
def g15(spark, sf):
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v")).withColumn("v", F.col("v").cast("double"))
    return rounded(discovery.eta_squared(e, ["dim"], "label", "v"), ["dim"], ["eta2"])


@query("g2_gram", f"""WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS c, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT x.c::INT AS a, y.c::INT AS b, {R('sum(x.v * y.v)')} AS g FROM e x JOIN e y ON x.vec_id = y.vec_id AND x.c <= y.c GROUP BY 1, 2""")  # fmt: skip
def g2(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("cell"), F.posexplode("embedding").alias("col", "v")).withColumn("v", F.col("v").cast("double"))
    return rounded(discovery.gram(e), ["a", "b"], ["g"])


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    """(fold, cell, zone): the quarter of each cell's largest month, a fold a year."""
    return month_panel(spark, sf).groupBy(F.col("year").alias("fold"), "cell").agg(F.floor((F.max_by("month", F.struct("v", -F.col("month"))) - 1) / 3).cast("int").alias("zone"))


PARTS = "parts AS (SELECT year AS fold, cell, ((month - 1) // 3)::INT AS zone FROM pm QUALIFY row_number() OVER (PARTITION BY year, cell ORDER BY v DESC, month) = 1)"


@query("g12_switch_map", f"WITH {PARTS} SELECT a.cell, {R('avg((a.zone <> b.zone)::INT::DOUBLE)')} AS share FROM parts a JOIN parts b ON a.cell = b.cell AND a.fold < b.fold GROUP BY 1", "pm")
def g12(spark, sf):
    return rounded(discovery.switch_map(_parts(spark, sf)), ["cell"], ["share"])


@query("g14_jaccard", f"WITH {PARTS}, b AS (SELECT x.zone, x.fold AS fold_a, y.fold AS fold_b, count(*) AS n FROM parts x JOIN parts y ON x.zone = y.zone AND x.cell = y.cell AND x.fold < y.fold GROUP BY 1, 2, 3), s AS (SELECT fold, zone, count(*) AS n FROM parts GROUP BY 1, 2) SELECT b.zone, fold_a, fold_b, {R('b.n / (p.n + q.n - b.n)::DOUBLE')} AS jaccard FROM b JOIN s p ON p.fold = fold_a AND p.zone = b.zone JOIN s q ON q.fold = fold_b AND q.zone = b.zone", "pm")
def g14(spark, sf):
    return rounded(discovery.jaccard(_parts(spark, sf)), ["zone", "fold_a", "fold_b"], ["jaccard"])


LINKS = r"""regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)"""


@query("x1_links", f"SELECT page_id, href, min(pos - 1)::INT AS pos FROM (SELECT page_id, unnest({LINKS}) AS href, generate_subscripts({LINKS}, 1) AS pos FROM pages) GROUP BY page_id, href")
def x1(spark, sf):
    return text.links(table(spark, sf, "pages"))


@query("x3_titles", "SELECT page_id, replace(replace(replace(replace(replace(trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&') AS title FROM pages")
def x3(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.title(F.col("html")).alias("title"))


@query("x2_markdown")
def x2(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.markdown(F.col("html")).alias("markdown"))


@query("x4_word_counts", r"SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 0 ELSE len(string_split_regex(trim(text), '\s+')) END::INT AS words FROM documents")
def x4(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.words(F.coalesce("text", F.lit(""))).cast("int").alias("words"))


@query("t2_revision_overlay", f"SELECT cell, day, {R('avg(v) + CASE WHEN day > 16 THEN 1 ELSE 0 END')} AS v FROM pd GROUP BY cell, day", "pd")
def t2(spark, sf):
    d = day_panel(spark, sf).groupBy("cell", "day").agg(F.avg("v").alias("v"))
    out = rolling.revised(d, d.withColumn("v", F.col("v") + 1), ["cell", "day"], F.col("day") > 16)
    return out.select("cell", "day", r4(settled(F.col("v"))).alias("v"))


@query("r36_holdout", f"WITH {PAIRS}, s AS (SELECT cell, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, corr(x, y) AS train_r FROM pairs WHERE year < 200 GROUP BY cell) SELECT cell, {R('train_r')} AS train_r, {R('corr(a + b * x, y)')} AS oos_r, count(*) AS n_test FROM pairs JOIN s USING (cell) WHERE year >= 200 GROUP BY cell, train_r", "pw")
def r36(spark, sf):
    f = regress.split_fit(pairs(spark, sf), ["cell"], F.col("year") < 200)
    return f.groupBy("cell").agg(r4(corr(F.when(F.col("year") < 200, F.col("x")), F.col("y"))).alias("train_r"), r4(corr(F.when(F.col("year") >= 200, F.col("pred")), F.col("y"))).alias("oos_r"), F.count_if(F.col("year") >= 200).alias("n_test"))
