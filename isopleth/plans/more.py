"""Further queries: conditions, candidates, benchmarks, streams, scans and maps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from isopleth.functions import sqlnames
from isopleth.functions.calendar import lead_windows
from isopleth.functions.scalar import clean, corr, kelvin_to_celsius, physical, r4
from isopleth.operators import atlas, benchmarks, candidates, cube, discovery, downscale, inference, regress, rolling, search
from isopleth.sources import io
from isopleth.sources.panels import cells, day_panel, month_panel, table, week_panel
from isopleth.streaming import issuance

from .base import R, query
from .stats import PAIRS, pairs, places, rounded, whole_folds


@query("f4_f5_f7_filters", f"SELECT cell, year, {R('sum(v)')} AS v FROM pm WHERE month IN (3, 4, 5) AND year BETWEEN 1996 AND 1999 AND cell IN (SELECT cell FROM dim WHERE lat > 0) GROUP BY 1, 2", "dim pm")
def f4(spark, sf):
    zone = cells(spark).where("lat > 0").select("cell")
    rows = month_panel(spark, sf).where(F.col("month").isin(3, 4, 5) & F.col("year").between(1996, 1999)).join(F.broadcast(zone), "cell", "left_semi")
    return rounded(rows.groupBy("cell", "year").agg(F.sum("v").alias("v")), ["cell", "year"], ["v"])


@query("f9_m10_m15_physical_values", f"SELECT event_id, CASE WHEN value + 273.15e0 < 280 THEN {R('value')} END AS c FROM events")
def f9(spark, sf):
    k = physical(clean(F.col("value") + 273.15), 280.0)
    return table(spark, sf, "events").select("event_id", r4(kelvin_to_celsius(k)).alias("c"))


@query("f12_j1_j3_finite_pairs", f"WITH {PAIRS} SELECT cell, year, {R('x')} AS x, {R('y')} AS y FROM pairs WHERE x IS NOT NULL AND y IS NOT NULL AND year IN (SELECT period FROM pw WHERE cell = 0)", "pw")
def f12(spark, sf):
    have = week_panel(spark, sf).where("cell = 0").select(F.col("period").alias("year"))
    return rounded(pairs(spark, sf).where("x IS NOT NULL AND y IS NOT NULL").join(have, "year", "left_semi"), ["cell", "year"], ["x", "y"])


@query("f14_flags", f"""WITH z AS (SELECT cell, period, (v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0) AS z, quantile_cont(v, 2e0/3) OVER w AS q, v FROM pw WINDOW w AS (PARTITION BY cell))
SELECT cell, count(*) FILTER (z < -0.5e0) AS cold, count(*) FILTER (v > q) AS strong, CASE WHEN count(*) FILTER (z < 0 AND v > q - 0.01e0) >= 3 THEN count(*) FILTER (z < 0 AND v > q - 0.01e0) END AS joint FROM z GROUP BY cell""", "pw")  # fmt: skip
def f14(spark, sf):
    w = Window.partitionBy("cell")
    z = cube.zscore(week_panel(spark, sf), ["cell"]).withColumn("q", F.percentile("v", F.lit(2 / 3)).over(w))
    joint = F.count_if((F.col("z") < 0) & (F.col("v") > F.col("q") - 0.01))
    return z.groupBy("cell").agg(F.count_if(F.col("z") < -0.5).alias("cold"), F.count_if(F.col("v") > F.col("q")).alias("strong"), F.when(joint >= 3, joint).alias("joint"))


@query("a7_preseason_field", f"SELECT cell, year AS season_year, {R('avg(v)')} AS x FROM pm WHERE month IN (7, 8, 9) GROUP BY 1, 2", "pm")
def a7(spark, sf):
    years = month_panel(spark, sf).select(F.col("year").alias("season_year")).distinct()
    return rounded(cube.preseason_mean(month_panel(spark, sf), years, [10, 11, 12], 0, 3, ["cell"], strict=False), ["cell", "season_year"], ["x"])


@query("a11_observed_windows", f"SELECT 'week1' AS \"window\", {R('avg(v)')} AS v FROM pd WHERE day BETWEEN 1 AND 7 UNION ALL SELECT 'week3', {R('avg(v)')} FROM pd WHERE day BETWEEN 15 AND 21", "pd")
def a11(spark, sf):
    d = day_panel(spark, sf).withColumn("all", F.lit(1))
    return rounded(rolling.lead_window_mean(d, lead_windows(spark).where(F.col("window").isin("week1", "week3")), ["all"]), ["window"], ["v"])


@query("a21_uniqueness", "SELECT count(DISTINCT (cell, year, month)) AS n_keys, count(*) AS n FROM pm", "pm")
def a21(spark, sf):
    return month_panel(spark, sf).agg(F.count_distinct("cell", "year", "month").alias("n_keys"), F.count("*").alias("n"))


@query("a25_error_summary", f"WITH o AS (SELECT cell, day, avg(v) AS v FROM pd GROUP BY 1, 2), e AS (SELECT cell, day // 7 AS span, avg(v - 10) AS e FROM o GROUP BY 1, 2) SELECT cell, count(*) FILTER (e > 0) AS over, {R('avg(abs(e))')} AS mae FROM e GROUP BY cell", "pd")
def a25(spark, sf):
    o = day_panel(spark, sf).groupBy("cell", "day").agg(F.avg("v").alias("v"))
    e = o.groupBy("cell", F.floor(F.col("day") / 7).alias("span")).agg(F.avg(F.col("v") - 10).alias("e"))
    return e.groupBy("cell").agg(F.count_if(F.col("e") > 0).alias("over"), r4(F.avg(F.abs("e"))).alias("mae"))


@query("w13_running_frame", f"SELECT cell, period, {R('avg(v) OVER (PARTITION BY cell ORDER BY period RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)')} AS mean FROM pw", "pw")
def w13(spark, sf):
    return rounded(rolling.running_mean(week_panel(spark, sf), ["cell"], "period", 3), ["cell", "period"], ["mean"])


@query("w10_l5_l10_distinct_windows", f"WITH d AS (SELECT DISTINCT cell, month % 4 AS win, max(v) OVER (PARTITION BY cell, month % 4) AS v FROM pm), k AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY v DESC, win) AS k FROM d) SELECT cell, win, {R('v')} AS v, row_number() OVER (PARTITION BY cell ORDER BY win)::INT AS place FROM k WHERE k <= 2", "pm")
def w10(spark, sf):
    d = month_panel(spark, sf).groupBy("cell", (F.col("month") % 4).alias("win")).agg(F.max("v").alias("v"))
    two = search.top(d, ["cell"], F.col("v"), "win", 2).drop("place")
    return two.select("cell", "win", r4(F.col("v")).alias("v"), F.row_number().over(Window.partitionBy("cell").orderBy("win")).alias("place"))


@query("m12_m17_group_map", "SELECT event_type, CASE event_type WHEN 'click' THEN 'act' WHEN 'purchase' THEN 'act' WHEN 'view' THEN 'see' ELSE 'other' END AS grp, count(*) AS n FROM events GROUP BY 1, 2")
def m12(spark, sf):
    names = F.create_map(*[F.lit(x) for x in ("click", "act", "purchase", "act", "view", "see")])
    return table(spark, sf, "events").groupBy("event_type", F.coalesce(F.try_element_at(names, F.col("event_type")), F.lit("other")).alias("grp")).agg(F.count("*").alias("n"))


@query("m13_recipe_text", "SELECT cell, 'month=' || month || ' / year=' || year AS recipe FROM pm", "pm")
def m13(spark, sf):
    return month_panel(spark, sf).select("cell", search.recipe_text(["month", "year"]).alias("recipe"))


@query("m18_json_functions", "SELECT event_id, (props->>'k')::INT AS k FROM events")
def m18(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("u8_sql_functions", f"SELECT l_orderkey, l_linenumber, {R('5e-1 * ((0.2e0 - (l_linenumber % 3 <= 0)::INT) ** 2 + (0.5e0 - (l_linenumber % 3 <= 1)::INT) ** 2)')} AS s, year(l_shipdate)::INT + (month(l_shipdate) > 2)::INT AS sy FROM lineitem")
def u8(spark, sf):
    sqlnames.register(spark)
    return spark.sql("SELECT l_orderkey, l_linenumber, round(rps3(0.2D, 0.3D, l_linenumber % 3), 4) + 0.0D AS s, season_year(year(l_shipdate), month(l_shipdate), 2) AS sy FROM {lines}", lines=table(spark, sf, "lineitem"))


@query("r14_scalar_to_field", f"""WITH t AS (SELECT period, sum(v) AS x FROM pw GROUP BY 1), p AS (SELECT cell, period, x, v AS y FROM pw JOIN t USING (period)), s AS (SELECT cell, count(*) AS n, avg(x) AS mx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx FROM p GROUP BY cell)
SELECT cell, {R('corr(y, y - (y - a - b * x) / greatest(1 - 1e0 / n - (x - mx) * (x - mx) / sxx, 1e-12))')} AS loo_r FROM p JOIN s USING (cell) WHERE n >= 5 GROUP BY cell""", "pw")  # fmt: skip
def r14(spark, sf):
    w = week_panel(spark, sf)
    rows = w.join(w.groupBy("period").agg(F.sum("v").alias("x")), "period").select("cell", "x", F.col("v").alias("y"))
    return rounded(regress.loyo_skill(rows, ["cell"]).where("n >= 5"), ["cell"], ["loo_r"])


@query("r24_point_biserial", f"WITH {PAIRS}, q AS (SELECT *, quantile_cont(y, 1e0/3) OVER (PARTITION BY cell) AS q FROM pairs) SELECT cell, {R('corr((y < q)::INT, x)')} AS r FROM q GROUP BY cell", "pw")
def r24(spark, sf):
    q = pairs(spark, sf).withColumn("q", F.percentile("y", F.lit(1 / 3)).over(Window.partitionBy("cell")))
    return q.groupBy("cell").agg(r4(corr((F.col("y") < F.col("q")).cast("double"), F.col("x"))).alias("r"))


@query("g16_expert_overlap", f"WITH p AS (SELECT cell, ((month - 1) // 3)::INT AS zone, CASE WHEN lat < 0 THEN 's' ELSE 'n' END AS region FROM (SELECT cell, month, sum(v) AS v FROM pm GROUP BY 1, 2) JOIN dim USING (cell) QUALIFY row_number() OVER (PARTITION BY cell ORDER BY v DESC, month) = 1) SELECT zone, region, {R('count(*)::DOUBLE / (SELECT count(*) FROM p a WHERE a.zone = p.zone)')} AS of_zone, {R('count(*)::DOUBLE / (SELECT count(*) FROM p a WHERE a.region = p.region)')} AS of_region FROM p GROUP BY zone, region", "dim pm")
def g16(spark, sf):
    """Zones are the quarters of the cells' largest months, regions the hemispheres."""
    month = month_panel(spark, sf).groupBy("cell", "month").agg(F.sum("v").alias("v"))
    parts = month.groupBy("cell").agg(F.floor((F.max_by("month", F.struct("v", -F.col("month"))) - 1) / 3).cast("int").alias("zone"))
    regions = cells(spark).join(parts, "cell", "left_semi").select("cell", F.when(F.col("lat") < 0, "s").otherwise("n").alias("region"))
    return rounded(benchmarks.expert_overlap(parts, regions), ["zone", "region"], ["of_zone", "of_region"])


@query("g20_fixed_mean")
def g20(spark, sf):
    full = pairs(spark, sf).groupBy((F.col("cell") % 4).alias("zone"), "year").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    ok = full.groupBy("year").agg(F.count("*").alias("n")).where("n = 4").select("year")
    rows = full.join(ok, "year", "left_semi").join(F.broadcast(whole_folds(spark, sf)), "year").select("fold", "zone", F.lit(1.0).alias("w"), "year", "is_train", "x", "y")
    return rounded(benchmarks.fixed_mean(rows), ["fold", "year"], ["pred", "sigma", "obs_mean"])


@query("g21_gridded")
def g21(spark, sf):
    rows = pairs(spark, sf).join(F.broadcast(whole_folds(spark, sf)), "year").withColumn("zone", F.col("cell") % 3)
    signal = rows.groupBy("fold", "zone", "year").agg(F.avg("x").alias("x"))
    return rounded(benchmarks.gridded(rows.select("fold", "cell", "zone", "year", "is_train", "y"), signal), ["fold", "n"], ["rpss"])


@query("g22_zones_against_bands", f"""WITH s AS (SELECT CASE WHEN cell % 2 = 0 THEN 'zone' ELSE 'band' END AS kind, (cell // 5)::INT AS unit, month AS predictor, avg(v) - 2 AS r, count(*) AS n, avg(v) AS level FROM pm GROUP BY 1, 2, 3),
z AS (SELECT kind, unit, sum(n) AS n, avg(level) AS level FROM s GROUP BY 1, 2), b AS (SELECT avg(level) AS bar FROM z WHERE kind = 'band') SELECT kind, unit, {R('max(abs(r))')} AS best FROM s WHERE (kind, unit) IN (SELECT (kind, unit) FROM z, b WHERE kind = 'band' OR n >= 60 AND level >= 0.98e0 * bar) GROUP BY 1, 2""", "pm")  # fmt: skip
def g22(spark, sf):
    s = month_panel(spark, sf).groupBy(F.when(F.col("cell") % 2 == 0, "zone").otherwise("band").alias("kind"), F.floor(F.col("cell") / 5).cast("int").alias("unit"), F.col("month").alias("predictor")).agg((F.avg("v") - 2).alias("r"), F.count("*").alias("n"), F.avg("v").alias("level"))
    sizes = s.groupBy("kind", "unit").agg(F.sum("n").alias("n"), F.avg("level").alias("level"))
    return rounded(benchmarks.zones_against_bands(s.select("kind", "unit", "predictor", "r"), sizes, 60, 0.98), ["kind", "unit"], ["best"])


@query("t1_t4_issuance_stream", "SELECT strftime(o_orderdate, '%Y-%m') AS init, o_orderpriority AS key, max(o_orderkey) AS v FROM orders GROUP BY 1, 2")
def t1(spark, sf):
    source, out = io.shared_folder(spark, "stream-in"), io.shared_folder(spark, "stream-out")
    rows = table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("init"), F.col("o_orderpriority").alias("key")).agg(F.max("o_orderkey").alias("v"))
    rows.write.parquet(source)
    for k in range(2):  # the second run adds nothing
        issuance.issue(spark.readStream.schema(rows.schema).parquet(source), out, f"{out}-offsets-{k}", ["init", "key"]).awaitTermination()
    return spark.read.schema("key string, v bigint, init string").parquet(out).select("init", "key", "v")


@query("u3_method_search")
def u3(spark, sf):
    p = pairs(spark, sf)
    out = downscale.left_out(p, ["cell"], sorted(downscale.METHODS)).groupBy("cell", "method").agg(corr("pred", "y").alias("r"), F.count("*").alias("n"))
    return rounded(out.withColumn("r", clean(F.col("r"))), ["cell", "method", "n"], ["r"])
