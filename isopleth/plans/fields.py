"""Queries over the month, week and day panels: scans, calendar, joins, reductions, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isopleth.functions import calendar as cal
from isopleth.functions import indices
from isopleth.functions.scalar import area_weight, in_box, km_per_degree, lon360, r4, slug
from isopleth.operators import cube, discovery, rolling, search
from isopleth.sources import io
from isopleth.sources.panels import cells, day_panel, month_panel, table, week_panel

from .base import R, query


def field(spark: SparkSession, sf: str) -> DataFrame:
    return month_panel(spark, sf).join(F.broadcast(cells(spark)), "cell")


@query("s2_f1_bbox_scan", f"SELECT cell, year, month, {R('v')} AS v FROM pm JOIN dim USING (cell) WHERE lat BETWEEN -10 AND 20 AND lon BETWEEN 14.4e0 AND 250", "dim pm")
def s2(spark, sf):
    return field(spark, sf).where(in_box(F.col("lat"), F.col("lon"), -10, 20, 14.4, 250)).select("cell", "year", "month", r4(F.col("v")).alias("v"))


@query("s3_family_glob", "SELECT 'region' AS member, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation")
def s3(spark, sf):
    both = [io.read_family(spark, sf, f"{t}.parquet").groupBy("member").agg(F.count("*").alias("n")) for t in ("region", "nation")]
    return both[0].unionByName(both[1])


@query("s4_cached_coarse", f"SELECT cell // 5 AS i, year AS j, {R('avg(v)')} AS v FROM pm GROUP BY 1, 2", "pm")
def s4(spark, sf):
    built = io.cached(spark, io.shared_folder(spark, "coarse"), month_panel(spark, sf), "x5", lambda d: d.groupBy(F.floor(F.col("cell") / 5).cast("int").alias("i"), F.col("year").alias("j")).agg(F.avg("v").alias("v")))
    return built.select("i", "j", r4(F.col("v")).alias("v"))


@query("s6_k1_csv_roundtrip", "SELECT n_nationkey::INT AS n_nationkey, n_name FROM nation WHERE n_name IS NOT NULL")
def s6(spark, sf):
    path = io.shared_folder(spark, "csv")
    io.write_csv(table(spark, sf, "nation"), path, ["n_nationkey", "n_name"])
    return io.read_csv(spark, path, "n_nationkey int, n_name string", ["n_name"])


@query("s7_k2_jsonl_roundtrip", f"SELECT cell, month, {R('avg(v)')} AS clim FROM pm GROUP BY cell, month", "pm")
def s7(spark, sf):
    path = io.shared_folder(spark, "jsonl")
    rows = io.json_rows(month_panel(spark, sf).groupBy("cell", "month").agg(F.avg("v").alias("clim")))
    rows.unionByName(spark.createDataFrame([('{"error": "x"}',), ("{broken",)], "json string")).write.text(path)
    return io.read_jsonl(spark, path, "cell int, month int, clim double")[0].select("cell", "month", r4(F.col("clim")).alias("clim"))


@query("s11_pipe_table", "SELECT n_nationkey::BIGINT AS pos, n_name AS name, n_nationkey * 1.5e0 AS value FROM nation")
def s11(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("pos"), F.concat(F.lit("| "), "n_name", F.lit(" | "), (F.col("n_nationkey") * 1.5).cast("string"), F.lit(" |")).alias("value"))
    lines = n.unionByName(spark.createDataFrame([(-1, "| --- | --- |"), (-2, "prose")], "pos long, value string"))
    return io.pipe_table(lines).select("pos", F.get("cells", F.lit(0)).alias("name"), io.cell_number(F.col("cells"), 1).alias("value"))


@query("s13_catalog_override", "SELECT r_regionkey::INT AS k, CASE WHEN r_regionkey = 2 THEN 'mirror' ELSE r_name END AS source FROM region")
def s13(spark, sf):
    catalog = table(spark, sf, "region").select(F.col("r_regionkey").cast("int").alias("k"), F.col("r_name").alias("source"))
    return io.routed(catalog, spark.createDataFrame([(2, "mirror")], "k int, source string"), "k")


@query("s14_newest_init", "SELECT max(d)::VARCHAR AS init FROM (SELECT DISTINCT o_orderdate::DATE AS d FROM orders) WHERE day(d) % 2 = 1 AND d IN (SELECT l_shipdate::DATE FROM lineitem)")
def s14(spark, sf):
    inits = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("init")).distinct()
    newest = rolling.newest_with_hindcast(inits, table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("init")))
    return newest.select(F.col("init").cast("string").alias("init"))


@query("k3_t4_restartable_append", "SELECT n_nationkey::INT AS k, n_nationkey::INT * 2 AS v FROM nation")
def k3(spark, sf):
    path = io.shared_folder(spark, "append")
    todo = table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("k"))
    made = lambda d: d.select("k", (F.col("k") * 2).alias("v"))
    for part in (todo.where("k < 10"), todo, todo):
        io.append_missing(spark, part, path, ["k"], made)
    return spark.read.parquet(path)


@query("k6_guarded_write", f"SELECT cell, {R('sum(v)')} AS v FROM pm GROUP BY cell", "pm")
def k6(spark, sf):
    return io.guarded(month_panel(spark, sf).groupBy("cell").agg(r4(F.sum("v")).alias("v")), "v")


@query("k9_complete_sweep", "SELECT count(*) AS n, count(DISTINCT (l_orderkey, l_linenumber)) AS n_keys, 0::BIGINT AS n_errors, false AS ok FROM lineitem")
def k9(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("replicate"), F.col("l_linenumber").alias("arm"), F.lit(None).cast("string").alias("error"))
    return io.complete(rows, 3, 3)


@query("a1_climatology", f"SELECT cell, month, {R('avg(v)')} AS clim FROM pm WHERE year BETWEEN 1995 AND 1999 GROUP BY cell, month", "pm")
def a1(spark, sf):
    return cube.climatology(month_panel(spark, sf), 1995, 1999).select("cell", "month", r4(F.col("clim")).alias("clim"))


@query("a2_j6_anomaly", f"SELECT cell, year, month, {R('v - avg(v) FILTER (year BETWEEN 1995 AND 1999) OVER (PARTITION BY cell, month)')} AS anom FROM pm", "pm")
def a2(spark, sf):
    return cube.anomaly(month_panel(spark, sf), 1995, 1999).select("cell", "year", "month", r4(F.col("anom")).alias("anom"))


@query("a3_area_mean_weighted", f"SELECT year, month, {R('sum(w * v) / sum(w)')} AS mean FROM pm JOIN dim USING (cell) GROUP BY year, month", "dim pm")
def a3(spark, sf):
    return cube.area_mean(field(spark, sf), ["year", "month"]).select("year", "month", r4(F.col("mean")).alias("mean"))


@query("a3_area_mean_plain", f"SELECT year, month, {R('avg(v)')} AS mean FROM pm GROUP BY year, month", "pm")
def a3b(spark, sf):
    return cube.area_mean(field(spark, sf), ["year", "month"], weighted=False).select("year", "month", r4(F.col("mean")).alias("mean"))


DAYS = "CASE month WHEN 12 THEN 31e0 WHEN 1 THEN 31e0 ELSE 28.25e0 END"


@query("a4_season_totals_wrap", f"SELECT cell, year + (month = 12)::INT AS season_year, {R(f'sum(v * {DAYS})')} AS total FROM pm WHERE month IN (12, 1, 2) GROUP BY 1, 2 HAVING count(DISTINCT month) = 3", "pm")
def a4(spark, sf):
    return cube.season_totals(month_panel(spark, sf), [12, 1, 2], ["cell"], day_weighted=True).select("cell", "season_year", r4(F.col("total")).alias("total"))


@query("flagship_mam", f"""WITH a AS (SELECT cell, year, month, v - avg(v) FILTER (year BETWEEN 1995 AND 1999) OVER (PARTITION BY cell, month) AS anom FROM pm),
m AS (SELECT cell % 5 AS grp, year, month, sum(w * anom) / sum(w) FILTER (anom IS NOT NULL) AS x FROM a JOIN dim USING (cell) GROUP BY 1, 2, 3)
SELECT grp, year AS season_year, {R('sum(x)')} AS total FROM m WHERE month IN (3, 4, 5) GROUP BY grp, year HAVING count(*) = 3 AND count(x) = 3""", "dim pm")  # fmt: skip
def flagship(spark, sf):
    a = cube.anomaly(field(spark, sf), 1995, 1999).withColumn("grp", F.col("cell") % 5)
    m = cube.area_mean(a, ["grp", "year", "month"], value="anom")
    return cube.season_totals(m, [3, 4, 5], ["grp"], value="mean").select("grp", "season_year", r4(F.col("total")).alias("total"))


@query("a5_calendar_totals", f"SELECT cell, year, {R('sum(v)')} AS total FROM pm WHERE month IN (10, 11, 12) GROUP BY cell, year", "pm")
def a5(spark, sf):
    return cube.calendar_totals(month_panel(spark, sf), [10, 11, 12], ["cell"]).select("cell", "year", r4(F.col("total")).alias("total"))


@query("a6_j9_preseason_mean", f"""WITH s AS (SELECT DISTINCT year AS season_year FROM pm), k AS (SELECT season_year, (season_year - 1) * 12 + 11 - 1 - g AS am FROM s, (SELECT unnest(range(0, 3))::INT AS g))
SELECT cell, season_year, CASE WHEN count(v) = 3 THEN {R('avg(v)')} END AS x FROM pm JOIN k ON pm.year * 12 + pm.month - 1 = k.am GROUP BY cell, season_year""", "pm")  # fmt: skip
def a6(spark, sf):
    years = month_panel(spark, sf).select(F.col("year").alias("season_year")).distinct()
    return cube.preseason_mean(month_panel(spark, sf), years, [12, 1, 2], 0, 3, ["cell"]).select("cell", "season_year", r4(F.col("x")).alias("x"))


@query("a9_ensemble_mean", f"SELECT day, {R('avg(m)')} AS v FROM (SELECT day, cell, avg(v) AS m FROM pd GROUP BY day, cell) GROUP BY day", "pd")
def a9(spark, sf):
    return cube.ensemble_mean(day_panel(spark, sf).withColumnRenamed("cell", "model"), ["day"]).select("day", r4(F.col("v")).alias("v"))


WIN = "win AS (SELECT * FROM (VALUES ('day1_30', 1, 30), ('week1', 1, 7), ('week2', 8, 14), ('week3', 15, 21), ('week4', 22, 28)) t(win, a, b))"


@query("a10_j8_lead_windows", f"WITH {WIN} SELECT cell, win AS \"window\", {R('avg(v)')} AS v FROM pd JOIN win ON day BETWEEN a AND b GROUP BY cell, win, a, b HAVING count(DISTINCT day) = b - a + 1", "pd")
def a10(spark, sf):
    return rolling.lead_window_mean(day_panel(spark, sf), cal.lead_windows(spark), ["cell"]).select("cell", "window", r4(F.col("v")).alias("v"))


@query("a12_anchor", f"SELECT cell, {R('avg(v)')} AS anchor FROM pd WHERE day BETWEEN 13 AND 20 GROUP BY cell", "pd")
def a12(spark, sf):
    return rolling.anchor(day_panel(spark, sf), 20, 7, ["cell"]).select("cell", r4(F.col("anchor")).alias("anchor"))


@query("a18_pivot_leads", "SELECT o_orderstatus AS s, " + ", ".join(f"max(CASE WHEN month(o_orderdate) = {m} THEN o_totalprice END) AS lead{m}" for m in range(1, 13)) + " FROM orders GROUP BY 1")
def a18(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("s"), F.month("o_orderdate").alias("lead"), "o_totalprice")
    return search.leads_wide(o, "s", "o_totalprice", list(range(1, 13)))


@query("a19_conditional_probability", f"""WITH t AS (SELECT cell, period, v, quantile_cont(v, 1e0/3) OVER (PARTITION BY cell) AS q, avg(v) OVER (PARTITION BY cell) AS m FROM pw)
SELECT cell, {R('avg((v < q)::INT::DOUBLE)')} AS p_all, {R('avg(CASE WHEN v < m THEN (v < q)::INT::DOUBLE END)')} AS p_dry, count(*) FILTER (v < m) AS n FROM t GROUP BY cell""", "pw")  # fmt: skip
def a19(spark, sf):
    w = Window.partitionBy("cell")
    t = week_panel(spark, sf).withColumns({"q": F.percentile("v", F.lit(1 / 3)).over(w), "m": F.avg("v").over(w)})
    below, dry = (F.col("v") < F.col("q")).cast("double"), F.col("v") < F.col("m")
    return t.groupBy("cell").agg(r4(F.avg(below)).alias("p_all"), r4(F.avg(F.when(dry, below))).alias("p_dry"), F.count_if(dry).alias("n"))


@query("a20_composites", f"""WITH s AS (SELECT period, sum(v) AS y FROM pw GROUP BY 1), r AS (SELECT period, row_number() OVER (ORDER BY y, period) AS r, count(*) OVER () AS n FROM s)
SELECT cell, {R('avg(v) FILTER (r <= greatest(3, n // 3))')} AS low, {R('avg(v) FILTER (r > n - greatest(3, n // 3))')} AS high, {R('avg(v) FILTER (r > n - greatest(3, n // 3)) - avg(v) FILTER (r <= greatest(3, n // 3))')} AS diff FROM pw JOIN r USING (period) GROUP BY cell""", "pw")  # fmt: skip
def a20(spark, sf):
    f = week_panel(spark, sf).withColumnRenamed("period", "year")
    out = cube.composites(f.groupBy("year").agg(F.sum("v").alias("y")), f)
    return out.select("cell", *[r4(F.col(c)).alias(c) for c in ("low", "high", "diff")])


@query("a26_two_grains", f"SELECT cell, CASE WHEN grouping(month) = 1 THEN NULL ELSE month END AS month, {R('max(v)')} AS best FROM pm GROUP BY GROUPING SETS ((cell), (cell, month))", "pm")
def a26(spark, sf):
    keys = [F.col("cell"), F.col("month")]
    return month_panel(spark, sf).groupingSets([keys[:1], keys], *keys).agg(r4(F.max("v")).alias("best"))


@query("f2_f3_wrapping_box", f"SELECT cell, lon, count(*) AS n, {R('avg(v)')} AS v FROM pm JOIN dim USING (cell) WHERE lat BETWEEN -30 AND 40 AND (((lon - 720) % 360 + 360) % 360 >= 330 OR ((lon - 720) % 360 + 360) % 360 <= 10) GROUP BY cell, lon", "dim pm")
def f2(spark, sf):
    rows = month_panel(spark, sf).join(cells(spark), "cell").where(in_box(F.col("lat"), lon360(F.col("lon") - 720), -30, 40, 330, 370))
    return rows.groupBy("cell", "lon").agg(F.count("*").alias("n"), r4(F.avg("v")).alias("v"))


@query("f6_bands", f"SELECT band, year, count(*) AS n, {R('avg(v)')} AS v FROM pm JOIN dim USING (cell) JOIN (VALUES ('all', -90, 90), ('north', 0, 90), ('south', -90, 0)) b(band, s, n) ON lat BETWEEN s AND n GROUP BY band, year", "dim pm")
def f6(spark, sf):
    dim = spark.createDataFrame([("all", -90.0, 90.0), ("north", 0.0, 90.0), ("south", -90.0, 0.0)], "band string, lat_s double, lat_n double")
    return cube.bands(month_panel(spark, sf).join(cells(spark), "cell"), dim).groupBy("band", "year").agg(F.count("*").alias("n"), r4(F.avg("v")).alias("v"))


@query("f8_valid_cells", "WITH c AS (SELECT cell, month, avg(v) AS clim FROM pm GROUP BY 1, 2) SELECT cell FROM c GROUP BY cell HAVING count(clim) = 12 AND sum(clim) > 1e-3", "pm")
def f8(spark, sf):
    return cube.valid_cells(cube.climatology(month_panel(spark, sf), 0, 9999))


@query("f10_wet_cells", f"WITH m AS (SELECT cell % 5 AS band, cell, avg(v) AS mean FROM pm GROUP BY 1, 2) SELECT band, cell, {R('mean')} AS mean FROM m WHERE mean >= 0.95e0 * (SELECT max(mean) FROM m x WHERE x.band = m.band)", "pm")
def f10(spark, sf):
    m = month_panel(spark, sf).groupBy((F.col("cell") % 5).alias("band"), "cell").agg(F.avg("v").alias("mean"))
    return cube.wet_cells(m, 0.95).select("band", "cell", r4(F.col("mean")).alias("mean"))


@query("f15_f16_j2_common_years", "SELECT period FROM pw GROUP BY period HAVING count(DISTINCT cell) = (SELECT count(DISTINCT cell) FROM pw)", "pw")
def f16(spark, sf):
    return cube.common_years(week_panel(spark, sf), "cell", "period")


@query("f17_j4_missing_days", f"WITH {WIN}, d AS (SELECT win, unnest(range(a, b + 3))::INT AS day FROM win) SELECT win AS \"window\", day FROM d WHERE day NOT IN (SELECT day FROM pd)", "pd")
def f17(spark, sf):
    wider = cal.lead_windows(spark).withColumn("last_day", F.col("last_day") + 2)
    return rolling.missing_days(day_panel(spark, sf), wider)


@query("f18_f19_season_calendar", "SELECT DISTINCT year, month::INT AS start, l::INT AS lead, (((month - l - 1) % 12 + 12) % 12 + 1)::INT AS init, (year * 12 + month - 1 - (l + 1))::INT AS am FROM pm, range(0, 6) b(l)", "pm")
def f18(spark, sf):
    """For every month of the panel as a season's start: the month of issue at each lead, and the absolute month before which predictors end."""
    starts = month_panel(spark, sf).select("year", F.col("month").alias("start")).distinct()
    leads = spark.createDataFrame([(m, lead, cal.init_month(m, lead)) for m in range(1, 13) for lead in range(6)], "start int, lead int, init int")
    out = starts.join(F.broadcast(leads), "start")  # months by leads
    am = F.lit(0)
    for m in range(1, 13):
        am = F.when(F.col("start") == m, cal.preseason(F.col("year"), [m], 0) - F.col("lead")).otherwise(am)
    return out.select("year", "start", "lead", "init", am.cast("int").alias("am"))


@query("f20_valid_dates", "SELECT y::INT AS year, (make_date(y, 2, CASE WHEN y % 4 = 0 THEN 29 ELSE 28 END) + d::INT)::VARCHAR AS day FROM (SELECT DISTINCT year AS y FROM pm), range(7, 14) b(d)", "pm")
def f20(spark, sf):
    """The second week after 29 February in every year of the panel."""
    years = month_panel(spark, sf).select("year").distinct()
    start = years.select("year", cal.moved_to_year(F.lit("2024-02-29").cast("date"), F.col("year")).alias("init"))
    return start.select("year", F.explode(cal.valid_days(F.col("init"), F.lit(8), F.lit(14))).alias("day")).select("year", F.col("day").cast("string").alias("day"))


@query("f21_f22_month_labels", f"SELECT m.month AS start, substr('JFMAMJJASOND', m.month, 1) || substr('JFMAMJJASOND', m.month % 12 + 1, 1) || substr('JFMAMJJASOND', (m.month + 1) % 12 + 1, 1) AS label, m.month > (m.month + 1) % 12 + 1 AS wraps, {R('avg(x.v)')} AS v FROM (SELECT DISTINCT month::INT AS month FROM pm) m JOIN pm x ON (x.month - m.month + 12) % 12 < 3 GROUP BY m.month", "pm")
def f22(spark, sf):
    """Mean values of all three-month windows of the panel, with their labels and whether they wrap."""
    rows = month_panel(spark, sf).select("v", F.explode(F.sequence(F.col("month") - 2, F.col("month"))).alias("m")).select("v", (F.pmod(F.col("m") - 1, F.lit(12)) + 1).alias("start"))
    months = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.pmod(F.col("start") - 1 + k, F.lit(12)) + 1)
    return rows.groupBy("start").agg(r4(F.avg("v")).alias("v")).select("start", cal.month_initials(months).alias("label"), cal.wraps_col(months).alias("wraps"), "v")


@query("f23_slug", "SELECT page_id, left(trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-'), 80) AS slug FROM pages")
def f23(spark, sf):
    return table(spark, sf, "pages").select("page_id", slug(F.col("url")).alias("slug"))


@query("f24_scatter", f"SELECT dim.cell, {R('v')} AS v FROM dim LEFT JOIN (SELECT cell, sum(v) AS v FROM pm WHERE cell < 20 GROUP BY cell) USING (cell)", "dim pm")
def f24(spark, sf):
    some = month_panel(spark, sf).where("cell < 20").groupBy("cell").agg(F.sum("v").alias("v"))
    return cells(spark).select("cell").join(some, "cell", "left").select("cell", r4(F.col("v")).alias("v"))


@query("j5_symmetric_difference", "WITH k AS (SELECT DISTINCT cell, year, month FROM pm), b AS (SELECT cell, year + 1 AS year, month FROM k), y AS (SELECT min(year) + 1 AS lo, max(year) AS hi FROM k) SELECT coalesce(k.cell, b.cell) AS cell, coalesce(k.year, b.year) AS year, coalesce(k.month, b.month) AS month FROM k FULL JOIN b USING (cell, year, month), y WHERE (k.cell IS NULL OR b.cell IS NULL) AND coalesce(k.year, b.year) BETWEEN lo AND hi", "pm")
def j5(spark, sf):
    """Months of a cell that a year has and the year before has not, or the other way round."""
    keys = ["cell", "year", "month"]
    now = month_panel(spark, sf).select(*keys)
    before = now.withColumn("year", F.col("year") + 1)
    span = now.agg((F.min("year") + 1).alias("lo"), F.max("year").alias("hi"))
    both = now.join(before, keys, "left_anti").unionByName(before.join(now, keys, "left_anti"))
    return both.crossJoin(F.broadcast(span)).where("year BETWEEN lo AND hi").select(*keys)  # one row on the other side


@query("j7_design_tensor", "SELECT n_name AS target, (26 * 5 * 2)::BIGINT AS n FROM nation")
def j7(spark, sf):
    names = [r[0] for r in table(spark, sf, "nation").select("n_name").collect()]  # a small dimension
    return search.tensor(spark, names).groupBy("target").agg(F.count_distinct("key").alias("n"))


@query("j11_l7_pool_models", f"WITH q AS (SELECT cell FROM pd GROUP BY cell HAVING count(DISTINCT day) >= 20) SELECT cell AS model, member, {R('avg(v)')} AS v FROM pd WHERE cell IN (SELECT cell FROM q) GROUP BY 1, 2", "pd")
def j11(spark, sf):
    d = day_panel(spark, sf)
    ok = d.groupBy("cell").agg(F.count_distinct("day").alias("n")).where("n >= 20").select("cell")
    return d.join(ok, "cell", "left_semi").groupBy(F.col("cell").alias("model"), "member").agg(r4(F.avg("v")).alias("v"))


@query("j12_a17_best_lookup", f"WITH b AS (SELECT cell, max(v) AS ceiling FROM pm GROUP BY cell) SELECT cell, year, month, {R('v')} AS v, {R('ceiling')} AS ceiling FROM pm JOIN b USING (cell) QUALIFY row_number() OVER (PARTITION BY cell ORDER BY v DESC, year * 12 + month) = 1", "pm")
def j12(spark, sf):
    p = month_panel(spark, sf).withColumn("am", cal.abs_month(F.col("year"), F.col("month")))
    top = p.groupBy("cell").agg(F.max("v").alias("ceiling"))
    return search.best(p, ["cell"], "v", "am").join(top, "cell", "left").select("cell", "year", "month", r4(F.col("v")).alias("v"), r4(F.col("ceiling")).alias("ceiling"))


@query("l1_l4_top_two", f"SELECT cell, year, month, {R('v')} AS v, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY v DESC, year * 12 + month) AS place FROM pm) WHERE place <= 2", "pm")
def l1(spark, sf):
    p = month_panel(spark, sf).withColumn("am", cal.abs_month(F.col("year"), F.col("month")))
    return search.top(p, ["cell"], F.col("v"), "am", 2).select("cell", "year", "month", r4(F.col("v")).alias("v"), "place")


@query("l2_l6_top_listing", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def l2(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("l9_ordered_distinct", "SELECT o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def l9(spark, sf):
    return search.ordered_distinct(table(spark, sf, "orders"), "o_orderpriority", "o_orderkey")


@query("l8_l11_set_operations", "SELECT (SELECT count(*) FROM (SELECT cell, month FROM pm WHERE year = 1995 INTERSECT SELECT cell, month FROM pm WHERE year = 1996)) AS both_years, (SELECT count(*) FROM (SELECT cell, month FROM pm WHERE year = 1995 UNION SELECT cell, month FROM pm WHERE year = 1996)) AS any_year", "pm")
def l8(spark, sf):
    a, b = (month_panel(spark, sf).where(F.col("year") == y).select("cell", "month") for y in (1995, 1996))
    return a.intersect(b).agg(F.count("*").alias("both_years")).crossJoin(a.union(b).distinct().agg(F.count("*").alias("any_year")))


@query("w1_zscore", f"SELECT cell, period, {R('(v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0)')} AS z FROM pw WINDOW w AS (PARTITION BY cell)", "pw")
def w1(spark, sf):
    return cube.zscore(week_panel(spark, sf), ["cell"]).select("cell", "period", r4(F.col("z")).alias("z"))


@query("w1_zscore_train", f"SELECT cell, period, {R('(v - avg(v) FILTER (period < 200) OVER w) / nullif(stddev_pop(v) FILTER (period < 200) OVER w, 0)')} AS z FROM pw WINDOW w AS (PARTITION BY cell)", "pw")
def w1b(spark, sf):
    return cube.zscore(week_panel(spark, sf), ["cell"], train=F.col("period") < 200).select("cell", "period", r4(F.col("z")).alias("z"))


@query("w12_centroid_order", f"SELECT g, {R('m')} AS m, (dense_rank() OVER (ORDER BY m) - 1)::INT AS zone FROM (SELECT month % 4 AS g, sum(-lon * v) / sum(v) AS m FROM pm JOIN dim USING (cell) GROUP BY 1)", "dim pm")
def w12(spark, sf):
    """Groups of months in the order of the centroid of their values."""
    m = month_panel(spark, sf).join(cells(spark), "cell").groupBy((F.col("month") % 4).alias("g")).agg((F.sum(-F.col("lon") * F.col("v")) / F.sum("v")).alias("m"))
    return m.select("g", r4(F.col("m")).alias("m"), (F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("m")) - 1).cast("int").alias("zone"))


@query("m1_m9_cell_geometry", f"SELECT cell, {R('cos(radians(lat))')} AS w, {R('111.32e0 * cos(radians(lat)) * 0.5e0')} AS km, {R('avg(v) * cos(radians(lat))')} AS wv FROM pm JOIN dim USING (cell) GROUP BY cell, lat", "dim pm")
def m1(spark, sf):
    means = month_panel(spark, sf).groupBy("cell").agg(F.avg("v").alias("v")).join(cells(spark), "cell")
    return means.select("cell", r4(area_weight(F.col("lat"))).alias("w"), r4(km_per_degree(F.col("lat"), 0.5)).alias("km"), r4(F.col("v") * area_weight(F.col("lat"))).alias("wv"))


@query("m6_m8_index_composition", f"""WITH z AS (SELECT cell, period, (v - avg(v) OVER (PARTITION BY cell)) / nullif(stddev_pop(v) OVER (PARTITION BY cell), 0) AS z FROM pw WHERE cell < 4),
x AS (SELECT period, max(CASE WHEN cell = 0 THEN z END) AS a, max(CASE WHEN cell = 1 THEN z END) AS b, max(CASE WHEN cell = 2 THEN z END) AS c, max(CASE WHEN cell = 3 THEN z END) AS d FROM z GROUP BY period)
SELECT period, {R('a - b')} AS iod, {R('12 + 323e0 * (a - b) - 193e0 * c + 94e0 * d')} AS composite FROM x""", "pw")  # fmt: skip
def m6(spark, sf):
    z = cube.zscore(week_panel(spark, sf).where("cell < 4"), ["cell"]).select("period", F.concat(F.lit("b"), "cell").alias("box"), F.col("z").alias("v"))
    x = indices.wide(z, ["b0", "b1", "b2", "b3"], ["period"])
    return x.select("period", r4(indices.spec("dipole", F.col("b0"), F.col("b1"))).alias("iod"), r4(indices.composite(indices.iod(F.col("b0"), F.col("b1")), F.col("b2"), F.col("b3"))).alias("composite"))


@query("m11_bimodality", f"""WITH c AS (SELECT cell, month, avg(v) AS clim FROM pm GROUP BY 1, 2),
h AS (SELECT cell, sum(clim * cos(2 * pi() * (month - 1) / 12)) AS c1, sum(clim * sin(2 * pi() * (month - 1) / 12)) AS s1, sum(clim * cos(4 * pi() * (month - 1) / 12)) AS c2, sum(clim * sin(4 * pi() * (month - 1) / 12)) AS s2 FROM c GROUP BY 1)
SELECT cell, {R('sqrt(c1*c1 + s1*s1) / 6')} AS a1, {R('sqrt(c2*c2 + s2*s2) / 6')} AS a2, {R('sqrt(c2*c2 + s2*s2) / 6 / (sqrt(c1*c1 + s1*s1) / 6 + 1e-6)')} AS ratio FROM h""", "pm")  # fmt: skip
def m11(spark, sf):
    return cube.bimodality(cube.climatology(month_panel(spark, sf), 0, 9999)).select("cell", *[r4(F.col(c)).alias(c) for c in ("a1", "a2", "ratio")])


@query("g4_g5_bilinear", f"""WITH g AS (SELECT cell AS i, month - 1 AS j, avg(v) AS v FROM pm GROUP BY 1, 2)
SELECT a.i AS id, {R('0.75e0 * (0.5e0 * a.v + 0.5e0 * b.v) + 0.25e0 * (0.5e0 * c.v + 0.5e0 * d.v)')} AS v FROM g a JOIN g b ON b.i = a.i AND b.j = 4 JOIN g c ON c.i = a.i + 1 AND c.j = 3 JOIN g d ON d.i = a.i + 1 AND d.j = 4 WHERE a.j = 3""", "pm")  # fmt: skip
def g4(spark, sf):
    grid = month_panel(spark, sf).groupBy(F.col("cell").alias("i"), (F.col("month") - 1).alias("j")).agg(F.avg("v").alias("v"))
    points = cells(spark).select(F.col("cell").alias("id"), (F.col("cell") + 0.25).alias("y"), F.lit(3.5).alias("x"))
    return cube.bilinear(grid, points).where("v IS NOT NULL").select("id", r4(F.col("v")).alias("v"))


@query("g23_rain_window", f"""WITH c AS (SELECT cell, month - 1 AS m, avg(v) AS v FROM pm GROUP BY 1, 2), d AS (SELECT cell, m + s AS m, v FROM c, (SELECT unnest([0, 12]) AS s)),
w AS (SELECT a.cell, a.m AS start, n AS length, sum(b.v) AS total FROM c a, range(3, 7) l(n), d b WHERE b.cell = a.cell AND b.m >= a.m AND b.m < a.m + n GROUP BY 1, 2, 3),
b AS (SELECT *, total / (SELECT sum(v) FROM c WHERE c.cell = w.cell) AS captured FROM w QUALIFY row_number() OVER (PARTITION BY cell, length ORDER BY total DESC, start) = 1)
SELECT cell, start::INT AS start, length::INT AS length, {R('captured')} AS captured FROM b QUALIFY row_number() OVER (PARTITION BY cell ORDER BY CASE WHEN captured >= 0.5e0 THEN length ELSE 99 - length END) = 1""", "pm")  # fmt: skip
def g23(spark, sf):
    c = discovery.cycle(cube.climatology(month_panel(spark, sf), 0, 9999), ["cell"])
    return discovery.rain_window(c, ["cell"], 0.5).select("cell", "start", "length", r4(F.col("captured")).alias("captured"))


@query("g1_cycle_features", f"WITH c AS (SELECT cell, month, avg(v) AS v FROM pm GROUP BY 1, 2) SELECT cell, month, {R('(v - avg(v) OVER (PARTITION BY cell)) / (stddev_pop(v) OVER (PARTITION BY cell) + 1e-6)')} AS z FROM c", "pm")
def g1(spark, sf):
    c = discovery.cycle(cube.climatology(month_panel(spark, sf), 0, 9999), ["cell"])
    return c.select("cell", F.posexplode(discovery.row_z(F.col("c"))).alias("p", "z")).select("cell", (F.col("p") + 1).alias("month"), r4(F.col("z")).alias("z"))
