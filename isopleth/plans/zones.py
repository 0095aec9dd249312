"""Queries over seasons, zones, tracks and the walk-forward atlas.

The driver's tables have no record of decades: a year of the fold queries is twelve weeks of the week panel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isopleth.functions import calendar as cal
from isopleth.functions import indices
from isopleth.functions.scalar import area_weight, r4
from isopleth.operators import atlas, benchmarks, cube, discovery, inference
from isopleth.sources.io import written
from isopleth.sources.panels import cells, month_panel, table, week_panel

from .base import R, query
from .stats import rounded

CYCLE = "c AS (SELECT cell, month - 1 AS m, avg(v) AS v FROM pm GROUP BY 1, 2)"
AROUND = f"{CYCLE}, x AS (SELECT a.cell, a.m, a.v, b.v AS before, d.v AS after, max(a.v) OVER (PARTITION BY a.cell) AS top FROM c a JOIN c b ON b.cell = a.cell AND b.m = (a.m + 11) % 12 JOIN c d ON d.cell = a.cell AND d.m = (a.m + 1) % 12)"
WETTEST = """w AS (SELECT p.cell, p.m AS peak, k, (p.m + 10 + k) % 12 AS start FROM p, range(0, 3) t(k)), t AS (SELECT w.cell, peak, k, start, a.v + b.v + d.v AS total FROM w JOIN c a ON a.cell = w.cell AND a.m = start JOIN c b ON b.cell = w.cell AND b.m = (start + 1) % 12 JOIN c d ON d.cell = w.cell AND d.m = (start + 2) % 12),
f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY cell, peak ORDER BY total DESC, k) = 1)"""
LABEL = "substr('JFMAMJJASONDJF', (start + 1)::INT, 3)"


def cycles(spark: SparkSession, sf: str) -> DataFrame:
    return discovery.cycle(cube.climatology(month_panel(spark, sf), 0, 9999), ["cell"])


@query("g11_w4_w7_seasons", f"""WITH {AROUND}, r AS (SELECT cell, m FROM x WHERE v >= before AND v >= after AND v > 0.15e0 * top), p AS (SELECT * FROM r WHERE (cell, (m + 11) % 12) NOT IN (SELECT (cell, m) FROM r)),
{WETTEST}, g AS (SELECT cell, start, min(peak) AS peak, max(total) AS total FROM f GROUP BY 1, 2) SELECT cell, start::INT AS start, {LABEL} AS label, {R('total')} AS total FROM g QUALIFY row_number() OVER (PARTITION BY cell ORDER BY total DESC, peak) <= 2""", "pm")  # fmt: skip
def g11(spark, sf):
    return rounded(discovery.seasons(cycles(spark, sf), ["cell"]), ["cell", "start", "label"], ["total"])


@query("g24_target_windows", f"""WITH {AROUND}, r AS (SELECT cell, m, v, row_number() OVER (PARTITION BY cell ORDER BY v DESC, m) AS k FROM x WHERE v >= before AND v >= after AND v >= 0.55e0 * top),
p AS (SELECT cell, m FROM r WHERE k = 1), {WETTEST} SELECT cell, peak::INT AS peak, start::INT AS start, {LABEL} AS label, {R('total')} AS total FROM f""", "pm")  # fmt: skip
def g24(spark, sf):
    """Targets at the highest peak of each cell; tests hold several peaks of a cycle against a plain loop."""
    return rounded(discovery.target_windows(cycles(spark, sf), ["cell"], 0.55, 12), ["cell", "peak", "start", "label"], ["total"])


@query("g24_spaced_targets")
def g24_spaced(spark, sf):
    return rounded(discovery.target_windows(cycles(spark, sf), ["cell"]), ["cell", "peak", "start", "label"], ["total"])


@query("g3_coarsen", f"SELECT cell // 3 AS i, (month - 1) // 5 AS j, {R('avg(v)')} AS v FROM pm WHERE cell // 3 < 8 AND (month - 1) // 5 < 2 GROUP BY 1, 2", "pm")
def g3(spark, sf):
    grid = month_panel(spark, sf).select(F.col("cell").alias("i"), (F.col("month") - 1).alias("j"), "v")
    return rounded(cube.coarsen(grid, 3, 5), ["i", "j"], ["v"])


E_SQL = "e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS v FROM embeddings), s AS (SELECT vec_id, label, sum(v * v) AS s FROM e GROUP BY 1, 2), m AS (SELECT label, d, avg(v) AS m FROM e GROUP BY 1, 2), q AS (SELECT label, avg(s) AS q, count(*) AS n FROM s GROUP BY 1)"


@query("g10_silhouette_by_label", f"""WITH {E_SQL}, x AS (SELECT e.vec_id, e.label, m.label AS other, sum(e.v * m.m) AS xm FROM e JOIN m USING (d) GROUP BY 1, 2, 3), f AS (SELECT x.vec_id, x.label, other, s - 2 * xm + q AS d, n FROM x JOIN s USING (vec_id) JOIN q ON q.label = other),
o AS (SELECT vec_id, max(d * n / nullif(n - 1, 0)) FILTER (other = label) AS a, min(d) FILTER (other <> label) AS b FROM f GROUP BY 1) SELECT {R('avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0))')} AS silhouette, count(*) AS n FROM o""")  # fmt: skip
def g10(spark, sf):
    return rounded(discovery.squared_silhouette(table(spark, sf, "embeddings"), [], "label", "embedding"), ["n"], ["silhouette"])


@query("g2_eof_scores")
def g2_scores(spark, sf):
    """The five leading singular vectors over all vectors, without their sign."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("cell"), F.posexplode("embedding").alias("col", "v")).withColumn("v", F.col("v").cast("double"))
    return discovery.eof_scores(e).select("cell", "mode", F.round(F.abs("score"), 6).alias("score"))


# --- folds of the week panel -------------------------------------------------------------------------------------------

#: Boxes of the week panel that stand for the index boxes, by cell.
BOX_CELLS = {"nino34": 20, "iod_w": 21, "iod_e": 22, "wpac": 23, "wv": 24}


def year_panel(spark: SparkSession, sf: str) -> DataFrame:
    """(cell, lat, lon, year, month, v): the week panel by years of twelve weeks; a week without orders is 0."""
    w = week_panel(spark, sf)
    every = cells(spark).crossJoin(F.broadcast(w.select("period").distinct()))  # the weeks of the record
    return every.join(w, ["cell", "period"], "left").fillna(0.0, ["v"]).select("cell", "lat", "lon", F.floor(F.col("period") / 12).cast("int").alias("year"), (F.col("period") % 12 + 1).alias("month"), "v")


def panel_folds(spark: SparkSession, field: DataFrame, k: int = 3) -> DataFrame:
    n = field.agg(F.max("year")).first()[0]
    return atlas.folds(spark, cal.walk_forward((n if n is not None else -1) + 1, k))


def prepared(spark: SparkSession, sf: str):
    """field, box series and folds of the week panel, the field written once."""
    field = written(year_panel(spark, sf), "field")
    named = spark.createDataFrame([(c, b) for b, c in BOX_CELLS.items()], "cell int, box string")
    return field, field.join(F.broadcast(named), "cell").select("box", "year", "month", "v"), panel_folds(spark, field)


@query("g6_g7_g17_fold_discovery")
def g17(spark, sf):
    field, _, folds = prepared(spark, sf)
    found = discovery.discover(field, folds)
    return rounded(found.curve.join(found.chosen.withColumnRenamed("k", "chosen"), "fold"), ["fold", "k", "chosen"], ["ari", "ari_sd", "silhouette"])


@query("g17_fold_windows")
def g17_windows(spark, sf):
    field, _, folds = prepared(spark, sf)
    means = discovery.zone_means(field, discovery.discover(field, folds).parts)
    return rounded(discovery.zone_windows(means, folds), ["fold", "zone", "start", "label"], ["total"])


def atlas_scores(spark: SparkSession, sf: str, replicates: int, arms=atlas.ARMS) -> DataFrame:
    field, series, folds = prepared(spark, sf)
    parts = written(discovery.discover(field, folds).parts, "parts")
    return atlas.run_atlas(field, series, folds, parts, indices.INDICES, list(BOX_CELLS), arms, replicates, {"MAM": [3, 4, 5]})


@query("g18_atlas_arms")
def g18(spark, sf):
    s = written(atlas_scores(spark, sf, 0), "scores")
    cover = atlas.coverage(s.where("discovered"), ["arm"], 3)
    return rounded(atlas.atlas_families(s, ["arm"]).join(cover, "arm"), ["family", "arm", "n"], ["rpss", "coverage"])


@query("u7_atlas_switches")
def u7(spark, sf):
    arms = (atlas.Arm("plain"), atlas.Arm("leak", leak=True), atlas.Arm("rainfall", weights="rainfall"))
    s = written(atlas_scores(spark, sf, 0, arms), "scores")
    return rounded(atlas.atlas_families(s, ["arm"]), ["family", "arm", "n"], ["rpss"])


@query("g18_r32_atlas_null")
def g18_null(spark, sf):
    """The three arms on twenty replicates of permuted targets: p of each family, and the verdict."""
    s = written(atlas_scores(spark, sf, 20, atlas.ARMS[:3]), "scores")
    p = inference.permutation_p(atlas.atlas_families(s, ["arm", "replicate"]), ["family", "arm"], "rpss")
    cover = atlas.coverage(s.where("replicate = 0 AND discovered"), ["arm"], 3)
    out = inference.verdict(p.withColumnRenamed("observed", "rpss").join(cover, "arm"))
    return rounded(out, ["family", "arm", "n_null", "verdict"], ["rpss", "p", "coverage"])


def tracked(spark: SparkSession, sf: str):
    field, _, folds = prepared(spark, sf)
    parts = written(discovery.discover(field, folds).parts, "parts")
    return field, folds, parts, written(discovery.tracks(parts, 2), "tracks"), cells(spark)


@query("j13_g13_tracks")
def j13(spark, sf):
    return tracked(spark, sf)[3]


@query("g13_orphans")
def g13(spark, sf):
    _, _, parts, matched, c = tracked(spark, sf)
    return rounded(discovery.stability_metrics(parts, matched, c, 2), ["fold"], ["orphan_area", "absence_share"])


@query("g14_track_stability")
def g14(spark, sf):
    _, _, parts, matched, c = tracked(spark, sf)
    return rounded(discovery.track_stability(discovery.aligned(parts, matched), c), ["zone", "n_folds"], ["agreement", "boundary_variation", "lat_sd", "lon_sd"])


@query("g14_track_recipes_and_skill")
def g14_recipes(spark, sf):
    field, series, folds = prepared(spark, sf)
    parts = written(discovery.discover(field, folds).parts, "parts")
    matched = written(discovery.tracks(parts, 2), "tracks")
    s = written(atlas.run_atlas(field, series, folds, parts, indices.INDICES, list(BOX_CELLS), atlas.ARMS[:1]).where("discovered"), "scores")
    recipes = s.select("fold", "zone", "window", F.substring_index("key", "|", 1).alias("index"), F.substring_index("key", "|", -1).cast("int").alias("lead")).distinct()
    out = discovery.recipe_agreement(recipes, matched, indices.GROUPS).join(discovery.track_skill(s, matched), "zone", "full")
    return rounded(out, ["zone", "n"], ["window_exact", "window_jaccard", "predictor", "predictor_group", "lead", "lead_diff", "rpss"])


WINDOWS = "wi AS (SELECT zone, unnest(range(0, zone + 1)) AS k FROM (SELECT DISTINCT cell % 3 AS zone FROM dim)), wt AS (SELECT zone, k, avg(v) FILTER (month = k + 1) AS total FROM pm JOIN wi ON cell % 3 = zone GROUP BY 1, 2)"


@query("a23_window_weights", f"""WITH a AS (SELECT cell % 3 AS zone, sum(w) AS a FROM dim GROUP BY 1), {WINDOWS}, s AS (SELECT zone, k, total, a / (SELECT sum(a) FROM a) AS share FROM wt JOIN a USING (zone))
SELECT zone::INT AS zone, k::INT AS "window", {R('CASE WHEN k = 0 AND zone > 0 THEN share ELSE share / greatest(zone, 1) END')} AS equal, {R('CASE WHEN k = 0 AND zone > 0 THEN share ELSE share * total / sum(CASE WHEN k > 0 OR zone = 0 THEN total END) OVER (PARTITION BY zone) END')} AS rainfall FROM s""", "dim pm")  # fmt: skip
def a23(spark, sf):
    """Zones of three kinds with one to three windows, the first of several forced."""
    parts = cells(spark).select(F.lit(0).alias("fold"), "cell", (F.col("cell") % 3).alias("zone"))
    windows = parts.select("fold", "zone").distinct().select("fold", "zone", F.explode(F.sequence(F.lit(0), F.col("zone"))).alias("window"))
    level = month_panel(spark, sf).groupBy((F.col("cell") % 3).alias("zone"), (F.col("month") - 1).alias("window")).agg(F.avg("v").alias("total"))
    windows = windows.join(level, ["zone", "window"]).withColumn("discovered", (F.col("window") > 0) | (F.col("zone") == 0))
    by = ["fold", "zone", "window"]
    both = [atlas.window_weights(parts, windows, cells(spark), rule).select(*by, F.col("weight").alias(rule)) for rule in ("equal", "rainfall")]
    return rounded(both[0].join(both[1], by), ["zone", "window"], ["equal", "rainfall"])


@query("r47_planted_field")
def r47(spark, sf):
    """A planted field of two zones: how many zones discovery finds in each fold, and how well they agree with the planted halves."""
    field, _ = benchmarks.two_zone_field(spark, 30, 6, 10)
    field = written(field, "planted")
    folds = atlas.folds(spark, [(list(range(1981, 1981 + a)), list(range(1981 + a, 1981 + a + 5))) for a in (20, 25)])
    found = discovery.discover(field, folds, range(2, 5), 10)
    truth = field.select("cell", (F.col("lon") >= 42.5).cast("int").alias("b")).distinct()
    fit = discovery.adjusted_rand(found.parts.join(truth, "cell").withColumnRenamed("zone", "a"), ["fold"])
    return rounded(found.chosen.join(fit, "fold"), ["fold", "k"], ["ari"])


@query("m7_box_gradients", f"WITH x AS (SELECT period, max(v) FILTER (cell = 20) AS n, max(v) FILTER (cell = 23) AS p, max(v) FILTER (cell = 24) AS w FROM pw GROUP BY 1) SELECT period, {R('p - n')} AS wpg, {R('n - w')} AS wvg, {R('n - (p + w) / 2')} AS two FROM x", "pw")
def m7(spark, sf):
    """Gradients of the boxes: two boxes, and one against the mean of two."""
    named = spark.createDataFrame([(c, b) for b, c in BOX_CELLS.items()], "cell int, box string")
    x = indices.wide(week_panel(spark, sf).join(F.broadcast(named), "cell").select("box", "period", "v"), list(BOX_CELLS), ["period"])
    n, p, w = (F.col(c) for c in ("nino34", "wpac", "wv"))
    return x.select("period", r4(indices.gradient(p, n)).alias("wpg"), r4(indices.gradient(n, w)).alias("wvg"), r4(indices.gradient(n, (p + w) / 2)).alias("two"))


BOXES = "bx AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {s}e0, {n}e0, {w}e0, {e}e0)" for k, (s, n, w, e) in indices.BOXES.items()) + ") t(box, s, n, w, e))"


@query("m6_box_series", f"""WITH {BOXES}, r AS (SELECT box, year, month, sum(dim.w * v) / sum(dim.w) AS m FROM pm JOIN dim USING (cell) JOIN bx ON lat BETWEEN bx.s AND bx.n AND (CASE WHEN bx.e > 360 THEN lon >= bx.w OR lon <= bx.e - 360 ELSE lon BETWEEN bx.w AND bx.e END) GROUP BY 1, 2, 3)
SELECT box, year, month, {R('m - avg(m) FILTER (year BETWEEN 1995 AND 1999) OVER (PARTITION BY box, month)')} AS v FROM r""", "dim pm")  # fmt: skip
def m6_boxes(spark, sf):
    grid = month_panel(spark, sf).join(F.broadcast(cells(spark)), "cell")
    return rounded(indices.box_series(grid, indices.BOXES, 1995, 1999), ["box", "year", "month"], ["v"])


def _standard(b: str) -> str:
    return f"(({b} - avg({b}) FILTER (year < 20) OVER ()) / nullif(stddev_pop({b}) FILTER (year < 20) OVER (), 0))"


@query("u6_m6_fold_predictors", f"""WITH e AS (SELECT cell, period FROM dim CROSS JOIN (SELECT DISTINCT period FROM pw)), f AS (SELECT cell, period // 12 AS year, period % 12 + 1 AS month, coalesce(v, 0) AS v FROM e LEFT JOIN pw USING (cell, period)), x AS (SELECT year, {', '.join(f'CASE WHEN count(v) FILTER (cell = {c}) = 2 THEN avg(v) FILTER (cell = {c}) END AS {b}' for b, c in BOX_CELLS.items())} FROM f WHERE month IN (5, 6) GROUP BY year)
SELECT year::INT AS year, {R('nino34')} AS nino34, {R('iod_w - iod_e')} AS iod, {R(_standard('wpac') + ' - ' + _standard('nino34'))} AS wpg, {R(_standard('nino34') + ' - ' + _standard('wv'))} AS wvg, {R('12 + 323e0 * (iod_w - iod_e) - 193e0 * wpac + 94e0 * nino34')} AS iwhg FROM x""", "dim pw")  # fmt: skip
def u6(spark, sf):
    """Every index before July to September, with constants of the training years (here the first twenty) alone."""
    field = year_panel(spark, sf)
    named = spark.createDataFrame([(c, b) for b, c in BOX_CELLS.items()], "cell int, box string")
    series = field.join(F.broadcast(named), "cell").select("box", "year", "month", "v")
    windows = spark.createDataFrame([("JAS", [7, 8, 9])], "window string, months array<int>")
    folds = field.select("year").distinct().select(F.lit(0).alias("fold"), "year", (F.col("year") < 20).alias("is_train"))
    x = atlas.fold_predictors(atlas.components(series, windows, [0]), folds, indices.INDICES, list(BOX_CELLS))
    wide = x.groupBy("year").pivot("key", [f"{k}|0" for k in indices.INDICES]).agg(F.first("x"))
    return wide.select("year", *[r4(F.col(f"`{k}|0`")).alias(k) for k in indices.INDICES])


@query("a8_area_weighted_seasons", f"WITH a AS (SELECT cell % 3 AS zone, year, month, sum(w * v) / sum(w) AS v FROM pm JOIN dim USING (cell) GROUP BY 1, 2, 3) SELECT zone, year, {R('avg(v)')} AS total FROM a WHERE month IN (6, 7, 8) GROUP BY 1, 2", "dim pm")
def a8(spark, sf):
    f = month_panel(spark, sf).join(F.broadcast(cells(spark)), "cell").withColumn("zone", F.col("cell") % 3)
    mean = f.groupBy("zone", "year", "month").agg((F.sum(area_weight(F.col("lat")) * F.col("v")) / F.sum(area_weight(F.col("lat")))).alias("v"))
    return rounded(cube.calendar_totals(mean, [6, 7, 8], ["zone"], how="mean"), ["zone", "year"], ["total"])
