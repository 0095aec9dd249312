"""Queries over permutation nulls, bootstraps, false-discovery families and verdicts.

Draws and donors come from hashes that DuckDB makes alike, and cover all weeks of the panel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isopleth.functions import prob
from isopleth.functions.scalar import corr, r4
from isopleth.operators import atlas, inference
from isopleth.sources.panels import month_panel, week_panel

from .base import R, query
from .stats import GROC, PAIRS, pairs, places, rounded

REPLICATES, DRAWN = 50, 40
PLACES = "pl AS (SELECT p, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT period AS p FROM pw))"
DRAWS = f"{PLACES}, dr AS (SELECT r AS rep, ('0x' || substr(md5(r || ':' || d), 1, 15))::BIGINT % n + 1 AS k FROM range(0, {DRAWN}) a(r), (SELECT n, k - 1 AS d FROM pl)), draws AS (SELECT rep, p AS year FROM dr JOIN pl USING (k))"
DONOR = f"{PLACES}, gv AS (SELECT r::INT AS replicate, p AS donor, row_number() OVER (PARTITION BY r ORDER BY CASE WHEN r = 0 THEN p END, md5(r || ':' || p)) AS k FROM range(0, {REPLICATES + 1}) a(r), pl), don AS (SELECT replicate, k, p AS year, donor FROM gv JOIN pl USING (k))"
MOVED = f"{PAIRS}, {DONOR}, mv AS (SELECT x.cell, don.replicate, x.x, y.y FROM pairs x JOIN don USING (year) JOIN pairs y ON y.cell = x.cell AND y.year = don.donor)"
PERM = f"{MOVED}, st AS (SELECT cell, replicate, corr(x, y) AS stat FROM mv GROUP BY 1, 2)"


def p_value(stat: str) -> str:
    return f"(1e0 + count(*) FILTER (replicate > 0 AND {stat} >= observed)) / (1 + count(*) FILTER (replicate > 0))"


PV = f"{PERM}, o AS (SELECT cell, stat AS observed FROM st WHERE replicate = 0), pv AS (SELECT cell, observed, {p_value('stat')} AS p, count(*) FILTER (replicate > 0) AS n_null FROM st JOIN o USING (cell) GROUP BY cell, observed)"
QV = f"{PV}, qk AS (SELECT *, row_number() OVER (PARTITION BY cell % 4 ORDER BY p, cell) AS k, count(*) OVER (PARTITION BY cell % 4) AS m FROM pv), qv AS (SELECT cell, p, least(1, min(p * m / k) OVER (PARTITION BY cell % 4 ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS q FROM qk)"


def placed(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).withColumnRenamed("year", "place")


def moves(spark: SparkSession, sf: str) -> DataFrame:
    return inference.donors(places(spark, sf), REPLICATES)


def null_stats(spark: SparkSession, sf: str) -> DataFrame:
    return inference.correlation_stat(inference.permuted(placed(spark, sf), moves(spark, sf), ["cell"]), ["cell", "replicate"])


def q_values(spark: SparkSession, sf: str) -> DataFrame:
    """(cell, p, fam, q): permutation p of every cell and its q in one of four families."""
    p = inference.permutation_p(null_stats(spark, sf), ["cell"]).withColumn("fam", F.col("cell") % 4)
    return inference.benjamini_hochberg(p, ["fam"], tie="cell")


@query("r26_r27_bootstrap_interval", f"WITH {PAIRS}, {DRAWS}, b AS (SELECT cell, rep, corr(x, y) AS r FROM pairs JOIN draws USING (year) GROUP BY 1, 2) SELECT cell, {R('quantile_cont(r, 0.025)')} AS lo, {R('quantile_cont(r, 0.975)')} AS hi, count(r) AS n_ok FROM b WHERE NOT isnan(r) GROUP BY cell", "pw")
def r27(spark, sf):
    return rounded(inference.bootstrap(placed(spark, sf), inference.resamples(places(spark, sf), DRAWN), ["cell"]), ["cell", "n_ok"], ["lo", "hi"])


THREE = "t AS (SELECT a.cell, a.period AS year, a.v AS y, b.v AS x1, c.v AS x2 FROM pw a JOIN pw b ON b.cell = (a.cell + 1) % 25 AND b.period = a.period JOIN pw c ON c.cell = (a.cell + 2) % 25 AND c.period = a.period)"


def three(spark: SparkSession, sf: str) -> DataFrame:
    """(cell, place, y, x1, x2): a cell's weeks with those of the next two cells."""
    w = week_panel(spark, sf)
    shifted = lambda k, name: w.select(F.pmod(F.col("cell") - k, F.lit(25)).alias("cell"), "period", F.col("v").alias(name))
    return w.withColumnRenamed("v", "y").join(shifted(1, "x1"), ["cell", "period"]).join(shifted(2, "x2"), ["cell", "period"]).withColumnRenamed("period", "place")


def _left_out(x: str) -> str:
    return f"y - (y - avg(y) OVER w - regr_slope(y, {x}) OVER w * ({x} - avg({x}) OVER w)) / greatest(1 - 1e0 / count(*) OVER w - ({x} - avg({x}) OVER w) ** 2 / nullif(regr_sxx(y, {x}) OVER w, 0), 1e-12)"


@query("r26_gain_interval", f"""WITH {THREE}, l AS (SELECT cell, year, y, {_left_out('x1')} AS p1, {_left_out('x2')} AS p2 FROM t WINDOW w AS (PARTITION BY cell)), {DRAWS},
g AS (SELECT cell, rep, corr(p1, y) - corr(p2, y) AS g FROM l JOIN draws USING (year) GROUP BY 1, 2) SELECT cell, {R('quantile_cont(g, 0.1)')} AS lo, {R('quantile_cont(g, 0.9)')} AS hi, count(g) AS n_ok FROM g WHERE NOT isnan(g) GROUP BY cell""", "pw")  # fmt: skip
def r26(spark, sf):
    return rounded(inference.bootstrap_gain(three(spark, sf), inference.resamples(places(spark, sf), DRAWN), ["cell"]), ["cell", "n_ok"], ["lo", "hi"])


@query("r28_block_bootstrap_gap", f"""WITH {THREE}, {DRAWS},
g AS (SELECT cell, rep, corr(x1, y) - corr(x2, y) AS g FROM t JOIN draws USING (year) GROUP BY 1, 2) SELECT cell, {R('avg((g <= 0)::INT::DOUBLE)')} AS p_not_better, {R('avg(g)')} AS gap FROM g WHERE NOT isnan(g) GROUP BY cell""", "pw")  # fmt: skip
def r28(spark, sf):
    return rounded(inference.bootstrap_gap(three(spark, sf), inference.resamples(places(spark, sf), DRAWN), ["cell"]), ["cell"], ["p_not_better", "gap"])


BLOCKS = "ca AS (SELECT cell, year, x1, x2, CASE WHEN quantile_cont(y, 1e0/3) OVER w > y THEN 0 WHEN quantile_cont(y, 2e0/3) OVER w > y THEN 1 ELSE 2 END AS c FROM t WINDOW w AS (PARTITION BY cell))"


@query("r28_block_bootstrap_groc_gap", f"""WITH {THREE}, {BLOCKS}, {DRAWS}, dd AS (SELECT * FROM ca JOIN draws USING (year)), one AS (WITH {GROC.format(g='cell, rep', b='b AS (SELECT cell, rep, x1 AS s, c FROM dd)')} SELECT * FROM groc),
two AS (WITH {GROC.format(g='cell, rep', b='b AS (SELECT cell, rep, x2 AS s, c FROM dd)')} SELECT * FROM groc), g AS (SELECT cell, one.groc - two.groc AS g FROM one JOIN two USING (cell, rep))
SELECT cell, {R('quantile_cont(g, 0.025)')} AS lo, {R('quantile_cont(g, 0.975)')} AS hi, {R('avg(g)')} AS gap, {R('avg((g <= 0)::INT::DOUBLE)')} AS p_not_better FROM g GROUP BY cell""", "pw")  # fmt: skip
def r28_groc(spark, sf):
    w = Window.partitionBy("cell")
    rows = three(spark, sf).withColumn("c", prob.tercile(F.col("y"), F.percentile("y", F.lit(1 / 3)).over(w), F.percentile("y", F.lit(2 / 3)).over(w)))
    out = inference.bootstrap_groc_gap(rows, inference.resamples(places(spark, sf), DRAWN), ["cell"], "x1", "x2", "c")
    return rounded(out, ["cell"], ["lo", "hi", "gap", "p_not_better"])


@query("r29_j10_permutation_p", f"WITH {PV} SELECT cell, {R('observed')} AS observed, {R('p')} AS p, n_null FROM pv", "pw")
def r29(spark, sf):
    return rounded(inference.permutation_p(null_stats(spark, sf), ["cell"]), ["cell", "n_null"], ["observed", "p"])


@query("r30_two_sided_shared_null", f"""WITH {MOVED}, a AS (SELECT cell, replicate, abs(corr(x, y)) AS stat FROM mv GROUP BY 1, 2), m AS (SELECT *, (y < avg(y) OVER (PARTITION BY cell, replicate))::INT AS dry FROM mv),
k AS (SELECT *, rank() OVER (PARTITION BY cell, replicate ORDER BY -x) + (count(*) OVER (PARTITION BY cell, replicate, x) - 1) / 2e0 AS r FROM m),
b AS (SELECT cell, replicate, abs((sum(r * dry) - sum(dry) * (sum(dry) + 1) / 2e0) / nullif(sum(dry) * sum(1 - dry), 0) - 5e-1) AS stat FROM k GROUP BY 1, 2),
st AS (SELECT 'correlation' AS mode, * FROM a UNION ALL SELECT 'dry tail', * FROM b), o AS (SELECT mode, cell, stat AS observed FROM st WHERE replicate = 0)
SELECT mode, cell, {R('observed')} AS observed, {R(p_value('stat'))} AS p FROM st JOIN o USING (mode, cell) GROUP BY mode, cell, observed""", "pw")  # fmt: skip
def r30(spark, sf):
    modes = {"correlation": inference.correlation_stat, "dry tail": inference.tail_auc_stat}
    both = [inference.permutation_test(placed(spark, sf), moves(spark, sf), ["cell"], f, two_sided=True).withColumn("mode", F.lit(m)) for m, f in modes.items()]
    return rounded(both[0].unionByName(both[1]), ["mode", "cell"], ["observed", "p"])


@query("u4_statistic_as_argument", f"WITH {MOVED}, st AS (SELECT cell, replicate, -avg(abs(x - y)) AS stat FROM mv GROUP BY 1, 2), o AS (SELECT cell, stat AS observed FROM st WHERE replicate = 0) SELECT cell, {R('observed')} AS observed, {R(p_value('stat'))} AS p FROM st JOIN o USING (cell) GROUP BY cell, observed", "pw")
def u4(spark, sf):
    closeness = lambda rows, by: rows.groupBy(*by).agg((-F.avg(F.abs(F.col("x") - F.col("y")))).alias("stat"))
    return rounded(inference.permutation_test(placed(spark, sf), moves(spark, sf), ["cell"], closeness), ["cell"], ["observed", "p"])


@query("r31_best_of_grid", f"WITH {PERM} SELECT replicate, cell % 2 AS a, CASE WHEN grouping(cell % 3) = 1 THEN NULL ELSE cell % 3 END AS b, {R('max(stat)')} AS best FROM st GROUP BY GROUPING SETS ((replicate, cell % 2), (replicate, cell % 2, cell % 3))", "pw")
def r31(spark, sf):
    s = null_stats(spark, sf).withColumns({"a": F.col("cell") % 2, "b": F.col("cell") % 3})
    return rounded(inference.best_of_grid(s, ["a", "b"]), ["replicate", "a", "b"], ["best"])


@query("r31_best_of_grid_p", f"WITH {PERM}, b AS (SELECT replicate, cell % 2 AS a, max(stat) AS best FROM st GROUP BY 1, 2), o AS (SELECT a, best AS observed FROM b WHERE replicate = 0) SELECT a, {R('observed')} AS observed, {R(p_value('best'))} AS p FROM b JOIN o USING (a) GROUP BY a, observed", "pw")
def r31_p(spark, sf):
    s = null_stats(spark, sf).withColumns({"a": F.col("cell") % 2, "b": F.col("cell") % 3})
    best = inference.best_of_grid(s, ["a", "b"]).where("b IS NULL")
    return rounded(inference.permutation_p(best, ["a"], "best"), ["a"], ["observed", "p"])


@query("r33_field_permutation", f"WITH {DONOR} SELECT replicate, cell, {R('sum(round(v * 1e8)::BIGINT) / 1e8')} AS total FROM pw JOIN don ON pw.period = don.donor WHERE don.k <= (SELECT max(n) FROM pl) / 2 GROUP BY 1, 2", "pw")
def r33(spark, sf):
    m = moves(spark, sf)  # totals over the first half of the places, which the permutation fills from all of them
    half = m.agg((F.max("k") / 2).alias("half"))
    given = m.crossJoin(F.broadcast(half)).where("k <= half").select("replicate", F.col("donor").alias("period"))  # one row on the other side
    return rounded(week_panel(spark, sf).join(given, "period").groupBy("replicate", "cell").agg((F.sum(F.round(F.col("v") * 1e8).cast("long")) / 1e8).alias("total")), ["replicate", "cell"], ["total"])


@query("r34_w9_benjamini_hochberg", f"WITH {QV} SELECT cell, {R('p')} AS p, {R('q')} AS q FROM qv", "pw")
def r34(spark, sf):
    return rounded(q_values(spark, sf), ["cell"], ["p", "q"])


@query("r35_dedup_family", f"WITH {QV} SELECT cell % 3 AS season, cell % 5 AS cluster, {R('min(q)')} AS q FROM qv WHERE cell NOT IN (3, 4) AND cell // 5 <> 0 GROUP BY 1, 2", "pw")
def r35(spark, sf):
    rows = q_values(spark, sf).select((F.col("cell") % 3).alias("season"), F.floor(F.col("cell") / 5).cast("string").alias("band"), F.col("cell").cast("string").alias("predictor"), "q")
    return rounded(inference.dedup_family(rows, ["3", "4"], ["0"], F.col("predictor").cast("int") % 5), ["season", "cluster"], ["q"])


@query("a22_survivor_counts", f"WITH {QV} SELECT cell % 4 AS fam, count(*) AS m, count(*) FILTER (q <= 0.1e0) AS n10, count(*) FILTER (q <= 0.5e0) AS n50 FROM qv GROUP BY 1", "pw")
def a22(spark, sf):
    return q_values(spark, sf).groupBy("fam").agg(F.count("*").alias("m"), F.count_if(F.col("q") <= 0.1).alias("n10"), F.count_if(F.col("q") <= 0.5).alias("n50"))


ARMS = f"{PERM}, ar AS (SELECT cell % 3 AS arm, replicate, avg(stat) AS rpss FROM st GROUP BY 1, 2)"
COVER = "cv AS (SELECT cell % 3 AS arm, count(*)::DOUBLE / (count(DISTINCT cell) * (SELECT max(n) FROM pl)) AS coverage FROM pairs GROUP BY 1)"


@query("r38_verdict", f"""WITH {ARMS}, {COVER}, o AS (SELECT arm, rpss AS observed FROM ar WHERE replicate = 0), v AS (SELECT arm, observed, {p_value('rpss')} AS p FROM ar JOIN o USING (arm) GROUP BY arm, observed)
SELECT arm, {R('observed')} AS rpss, {R('p')} AS p, {R('coverage')} AS coverage, CASE WHEN observed > 0 AND p <= 0.05e0 THEN CASE WHEN coverage >= 0.5e0 THEN 'USEFUL' ELSE 'LOW COVERAGE' END ELSE 'NOT' END AS verdict FROM v JOIN cv USING (arm)""", "pw")  # fmt: skip
def r38(spark, sf):
    arms = null_stats(spark, sf).groupBy((F.col("cell") % 3).alias("arm"), "replicate").agg(F.avg("stat").alias("rpss"))
    n = places(spark, sf).agg(F.count("*").alias("n"))
    cover = placed(spark, sf).groupBy((F.col("cell") % 3).alias("arm")).agg(F.count("*").alias("rows"), F.count_distinct("cell").alias("cells")).crossJoin(F.broadcast(n)).select("arm", (F.col("rows") / (F.col("cells") * F.col("n"))).alias("coverage"))
    out = inference.verdict(inference.permutation_p(arms, ["arm"], "rpss").withColumnRenamed("observed", "rpss").join(cover, "arm"))
    return rounded(out, ["arm", "verdict"], ["rpss", "p", "coverage"])


@query("r39_paired_arms", f"""WITH {ARMS}, d AS (SELECT replicate, max(rpss) FILTER (arm = 0) - max(rpss) FILTER (arm = 1) AS diff FROM ar GROUP BY replicate), o AS (SELECT diff AS observed FROM d WHERE replicate = 0)
SELECT {R('observed')} AS observed, {R(p_value('diff'))} AS p, count(*) FILTER (replicate > 0) AS n_null FROM d, o GROUP BY observed""", "pw")  # fmt: skip
def r39(spark, sf):
    arms = null_stats(spark, sf).groupBy((F.col("cell") % 3).cast("string").alias("arm"), "replicate").agg(F.avg("stat").alias("rpss"))
    out = inference.permutation_p(atlas.paired(arms, "0", "1").withColumn("g", F.lit(0)), ["g"], "diff")
    return rounded(out, ["n_null"], ["observed", "p"])


@query("r37_exact_spearman")
def r37(spark, sf):
    """Every cell's yearly totals against the next cell's: seven or eight years, so that all their orders can be tried."""
    t = month_panel(spark, sf).groupBy("cell", "year").agg(F.sum("v").alias("y"))
    rows = t.join(t.select(F.pmod(F.col("cell") - 1, F.lit(25)).alias("cell"), "year", F.col("y").alias("x")), ["cell", "year"])
    return rounded(inference.exact_spearman(rows, ["cell"]), ["cell", "n"], ["rho", "p"])


@query("f11_minimum_sample", f"WITH {PAIRS} SELECT cell, year % 8 AS part, count(*) AS n, {R('corr(x, y)')} AS r FROM pairs GROUP BY 1, 2 HAVING count(*) >= 25", "pw")
def f11(spark, sf):
    rows = pairs(spark, sf).groupBy("cell", (F.col("year") % 8).alias("part")).agg(F.count("*").alias("n"), r4(corr("x", "y")).alias("r"))
    return rows.where("n >= 25")
