"""Ranks, skill of rankings, permutation and bootstrap inference, false-discovery control, verdicts."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isopleth.functions.scalar import corr, with_stats

from .regress import loyo


def running_sums(table: DataFrame, by: list[str], order: str, cols: list[str], tie: str | None = None, bins: int = 64) -> DataFrame:
    """table with ``<col>_before``: sums over the rows of the group that come earlier by ``order`` (then ``tie``; equal rows in any order).

    Each group is cut at quantiles of its order, so that a task sorts a part of a group; the parts' own sums are few.
    """
    cut = with_stats(table, by, _edges=F.percentile_approx(order, [k / bins for k in range(1, bins)], 1000))
    cut = cut.withColumn("_bin", F.size(F.filter(F.array_distinct("_edges"), lambda e: e < F.col(order)))).drop("_edges")
    part = cut.groupBy(*by, "_bin").agg(*[F.sum(c).alias(f"_{c}") for c in cols])
    earlier = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(*[F.col(k).alias(f"_key_{k}") for k in by], F.col("_bin").alias("_part"), *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_from_{c}") for c in cols])
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in by], F.col("_bin") == F.col("_part"))
    inside = Window.partitionBy(*by, "_bin").orderBy(*[c for c in (order, tie) if c]).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.join(part, same)
    return out.select(*table.columns, *[(F.col(f"_from_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"{c}_before") for c in cols])


def average_ranks(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, rank): the mean rank from 1 of each distinct value of a group."""
    t = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    return running_sums(t, by, value, ["_n"]).select(*by, value, (F.col("_n_before") + (F.col("_n") + 1) / 2.0).alias("rank"))


def spearman(rows: DataFrame, by: list[str], x: str = "x", y: str = "y", least: int = 4) -> DataFrame:
    """(by, rho, n): correlation of average ranks; null below ``least`` rows. Rows without both values are left out."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))
    ranked = both.join(average_ranks(both, by, "_x").withColumnRenamed("rank", "rx"), [*by, "_x"]).join(average_ranks(both, by, "_y").withColumnRenamed("rank", "ry"), [*by, "_y"])
    return ranked.groupBy(*by).agg(F.when(F.count("*") >= least, corr("rx", "ry")).alias("rho"), F.count("*").alias("n"))


def auc(rows: DataFrame, by: list[str], score: str, positive: Column, tie: str | None = None) -> DataFrame:
    """(by, auc, n_pos, n_neg): Mann-Whitney from average ranks, or from ordinal ranks where a tie-breaking key is named.

    Counts of each score stand in for its rows; rows without a score are left out.
    """
    marked = rows.where(F.col(score).isNotNull()).select(*by, F.col(score).alias("_s"), *([F.col(tie).alias("_t")] if tie else []), positive.cast("long").alias("_p"))
    marked = marked.where("_p IS NOT NULL")
    if tie:
        t = marked.withColumns({"pos": F.col("_p"), "neg": 1 - F.col("_p")})
        below = F.col("neg_before")
    else:
        t = marked.groupBy(*by, "_s").agg(F.sum("_p").alias("pos"), F.sum(1 - F.col("_p")).alias("neg"))
        below = F.col("neg_before") + F.col("neg") / 2.0
    sums = running_sums(t, by, "_s", ["neg"], "_t" if tie else None)
    out = sums.groupBy(*by).agg(F.sum(F.col("pos") * below).alias("u"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return out.select(*by, (F.col("u") / F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0))).alias("auc"), "n_pos", "n_neg")


def groc(rows: DataFrame, by: list[str], score: str, category: str) -> DataFrame:
    """(by, groc): the share of pairs from different categories that the score orders rightly, ties half (after Mason and Weigel).

    Ranks within each pair of categories stand in for the pairs, so that none are enumerated.
    """
    kinds = rows.select(category).distinct().select(F.col(category).alias("other"))  # a few categories
    both = rows.select(*by, F.col(score).alias("s"), F.col(category).alias("c")).join(F.broadcast(kinds), F.col("c") != F.col("other"))
    pairs = both.select(*by, "s", F.least("c", "other").alias("a"), F.greatest("c", "other").alias("b"), (F.col("c") > F.col("other")).alias("up"))
    part = auc(pairs, [*by, "a", "b"], "s", F.col("up")).where((F.col("n_pos") > 0) & (F.col("n_neg") > 0))
    n = F.col("n_pos") * F.col("n_neg")
    return part.groupBy(*by).agg((F.sum(F.col("auc") * n) / F.sum(n)).alias("groc"))


def benjamini_hochberg(rows: DataFrame, by: list[str], p: str = "p", tie: str = "id") -> DataFrame:
    """rows with ``q``: step-up and monotone, clipped at 1, within each family."""
    family = Window.partitionBy(*by)
    ranked = rows.withColumns({"_k": F.row_number().over(family.orderBy(p, tie)), "_m": F.count("*").over(family)})
    down = family.orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("q", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_k")).over(down))).drop("_k", "_m")


def ranked_places(places: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, place, k, n): distinct places with their rank from 1 and their number. Places are years or weeks of a record: a small table."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return places.select(*by, "place").distinct().select(*by, "place", F.row_number().over(w.orderBy("place")).alias("k"), F.count("*").over(w).alias("n"))


def _hash(*parts: str) -> Column:
    return F.md5(F.concat_ws(":", *[F.col(p).cast("string") for p in parts]))


def donors(places: DataFrame, replicates: int, by: list[str] = ()) -> DataFrame:
    """(by, replicate, k, place, donor): a random permutation of the (usable) places for each replicate, the same in any engine; replicate 0 is the identity.

    A replicate's donors are the places in the order of the hash of replicate and place; the k-th of them gives to the k-th
    place. One table serves all series, so that what they have in common stays; with keys (folds), each has the same order
    cut down to its own places. Rows: replicates times places.
    """
    ranked = ranked_places(places, by)
    reps = ranked.sparkSession.range(replicates + 1).select(F.col("id").cast("int").alias("replicate"))
    given = reps.crossJoin(ranked.select(*by, F.col("place").alias("donor")))
    order = Window.partitionBy("replicate", *by).orderBy(F.when(F.col("replicate") == 0, F.col("donor")), _hash("replicate", "donor"))
    return given.withColumn("k", F.row_number().over(order)).join(ranked.select(*by, "k", "place"), [*by, "k"]).select(*by, "replicate", "k", "place", "donor")


def permuted(pairs: DataFrame, moves: DataFrame, by: list[str]) -> DataFrame:
    """(by, replicate, place, x, y): y of each place taken from its donor; all replicates in one join."""
    x = pairs.select(*by, "place", "x")
    y = pairs.select(*by, F.col("place").alias("donor"), "y")
    return x.join(moves.select("replicate", "place", "donor"), "place").join(y, [*by, "donor"])


def permutation_test(pairs: DataFrame, moves: DataFrame, by: list[str], statistic: Callable[[DataFrame, list[str]], DataFrame], two_sided: bool = False) -> DataFrame:
    """permutation_p of any statistic: a function from rows (keys, place, x, y) and the names of the keys to rows (keys, stat)."""
    return permutation_p(statistic(permuted(pairs, moves, by), [*by, "replicate"]), by, two_sided=two_sided)


def correlation_stat(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, stat): the correlation of x and y."""
    return rows.groupBy(*by).agg(corr("x", "y").alias("stat"))


def tail_auc_stat(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, stat): how well a low x tells a y below its mean, as area under the curve less a half."""
    mean = rows.groupBy(*by).agg(F.avg("y").alias("_m"))
    marked = rows.join(mean, by).withColumn("_s", -F.col("x"))
    return auc(marked, by, "_s", F.col("y") < F.col("_m")).select(*by, (F.col("auc") - 0.5).alias("stat"))


def permutation_p(stats: DataFrame, by: list[str], stat: str = "stat", two_sided: bool = False) -> DataFrame:
    """(by, observed, p, n_null, floor): share of replicates at least as good as replicate 0, that one counted."""
    v = F.abs(F.col(stat)) if two_sided else F.col(stat)
    w = Window.partitionBy(*by)
    rows = stats.select(*by, "replicate", v.alias("v"), F.max(F.when(F.col("replicate") == 0, v)).over(w).alias("observed"))
    out = rows.groupBy(*by, "observed").agg(F.count_if(F.col("replicate") > 0).alias("n_null"), F.count_if((F.col("replicate") > 0) & (F.col("v") >= F.col("observed"))).alias("n_over"))
    return out.select(*by, "observed", ((1 + F.col("n_over")) / (1 + F.col("n_null"))).alias("p"), "n_null", (1 / (1 + F.col("n_null"))).alias("floor"))


def best_of_grid(stats: DataFrame, family: list[str], stat: str = "stat") -> DataFrame:
    """(replicate, family..., best): the largest statistic of each replicate at the family's grains, finest and all but its last key, in one pass."""
    keys = [F.col(c) for c in ("replicate", *family)]
    return stats.groupingSets([keys, keys[:-1]], *keys).agg(F.max(stat).alias("best"))


def resamples(places: DataFrame, reps: int) -> DataFrame:
    """(rep, draw, place): as many draws with replacement as there are places, for each replicate, by a hash: the same in any engine."""
    ranked = ranked_places(places)
    grid = ranked.sparkSession.range(reps).select(F.col("id").cast("int").alias("rep")).crossJoin(ranked.select((F.col("k") - 1).alias("draw"), "n"))
    k = F.conv(F.substring(_hash("rep", "draw"), 1, 15), 16, 10).cast("long") % F.col("n") + 1
    return grid.select("rep", "draw", k.cast("int").alias("k")).join(ranked.select("k", "place"), "k").select("rep", "draw", "place")


def _usable(v: str) -> Column:
    return F.col(v).isNotNull() & ~F.isnan(v)


def bootstrap(pairs: DataFrame, draws: DataFrame, by: list[str], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(by, lo, hi, n_ok): percentile interval of the correlation of x and y; replicates without spread are left out."""
    r = pairs.join(draws, "place").groupBy(*by, "rep").agg(corr("x", "y").alias("r")).where(_usable("r"))
    return r.groupBy(*by).agg(F.percentile("r", low).alias("lo"), F.percentile("r", high).alias("hi"), F.count("r").alias("n_ok"))


def _gaps(rows: DataFrame, draws: DataFrame, by: list[str]) -> DataFrame:
    """(by, rep, g): the correlation of x1 with y less that of x2, on shared draws."""
    return rows.join(draws, "place").groupBy(*by, "rep").agg((corr("x1", "y") - corr("x2", "y")).alias("g")).where(_usable("g"))


def bootstrap_gap(pairs: DataFrame, draws: DataFrame, by: list[str]) -> DataFrame:
    """(by, p_not_better, gap): of two predictors x1 and x2 of y on shared draws: mean gain in correlation of x1, and how often there is none."""
    return _gaps(pairs, draws, by).groupBy(*by).agg(F.avg((F.col("g") <= 0).cast("double")).alias("p_not_better"), F.avg("g").alias("gap"))


def bootstrap_gain(rows: DataFrame, draws: DataFrame, by: list[str], level: float = 0.8) -> DataFrame:
    """(by, lo, hi, n_ok): interval of the gain of x1 over x2 in the correlation of left-out predictions with y. rows: (by, place, x1, x2, y).

    Predictions leave their own place out of the regression, so that the interval belongs to the same statistic as the skill.
    """
    ok = rows.where(F.col("x1").isNotNull() & F.col("x2").isNotNull() & F.col("y").isNotNull())
    one = loyo(ok.withColumnRenamed("x1", "x"), by).select(*by, "place", "x2", "y", F.col("loo").alias("x1"))
    two = loyo(one.withColumnRenamed("x2", "x"), by).select(*by, "place", "x1", "y", F.col("loo").alias("x2"))
    return gap_interval(two, draws, by, level)


def gap_interval(rows: DataFrame, draws: DataFrame, by: list[str], level: float = 0.8) -> DataFrame:
    """(by, lo, hi, n_ok): interval of the correlation of x1 with y less that of x2, on shared draws."""
    out = _gaps(rows, draws, by).groupBy(*by)
    return out.agg(F.percentile("g", (1 - level) / 2).alias("lo"), F.percentile("g", (1 + level) / 2).alias("hi"), F.count("g").alias("n_ok"))


def bootstrap_groc_gap(rows: DataFrame, draws: DataFrame, by: list[str], score: str, other: str, category: str) -> DataFrame:
    """(by, lo, hi, gap, p_not_better): of two scores' generalised areas under the curve on blocks (places) drawn together: interval and mean of their gap.

    Blocks are drawn whole, so that rows of one place stay together.
    """
    drawn = rows.join(draws, "place")
    keys = [*by, "rep"]
    a, b = (groc(drawn, keys, s, category).withColumnRenamed("groc", n) for s, n in ((score, "a"), (other, "b")))
    g = a.join(b, keys).select(*by, (F.col("a") - F.col("b")).alias("g"))
    return g.groupBy(*by).agg(F.percentile("g", 0.025).alias("lo"), F.percentile("g", 0.975).alias("hi"), F.avg("g").alias("gap"), F.avg((F.col("g") <= 0).cast("double")).alias("p_not_better"))


def williams(rows: DataFrame) -> DataFrame:
    """rows (r1, r2, r12, n) with ``t`` of Williams' test that two dependent correlations are equal; null below five rows. It has n - 3 degrees."""
    det = 1 - F.pow("r1", F.lit(2)) - F.pow("r2", F.lit(2)) - F.pow("r12", F.lit(2)) + 2 * F.col("r1") * F.col("r2") * F.col("r12")
    mean = (F.col("r1") + F.col("r2")) / 2
    under = 2 * (F.col("n") - 1) / (F.col("n") - 3) * det + mean * mean * F.pow(1 - F.col("r12"), F.lit(3))
    return rows.withColumn("t", F.when(F.col("n") >= 5, (F.col("r1") - F.col("r2")) * F.sqrt(F.try_divide((F.col("n") - 1) * (1 + F.col("r12")), under))))


def _average_ranks(v: np.ndarray) -> np.ndarray:
    _, at, n = np.unique(v, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[at]


def exact_spearman_p(x: list[float], y: list[float], most: int = 200_000, draws: int = 5000, seed: int = 0) -> tuple[float, float]:
    """(rho, one-sided p), by all permutations where there are at most ``most``, else by draws. No spread in x or y: (nan, nan)."""
    rx, ry = (_average_ranks(np.asarray(v, float)) for v in (x, y))
    n = len(rx)
    if n < 2 or rx.std() == 0 or ry.std() == 0:
        return float("nan"), float("nan")
    a, b = (rx - rx.mean()) / rx.std() / n, (ry - ry.mean()) / ry.std()
    rho = float(a @ b)
    if math.factorial(min(n, 20)) <= most:
        return rho, float(np.mean([a @ b[list(p)] >= rho - 1e-12 for p in itertools.permutations(range(n))]))
    rng = np.random.default_rng(seed)
    return rho, float((1 + sum(a @ rng.permutation(b) >= rho - 1e-12 for _ in range(draws))) / (1 + draws))


def exact_spearman(rows: DataFrame, by: list[str], most: int = 200_000) -> DataFrame:
    """(by, rho, p, n) of many small groups (x, y), a group a task's call; a group without spread has nulls."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ok = pdf.dropna(subset=["x", "y"]).sort_values(["x", "y"])
        rho, p = exact_spearman_p(ok["x"].tolist(), ok["y"].tolist(), most)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "rho": [rho], "p": [p], "n": [len(ok)]})

    keys = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c in by)
    out = rows.groupBy(*by).applyInPandas(one, f"{keys}, rho double, p double, n long")
    return out.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in ("rho", "p")})


def dedup_family(rows: DataFrame, derived: list[str], composite: list[str], cluster: Column) -> DataFrame:
    """(season, cluster, q): families without composite bands and derived predictors, then the least q of each season and cluster."""
    kept = rows.where(~F.col("predictor").isin(derived) & ~F.col("band").isin(composite)).withColumn("cluster", cluster)
    return kept.groupBy("season", "cluster").agg(F.min("q").alias("q"))


def verdict(rows: DataFrame, alpha: float = 0.05, coverage: float = 0.5) -> DataFrame:
    """rows (rpss, p, coverage) with ``verdict``: USEFUL only with positive skill, a small p and enough coverage."""
    good = (F.col("rpss") > 0) & (F.col("p") <= alpha)
    return rows.withColumn("verdict", F.when(good & (F.col("coverage") >= coverage), "USEFUL").when(good, "LOW COVERAGE").otherwise("NOT"))
