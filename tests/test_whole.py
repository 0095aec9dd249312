"""Queries over whole tables and panels, held against brute force."""

import hashlib
import itertools
import re

import numpy as np
import pyarrow.parquet as pq
from isopleth.operators import inference
from isopleth.plans import base, fields, models, more, nulls, stats, zones  # noqa: F401

SF = "/root/testdata/sf0.01"


def rows(spark, name):
    return base.QUERIES[name](spark, SF).collect()


def test_groc_of_all_orders(spark):
    o = pq.read_table(f"{SF}/orders.parquet").to_pandas()
    got = {r.g: r.groc for r in rows(spark, "groc_three_categories")}
    assert set(got) == set(o["o_orderpriority"])
    for g, part in o.groupby("o_orderpriority"):
        s, c = part["o_totalprice"].to_numpy(), part["o_orderkey"].to_numpy() % 3
        right = total = 0
        for a in range(3):
            for b in range(a + 1, 3):
                x, y = s[c == a][:, None], s[c == b][None, :]
                right += (y > x).sum() + 0.5 * (y == x).sum()
                total += x.size * y.size
        assert abs(got[g] - right / total) < 1e-4


def panel(spark):
    w = stats.pairs(spark, SF).toPandas()
    return w, int(stats.week_panel(spark, SF).toPandas()["period"].max()) + 1


def test_permutation_p_over_all_weeks(spark):
    p, n = panel(spark)
    order = lambda r: sorted(range(n), key=lambda k: hashlib.md5(f"{r}:{k}".encode()).hexdigest())
    weeks = np.sort(p["year"].unique())
    assert n > 300 and len(weeks) == n
    got = {r.cell: (r.observed, r.p, r.n_null) for r in rows(spark, "r29_j10_permutation_p")}
    assert set(got) == set(p["cell"])
    moves = [order(r) for r in range(1, 51)]
    for cell, part in list(p.groupby("cell"))[:5]:
        x, y = np.full(n, np.nan), np.full(n, np.nan)
        x[part["year"]], y[part["year"]] = part["x"], part["y"]
        found = []
        for to in [list(range(n)), *moves]:
            moved = y[to]
            both = ~np.isnan(x) & ~np.isnan(moved)
            found.append(np.corrcoef(x[both], moved[both])[0, 1])
        want = (1 + sum(v >= found[0] for v in found[1:])) / 51
        assert abs(got[cell][0] - found[0]) < 1e-4 and abs(got[cell][1] - want) < 1e-4 and got[cell][2] == 50


def test_bootstrap_over_all_weeks(spark):
    p, n = panel(spark)
    got = {r.cell: (r.lo, r.hi) for r in rows(spark, "r26_r27_bootstrap_interval")}
    place = lambda r, d: int(hashlib.md5(f"{r}:{d}".encode()).hexdigest()[:15], 16) % n
    for cell, part in list(p.groupby("cell"))[:5]:
        at = {int(y): k for k, y in enumerate(part["year"])}
        x, y, found = part["x"].to_numpy(), part["y"].to_numpy(), []
        for r in range(40):
            k = [at[q] for q in (place(r, d) for d in range(n)) if q in at]
            found.append(np.corrcoef(x[k], y[k])[0, 1])
        assert np.allclose(got[cell], np.percentile(found, (2.5, 97.5)), atol=1e-4)


def test_replicates_are_distinct_permutations_of_the_usable_places(spark):
    usable = [3, 4, 7, 8, 9, 11, 20, 21, 22, 25, 26, 27]
    moves = inference.donors(spark.createDataFrame([(k,) for k in usable], "place int"), 200).toPandas().sort_values(["replicate", "place"])
    maps = [tuple(g["donor"]) for _, g in moves.groupby("replicate")]
    assert len(maps) == 201 == len(set(maps)) and maps[0] == tuple(usable)
    assert all(sorted(m) == usable for m in maps) and all(list(g["place"]) == usable for _, g in moves.groupby("replicate"))
    shifts = {tuple((usable.index(b) - usable.index(a)) % len(usable) for a, b in zip(usable, m)) for m in maps[1:]}
    assert len(shifts) > 190  # not one order that is only shifted
    draws = inference.resamples(spark.createDataFrame([(k,) for k in usable], "place int"), 100).toPandas()
    assert (draws.groupby("rep").size() == len(usable)).all() and set(draws["place"]) == set(usable)
    assert len({tuple(sorted(g["place"])) for _, g in draws.groupby("rep")}) > 95


def test_p_is_uniform_without_signal(spark):
    rng = np.random.default_rng(8)
    n, series = 30, 300
    pairs = spark.createDataFrame([(c, k, float(x), float(y)) for c in range(series) for k, (x, y) in enumerate(rng.normal(size=(n, 2)))], "cell int, place int, x double, y double")
    moves = inference.donors(pairs.select("place").distinct(), 99)
    for statistic, two_sided in ((inference.correlation_stat, False), (inference.tail_auc_stat, True)):
        p = np.sort([r.p for r in inference.permutation_test(pairs, moves, ["cell"], statistic, two_sided).collect()])
        assert len(p) == series and np.abs(p - np.arange(1, series + 1) / series).max() < 0.11


def test_exact_spearman_of_groups(spark):
    rng = np.random.default_rng(5)
    data = [(g, float(x), float(y)) for g in range(4) for x, y in rng.integers(0, 5, size=(6, 2))] + [(9, 1.0, float(k)) for k in range(5)]
    got = {r.g: r for r in inference.exact_spearman(spark.createDataFrame(data, "g int, x double, y double"), ["g"]).collect()}
    rank = lambda v: [(sum(b < a for b in v) + (sum(b <= a for b in v) + 1)) / 2 for a in v]
    for g in range(4):
        x, y = (rank([r[k] for r in data if r[0] == g]) for k in (1, 2))
        every = [np.corrcoef(x, p)[0, 1] for p in itertools.permutations(y)]
        assert abs(got[g].rho - every[0]) < 1e-9 and abs(got[g].p - np.mean(np.array(every) >= every[0] - 1e-12)) < 1e-9
    assert got[9].rho is None and got[9].p is None and got[9].n == 5


def test_no_week_or_cell_is_left_out(spark):
    p, n = panel(spark)
    assert {(r.cell, r.year) for r in rows(spark, "r46_logit_terciles")} == set(zip(p["cell"], p["year"]))
    assert {(r.cell, r.n) for r in rows(spark, "u3_method_search")} == {(c, len(x)) for c, x in p.groupby("cell")}
    assert len({r.cell for r in rows(spark, "r40_arima")}) == 5 and {r.n for r in rows(spark, "r41_arima_skill")} <= set(range(1, 21))
    assert max(r.year for r in rows(spark, "g20_fixed_mean")) == n - 1
    assert {r.g for r in rows(spark, "r16_top_combo")} == set(range(25)) and min(r.n for r in rows(spark, "r16_top_combo")) > 40
    assert {r.cell for r in rows(spark, "u3_cca_left_out")} == set(range(1, 25, 2))
    assert rows(spark, "g21_gridded") and rows(spark, "r43_persistence_sensitivity")
    assert len(rows(spark, "r7_batched_features")) == 625


def test_gram_of_all_columns(spark):
    e = np.array(pq.read_table(f"{SF}/embeddings.parquet")["embedding"].to_pylist(), float)
    got = {(r.a, r.b): r.g for r in rows(spark, "g2_gram")}
    want = e.T @ e
    assert len(got) == 64 * 65 // 2
    assert all(abs(g - want[a, b]) < 1e-3 for (a, b), g in got.items())


def test_slug_of_the_whole_url(spark):
    urls = dict(zip(*(pq.read_table(f"{SF}/pages.parquet")[c].to_pylist() for c in ("page_id", "url"))))
    got = {r.page_id: r.slug for r in rows(spark, "f23_slug")}
    assert got == {k: re.sub("[^a-z0-9]+", "-", u.lower()).strip("-")[:80] for k, u in urls.items()}
    assert any(len(u) > 40 and len(got[k]) > 40 for k, u in urls.items())
