"""k-means, its seeds and silhouettes over blocks against the same in one place."""

import numpy as np
import pytest

from isopleth.operators import discovery
from isopleth.operators.kmeans import FAN, Blocks, distances, fitted, fitted_apart, lloyd


@pytest.fixture(scope="module")
def dealt(spark):
    """Two sets of points in over FAN blocks, in no order, scaled by set."""
    rng = np.random.default_rng(2)
    data, rows, scale = {}, [], {}
    for name in (0, 5):
        x = rng.normal(size=(210, 3)) + 4 * rng.integers(0, 3, size=(210, 1))
        ids = rng.permutation(210)
        scale[name] = (np.full(3, float(name)), np.array([1.0, 0.5, 2.0]))
        data[name] = (x - scale[name][0]) * scale[name][1]
        for block, part in enumerate(np.array_split(ids, FAN + 3)):
            rows.append((name, block, part.tolist(), x[part].ravel().tolist()))
    frame = spark.createDataFrame(rows, "set long, block long, ids array<long>, x array<double>").repartition(4)
    return data, Blocks(frame, 3, scale)


def test_centres_are_those_of_one_place(dealt):
    data, blocks = dealt
    best, apart = (f(blocks, {0: 0, 5: 7}, [2, 3, 5], starts=4) for f in (fitted, fitted_apart))
    assert all(np.allclose(best[name][k], apart[name][k]) for name in best for k in (2, 3, 5))
    for name, seed in ((0, 0), (5, 7)):
        for k in (2, 3, 5):
            label, inertia = lloyd(data[name], k, starts=4, seed=seed)
            d = distances(data[name], best[name][k])
            assert d.min(1).sum() == pytest.approx(inertia) and discovery.ari(d.argmin(1), label) == pytest.approx(1.0)


def test_silhouettes_from_pairs_of_blocks(dealt):
    data, blocks = dealt
    best = fitted(blocks, {0: 0, 5: 7}, [2, 4], starts=2)
    got = {(r["set"], r.k): r.silhouette for r in discovery.block_silhouettes(blocks, best).collect()}
    for name in (0, 5):
        labels = [distances(data[name], best[name][k]).argmin(1) for k in (2, 4)]
        assert [got[name, 2], got[name, 4]] == pytest.approx(discovery.silhouettes(data[name], labels))


def test_a_race_draws_by_weight():
    from isopleth.operators.kmeans import race

    weight = np.array([0.0, 1.0, 3.0, 6.0])
    drawn = np.bincount([race(np.arange(4), weight, seed, 0, 1).argmax() for seed in range(20_000)], minlength=4) / 20_000
    assert drawn[0] == 0 and np.allclose(drawn, weight / 10, atol=0.015)
