"""Block counts and memory of the all-pairs jobs."""
import numpy as np
import pandas as pd
import pytest

from featurelab.operators import distance as D


def _frame(spark, x):
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "features": list(x)}))


def _sq(a, b):
    return ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)


@pytest.fixture(scope="module")
def rows():
    return np.random.default_rng(31).normal(size=(240, 5))


def _most_pairs():
    return (2 * D.MAX_BLOCKS) ** 2  # as many cells as blocks, and each may leave one block more


def test_small_blocks_do_not_multiply_the_exchange(spark, rows):
    stats = {}
    got = D.knn_radii(_frame(spark, rows), ks=(3, 5), block_rows=2, stats=stats).toPandas().sort_values("id")
    want = np.sort(_sq(rows, rows), axis=1)[:, [3, 5]]
    np.testing.assert_allclose(np.vstack(got["radii"].values), want, atol=1e-9)
    assert stats["pairs"] <= _most_pairs()


def test_small_blocks_of_memberships_and_manifolds(spark, rows):
    a, b = rows[:130], rows[130:]
    radii = {id(x): spark.createDataFrame([(i, float(v)) for i, v in enumerate(np.sort(_sq(x, x), axis=1)[:, 3])], "id long, radius double") for x in (a, b)}
    ra, rb = (np.sort(_sq(x, x), axis=1)[:, 3] for x in (a, b))
    d = _sq(a, b)
    stats = {}
    flags = D.membership_flags(_frame(spark, a), radii[id(a)], _frame(spark, b), radii[id(b)], block_rows=2, stats=stats).toPandas()
    want = {("ref", i): v for i, v in enumerate((d <= rb[None, :]).any(axis=1))} | {("sample", i): v for i, v in enumerate((d <= ra[:, None]).any(axis=0))}
    assert {(r.side, r.id): r.inside for r in flags.itertuples()} == want
    assert stats["pairs"] <= _most_pairs()
    stats = {}
    got = D.manifold_evaluate(_frame(spark, a), radii[id(a)], _frame(spark, b), block_rows=2, stats=stats).toPandas().sort_values("id")
    assert got["nearest_id"].tolist() == d.argmin(axis=0).tolist()
    np.testing.assert_allclose(got["max_realism"], (ra[:, None] / (d + D.REALISM_EPS)).max(axis=0), rtol=1e-6)
    assert stats["pairs"] <= _most_pairs()


def test_small_blocks_of_summaries(spark, rows, monkeypatch):
    a, b = rows[:130], rows[130:]
    sides, whole = [], D.blocked_cogroup
    monkeypatch.setattr(D, "blocked_cogroup", lambda *args, **kw: (sides.append(args[4:6]), whole(*args, **kw))[1])
    got = D.pairwise_distance_summary(_frame(spark, a), _frame(spark, b), block_rows=2).toPandas().sort_values("id")
    d = _sq(a, b)
    np.testing.assert_allclose(got[["min_dist", "max_dist", "sum_dist"]], np.stack([d.min(axis=1), d.max(axis=1), d.sum(axis=1)], axis=1), atol=1e-9)
    assert got["n_pairs"].tolist() == [len(b)] * len(a) and max(sides[0]) <= D.MAX_BLOCKS


def test_smallest_distances_hold_no_tile():
    x = np.random.default_rng(5).normal(size=(3000, 4))
    found = D._k_smallest(x, x, 4)
    held = {id(y.base): y.base.nbytes for y in found if y.base is not None}
    assert sum(held.values()) <= 3000 * 4 * 8
    np.testing.assert_allclose(np.vstack(found[:50]), np.sort(_sq(x[:50], x), axis=1)[:, :4], atol=1e-12)


def test_smallest_distances_pass_rows_without_numbers(monkeypatch):
    monkeypatch.setattr(D, "TILE_COLUMNS", 3, raising=False)
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(9, 2)), rng.normal(size=(11, 2))
    b[:4], a[2] = np.nan, np.nan
    np.testing.assert_allclose(np.vstack(D._k_smallest(a, b, 5)), np.sort(_sq(a, b), axis=1)[:, :5], atol=1e-12)


def test_blocks_stay_small_at_any_size():
    for n in (100_000, 600_000, 10_000_000):
        for block_rows in (64, 128, None):
            if block_rows:
                blocks = D.blocks_wanted(n, 64, 12, block_rows)
                assert blocks <= max(D.MAX_BLOCKS, D.auto_blocks(n, 64, 1))
            assert -(-n // D.auto_blocks(n, 64, 12)) * 64 * 8 <= 33 << 20
