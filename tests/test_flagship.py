"""Brute-force and closed-form checks of the evaluation operators."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from featurelab.operators import distance as D
from featurelab.operators import stats as S
from featurelab.plans import fixtures as fx


def _np_features(spark, sf):
    pdf = fx.features(spark, sf).toPandas().sort_values("id")
    return pdf["id"].to_numpy(), np.vstack(pdf["features"].values).astype(np.float64)


def _sq(a, b):
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0)


def _frame(spark, ids, x):
    return spark.createDataFrame(pd.DataFrame({"id": ids, "features": list(x)}))


@pytest.mark.parametrize("block_rows", [10_000, 128, 60])
def test_knn_radii_bruteforce(spark, block_rows):
    ids, x = _np_features(spark, SF_SMALL)
    want = np.sort(_sq(x, x), axis=1)[:, [1, 3, 5]]
    got = D.knn_radii(fx.features(spark, SF_SMALL), ks=(1, 3, 5), block_rows=block_rows).toPandas()
    got = got.set_index("id").loc[ids]
    np.testing.assert_allclose(np.vstack(got["radii"].values), want, rtol=1e-9, atol=1e-12)


def test_knn_with_duplicates_counts_self_and_copies(spark):
    x = np.array([[0.0, 0.0], [0.0, 0.0], [1.0, 0.0], [3.0, 0.0], [3.0, 4.0]])
    r = D.knn_radii(_frame(spark, np.arange(5), x), ks=(1, 2), block_rows=2).toPandas().set_index("id")
    d = np.sort(_sq(x, x), axis=1)
    np.testing.assert_allclose(np.vstack(r.loc[range(5), "radii"].values), d[:, [1, 2]])
    assert r.loc[0, "radii"][0] == 0.0  # the duplicate is at distance 0


def test_knn_too_few_rows(spark):
    with pytest.raises(ValueError):
        D.knn_radii(_frame(spark, np.arange(3), np.eye(3)), ks=(3,))


def test_precision_recall_bruteforce_and_anchor(spark):
    ids, x = _np_features(spark, SF_MID)
    ref, smp = x[ids % 2 == 0], x[ids % 2 == 1]
    r_ref = np.sort(_sq(ref, ref), axis=1)[:, 3]
    r_smp = np.sort(_sq(smp, smp), axis=1)[:, 3]
    d = _sq(ref, smp)
    precision = (d <= r_ref[:, None]).any(axis=0).mean()
    recall = (d <= r_smp[None, :]).any(axis=1).mean()
    for br in (4096, 64):
        pr = D.precision_recall(fx.ref_features(spark, SF_MID), fx.sample_features(spark, SF_MID),
                                block_rows=br).first()
        assert pr["precision"] == pytest.approx(precision) and pr["recall"] == pytest.approx(recall)
    assert (round(precision, 3), round(recall, 3)) == (0.932, 0.952)


def test_boundary_is_inside(spark):
    ref = np.array([[0.0], [1.0], [2.0], [3.0]])
    smp = np.array([[5.0], [6.0], [7.0], [8.0]])
    # ref radius (k=1) = 1 for every ref row; sample at distance exactly 1 from ref 3 is inside
    smp[0, 0] = 4.0
    pr = D.precision_recall(_frame(spark, np.arange(4), ref), _frame(spark, np.arange(4), smp), k=1).first()
    assert pr["precision"] == pytest.approx(0.25)


def test_manifold_evaluate_bruteforce(spark):
    ids, x = _np_features(spark, SF_SMALL)
    ref, ev = x[ids % 2 == 0], x[ids % 2 == 1]
    rid, eid = ids[ids % 2 == 0], ids[ids % 2 == 1]
    r = np.sort(_sq(ref, ref), axis=1)[:, 3]
    d = _sq(ev, ref)
    radii = D.knn_radii(fx.ref_features(spark, SF_SMALL))
    got = D.manifold_evaluate(fx.ref_features(spark, SF_SMALL), radii, fx.sample_features(spark, SF_SMALL),
                              block_rows=50).toPandas().set_index("id").loc[eid]
    np.testing.assert_array_equal(got["inside"].to_numpy(), (d <= r[None, :]).any(axis=1))
    np.testing.assert_allclose(got["max_realism"].to_numpy(), (r[None, :] / (d + 1e-5)).max(axis=1), rtol=1e-9)
    np.testing.assert_array_equal(got["nearest_id"].to_numpy(), rid[d.argmin(axis=1)])


def test_nearest_ties_go_to_lowest_id(spark):
    ref = np.array([[1.0, 0.0], [-1.0, 0.0], [0.0, 1.0]])
    ev = np.array([[0.0, 0.0]])
    got = D.nearest(_frame(spark, np.array([5, 2, 9]), ref), _frame(spark, np.array([0]), ev), block_rows=1).first()
    assert got["nearest_id"] == 2


def test_clamp_radii_percentile(spark):
    vals = np.arange(10, dtype=float)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(10), "radius": vals}))
    got = D.clamp_radii(df, 50.0).toPandas().sort_values("id")["radius"].to_numpy()
    cut = np.percentile(vals, 50)
    np.testing.assert_array_equal(got, np.where(vals > cut, 0.0, vals))


def test_statistics_match_numpy(spark):
    ids, x = _np_features(spark, SF_SMALL)
    st = S.fit_statistics(fx.features(spark, SF_SMALL).repartition(7))
    np.testing.assert_allclose(st.mu, x.mean(0), atol=1e-12)
    np.testing.assert_allclose(st.sigma, np.cov(x, rowvar=False), atol=1e-12)
    assert st.n == len(x)


def test_frechet_closed_forms():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(200, 5))
    s = S.FeatureStats(200, a.mean(0), np.cov(a, rowvar=False))
    assert abs(S.frechet_distance(s, s)) < 1e-9
    shift = np.array([1.0, -2.0, 0.5, 0.0, 3.0])
    t = S.FeatureStats(200, s.mu + shift, s.sigma)
    assert S.frechet_distance(s, t) == pytest.approx(shift @ shift, rel=1e-9)
    d1, d2 = np.diag([1.0, 4.0, 9.0]), np.diag([4.0, 1.0, 16.0])
    z = np.zeros(3)
    got = S.frechet_distance(S.FeatureStats(1, z, d1), S.FeatureStats(1, z, d2))
    assert got == pytest.approx(((np.sqrt([1, 4, 9]) - np.sqrt([4, 1, 16])) ** 2).sum())
    with pytest.raises(ValueError):
        S.frechet_distance(S.FeatureStats(1, np.zeros(2), np.eye(2)), S.FeatureStats(1, z, d1))


def test_fid_anchor(spark):
    fid = S.frechet_distance(S.fit_statistics(fx.ref_features(spark, SF_MID)),
                             S.fit_statistics(fx.sample_features(spark, SF_MID)))
    assert fid == pytest.approx(0.13638019833032056, rel=1e-9)


def test_inception_score_bruteforce(spark):
    pdf = fx.probs(spark, SF_SMALL).toPandas().sort_values("id")
    p = np.vstack(pdf["probs"].values)
    scores = []
    for s in range(0, len(p), 64):
        part = p[s:s + 64]
        kl = part * (np.log(part) - np.log(part.mean(0, keepdims=True)))
        scores.append(np.exp(kl.sum(1).mean()))
    got = S.inception_score(fx.probs(spark, SF_SMALL), split_size=64).first()
    assert got["inception_score"] == pytest.approx(np.mean(scores), rel=1e-9)
    assert got["n_chunks"] == len(scores)


def test_inception_score_zero_probability_is_nan(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "id long, probs array<double>")
    assert np.isnan(S.inception_score(df).first()["inception_score"])


def test_linear_softmax(spark):
    w = np.eye(64)[:, :10] * 20
    got = S.linear_softmax(fx.features(spark, SF_SMALL), w).toPandas().sort_values("id")
    want = fx.probs(spark, SF_SMALL).toPandas().sort_values("id")
    np.testing.assert_allclose(np.vstack(got["probs"].values), np.vstack(want["probs"].values), rtol=1e-9)


def test_statistics_invariant_to_partitioning(spark):
    f = fx.features(spark, SF_SMALL)
    a = S.fit_statistics(f.repartition(1))
    b = S.fit_statistics(f.repartition(17))
    np.testing.assert_allclose(a.mu, b.mu, atol=1e-13)
    np.testing.assert_allclose(a.sigma, b.sigma, atol=1e-13)


def test_precision_recall_invariant_to_partitioning(spark):
    ref, smp = fx.ref_features(spark, SF_SMALL), fx.sample_features(spark, SF_SMALL)
    a = D.precision_recall(ref.repartition(1), smp.repartition(1)).first()
    b = D.precision_recall(ref.repartition(17), smp.repartition(5), block_rows=40).first()
    assert (a["precision"], a["recall"]) == (b["precision"], b["recall"])


def test_empty_and_single_row_inputs(spark):
    empty = fx.features(spark, SF_SMALL).limit(0)
    with pytest.raises(ValueError):
        S.fit_statistics(empty)
    one = spark.createDataFrame([(0, [0.25, 0.75])], "id long, probs array<double>")
    got = S.inception_score(one).first()
    assert got["n_chunks"] == 1 and got["inception_score"] == pytest.approx(1.0)


def test_precision_recall_unequal_sets_and_blocks(spark):
    ids, x = _np_features(spark, SF_SMALL)
    rmask, smask = ids % 2 == 0, (ids % 2 == 1) & (ids < 200)
    ref, smp = x[rmask], x[smask]
    r_ref = np.sort(_sq(ref, ref), axis=1)[:, 3]
    r_smp = np.sort(_sq(smp, smp), axis=1)[:, 3]
    d = _sq(ref, smp)
    want = ((d <= r_ref[:, None]).any(axis=0).mean(), (d <= r_smp[None, :]).any(axis=1).mean())
    f = fx.features(spark, SF_SMALL)
    got = D.precision_recall(f.where("id % 2 = 0"), f.where("id % 2 = 1 AND id < 200"), block_rows=40).first()
    assert (got["precision"], got["recall"]) == pytest.approx(want)


def test_knn_two_level_merge(spark, monkeypatch):
    monkeypatch.setattr(D, "TWO_LEVEL_BLOCKS", 2)
    ids, x = _np_features(spark, SF_SMALL)
    want = np.sort(_sq(x, x), axis=1)[:, 3]
    got = D.knn_radii(fx.features(spark, SF_SMALL), block_rows=50).toPandas().set_index("id").loc[ids]
    np.testing.assert_allclose(got["radius"].to_numpy(), want, rtol=1e-9, atol=1e-12)


def test_fit_statistics_multi_takes_any_number_of_sets(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i % 40), [float(v) for v in rng.normal(size=3)]) for i in range(400)] + [(3, None)]
    f = spark.createDataFrame(rows, "g int, features array<double>")
    for parts in (1, 7):  # however the sets are mixed over the tasks
        st = S.fit_statistics_multi(f.repartition(parts), ["features"], "g")
        assert len(st) == 40
        for g in (0, 3, 39):
            x = np.array([v for k, v in rows if k == g and v is not None])
            assert np.allclose(st[(str(g), "features")].sigma, np.cov(x, rowvar=False))


def _clustered(seed, n, groups=12, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim)) * 40
    x = centres[rng.integers(0, groups, n)] + rng.normal(size=(n, dim))
    x[: n // 3] = centres[0] + rng.normal(size=(n // 3, dim)) * 0.5  # a crowded cell
    return np.vstack([x[:-4], np.repeat(x[:1], 4, axis=0)])  # and repeated rows


def _brute_radii(x, k):
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    return np.sort(d, axis=1)[:, k]


def test_block_pairs_of_clustered_data_are_skipped_without_a_loss(spark):
    x = _clustered(1, 300)
    stats = {}
    got = D.knn_radii(_frame(spark, np.arange(len(x)), x), ks=(3, 1), block_rows=60, stats=stats).toPandas().sort_values("id")
    np.testing.assert_allclose(np.vstack(got["radii"].values), np.stack([_brute_radii(x, 3), _brute_radii(x, 1)], axis=1), atol=1e-8)
    assert stats["pairs"] > 200 and stats["kept"] < 0.7 * stats["pairs"]
    flat = np.random.default_rng(2).normal(size=(120, 6))  # nothing to skip, nothing to lose
    got = D.knn_radii(_frame(spark, np.arange(120), flat), ks=(3,), block_rows=30).toPandas().sort_values("id")
    np.testing.assert_allclose(got["radius"], _brute_radii(flat, 3), atol=1e-8)
    far = np.vstack([flat[:50] + 1e6, flat[50:100]])  # far from the origin: the bounds must allow for rounding
    got = D.knn_radii(_frame(spark, np.arange(100), far), ks=(3,), block_rows=25).toPandas().sort_values("id")
    np.testing.assert_allclose(got["radius"], _brute_radii(far, 3), atol=0.05)


def test_memberships_skip_pairs_without_a_loss(spark):
    a, b = _clustered(3, 240), np.vstack([_clustered(3, 160)[::2], _clustered(9, 100)])
    ra, rb = _brute_radii(a, 3), _brute_radii(b, 3)
    frame = lambda x, r: spark.createDataFrame([(i, float(v)) for i, v in enumerate(r)], "id long, radius double")
    stats = {}
    flags = D.membership_flags(_frame(spark, np.arange(len(a)), a), frame(a, ra), _frame(spark, np.arange(len(b)), b), frame(b, rb),
                               block_rows=60, stats=stats).toPandas()
    d = ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)
    want = {("ref", i): v for i, v in enumerate((d <= rb[None, :]).any(axis=1))} | {("sample", i): v for i, v in enumerate((d <= ra[:, None]).any(axis=0))}
    assert {(r.side, r.id): r.inside for r in flags.itertuples()} == want
    assert stats["pairs"] > 100 and stats["kept"] < 0.7 * stats["pairs"]


def test_frechet_distance_of_many_sets_is_solved_in_their_tasks(spark):
    from featurelab.operators import stats as ST
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 5)) * rng.uniform(0.5, 3, 5) + 7
    key = rng.integers(0, 60, 900)
    key[:300] = 0  # a hot set
    rows = [(int(k), i % 2, [float(v) for v in r]) for i, (k, r) in enumerate(zip(key, x))] + [(None, 0, [1.0] * 5), (70, 0, [1.0] * 5), (71, 1, [2.0] * 5), (72, 0, None)]
    df = spark.createDataFrame(rows, "k int, side int, features array<double>").repartition(5)
    out = ST.frechet_by_set(df.where("side = 0"), df.where("side = 1"), "k")
    got = {r["k"]: (r["n_ref"], r["n_sample"], r["fid"]) for r in out.collect()}
    assert set(got) == {*range(60), 70, 71} and got[70] == (1, 0, None) and got[71] == (0, 1, None)
    for k in range(60):
        a, b = (x[(key == k) & (np.arange(900) % 2 == s)] for s in (0, 1))
        assert got[k][:2] == (len(a), len(b))
        if min(len(a), len(b)) < 2:
            assert got[k][2] is None
            continue
        stat = [ST.FeatureStats(len(v), v.mean(axis=0), np.cov(v, rowvar=False)) for v in (a, b)]
        assert got[k][2] == pytest.approx(ST.frechet_distance(*stat), rel=1e-6)  # roots of singular matrices
    assert ST.frechet_by_set(df.limit(0), df.limit(0), "k").count() == 0


def test_manifold_and_nearest_skip_pairs_without_a_loss(spark):
    a, b = _clustered(5, 240), np.vstack([_clustered(5, 160)[::2], _clustered(8, 60)])
    radii = _brute_radii(a, 3)
    r = spark.createDataFrame([(i, float(v)) for i, v in enumerate(radii)], "id long, radius double")
    d = ((b[:, None, :] - a[None, :, :]) ** 2).sum(axis=2)
    stats = {}
    got = D.manifold_evaluate(_frame(spark, np.arange(len(a)), a), r, _frame(spark, np.arange(len(b)), b), block_rows=60, stats=stats).toPandas().sort_values("id")
    assert got["inside"].tolist() == (d <= radii[None, :]).any(axis=1).tolist()
    np.testing.assert_allclose(got["max_realism"], (radii[None, :] / (d + D.REALISM_EPS)).max(axis=1), rtol=1e-6)
    np.testing.assert_allclose(got["nearest_dist"], d.min(axis=1), atol=1e-8)
    assert stats["pairs"] > 100 and stats["kept"] < 0.9 * stats["pairs"]
    stats = {}
    near = D.nearest(_frame(spark, np.arange(len(a)), a), _frame(spark, np.arange(len(b)), b), block_rows=60, stats=stats).toPandas().sort_values("id")
    np.testing.assert_allclose(d[np.arange(len(b)), near["nearest_id"]], d.min(axis=1), atol=1e-8)
    assert stats["kept"] < 0.9 * stats["pairs"]
