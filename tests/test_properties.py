"""Property checks: column functions against plain-Python statements of the same rules."""
import fnmatch
import hashlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from featurelab.functions import paths as P
from featurelab.functions.permute import permuted, unpermuted

SETTINGS = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


# stated examples: seconds -> long form, short form
DURATIONS = [(0.0, "0s", "0s"), (0.5, "0s", "0s"), (1.5, "2s", "2s"), (59.4, "59s", "59s"), (60.0, "1m 00s", "1m 00s"), (61.0, "1m 01s", "1m 01s"),
             (3599.0, "59m 59s", "59m 59s"), (3600.0, "1h 00m 00s", "1h 00m"), (7325.0, "2h 02m 05s", "2h 02m"),
             (86399.0, "23h 59m 59s", "23h 59m"), (86400.0, "1d 00h 00m", "1d 00h"), (200000.0, "2d 07h 33m", "2d 07h")]


def test_format_duration_examples(spark):
    df = spark.createDataFrame([(d[0],) for d in DURATIONS], "s double")
    got = df.select("s", P.format_duration("s").alias("a"), P.format_duration("s", brief=True).alias("b")).collect()
    assert [tuple(r) for r in got] == DURATIONS


@SETTINGS
@given(st.lists(st.floats(0, 400000, allow_nan=False), min_size=1, max_size=200))
def test_format_duration_reads_back(spark, values):
    """The printed units add up to the time, less what the last unit leaves out."""
    df = spark.createDataFrame([(float(v),) for v in values], "s double")
    unit = {"s": 1, "m": 60, "h": 3600, "d": 86400}
    for r in df.select("s", P.format_duration("s").alias("a"), P.format_duration("s", brief=True).alias("b")).collect():
        for text in (r["a"], r["b"]):
            parts = text.split()
            total = sum(int(x[:-1]) * unit[x[-1]] for x in parts)
            assert 0 <= round(r["s"]) - total < unit[parts[-1][-1]] and len(parts) <= 3
        assert r["a"].startswith(r["b"])


# stated examples
URLS = {"http://a.com": True, "https://a.example.org/b.html?q=1#top": True, "ftp://a.com/": True, "HTTP://A.COM": True, "foo://": False,
        "http://": False, "http://localhost": False, "localhost.com": False, "": False, "a.com/x": False, "http:///path.html": False}


def test_is_valid_url_examples(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "u string")
    assert {r["u"]: r["v"] for r in df.select("u", P.is_valid_url("u").alias("v")).collect()} == URLS


_url = st.builds(lambda sch, host, tld, path: f"{sch}://{host}{tld}{path}",
                 st.sampled_from(["http", "https", "ftp"]), st.from_regex(r"[a-z]{1,6}", fullmatch=True),
                 st.sampled_from(["", ".com", ".example.org"]), st.sampled_from(["", "/", "/a/b.html", "?q=1", "#top"]))


@SETTINGS
@given(st.lists(_url, min_size=1, max_size=200))
def test_is_valid_url(spark, urls):
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [r[0] for r in df.select(P.is_valid_url("u")).collect()]
    # with a scheme and a plain host, only a dot in the host decides
    assert got == ["." in u.split("://")[1].split("/")[0].split("?")[0].split("#")[0] for u in urls]


@SETTINGS
@given(st.lists(st.from_regex(r"[a-c_.]{1,6}", fullmatch=True), min_size=1, max_size=50),
       st.sampled_from(["*.c", "a?", "[ab]*", "[!a]*", "*_*", "a.*", "?"]))
def test_fnmatch_regex(spark, names, pattern):
    df = spark.createDataFrame([(n,) for n in names], "n string")
    rx = P.fnmatch_regex(pattern)
    got = [r[0] for r in df.select(df.n.rlike(rx)).collect()]
    assert got == [fnmatch.fnmatchcase(n, pattern) for n in names]


def test_generation_manifest_matches_rank_simulation(spark):
    from featurelab.operators.sampling import generation_manifest
    num, world, batch, seed = 50, 3, 4, 7
    got = generation_manifest(spark, num, world, batch, seed, 1000).toPandas()
    want = []
    total, done = 0, 0
    need = -(-num // (world * batch)) * world * batch
    while done < need:  # every rank writes one batch per iteration
        for rank in range(world):
            for i in range(batch):
                idx = i * world + rank + done
                if idx < num:
                    want.append((idx, rank, seed * world + rank))
        done += world * batch
    assert sorted(zip(got["index"], got["rank"], got["rank_seed"])) == sorted(want)
    assert sorted(got["index"]) == list(range(num))


def test_time_schedule_shape(spark):
    from featurelab.operators.sampling import time_schedule
    s = time_schedule(spark, 5, cfg_scale=2.0, lo=0.0, hi=0.5).toPandas().sort_values("i")
    np.testing.assert_allclose(s["t"], np.linspace(1.0, 0.04, 5))
    np.testing.assert_allclose(s["t_next"], list(np.linspace(1.0, 0.04, 5)[1:]) + [0.0])
    assert s["noisy"].tolist() == [True, True, True, True, False]
    assert s["guided"].tolist() == [t <= 0.5 for t in np.linspace(1.0, 0.04, 5)]


@SETTINGS
@given(st.lists(st.integers(0, 10**9), min_size=1, max_size=100))
def test_artifact_and_checkpoint_names(spark, idxs):
    df = spark.createDataFrame([(i,) for i in idxs], "i long")
    got = df.select(P.artifact_path("i", "latents").alias("a"), P.artifact_path("i", "cls").alias("c"),
                    P.checkpoint_name("i").alias("k")).collect()
    for i, r in zip(idxs, got):
        s = f"{i:08d}"
        assert r["a"] == f"{s[:5]}/img-mean-std-{s}.npy"
        assert r["c"] == f"{s[:5]}/img-dinov3-{s}_cls.npy"
        assert r["k"] == f"{i:07d}.pt"


@SETTINGS
@given(st.lists(st.from_regex(r"([a-z]{1,3}/){0,2}[a-z]{1,3}(\.[a-zA-Z]{1,4})?", fullmatch=True),
                min_size=1, max_size=100))
def test_top_dir_and_extension(spark, paths):
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = df.select(P.top_dir("p").alias("t"), P.file_ext("p").alias("e")).collect()
    for p, r in zip(paths, got):
        assert r["t"] == (p.split("/")[0] if "/" in p else "")
        assert r["e"] == p.split(".")[-1]


M = 2 ** 31 - 1


def _permutation(n, seed, epoch):
    """The keyed permutation of 0..n-1, from its definition."""
    a = next(a for a in range(1, n + 1) if a * a >= n)
    b = -(-n // a)
    h = hashlib.md5(f"{seed}:{epoch}".encode()).hexdigest()
    k = [int(h[8 * i:8 * i + 8], 16) % M for i in range(4)]

    def once(x):
        low, high = x % a, x // a
        for j in range(8):
            v = high if j % 2 == 0 else low
            t = (v + k[0] + j * k[1]) % M
            add = t * t % M * (1 + (k[2] + j * k[3]) % (M - 1)) % M
            low, high = ((low + add) % a, high) if j % 2 == 0 else (low, (high + add) % b)
        return high * a + low

    out = []
    for x in range(n):
        x = once(x)
        while x >= n:
            x = once(x)
        out.append(x)
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 100, 1023, 1024, 1025, 4099])
def test_keyed_permutation(spark, n):
    df = spark.range(n).select("id", permuted("id", n, 11, 4).alias("x"))
    got = df.select("id", "x", unpermuted("x", n, 11, 4).alias("back")).orderBy("id").collect()
    assert [r["x"] for r in got] == _permutation(n, 11, 4)
    assert sorted(r["x"] for r in got) == list(range(n)) and all(r["back"] == r["id"] for r in got)


def test_keyed_permutation_of_large_ranges(spark):
    for n in (10 ** 9 + 7, 2 ** 61 + 3):
        df = spark.range(0, n, max(1, n // 5000)).withColumn("x", permuted("id", n, 1, "e"))
        df = df.withColumn("back", unpermuted("x", n, 1, "e"))
        assert df.where((F.col("x") < 0) | (F.col("x") >= n) | (F.col("back") != F.col("id"))).count() == 0
        share = df.select(F.avg((F.col("x") < n // 2).cast("double")), F.countDistinct("x"), F.count("*")).first()
        assert abs(share[0] - 0.5) < 0.05 and share[1] == share[2]


def test_epoch_batches_and_sampler_match_python(spark):
    from featurelab.operators.sampling import epoch_batches, infinite_sampler
    ids = list(range(0, 137, 2))  # 69 non-dense ids
    df = spark.createDataFrame([(i,) for i in ids], "i long")
    seed, epoch, batch = 11, 4, 8
    n = len(ids)
    order = [ids[x] for x in _permutation(n, seed, epoch)]
    keep = (n // batch) * batch
    got = epoch_batches(df, "i", batch, seed, epoch).toPandas().sort_values(["batch_id", "slot"])
    assert got["i"].tolist() == order[:keep]
    rank, replicas, start, steps = 2, 3, 50, 140
    idx = [start + rank + j * replicas for j in range(steps)]
    want = [ids[_permutation(n, seed, i // n)[i % n]] for i in idx]
    s = infinite_sampler(df, "i", rank, replicas, seed, start, steps).toPandas().sort_values("j")
    assert s["i"].tolist() == want
    with pytest.raises(ValueError):
        epoch_batches(df, "i", batch, seed, epoch, "i")


def test_epochs_are_neither_sorted_nor_copied(spark):
    from featurelab.operators.sampling import epoch_batches, infinite_sampler
    df = spark.range(1000).withColumn("payload", F.col("id").cast("string"))
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    batches = plan(epoch_batches(df, "id", 10, 1, 2, "id"))
    assert "Exchange" not in batches and "Sort" not in batches and "Window" not in batches
    stream = plan(infinite_sampler(df, "id", 0, 2, 1, 0, 5000, "id"))
    assert "Sort" not in stream and "Window" not in stream and "payload" not in stream


@pytest.mark.parametrize("seed", range(3))
def test_exact_percentile_by_radix_selection(spark, seed):
    from featurelab.operators.selection import exact_percentile, exact_ranks
    rng = np.random.default_rng(seed)
    values = np.concatenate([rng.normal(size=300) * 10.0 ** rng.integers(-300, 300, 300), np.repeat(rng.normal(), 200), [0.0, -0.0, np.inf, -np.inf, 5e-324]])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)] * 7, "r double").repartition(3)
    assert exact_ranks(df, "r", list(range(0, 505, 31))) == np.sort(values)[::31].tolist()
    finite = df.where("abs(r) < 1e305")
    for q in (0.0, 0.1, 0.5, 0.9, 0.999, 1.0):
        assert exact_percentile(finite, "r", q) == finite.agg(F.percentile("r", F.lit(q))).first()[0]
    assert exact_percentile(df.limit(0), "r", 0.5) is None
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,)], "r double")
    assert exact_ranks(nan, "r", [0, 1]) == [1.0, 2.0] and np.isnan(exact_ranks(nan, "r", [2])[0])


def test_clamping_counts_instead_of_gathering(spark):
    from featurelab.operators import distance as D
    radii = spark.range(1000).select("id", (F.col("id") * 7919 % 1000).cast("double").alias("radius"))
    out = D.clamp_radii(radii, 90.0, staged=True)
    assert out.where("radius > 899.1").count() == 0 and out.where("radius > 0").count() == 899
    assert "percentile" not in out._jdf.queryExecution().toString()
