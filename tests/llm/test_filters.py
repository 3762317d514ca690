import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from edge_tables import edge_docs, edge_rows, no_docs  # noqa: F401

from featurelab.llm import decontam, langid, quality, toxicity

SF = "/root/testdata/sf0.01"
FOLD = "crc32(cast(doc_id as string)) % 4"


def _docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_quality_counts_and_verdict(edge_docs, edge_rows, no_docs):
    got = {r["doc_id"]: r for r in quality.quality_rules(edge_docs).collect()}
    for i, t in edge_rows:
        n, chars, sym, dup, rep, _, _ = brute.quality(t)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, sym, dup, rep)
        assert r["base_failed"] == (n < 50 or 100 * rep > 50 * n)
        assert r["kept"] == brute.good(t)
        assert (r["failed_rule"] is None) == r["kept"]
    assert quality.quality_rules(no_docs).count() == 0


def test_quality_filter_agrees_and_keeps_columns(edge_docs, edge_rows, no_docs):
    kept = quality.keep_good(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, t in edge_rows if brute.good(t)]
    assert quality.keep_good(no_docs).count() == 0


def test_cascade_orders_by_rejection_per_cost(edge_docs):
    plan = quality.plan_cascade(edge_docs, tuple(quality.RULES))
    assert {p[0] for p in plan} == set(quality.RULES)
    gain = [bad / (cost + 1e-9) for _, cost, bad in plan]
    assert gain == sorted(gain, reverse=True)


def test_language_accuracy_on_held_out_rows(spark, edge_docs, no_docs):
    docs = _docs(spark)
    model = langid.train(docs, F.expr(f"{FOLD} <> 2"))
    out = langid.detect(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(f"{FOLD} = 2")
    right, n, low, high = out.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert right / n > 0.97 and low >= 0 and high <= 1
    edge = {r["doc_id"]: r for r in langid.detect(edge_docs, model).collect()}
    assert all(edge[i]["lang_pred"] == "und" and edge[i]["score"] == 0 for i in (0, 1, 2, 18))
    assert edge[6]["lang_pred"] in model.langs
    empty = langid.train(no_docs)
    assert [r["lang_pred"] for r in langid.detect(edge_docs, empty).collect()] == ["und"] * edge_docs.count()
    assert langid.detect(no_docs, model).count() == 0


def test_language_is_blind_to_labels(spark):
    docs = _docs(spark).limit(50)
    model = langid.train(_docs(spark), F.expr(f"{FOLD} <> 2"))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    a, b = ({r["doc_id"]: tuple(r) for r in langid.detect(d, model).collect()} for d in (docs, other))
    assert a == b


def _all_segments(scores):
    """Maximal segments by their recursive definition: the best-scoring one, then left and right of it."""
    if not len(scores):
        return []
    c = np.concatenate([[0], np.cumsum(scores)])
    best, at = 0, None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = c[j] - c[i]
            if s > best + 1e-12 or (at and abs(s - best) <= 1e-12 and j - i < at[1] - at[0]):
                best, at = s, (i, j)
    if at is None:
        return []
    i, j = at
    return _all_segments(scores[:i]) + [(i, j, best)] + [(a + j, b + j, s) for a, b, s in _all_segments(scores[j:])]


def test_segments_match_their_definition():
    rng = np.random.default_rng(5)
    for _ in range(60):
        s = rng.normal(-0.3, 1, rng.integers(0, 25))
        got, want = sorted(toxicity.segments(s)), sorted(_all_segments(s))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([x for *_, x in got], [x for *_, x in want])


def test_toxicity_on_held_out_rows(spark, edge_docs, no_docs):
    docs, labels = _docs(spark), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels, F.expr(f"{FOLD} <> 2"))
    out = toxicity.score(docs, model).join(labels, "doc_id").where(f"{FOLD} = 2").select("score", "predicted", "toxic").toPandas()
    assert out["score"].between(0, 1).all()
    assert ((out["score"] >= 0.3).astype(int) == out["predicted"]).all()
    pos, neg = out[out["toxic"] == 1]["score"].to_numpy(), out[out["toxic"] == 0]["score"].to_numpy()
    auc = (np.sign(pos[:, None] - neg[None, :]) + 1).mean() / 2
    assert auc > 0.8
    edge = {r["doc_id"]: r for r in toxicity.score(edge_docs, model).collect()}
    assert edge[0]["score"] == edge[1]["score"] == edge[2]["score"] and edge[0]["passages"] == []
    assert toxicity.score(no_docs, model).count() == 0
    flat = toxicity.train(docs, labels.where("toxic = 0").limit(5))
    assert {r["score"] for r in toxicity.score(edge_docs, flat).collect()} == {0.0}
    nothing = toxicity.train(no_docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(edge_docs, nothing).collect()} == {0.0}


def _dirty(df):
    return {r["doc_id"]: (r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), sorted(str(i) for i in r["item_ids"]))
            for r in df.collect()}


@pytest.fixture(scope="module")
def items(edge_rows):
    texts = dict(edge_rows)
    passage = texts[10]
    rows = [(1, passage), (2, " ".join(passage.split()[5:17])), (3, "one"), (4, "TWO, words!"), (5, None), (6, "  "), (7, passage),
            (8, " ".join(texts[15].split()[100:113])), (9, "w1ord"), (10, " ".join(texts[15].split()[200:230])), (11, "日本 テキスト 日本")]
    return rows


def test_contamination_matches_brute_force(spark, edge_docs, edge_rows, items, no_docs):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = _dirty(decontam.contamination(edge_docs, bench))
    assert got == {i: brute.contamination(t, items) for i, t in edge_rows}
    assert decontam.contamination(no_docs, bench).count() == 0
    clean = _dirty(decontam.contamination(edge_docs, bench.limit(0)))
    assert all(h == 0 and not ids for _, h, ids in clean.values())


def test_contamination_null_item_ids_and_repeats(spark):
    t = " ".join(f"b{i}" for i in range(20))
    bench = spark.createDataFrame([(None, t), (3, t), (3, t)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + t), (1, "x " + t), (None, "y")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_words"], [tuple(s) for s in r["spans"]], r["item_ids"]) for r in decontam.contamination(docs, bench).collect())
    assert got == [(0, 1, [], []), (1, 21, [(1, 21)], [3]), (1, 21, [(1, 21)], [3])]


def test_every_shared_window_has_a_kept_hash():
    rng = np.random.default_rng(0)
    for _ in range(200):
        shared = rng.integers(0, 2 ** 60, decontam.WINDOW).astype(np.uint64)
        a = np.concatenate([rng.integers(0, 2 ** 60, rng.integers(0, 30)).astype(np.uint64), shared, rng.integers(0, 2 ** 60, rng.integers(0, 30)).astype(np.uint64)])
        b = np.concatenate([rng.integers(0, 2 ** 60, rng.integers(0, 30)).astype(np.uint64), shared])
        kept = []
        for x in (a, b):
            g = decontam.tx.gram_hashes(x, decontam.GRAM)
            ok = np.ones(len(x) - decontam.WINDOW + 1, bool)
            kept.append(set(g[decontam.kept_grams(g, ok)].tolist()))
        inside = set(decontam.tx.gram_hashes(shared, decontam.GRAM).tolist())
        assert kept[0] & kept[1] & inside
