import random

import brute
import numpy as np
import pytest

from edge_tables import edge_docs, edge_rows, no_docs  # noqa: F401

from featurelab.llm import near_dedup, substring_dedup


def _removed(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


@pytest.mark.parametrize("hot", [20_000, 1])
def test_repeated_substrings(edge_docs, edge_rows, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    want = {i: (n, g, s, brute.sha(k)) for (i, _), (n, g, s, k) in zip(edge_rows, brute.repeats([t for _, t in edge_rows]))}
    got = substring_dedup.remove_repeats(edge_docs, keep_text=True)
    assert _removed(got) == want
    kept = {r["doc_id"]: r["kept_text"] for r in got.collect()}
    for (i, _), (_, _, _, k) in zip(edge_rows, brute.repeats([t for _, t in edge_rows])):
        assert kept[i] == k.decode("utf-8", "ignore")


def test_repeated_substrings_on_random_overlaps(spark):
    rnd = random.Random(4)
    pool = "".join(rnd.choice("abcd ") for _ in range(3000))
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            a = rnd.randint(0, 2600)
            parts.append(pool[a:a + rnd.choice([150, 199, 200, 201, 260, 400])])
            parts.append("".join(rnd.choice("efgh") for _ in range(rnd.randint(0, 90))))
        texts.append("".join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    want = {i: (n, g, s, brute.sha(k)) for i, (n, g, s, k) in enumerate(brute.repeats(texts))}
    assert _removed(substring_dedup.remove_repeats(docs)) == want


def test_repeated_ids_nulls_and_empty_table(spark, no_docs):
    t = "".join(chr(97 + i * i % 26) for i in range(500))
    docs = spark.createDataFrame([(1, t), (1, "other"), (None, t), (None, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in substring_dedup.remove_repeats(docs).collect())
    assert got == [(0, 0, 0), (0, 500, 500), (1, 5, 0), (1, 500, 500)]
    assert substring_dedup.remove_repeats(no_docs).count() == 0


def test_merge_yields_sorted_strings_and_shared_prefixes():
    rnd = random.Random(1)
    runs = []
    for _ in range(7):
        keys = sorted({bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 60))) for _ in range(rnd.randint(0, 50))})
        blob = substring_dedup._pack_run(keys, np.zeros((len(keys), 3), np.int64))
        back, lcp, _ = substring_dedup._unpack_run(blob)
        assert back == keys
        runs.append((keys, lcp))
    out = [(runs[r][0][i], h) for r, i, h in substring_dedup.merge_runs(runs)]
    assert [k for k, _ in out] == sorted(k for keys, _ in runs for k in keys)
    for (a, _), (b, h) in zip(out, out[1:]):
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert h == n


def _near(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def _variants(n, seed=3):
    rnd = random.Random(seed)
    base = [f"t{rnd.randint(0, 5000)}" for _ in range(150)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 2, 3, 5, 8])):
            w[rnd.randrange(len(w))] = f"e{rnd.randint(0, 10 ** 6)}"
        if i % 7 == 0:
            w = w[rnd.randint(0, 12):]
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("hot, crowded", [(64, 10), (4, 10 ** 6), (4, 0)])
def test_near_duplicates_match_brute_force(spark, edge_rows, monkeypatch, hot, crowded):
    """Small and hot lists, sets below and above the sketch size, chains; crowded values broadcast and joined."""
    monkeypatch.setattr(near_dedup, "HOT", hot)
    monkeypatch.setattr(near_dedup, "CROWDED", crowded)
    rows = edge_rows + [(1000 + i, t) for i, t in _variants(150)]
    rnd = random.Random(9)
    chain = [f"c{i}" for i in range(900)]
    for i in range(8):  # each link changes a few more words
        for _ in range(12):
            chain[rnd.randrange(len(chain))] = f"z{rnd.randint(0, 10 ** 6)}"
        rows.append((5000 + i, " ".join(chain)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_dedup.near_duplicates(docs)
    assert _near(got) == brute.components(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


def test_near_duplicates_nulls_repeats_clashes(spark, edge_docs, edge_rows, no_docs):
    assert _near(near_dedup.near_duplicates(edge_docs)) == brute.components(edge_rows)
    t = "one two three four five six seven"
    docs = spark.createDataFrame([(None, t), (7, t), (7, t), (9, t), (8, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs).collect())
    assert got == [(-1, None, True), (7, 7, True), (7, 7, True), (8, 8, True), (9, 7, False)]
    assert near_dedup.near_duplicates(no_docs).count() == 0


def test_shared_value_bound_holds_on_samples():
    rnd = np.random.default_rng(2)
    k = 64
    for n in (20, 60, 90, 400, 3000):
        for _ in range(200):
            u = rnd.integers(0, 2 ** 40, n)
            both = int(np.ceil(0.85 * n))
            x = np.unique(np.concatenate([u[:both], u[both:both + (n - both) // 2]]))
            y = np.unique(np.concatenate([u[:both], u[both + (n - both) // 2:]]))
            if 100 * len(np.intersect1d(x, y)) < 85 * len(np.union1d(x, y)):
                continue
            got = len(np.intersect1d(x[:k], y[:k]))
            assert got >= min(near_dedup.shared_at_least(len(x), k, 85), near_dedup.shared_at_least(len(y), k, 85))


def _template_family(n, seed):
    """Texts of one 500-word template with 16 slots of 8 options each, and the options of each text."""
    rnd = random.Random(seed)
    template = [f"t{k}" for k in range(500)]
    picks = [[rnd.randrange(8) for _ in range(16)] for _ in range(n)]
    texts = []
    for p in picks:
        w = list(template)
        for slot, option in enumerate(p):
            w[15 + 30 * slot] = f"s{slot}o{option}"
        texts.append(" ".join(w))
    return texts, np.array(picks)


def _family_components(picks):
    """Smallest index of each text's component: texts that differ in d slots share 496 - 5 d of 496 + 5 d shingles."""
    parent = list(range(len(picks)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(picks)):
        d = (picks[:i] != picks[i]).sum(axis=1)
        for j in np.flatnonzero(100 * (496 - 5 * d) >= 85 * (496 + 5 * d)):
            a, b = sorted((find(i), find(int(j))))
            parent[b] = a
    return [find(i) for i in range(len(picks))]


def test_template_families_are_not_tested_pair_by_pair(spark, monkeypatch):
    tests = {}
    real = near_dedup.common.stage

    def counted(df, name):
        out = real(df, name)
        if name.endswith("-likely"):
            tests[n] = tests.get(n, 0) + out.count()
        return out

    monkeypatch.setattr(near_dedup.common, "stage", counted)
    for n in (300, 600):
        texts, picks = _template_family(n, 7)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
        assert [got[i] for i in range(n)] == _family_components(picks)
    assert all(k < n / 2 for n, k in tests.items())  # of n * (n - 1) / 2 pairs; the similar ones are among them
