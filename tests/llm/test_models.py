"""The fitted operators against plain-Python versions of their models."""
import collections
import math
import re
import struct
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from featurelab.llm import langid, toxicity
from featurelab.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
M32, M64 = (1 << 32) - 1, (1 << 64) - 1


def _held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


# ------------------------------------------------------------- language id
def _grams(text):
    """Buckets of a text's n-grams and its number of letters."""
    low = []
    for ch in text or "":
        c = ord(ch.lower()[0]) if ch.isalpha() else 0
        if c or not low or low[-1]:
            low.append(c)
    out = []
    for n in (1, 2, 3):
        for i in range(len(low) - n + 1):
            if low[i] + low[i + n - 1] == 0:
                continue
            h = 0
            for k in range(n):
                h = (h * 0x01000193 + low[i + k] + k + 1) & M32
            g = h * (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)[n % 3] & M32
            out.append((g ^ (g >> 15)) % langid.BUCKETS)
    return out, sum(c > 0 for c in low)


def _bayes(train, texts):
    """[(language, score)] of the texts, from [(language, text)]."""
    counts, docs = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in train:
        counts[lang].update(_grams(text)[0])
        docs[lang] += 1
    out = []
    for text in texts:
        grams, letters = _grams(text)
        if not letters or not docs:
            out.append(("und", 0.0))
            continue
        ll = {}
        for lang in docs:
            total = sum(counts[lang].values()) + 0.5 * langid.BUCKETS
            ll[lang] = math.log(docs[lang] / sum(docs.values())) + sum(math.log((counts[lang][g] + 0.5) / total) for g in grams)
        best = min(ll, key=lambda x: (-ll[x], x))
        out.append((best, 1 / sum(math.exp(v - ll[best]) for v in ll.values())))
    return out


def test_op2_matches_plain_naive_bayes(spark):
    rows = duckdb.sql(f"select doc_id, lang, text from '{SF}/documents.parquet'").fetchall()
    want = _bayes([(lang, t) for i, lang, t in rows if lang is not None and t is not None and not _held_out(i)], [t for *_, t in rows])
    got = {r["doc_id"]: r for r in QUERIES["op2_language_id"](spark, SF).collect()}
    assert len(got) == len(rows)
    for (i, _, _), (lang, score) in zip(rows, want):
        assert got[i]["held_out"] == _held_out(i)
        assert got[i]["lang_pred"] == lang and got[i]["score"] == pytest.approx(score, abs=1e-3)


def test_language_id_of_odd_rows(spark):
    schema = "doc_id long, lang string, text string, top double"
    rows = [(1, "a", "abc abd"), (1, "a", "abc abd"), (None, "b", "xyz xyw"), (2, None, "abc"), (3, "b", None), (4, "a", ""), (5, "b", "123"),
            (6, "und", "qqq qqq"), (7, "c", "𐐀𐐁 İ")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], schema)
    model = langid.train(docs)
    got = sorted((r["doc_id"] or 0, r["lang_pred"], round(r["score"], 6)) for r in langid.detect(docs, model).collect())
    want = _bayes([(lang, t) for _, lang, t in rows if lang is not None and t is not None], [t for *_, t in rows])
    assert got == sorted((i or 0, lang, round(s, 6)) for (i, *_), (lang, s) in zip(rows, want))


def test_thousands_of_languages(spark, monkeypatch):
    rows = [(i, f"l{i:04}", " ".join(chr(0x4E00 + (i * 7 + k * 13) % 9000) * 2 for k in range(6))) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    model = langid.train(docs)
    assert len(model.langs) == 2000
    some = docs.where("doc_id % 40 = 0")
    got = {r["doc_id"]: r for r in langid.detect(some, model).collect()}
    want = dict(zip(range(0, 2000, 40), _bayes([r[1:] for r in rows], [r[2] for r in rows[::40]])))
    assert {i: r["lang_pred"] for i, r in got.items()} == {i: w[0] for i, w in want.items()}
    assert all(got[i]["score"] == pytest.approx(w[1], abs=1e-3) for i, w in want.items())


# ---------------------------------------------------------------- toxicity
def _mix(h):
    h ^= h >> 31
    h = h * 0x7FB5D329728EA185 & M64
    h ^= h >> 27
    h = h * 0x81DADEF4BC2DD44D & M64
    return h ^ (h >> 33)


def _cells(text):
    """Cells of each word: of its stems, short to long, and of itself."""
    out = []
    for w in re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())):
        def cell(part, size):
            h = 0
            for k, b in enumerate(part):
                h += (_mix(b + 1) | 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64)
            return _mix(h & M64) % size
        out.append([(k, cell(w[:k], toxicity.STEM_BUCKETS)) for k in toxicity.STEMS] + [("word", cell(w, toxicity.WORD_BUCKETS))])
    return out


def _maximal(scores):
    """Scores of the maximal segments: the best one, then those left and right of it."""
    out, todo = [], [(0, len(scores))]
    while todo:
        lo, hi = todo.pop()
        best, at, run, start = 0.0, None, 0.0, lo
        for i in range(lo, hi):
            if run <= 0:
                run, start = 0.0, i
            run += scores[i]
            if run > best:
                best, at = run, (start, i + 1)
        if at:
            out.append(best)
            todo += [(lo, at[0]), (at[1], hi)]
    return out


def test_op5_matches_a_plain_model(spark):
    texts = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    labels = dict(duckdb.sql(f"select doc_id, max(toxic) from '{SF}/labels.parquet' where toxic is not null and doc_id is not null group by 1").fetchall())
    labels = {i: int(y > 0) for i, y in labels.items() if not _held_out(i) and i in texts}
    part = {i: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64(struct.pack("<q", i), seed=42).intdigest()) % 4 for i in labels}
    pos, tot = collections.Counter(), collections.Counter()
    cells = {i: _cells(t) for i, t in texts.items()}
    for i, y in labels.items():
        if part[i]:
            for word in cells[i]:
                tot.update(word)
                pos.update(word * y)
    words = [c for c in tot if c[0] == "word"]
    rate = sum(pos[c] for c in words) / sum(tot[c] for c in words)

    def score(word):
        r = rate
        for c in word:
            r = (pos[c] + 2.0 * r) / (tot[c] + 2.0)
        return math.log(r / (1 - r)) - math.log(rate / (1 - rate)) - 0.7

    scores = {i: [score(w) for w in ws] for i, ws in cells.items()}
    found = {i: _maximal(s) for i, s in scores.items()}
    clean = [i for i in labels if part[i] == 0 and labels[i] == 0]
    bins = collections.Counter(min(255, max(0, int((s + 8) * 8))) for i in clean for s in scores[i])
    value = {b: (b + 0.5) / 8 - 8 for b in bins}
    lo, hi = 1e-3, 20.0
    for _ in range(60):
        mid = (lo + hi) / 2
        mean = sum(n * math.exp(min(mid * value[b], 500)) for b, n in bins.items()) / sum(bins.values())
        lo, hi = (mid, hi) if mean < 1 else (lo, mid)
    lam = max(lo, 0.05)
    log_k = sum(lam * max(found[i], default=0) - math.log(max(1, len(scores[i]))) for i in clean) / len(clean) - 0.5772156649
    evidence = {i: math.log1p(sum(max(0.0, lam * s - log_k - math.log(max(1, len(scores[i])))) for s in found[i])) for i in texts}
    xs = [(evidence[i], labels[i]) for i in labels if part[i] == 0]
    a = b = 0.0
    for _ in range(200):  # Newton's method on the penalised likelihood
        p = [1 / (1 + math.exp(-max(-30, min(30, a + b * x)))) for x, _ in xs]
        g = np.array([sum(q - y for q, (_, y) in zip(p, xs)), sum((q - y) * x for q, (x, y) in zip(p, xs)) + 0.1 * b])
        w = [max(q * (1 - q), 1e-9) for q in p]
        h = np.array([[sum(w) + 1e-6, sum(v * x for v, (x, _) in zip(w, xs))], [0, sum(v * x * x for v, (x, _) in zip(w, xs)) + 0.1]])
        h[1, 0] = h[0, 1]
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    got = {r["doc_id"]: r for r in QUERIES["op5_toxicity"](spark, SF).collect()}
    assert set(got) == set(texts)
    for i in texts:
        want = 1 / (1 + math.exp(-max(-30, min(30, a + b * evidence[i]))))
        assert got[i]["score"] == pytest.approx(want, abs=2e-3)
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.3) and got[i]["held_out"] == _held_out(i)


def test_toxicity_of_repeated_and_null_ids(spark):
    bad, good = "awful nasty vile words here " * 8, "quiet river mill valley spring " * 8
    rows = [(i, bad if i % 2 else good) for i in range(80)] + [(3, "other text of the id")] * 50 + [(None, bad)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, y int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(3, 0), (5, None), (None, 1)], "doc_id long, toxic int")
    fitted = toxicity._fit_rows(docs, labels, None, 1000)
    assert fitted.count() == 80 and fitted.where("doc_id = 3").first()["text"] == bad
    out = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(out) == len(rows)
    assert min(r["score"] for r in out if r["doc_id"] == 7) > max(r["score"] for r in out if r["doc_id"] == 8)
    assert len({r["score"] for r in out if r["doc_id"] in (7, 9, None)}) == 1
    assert docs.join(F.broadcast(fitted.select("doc_id")), "doc_id").count() == 130
