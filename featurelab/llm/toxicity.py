"""Toxicity by maximum-scoring segments of token log-odds.

1. Token log-odds.  Words of labelled rows are counted per class.  The rate of
   class 1 of a word is shrunk by a Dirichlet prior towards the rate of its
   8-byte prefix, that one towards its 6-byte and 4-byte prefixes and finally
   the overall rate, so unseen and rare words fall back to what their stem says.
   Tables are hashed to a fixed size, which bounds what is broadcast.
2. Segments.  Each token scores ``log-odds - PENALTY``, negative for ordinary
   text.  One left-to-right scan finds all maximal scoring segments; only
   tokens of positive score are visited, the runs between them are prefix sums.
3. Extreme values.  Under background text the best segment of n tokens follows
   an extreme-value law, so a segment of score S is expected
   ``E = K n exp(-lambda S)`` times by chance.  ``lambda`` solves
   ``mean(exp(lambda s)) = 1`` over background tokens, ``K`` fits the background
   documents' best segments.  A document's evidence is the sum of ``-log E``
   over its segments with ``E < 1``; a logistic curve fitted on labelled rows
   that were not counted maps evidence to a probability.

Defined results: null and empty texts have no tokens and get the probability
of zero evidence; a document with several labels takes the largest; null
labels are not learned from; of several texts of one id the smallest is learned from; without both classes among the labels every
score is the observed rate (0 without labels); repeated rows are scored one by
one; an empty table gives an empty result.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from . import text as tx

#: the classifier is fitted on at most this many labelled rows
FIT_ROWS = 20000
#: of the fit rows, one in CALIBRATE is kept for calibration and not counted
CALIBRATE = 4
WORD_BUCKETS = 1 << 18
STEM_BUCKETS = 1 << 16
STEMS = (4, 6, 8)
PRIOR = 2.0
PENALTY = 0.7
_SPAN = WORD_BUCKETS + len(STEMS) * STEM_BUCKETS


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Table cells of every word (its stems, short to long, then itself), and the row of each word."""
    s, e, rows = tx.words(raw, offsets, "alnum")
    if not len(s):
        return [np.empty(0, np.int64)] * (len(STEMS) + 1), rows
    p, inv = tx._powers(len(raw) + 1)
    c = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(tx.byte_codes(True)[raw] * p[:len(raw)], out=c[1:])
    cells = []
    for i, k in enumerate(STEMS):
        h = tx.mix((c[np.minimum(e, s + k)] - c[s]) * inv[s])
        cells.append((h & np.uint64(STEM_BUCKETS - 1)).astype(np.int64) + WORD_BUCKETS + i * STEM_BUCKETS)
    cells.append((tx.mix((c[e] - c[s]) * inv[s]) & np.uint64(WORD_BUCKETS - 1)).astype(np.int64))
    return cells, rows


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)`` of one score sequence, in linear time."""
    cum = np.concatenate([[0.0], np.cumsum(scores)])
    out: list[list] = []  # start, end, sum before, sum after
    for i in np.flatnonzero(scores > 0):
        seg = [int(i), int(i) + 1, cum[i], cum[i + 1]]
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= seg[2]:
                j = out[j][4]
            if j < 0 or out[j][3] >= seg[3]:
                out.append([*seg, j])
                break
            seg = [out[j][0], seg[1], out[j][2], seg[3]]
            del out[j:]
    return [(s, e, float(b - a)) for s, e, a, b, _ in out]


class Model:
    """Hashed class counts, extreme-value parameters and the logistic curve."""

    def __init__(self, pos: np.ndarray, tot: np.ndarray):
        self.rate = float(pos[:WORD_BUCKETS].sum() / max(1, tot[:WORD_BUCKETS].sum()))
        self.pos, self.tot = pos.astype(np.float32), tot.astype(np.float32)
        self.lam, self.k, self.a, self.b, self.flat = 1.0, 1.0, 0.0, 0.0, None

    def scores(self, cells: list[np.ndarray]) -> np.ndarray:
        r = np.full(len(cells[0]), self.rate, np.float64)
        for c in cells:
            r = (self.pos[c] + PRIOR * r) / (self.tot[c] + PRIOR)
        r = np.clip(r, 1e-6, 1 - 1e-6)
        base = min(max(self.rate, 1e-6), 1 - 1e-6)
        return np.log(r / (1 - r)) - math.log(base / (1 - base)) - PENALTY

    def evidence(self, best: list[float], n: int) -> float:
        total = 0.0
        for s in best:
            log_e = math.log(self.k * max(1, n)) - self.lam * s
            total += max(0.0, -log_e)
        return total

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(evidence), self.flat)
        return 1.0 / (1.0 + np.exp(-np.clip(self.a + self.b * np.log1p(evidence), -30, 30)))


def _documents(model: Model, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, list, np.ndarray]]:
    """Token count, segments and token scores of every row of a chunk."""
    cells, rows = tokens(raw, offsets)
    s = model.scores(cells)
    bounds = tx.row_bounds(rows, len(offsets) - 1)
    hot = np.concatenate([[0], np.cumsum(s > 0)])
    for i in range(len(offsets) - 1):
        a, b = bounds[i], bounds[i + 1]
        yield int(b - a), (segments(s[a:b]) if hot[b] > hot[a] else []), s[a:b]


def _fit_rows(docs: DataFrame, labels: DataFrame, where: Column | None, limit: int) -> DataFrame:
    """At most ``limit`` labelled rows, chosen by a hash of the id; ``part`` 0 is for calibration."""
    lab = labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
    lab = lab.where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    if where is not None:
        lab = lab.where(where)
    h = F.xxhash64("doc_id")
    lab = lab.withColumn("h", h).orderBy("h", "doc_id").limit(limit)
    lab = lab.select("doc_id", (F.col("y") > 0).cast("int").alias("y"), F.pmod("h", F.lit(CALIBRATE)).cast("int").alias("part"))
    # at most `limit` rows of three numbers: a broadcast of bounded size; of rows that share an id one text is fitted
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(lab), "doc_id")
    return rows.groupBy("doc_id", "y", "part").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, where: Column | None = None, fit_rows: int = FIT_ROWS) -> Model:
    spark = docs.sparkSession
    common.prepare(spark)
    rows = _fit_rows(docs, labels, where, fit_rows)

    def count(it):
        pos, tot = np.zeros(_SPAN, np.int64), np.zeros(_SPAN, np.int64)
        for rb in it:
            y = rb.column(0).to_numpy()
            for i, j, raw, off in tx.utf8_chunks(rb.column(1)):
                cells, owner = tokens(raw, off)
                w = y[i:j][owner]
                for c in cells:
                    tot += np.bincount(c, minlength=_SPAN)
                    pos += np.bincount(c, weights=w, minlength=_SPAN).astype(np.int64)
        at = np.flatnonzero(tot)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(pos[at]), pa.array(tot[at])], names=["cell", "pos", "tot"])

    got = rows.where("part <> 0").select("y", "text").mapInArrow(count, "cell long, pos long, tot long") \
        .groupBy("cell").agg(F.sum("pos").alias("pos"), F.sum("tot").alias("tot")).toArrow()
    pos, tot = np.zeros(_SPAN, np.int64), np.zeros(_SPAN, np.int64)
    cell = got.column("cell").to_numpy()
    pos[cell], tot[cell] = got.column("pos").to_numpy(), got.column("tot").to_numpy()
    model = Model(pos, tot)
    shared = spark.sparkContext.broadcast(model)

    def best(it):
        for rb in it:
            y = rb.column(0).to_numpy()
            for i, j, raw, off in tx.utf8_chunks(rb.column(1)):
                ns, segs, hist = [], [], []
                for n, found, s in _documents(shared.value, raw, off):
                    ns.append(n)
                    segs.append([x[2] for x in found])
                    hist.append(np.bincount(np.clip(((s + 8) * 8).astype(np.int64), 0, 255), minlength=256))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(y[i:j].astype(np.int32)), pa.array(ns, pa.int64()), pa.array(segs, pa.list_(pa.float64())),
                     pa.array(hist, pa.list_(pa.int64()))], names=["y", "n", "segs", "hist"])

    cal = rows.where("part = 0").select("y", "text").mapInArrow(best, "y int, n long, segs array<double>, hist array<long>").toArrow().to_pandas()
    shared.unpersist()
    _calibrate(model, cal)
    return model


def _calibrate(model: Model, cal) -> None:
    y = cal["y"].to_numpy() if len(cal) else np.empty(0)
    if len(y) == 0 or y.min() == y.max():
        model.flat = float(y.mean()) if len(y) else 0.0
        return
    clean = cal[cal["y"] == 0]
    hist = np.sum(clean["hist"].tolist(), axis=0).astype(np.float64)
    value = (np.arange(256) + 0.5) / 8 - 8
    if hist[value > 0].sum() > 0:
        lo, hi = 1e-3, 20.0
        w = hist / hist.sum()
        for _ in range(60):  # mean(exp(lambda s)) - 1 is below zero under the root
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (w * np.exp(np.minimum(mid * value, 500))).sum() < 1 else (lo, mid)
        model.lam = max(lo, 0.05)
    # mean of lambda * S_max is log(K n) plus Euler's constant under the extreme-value law
    top = np.array([max(x, default=0.0) for x in clean["segs"].tolist()])
    n = np.maximum(1, clean["n"].to_numpy())
    model.k = float(np.exp(np.mean(model.lam * top - np.log(n)) - 0.5772156649))
    x = np.log1p(np.array([model.evidence(s, m) for s, m in zip(cal["segs"].tolist(), cal["n"].tolist())]))
    a = b = 0.0
    for _ in range(50):  # Newton steps of a ridge logistic regression on one feature
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = np.array([(p - y).sum(), ((p - y) * x).sum() + 0.1 * b])
        w = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[w.sum() + 1e-6, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 0.1]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    model.a, model.b = float(a), float(b)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """``doc_id, score, predicted, passages`` (``array<struct<start, end, score>>`` in words) of every row."""
    spark = docs.sparkSession
    common.prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    src = docs.select(F.col(id_column).alias("doc_id"), F.col("text").cast("string").alias("text"))
    passage = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(it):
        m = shared.value
        for rb in it:
            for i, j, raw, off in tx.utf8_chunks(rb.column(1)):
                ev, found = [], []
                for n, segs, _ in _documents(m, raw, off):
                    ev.append(m.evidence([s[2] for s in segs], n))
                    limit = math.log(m.k * max(1, n)) / m.lam if m.k > 0 else 0.0
                    found.append([{"start": a, "end": b, "score": s} for a, b, s in segs if s > limit])
                p = m.probability(np.array(ev))
                yield pa.RecordBatch.from_arrays(
                    [rb.column(0).slice(i, j - i), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32)),
                     pa.array(found, passage)], names=["doc_id", "score", "predicted", "passages"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double, predicted int, "
                               "passages array<struct<start:long,end:long,score:double>>")
