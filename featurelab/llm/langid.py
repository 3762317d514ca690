"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of code points (n = 1..``MAX_N``, lower case, letters
and single word gaps only) into ``BUCKETS`` hash buckets per language.  Each
task sends its sparse partial counts; the summed counts become log
probabilities, kept as a language's value for an n-gram it never saw and, per
bucket, what the languages that saw it add.  Scoring sums both for a whole batch
of texts (a sparse batch product in numpy; languages that saw most buckets are
gathered as columns).  Languages are taken in blocks of ``BLOCK_LANGS``, so a
broadcast holds at most ``BLOCK_LANGS x BUCKETS`` values for any number of them;
texts pass the blocks one after the other, each updates the best language so far.

Defined results: a null text, or one without letters, gives ``und`` and score
0; labels that are null are not learned from; with no training rows every text
is ``und``; ties go to the smaller language name; repeated rows count and are
predicted one by one; an empty table gives an empty result.
"""
from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from . import text as tx

BUCKETS = 1 << 15
MAX_N = 3
#: languages of one broadcast block
BLOCK_LANGS = 256
#: languages whose dense counts a training task holds before it sends them on
HELD_LANGS = 64
#: additive smoothing of the counts
ALPHA = 0.5
#: products of a text and a bucket's language that are formed at a time
_PRODUCTS = 1 << 20
_MULT = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


@functools.lru_cache(maxsize=1)
def _fold_table() -> np.ndarray:
    """Lower-case letter of each code point of the BMP; 0 where it is no letter."""
    out = np.zeros(0x10000, np.uint32)
    for c in range(0x10000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low[0]) if len(low) >= 1 else c
    return out


def _letters(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded letters of a chunk with one gap (0) between words, the text of each, and letters per text."""
    n = len(offsets) - 1
    starts = (raw & 0xC0) != 0x80
    at = np.flatnonzero(starts)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    rows = np.searchsorted(offsets, at, "right") - 1
    table = _fold_table()
    low = np.where(points < 0x10000, table[np.minimum(points, 0xFFFF)], 0)
    high = points >= 0x10000
    if high.any():
        low[high] = [ord(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in points[high]]
    letters = np.bincount(rows[low > 0], minlength=n)
    keep = np.ones(len(low), bool)  # runs of non-letters become one gap
    keep[1:] = (low[1:] > 0) | (low[:-1] > 0) | (rows[1:] != rows[:-1])
    return low[keep], rows[keep], letters


def ngram_buckets(raw: np.ndarray, offsets: np.ndarray):
    """Bucket and text of every n-gram of a chunk, and letters per text."""
    low, rows, letters = _letters(raw, offsets)
    buckets, owner = [], []
    h = np.zeros(len(low), np.uint32)
    for n in range(1, MAX_N + 1):
        m = len(low) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193) + low[n - 1:] + np.uint32(n)
        ok = (rows[n - 1:] == rows[:m]) & (low[:m] + low[n - 1:] > 0)
        g = h * _MULT[n % 3]
        buckets.append(((g ^ (g >> np.uint32(15))) & np.uint32(BUCKETS - 1))[ok].astype(np.int32))
        owner.append(rows[:m][ok])
    return buckets, owner, letters


class Block:
    """Log probabilities of some languages (``langs``, sorted): ``lang, bucket, n`` are their counts."""

    def __init__(self, langs: list[str], docs: np.ndarray, all_docs: int, lang: np.ndarray, bucket: np.ndarray, n: np.ndarray):
        self.langs, k = langs, len(langs)
        self.prior = np.log(np.maximum(docs, 1) / max(1, all_docs))
        self.base = np.log(ALPHA / (np.bincount(lang, weights=n, minlength=k) + ALPHA * BUCKETS))
        value = np.log1p(n / ALPHA).astype(np.float32)
        often = np.bincount(lang, minlength=k) > BUCKETS // 4
        self.often = np.flatnonzero(often)
        self.columns = np.zeros((len(self.often), BUCKETS), np.float32)
        full = often[lang]
        self.columns[np.searchsorted(self.often, lang[full]), bucket[full]] = value[full]
        order = np.argsort(bucket[~full], kind="stable")
        self.lang, self.value = lang[~full][order], value[~full][order]
        self.starts = np.searchsorted(bucket[~full][order], np.arange(BUCKETS + 1))

    def scores(self, buckets: list[np.ndarray], owner: list[np.ndarray], n: int) -> np.ndarray:
        """Log likelihood of each of ``n`` texts under each language."""
        grams = sum((np.bincount(o, minlength=n) for o in owner), np.zeros(n))
        ll = self.prior + grams[:, None] * self.base
        k = len(self.langs)
        for b, o in zip(buckets, owner):
            for j, column in zip(self.often, self.columns):
                ll[:, j] += np.bincount(o, weights=column[b], minlength=n)
            sizes = self.starts[b + 1] - self.starts[b]
            some = np.flatnonzero(sizes)
            ends = np.cumsum(sizes[some])
            for i, j in _slices(ends, _PRODUCTS):
                at, size = some[i:j], sizes[some[i:j]]
                first = np.repeat(self.starts[b[at]] - (np.cumsum(size) - size), size)
                cell = first + np.arange(len(first))
                ll += np.bincount(np.repeat(o[at], size) * k + self.lang[cell], weights=self.value[cell], minlength=n * k).reshape(n, k)
        return ll


def _slices(ends: np.ndarray, limit: int):
    """Runs of items whose running total ``ends`` grows by about ``limit`` each."""
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, "right")))
        yield i, j
        i = j


class Model:
    """The sorted language names, their rows and the staged counts; the driver builds one block at a time."""

    def __init__(self, langs: list[str], cells: DataFrame | None, per_lang: np.ndarray):
        self.langs, self.cells, self.per_lang = langs, cells, per_lang

    def blocks(self):
        for a in range(0, len(self.langs), BLOCK_LANGS):
            b = min(a + BLOCK_LANGS, len(self.langs))
            got = self.cells.where((F.col("lang") >= a) & (F.col("lang") < b)).toArrow()
            lang, bucket, n = (got.column(c).to_numpy() for c in ("lang", "bucket", "n"))
            yield Block(self.langs[a:b], self.per_lang[a:b], int(self.per_lang.sum()), lang - a, bucket, n)


def train(docs: DataFrame, where: Column | None = None) -> Model:
    """Count the n-grams of the labelled rows (all of them, or those ``where`` holds)."""
    spark = docs.sparkSession
    common.prepare(spark)
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"),
                       F.coalesce(where if where is not None else F.lit(True), F.lit(False)).alias("use"))
    rows = rows.where("use and lang is not null and text is not null").select("lang", "text")
    per_lang = sorted(tuple(r) for r in rows.groupBy("lang").count().collect())
    if not per_lang:
        return Model([], None, np.empty(0, np.int64))
    langs = [r[0] for r in per_lang]
    names = spark.sparkContext.broadcast({v: i for i, v in enumerate(langs)})

    def count(it):
        held: dict[int, np.ndarray] = {}

        def send():
            for k, total in held.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(total[at])], names=["lang", "bucket", "n"])
            held.clear()

        for rb in it:
            lang = np.array([names.value[x] for x in rb.column(0).to_pylist()], np.int64)
            for i, j, raw, off in tx.utf8_chunks(rb.column(1)):
                present, local = np.unique(lang[i:j], return_inverse=True)
                for b, o in zip(*ngram_buckets(raw, off)[:2]):
                    for s in range(0, len(present), HELD_LANGS):
                        some = present[s:s + HELD_LANGS]
                        code = local[o] - s
                        if len(some) < len(present):
                            of = (code >= 0) & (code < len(some))
                            code, part = code[of], b[of]
                        else:
                            part = b
                        total = np.bincount(code * BUCKETS + part, minlength=len(some) * BUCKETS).reshape(len(some), BUCKETS)
                        for k, t in zip(some.tolist(), total):
                            held[k] = held[k] + t if k in held else t.copy()
                        if len(held) > HELD_LANGS:
                            yield from send()
        yield from send()

    cells = rows.mapInArrow(count, "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return Model(langs, common.stage(cells, "language-counts"), np.array([r[1] for r in per_lang], np.int64))


def detect(docs: DataFrame, model: Model, id_column: str = "doc_id") -> DataFrame:
    """``doc_id, lang_pred, score`` of every row; reads the text only."""
    spark = docs.sparkSession
    common.prepare(spark)
    out = docs.select(F.col(id_column).alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit("und").alias("lang_pred"),
                      F.lit(float("-inf")).alias("top"), F.lit(float("-inf")).alias("total"))
    kind = out.schema["doc_id"].dataType.simpleString()

    def update(shared):
        def run(it):
            block = shared.value
            for rb in it:
                for i, j, raw, off in tx.utf8_chunks(rb.column(1)):
                    buckets, owner, letters = ngram_buckets(raw, off)
                    ll = block.scores(buckets, owner, j - i)
                    before, top, total = (rb.column(c).slice(i, j - i) for c in (2, 3, 4))
                    best, most = ll.argmax(axis=1), ll.max(axis=1)
                    better = (most > top.to_numpy()) & (letters > 0)
                    total = np.where(letters > 0, np.logaddexp(total.to_numpy(), most + np.log(np.exp(ll - most[:, None]).sum(axis=1))), -np.inf)
                    names = [block.langs[k] if b else x for k, b, x in zip(best, better, before.to_pylist())]
                    yield pa.RecordBatch.from_arrays(
                        [rb.column(0).slice(i, j - i), rb.column(1).slice(i, j - i), pa.array(names, pa.string()),
                         pa.array(np.where(better, most, top.to_numpy())), pa.array(total)], names=["doc_id", "text", "lang_pred", "top", "total"])

        return run

    for block in model.blocks():
        out = out.mapInArrow(update(spark.sparkContext.broadcast(block)), f"doc_id {kind}, text string, lang_pred string, top double, total double")
    score = F.when(F.col("total") == float("-inf"), 0.0).otherwise(F.least(F.exp(F.col("top") - F.col("total")), F.lit(1.0)))
    if not model.langs:
        score = F.lit(0.0)
    return out.select("doc_id", "lang_pred", score.alias("score"))
