"""Quality rules as a short-circuit cascade.

Each rule is a vectorised reject test over the documents of one Arrow batch.
``plan_cascade`` times every rule and counts its rejections on a bounded
sample, and orders the rules by rejections per second; ``quality_rules`` runs
them in that order, and a rule only sees the documents that all earlier rules
kept.  The order changes the cost and ``failed_rule``, never the verdict.

Defined results: a null text counts as an empty one (no words, rejected by the
word-count rule); repeated rows are judged one by one; an empty table gives an
empty result; extra input columns are carried along, and an input column named
like an output column is replaced.
"""
from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import text as tx

#: rows of the sample on which costs and selectivities are estimated (they decide the order, not the verdict)
SAMPLE_ROWS = 256
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[128:] = True


class Batch:
    """Texts of one chunk with lazily computed, shared word boundaries."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets, self.n = raw, offsets, len(offsets) - 1
        self._words = None
        self._hashes = None

    @property
    def words(self):
        if self._words is None:
            self._words = tx.words(self.raw, self.offsets, "space")
        return self._words

    @property
    def word_bounds(self):
        return tx.row_bounds(self.words[2], self.n)

    @property
    def hashes(self):
        if self._hashes is None:
            self._hashes = tx.span_hashes(self.raw, self.words[0], self.words[1], False)
        return self._hashes

    def per_row(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text the byte mask marks."""
        c = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return c[self.offsets[1:]] - c[self.offsets[:-1]]

    def take(self, keep: np.ndarray) -> "Batch":
        """The batch of the marked rows."""
        if keep.all():
            return self
        lens = np.diff(self.offsets)
        return Batch(self.raw[np.repeat(keep, lens)], np.concatenate([[0], np.cumsum(lens[keep])]))


def n_words(b: Batch) -> np.ndarray:
    return np.diff(b.word_bounds).astype(np.int64)


def word_chars(b: Batch) -> np.ndarray:
    return b.per_row(tx.word_table("space")[b.raw] & ((b.raw & 0xC0) != 0x80))


def n_symbols(b: Batch) -> np.ndarray:
    return b.per_row(_SYMBOLS[b.raw])


def _lines(b: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the newline-split lines that hold a word."""
    nl = np.flatnonzero(b.raw == 10)
    starts = np.unique(np.concatenate([b.offsets[:-1], nl + 1]))
    starts = starts[starts < len(b.raw)]
    ends = np.minimum(np.append(starts[1:], len(b.raw)), len(b.raw))
    ends = np.where(np.isin(ends - 1, nl) & (ends > starts), ends - 1, ends)
    ws = b.words[0]
    has = np.searchsorted(ws, ends) > np.searchsorted(ws, starts)
    starts, ends = starts[has], ends[has]
    return starts, ends, np.searchsorted(b.offsets, starts, "right") - 1


def _first_seen(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: is its key new in its row, and does the row hold the key twice."""
    order = np.lexsort((keys, rows))
    k, r = keys[order], rows[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    more = ~new
    more[:-1] |= ~new[1:]
    first, twice = np.empty(len(k), bool), np.empty(len(k), bool)
    first[order], twice[order] = new, more
    return first, twice


def line_counts(b: Batch) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those equal to an earlier line of the same text."""
    s, e, r = _lines(b)
    first, _ = _first_seen(tx.span_hashes(b.raw, s, e, False), r)
    return np.bincount(r, minlength=b.n), np.bincount(r[~first], minlength=b.n)


def n_repeat_words(b: Batch) -> np.ndarray:
    """Words inside three-word windows that occur twice or more in the text."""
    rows = b.words[2]
    n = len(rows)
    if n < 3:
        return np.zeros(b.n, np.int64)
    ok = rows[2:] == rows[:-2]
    at = np.flatnonzero(ok)
    _, twice = _first_seen(tx.gram_hashes(b.hashes, 3)[at], rows[at])
    mark = np.zeros(n, bool)
    for i in range(3):
        mark[at[twice] + i] = True
    return np.bincount(rows[mark], minlength=b.n)


def _few_words(b):
    return n_words(b) < 50


def _repeats(b):
    return 100 * n_repeat_words(b) > 50 * n_words(b)


def _many_symbols(b):
    return 10 * n_symbols(b) > n_words(b)


def _same_lines(b):
    lines, dup = line_counts(b)
    return 2 * dup > lines


def _odd_word_length(b):
    n, c = n_words(b), word_chars(b)
    return (c < 2 * n) | (c > 20 * n)


def _no_letters(b):
    s, e, r = b.words
    c = np.concatenate([[0], np.cumsum(_ALPHA[b.raw], dtype=np.int64)])
    return 2 * np.bincount(r[c[e] > c[s]], minlength=b.n) < n_words(b)


#: the contract's base rules, and the further rules of this operator
BASE_RULES: dict[str, Callable] = {"few_words": _few_words, "repeats": _repeats}
RULES: dict[str, Callable] = {"many_symbols": _many_symbols, "same_lines": _same_lines,
                              "odd_word_length": _odd_word_length, "no_letters": _no_letters}


def _batches(column: pa.Array) -> Iterator[Batch]:
    for _, _, raw, off in tx.utf8_chunks(column):
        yield Batch(raw, off)


def plan_cascade(docs: DataFrame, rules: tuple[str, ...], sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """``[(rule, seconds per document, rejected fraction), ...]`` in the order to run.

    Measured on at most ``sample_rows`` documents; rules with equal ratios stay
    in the given order.
    """
    checks = {**BASE_RULES, **RULES}
    # the first rows only, fetched as `head` does: no exchange, a bounded number of texts
    texts = pa.array([r[0] for r in docs.select(F.col("text").cast("string")).head(sample_rows)], pa.string())
    n, cost, bad = max(1, len(texts)), dict.fromkeys(rules, 0.0), dict.fromkeys(rules, 0)
    for sample in _batches(texts):
        for name in rules:
            b = Batch(sample.raw, sample.offsets)
            t = time.perf_counter()
            bad[name] += int(checks[name](b).sum())
            cost[name] += time.perf_counter() - t
    plan = [(name, cost[name] / n, bad[name] / n) for name in rules]
    return sorted(plan, key=lambda p: -(p[2] / (p[1] + 1e-9)))


_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def quality_rules(docs: DataFrame, rules: tuple[str, ...] | None = None, id_column: str = "doc_id",
                  sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: the base counts, ``base_failed``, ``kept`` and ``failed_rule``.

    The counts are part of the result and so are computed for every document;
    the cascade runs on what the base rules keep.
    """
    common.prepare(docs.sparkSession)
    rules = tuple(RULES) if rules is None else rules
    order = [p[0] for p in plan_cascade(docs, rules, sample_rows)]
    src = docs.select(F.col(id_column).alias("doc_id"), F.col("text").cast("string").alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()

    def run(it):
        for rb in it:
            ids = rb.column(0)
            for i, j, raw, off in tx.utf8_chunks(rb.column(1)):
                b = Batch(raw, off)
                nw, rep = n_words(b), n_repeat_words(b)
                _, dup = line_counts(b)
                base = (nw < 50) | (100 * rep > 50 * nw)
                failed = np.where(base, np.where(nw < 50, "few_words", "repeats"), "").astype(object)
                alive = np.flatnonzero(~base)
                live = b.take(~base)
                for name in order:
                    if not len(alive):
                        break
                    bad = RULES[name](live)
                    failed[alive[bad]] = name
                    alive, live = alive[~bad], live.take(~bad)
                cols = [nw, word_chars(b), n_symbols(b), dup.astype(np.int64), rep.astype(np.int64)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), *(pa.array(c, pa.int64()) for c in cols), pa.array(base),
                     pa.array(failed == ""), pa.array([f or None for f in failed], pa.string())],
                    names=["doc_id", *(c.split()[0] for c in _STATS.split(", ")), "base_failed", "kept", "failed_rule"])

    return src.mapInArrow(run, f"doc_id {id_type}, {_STATS}, base_failed boolean, kept boolean, failed_rule string")


def keep_good(docs: DataFrame, rules: tuple[str, ...] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns.

    Base and further rules form one cascade here, so a rejected document costs
    only the rules up to the one that rejects it.
    """
    common.prepare(docs.sparkSession)
    names = (*BASE_RULES, *(tuple(RULES) if rules is None else rules))
    order = [p[0] for p in plan_cascade(docs, names, sample_rows)]
    checks = {**BASE_RULES, **RULES}

    def run(it):
        for rb in it:
            *columns, texts = rb.columns
            keep = np.zeros(rb.num_rows, bool)
            for i, _, raw, off in tx.utf8_chunks(texts):
                live = Batch(raw, off)
                alive = np.arange(live.n)
                for name in order:
                    if not len(alive):
                        break
                    bad = checks[name](live)
                    alive, live = alive[~bad], live.take(~bad)
                keep[i + alive] = True
            yield pa.RecordBatch.from_arrays(columns, names=rb.schema.names[:-1]).filter(pa.array(keep))

    return docs.select("*", F.col("text").cast("string").alias("_judged")).mapInArrow(run, docs.schema)
