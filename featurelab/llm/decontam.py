"""Benchmark decontamination by winnowed word fingerprints.

Words are lower-cased runs of 0-9, a-z and characters above ASCII.  A window is
``WINDOW`` consecutive words of an item; a shorter item is one window.  Of every
``WINDOW - GRAM + 1`` consecutive ``GRAM``-word hashes of a text the smallest is
kept, so two texts that share a window share a kept hash at the same place in
it.  Kept hashes of documents and items are joined, and each hit is extended by
comparing the hashes of all windows around it.  Items of fewer than ``WINDOW``
words are matched by their whole word sequence: for each such length that the
benchmark has, all word runs of that length are fingerprints.

A bit table over the item fingerprints, of fixed size at most, drops document
fingerprints that no item can have before anything is shuffled; false
positives of the table only cost join rows.

Defined results: null and empty texts have no words, no hits and are clean;
items without words match nothing; items with a null id mark words but are not
counted or listed; repeated items count once per id; an empty benchmark leaves
every document clean; repeated document rows are judged one by one; extra and
clashing columns are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import text as tx

WINDOW = 13
GRAM = 7
SPAN = WINDOW - GRAM + 1
#: the bit table has at most 2**MAX_BITS bits (2 MB)
MAX_BITS = 24


def kept_grams(grams: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Positions whose gram is the smallest of a run of ``SPAN`` grams inside one text.

    ``ok[i]``: a whole window of words starts at ``i``.
    """
    if not ok.any():
        return np.empty(0, np.int64)
    low = tx.window_min(grams, SPAN)
    low[~ok[:len(low)]] = 0
    # the largest minimum over the runs that hold a position equals its gram if it is some run's minimum
    edge = np.zeros(SPAN - 1, np.uint64)
    top = ~tx.window_min(~np.concatenate([edge, low, edge]), SPAN)
    return np.flatnonzero((top == grams) & (top != 0))


def fingerprints(raw: np.ndarray, offsets: np.ndarray, short: tuple[int, ...], whole: bool = False):
    """Fingerprints of a chunk of texts.

    Returns words per text and, for each fingerprint, its hash, text, word
    position in the text, window length, and the hashes of the windows around
    it (``SPAN`` columns; 0 where there is none).  ``short``: window lengths
    below ``WINDOW`` to list in full; with ``whole`` only texts of exactly that
    many words have them.
    """
    s, e, rows = tx.words(raw, offsets, "alnum")
    n_rows = len(offsets) - 1
    bounds = tx.row_bounds(rows, n_rows)
    h = tx.span_hashes(raw, s, e, True)
    n = len(h)
    out = []
    if n >= WINDOW:
        wins = tx.gram_hashes(h, WINDOW) | np.uint64(1)
        ok = rows[WINDOW - 1:] == rows[:n - WINDOW + 1]
        grams = tx.gram_hashes(h, GRAM)
        at = kept_grams(grams, ok)
        padded = np.concatenate([np.zeros(SPAN - 1, np.uint64), np.where(ok, wins, 0), np.zeros(WINDOW, np.uint64)])
        out.append((grams[at], at, WINDOW, padded[at[:, None] + np.arange(SPAN)[None, :]]))
    for m in short:
        if n < m:
            continue
        g = tx.gram_hashes(h, m)
        ok = rows[m - 1:] == rows[:n - m + 1]
        if whole:
            ok &= np.diff(bounds)[rows[:n - m + 1]] == m
        at = np.flatnonzero(ok)
        around = np.zeros((len(at), SPAN), np.uint64)
        around[:, SPAN - 1] = g[at] | np.uint64(1)
        out.append((g[at] ^ np.uint64(m), at, m, around))
    if not out:
        z = np.empty(0, np.int64)
        return np.diff(bounds), z.astype(np.uint64), z, z, z, np.empty((0, SPAN), np.uint64)
    at = np.concatenate([o[1] for o in out])
    return (np.diff(bounds), np.concatenate([o[0] for o in out]), rows[at], at - bounds[rows[at]],
            np.concatenate([np.full(len(o[1]), o[2], np.int64) for o in out]), np.concatenate([o[3] for o in out]))


def _lists(values: np.ndarray, width: int) -> pa.Array:
    flat = pa.array(tx.signed(np.ascontiguousarray(values).reshape(-1)))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32)), flat)


def item_fingerprints(items: DataFrame) -> DataFrame:
    """``fp, item_id, length, around`` of every item."""
    src = items.select(F.col("item_id").alias("item_id"), F.col("text").cast("string").alias("text"))
    short = tuple(range(1, WINDOW))

    def run(it):
        for rb in it:
            for i, j, raw, off in tx.utf8_chunks(rb.column(1)):
                _, fp, row, _, length, around = fingerprints(raw, off, short, whole=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tx.signed(fp)), rb.column(0).slice(i, j - i).take(pa.array(row)), pa.array(length.astype(np.int32)),
                     _lists(around, SPAN)], names=["fp", "item_id", "length", "around"])

    kind = src.schema["item_id"].dataType.simpleString()
    return src.mapInArrow(run, f"fp long, item_id {kind}, length int, around array<long>")


def _bit_table(fps: DataFrame) -> np.ndarray:
    """Bits of all item fingerprints modulo the table size; built by the tasks, at most 2**MAX_BITS bits here."""
    n = fps.count()
    bits = min(MAX_BITS, max(16, int(n * 16).bit_length()))
    slot = F.col("fp").bitwiseAND(F.lit((1 << bits) - 1))
    words = fps.groupBy(F.shiftright(slot, 5).alias("w")) \
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(fp & 31 as int))")).alias("b")).toArrow()
    table = np.zeros((1 << bits) >> 5, np.uint32)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy().astype(np.uint32)
    return table


def contamination(docs: DataFrame, items: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``doc_id, n_words, spans, item_ids`` per document row.

    ``spans``: sorted ``array<struct<start, end>>`` of hit words, overlapping
    windows joined; ``item_ids``: the items with a window in the document.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    fps = common.stage(item_fingerprints(items), "item-fps")
    short = tuple(r[0] for r in fps.where(F.col("length") < WINDOW).select("length").distinct().orderBy("length").collect())
    shared = spark.sparkContext.broadcast(_bit_table(fps))
    src = docs.select(F.col(id_column).alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(it):
        table = shared.value
        mask = np.uint64(len(table) * 32 - 1)
        for rb in it:
            for i, j, raw, off in tx.utf8_chunks(rb.column(1)):
                n_words, fp, row, pos, length, around = fingerprints(raw, off, short)
                slot = fp & mask
                hit = np.flatnonzero((table[slot >> np.uint64(5)] >> (slot & np.uint64(31)).astype(np.uint32)) & np.uint32(1))
                hit = hit[np.argsort(row[hit], kind="stable")]
                ends = np.searchsorted(row[hit], np.arange(j - i + 1))
                hits = pa.StructArray.from_arrays(
                    [pa.array(tx.signed(fp[hit])), pa.array(pos[hit]), pa.array(length[hit].astype(np.int32)), _lists(around[hit], SPAN)],
                    names=["fp", "pos", "length", "around"])
                yield pa.RecordBatch.from_arrays(
                    [rb.column(0).slice(i, j - i), pa.array(n_words.astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), hits)], names=["doc_id", "n_words", "hits"])

    kind = src.schema["doc_id"].dataType.simpleString()
    found = src.mapInArrow(run, f"doc_id {kind}, n_words long, hits array<struct<fp:long,pos:long,length:int,around:array<long>>>")
    # the row number keeps repeated document ids apart; staged, so it is the same for both consumers
    found = common.stage(found.withColumn("row", F.monotonically_increasing_id()), "doc-fps")
    hit = found.where(F.size("hits") > 0).select("row", F.explode("hits").alias("h")) \
        .select("row", "h.fp", "h.pos", "h.length", F.col("h.around").alias("mine"))
    pairs = hit.join(fps, ["fp", "length"])
    start = F.col("pos") - F.lit(SPAN - 1)
    equal = F.filter(F.sequence(F.lit(0), F.lit(SPAN - 1)),
                     lambda k: (F.get("mine", k) == F.get("around", k)) & (F.get("mine", k) != 0))
    wins = pairs.select("row", "item_id", "length", F.explode(F.transform(equal, lambda k: start + k)).alias("start"))
    per_doc = wins.groupBy("row").agg(
        F.collect_set("item_id").alias("item_ids"),
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("w"))
    joined = F.aggregate("w", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"), _join_span)
    per_doc = per_doc.select("row", "item_ids", joined.alias("spans"))
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    out = found.select("row", "doc_id", "n_words").join(per_doc, "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("spans", none).alias("spans"),
                      F.coalesce("item_ids", F.array().cast(per_doc.schema["item_ids"].dataType)).alias("item_ids"))


def _join_span(acc, w):
    """Add a window to the joined spans; windows come in order of their start."""
    last = F.try_element_at(acc, F.lit(-1))
    grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], w["end"]).alias("end"))
    return F.when((F.size(acc) > 0) & (last["end"] >= w["start"]),
                  F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))) \
        .otherwise(F.concat(acc, F.array(F.struct(w["start"].alias("start"), w["end"].alias("end")))))
