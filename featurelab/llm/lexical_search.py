"""Ranked lexical search in norm buckets.

1. One pass over the texts turns every document into its length and the
   frequencies of the terms that some query has; each batch adds a summary row
   (documents, terms, documents per query term), so corpus statistics are sums
   over batches.
2. A document's impacts follow from its frequencies.  Its vector is scaled by
   ``sqrt(weight)`` per term, a query's by the same, so their product is the score
   and Cauchy-Schwarz bounds it by the product of their lengths.
3. Documents are ordered by vector length, longest first, in ranges.  The longest
   ones are searched first and give every query a threshold, its tenth best score
   so far.  In the other ranges each batch is a bucket: a query whose length
   times the bucket's greatest length stays below its threshold skips the bucket.
   Inside, the greatest impact of every term in the bucket bounds what a term can
   add; the terms that together cannot reach the threshold name no candidate, and
   documents without any other term of the query are left out.  Candidates whose
   own length is too small go next.  The survivors are scored exactly in 64-bit
   integers, and the threshold rises.
4. Every task returns at most ``k`` documents per query; the best ``k`` of these
   are the result.

A bound drops a document only if it lies below the threshold, so ties are kept
and the result is exact.  Terms are compared by 64-bit hashes.  Queries are taken
in blocks of bounded size (``BLOCK_TERMS``), each with a pass of its own.

Defined results: a null or empty text has no term, a document without terms is
counted nowhere and never returned; a row with a null id counts in the statistics
but is not returned; rows that repeat an id are documents of their own; each item
row is a query of its own, one with a null id or no term has no result; empty
tables give an empty result; extra and clashing columns are not read.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from . import text as tx

#: documents returned per query
TOP = 10
#: distinct (query, term) pairs of a block of queries, which every task holds (16 bytes each)
BLOCK_TERMS = 2_000_000
#: share of the documents, the longest vectors, that gives the first thresholds
LONGEST = 1 / 64
#: bounds are floating point; they are widened by this factor before they drop anything
_SLACK = 1 + 1e-9


def _terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every term of a chunk of texts."""
    s, e, rows = tx.words(raw, offsets, "alnum")
    return tx.span_hashes(raw, s, e, True), rows


def _counted(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) in that order and their counts."""
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (r[1:] != r[:-1])]))
    return r[new], h[new], np.diff(np.append(new, len(h)))


def query_terms(items: DataFrame, id_column: str = "item_id") -> DataFrame:
    """``query, item_id, term, times``: the distinct terms of every item row."""
    kind = items.schema[id_column].dataType.simpleString()

    def run(it):
        for rb in it:
            for i, j, raw, off in tx.utf8_chunks(rb.column(2)):
                r, h, n = _counted(*_terms(raw, off))
                at = pa.array(r + i)
                yield pa.RecordBatch.from_arrays([rb.column(0).take(at), rb.column(1).take(at), pa.array(tx.signed(h)), pa.array(n.astype(np.int64))],
                                                 names=["query", "item_id", "term", "times"])

    rows = items.where(F.col(id_column).isNotNull()).select(
        F.monotonically_increasing_id().alias("query"), F.col(id_column).alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"query long, item_id {kind}, term long, times long")


class _Queries:
    """A block of queries: its vocabulary and each query's terms as positions in it."""

    def __init__(self, block: DataFrame):
        rows = block.select("query", "term", "times").toArrow()
        query, term, self.times = (rows.column(i).to_numpy() for i in range(3))
        self.vocabulary, self.term = np.unique(term.view(np.uint64), return_inverse=True)
        self.ids, self.query = np.unique(query, return_inverse=True)
        order = np.lexsort((self.term, self.query))
        self.term, self.query, self.times = self.term[order], self.query[order], self.times[order]
        self.bounds = np.searchsorted(self.query, np.arange(len(self.ids) + 1))


def sparse_documents(docs: DataFrame, vocabulary, id_column: str = "doc_id") -> DataFrame:
    """``doc_id, n, summary, terms, counts`` of every document with a term, and a summary row per batch.

    A summary row has the number of documents in ``doc_n``, of terms in ``n``, and
    the documents per vocabulary term in ``terms, counts``.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    src = docs.select(F.col(id_column).alias("doc_id"), F.col("text").cast("string").alias("text"))

    def lists(values, ends):
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(np.int32)))

    def run(it):
        words = vocabulary.value
        for rb in it:
            seen, n_docs, n_terms = np.zeros(len(words), np.int64), 0, 0
            for i, j, raw, off in tx.utf8_chunks(rb.column(1)):
                h, rows = _terms(raw, off)
                n = np.bincount(rows, minlength=j - i)
                n_docs, n_terms = n_docs + np.count_nonzero(n), n_terms + len(h)
                at = np.minimum(np.searchsorted(words, h), len(words) - 1)
                known = words[at] == h
                r, t, c = _counted(at[known], rows[known])
                seen += np.bincount(t, minlength=len(words))
                some = np.flatnonzero(np.bincount(r, minlength=j - i))
                ends = np.append(0, np.searchsorted(r, some, "right"))
                yield pa.RecordBatch.from_arrays(
                    [rb.column(0).take(pa.array(some + i)), pa.array(n[some]), pa.array(np.zeros(len(some), np.int64)), lists(t, ends), lists(c, ends)],
                    names=["doc_id", "n", "doc_n", "terms", "counts"])
            t = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, rb.schema.field(0).type), pa.array([n_terms], pa.int64()), pa.array([n_docs], pa.int64()),
                 lists(t, np.array([0, len(t)])), lists(seen[t], np.array([0, len(t)]))], names=["doc_id", "n", "doc_n", "terms", "counts"])

    return src.mapInArrow(run, f"doc_id {kind}, n long, doc_n long, terms array<int>, counts array<int>")


def impact_vectors(sparse: DataFrame, weights, n_docs: int, n_terms: int) -> DataFrame:
    """``doc_id, length, terms, impacts``: impacts of every document and the length of its weighted vector."""

    def run(it):
        for rb in it:
            terms, counts = rb.column(2), rb.column(3)
            ends = np.concatenate([[0], np.cumsum(np.diff(terms.offsets.to_numpy()))])
            t, tf = terms.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.int64)
            m = 25 + (75 * rb.column(1).to_numpy() * n_docs) // n_terms
            impact = (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, np.diff(ends)))
            squares = np.concatenate([[0.0], np.cumsum(weights.value[t] * impact.astype(float) ** 2)])
            length = np.sqrt(np.maximum(squares[ends[1:]] - squares[ends[:-1]], 0.0) + squares[-1] * 1e-12)
            o = pa.array(ends.astype(np.int32))
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(length * _SLACK), pa.ListArray.from_arrays(o, pa.array(t.astype(np.int32))),
                                              pa.ListArray.from_arrays(o, pa.array(impact.astype(np.int32)))], names=["doc_id", "length", "terms", "impacts"])

    kind = sparse.schema["doc_id"].dataType.simpleString()
    return sparse.where("doc_n = 0 and doc_id is not null").select("doc_id", "n", "terms", "counts") \
        .mapInArrow(run, f"doc_id {kind}, length double, terms array<int>, impacts array<int>")


class _Best:
    """The best documents of every query so far, and the scores they must reach."""

    def __init__(self, n_queries: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        self.scores, self.ids = [np.empty(0, np.int64)] * n_queries, [None] * n_queries

    def add(self, q: int, scores: np.ndarray, ids: pa.Array) -> None:
        scores = np.concatenate([self.scores[q], scores])
        ids = ids if self.ids[q] is None else pa.concat_arrays([self.ids[q], ids])
        table = pa.table({"score": -scores, "id": ids})
        order = pc.sort_indices(table, [("score", "ascending"), ("id", "ascending")])[:self.k]
        self.scores[q], self.ids[q] = scores[order.to_numpy()], ids.take(order)
        if len(order) == self.k:
            self.floor[q] = max(self.floor[q], self.scores[q][-1])


def _search(batches, queries: _Queries, weights: np.ndarray, floor: np.ndarray, k: int, scored):
    """Best ``k`` of the documents ``doc_id, length, terms, impacts``, each batch a bucket.

    ``scored`` counts the exact scores, if it is not None.
    """
    best = _Best(len(queries.ids), k, floor)
    q_weight = queries.times * weights[queries.term]
    q_length = np.sqrt(np.add.reduceat(queries.times.astype(float) ** 2 * weights[queries.term], queries.bounds[:-1])) * _SLACK
    for rb in batches:
        if rb.num_rows == 0:
            continue
        length = rb.column(1).to_numpy()
        terms = rb.column(2)
        sizes = np.diff(terms.offsets.to_numpy())
        t, impact = terms.flatten().to_numpy(), rb.column(3).flatten().to_numpy().astype(np.int64)
        order = np.argsort(t, kind="stable")
        docs, impact = np.repeat(np.arange(rb.num_rows), sizes)[order], impact[order]
        lists = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=len(weights)))])
        top = np.zeros(len(weights), np.int64)
        held = np.flatnonzero(np.diff(lists))
        top[held] = np.maximum.reduceat(impact, lists[held])
        can_add = q_weight * top[queries.term]  # the most that a term of a query can add in this bucket
        active = np.flatnonzero((q_length * length.max() >= best.floor) & (np.add.reduceat(can_add, queries.bounds[:-1]) >= np.maximum(best.floor, 1)))
        total = np.zeros(rb.num_rows, np.int64)
        for q in active:
            at = slice(queries.bounds[q], queries.bounds[q + 1])
            own, add, weight = queries.term[at], can_add[at], q_weight[at]
            by_bound = np.argsort(add)
            must = by_bound[np.cumsum(add[by_bound]) >= max(best.floor[q], 1)]  # without these a document stays below the floor
            candidates = np.unique(np.concatenate([docs[lists[x]:lists[x + 1]] for x in own[must]]))
            candidates = candidates[q_length[q] * length[candidates] >= best.floor[q]]
            if not len(candidates):
                continue
            total[:] = 0
            for x, w in zip(own, weight):
                total[docs[lists[x]:lists[x + 1]]] += w * impact[lists[x]:lists[x + 1]]
            scores = total[candidates]
            if scored is not None:
                scored.add(len(candidates))
            good = np.flatnonzero(scores >= max(best.floor[q], 1))
            if len(good):
                best.add(q, scores[good], rb.column(0).take(pa.array(candidates[good])))
    for q, ids in enumerate(best.ids):
        if ids is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), queries.ids[q])), ids, pa.array(best.scores[q])],
                                             names=["query", "doc_id", "score"])


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(docs: DataFrame, block: DataFrame, id_column: str, k: int, scored) -> DataFrame:
    spark = docs.sparkSession
    queries = _Queries(block)
    shared = spark.sparkContext.broadcast(queries)
    vocabulary = spark.sparkContext.broadcast(queries.vocabulary)
    sparse = common.stage(sparse_documents(docs, vocabulary, id_column), "search-sparse")
    summary = sparse.where("doc_n > 0")
    n_docs, n_terms = summary.agg(F.coalesce(F.sum("doc_n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = summary.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("df")).toArrow()
    df = np.zeros(len(queries.vocabulary), np.int64)
    df[held.column(0).to_numpy()] = held.column(1).to_numpy()
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    weights = spark.sparkContext.broadcast(weight)
    vectors = common.stage(impact_vectors(sparse, weights, n_docs, max(1, n_terms)), "search-vectors")

    def search(rows: DataFrame, floor: np.ndarray) -> DataFrame:
        floors = spark.sparkContext.broadcast(floor)
        kind = rows.schema["doc_id"].dataType.simpleString()

        def run(it):
            yield from _search(it, shared.value, weights.value, floors.value, k, scored)

        order = [F.desc("length"), F.xxhash64("doc_id")]
        return rows.repartitionByRange(common.partitions(spark), *order).sortWithinPartitions(*order) \
            .mapInArrow(run, f"query long, doc_id {kind}, score long")

    cut = vectors.approxQuantile("length", [1 - LONGEST], 0.001)
    floor = np.zeros(len(queries.ids), np.int64)
    if not cut:
        return search(vectors, floor)
    first = common.stage(_best(search(vectors.where(F.col("length") >= cut[0]), floor), k).drop("rank"), "search-longest")
    known = first.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).toArrow()
    floor[np.searchsorted(queries.ids, known.column(0).to_numpy())] = known.column(2).to_numpy()
    return first.unionByName(search(vectors.where(F.col("length") < cut[0]), floor))


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS, id_column: str = "doc_id", scored=None) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of the highest scores above 0 for every item.

    ``scored``, an accumulator, is increased by the number of exact scores.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    terms = common.stage(query_terms(items), "search-queries")
    n = terms.count()
    blocks = -(-n // block_terms)
    found = terms.select("query", F.lit(None).cast(docs.schema[id_column].dataType).alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    for b in range(blocks):
        block = terms.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)
        if block.limit(1).count():
            found = found.unionByName(common.stage(_block(docs, block, id_column, k, scored), "search-found"))
    names = terms.select("query", "item_id").distinct()
    return _best(found, k).join(names, "query").select("item_id", "rank", "doc_id", "score")
