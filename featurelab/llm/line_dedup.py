"""Repeated lines: keep bitmaps from range-dealt, sorted line hashes.

1. Every line of at least ``MIN_CHARS`` code points, stripped and with A-Z
   lower-cased, becomes a row ``(hash, document, position)``; texts go no
   further.  The hash has 128 bits.
2. The rows are dealt by ranges of the hash and sorted by hash, document
   (largest id first) and position, so the lines of one key stream past together:
   the first document keeps its lines, and if at least ``MIN_DOCS`` documents
   follow each other, all others lose them.
3. A key of more rows than a fair share of a task (at most four such keys per
   task exist, so their table is small) is left out of the stream; its documents
   are counted and its largest id is found by partial aggregates, and its rows
   are judged where they lie.
4. The answer is a run-length-coded keep bitmap per document (``keep_runs``:
   kept, dropped, kept, ... lines), not text; ``kept_text`` applies it.

Only DataFrame functions are used.

Defined results: a null or empty text is one empty line; a row with a null id
takes no part and keeps all its lines; rows that repeat an id are one document
(a key in all of them counts once, and the largest id keeps it in each of its
rows); an empty table gives an empty result; extra and clashing columns are not
read.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: a key below this many code points is never dropped
MIN_CHARS = 20
#: documents that must hold a key before its lines are dropped
MIN_DOCS = 3
#: a key of fewer rows is never taken out of the stream
HOT_ROWS = 1000
_BLANK = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lines(text):
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _rows(docs: DataFrame, id_column: str) -> DataFrame:
    """``doc_id, text_hash, pos, h1, h2`` of every line that can be dropped."""
    known = docs.where(F.col(id_column).isNotNull()).select(
        F.col(id_column).alias("doc_id"), _hash_of("text").alias("text_hash"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    key = F.translate(F.btrim("line", F.lit(_BLANK)), _UPPER, _LOWER)
    return known.where(F.length("line") >= MIN_CHARS).withColumn("key", key).where(F.length("key") >= MIN_CHARS).select(
        "doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))


def _hash_of(column: str):
    """Tells rows of one id apart."""
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")))


def keep_bitmaps(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``doc_id, text_hash, keep_runs`` of the documents that lose lines, one row per id and text."""
    spark = docs.sparkSession
    common.prepare(spark)
    parts = common.partitions(spark)
    rows = common.stage(_rows(docs, id_column), "lines")
    limit = max(HOT_ROWS, rows.count() // (4 * parts))  # at most 4 * parts keys have more rows
    hot = common.stage(rows.groupBy("h1").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("h1"), "hot-lines")

    # the stream: range-dealt hashes, secondary sort by document and position
    calm = rows.join(F.broadcast(hot), "h1", "left_anti")
    dealt = calm.repartitionByRange(parts, "h1", "h2").sortWithinPartitions("h1", "h2", F.desc("doc_id"), "pos")
    key = Window.partitionBy("h1", "h2")
    seen = F.dense_rank().over(key.orderBy(F.desc("doc_id")))
    stream = dealt.withColumn("nth", seen).withColumn("n_docs", F.max("nth").over(key))
    drops = stream.where((F.col("n_docs") >= MIN_DOCS) & (F.col("nth") > 1)).select("doc_id", "text_hash", "pos")

    # the keys left out of the stream: their rows stay where they are
    crowd = rows.join(F.broadcast(hot), "h1")
    judged = common.stage(crowd.groupBy("h1", "h2").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("holder"))
                          .where(F.col("n_docs") >= MIN_DOCS).select("h1", "h2", "holder"), "hot-holders")
    lost = crowd.join(F.broadcast(judged), ["h1", "h2"]).where("doc_id <> holder").select("doc_id", "text_hash", "pos")

    gone = drops.unionByName(lost).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    return gone.select("doc_id", "text_hash", _runs(F.col("gone")).alias("keep_runs"))


def _runs(gone):
    """Lengths of the kept, dropped, kept, ... runs before the end of the last dropped run."""
    first = F.filter(gone, lambda x, i: (i == 0) | (F.get(gone, i - 1) != x - 1))
    after = F.transform(F.filter(gone, lambda x, i: F.coalesce(F.get(gone, i + 1) != x + 1, F.lit(True))), lambda x: x + 1)
    edges = F.array_sort(F.concat(first, after))
    return F.transform(edges, lambda x, i: x - F.when(i == 0, 0).otherwise(F.get(edges, i - 1)))


def drop_repeats(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``docs`` with ``keep_runs`` (null: nothing is dropped); clashing columns are replaced."""
    bitmaps = keep_bitmaps(docs, id_column).select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("keep_runs").alias("_runs"))
    marked = docs.withColumn("_own", _hash_of("text"))
    joined = marked.join(bitmaps, (marked[id_column] == bitmaps["_id"]) & (marked["_own"] == bitmaps["_hash"]), "left")
    return joined.withColumn("keep_runs", F.col("_runs")).drop("_id", "_hash", "_own", "_runs")


def n_lines(text):
    """Lines of a text before dropping."""
    return F.size(_lines(text)).cast("long")


def n_dropped(runs):
    """Lines that a keep bitmap drops."""
    odd = F.filter(runs, lambda x, i: i % 2 == 1)
    return F.coalesce(F.aggregate(odd, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))


def kept_text(text, runs):
    """The lines that a keep bitmap leaves, joined by newlines."""
    lines = _lines(text)
    keep = F.flatten(F.transform(runs, lambda x, i: F.array_repeat(i % 2 == 0, x)))
    left = F.filter(F.zip_with(lines, keep, lambda x, k: F.when(F.coalesce(k, F.lit(True)), x)), lambda x: x.isNotNull())
    return F.when(runs.isNull(), F.coalesce(text.cast("string"), F.lit(""))).otherwise(F.array_join(left, "\n"))
