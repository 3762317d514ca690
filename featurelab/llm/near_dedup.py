"""Near-duplicate components by bottom-k sketches.

1. One hash function gives every document its set of distinct ``SHINGLE``-word
   shingles, a 128-bit digest of the set and a sketch of the ``K`` smallest
   hashes.  Documents of equal sets form a class; only one row per class goes
   on, so copies cost nothing further.
2. Inverted lists.  Two sets that are similar enough share at least ``c`` of
   their sketch values, so in any common order they share one of the first
   ``|sketch| - c + 1``.  Only those are listed; the order puts values of
   crowded lists last.  For sets below ``K`` this is exact; above, ``c`` lies
   seven standard deviations below the mean of the hypergeometric law.
3. A list that is still longer than ``HOT`` (near copies of one document) is not
   paired up.  Its documents are listed again by the rarest shingles of their
   whole sets - counted among these documents - under the exact prefix and
   position bounds, so documents too far from the common text leave the lists.
   A pair of them is only looked at further if their prefixes share so many
   shingles that, with all that follows the prefixes, the sets can be similar.
4. Each list first proposes pairs with its hub (the member of the most common
   shingles).  Pairs pass the union-sketch estimate, then the exact Jaccard
   test on whole sets.  Connected components follow; then only pairs of one
   list in different components are left, and are tested the same way.  So a
   group of m copies costs about m tests, and no link between components is lost.

Defined results: a null or empty text, or one without words, has an empty set,
is linked with nothing and kept; a text of fewer than ``SHINGLE`` words is one
shingle; a row with a null id takes no part, has a null component and is kept;
rows that repeat an id share its component and are all kept or not by the same
rule; an empty table gives an empty result; extra and clashing columns are not
read.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from . import text as tx

SHINGLE = 5
K = 128
#: lists longer than this are listed anew by rarest shingles
HOT = 64
#: up to so many ids (8 bytes each) a lookup of texts is a broadcast join, beyond it a shuffle join
BROADCAST_IDS = 1_000_000
#: up to so many crowded values (4 bytes each) are broadcast to order the lists, beyond it they are joined
CROWDED = 1_000_000
#: fixed part of a similarity threshold in percent
THRESHOLD = 85
_SIGMAS = 7.0


def shared_at_least(n: int, k: int, percent: int) -> int:
    """Sketch values that a set of ``n`` shingles shares with any set similar by ``percent``."""
    t = percent / 100
    if n < t * k:
        return max(1, math.ceil(percent * n / 100))
    u = max(n / t, 2.0)  # the union is at most this large
    sd = math.sqrt(k * t * (1 - t) * max(0.0, (u - k) / (u - 1)))
    return max(1, math.floor(t * min(n, k) - _SIGMAS * sd))


def _shingles(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (63 bits, ascending in each text) of a chunk, and the text of each."""
    s, e, rows = tx.words(raw, offsets, "space")
    n_rows = len(offsets) - 1
    h = tx.span_hashes(raw, s, e, True)
    counts = np.bincount(rows, minlength=n_rows)
    g = tx.gram_hashes(h, SHINGLE)
    ok = rows[SHINGLE - 1:] == rows[:len(g)] if len(g) else np.empty(0, bool)
    hashes, owner = [g[ok]], [rows[:len(g)][ok]]
    few = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(few):
        first = np.searchsorted(rows, few)
        for m in range(1, SHINGLE):
            at = first[counts[few] == m]
            if len(at):
                code = np.zeros(len(at), np.uint64)
                for i in range(m):
                    code = tx.mix(code + h[at + i] + np.uint64(m))
                hashes.append(code)
                owner.append(rows[at])
    v, o = np.concatenate(hashes) >> np.uint64(1), np.concatenate(owner)
    if (o[1:] < o[:-1]).any():
        order = np.argsort(o, kind="stable")
        v, o = v[order], o[order]
    b = tx.row_bounds(o, n_rows)
    for lo, hi in zip(b[:-1].tolist(), b[1:].tolist()):
        v[lo:hi].sort()
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return v[new], o[new]


def _digests(v: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over the mixed hashes of each text."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tx.mix(v ^ np.uint64(salt)), dtype=np.uint64)])
        out.append(tx.signed(c[bounds[1:]] - c[bounds[:-1]]))
    return out[0], out[1]


def sketches(docs: DataFrame, id_column: str, k: int) -> DataFrame:
    """``doc_id, n, d1, d2, sketch`` of every row (sketch: the top 31 bits of the smallest hashes, ascending)."""
    src = docs.select(F.col(id_column).alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(it):
        for rb in it:
            for i, j, raw, off in tx.utf8_chunks(rb.column(1)):
                v, o = _shingles(raw, off)
                b = tx.row_bounds(o, j - i)
                d1, d2 = _digests(v, b)
                n = np.diff(b)
                keep = np.arange(len(v)) - b[o] < k
                size = np.minimum(n, k)
                ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [rb.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(d1), pa.array(d2),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array((v[keep] >> np.uint64(32)).astype(np.int32)))],
                    names=["doc_id", "n", "d1", "d2", "sketch"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, n long, d1 long, d2 long, sketch array<int>")


def _full_sets(docs: DataFrame, id_column: str, wanted: DataFrame) -> DataFrame:
    """``rep, hashes`` (whole sorted shingle sets) for ``wanted`` (``rep, doc_id, d1, d2``)."""
    src = docs.select(F.col(id_column).alias("doc_id"), F.col("text").cast("string").alias("text"))
    small = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    src = src.join(F.broadcast(wanted) if small else wanted, "doc_id").select("rep", "d1", "d2", "text")

    def run(it):
        for rb in it:
            for i, j, raw, off in tx.utf8_chunks(rb.column(3)):
                v, o = _shingles(raw, off)
                b = tx.row_bounds(o, j - i)
                d1, d2 = _digests(v, b)
                same = (d1 == rb.column(1).to_numpy()[i:j]) & (d2 == rb.column(2).to_numpy()[i:j])
                v = tx.signed(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rb.column(0).to_numpy()[i:j][same]),
                     pa.array([v[b[r]:b[r + 1]] for r in np.flatnonzero(same)], pa.list_(pa.int64()))], names=["rep", "hashes"])

    return src.mapInArrow(run, "rep long, hashes array<long>")


def _similar(pairs: DataFrame, left: str, right: str, test) -> DataFrame:
    """Pairs ``a, b`` whose two array columns pass ``test`` (of the two columns of a batch)."""

    def run(it):
        for rb in it:
            ok = test(rb.column(2), rb.column(3)) if rb.num_rows else np.empty(0, bool)
            yield pa.RecordBatch.from_arrays([rb.column(i).filter(pa.array(ok)) for i in (0, 1)], names=["a", "b"])

    return pairs.select("a", "b", left, right).mapInArrow(run, "a long, b long")


def _estimate(k: int, percent: int):
    """Union-sketch test: may the two sets be similar by ``percent``?"""
    t = percent / 100

    def test(left, right):
        rows = np.arange(len(left))
        sizes = [x.value_lengths().to_numpy() for x in (left, right)]
        # pair, value and side in 64 bits: a value of both sides lies side by side
        keys = np.concatenate([(np.repeat(rows, n) << 32) + (x.flatten().to_numpy().astype(np.int64) << 1) + side
                               for side, (x, n) in enumerate(zip((left, right), sizes))])
        keys.sort()
        keys = keys[np.diff(keys, prepend=-1) != 0]
        first = np.diff(keys >> 1, prepend=-1) != 0
        row = keys >> 32
        union = np.bincount(row[first], minlength=len(rows))
        capped = np.maximum(*sizes) >= k
        m = np.where(capped, np.minimum(k, union), union)
        rank = np.cumsum(first) - (np.cumsum(union) - union)[row]
        both = np.bincount(row[~first & (rank <= m[row])], minlength=len(rows))
        slack = np.where(capped, _SIGMAS * np.sqrt(m * t * (1 - t)), 0.0)
        return both >= t * m - slack - 1

    return test


def _exact(percent: int):
    def test(left, right):
        ok = np.empty(len(left), bool)
        for i, (x, y) in enumerate(zip(left, right)):
            x, y = (z.values.to_numpy() for z in (x, y))
            inter = len(np.intersect1d(x, y, assume_unique=True))
            ok[i] = 100 * inter >= percent * (len(x) + len(y) - inter)
        return ok

    return test


class _Verifier:
    """Runs pairs of classes through the estimate and the exact test."""

    def __init__(self, docs, id_column, reps, k, percent, prefixes=None):
        self.docs, self.id_column, self.reps, self.k, self.percent, self.prefixes = docs, id_column, reps, k, percent, prefixes

    def links(self, pairs: DataFrame, name: str) -> DataFrame:
        if self.prefixes is not None:
            pairs = self._prefixes_ok(pairs)
        sk = self.reps.select(F.col("rep").alias("a"), F.col("sketch").alias("sa"))
        both = pairs.join(sk, "a").join(sk.select(F.col("a").alias("b"), F.col("sa").alias("sb")), "b")
        likely = common.stage(_similar(both, "sa", "sb", _estimate(self.k, self.percent)), f"{name}-likely")
        wanted = likely.select(F.explode(F.array("a", "b")).alias("rep")).distinct() \
            .join(self.reps.select("rep", "doc_id", "d1", "d2"), "rep")
        sets = common.stage(_full_sets(self.docs, self.id_column, wanted).dropDuplicates(["rep"]), f"{name}-sets")
        sa = sets.select(F.col("rep").alias("a"), F.col("hashes").alias("sa"))
        sb = sets.select(F.col("rep").alias("b"), F.col("hashes").alias("sb"))
        return common.stage(_similar(likely.join(sb, "b").join(sa, "a"), "sa", "sb", _exact(self.percent)), f"{name}-links")


    def _prefixes_ok(self, pairs: DataFrame) -> DataFrame:
        """Pairs that the shared shingles of their whole-set prefixes allow (others, and those without prefixes, stay).

        What two sets share beyond the prefix that ends first lies in the rest of that set.
        """
        for x in "ab":
            side = self.prefixes.select(F.col("rep").alias(x), F.col("n").alias("n" + x), F.col("prefix").alias("p" + x))
            pairs = pairs.join(side, x, "left")
        rest = [F.ceil(F.col(n) * F.lit(self.percent) / F.lit(100)) - 1 for n in ("na", "nb")]
        most = F.size(F.array_intersect("pa", "pb")) + F.greatest(*rest)
        return pairs.where(F.coalesce(most >= _overlap(F.col("na"), F.col("nb"), self.percent), F.lit(True))).select("a", "b")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, label``: the smallest node reachable over the edges ``a, b``; nodes without edges are left out.

    Min-label rounds with pointer jumping; each round is staged.
    """
    sym = common.stage(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), f"{name}-edges")
    labels = common.stage(sym.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                          .select("node", F.least("node", "m").alias("label")), f"{name}-0")
    while True:
        near = sym.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label"))
        step = common.stage(step, f"{name}-step")
        labels = step.select("node", "label")
        if step.where("old <> label").limit(1).count() == 0:
            return labels


def _hot_lists(docs, id_column, reps, lists, percent) -> tuple[DataFrame, DataFrame] | tuple[None, None]:
    """Lists of the documents of hot lists, by the rarest shingles of their whole sets, and those prefixes (``rep, n, prefix``)."""
    hot = lists.where(F.col("m") > HOT).select("rep").distinct()
    wanted = common.stage(hot.join(reps.select("rep", "doc_id", "d1", "d2"), "rep"), "hot-reps")
    if wanted.limit(1).count() == 0:
        return None, None
    sets = common.stage(_full_sets(docs, id_column, wanted).dropDuplicates(["rep"]), "hot-sets")
    flat = sets.select("rep", F.size("hashes").alias("n"), F.explode("hashes").alias("value"))
    # aggregates are staged before they are joined, so that a crowded value is split
    df = common.stage(flat.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "hot-frequencies")
    # shingles of one document only are the rarest: their number is n minus the rest
    flat = flat.join(df, "value")
    w = Window.partitionBy("rep")
    flat = flat.withColumn("common", F.count("*").over(w)).withColumn("mass", F.sum("df").over(w) / F.col("n"))
    # position among the document's shingles in the order (df, value), rarest first
    flat = flat.withColumn("place", F.col("n") - F.col("common") + F.row_number().over(w.orderBy("df", "value")))
    prefix = F.col("n") - F.ceil(F.col("n") * F.lit(percent) / F.lit(100)) + 1
    flat = common.stage(flat.where(F.col("place") <= prefix), "hot-prefix-rows")
    prefixes = common.stage(flat.groupBy("rep", "n").agg(F.collect_list("value").alias("prefix")), "hot-prefixes")
    # the rest of a set after its place must suffice for the smallest set of the list
    small = common.stage(flat.groupBy("value").agg(F.min("n").alias("least")), "hot-least")
    flat = flat.join(small, "value").where(F.col("n") - F.col("place") + 1 >= _overlap(F.col("n"), F.col("least"), percent))
    lists = flat.select("value", "rep", F.col("n").cast("long").alias("n"), F.col("place").cast("int").alias("place"),
                        F.col("n").cast("int").alias("size"), F.col("n").cast("int").alias("need"), F.lit(True).alias("whole"),
                        (-F.col("mass")).alias("order"), F.lit(True).alias("hot"))
    return lists, prefixes


def _overlap(a, b, percent: int):
    """Shingles that sets of these sizes must share to be similar by ``percent``."""
    return F.ceil((a + b) * F.lit(percent) / F.lit(100 + percent) - F.lit(1e-9))


def _pairs_ok(percent: int):
    """Size and position bounds for members ``a`` and ``b`` of a list.

    At their first common value the rest of both must hold what they need to
    share, so a similar pair passes in at least one list.
    """
    sizes = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    need = F.when(F.col("wa") & F.col("wb"), _overlap(F.col("na"), F.col("nb"), percent)).otherwise(F.least("ca", "cb"))
    return sizes & (1 + F.least(F.col("sa") - F.col("pa"), F.col("sb") - F.col("pb")) >= need)


def _side(rows: DataFrame, x: str, rep: str = "rep") -> DataFrame:
    """The list columns of one side of a pair."""
    return rows.select("hot", "value", F.col(rep).alias(x), F.col("n").alias("n" + x), F.col("place").alias("p" + x),
                       F.col("size").alias("s" + x), F.col("need").alias("c" + x), F.col("whole").alias("w" + x),
                       *([F.col("comp").alias("comp_" + x)] if "comp" in rows.columns else []))


def _prefix_rows(rb: pa.RecordBatch, last: np.ndarray, k: int, percent: int) -> pa.RecordBatch:
    """One row for each sketch value to list, of a batch of ``rep, n, sketch``; values in ``last`` (ascending) take the last places."""
    flat, n = rb.column(2).flatten().to_numpy(), rb.column(1).to_numpy()
    size = rb.column(2).value_lengths().to_numpy()
    each, of = np.unique(n, return_inverse=True)
    need = np.minimum(size, np.array([shared_at_least(int(x), k, percent) for x in each], np.int64)[of])
    row = np.repeat(np.arange(len(n)), size)
    start = np.concatenate([[0], np.cumsum(size)])
    # one search of the whole batch: the cost of a document grows with the logarithm of the crowded values
    late = np.zeros(len(flat), bool)
    if len(last):
        late = last[np.minimum(np.searchsorted(last, flat), len(last) - 1)] == flat
    before = np.concatenate([[0], np.cumsum(late)])
    late_before = before[:-1] - before[start[row]]
    early = size - np.diff(before[start])
    place = np.where(late, early[row] + late_before, np.arange(len(flat)) - start[row] - late_before)
    keep = place <= (size - need)[row]
    row = row[keep]
    return pa.RecordBatch.from_arrays(
        [pa.array(rb.column(0).to_numpy()[row]), pa.array(n[row]), pa.array(size[row].astype(np.int32)), pa.array(need[row].astype(np.int32)),
         pa.array(place[keep].astype(np.int32)), pa.array(flat[keep].astype(np.int64))], names=["rep", "n", "size", "need", "place", "value"])


def near_duplicates(docs: DataFrame, percent: int = THRESHOLD, k: int = K, id_column: str = "doc_id") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    ``component_id`` is the smallest id of the documents reachable over links
    of ``100 * intersection >= percent * union``.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    all_rows = common.stage(sketches(docs, id_column, k).withColumn("row", F.monotonically_increasing_id()), "sketches")
    key = ["n", "d1", "d2"]
    known = all_rows.where("n > 0 and doc_id is not null")
    classes = common.stage(known.groupBy(*key).agg(F.min("doc_id").alias("first_id"), F.min("row").alias("rep")), "classes")
    reps = common.stage(known.join(classes.select(F.col("rep").alias("row")), "row")
                        .select(F.col("row").alias("rep"), "doc_id", *key, "sketch"), "class-reps")

    # values that many sketches hold go last in the order of the lists
    crowded = common.stage(reps.select(F.explode("sketch").alias("value")).groupBy("value").agg(F.count("*").alias("m"))
                           .where(F.col("m") > HOT).select("value"), "crowded")
    ordered, last = reps.select("rep", "n", "sketch"), np.empty(0, np.int32)
    if crowded.limit(CROWDED + 1).count() <= CROWDED:
        last = np.sort(crowded.toArrow().column(0).to_numpy().astype(np.int32))
    else:
        flat = reps.select("rep", "n", F.posexplode("sketch").alias("at", "value")) \
            .join(crowded.withColumn("late", F.lit(True)), "value", "left")
        line = F.array_sort(F.collect_list(F.struct(F.coalesce("late", F.lit(False)).alias("late"), "at", "value")))
        ordered = flat.groupBy("rep", "n").agg(F.transform(line, lambda x: x["value"]).alias("sketch"))
    last = spark.sparkContext.broadcast(last)

    def prefixes(it):
        for rb in it:
            yield _prefix_rows(rb, last.value, k, percent)

    lists = ordered.mapInArrow(prefixes, "rep long, n long, size int, need int, place int, value long")
    # staged, so that both sides of the join are plain exchanges and a crowded value is split
    members = common.stage(lists.groupBy("value").agg(F.count("*").alias("m")).where("m > 1"), "members")
    lists = common.stage(lists.join(members, "value"), "lists")
    plain = lists.where(F.col("m") <= HOT).select(
        "value", "rep", "n", (F.col("place") + 1).alias("place"), "size", "need",
        (100 * F.col("n") < percent * k).alias("whole"), F.lit(0.0).cast("double").alias("order"), F.lit(False).alias("hot"))
    again, prefixes = _hot_lists(docs, id_column, reps, lists, percent)
    lists = common.stage(plain.unionByName(again) if again is not None else plain, "pair-lists")

    check = _Verifier(docs, id_column, reps, k, percent, prefixes)
    member = F.struct("order", "rep", "n", "place", "size", "need", "whole")
    hubs = common.stage(lists.groupBy("hot", "value").agg(F.min(member).alias("h"), F.count("*").alias("m")).where("m > 1").select("hot", "value", "h.*"),
                        "hubs")
    star = _side(lists, "a").join(_side(hubs, "b"), ["hot", "value"]).where("a <> b").where(_pairs_ok(percent))
    star = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = check.links(star, "star")
    label = components(links, "star-cc")

    # what is left: members of one list that lie in different components
    tagged = lists.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("label", "rep")) \
        .join(hubs.select("hot", "value", F.col("rep").alias("hub")), ["hot", "value"])
    mixed = tagged.groupBy("hot", "value").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("hot", "value")
    mixed = common.stage(mixed, "mixed-values")
    tagged = common.stage(tagged.join(mixed, ["hot", "value"]).where("rep <> hub").drop("hub", "label"), "mixed-lists")
    cross = _side(tagged, "a").join(_side(tagged, "b"), ["hot", "value"]).where("a < b and comp_a <> comp_b").where(_pairs_ok(percent)) \
        .select("a", "b").distinct()
    more = check.links(cross, "cross")

    final = components(links.unionByName(more), "cc")
    where = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    least = where.groupBy("label").agg(F.min("first_id").alias("component"))
    where = where.join(least, "label").select(*key, "component")
    out = all_rows.select("doc_id", *key).join(where, key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
