"""Prefix trie of conversations by time-forward processing.

1. Turns become ``(conversation, turn, digest of role and text, bytes)`` and are
   sorted by ranges, so a long conversation spans many tasks.  Two passes give
   every turn its place and the polynomial hash (modulo 2**127 - 1) of the turns
   up to it: the first pass reports the last conversation of each partition, the
   second replays with what the partition before left open.
2. A conversation that takes over the beginning of another has prefix hashes that
   follow from its own and from the other's by one multiplication, so no rebuilt
   text is ever formed.  Equal prefix hashes are one node; its smallest
   conversation and its depth name it.
3. Subtree totals.  Nodes are dealt in shards, ranges of ``(conversation,
   depth)``; a parent's key is below its children's.  In each shard the nodes
   stream by in reverse level order and send their totals to their parents through
   a priority queue that spills to sorted runs.  Nodes whose parent lies in another
   shard are the shard's roots.  Their totals go up between shards by doubling:
   after ``i`` rounds a root knows what lies fewer than ``2**i`` roots below it.  A
   second pass in the shards adds what arrives at its nodes.
4. The ids that end at a node are sorted by ranges and joined to pieces of bounded
   length; one task streams the pieces of a node through SHA-256.

Defined results: rows with a null id are left out; null roles and texts are empty;
turns that share a number are ordered by the MD5 of their length-prefixed role and
their text; repeated rows are turns of their own; an empty table has no node, not
even a root; a negative id takes over from ``id - id % 5`` with the remainder
towards zero; extra and clashing columns are not read.
"""
from __future__ import annotations

import hashlib
import heapq
import itertools
import struct
import tempfile
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: conversations ``c - c % GROUP`` lend the others their first turns, ``crc32(c) % SHARED`` of them
GROUP, SHARED = 5, 9
#: nodes of a shard, at most about; there are at least as many shards as shuffle partitions
SHARD_ROWS = 250_000
#: messages that a queue holds before it writes a sorted run
QUEUE_ROWS = 100_000
#: characters of a piece of joined ids
PIECE = 16_384

_PRIME = (1 << 127) - 1
_FACTOR = 0x2545F4914F6CDD1D9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, _PRIME)
_ZERO = bytes(16)


def _number(b: bytes) -> int:
    return int.from_bytes(b, "big")


def _zero():
    return F.unhex(F.lit(_ZERO.hex()))


# ---- places and prefix hashes -------------------------------------------------------------------

def _turns(conversations: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))


def _last_of_partition(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the first and last conversation of a partition, and length and hash of its part of the last."""
    first = last = None
    n, x = 0, 0
    for rb in it:
        convs = rb.column(0).to_pylist()
        if not convs:
            continue
        if first is None:
            first = convs[0]
        if convs[-1] != last:
            last, n, x = convs[-1], 0, 0
        at = len(convs)
        while at and convs[at - 1] == last:
            at -= 1
        for d in rb.column(2).slice(at).to_pylist():
            x = (x * _FACTOR + _number(d)) % _PRIME
        n += len(convs) - at
    if first is not None:
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "first": [first], "last": [last], "n": [n],
                                          "x": [x.to_bytes(16, "big")]})


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, x, digest, bytes`` of every turn: its place from 1 and the hash of all turns up to it."""
    spark = conversations.sparkSession
    order = ["conv_id", F.asc_nulls_first("turn"), "digest"]
    turns = _turns(conversations).repartitionByRange(common.partitions(spark), *order).sortWithinPartitions(*order).checkpoint()
    ends = turns.mapInArrow(_last_of_partition, "part long, first long, last long, n long, x binary").collect()
    begin, state = {}, (None, 0, 0)
    for e in sorted(ends, key=lambda e: e["part"]):
        begin[e["part"]] = state
        n, x = e["n"], _number(e["x"])
        if e["first"] == e["last"] == state[0]:
            n, x = n + state[1], (x + state[2] * pow(_FACTOR, n, _PRIME)) % _PRIME
        state = e["last"], n, x
    begin = spark.sparkContext.broadcast(begin)

    def replay(it):
        conv, n, x = begin.value.get(TaskContext.get().partitionId(), (None, 0, 0))
        for rb in it:
            pos, xs = [], []
            for c, d in zip(rb.column(0).to_pylist(), rb.column(2).to_pylist()):
                if c != conv:
                    conv, n, x = c, 0, 0
                n, x = n + 1, (x * _FACTOR + _number(d)) % _PRIME
                pos.append(n)
                xs.append(x.to_bytes(16, "big"))
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(pos, pa.int64()), pa.array(xs, pa.binary()), rb.column(2), rb.column(3)],
                                             names=["conv_id", "pos", "x", "digest", "bytes"])

    return turns.mapInArrow(replay, "conv_id long, pos long, x binary, digest binary, bytes long")


# ---- rebuilt conversations ----------------------------------------------------------------------

def _borrowed(conv):
    return F.crc32(conv.cast("string")) % SHARED


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations (``conv_id, total``) and their turns (``conv_id, depth, node, parent, bytes, last``)."""
    head = F.struct("pos", "x", "digest", "bytes")
    heads = common.stage(turns.groupBy("conv_id").agg(
        F.max("pos").alias("n"), F.array_sort(F.collect_list(F.when(F.col("pos") < SHARED, head))).alias("head")), "trie-heads")
    lender = heads.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), F.col("head").alias("base_head"))
    h, n = _borrowed(F.col("conv_id")), F.col("n")
    c = heads.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).join(lender, "base", "left")
    c = c.withColumn("h", h).withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0))))
    at = [F.coalesce(F.get(F.col(a), F.col(i).cast("int") - 1)["x"], _zero()) for a, i in (("base_head", "k"), ("head", "h"))]
    c = common.stage(c.select("conv_id", "h", "k", (F.col("k") + F.greatest(n - F.col("h"), F.lit(0))).alias("total"), at[0].alias("lent"),
                              at[1].alias("own"), F.slice("base_head", 1, F.col("k").cast("int")).alias("taken")), "trie-conversations")
    taken = c.select("conv_id", "total", F.explode("taken").alias("t")).select(
        "conv_id", F.col("t.pos").alias("depth"), "t.x", "t.digest", "t.bytes", F.lit(0).cast("long").alias("after"), _zero().alias("lent"),
        _zero().alias("own"), "total")
    rest = turns.where(F.col("pos") > _borrowed(F.col("conv_id"))).join(c, "conv_id").select(
        "conv_id", (F.col("k") + F.col("pos") - F.col("h")).alias("depth"), "x", "digest", "bytes", (F.col("pos") - F.col("h")).alias("after"),
        "lent", "own", "total")

    def hashes(it):
        for rb in it:
            node, parent = [], []
            for x, d, e, lent, own in zip(*(rb.column(i).to_pylist() for i in (2, 3, 5, 6, 7))):
                x = _number(x)
                if lent != own:
                    x = (x + (_number(lent) - _number(own)) * pow(_FACTOR, e, _PRIME)) % _PRIME
                node.append(x.to_bytes(16, "big"))
                parent.append(((x - _number(d)) * _INVERSE % _PRIME).to_bytes(16, "big"))
            depth, total = rb.column(1), rb.column(8)
            yield pa.RecordBatch.from_arrays(
                [rb.column(0), depth, pa.array(node, pa.binary()), pa.array(parent, pa.binary()), rb.column(4),
                 pa.array([a == b for a, b in zip(depth.to_pylist(), total.to_pylist())], pa.bool_())],
                names=["conv_id", "depth", "node", "parent", "bytes", "last"])

    rows = taken.unionByName(rest).mapInArrow(hashes, "conv_id long, depth long, node binary, parent binary, bytes long, last boolean")
    return c.select("conv_id", "total"), common.stage(rows, "trie-turns")


def _tree(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """``node, depth, conv_id, parent_conv_id, n_convs, n_children, bytes`` of every node, the root included."""
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        _zero().alias("node"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(None).cast("binary").alias("parent"),
        F.lit(0).cast("long").alias("bytes"))
    nodes = rows.groupBy("node", "depth").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
                                              F.min("parent").alias("parent"), F.max("bytes").alias("bytes"))
    nodes = common.stage(nodes.unionByName(root), "trie-nodes")
    above = (F.col("depth") - 1).alias("depth")
    kids = common.stage(nodes.where("depth > 0").groupBy(F.col("parent").alias("node"), above).agg(F.count("*").alias("n_children")), "trie-children")
    names = nodes.select(F.col("node").alias("parent"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    tree = nodes.join(kids, ["node", "depth"], "left").join(names, ["parent", "depth"], "left")
    return common.stage(tree.select("node", "depth", "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
                                    "bytes"), "trie-tree")


# ---- subtree totals -----------------------------------------------------------------------------

class SpillingQueue:
    """Priority queue of ``(-depth, -conversation, leaves, saved)`` messages.

    Beyond ``limit`` messages in memory it writes them as a sorted run to an unnamed
    scratch file of the task, which ends with it; only the head of each run is held.
    """

    _RECORD = struct.Struct("<4q")

    def __init__(self, limit: int = QUEUE_ROWS):
        self.heap, self.heads, self.limit, self.runs = [], [], limit, 0

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.limit:
            run = tempfile.TemporaryFile()
            for m in sorted(self.heap):
                run.write(self._RECORD.pack(*m))
            run.seek(0)
            self.heap, self.runs = [], self.runs + 1
            self._advance(run, self.runs)

    def _advance(self, run, number: int) -> None:
        record = run.read(self._RECORD.size)
        if record:
            heapq.heappush(self.heads, (self._RECORD.unpack(record), number, run))
        else:
            run.close()

    def take(self, key: tuple) -> Iterator[tuple]:
        """Remove and yield the messages for ``key``; none for an earlier key may be left."""
        while self.heap and self.heap[0][:2] == key:
            yield heapq.heappop(self.heap)
        while self.heads and self.heads[0][0][:2] == key:
            message, number, run = heapq.heappop(self.heads)
            yield message
            self._advance(run, number)


_LOCAL = "shard int, conv_id long, depth long, parent_conv_id long, leaves long, saved long, top_conv long, top_depth long"
_NAMES = [f.split()[0] for f in _LOCAL.split(", ")]


def _in_shards(sharded: DataFrame, lows: dict, queue_rows: int, shards: int) -> DataFrame:
    """Totals of every node over its subtree in its shard, and the topmost node above it there."""

    def totals(nodes, low):
        queue = SpillingQueue(queue_rows)
        for conv, depth, parent, leaves, saved in nodes:
            for _, _, a, b in queue.take((-depth, -conv)):
                leaves, saved = leaves + a, saved + b
            inside = parent is not None and (parent, depth - 1) >= low
            if inside:
                queue.push((1 - depth, -parent, leaves, saved))
            yield conv, depth, parent, leaves, saved, inside

    def shard_rows(shard, nodes):
        out = list(totals(nodes, lows[shard]))  # a shard has a bounded number of nodes
        top = {}
        for conv, depth, parent, _, _, inside in reversed(out):  # level order: parents come first
            top[conv, depth] = top[parent, depth - 1] if inside else (conv, depth)
        columns = list(zip(*out))[:5]
        tops = [top[conv, depth] for conv, depth in zip(*columns[:2])]
        return pa.RecordBatch.from_pydict(dict(zip(_NAMES, [[shard] * len(out), *map(list, columns), *map(list, zip(*tops))])),
                                          schema=pa.schema([(n, pa.int32() if n == "shard" else pa.int64()) for n in _NAMES]))

    def run(it):
        current, nodes = None, []
        for rb in it:
            for shard, *node in zip(*(c.to_pylist() for c in rb.columns)):
                if shard != current:
                    if nodes:
                        yield shard_rows(current, nodes)
                    current, nodes = shard, []
                nodes.append(node)
        if nodes:
            yield shard_rows(current, nodes)

    dealt = sharded.select("shard", "conv_id", "depth", "parent_conv_id", "leaves", "saved").repartition(shards, "shard") \
        .sortWithinPartitions("shard", F.desc("depth"), F.desc("conv_id"))
    return dealt.mapInArrow(run, _LOCAL)


def _across_roots(roots: DataFrame) -> DataFrame:
    """Totals of shard roots (``key, up, leaves, saved``) over all roots below them, by doubling."""
    while roots.where("up is not null").limit(1).count():
        below = roots.where("up is not null").groupBy(F.col("up").alias("key")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        below = common.stage(below, "trie-below")
        farther = roots.select(F.col("key").alias("up"), F.col("up").alias("far"))
        step = roots.join(below, "key", "left").join(farther, "up", "left")
        roots = common.stage(step.select("key", F.col("far").alias("up"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"),
                                         (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), "trie-roots")
    return roots


def subtree_totals(tree: DataFrame, shard_rows: int = SHARD_ROWS, queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """``conv_id, depth, leaves, saved`` summed over every node's subtree (``conv_id, depth, parent_conv_id, leaves, saved``)."""
    shards = max(common.partitions(tree.sparkSession), -(-tree.count() // shard_rows))
    sharded = common.stage(tree.repartitionByRange(shards, "conv_id", "depth").withColumn("shard", F.spark_partition_id()), "trie-shards")
    lows = {r["shard"]: tuple(r["low"]) for r in sharded.groupBy("shard").agg(F.min(F.struct("conv_id", "depth")).alias("low")).collect()}
    local = common.stage(_in_shards(sharded, lows, queue_rows, shards), "trie-local")
    key, top = F.struct("conv_id", "depth"), F.struct(F.col("top_conv").alias("conv_id"), F.col("top_depth").alias("depth"))
    roots = local.where(key == top).withColumn("key", key)
    if roots.where("parent_conv_id is not null").limit(1).count() == 0:
        return local
    places = local.select(F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"), top.alias("up"))
    roots = common.stage(roots.join(places, ["parent_conv_id", "depth"], "left").select("key", "parent_conv_id", "up", "leaves", "saved"), "trie-shard-roots")
    whole = _across_roots(roots.drop("parent_conv_id")).drop("up")
    arriving = whole.join(roots.where("up is not null").select("key", "parent_conv_id"), "key").groupBy(
        F.col("parent_conv_id").alias("conv_id"), (F.col("key.depth") - 1).alias("depth")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    more = sharded.join(common.stage(arriving, "trie-arriving"), ["conv_id", "depth"], "left")
    more = more.withColumn("leaves", F.col("leaves") + F.coalesce("l", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("s", F.lit(0)))
    return _in_shards(more, lows, queue_rows, shards)


# ---- ids that end at a node ---------------------------------------------------------------------

_PIECES = pa.schema([("node", pa.binary()), ("depth", pa.int64()), ("first", pa.int64()), ("piece", pa.string())])
_HASHES = pa.schema([("node", pa.binary()), ("depth", pa.int64()), ("ends_sha256", pa.string())])


def _rows(it):
    for rb in it:
        yield from zip(*(c.to_pylist() for c in rb.columns))


def _batches(rows, schema, size: int = 1024):
    rows = iter(rows)
    while some := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), schema.types)], schema=schema)


def _joined(rows):
    """Sorted ``node, depth, conv_id`` to ``node, depth, first, piece``."""
    current, ids, size = None, [], 0
    for node, depth, conv in rows:
        if ids and ((node, depth) != current or size > PIECE):
            yield *current, int(ids[0]), ",".join(ids)
            ids, size = [], 0
        current = node, depth
        ids.append(str(conv))
        size += len(ids[-1]) + 1
    if ids:
        yield *current, int(ids[0]), ",".join(ids)


def _hashed(rows):
    """Pieces in order to one SHA-256 per node; only the running hash is held."""
    current, state = None, hashlib.sha256()
    for node, depth, _, piece in rows:
        if (node, depth) != current:
            if current:
                yield *current, state.hexdigest()
            current, state = (node, depth), hashlib.sha256()
        else:
            state.update(b",")
        state.update(piece.encode())
    if current:
        yield *current, state.hexdigest()


def end_hashes(ends: DataFrame) -> DataFrame:
    """``node, depth, ends_sha256``: hash of the ascending ids of ``node, depth, conv_id``, joined by commas."""
    parts = common.partitions(ends.sparkSession)
    order = ["node", "depth", "conv_id"]
    pieces = ends.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order) \
        .mapInArrow(lambda it: _batches(_joined(_rows(it)), _PIECES), "node binary, depth long, first long, piece string")
    return pieces.repartition(parts, "node", "depth").sortWithinPartitions("node", "depth", "first") \
        .mapInArrow(lambda it: _batches(_hashed(_rows(it)), _HASHES), "node binary, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, shard_rows: int = SHARD_ROWS, queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """One row per trie node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    spark = conversations.sparkSession
    common.prepare(spark)
    convs, rows = rebuilt(common.stage(prefix_hashes(conversations), "trie-hashes"))
    tree = _tree(convs, rows)
    values = tree.select("conv_id", "depth", "parent_conv_id", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"),
                         ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    totals = common.stage(subtree_totals(values, shard_rows, queue_rows).select(
        "conv_id", "depth", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens")), "trie-totals")
    empty = convs.where("total = 0").select(_zero().alias("node"), F.lit(0).cast("long").alias("depth"), "conv_id")
    ends = common.stage(end_hashes(rows.where("last").select("node", "depth", "conv_id").unionByName(empty)), "trie-ends")
    out = tree.join(totals, ["conv_id", "depth"]).join(ends, ["node", "depth"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
