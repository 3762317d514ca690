"""Packing of tokenised documents into fixed-length sequences.

The pieces' length histogram has at most ``capacity`` rows, whatever the size
of the corpus, so the packing itself is planned on the driver: the
configuration linear program (how often to use which multiset of lengths) is
solved by multiplicative weights, where each step prices the best
configuration with a knapsack dynamic program, until every length is covered;
it is then rounded and applied, what rounding leaves is solved again, at every
size of input, and the last few pieces go best-fit.
The plan - configurations and counts, at most a few thousand - is broadcast,
and every piece finds its place from its rank among the pieces of its length.

Defined results: a null text is an empty one, which is one piece holding only
the end token; repeated rows are packed as separate documents; an empty table
gives an empty result; extra and clashing columns are not read.  Which of
equally long pieces shares a sequence with which is arbitrary but fixed by row
content and order.
"""
from __future__ import annotations

import base64
import functools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
END_TOKEN = 0
VOCABULARY = "byte_bpe_50k.tiktoken"
#: fixed value: the vocabulary's special token and its id
SPECIAL = {"<|endoftext|>": 50256}
#: runs of white space from this length on do not go through the pre-tokenizer's backtracking pattern
LONG_SPACE = 10_000
#: fixed value: the characters that the pre-tokenizer's pattern counts as white space
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: fixed value: a configuration filled less is left to best-fit
FULL = 0.995
#: fixed value: power of a length's share of the capacity that is its weight at first
LONG_FIRST = 1.05
#: pieces per rank group (window partition)
RANK_GROUP = 100_000


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY):
    """Byte-level BPE encoder of a public vocabulary file (a file name, or a path).

    The rank file holds the vocabulary of ``byte_bpe_50k.json``; the ids are the
    same, at several times the speed.  As with that file, the string of the special
    token in a text is that token.
    """
    import public_tokenizers
    import tiktoken

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    with open(path, "rb") as fh:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, fh)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def encode(enc, text: str) -> np.ndarray:
    """Ids of a text.

    The pre-tokenizer takes a white-space run as one unit, without its last
    character if text follows.  Long runs are cut out there and encoded as the
    unit they are, since its pattern would backtrack over every character of them.
    """
    out, at = [], 0
    for run in re.finditer(f"[{_SPACE}]{{{LONG_SPACE},}}", text):
        last = run.end() == len(text) or text.startswith(tuple(SPECIAL), run.end())
        stop = run.end() if last else run.end() - 1
        out.append(enc.encode_to_numpy(text[at:run.start()], allowed_special="all"))
        out.append(np.array(enc._core_bpe.encode_single_piece(text[run.start():stop].encode()), np.uint32))
        at = stop
    out.append(enc.encode_to_numpy(text[at:], allowed_special="all"))
    return np.concatenate(out) if len(out) > 1 else out[0]


def pieces_of(ids: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of a document: the first may be shorter than ``capacity``."""
    n = len(ids)
    first = n % capacity or capacity
    cuts = [0, *range(first, n + 1, capacity)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def tokenize_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY,
                    id_column: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """``row, doc_id, piece, start, length, ids_crc32`` (and ``ids``) of every piece of every document row."""
    src = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(it):
        enc = encoder(vocabulary)
        for rb in it:
            take, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(rb.column(1)):
                tok = np.append(encode(enc, text.as_py()), np.uint32(END_TOKEN)).astype("<u4")
                for k, (s, n) in enumerate(pieces_of(tok, capacity)):
                    take.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(tok[s:s + n].tobytes()))
                    if keep_ids:
                        ids.append(tok[s:s + n].astype(np.int32))
            cols = [rb.column(0).take(pa.array(take, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                cols, names = [*cols, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = src.schema["doc_id"].dataType.simpleString()
    out = src.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)
    return out.withColumn("row", F.monotonically_increasing_id())


def _best_configuration(value: np.ndarray, lengths: np.ndarray, capacity: int, left: np.ndarray) -> dict[int, int]:
    """The multiset of lengths of the largest total value that fits ``capacity`` (knapsack over capacities).

    ``left``: how many pieces of each length there are; the traceback never takes more.
    """
    f = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    by_length, place = np.full(capacity + 1, -1.0), np.full(capacity + 1, -1)
    by_length[lengths], place[lengths] = value, np.arange(len(lengths))
    for c in range(1, capacity + 1):
        f[c] = f[c - 1]
        v = f[c - 1::-1] + by_length[1:c + 1]
        b = int(v.argmax())
        if v[b] > f[c] + 1e-12:
            f[c], pick[c] = v[b], place[b + 1]
    out: dict[int, int] = {}
    c = capacity
    while c > 0:
        b = int(pick[c])
        if b < 0:
            c -= 1
        elif out.get(b, 0) >= left[b]:  # none left of this length: the next best that still fits
            ok = np.flatnonzero((lengths <= c) & (left > np.array([out.get(i, 0) for i in range(len(lengths))])))
            if not len(ok):
                break
            b = int(ok[-1])
            out[b] = out.get(b, 0) + 1
            c -= int(lengths[b])
        else:
            out[b] = out.get(b, 0) + 1
            c -= int(lengths[b])
    return out


def _solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, steps: int) -> list[tuple[dict[int, int], float]]:
    """Fractional configuration LP by multiplicative weights: ``[(configuration, times), ...]``.

    Each length is a covering row; its weight falls as configurations cover it.
    Long pieces start a little above their share, so that short ones are left to fill up the last sequences.
    At least ``steps`` steps, and as many as it takes to cover every length.
    """
    weight = (lengths / capacity) ** LONG_FIRST
    covered = np.zeros(len(lengths))
    found: dict[tuple, float] = {}
    step = 0
    while step < steps or not covered.all():
        step += 1
        conf = _best_configuration(weight, lengths, capacity, counts)
        if not conf:
            break
        at, a = np.array(list(conf)), np.array(list(conf.values()))
        times = float((counts[at] / a).min())
        key = tuple(sorted(conf.items()))
        found[key] = found.get(key, 0.0) + times
        covered[at] += a * times
        weight[at] *= np.exp(-0.3 * a * times / counts[at])
    scale = max(1.0, float((covered / counts).max()))
    return [(dict(k), x / scale) for k, x in found.items()]


def _configurations(left: dict[int, int], capacity: int, steps: int, rounds: int) -> tuple[list[tuple[list[int], int]], dict[int, int]]:
    """The sequences that the rounded LP fills, and the pieces it leaves."""
    plan: list[tuple[list[int], int]] = []
    for _ in range(rounds):
        if not left:
            break
        lengths = np.array(sorted(left))
        counts = np.array([left[x] for x in lengths])
        before = counts.sum()
        for conf, x in sorted(_solve(lengths, counts.copy(), capacity, steps),
                              key=lambda p: -sum(int(lengths[i]) * a for i, a in p[0].items())):
            # rounded to the nearest, at least one, while the pieces last
            k = min([max(1, int(x + 0.5)), *(int(counts[i]) // a for i, a in conf.items())])
            if k > 0 and sum(int(lengths[i]) * a for i, a in conf.items()) >= FULL * capacity:
                plan.append(([int(lengths[i]) for i, a in conf.items() for _ in range(a)], k))
                for i, a in conf.items():
                    counts[i] -= a * k
        left = {int(x): int(n) for x, n in zip(lengths, counts) if n}
        if counts.sum() == before:
            break
    return plan, left


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY, steps: int = 60, rounds: int = 8) -> list[tuple[list[int], int]]:
    """``[(lengths of one sequence, how many such sequences), ...]`` that use every piece exactly once."""
    plan: list[tuple[list[int], int]] = []
    left = {int(k): int(v) for k, v in histogram.items() if v > 0}
    if left.get(capacity):
        plan.append(([capacity], left.pop(capacity)))
    full, left = _configurations(left, capacity, steps, rounds)
    return plan + full + _best_fit(left, capacity)


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing over groups of equal bins, so its cost follows the number of lengths, not of pieces."""
    space: dict[int, list] = {}  # free room -> groups [lengths, bins]

    def put(room, items, n):
        space.setdefault(room, []).append([items, n])

    for length in sorted(left, reverse=True):
        n = left[length]
        while n > 0:
            room = min((r for r in space if r >= length), default=None)
            if room is None:
                per = max(1, capacity // length)
                full, rest = divmod(n, per)
                if full:
                    put(capacity - per * length, [length] * per, full)
                if rest:
                    put(capacity - rest * length, [length] * rest, 1)
                n = 0
                continue
            group = space[room][-1]
            k = min(n, group[1])
            group[1] -= k
            items = group[0]
            if group[1] == 0:
                space[room].pop()
                if not space[room]:
                    del space[room]
            put(room - length, [*items, length], k)
            n -= k
    return [(items, n) for groups in space.values() for items, n in groups if n > 0]


def _slots(plan: list[tuple[list[int], int]]):
    """For each length, which ranks go to which sequences and at which offsets (arrays sorted by length and rank)."""
    rows = []
    used: dict[int, int] = {}
    seq = 0
    for items, times in plan:
        at = 0
        for length in sorted(set(items), reverse=True):
            a = items.count(length)
            lo = used.get(length, 0)
            rows.append((length, lo, a, seq, at))
            used[length] = lo + a * times
            at += a * length
        seq += times
    rows.sort()
    return [np.array([r[i] for r in rows], np.int64) for i in range(5)], seq


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, id_column: str = "doc_id",
         keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``) of every piece."""
    spark = docs.sparkSession
    common.prepare(spark)
    pieces = common.stage(tokenize_pieces(docs, capacity, vocabulary, id_column, keep_ids), "pieces")
    # ranks inside each length: a frequent length is split into groups of about RANK_GROUP pieces
    groups = max(16, pieces.count() // RANK_GROUP)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)).cast("int"))
    counts = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    counts = common.stage(counts, "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table, _ = _slots(plan_packing(histogram, capacity))
    shared = spark.sparkContext.broadcast(table)
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")) \
        .drop("n")
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row", "piece")) - 1) \
        .join(before, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] * keep_ids)]

    def place(it):
        length, lo, per, base, at = shared.value
        order = length * (1 << 42) + lo
        for rb in it:
            n, rank = (rb.column(rb.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            k = np.searchsorted(order, n * (1 << 42) + rank, "right") - 1
            d = rank - lo[k]
            yield pa.RecordBatch.from_arrays(
                [*(rb.column(c) for c in cols), pa.array(base[k] + d // per[k]), pa.array(at[k] + d % per[k] * n)],
                names=[*cols, "sequence_id", "offset"])

    ranked = ranked.select(*cols, "rank")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields[:-1])
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")
