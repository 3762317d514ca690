"""Exact removal of repeated substrings by a distributed merge sort of suffixes.

A byte is removed if a ``WINDOW``-byte string that covers it starts at two or
more places of the corpus.

1. Anchors.  Of the ``GRAM``-byte strings in a window the one of the smallest
   hash (leftmost on ties) is the window's anchor, so equal windows have equal
   anchors at equal places.  Windows of one anchor form a block.  Blocks whose
   anchor string occurs once in the corpus hold no repeated window; only their
   hashes were ever shuffled.
2. Sorted runs.  Each task cuts the suffixes at the anchors of the other
   blocks (the bytes from the anchor to the end of the block's last window,
   then the bytes before it, backwards), sorts them, and sends front-coded runs:
   for every suffix the length of the prefix it shares with the one before, and
   the rest.  A suffix that a task holds several times is settled there and
   goes on once.
3. Merge.  The task of an anchor's hash merges the runs with a loser tree that
   knows for each run the prefix shared with the last output, so known prefixes
   are never compared again; the merge yields the suffixes in order with the
   prefix each shares with its neighbour.  Windows of two blocks are equal if
   they lie in one class of equal bytes right of the anchor and one class of
   equal bytes left of it; the classes for each place of the window follow from
   the shared-prefix lengths, without another look at the bytes.
4. An anchor string with more than ``HOT`` places is split: each of its windows
   is a suffix of its own, dealt by its own hash.

All decisions are made on bytes; hashes only choose what meets where.

Defined results: a null text is an empty one; texts below ``WINDOW`` bytes lose
nothing; copies of a text lose everything if it has ``WINDOW`` bytes; rows that
repeat an id are texts of their own; an empty table gives an empty result;
extra and clashing columns are not read.  A removed run may cut a character;
``kept_text`` drops what is left of it, ``kept_sha256`` is of the bytes.
"""
from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import text as tx

WINDOW = 200
GRAM = 64
_REACH = WINDOW - GRAM  # how far before its anchor a window may start
#: occurrences from which an anchor string is split by windows
HOT = 20_000
#: suffixes of a task's sorted run, and of a merge task
RUN = 100_000
_BITS = 22
_ZSTD = pa.Codec("zstd", 1)


def blocks(raw: np.ndarray, offsets: np.ndarray):
    """Blocks of a chunk: text, first window and anchor (places in the text), windows, anchor hash."""
    n_rows = len(offsets) - 1
    out = []
    total = len(raw) - WINDOW + 1
    step = (1 << _BITS) - WINDOW
    low = np.uint64((1 << _BITS) - 1)
    for at in range(0, max(0, total), step):
        part = raw[at:at + step + WINDOW - 1]
        spots = np.arange(len(part) - GRAM + 1)
        h = tx.span_hashes(part, spots, spots + GRAM, False)
        best = tx.window_min((h & ~low) | spots.astype(np.uint64), _REACH + 1)
        anchor = (best & low).astype(np.int64)
        p = np.arange(len(anchor))
        row = np.searchsorted(offsets, p + at, "right") - 1
        ok = p + at + WINDOW <= offsets[row + 1]
        p, anchor, row = p[ok], anchor[ok], row[ok]
        if not len(p):
            continue
        new = np.ones(len(p), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(p)))
        base = offsets[row[first]] - at
        out.append((row[first], p[first] - base, anchor[first] - base, size, h[anchor[first]]))
    if not out:
        z = np.empty(0, np.int64)
        return z, z, z, z, z.astype(np.uint64), n_rows
    return (*(np.concatenate([o[i] for o in out]) for i in range(5)), n_rows)


def _anchors(docs: DataFrame) -> DataFrame:
    """``did, sha, n_bytes, grams, starts, offs, sizes`` of every row (``did``: the id as text)."""

    def run(it):
        for rb in it:
            for i, j, raw, off in tx.utf8_chunks(rb.column(1)):
                row, start, anchor, size, gram, n = blocks(raw, off)
                ends = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
                data = raw.tobytes()
                sha = [hashlib.sha256(data[off[k]:off[k + 1]]).digest() for k in range(n)]
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in
                         (tx.signed(gram), start.astype(np.int32), (anchor - start).astype(np.int16), size.astype(np.int16))]
                yield pa.RecordBatch.from_arrays(
                    [rb.column(0).slice(i, j - i), pa.array(sha, pa.binary()), pa.array(np.diff(off)), *lists],
                    names=["did", "sha", "n_bytes", "grams", "starts", "offs", "sizes"])

    return docs.select("did", "text").mapInArrow(
        run, "did string, sha binary, n_bytes long, grams array<long>, starts array<int>, offs array<short>, sizes array<short>")


def shared_prefixes(keys: list[bytes]) -> np.ndarray:
    """Length of the prefix each string shares with the one before it (0 for the first)."""
    n = len(keys)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    lens = np.array([len(k) for k in keys])
    for a in range(0, n - 1, 4096):
        part = keys[a:a + 4097]
        ln = lens[a:a + 4097]
        width = int(ln.max())
        m = np.zeros((len(part), width + 1), np.uint8)
        flat = np.frombuffer(b"".join(part), np.uint8)
        cols = np.arange(len(flat)) - np.repeat(np.cumsum(ln) - ln, ln)
        m[np.repeat(np.arange(len(part)), ln), cols] = flat
        d = m[1:] != m[:-1]
        d[:, width] = True
        out[a + 1:a + len(part)] = np.minimum(d.argmax(axis=1), np.minimum(ln[1:], ln[:-1]))
    return out


def _first_difference(a: bytes, b: bytes, h: int) -> int:
    """Where two strings that agree on their first ``h`` bytes differ (the shorter length if one is a prefix)."""
    n = min(len(a), len(b))
    while h < n:
        x, y = a[h:h + 24], b[h:h + 24]
        if x != y:
            m = min(len(x), len(y))
            d = int.from_bytes(x[:m], "big") ^ int.from_bytes(y[:m], "big")
            return h + m - (d.bit_length() + 7) // 8 if d else h + m
        h += 24
    return n


def merge_runs(runs: list[tuple[list[bytes], list[int]]]):
    """Merge sorted runs (strings, prefix shared with the predecessor) with a loser tree.

    Yields ``(run, place in run, prefix shared with the string put out before)``.
    Each loser keeps the prefix it shares with the winner it lost to, which is
    the last output when it plays again; unequal prefixes decide without a look
    at the strings, equal ones are compared from there on.
    """
    runs_n = len(runs)
    if runs_n == 0:
        return
    keys = [r[0] for r in runs]
    lcps = [r[1] for r in runs]
    place = [0] * runs_n
    head: list = [k[0] if k else None for k in keys]
    known = [0] * runs_n
    tree = [0] * runs_n

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = head[a], head[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        ha, hb = known[a], known[b]
        if ha > hb:
            return a, b
        if ha < hb:
            return b, a
        d = _first_difference(x, y, ha)
        if x[d:d + 1] <= y[d:d + 1]:
            known[b] = d
            return a, b
        known[a] = d
        return b, a

    winners = [0] * runs_n + list(range(runs_n))
    for node in range(runs_n - 1, 0, -1):
        winners[node], tree[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1] if runs_n > 1 else 0
    while head[top] is not None:
        i = place[top]
        yield top, i, known[top]
        i += 1
        place[top] = i
        if i < len(keys[top]):
            head[top], known[top] = keys[top][i], lcps[top][i]
        else:
            head[top] = None
        node = (top + runs_n) >> 1
        while node:
            other = tree[node]
            x = head[top]
            if x is None or known[top] < known[other] and head[other] is not None:
                top, tree[node] = other, top
            elif head[other] is not None and known[top] == known[other]:
                top, tree[node] = play(top, other)
            node >>= 1


def _pack_run(keys: list[bytes], info: np.ndarray) -> bytes:
    lcp = shared_prefixes(keys)
    rest = [k[h:] for k, h in zip(keys, lcp.tolist())]
    return _ZSTD.compress(p := pickle.dumps((lcp.astype(np.uint16), np.array([len(r) for r in rest], np.uint16), b"".join(rest), info), 5),
                          asbytes=True) + len(p).to_bytes(8, "little")


def _unpack_run(blob: bytes) -> tuple[list[bytes], list[int], np.ndarray]:
    lcp, size, rest, info = pickle.loads(_ZSTD.decompress(blob[:-8], int.from_bytes(blob[-8:], "little"), asbytes=True))
    keys, at, prev = [], 0, b""
    for h, n in zip(lcp.tolist(), size.tolist()):
        prev = prev[:h] + rest[at:at + n]
        at += n
        keys.append(prev)
    return keys, lcp.tolist(), info


def _joined_ranges(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Byte ranges with the overlapping and touching ones of each row joined."""
    if not len(rows):
        return rows, starts, ends
    order = np.lexsort((starts, rows))
    rows, starts, ends = rows[order], starts[order], ends[order]
    far = int(ends.max()) + 2  # rows laid out one after another: a range never reaches the next row
    _, rank = np.unique(rows, return_inverse=True)
    s, e = starts + rank * far, np.maximum.accumulate(ends + rank * far)
    new = np.concatenate([[True], s[1:] > e[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)
    return rows[new], starts[new], e[last] - rank[last] * far


def _runs(texts: DataFrame, parts: int) -> DataFrame:
    """``part, run, row, start, end``: front-coded runs, and byte ranges already known to be repeated."""

    def flush(bins: dict, settled: list):
        out_part, out_run = [], []
        for part, items in bins.items():
            items.sort()
            keys: list[bytes] = []
            info: list[tuple[int, int, int]] = []  # row, anchor, places (2: two or more, settled here)
            i = 0
            while i < len(items):
                j = i + 1
                while j < len(items) and items[j][0] == items[i][0]:
                    j += 1
                key, row, anchor = items[i]
                keys.append(key)
                info.append((row, anchor, 1 if j == i + 1 else 2))
                if j > i + 1:
                    right = key[-1]
                    for _, r, a in items[i:j]:
                        settled.append((r, a - (len(key) - 1 - right), a + right))
                i = j
            out_part.append(part)
            out_run.append(_pack_run(keys, np.array(info, np.int64)))
        n = len(out_part)
        s = np.stack(_joined_ranges(*np.array(settled, np.int64).reshape(-1, 3).T), axis=1)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.array(out_part, np.int32), (s[:, 0] % parts).astype(np.int32)])),
             pa.array(out_run + [None] * len(s), pa.binary()),
             *(pa.array(np.concatenate([np.zeros(n, np.int64), s[:, c]])) for c in range(3))],
            names=["part", "run", "row", "start", "end"])

    def run(it):
        bins, settled, held = {}, [], 0
        for rb in it:
            for row, text, found in zip(rb.column(0).to_pylist(), rb.column(1), rb.column(2)):
                raw = text.as_buffer().to_pybytes()
                back = raw[::-1]
                n = len(raw)
                f = found.values
                for gram, start, off, size, hot in zip(*(f.field(c).to_pylist() for c in range(5))):
                    if hot:  # every window is a suffix of its own
                        for p in range(start, start + size):
                            key = raw[p:p + WINDOW] + b"\xc8"
                            part = int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "little") % parts
                            bins.setdefault(part, []).append((key, row, p))
                    else:
                        a, e = start + off, start + size - 1 + WINDOW
                        key = raw[a:e] + back[n - a:n - start] + bytes((e - a,))
                        bins.setdefault(gram % parts, []).append((key, row, a))
                    held += size if hot else 1
                if held >= RUN:
                    yield flush(bins, settled)
                    bins, settled, held = {}, [], 0
        if held:
            yield flush(bins, settled)

    return texts.select("row", "text", "found").mapInArrow(run, "part int, run binary, row long, start long, end long")


def repeated_windows(right: np.ndarray, left: list[bytes], lcp: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Which windows of each suffix are repeated: ``[suffix, bytes before the anchor]``.

    ``right``: bytes from the anchor on; ``left``: bytes before it, backwards;
    ``lcp``: prefix shared with the suffix before; ``many``: the suffix has
    several places itself.
    """
    m = len(right)
    left_n = np.array([len(x) for x in left], np.int64)
    out = np.zeros((m, _REACH + 1), bool)
    order = sorted(range(m), key=left.__getitem__)
    left_lcp = shared_prefixes([left[i] for i in order])
    order = np.array(order, np.int64)
    left_class = np.empty(m, np.int64)
    for before in range(_REACH + 1):
        rows = np.flatnonzero((WINDOW - right <= before) & (before <= left_n))
        if not len(rows):
            continue
        right_class = np.cumsum(lcp < WINDOW - before)
        left_class[order] = np.cumsum(left_lcp < before)
        key = right_class[rows] * (m + 1) + left_class[rows]
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        out[rows, before] = (counts[inverse] > 1) | many[rows]
    return out


def _merge(runs: DataFrame) -> DataFrame:
    """``row, start, end``: byte ranges covered by repeated windows."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        done = pdf[pdf["run"].isna()]
        packed = [_unpack_run(b) for b in pdf["run"].dropna()]
        keys: list[bytes] = []
        lcp: list[int] = []
        owner: list[tuple[int, int]] = []
        which: list[int] = []
        many: list[bool] = []
        for r, i, h in merge_runs([(p[0], p[1]) for p in packed]):
            key = packed[r][0][i]
            if keys and h == len(key) == len(keys[-1]):
                many[-1] = True
            else:
                keys.append(key)
                lcp.append(h)
                many.append(bool(packed[r][2][i, 2] > 1))
            owner.append((r, i))
            which.append(len(keys) - 1)
        starts, ends, rows = [done["start"].to_numpy()], [done["end"].to_numpy()], [done["row"].to_numpy()]
        if keys:
            h, multi = np.array(lcp), np.array(many)
            right = np.array([k[-1] for k in keys], np.int64)
            left_n = np.array([len(k) for k in keys], np.int64) - 1 - right
            group = np.cumsum(h < GRAM) - 1
            mixed = np.bincount(group)[group] > 1
            info = np.array([packed[r][2][i] for r, i in owner], np.int64)
            which = np.array(which)
            single = info[:, 2] == 1  # the others are settled where they come from
            whole = single & ~mixed[which] & multi[which]
            w = which[whole]
            rows.append(info[whole, 0])
            starts.append(info[whole, 1] - left_n[w])
            ends.append(info[whole, 1] + right[w])
            at = np.flatnonzero(mixed)
            if len(at):
                found = repeated_windows(right[at], [keys[i][right[i]:-1] for i in at], h[at], multi[at])
                edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
                suffix, first = np.nonzero(edge == 1)
                last = np.nonzero(edge == -1)[1] - 1
                local = np.full(len(keys), -1)
                local[at] = np.arange(len(at))
                occ = np.flatnonzero(single & mixed[which])
                mine = local[which[occ]]
                lo = np.searchsorted(suffix, mine)
                n = np.searchsorted(suffix, mine, "right") - lo
                take = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                rows.append(np.repeat(info[occ, 0], n))
                anchor = np.repeat(info[occ, 1], n)
                starts.append(anchor - last[take])
                ends.append(anchor - first[take] + WINDOW)
        r, s, e = _joined_ranges(np.concatenate(rows), np.concatenate(starts), np.concatenate(ends))
        return pd.DataFrame({"row": r, "start": s, "end": e})

    return runs.groupBy("part").applyInPandas(merge, "row long, start long, end long")


def _apply(texts: DataFrame, keep_text: bool) -> DataFrame:
    """Cut the spans (``whole`` or ``spans``) out of each text; ``doc_id`` may be of any type."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(it):
        for rb in it:
            out = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")}
            for text, whole, spans in zip(rb.column(1), rb.column(2).to_pylist(), rb.column(3)):
                raw = text.as_buffer().to_pybytes()
                if whole and len(raw) >= WINDOW:
                    gone, kept = [(0, len(raw))], b""
                else:
                    gone = _joined(spans)
                    kept = raw if not gone else b"".join(
                        raw[a:b] for a, b in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(raw)]))
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(len(raw) - len(kept))
                out["n_spans"].append(len(gone))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if keep_text:
                    out["kept_text"].append(kept.decode("utf-8", "ignore"))
            cols = [pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * keep_text
            yield pa.RecordBatch.from_arrays(
                [rb.column(0), *cols, pa.array(out["kept_sha256"], pa.string()),
                 *([pa.array(out["kept_text"], pa.string())] if keep_text else [])], names=names)

    return texts.select("doc_id", "text", "whole", "spans").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * keep_text)


def _joined(spans) -> list[tuple[int, int]]:
    if not spans.is_valid or not len(spans.values):
        return []
    s, e = (spans.values.field(i).to_numpy() for i in range(2))
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    cut = np.flatnonzero(s[1:] > e[:-1]) + 1
    return list(zip(s[np.concatenate([[0], cut])].tolist(), e[np.append(cut - 1, len(e) - 1)].tolist()))


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", keep_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept_text``) of every row.

    The id column may be a struct, which carries further columns along.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    src = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("did"),
                      F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = common.stage(_anchors(src).withColumn("row", F.monotonically_increasing_id()), "anchors")
    # copies of a text: one row stands for all of them
    copies = found.groupBy("sha").agg(F.count("*").alias("copies"), F.min("row").alias("rep"))
    rows = common.stage(found.select("row", "did", "sha").join(copies, "sha"), "copies")
    flat = found.select("row", F.explode(F.arrays_zip("grams", "starts", "offs", "sizes")).alias("b")) \
        .select("row", F.col("b.grams").alias("gram"), F.col("b.starts").alias("start"), F.col("b.offs").alias("off"), F.col("b.sizes").alias("size"))
    # staged, so that both sides of the join below are plain exchanges and a frequent anchor string is split
    often = common.stage(found.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "often")
    candidates = flat.join(often, "gram").groupBy("row").agg(
        F.collect_list(F.struct("gram", "start", "off", "size", (F.col("n") > HOT).alias("hot"))).alias("found"))
    candidates = common.stage(candidates.join(rows.where("row = rep").select("row", "did", "sha"), "row"), "candidates")
    # the merge tasks: as many as hold RUN suffixes each, at least the session's shuffle partitions
    suffixes = candidates.agg(F.sum(F.size("found")).alias("n")).first()["n"] or 0
    parts = max(common.partitions(spark), -(-suffixes // RUN))

    # one exchange of the texts serves the cutting of suffixes and the removal
    texts = src.withColumn("sha", F.unhex(F.sha2("text", 256))).repartition(common.partitions(spark), "did", "sha")
    runs = _runs(texts.join(candidates, ["did", "sha"]), parts)
    spans = _merge(runs).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    marks = rows.join(spans, "row", "left").where("copies > 1 or spans is not null") \
        .groupBy("did", "sha").agg(F.max(F.col("copies") > 1).alias("whole"), F.first("spans", True).alias("spans"))
    marked = texts.join(marks, ["did", "sha"], "left").withColumn("whole", F.coalesce("whole", F.lit(False)))
    return _apply(marked, keep_text)
