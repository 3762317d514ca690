"""Distances between feature sets, reduced inside blocks.

All-pairs work is split into ``Bl x Br`` block pairs.  Every row of the left
set is copied once per right block and vice versa, rows meet in a
``cogroup(...).applyInPandas`` task keyed by ``(bl, br)``, and the numpy
kernel reduces the distance block before anything leaves the task: the k+1
smallest distances per row (k-NN radii), or one membership flag per row and
direction (precision / recall), or running max / argmin (manifold evaluate).

Costs: shuffle volume is ``O(N * B * D)`` and output ``O(N * B)``; nothing is
ever ``O(N^2)`` in rows.  ``B`` follows ``block_rows`` up to ``MAX_BLOCKS``; beyond
that there are more blocks only where one would exceed ``BLOCK_BYTES``.  So the
exchange grows with N, and a task holds two blocks and a distance tile of
``TILE_BYTES``, whatever N is; only the arithmetic grows with ``N^2``.  Block ids are a hash of the row id, so no block is
hot even when ids are clustered.

Distances are squared Euclidean, ``max(|u|^2 - 2 u.v + |v|^2, 0)``, computed in
double (the source computes them in half precision with a single-precision
fallback).
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .pruning import CellPairs, Cells, choose_pivots, finite_or_far, with_cell
from .selection import exact_percentile

DEFAULT_BLOCK_ROWS = None  # None: sized from the feature width and the cluster (auto_blocks)
# Bytes of one side's block inside a task (rows x D doubles) when sizing blocks automatically.
BLOCK_BYTES = 32 << 20
MIN_BLOCK_ROWS = 256
# Blocks are split for parallelism only down to this many rows (about 1e7
# distance pairs per task); smaller blocks cost more in task overhead than they save.
PARALLEL_BLOCK_ROWS = 4096
# Blocks a side that ``block_rows`` may ask for (each row is copied once per block of the other
# side); there are more only where a block would exceed BLOCK_BYTES.
MAX_BLOCKS = 24
# Above this many right blocks the k-NN candidate lists merge in two levels.
TWO_LEVEL_BLOCKS = 64
# Bytes of a distance tile inside a task, and the right rows of one: the left rows
# taken at a time follow from both.  A tile stays in the processor's cache.
TILE_BYTES = 4 << 20
TILE_COLUMNS = 2048
REALISM_EPS = 1e-5


# ---------------------------------------------------------------- columns
def squared_distance(u: Column | str, v: Column | str) -> Column:
    """V8 for two array columns already on the same row."""
    u = F.col(u) if isinstance(u, str) else u
    v = F.col(v) if isinstance(v, str) else v
    uu = F.aggregate(u, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    vv = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    uv = F.aggregate(F.zip_with(u, v, lambda a, b: a.cast("double") * b.cast("double")),
                     F.lit(0.0), lambda acc, x: acc + x)
    return F.greatest(uu - F.lit(2.0) * uv + vv, F.lit(0.0))


# ---------------------------------------------------------------- kernels
def _matrix(series: pd.Series) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, 0))
    return np.vstack(series.values).astype(np.float64, copy=False)


def tile_rows(width: int) -> int:
    """Left rows per tile against ``width`` right rows."""
    return max(1, TILE_BYTES // (8 * max(1, width)))


def sq_dist_tiles(a: np.ndarray, b: np.ndarray):
    """Squared distances between rows of ``a`` and of ``b``, as tiles ``(rows of a, rows of b, distances)``;
    the right rows ascend for the same left rows.  The next tile overwrites the last one."""
    aa, bb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    width = min(TILE_COLUMNS, max(1, len(b)))
    step = min(tile_rows(width), max(1, len(a)))
    twice, room = a * -2.0, np.empty(step * width)
    for s in range(0, len(a), step):
        left = slice(s, min(len(a), s + step))
        for t in range(0, len(b), width):
            right = slice(t, min(len(b), t + width))
            n, m = left.stop - s, right.stop - t
            d = np.matmul(twice[left], b[right].T, out=room[:n * m].reshape(n, m))
            d += aa[left, None]
            d += bb[None, right]
            np.maximum(d, 0.0, out=d)
            yield left, right, d


# ---------------------------------------------------------------- blocking
def count_blocks(n_rows: int, block_rows: int) -> int:
    return max(1, int(math.ceil(n_rows / float(block_rows))))


def auto_blocks(n_rows: int, dim: int, slots: int) -> int:
    """Blocks per side: enough that one side's block stays under ``BLOCK_BYTES``
    (memory), and up to about ``sqrt(slots)`` so the ``B x B`` block pairs keep
    the cluster busy, as long as blocks keep ``PARALLEL_BLOCK_ROWS`` rows.
    Shuffle grows with B (each row is copied B times), so B is not larger
    than these two needs."""
    cap_rows = max(MIN_BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, dim)))
    by_memory = count_blocks(n_rows, cap_rows)
    by_slots = min(int(math.ceil(math.sqrt(max(1, slots)))), count_blocks(n_rows, PARALLEL_BLOCK_ROWS))
    return max(1, by_memory, by_slots)


def blocks_wanted(n_rows: int, dim: int, slots: int, block_rows: int | None) -> int:
    """Blocks of ``n_rows`` rows: by ``block_rows`` up to ``MAX_BLOCKS`` and beyond that by memory, or :func:`auto_blocks`."""
    if not block_rows:
        return auto_blocks(n_rows, dim, slots)
    wanted = count_blocks(n_rows, block_rows)
    return wanted if wanted <= MAX_BLOCKS else max(MAX_BLOCKS, min(wanted, auto_blocks(n_rows, dim, 1)))


def _n_blocks(df: DataFrame, n_rows: int, block_rows: int | None, feat: str = "f") -> int:
    from ..session import default_parallelism
    row = df.select(F.size(feat).alias("d")).where(F.col("d").isNotNull()).first()
    dim = int(row["d"]) if row else 1
    return blocks_wanted(n_rows, dim, default_parallelism(df.sparkSession), block_rows)


def _n_pivots(blocks: int) -> int:
    """Some more cells than blocks, so that they are small; as every cell is a block, bounded like those."""
    return min(4 * blocks, max(MAX_BLOCKS, blocks))


def _n(x) -> Column:
    return x if isinstance(x, Column) else F.lit(int(x))


def block_of(id_col: str, n_blocks) -> Column:
    """Block id from a hash of the row id; cast to int so cogroup keys agree."""
    return F.pmod(F.xxhash64(F.col(id_col)), _n(n_blocks)).cast("int")


def _replicate(df: DataFrame, own: str, other: str, id_col: str, n_own, n_other) -> DataFrame:
    """Tag rows with their own block and copy them once per block of the other side
    (block counts are ints or per-row columns, e.g. per set)."""
    return (df.withColumn(own, block_of(id_col, n_own))
            .withColumn(other, F.explode(F.sequence(F.lit(0), (_n(n_other) - 1).cast("int")))))


def blocked_cogroup(left: DataFrame, right: DataFrame, kernel, schema: str,
                    n_left_blocks: int, n_right_blocks: int, id_col: str = "id") -> DataFrame:
    """Run ``kernel(key, left_pdf, right_pdf)`` on every (left block, right block) pair.

    The kernel must reduce its distance block (it may not emit all pairs).
    """
    # fresh attributes on the right: a cogroup of a plan with itself otherwise
    # loses columns to pruning when its result is only counted
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    lb = _replicate(left, "_bl", "_br", id_col, n_left_blocks, n_right_blocks)
    rb = _replicate(right, "_br", "_bl", id_col, n_right_blocks, n_left_blocks)
    return (lb.groupBy("_bl", "_br")
            .cogroup(rb.groupBy("_bl", "_br"))
            .applyInPandas(kernel, schema=schema))


def _blocks_for(df: DataFrame, block_rows: int | None, n_rows: int | None) -> tuple[int, int]:
    n = df.count() if n_rows is None else n_rows
    return n, _n_blocks(df, n, block_rows)


# ---------------------------------------------------------------- K1
def knn_radii(df: DataFrame, id_col: str = "id", feat_col: str = "features", ks=(3,),
              block_rows: int | None = DEFAULT_BLOCK_ROWS, n_rows: int | None = None,
              set_col: str | None = None, counts: dict | None = None,
              n_blocks: int | None = None, dim: int | None = None, stats: dict | None = None) -> DataFrame:
    """K1: squared distance to the k-th neighbour of every row, for each k in ``ks``.

    Position 0 of a row's sorted distance list is the row itself, so position
    ``k`` is taken (the source's convention).  Returns ``(id, radii)`` with
    ``radii[j]`` for ``ks[j]`` and ``radius`` = ``radii[0]``.  With ``set_col``
    rows only meet rows of their own set and the output carries the set column.
    ``stats`` receives the number of block pairs and of those that were not skipped.
    """
    ks = tuple(int(k) for k in ks)
    kmax = max(ks)
    sel = [F.col(id_col).cast("bigint").alias("id"), F.col(feat_col).alias("f")]
    sel.append((F.col(set_col).cast("string") if set_col else F.lit("")).alias("_set"))
    feats = df.select(*sel).where("f is not null")  # rows without features take no part
    if counts is None:
        if set_col:
            counts = {r["_set"]: r["n"] for r in feats.groupBy("_set").agg(F.count(F.lit(1)).alias("n")).collect()}
        else:
            counts = {"": feats.count() if n_rows is None else n_rows}
    if not counts or min(counts.values()) < kmax + 1:
        raise ValueError(f"knn_radii needs at least {kmax + 1} rows per set, got {counts}")
    if n_blocks:
        per_set = {k_: int(n_blocks) for k_ in counts}
    else:
        from ..session import default_parallelism
        if dim is None:
            row = feats.select(F.size("f").alias("d")).where(F.col("d").isNotNull()).first()
            dim = int(row["d"]) if row else 1
        slots = default_parallelism(df.sparkSession)
        per_set = {k_: blocks_wanted(v, dim, slots, block_rows) for k_, v in counts.items()}
    radii = lambda d: F.array(*[F.element_at(d, k + 1) for k in ks])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(pdf["f"])
        return pd.DataFrame({"_set": pdf["_set"].values, "id": pdf["id"].values, "d": _k_smallest(x, x, kmax + 1)})

    found = None
    if max(per_set.values()) == 1:  # every set is one block: one job for all
        found = feats.groupBy("_set").applyInPandas(whole, "_set string, id long, d array<double>") \
            .select("_set", F.col("id").alias(id_col), radii("d").alias("radii"))
        per_set = {}
    for name, n_set in sorted((k_, counts[k_]) for k_ in per_set):
        own = feats.where(F.col("_set") == name).drop("_set")
        rows = max(kmax + 1, -(-n_set // per_set[name]))
        one = _nearest_in_blocks(own, n_set, rows, kmax + 1, stats).select(F.lit(name).alias("_set"), F.col("id").alias(id_col), radii("nearest").alias("radii"))
        found = one if found is None else found.unionByName(one)
    out = found.withColumn("radius", F.element_at("radii", 1))
    if set_col:
        return out.withColumnRenamed("_set", set_col)
    return out.drop("_set")


def _k_smallest(a: np.ndarray, b: np.ndarray, keep: int) -> list[np.ndarray]:
    """The ``keep`` smallest squared distances of each row of ``a`` to the rows of ``b``, ascending.

    A row's distances of the first tile are selected; of the later ones only those below what it
    has are looked at.  What is returned holds no tile."""
    m = min(keep, b.shape[0])
    out, row = np.empty((a.shape[0], m)), np.arange(m)
    for left, right, d in sq_dist_tiles(a, b):
        if right.start == 0:
            best = np.sort(np.partition(d, m - 1, axis=1)[:, :m] if m < d.shape[1] else d, axis=1)
        else:
            full = best.shape[1] == m
            # NaN is the largest value: it is below nothing, and a row that still holds one takes all
            i, j = np.nonzero(~(d >= best[:, -1:])) if full else np.nonzero(np.ones(d.shape, bool))
            if len(i):
                rows = np.concatenate([np.repeat(np.arange(len(d)), best.shape[1]), i])
                values = np.concatenate([best.ravel(), d[i, j]])
                order = np.lexsort((values, rows))
                at = np.searchsorted(rows[order], np.arange(len(d)))
                best = values[order[at[:, None] + row[:min(m, right.stop)]]]
        if right.stop == b.shape[0]:
            out[left] = best
    return list(out)


_CANDIDATES = "id long, blk int, d array<double>"


def _nearest_in_blocks(feats: DataFrame, n_rows: int, block_rows: int, keep: int, stats: dict | None) -> DataFrame:
    """``id, nearest``: the ``keep`` smallest squared distances of every row of ``feats`` (``id, f``) within it.

    Blocks are cells around pivots.  Each block is first searched alone, which
    bounds how far the neighbours of its rows can lie; then it only meets blocks
    that the triangle inequality does not put farther away
    (:mod:`featurelab.operators.pruning`).
    """
    row = feats.select(F.size("f").alias("d")).first()
    pivots = choose_pivots(feats, _n_pivots(count_blocks(n_rows, block_rows)) if n_rows > block_rows else 1, int(row["d"]) if row else 1)
    celled = with_cell(feats, pivots)
    cells = Cells.of(celled, len(pivots), block_rows)
    block = F.pmod(F.xxhash64("id"), F.get(F.array(*(F.lit(int(n)) for n in cells.blocks)), F.col("cell"))).cast("int")

    def alone(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(pdf["f"])
        return pd.DataFrame({"id": pdf["id"].values, "cell": pdf["cell"].values, "blk": np.full(len(pdf), -1, np.int32), "d": _k_smallest(x, x, keep)})

    first = celled.withColumn("block", block).groupBy("cell", "block").applyInPandas(alone, "id long, cell int, blk int, d array<double>")
    if int(cells.blocks[cells.rows > 0].sum()) <= 1:
        return first.select("id", F.col("d").alias("nearest"))
    first = stage(first, "neighbours-in-block")
    # squared distance that holds `keep` rows for every row of a cell; without so many in its block there is no bound yet
    bound = np.zeros(len(pivots))
    far = F.when(F.size("d") < keep, F.lit(float("inf"))).otherwise(F.element_at("d", -1))
    for r in first.groupBy("cell").agg(F.max(far).alias("b")).collect():
        bound[r["cell"]] = finite_or_far(r["b"])
    pairs = CellPairs(cells, cells, pivots, np.repeat(np.sqrt(bound)[:, None], len(pivots), axis=1))
    if stats is not None:
        stats.update(pairs.shares())

    def meet(key, lpdf: pd.DataFrame, rpdf: pd.DataFrame) -> pd.DataFrame:
        if len(lpdf) == 0 or len(rpdf) == 0:
            return pd.DataFrame({"id": pd.Series([], dtype="int64"), "blk": pd.Series([], dtype="int32"), "d": pd.Series([], dtype=object)})
        return pd.DataFrame({"id": lpdf["id"].values, "blk": np.full(len(lpdf), int(key[2]), np.int32),
                             "d": _k_smallest(_matrix(lpdf["f"]), _matrix(rpdf["f"]), keep)})

    key = ["l_cell", "l_block", "r_cell", "r_block"]
    other = F.expr("l_cell <> r_cell or l_block <> r_block")
    left = pairs.spread(celled, "l", "r").where(other)
    right = pairs.spread(celled.select(*(F.col(c).alias(c) for c in celled.columns)), "r", "l").where(other)
    second = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(meet, _CANDIDATES)
    partial = first.select("id", "blk", "d").unionByName(second)
    top = lambda c: F.slice(F.array_sort(F.flatten(F.collect_list(c))), 1, keep)
    blocks = int(cells.blocks.sum())
    if blocks > TWO_LEVEL_BLOCKS:
        # many right blocks: merge within groups of ~sqrt(B) cells first, so no
        # row ever collects more than ~sqrt(B) * (k + 1) candidate distances
        g = int(math.ceil(math.sqrt(len(pivots))))
        partial = partial.groupBy("id", F.floor(F.col("blk") / F.lit(g)).alias("_grp")).agg(top("d").alias("d"))
    return partial.groupBy("id").agg(top("d").alias("nearest"))


def clamp_radii(radii: DataFrame, pct: float | None, col: str = "radius", staged: bool = False) -> DataFrame:
    """Radii above the (linearly interpolated) ``pct`` percentile become 0.

    The cut-off is one number: it is selected exactly in a few counting passes
    (:mod:`featurelab.operators.selection`) and applied as a literal.  The radii
    are staged first unless they are already (``staged``), so the blocked job
    behind them runs once.
    """
    if pct is None:
        return radii
    if not staged:
        radii = stage(radii, "radii")
    cut = exact_percentile(radii, col, pct / 100.0)
    return radii.withColumn(col, F.when(F.col(col) > F.lit(cut), F.lit(0.0)).otherwise(F.col(col)))


# ---------------------------------------------------------------- A7 / J5 / U3
def _with_radius(feats: DataFrame, radii: DataFrame, id_col: str) -> DataFrame:
    """Feature rows ``(id, f, r=NULL)`` plus radius rows ``(id, f=NULL, r)``.

    Both kinds are blocked by the same id hash and replicated alike, so each
    block task receives the radii of its own rows; the match happens inside
    the task instead of a shuffle join of the wide feature table.
    """
    r = radii.select(F.col(id_col).cast("bigint").alias("id"), F.lit(None).cast(feats.schema["f"].dataType).alias("f"),
                     F.col("radius").cast("double").alias("r"))
    return feats.select("id", "f", F.lit(None).cast("double").alias("r")).unionByName(r)


def _split_radius(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows of one block: features joined to their radius (inside the task)."""
    has_f = pdf["f"].notna()
    rad = pdf.loc[~has_f, ["id", "r"]].drop_duplicates("id")
    return pdf.loc[has_f, ["id", "f"]].merge(rad, on="id", how="inner")


def membership_flags(ref: DataFrame, ref_radii: DataFrame, smp: DataFrame, smp_radii: DataFrame,
                     id_col: str = "id", feat_col: str = "features",
                     block_rows: int | None = DEFAULT_BLOCK_ROWS,
                     n_ref: int | None = None, n_smp: int | None = None,
                     ref_blocks: int | None = None, smp_blocks: int | None = None,
                     stats: dict | None = None) -> DataFrame:
    """J5 + U3 in both directions in one pass over (ref block, sample block) pairs.

    Returns ``(side, id, inside)``: side ``ref`` rows are inside some sample
    ball (recall), side ``sample`` rows inside some reference ball (precision).
    Boundary included (``dist <= radius``).  With several blocks a side, blocks are
    cells around pivots, and pairs farther apart than the larger radius of both
    are skipped; ``stats`` receives the number of pairs and of those kept.
    """
    rf = ref.select(F.col(id_col).cast("bigint").alias("id"), F.col(feat_col).alias("f")).where("f is not null")
    sf = smp.select(F.col(id_col).cast("bigint").alias("id"), F.col(feat_col).alias("f")).where("f is not null")
    br = ref_blocks or _blocks_for(rf, block_rows, n_ref)[1]
    bs = smp_blocks or _blocks_for(sf, block_rows, n_smp)[1]

    def kernel(_key, rpdf: pd.DataFrame, spdf: pd.DataFrame) -> pd.DataFrame:
        rpdf, spdf = _split_radius(rpdf), _split_radius(spdf)
        if len(rpdf) == 0 or len(spdf) == 0:
            return pd.DataFrame({"side": pd.Series([], dtype=object),
                                 "id": pd.Series([], dtype="int64"),
                                 "inside": pd.Series([], dtype=bool)})
        a, b = _matrix(rpdf["f"]), _matrix(spdf["f"])
        ra, rb = rpdf["r"].to_numpy(np.float64), spdf["r"].to_numpy(np.float64)
        ref_in = np.zeros(a.shape[0], dtype=bool)
        smp_in = np.zeros(b.shape[0], dtype=bool)
        for left, right, d in sq_dist_tiles(a, b):
            ref_in[left] |= (d <= rb[None, right]).any(axis=1)
            smp_in[right] |= (d <= ra[left, None]).any(axis=0)
        return pd.DataFrame({
            "side": ["ref"] * len(a) + ["sample"] * len(b),
            "id": np.concatenate([rpdf["id"].to_numpy(), spdf["id"].to_numpy()]),
            "inside": np.concatenate([ref_in, smp_in]),
        })

    schema = "side string, id long, inside boolean"
    if br == bs == 1:
        partial = blocked_cogroup(_with_radius(rf, ref_radii, id_col), _with_radius(sf, smp_radii, id_col), kernel, schema, br, bs)
        return partial.groupBy("side", "id").agg(F.bool_or("inside").alias("inside"))
    sides = {"l": (rf, ref_radii, br, "ref"), "r": (sf, smp_radii, bs, "sample")}
    row = rf.select(F.size("f").alias("d")).first()
    pivots = choose_pivots(rf, _n_pivots(max(br, bs)), int(row["d"]) if row else 1)
    if not len(pivots):
        return rf.sparkSession.createDataFrame([], schema)
    cells, most, rows, ids = {}, {}, {}, None
    for s, (feats, radii, blocks, name) in sides.items():
        celled = with_cell(feats, pivots)
        n = feats.count()
        cells[s] = Cells.of(celled, len(pivots), max(1, -(-n // blocks)))
        own = stage(celled.select("id", "cell", "gap").join(
            radii.select(F.col(id_col).cast("bigint").alias("id"), F.col("radius").cast("double").alias("r")), "id"), "block-radii")
        most[s] = np.zeros(len(pivots))
        for r in own.groupBy("cell").agg(F.max("r").alias("r")).collect():
            most[s][r["cell"]] = math.sqrt(max(0.0, finite_or_far(r["r"])))
        rows[s] = celled.select("id", "f", F.lit(None).cast("double").alias("r"), "cell", "gap").unionByName(
            own.select("id", F.lit(None).cast(feats.schema["f"].dataType).alias("f"), "r", "cell", "gap"))
        none = own.select(F.lit(name).alias("side"), "id", F.lit(False).alias("inside"))
        ids = none if ids is None else ids.unionByName(none)
    pairs = CellPairs(cells["l"], cells["r"], pivots, np.maximum(most["l"][:, None], most["r"][None, :]))
    if stats is not None:
        stats.update(pairs.shares())
    key = ["l_cell", "l_block", "r_cell", "r_block"]
    left, right = pairs.spread(rows["l"], "l", "r"), pairs.spread(rows["r"], "r", "l")
    partial = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(kernel, schema)
    return partial.unionByName(ids).groupBy("side", "id").agg(F.bool_or("inside").alias("inside"))


def precision_recall(ref: DataFrame, smp: DataFrame, k: int = 3, id_col: str = "id",
                     feat_col: str = "features", block_rows: int | None = DEFAULT_BLOCK_ROWS,
                     clamp_pct: float | None = None) -> DataFrame:
    """One row ``(precision, recall)`` from k-NN manifolds of both sets.

    One small aggregate profiles both sets (row counts, feature width); the
    radii of both sets then come from one blocked job and the memberships
    from a second one over (reference block, sample block) pairs.
    """
    both = (ref.select(F.lit("ref").alias("_side"), id_col, feat_col)
            .unionByName(smp.select(F.lit("sample").alias("_side"), id_col, feat_col)))
    prof = {r["_side"]: (r["n"], r["d"]) for r in
            both.where(F.col(feat_col).isNotNull()).groupBy("_side").agg(F.count(F.lit(1)).alias("n"), F.max(F.size(feat_col)).alias("d")).collect()}
    counts = {s_: v[0] for s_, v in prof.items()}
    if set(counts) != {"ref", "sample"}:
        raise ValueError("precision_recall needs non-empty reference and sample sets")
    dim = max(v[1] for v in prof.values())
    from ..session import default_parallelism
    slots = default_parallelism(ref.sparkSession)

    def blocks(n):
        return blocks_wanted(n, dim, slots, block_rows)
    radii = knn_radii(both, id_col, feat_col, (k,), block_rows, set_col="_side", counts=counts, dim=dim)
    # both sides read the radii: stage them once (N x (id, radius), small next to
    # the features) so the blocked k-NN job runs once, and survives lost executors
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(ref.sparkSession)
    radii = radii.select("_side", id_col, "radius").checkpoint(eager=True)
    r1 = clamp_radii(radii.where(F.col("_side") == "ref").drop("_side"), clamp_pct, staged=True)
    r2 = clamp_radii(radii.where(F.col("_side") == "sample").drop("_side"), clamp_pct, staged=True)
    flags = membership_flags(ref, r1, smp, r2, id_col, feat_col, block_rows,
                             ref_blocks=blocks(counts["ref"]), smp_blocks=blocks(counts["sample"]))
    return flags.agg(
        F.avg(F.when(F.col("side") == "sample", F.col("inside").cast("double"))).alias("precision"),
        F.avg(F.when(F.col("side") == "ref", F.col("inside").cast("double"))).alias("recall"))


# ---------------------------------------------------------------- A8 / K2
def manifold_evaluate(ref: DataFrame, ref_radii: DataFrame, evl: DataFrame, id_col: str = "id",
                      feat_col: str = "features", block_rows: int | None = DEFAULT_BLOCK_ROWS,
                      eps: float = REALISM_EPS, stats: dict | None = None) -> DataFrame:
    """Per eval row ``inside`` (any ball holds it), ``max_realism`` =
    ``max(r / (d + eps))``, ``nearest_id`` (lowest id on ties) and its distance.

    With several blocks a side, blocks are cells around pivots.  The rows of a cell
    meet first; what they find bounds how far a better ball or a nearer row can lie,
    and block pairs beyond that are skipped (``stats`` receives their numbers)."""
    rf = ref.select(F.col(id_col).cast("bigint").alias("id"), F.col(feat_col).alias("f")).where("f is not null")
    ef = evl.select(F.col(id_col).cast("bigint").alias("id"), F.col(feat_col).alias("f")).where("f is not null")
    n_ref, br = _blocks_for(rf, block_rows, None)
    n_eval, be = _blocks_for(ef, block_rows, None)

    def kernel(_key, rpdf: pd.DataFrame, epdf: pd.DataFrame) -> pd.DataFrame:
        rpdf = _split_radius(rpdf)
        if len(rpdf) == 0 or len(epdf) == 0:
            return pd.DataFrame({"id": pd.Series([], dtype="int64"), "inside": pd.Series([], dtype=bool),
                                 "realism": pd.Series([], dtype="float64"),
                                 "min_d": pd.Series([], dtype="float64"),
                                 "nearest_id": pd.Series([], dtype="int64")})
        rpdf = rpdf.sort_values("id", kind="stable")
        a, b = _matrix(epdf["f"]), _matrix(rpdf["f"])
        r = rpdf["r"].to_numpy(np.float64)
        rid = rpdf["id"].to_numpy()
        inside, realism = np.zeros(len(a), bool), np.full(len(a), -np.inf)
        mind, near = np.full(len(a), np.inf), np.full(len(a), rid[0])
        for left, right, d in sq_dist_tiles(a, b):
            inside[left] |= (d <= r[None, right]).any(axis=1)
            j = d.argmin(axis=1)
            v = d[np.arange(d.shape[0]), j]
            # the right rows ascend by id, so the first of equal distances stays; NaN is taken and stays
            closer = (v < mind[left]) | (np.isnan(v) & ~np.isnan(mind[left]))
            near[left] = np.where(closer, rid[right][j], near[left])
            mind[left] = np.where(closer, v, mind[left])
            d += eps
            np.divide(r[None, right], d, out=d)
            realism[left] = np.maximum(realism[left], d.max(axis=1))
        return pd.DataFrame({"id": epdf["id"].values, "inside": inside, "realism": realism, "min_d": mind, "nearest_id": near})

    schema = "id long, inside boolean, realism double, min_d double, nearest_id long"
    if br == be == 1 or n_ref == 0:
        partial = blocked_cogroup(_with_radius(rf, ref_radii, id_col), ef, kernel, schema, br, be)
    else:
        partial = _evaluate_in_cells(rf, ref_radii, ef, id_col, -(-n_ref // br), max(1, -(-n_eval // be)), _n_pivots(max(br, be)), kernel, schema, eps, stats)
    return (partial.groupBy("id")
            .agg(F.bool_or("inside").alias("inside"),
                 F.max("realism").alias("max_realism"),
                 F.min(F.struct("min_d", "nearest_id")).alias("_nn"))
            .select(F.col("id").alias(id_col), "inside", "max_realism",
                    F.col("_nn.nearest_id").alias("nearest_id"),
                    F.col("_nn.min_d").alias("nearest_dist")))


def _evaluate_in_cells(rf, ref_radii, ef, id_col, ref_rows, eval_rows, n_pivots, kernel, schema, eps, stats) -> DataFrame:
    """The partial results of the block pairs that can matter: those of a cell with itself, then those in reach."""
    row = rf.select(F.size("f").alias("d")).first()
    pivots = choose_pivots(rf, n_pivots, int(row["d"]))
    celled = with_cell(rf, pivots)
    ev = with_cell(ef, pivots)
    left, right = Cells.of(celled, len(pivots), ref_rows), Cells.of(ev, len(pivots), eval_rows)
    own = stage(celled.select("id", "cell", "gap").join(
        ref_radii.select(F.col(id_col).cast("bigint").alias("id"), F.col("radius").cast("double").alias("r")), "id"), "block-radii")
    most = np.zeros(len(pivots))
    for r in own.groupBy("cell").agg(F.max("r").alias("r")).collect():
        most[r["cell"]] = max(0.0, finite_or_far(r["r"]))
    rows = celled.select("id", "f", F.lit(None).cast("double").alias("r"), "cell", "gap").unionByName(
        own.select("id", F.lit(None).cast(rf.schema["f"].dataType).alias("f"), "r", "cell", "gap"))
    key = ["l_cell", "l_block", "r_cell", "r_block"]

    def meet(pairs: CellPairs) -> DataFrame:
        a, b = pairs.spread(rows, "l", "r"), pairs.spread(ev.select(*(F.col(c).alias(c) for c in ev.columns)), "r", "l")
        return a.groupBy(*key).cogroup(b.groupBy(*key)).applyInPandas(kernel, schema)

    far = np.full((len(pivots), len(pivots)), np.inf)
    same = CellPairs(left, right, pivots, far)
    same.keep &= np.eye(len(pivots), dtype=bool)
    first = stage(meet(same), "own-cell")
    found = ev.select("id", "cell").join(first.groupBy("id").agg(F.min("min_d").alias("d"), F.max("realism").alias("m")), "id", "left")
    near, real = np.zeros(len(pivots)), np.full(len(pivots), np.inf)
    for r in found.groupBy("cell").agg(F.max(F.coalesce("d", F.lit(float("inf")))).alias("d"), F.min(F.coalesce("m", F.lit(0.0))).alias("m")).collect():
        near[r["cell"]], real[r["cell"]] = finite_or_far(r["d"]), r["m"] if r["m"] == r["m"] else 0.0
    # a ball of radius r beats the realism m up to the distance r / m - eps
    beat = np.where(most[:, None] > 0, most[:, None] / np.maximum(real[None, :], 1e-300) - eps, 0.0)
    rest = CellPairs(left, right, pivots, np.sqrt(np.maximum(np.maximum(most[:, None], near[None, :]), beat)))
    if stats is not None:
        stats.update(rest.shares())
    rest.keep &= ~np.eye(len(pivots), dtype=bool)
    return first.unionByName(meet(rest))


def nearest(ref: DataFrame, evl: DataFrame, id_col: str = "id", feat_col: str = "features",
            block_rows: int | None = DEFAULT_BLOCK_ROWS, stats: dict | None = None) -> DataFrame:
    """K2: id of the closest reference row for each eval row (first id on ties)."""
    zero = ref.select(F.col(id_col), F.lit(0.0).alias("radius"))
    return manifold_evaluate(ref, zero, evl, id_col, feat_col, block_rows, stats=stats).select(
        id_col, "nearest_id", "nearest_dist")


def pairwise_distance_summary(left: DataFrame, right: DataFrame, id_col: str = "id",
                              feat_col: str = "features",
                              block_rows: int | None = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """J4 reduced per left row: count, min, max and sum of distances to the right set."""
    lf = left.select(F.col(id_col).cast("bigint").alias("id"), F.col(feat_col).alias("f")).where("f is not null")
    rf = right.select(F.col(id_col).cast("bigint").alias("id"), F.col(feat_col).alias("f")).where("f is not null")
    _, bl = _blocks_for(lf, block_rows, None)
    _, brr = _blocks_for(rf, block_rows, None)

    def kernel(_key, lpdf: pd.DataFrame, rpdf: pd.DataFrame) -> pd.DataFrame:
        if len(lpdf) == 0 or len(rpdf) == 0:
            return pd.DataFrame({"id": pd.Series([], dtype="int64"), "n": pd.Series([], dtype="int64"),
                                 "mn": pd.Series([], dtype="float64"), "mx": pd.Series([], dtype="float64"),
                                 "sm": pd.Series([], dtype="float64")})
        a, b = _matrix(lpdf["f"]), _matrix(rpdf["f"])
        mn, mx, sm = np.full(len(a), np.inf), np.full(len(a), -np.inf), np.zeros(len(a))
        for left, _, d in sq_dist_tiles(a, b):
            mn[left] = np.minimum(mn[left], d.min(axis=1))
            mx[left] = np.maximum(mx[left], d.max(axis=1))
            sm[left] += d.sum(axis=1)
        return pd.DataFrame({"id": lpdf["id"].values, "n": np.full(len(a), b.shape[0], dtype=np.int64), "mn": mn, "mx": mx, "sm": sm})

    partial = blocked_cogroup(lf, rf, kernel, "id long, n long, mn double, mx double, sm double", bl, brr)
    return partial.groupBy("id").agg(F.sum("n").alias("n_pairs"), F.min("mn").alias("min_dist"),
                                     F.max("mx").alias("max_dist"), F.sum("sm").alias("sum_dist")
                                     ).withColumnRenamed("id", id_col)
