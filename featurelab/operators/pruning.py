"""Which pairs of blocks of an all-pairs job can matter.

A few rows are pivots; every row belongs to the cell of its nearest pivot, and a
cell's radius is its largest distance to the pivot.  By the triangle inequality no
two rows of the cells A and B are closer than ``|a - b| - radius(A) - radius(B)``,
so a pair of cells is skipped when that exceeds what is looked for.  Large cells
are cut into blocks by a hash of the id.

Pivots are the rows of the smallest id hashes, at most ``MAX_PIVOTS`` and
``PIVOT_BYTES``, so what the driver and the tasks hold of them (their distances
included) is bounded; they change only which pairs are skipped, never a result.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_PIVOTS = 512
PIVOT_BYTES = 64 << 20
_PARTNERS = T.ArrayType(T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("block", T.IntegerType()),
                                      T.StructField("limit", T.DoubleType())]))
#: bounds are floating point: they are loosened by this share of the coordinates' size before anything is skipped
_SLACK = 1e-6


def choose_pivots(feats: DataFrame, n: int, dim: int) -> np.ndarray:
    """At most ``n`` rows of ``feats`` (``id, f``), by the smallest hashes of their ids."""
    n = max(1, min(n, MAX_PIVOTS, PIVOT_BYTES // (8 * max(1, dim))))
    rows = feats.select("f", F.xxhash64("id").alias("h")).orderBy("h").limit(n).collect()
    return np.array([r["f"] for r in rows], np.float64)


def with_cell(feats: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``feats`` (with ``f``) and ``cell, gap``: the nearest pivot and the distance to it."""
    shared = feats.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches):
        p = shared.value
        pp = np.einsum("ij,ij->i", p, p)
        for pdf in batches:
            if len(pdf) == 0:
                continue
            cell, gap = [], []
            step = max(1, (32 << 20) // (8 * len(p)))
            for s in range(0, len(pdf), step):
                x = np.vstack(pdf["f"].iloc[s:s + step].values).astype(np.float64)
                near = (pp[None, :] - 2.0 * (x @ p.T)).argmin(axis=1)
                cell.append(near)
                gap.append(np.sqrt(((x - p[near]) ** 2).sum(axis=1)))
            yield pdf.assign(cell=np.concatenate(cell).astype(np.int32), gap=np.concatenate(gap))

    schema = T.StructType(feats.schema.fields + [T.StructField("cell", T.IntegerType()), T.StructField("gap", T.DoubleType())])
    return feats.mapInPandas(assign, schema)


def finite_or_far(x) -> float:
    """A bound; unknown (null or NaN) is infinitely far."""
    return float("inf") if x is None or math.isnan(x) else float(x)


@dataclass
class Cells:
    """Rows, radius and blocks of every cell of a set."""
    rows: np.ndarray
    radius: np.ndarray
    blocks: np.ndarray

    @staticmethod
    def of(celled: DataFrame, n_pivots: int, block_rows: int) -> Cells:
        rows, radius = np.zeros(n_pivots, np.int64), np.zeros(n_pivots)
        for r in celled.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("g")).collect():
            rows[r["cell"]], radius[r["cell"]] = r["n"], finite_or_far(r["g"])
        return Cells(rows, radius, np.maximum(1, -(-rows // max(1, block_rows))))


def pivot_distances(pivots: np.ndarray) -> np.ndarray:
    return np.vstack([np.sqrt(((pivots - p) ** 2).sum(axis=1)) for p in pivots])


@dataclass
class CellPairs:
    """The pairs of a left and a right cell that can matter, and how far away a row of either may still lie."""
    left: Cells
    right: Cells
    pivots: np.ndarray
    reach: np.ndarray  # of each (left, right) pair: distances up to it matter

    def __post_init__(self):
        self.distance = pivot_distances(self.pivots)
        size = np.abs(self.pivots).max(initial=0.0) * math.sqrt(self.pivots.shape[1] if self.pivots.ndim == 2 else 1)
        self.reach = self.reach + _SLACK * (1.0 + size + self.distance.max(initial=0.0))
        bound = self.distance - self.left.radius[:, None] - self.right.radius[None, :]
        self.keep = (bound <= self.reach) & (self.left.rows > 0)[:, None] & (self.right.rows > 0)[None, :]

    def _partners(self, other: Cells, keep, distance, reach) -> list[list[tuple]]:
        """By cell ``(other cell, its block, limit)``; a row takes part if its gap is at least the limit."""
        out = []
        for a in range(len(keep)):
            limit = distance[a] - other.radius - reach[a]
            out.append([(int(b), k, float(limit[b])) for b in np.flatnonzero(keep[a]) for k in range(int(other.blocks[b]))])
        return out

    def spread(self, celled: DataFrame, own: str, partner: str) -> DataFrame:
        """Copies of the rows for every block of the other side they may matter to, with
        ``<own>_cell, <own>_block`` and ``<partner>_cell, <partner>_block``."""
        if own == "l":
            rows, cells = self._partners(self.right, self.keep, self.distance, self.reach), self.left
        else:
            rows, cells = self._partners(self.left, self.keep.T, self.distance.T, self.reach.T), self.right
        spark = celled.sparkSession
        table = spark.createDataFrame(list(enumerate(rows)), T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("partners", _PARTNERS)]))
        blocks = F.array(*(F.lit(int(n)) for n in cells.blocks))
        copies = celled.withColumn("block", F.pmod(F.xxhash64("id"), F.get(blocks, F.col("cell"))).cast("int"))
        # the table has one row per pivot
        copies = copies.join(F.broadcast(table), "cell").withColumn("p", F.explode(F.filter("partners", lambda p: F.col("gap") >= p["limit"])))
        return copies.withColumnsRenamed({"cell": f"{own}_cell", "block": f"{own}_block"}).withColumn(f"{partner}_cell", F.col("p.cell")) \
            .withColumn(f"{partner}_block", F.col("p.block")).drop("partners", "p", "gap")

    def shares(self) -> dict:
        """Block pairs in all, and those kept."""
        all_pairs = int(self.left.blocks[self.left.rows > 0].sum() * self.right.blocks[self.right.rows > 0].sum())
        kept = int((self.keep * self.left.blocks[:, None] * self.right.blocks[None, :]).sum())
        return {"pairs": all_pairs, "kept": kept}
