"""Exact top-k search by inner product over Voronoi cells (operator 5).

Pivots, as many as the square root of the rows (PIVOTS at most), part the vectors into cells; cells whose pivots lie near each
other make a group of about BLOCK vectors, and a larger one is parted by hash. With u the direction of a cell's pivot, a
vector is x = a u + r, r orthogonal to u. A cell's summary is the least and greatest a and the greatest |r|, and its radius
about the pivot p. For a query q = b u + s, every x of the cell scores at most max(b a) + |s| |r|, and at most
q.p + |q| radius: the lesser of the two is the cell's bound.

SAMPLE rows (a bounded, documented number, by hash of vec_id; the pivots are the first of them) are known to every task. The
k-th highest score of a query among them, its own row left out, is reached by its answers, so the query goes only to groups
that hold a cell whose bound reaches it. Data rows are written once, to their group; only queries, the smaller side, are
replicated, and only where they must be. A task holds one block's vectors, its queries stream by; blocks are merged.

The result is exact: components are integers, products are summed exactly in doubles (below 2^53), and bounds have slack for
rounding. How much bounds prune depends on the data: ``routed`` counts it. Which rows take part: see provenlake.llm.vectors.
An empty table: no rows. Fewer than k other rows: all of them. Ties go to the smaller vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenlake.llm.vectors import BLOCK, BLOCKS, block_rows, matrix, solve_blocks, taking_part, top_k

#: Pivots at most, and rows that every task knows: both bound what the driver holds and broadcasts.
PIVOTS, SAMPLE = 2048, 8192


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * (x @ p.T), 0))


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


class Cells:
    """Pivots, their directions, and the group of each."""

    def __init__(self, pivots: np.ndarray, groups: int):
        self.p = pivots
        size = _norms(pivots)
        self.u = pivots / np.where(size > 0, size, 1)[:, None]
        heads = pivots[: max(1, min(groups, len(pivots)))]
        self.group = _distances(pivots, heads).argmin(1)

    def bounds(self, q: np.ndarray, summary: np.ndarray) -> np.ndarray:
        """The greatest score that a vector of each cell can have with each query; -inf for empty cells."""
        low, high, rest, radius = summary.T
        b, size = q @ self.u.T, _norms(q)[:, None]
        across = np.sqrt(np.maximum(size * size - b * b, 0))
        with np.errstate(invalid="ignore"):
            most = np.minimum(np.maximum(b * low, b * high) + across * rest, q @ self.p.T + size * radius)
            return np.where(np.isfinite(low), most + 1e-6 * (np.abs(most) + size * (rest + radius) + 1), -np.inf)


class Join:
    """The steps over a table: see the module's head."""

    def __init__(self, table: DataFrame, k: int, every: int, scale: int, pivots: int | None, id_col: str, vector_col: str):
        self.spark, self.k, self.every = table.sparkSession, k, every
        rows, self.d = taking_part(table, id_col, vector_col)
        if not self.d:
            return
        self.rows = rows.select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("v"))
        self.n = rows.count()
        known = self.rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
        ids, sample = np.array([r["vec_id"] for r in known], np.int64), np.array([r["v"] for r in known], np.float64)
        p = np.unique(sample[: pivots or max(1, min(PIVOTS, int(self.n**0.5)))], axis=0)
        self.groups = max(1, min(len(p), -(-self.n // BLOCK)))
        self.told = self.spark.sparkContext.broadcast((Cells(p[np.random.default_rng(5).permutation(len(p))], self.groups), ids, sample))

    def summary(self) -> np.ndarray:
        """(n, least a, greatest a, greatest |r|, radius) of each cell: five numbers a pivot."""
        told, d = self.told, self.d

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells = told.value[0]
            for batch in batches:
                if len(batch):
                    x = matrix(batch, "v", d)
                    dist = _distances(x, cells.p)
                    cell = dist.argmin(1)
                    a = (x * cells.u[cell]).sum(1)
                    r = np.sqrt(np.maximum((x * x).sum(1) - a * a, 0))
                    own = np.unique(cell)
                    parts = [cell == c for c in own]
                    cols = [[int(m.sum()) for m in parts], [a[m].min() for m in parts], [a[m].max() for m in parts], [r[m].max() for m in parts], [dist[m, c].max() for m, c in zip(parts, own, strict=True)]]
                    yield pa.record_batch([pa.array(own.astype(np.int32)), pa.array(cols[0], pa.int64()), *(pa.array(x, pa.float64()) for x in cols[1:])], ["cell", "n", "low", "high", "rest", "radius"])

        found = self.rows.mapInArrow(run, "cell int, n long, low double, high double, rest double, radius double")
        rows = found.groupBy("cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("rest").alias("rest"), F.max("radius").alias("radius")).collect()
        out = np.full((len(told.value[0].p), 5), np.nan)
        out[:, 0] = 0
        for r in rows:
            out[r["cell"]] = r["n"], r["low"], r["high"], r["rest"], r["radius"]
        return out

    def routed(self) -> tuple[DataFrame, int]:
        """(rows of BLOCKS: every vector once, each query for the blocks it must see; the number of blocks)."""
        told, d, k, every = self.told, self.d, self.k, self.every
        summary = self.summary()
        size = np.zeros(self.groups, np.int64)
        np.add.at(size, told.value[0].group, summary[:, 0].astype(np.int64))
        blocks = np.maximum(1, -(-size // BLOCK))
        first = np.cumsum(blocks) - blocks
        shared = self.spark.sparkContext.broadcast((summary[:, 1:], blocks, first))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells, sample_ids, sample = told.value
            summary, blocks, first = shared.value
            for batch in batches:
                if not len(batch):
                    continue
                ids, x = batch.column("vec_id").to_numpy(), matrix(batch, "v", d)
                group = cells.group[_distances(x, cells.p).argmin(1)]
                salt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                yield block_rows(first[group] + salt % blocks[group], 0, ids, x)
                asked = np.flatnonzero(ids % every == 0)
                for i in (asked[a : a + 256] for a in range(0, len(asked), 256)):
                    q = x[i]
                    score = np.where(sample_ids[None] == ids[i][:, None], -np.inf, q @ sample.T)
                    least = -np.partition(-score, k - 1, 1)[:, k - 1] if score.shape[1] >= k else np.full(len(i), -np.inf)
                    send = cells.bounds(q, summary) >= least[:, None]
                    reach = np.zeros((len(i), len(blocks)), bool)
                    for g in range(len(blocks)):
                        reach[:, g] = send[:, cells.group == g].any(1)
                    for g in np.flatnonzero(reach.any(0)).tolist():
                        own = i[reach[:, g]]
                        for b in range(int(blocks[g])):
                            yield block_rows(np.full(len(own), first[g] + b), 1, ids[own], x[own])

        return self.rows.mapInArrow(run, BLOCKS), int(blocks.sum())


def search(table: DataFrame, k: int = 5, every: int = 50, scale: int = 256, pivots: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for rows whose id is divisible by ``every``, the k rows with the highest inner product
    of floor(scale * x), the query's own row left out."""
    join = Join(table, k, every, scale, pivots, id_col, vector_col)
    if not join.d:
        return join.spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows, blocks = join.routed()
    return top_k(solve_blocks(rows, blocks, join.d, k, lambda a, b: a @ b.T, "long"), k)
