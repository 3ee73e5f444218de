"""Approximate nearest neighbours by cross-polytope hashing (operator 8).

A table's hash of a unit vector is the signed axis nearest to it after a pseudo-random rotation: three rounds of random
signs and a fast Walsh-Hadamard transform. A vector lies in one bucket of each table; a query looks into the ``probes``
buckets of each table whose axes it lies nearest to. What it meets there is scored exactly, in double precision, on the
original vectors, and the best of all tables are kept. All rows are indexed. A query that so meets fewer than k rows, though
there are more, is compared with all of them.

The vectors of this task have little structure (nearest cosines of 0.4 in 64 dimensions), so the defaults look into many
buckets: 12 tables of 128 buckets and 6 probes each, a recall of about 0.95; see the README for measured figures.

Buckets over BLOCK vectors are parted by hash, so that a bucket which holds a third of all rows is spread over many tasks;
bucket sizes (tables x 2 x dimensions numbers) are all that the driver sees. Blocks are solved locally: a task holds one
block's vectors, and its queries stream by. A vector is written once for each table. Which rows take part: see provenlake.llm.vectors; zero vectors take none. Ties go to the smaller vec_id. An
empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenlake.llm.common import shards_for, stash
from provenlake.llm.vectors import BLOCK, BLOCKS, block_rows, matrix, solve_blocks, taking_part, top_k


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of rows whose length is a power of two, scaled to keep lengths."""
    n, size = x.shape
    h = 1
    while h < size:
        y = x.reshape(n, size // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, size)
        h *= 2
    return x / np.sqrt(size)


class Rotations:
    """Pseudo-random rotations: (Hadamard after random signs) three times, of vectors padded to a power of two."""

    def __init__(self, d: int, tables: int, seed: int):
        self.d, self.size = d, 1 << max(1, (d - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), (tables, 3, self.size))

    def rotate(self, x: np.ndarray, table: int) -> np.ndarray:
        y = np.zeros((len(x), self.size))
        y[:, : self.d] = x
        for s in self.signs[table]:
            y = hadamard(y * s)
        return y

    def bucket(self, y: np.ndarray) -> np.ndarray:
        """The nearest signed axis: the axis, plus size for its negative side."""
        axis = np.abs(y).argmax(1)
        return axis + self.size * (y[np.arange(len(y)), axis] < 0)

    def probes(self, y: np.ndarray, count: int) -> np.ndarray:
        """The count nearest signed axes of each row."""
        both = np.concatenate([y, -y], 1)
        count = min(count, both.shape[1])
        return np.argpartition(-both, count - 1, 1)[:, :count]


def _cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (q @ x.T) / (np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None])


def _pair_cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (q * x).sum(-1) / (np.sqrt((q * q).sum(-1)) * np.sqrt((x * x).sum(-1)))


def search(table: DataFrame, k: int = 5, every: int = 50, tables: int = 12, probes: int = 6, seed: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for rows whose id is divisible by ``every``, the k nearest found by cosine."""
    spark = table.sparkSession
    rows, d = taking_part(table, id_col, vector_col)
    rows = rows.where("exists(v, x -> x != 0)")
    if not d:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    hashes = Rotations(d, tables, seed)
    width = 2 * hashes.size

    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.sqrt((x * x).sum(1))[:, None]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = np.zeros(tables * width, np.int64)
        for batch in batches:
            x = unit(matrix(batch, "v", d))
            for t in range(tables):
                data += np.bincount(t * width + hashes.bucket(hashes.rotate(x, t)), minlength=len(data))
        at = np.flatnonzero(data)
        yield pa.record_batch([pa.array(at), pa.array(data[at])], ["bucket", "n"])

    sizes = rows.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # tables x axes rows
    blocks = np.ones(tables * width, np.int64)
    for r in sizes:
        blocks[r["bucket"]] = max(1, -(-r["n"] // BLOCK))
    told = spark.sparkContext.broadcast((blocks, np.cumsum(blocks) - blocks))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, first = told.value
        for batch in batches:
            ids, x = batch.column("vec_id").to_numpy(), matrix(batch, "v", d)
            u, salt = unit(x), (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            q = np.flatnonzero(ids % every == 0)
            for t in range(tables):
                y = hashes.rotate(u, t)
                b = t * width + hashes.bucket(y)
                yield block_rows(first[b] + salt % blocks[b], 0, ids, x)
                if len(q):
                    p = t * width + hashes.probes(y[q], probes)
                    own, p = np.repeat(q, p.shape[1]), p.ravel()
                    for s in range(int(blocks[p].max())):
                        i = own[blocks[p] > s]
                        yield block_rows(first[p[blocks[p] > s]] + s, 1, ids[i], x[i])

    n = int(blocks.sum())
    most = tables * shards_for(table, 24_000_000)
    found = stash(top_k(solve_blocks(rows.mapInArrow(route, BLOCKS), min(n, most), d, k, _cosine, "double", _pair_cosine), k), "met")
    total = sum(r["n"] for r in sizes if r["bucket"] < width)
    met = found.groupBy("query_id").agg(F.count("*").alias("met"))
    asked = rows.where(F.col("vec_id") % every == 0)
    short = stash(asked.join(met, asked["vec_id"] == met["query_id"], "left").where(F.coalesce("met", F.lit(0)) < min(k, total - 1)).select("vec_id", "v"), "short")
    left = short.count()
    if not left:
        return found
    whole = top_k(solve_blocks(_all_pairs(rows, short, -(-total // BLOCK)), most, d, k, _cosine, "double", _pair_cosine), k)
    return found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(whole)


def _all_pairs(rows: DataFrame, queries: DataFrame, blocks: int) -> DataFrame:
    """Rows of BLOCKS in which every query meets every block of the rows."""

    def side(df: DataFrame, kind: int, block) -> DataFrame:
        return df.select(block.cast("int").alias("shard"), F.lit(kind).alias("kind"), "vec_id", "v")

    return side(rows, 0, F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).unionByName(side(queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), 1, F.col("block")))
