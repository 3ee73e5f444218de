"""Vector tables and blockwise search, shared by operators 5 and 8.

A row takes part when its vec_id is not null and its vector is not null, holds no null or non-finite component, and has the
table's dimension (that of most rows; of equally many, the greater). Rows that repeat a vec_id count once, with the least
vector. Columns besides the two are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenlake.llm.common import arrow_batches, dealt, grouped, spans, spread

#: Vectors in a block: what one task holds.
BLOCK = 8192


def taking_part(table: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id, v array<double>) of the rows that take part, and the dimension (0: no rows)."""
    arrow_batches(table.sparkSession)
    own = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    own = own.where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    sizes = own.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not sizes:
        return own, 0
    d = int(sizes[0]["d"])
    own = own.where(F.size("v") == d)
    if own.groupBy("vec_id").count().where("count > 1").limit(1).count():
        own = own.groupBy("vec_id").agg(F.min("v").alias("v"))
    return spread(own), d


def matrix(batch: pa.RecordBatch, name: str, d: int) -> np.ndarray:
    """A list column of d doubles each, as rows."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """For each row of scores, places of its k highest, ties to the smaller id: at least those (all that tie with the last
    are looked at, so none is lost)."""
    order = np.argsort(ids, kind="stable")
    s = scores[:, order]
    if s.shape[1] > k:
        # the k-th highest, then everything above it and the smallest ids among those that equal it
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        least = np.take_along_axis(s, top, 1).min(1)
        above = s > least[:, None]
        equal = s == least[:, None]
        room = k - above.sum(1)
        keep = above | (equal & (np.cumsum(equal, 1) <= room[:, None]))
        place = np.nonzero(keep)[1].reshape(len(s), k)
    else:
        place = np.tile(np.arange(s.shape[1]), (len(s), 1))
    return order[place]


def block_rows(shard: np.ndarray, kind: int, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    """Rows of BLOCKS."""
    return pa.record_batch([pa.array(shard.astype(np.int32)), pa.array(np.full(len(ids), kind, np.int32)), pa.array(ids), lists(x)], ["shard", "kind", "vec_id", "v"])


BLOCKS = "shard int, kind int, vec_id long, v array<double>"


def solve_blocks(rows: DataFrame, partitions: int, d: int, k: int, score: Callable[[np.ndarray, np.ndarray], np.ndarray], kind: str, exact: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Rows of BLOCKS (kind 0: data, 1: queries), one block in a shard: each query's k best within the block, itself left
    out: query_id, vec_id, score. A block's data come first and are held; its queries stream by, so that any number of them
    needs no copy of the data. exact(queries, vectors) scores pairs along the last axis, the same in whatever block they
    meet; products of whole matrices may differ in the last bit."""
    dtype = {"long": np.int64, "double": np.float64}[kind]

    def solved(ids: np.ndarray, x: np.ndarray, query: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        s = score(q, x)
        own = ids[None] == query[:, None]
        place = best(ids, np.where(own, -np.inf, s), min(k + 1, len(ids)))
        found = np.take_along_axis(s, place, 1) if exact is None else exact(q[:, None], x[place])
        keep = ~np.take_along_axis(own, place, 1)
        return pa.record_batch([pa.array(np.repeat(query, place.shape[1]).reshape(place.shape)[keep]), pa.array(ids[place[keep]]), pa.array(found[keep].astype(dtype))], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, ids, x = None, [], None, None
        for batch in batches:
            shard, which = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            for a, b in spans(grouped(shard.astype(np.int64) * 2 + which), len(batch)):
                part = batch.slice(a, b - a)
                if shard[a] != at:
                    at, held, ids = int(shard[a]), [], None
                own = part.column("vec_id").to_numpy(), matrix(part, "v", d)
                if which[a] == 0:
                    held.append(own)
                elif held:
                    if ids is None:
                        ids, x = (np.concatenate(y) for y in zip(*held, strict=True))
                    for i in range(0, b - a, 512):
                        yield solved(ids, x, own[0][i : i + 512], own[1][i : i + 512])

    return dealt(rows, partitions).sortWithinPartitions("shard", "kind").mapInArrow(run, f"query_id long, vec_id long, score {kind}")


def top_k(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query over all blocks, ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
