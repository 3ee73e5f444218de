"""Best-fit packing of documents into sequences (operator 3), large items first.

Only the histogram of piece lengths decides a packing, and it has at most ``capacity`` lengths whatever the corpus is. So
Spark tokenises and counts, the driver packs *classes* of equal bins over that histogram, and Spark deals the pieces of a
length out to the bins by their rank among the pieces of that length.

Packing: pieces over a third of the capacity go at most two to a bin, matched greedily, the largest with the largest that
fits beside it; smaller ones, longest first, go where they leave least room; new bins open only when none has room.

Nulls: a null text is an empty document (its end mark alone is packed). Repeated rows are documents of their own. An empty
table packs into nothing. Extra columns are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenlake.llm.common import arrow_batches, library_encoder, spread, stash

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones at the end, the rest first."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, ids: bool = False) -> DataFrame:
    """Tokenise whole texts, append end_id, cut. Map-side only; with ids=True the pieces' ids come along as binary."""
    arrow_batches(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_encoder(tokenizer, mark="\n")
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for doc, raw in zip(batch.column(0).to_pylist(), encode([x or "" for x in batch.column(1).to_pylist()]), strict=True):
                raw += end
                for k, (s, n) in enumerate(cut(len(raw) // 4, capacity)):
                    part = raw[4 * s : 4 * (s + n)]
                    for col, x in zip(rows, (doc, k, s, n, zlib.crc32(part), part if ids else None), strict=True):
                        col.append(x)
            cols = [pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.record_batch(cols if ids else cols[:5], names if ids else names[:5])

    return spread(docs.select("doc_id", docs["text"].cast("string").alias("text"))).mapInArrow(run, PIECES + (", ids binary" if ids else ""))


def plan(counts: dict[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int, int, int]]], int]:
    """Packs counts[length] pieces of each length. Gives, per length, runs (first rank, pieces, first bin, offset, per bin),
    and the number of bins. Work and result are bounded by the number of lengths, not by the number of pieces.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    third = capacity / 3
    next_bin, taken = 0, dict.fromkeys(left, 0)
    runs: dict[int, list[tuple[int, int, int, int, int]]] = {n: [] for n in left}
    rooms: dict[int, list[tuple[int, int]]] = {}  # room -> [(first bin, bins)]

    def put(n: int, pieces: int, first_bin: int, offset: int, per_bin: int = 1) -> None:
        runs[n].append((taken[n], pieces, first_bin, offset, per_bin))
        taken[n] += pieces
        left[n] -= pieces

    def room(size: int, first_bin: int, bins: int) -> None:
        if bins > 0:
            rooms.setdefault(size, []).append((first_bin, bins))

    large = sorted((n for n in left if n > third), reverse=True)
    for n in large:
        for m in (m for m in large if m <= n and n + m <= capacity):
            k = left[n] // 2 if m == n else min(left[n], left[m])
            if k:
                put(n, k, next_bin, 0)
                put(m, k, next_bin, n)
                room(capacity - n - m, next_bin, k)
                next_bin += k
            if not left[n]:
                break
        if k := left[n]:
            put(n, k, next_bin, 0)
            room(capacity - n, next_bin, k)
            next_bin += k
    for n in sorted((n for n in left if n <= third), reverse=True):
        order = sorted(s for s in rooms if rooms[s])
        while left[n]:
            at = bisect.bisect_left(order, n)
            while at < len(order) and not rooms[order[at]]:
                order.pop(at)
            if at == len(order):
                per = capacity // n
                bins, rest = divmod(left[n], per)
                if bins:
                    put(n, bins * per, next_bin, 0, per)
                    room(capacity - per * n, next_bin, bins)
                    next_bin += bins
                if rest:
                    put(n, rest, next_bin, 0, rest)
                    room(capacity - rest * n, next_bin, 1)
                    next_bin += 1
                break
            size = order[at]
            first, bins = rooms[size].pop()
            per = size // n
            used = min(bins, left[n] // per)
            if used:
                put(n, used * per, first, capacity - size, per)
                room(size - per * n, first, used)
            if used < bins:
                rest = left[n]
                if rest and rest < per:
                    put(n, rest, first + used, capacity - size, rest)
                    room(size - rest * n, first + used, 1)
                    room(size, first + used + 1, bins - used - 1)
                else:
                    room(size, first + used, bins - used)
    return runs, next_bin


def ranked(pieces: DataFrame, salts: int) -> DataFrame:
    """Adds rank: 0, 1, ... among the pieces of a length. A length that holds many pieces is dealt over ``salts`` groups;
    the groups' sizes, at most lengths x salts rows, give each group its first rank.
    """
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    sums = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    first = sums.withColumn("first", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("length", "salt", F.coalesce("first", F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return salted.withColumn("own", F.row_number().over(own) - 1).join(first, ["length", "salt"]).withColumn("rank", F.col("first") + F.col("own")).drop("own", "first", "salt")


def pack_pieces(pieces: DataFrame, capacity: int, salts: int = 256) -> DataFrame:
    """Adds sequence_id and offset to pieces (a stashed table: it is read twice)."""
    spark = pieces.sparkSession
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    runs, _ = plan(counts, capacity)
    flat = [(n, *run) for n, own in runs.items() for run in own]
    table = np.array(sorted(flat), np.int64).reshape(-1, 6)
    packed = spark.sparkContext.broadcast(table)  # at most a few rows for each pair of lengths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = packed.value
        lengths, starts = np.unique(t[:, 0], return_index=True)
        ends = np.append(starts[1:], len(t))
        for batch in batches:
            n, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = np.zeros(len(n), np.int64)
            for length in np.unique(n):
                at = np.searchsorted(lengths, length)
                own = n == length
                part = t[starts[at] : ends[at]]
                row[own] = starts[at] + np.searchsorted(part[:, 1], rank[own], "right") - 1
            _, first, _, first_bin, offset, per = t[row].T
            k = rank - first
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.record_batch([*(batch.column(x) for x in names), pa.array(first_bin + k // per), pa.array(offset + k % per * n)], [*names, "sequence_id", "offset"])

    out = ranked(pieces, salts).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return out.mapInArrow(run, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, salts: int = 256) -> DataFrame:
    """All documents packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_pieces(stash(pieces_of(docs, tokenizer, capacity, end_id), "pieces"), capacity, salts)
