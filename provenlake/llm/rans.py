"""Token ids as files of a static range asymmetric numeral system (operator 9).

One frequency table, counted over all ids, is shared by every block. A block holds the ids of some whole documents, is coded
by itself in interleaved lanes (token i in lane i mod lanes), and carries its documents' ids and lengths, its lanes' states,
checkpoints (states and word position every CHECKPOINT steps, from which decoding can start) and checksums. Blocks lie in
ascending doc_id order, one row each (bucket, block, payload) of a Parquet table, so that any store that Spark writes to
holds them and a lost task is simply run again.

States are 64-bit in [2^31, 2^63), renormalised by 32-bit words; frequencies sum to 2^20. numpy codes one step of all lanes
at a time. Nulls: a null text has the end id alone; a null doc_id comes first. Rows that repeat a doc_id are documents of
their own, ordered by length and checksum. An empty table makes no blocks. Extra columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenlake.llm.common import U64, arrow_batches, discard, exchange, library_encoder, pack, shards_for, shared_dir, spread, stash, tuned, unpack

SCALE = 20
LOW = U64(1 << 31)
MAGIC = b"rANSids1"
CHECKPOINT = 256
#: Ids in a block, about; a longer document has a block of its own.
BLOCK = 1 << 19
#: The bit of a document's length that says that it has no doc_id; lengths are below it.
_NULL, _LENGTH = 1 << 31, (1 << 31) - 1


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to sum 2^SCALE; each id that occurs keeps at least 1."""
    total, seen = int(counts.sum()), counts > 0
    out = np.zeros(len(counts), np.int64)
    if not total:
        return out
    if int(seen.sum()) > 1 << SCALE:
        raise ValueError("more distinct ids than slots")
    out[seen] = np.maximum(1, counts[seen].astype(np.float64) / total * (1 << SCALE)).astype(np.int64)
    over = int(out.sum()) - (1 << SCALE)
    order = np.argsort(-out, kind="stable")
    at = 0
    while over:
        i = order[at % len(order)]
        if over < 0:
            step = max(1, -over // 64)
            out[i] += step
            over += step
        elif out[i] > 1:
            step = min(int(out[i]) - 1, max(1, over // 64), over)
            out[i] -= step
            over -= step
        at += 1
    return out


class Table:
    """A shared frequency table: 2^SCALE slots."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


def lanes_for(n: int) -> int:
    return 1 << max(0, min(10, (n // 256).bit_length()))


def encode(ids: np.ndarray, table: Table) -> tuple[int, np.ndarray, np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """(lanes, words, states, checkpoints (step, words before it, states)) of ids."""
    n, lanes = len(ids), lanes_for(len(ids))
    steps = -(-n // lanes)
    freq, start = table.freq[ids], table.start[ids]
    limit = freq << U64(63 - SCALE)
    x = np.full(lanes, LOW)
    words, marks, out = [], [], 0
    for t in range(steps - 1, -1, -1):
        own = slice(t * lanes, min(n, (t + 1) * lanes))
        f, v = freq[own], x[: own.stop - own.start]
        full = v >= limit[own]
        if full.any():
            w = (v[full] & U64(0xFFFFFFFF)).astype(np.uint32)
            words.append(w)
            out += len(w)
            v = np.where(full, v >> U64(32), v)
        q = v // f
        x[: own.stop - own.start] = (q << U64(SCALE)) + (v - q * f) + start[own]
        if t and t % CHECKPOINT == 0:
            marks.append((t, out, x.copy()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    return lanes, stream, x, [(t, out - k, s) for t, k, s in reversed(marks)]


def decode(n: int, lanes: int, words: np.ndarray, states: np.ndarray, table: Table, step: int = 0, at: int = 0) -> np.ndarray:
    """Ids from a step on; step, at and states are the block's beginning or one of its checkpoints."""
    steps = -(-n // lanes)
    ids = np.empty(n - step * lanes, np.uint32)
    x, mask = states.astype(np.uint64).copy(), U64((1 << SCALE) - 1)
    for t in range(step, steps):
        size = min(n - t * lanes, lanes)
        v = x[:size]
        slot = v & mask
        s = table.slots[slot]
        ids[(t - step) * lanes : (t - step) * lanes + size] = s
        v = table.freq[s] * (v >> U64(SCALE)) + slot - table.start[s]
        low = np.flatnonzero(v < LOW)
        if len(low):
            v[low] = v[low] << U64(32) | words[at : at + len(low)]
            at += len(low)
        x[:size] = v
    return ids


def to_block(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, table: Table) -> bytes:
    """One block: header, documents, states, checkpoints, words; each part under the checksum in front of it all."""
    lanes, words, states, marks = encode(ids, table)
    docs = pack(doc_ids.astype("<i8")) if len(doc_ids) else b""
    lens = pack(lengths.astype("<u4")) if len(lengths) else b""
    body = b"".join(
        [
            struct.pack("<QIIIIII", len(ids), lanes, len(words), len(marks), len(docs), len(lens), zlib.crc32(ids.astype("<u4").tobytes())),
            docs,
            lens,
            states.astype("<u8").tobytes(),
            *(struct.pack("<QQ", t, k) + s.astype("<u8").tobytes() for t, k, s in marks),
            words.astype("<u4").tobytes(),
        ]
    )
    return MAGIC + struct.pack("<I", zlib.crc32(body)) + body


def from_block(payload: bytes, table: Table, checkpoint: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids) of a block; with checkpoint k, ids from that checkpoint on. Checksums are verified."""
    if payload[:8] != MAGIC or zlib.crc32(body := payload[12:]) != struct.unpack("<I", payload[8:12])[0]:
        raise ValueError("a block is damaged")
    n, lanes, n_words, n_marks, n_docs, n_lens, crc = struct.unpack_from("<QIIIIII", body)
    at = struct.calcsize("<QIIIIII")
    doc_ids = unpack(body[at : at + n_docs], "<i8") if n_docs else np.zeros(0, np.int64)
    lengths = unpack(body[at + n_docs : at + n_docs + n_lens], "<u4") if n_lens else np.zeros(0, np.uint32)
    at += n_docs + n_lens
    states, step, word = np.frombuffer(body, "<u8", lanes, at), 0, 0
    at += 8 * lanes
    if checkpoint is not None:
        place = at + checkpoint * (16 + 8 * lanes)
        step, word = struct.unpack_from("<QQ", body, place)
        states = np.frombuffer(body, "<u8", lanes, place + 16)
    at += n_marks * (16 + 8 * lanes)
    ids = decode(n, lanes, np.frombuffer(body, "<u4", n_words, at), states, table, step, word)
    if checkpoint is None and zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("decoded ids do not match their checksum")
    return doc_ids, lengths, ids


# -- tables -----------------------------------------------------------------------------------------------------------


def _packed(ids: np.ndarray) -> bytes:
    """Ids in two bytes each where that is enough, after a byte that says so."""
    short = not len(ids) or int(ids.max()) < 1 << 16
    return (b"2" if short else b"4") + pack(ids.astype("<u2" if short else "<u4"))


def _unpacked(b: bytes) -> np.ndarray:
    return unpack(b[1:], "<u2" if b[:1] == b"2" else "<u4")


_RAW = "bucket int, block int, n long, docs binary, lengths binary, ids binary"


def ordered_ids(docs: DataFrame, tokenizer: str, end_id: int, with_space: bool = False) -> DataFrame:
    """Whole texts as ids in ascending doc_id order: one row for each block to be. Bounds of the buckets come from a
    quantile sketch over doc_id, so that no sort samples the tokenised rows.
    """
    buckets = shards_for(docs, 6_000_000)
    bounds = docs.select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", [i / buckets for i in range(1, buckets)], 0.1 / buckets) if buckets > 1 else []
    cuts = np.array(sorted(set(bounds)), np.float64)
    end = np.array([end_id], "<u4").tobytes()

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = library_encoder(tokenizer, "\n" if with_space else " 0 ")
        for batch in batches:
            ids = [np.frombuffer(x + end, "<u4") for x in enc([x or "" for x in batch.column(1).to_pylist()])]
            own = np.array([-(1 << 63) if x is None else x for x in batch.column(0).to_pylist()], np.int64)
            sizes = np.array([len(x) for x in ids], np.uint32) | np.where(batch.column(0).is_null().to_numpy(zero_copy_only=False), _NULL, 0).astype(np.uint32)
            bucket = np.searchsorted(cuts, own.astype(np.float64), "right")
            order = np.argsort(bucket, kind="stable")
            rows: list[list] = [[], [], [], []]
            for b in np.unique(bucket):
                part = order[bucket[order] == b]
                for col, x in zip(rows, (int(b), pack(own[part]), pack(sizes[part]), _packed(np.concatenate([ids[i] for i in part]))), strict=True):
                    col.append(x)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "docs", "lengths", "ids"])

    def order(bucket: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        own = np.concatenate([unpack(x, "<i8") for x in rows["docs"].to_pylist()])
        n = np.concatenate([unpack(x, "<u4") for x in rows["lengths"].to_pylist()]).astype(np.int64)
        none, n = n >> 31, n & _LENGTH
        flat = np.concatenate([_unpacked(x) for x in rows["ids"].to_pylist()])
        ends = np.cumsum(n)
        crc = np.zeros(len(n), np.uint32)
        again = np.isin(own, own[np.sort(own).searchsorted(own, "right") - np.sort(own).searchsorted(own) > 1]) if len(np.unique(own)) < len(own) else np.zeros(len(own), bool)
        for i in np.flatnonzero(again):
            crc[i] = zlib.crc32(flat[ends[i] - n[i] : ends[i]].tobytes())
        rank = np.lexsort((crc, n, own, 1 - none))
        block = (np.cumsum(n[rank]) - n[rank]) // BLOCK
        for b in np.unique(block):
            part = rank[block == b]
            ids = np.concatenate([flat[ends[i] - n[i] : ends[i]] for i in part])
            yield pa.record_batch([pa.array([bucket], pa.int32()), pa.array([int(b)], pa.int32()), pa.array([len(ids)], pa.int64()), *(pa.array([x], pa.binary()) for x in (pack(own[part]), pack((n[part] | none[part] << 31).astype(np.uint32)), _packed(ids)))], ["bucket", "block", "n", "docs", "lengths", "ids"])

    arrow_batches(docs.sparkSession)
    read = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")))
    return exchange(read.mapInArrow(tokenise, "bucket int, docs binary, lengths binary, ids binary"), buckets, order, _RAW, "bucket")


def id_counts(raw: DataFrame) -> np.ndarray:
    """How often each id occurs, over all blocks. The result has a row for each id of the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                c = np.bincount(_unpacked(x))
                if len(c) > len(total):
                    total, c = c.astype(np.int64), total
                total[: len(c)] += c
        own = np.flatnonzero(total)
        yield pa.record_batch([pa.array(own, pa.int64()), pa.array(total[own], pa.int64())], ["id", "n"])

    found = raw.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids = found["id"].to_numpy()
    out = np.zeros(int(ids.max(initial=-1)) + 1, np.int64)
    out[ids] = found["n"].to_numpy()
    return out


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, with_space: bool = False) -> Table:
    """Tokenise docs and write block files and their table under path."""
    spark = docs.sparkSession
    raw = stash(ordered_ids(docs, tokenizer, end_id, with_space), "ids")
    freq = scaled(id_counts(raw))
    shared = spark.sparkContext.broadcast(freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(shared.value)
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pydict()
                block = to_block(unpack(row["docs"][0], "<i8"), unpack(row["lengths"][0], "<u4"), _unpacked(row["ids"][0]), table)
                yield pa.record_batch([pa.array(row["bucket"], pa.int32()), pa.array(row["block"], pa.int32()), pa.array(row["n"], pa.int64()), pa.array([block], pa.binary())], ["bucket", "block", "n", "payload"])

    with tuned(spark):
        spark.createDataFrame([(int(i), int(f)) for i, f in enumerate(freq.tolist()) if f], "id long, freq long").coalesce(1).write.parquet(f"{path}/table")
        raw.mapInArrow(run, "bucket int, block int, n long, payload binary").write.option("compression", "none").parquet(f"{path}/blocks")
    discard(raw)
    return Table(freq)


def read_table(spark, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/table").toArrow()  # bounded by the vocabulary
    ids = rows["id"].to_numpy()
    freq = np.zeros(int(ids.max(initial=-1)) + 1, np.int64)
    freq[ids] = rows["freq"].to_numpy()
    return freq


def read_ids(spark, path: str, with_ids: bool = True) -> DataFrame:
    """Documents of block files: doc_id, start (ids before it), n_tokens, ids_crc32 and, with_ids, the ids themselves (binary,
    little-endian uint32)."""
    shared = spark.sparkContext.broadcast(read_table(spark, path))
    blocks = spark.read.parquet(f"{path}/blocks")
    by_bucket = blocks.groupBy("bucket").agg(F.sum("n").alias("n"))
    first = by_bucket.select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    base = blocks.select("bucket", "block", F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("own")).join(first, "bucket").select("bucket", "block", (F.col("first") + F.col("own")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(shared.value)
        for batch in batches:
            for bucket, block, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own, n, ids = from_block(payload, table)
                none, n = n >> np.uint32(31), n & np.uint32(_LENGTH)
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum(n.astype(np.int64))
                for a in range(0, len(own), 1024):
                    part = slice(a, a + 1024)
                    texts = [raw[4 * (e - k) : 4 * e] for e, k in zip(ends[part].tolist(), n[part].tolist(), strict=True)]
                    k = len(texts)
                    yield pa.record_batch(
                        [pa.array([bucket] * k, pa.int32()), pa.array([block] * k, pa.int32()), pa.array(own[part], pa.int64(), mask=none[part].astype(bool)), pa.array(ends[part] - n[part], pa.int64()), pa.array(n[part].astype(np.int64)), pa.array([zlib.crc32(x) for x in texts], pa.int64()), *([pa.array(texts, pa.binary())] if with_ids else [])],
                        ["bucket", "block", "doc_id", "at", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])],
                    )

    read = blocks.select("bucket", "block", "payload").mapInArrow(run, "bucket int, block int, doc_id long, at long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))
    return read.join(base, ["bucket", "block"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write docs and read them back: doc_id, start, n_tokens, ids_crc32 as the files have them."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/rans-{uuid.uuid4().hex}"
    write_ids(docs, path, tokenizer, end_id)
    return stash(read_ids(spark, path, with_ids=False), "rans-read")
