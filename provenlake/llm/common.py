"""What the operators of this subpackage share: the shared folder, blob exchanges, hashes over numpy arrays."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Multipliers of the 64-bit mixers (odd, from the golden ratio and the murmur finalisers).
MUL_A, MUL_B = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="provenlake-")
        shared_dir.own = found
    return found.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with tuned(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete stashed tables that nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(df.stash_path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


class tuned:
    """While it holds: Arrow batches stay small enough for very long texts, and shuffle files go when their query ends."""

    CONF = {
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
        "spark.sql.execution.arrow.maxBytesPerBatch": "33554432",
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    }

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        self.old = {k: self.spark.conf.get(k, None) for k in self.CONF}
        for k, v in self.CONF.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *exc):
        for k, v in self.old.items():
            self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)


def arrow_batches(spark: SparkSession) -> None:
    """Small Arrow batches for lazily returned frames: 1,024 rows and 32 MB, so that very long texts fit beside each other."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "33554432")


def est_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of df's plan, from file sizes: no job runs. Where it knows none, 2 KB a row."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 53 else 2000 * df.count()


def shards_for(df: DataFrame, bytes_per_shard: int = 12_000_000) -> int:
    """How many shards the exchanged statistics of df need so that each fits a task's memory: in proportion to df."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-est_bytes(df) // bytes_per_shard))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores; only a table of fewer partitions than cores, so a small one, is dealt out anew."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def utf8(col: pa.Array) -> list[bytes]:
    """A text column as UTF-8 bytes; null as empty."""
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def words_of(text: bytes) -> list[bytes]:
    r"""A-Z lower-cased, then words [^\x20\x09-\x0D]+: bytes.split() parts at just these six bytes."""
    return text.lower().split()


# -- caches of Python workers ---------------------------------------------------------------------------------------

_CACHES: dict[str, list] = {}


def cache_of(owner: str, cache):
    """Registers a cache (with clear()) as an operator's."""
    _CACHES.setdefault(owner, []).append(cache)
    return cache


def own_caches(owner: str) -> None:
    """Empties the caches of all other operators: workers are used again, and would hold those of every earlier stage."""
    for name, caches in _CACHES.items():
        if name != owner:
            for c in caches:
                c.clear()


# -- hashes ---------------------------------------------------------------------------------------------------------


def mix(a: np.ndarray, b) -> np.ndarray:
    """64-bit mix of two arrays."""
    x = a * MUL_A + b
    x ^= x >> U64(29)
    x *= MUL_B
    x ^= x >> U64(32)
    return x


class WordHashes(dict):
    """bytes -> 64-bit hash; a bounded cache over xxh64."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def grouped(ids: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal neighbours."""
    if not len(ids):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))


def spans(cut: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the runs that begin at cut, over n places."""
    ends = cut.tolist()[1:] + [n]
    return zip(cut.tolist(), ends[: len(cut)], strict=True)


# -- exchanges of packed arrays ---------------------------------------------------------------------------------------


def pack(a: np.ndarray) -> bytes:
    """An array's bytes, byte planes apart (sorted hashes and ids then compress well), by zstd."""
    import zstandard

    raw = np.ascontiguousarray(a)
    planes = raw.view(np.uint8).reshape(len(raw), -1).T if len(raw) else raw.view(np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    import zstandard

    dtype = np.dtype(dtype)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b, max_output_size=1 << 31), np.uint8)
    return np.ascontiguousarray(raw.reshape(dtype.itemsize, -1).T).view(dtype).ravel()


def shard_of(h: np.ndarray, n: int) -> np.ndarray:
    """Shard of a 64-bit hash by its high bits: shards are ranges of the hash."""
    return ((h >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def by_shard(h: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """(shard, slice) of a sorted hash array."""
    if len(h):
        s = shard_of(h, n)
        cut = grouped(s)
        for a, b in spans(cut, len(h)):
            yield int(s[a]), slice(a, b)


def dealt(df: DataFrame, n: int, key: str = "shard") -> DataFrame:
    """Rows by the number of their shard itself: hashed, a few shards would share a partition and others stay empty."""
    return df.repartitionById(n, F.coalesce(F.col(key), F.lit(0)))


def exchange(df: DataFrame, n: int, reduce: Callable, schema: str, key: str = "shard", partitions: int | None = None, deal: str | None = None) -> DataFrame:
    """Rows by shard: reduce(shard, rows) gets one shard's rows at a time as a pyarrow table and yields record batches. deal:
    the column that chooses the partition, where key itself is no small number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            k = batch.column(key).to_numpy(zero_copy_only=False)
            for a, b in spans(grouped(k), len(k)):
                if held and k[a] != at:
                    yield from reduce(at, pa.Table.from_batches(held))
                    held = []
                at = int(k[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from reduce(at, pa.Table.from_batches(held))

    return dealt(df, partitions or n, deal or key).sortWithinPartitions(key).mapInArrow(run, schema)


#: Counters in a slice of sum_counters.
SLICE = 1 << 16


def sum_counters(df: DataFrame, count: Callable, size: int, schema_cols: int = 1) -> list[np.ndarray]:
    """Sums of arrays of ``size`` counters over all tasks: count(batches) gives one task's arrays. Tasks' arrays are added up
    slice by slice in two rounds, so no task holds more than a few slices; the result is bounded by size."""
    rounds = 64

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        arrays = count(batches)
        group = TaskContext.get().partitionId() % rounds
        for k, a in enumerate(arrays):
            for i in range(0, size, SLICE):
                part = a[i : i + SLICE]
                if part.any():
                    yield pa.record_batch([pa.array([(k * (-(-size // SLICE)) + i // SLICE) * rounds + group], pa.int32()), pa.array([pack(part.astype(np.int64))], pa.binary())], ["shard", "a"])

    def fold(down: int):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, total = None, None
            for batch in batches:
                for shard, a in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if shard != at and at is not None:
                        yield pa.record_batch([pa.array([at // down], pa.int32()), pa.array([pack(total)], pa.binary())], ["shard", "a"])
                        total = None
                    at, x = shard, unpack(a, np.int64)
                    total = x.copy() if total is None else total + x
            if at is not None:
                yield pa.record_batch([pa.array([at // down], pa.int32()), pa.array([pack(total)], pa.binary())], ["shard", "a"])

        return run

    n = df.sparkSession.sparkContext.defaultParallelism
    rows = df.mapInArrow(first, "shard int, a binary")
    for down in (rounds, 1):
        rows = rows.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(fold(down), "shard int, a binary")
    out = [np.zeros(size, np.int64) for _ in range(schema_cols)]
    slices = -(-size // SLICE)
    for row in rows.collect():  # size counters for each array at most
        k, i = divmod(row["shard"], slices)
        part = unpack(bytes(row["a"]), np.int64)
        out[k][i * SLICE : i * SLICE + len(part)] = part
    return out


# -- texts to token ids -----------------------------------------------------------------------------------------------

#: White space beyond ASCII, and what some rules call white space and others do not.
_WIDE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class _Held:
    """Ids by 64-bit key: sorted keys, and where their ids lie in one array. Keys are hashes, so ranges of twice as many as there
    are keys hold one or none as a rule: a key is looked for from the start of its range."""

    def __init__(self, keys: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray):
        self.keys, self.starts, self.sizes, self.ids = keys, starts, sizes, ids
        self.first: np.ndarray | None = None

    @classmethod
    def none(cls) -> _Held:
        return cls(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys; -1 where there is none."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        bits = (2 * len(self.keys)).bit_length()
        shift = U64(64 - bits)
        if self.first is None:
            sizes = np.bincount((self.keys >> shift).astype(np.int64), minlength=1 << bits)
            self.first = np.concatenate([[0], np.cumsum(sizes)])
        own = (keys >> shift).astype(np.int64)
        at, end = self.first[own], self.first[own + 1]
        out = np.full(len(keys), -1, np.int64)
        left = np.flatnonzero(at < end)
        while len(left):
            here = at[left]
            hit = self.keys[here] == keys[left]
            out[left[hit]] = here[hit]
            at[left] += 1
            left = left[~hit & (here + 1 < end[left])]
        return out

    def get(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids one after another) of places."""
        n = self.sizes[at]
        return n, self.ids[np.repeat(self.starts[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]

    def joined(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> _Held:
        all_keys = np.concatenate([self.keys, keys])
        order = np.argsort(all_keys, kind="stable")
        starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        return _Held(all_keys[order], starts[order], np.concatenate([self.sizes, sizes])[order], np.concatenate([self.ids, ids]))


class ChunkCache:
    """Encodes whole texts by parting them where no token can cross, and remembering each chunk's ids.

    encode(list of str) -> list of bytes (ids, little-endian uint32) does the true work, for chunks that are not known. Texts
    are parted, over numpy arrays of their bytes: where white space begins, at the last of several white spaces if that is a
    space, after a single other white space, and before a mark that follows an ASCII letter or digit. Chunks are known by
    64-bit hashes. LIMIT chunks are held at most (those not met while half as many others came go), and none over LONG
    bytes: memory is bounded. Texts with white space that is not ASCII, or that hold one of ``added`` (strings that the library
    makes one token wherever they stand) in whatever case, are encoded whole and as they are.
    lower: the vocabulary has lower case only, so ASCII texts are lower-cased before (other letters are left to its rules).
    """

    LIMIT, LONG, SIZE = 1_000_000, 64, 1 << 22
    _END = 255  # a byte that UTF-8 does not have, between texts

    def __init__(self, encode: Callable[[list[str]], list[bytes]], lower: bool = False, added: list[str] | None = None):
        self.encode, self.lower = encode, lower
        self.added = re.compile("|".join(map(re.escape, added)), re.I) if added else None
        self.young, self.old = _Held.none(), _Held.none()
        r = np.random.default_rng(11)
        self.of_byte, self.of_place = (r.integers(0, 1 << 63, n, dtype=np.uint64) * U64(2) + U64(1) for n in (256, self.LONG + 1))
        kind = np.zeros(256, np.uint8)  # 1: white space, 2: ASCII letter or digit, 4: mark
        kind[[9, 10, 11, 12, 13, 32]] = 1
        kind[[i for i in range(128) if chr(i).isalnum()]] = 2
        kind[list(b".,;:!?$")] = 4
        self.kind = kind

    def _starts(self, raw: np.ndarray) -> np.ndarray:
        """Where chunks begin in texts that _END parts (before, between and after them)."""
        kind = self.kind[raw]
        space, end = kind == 1, raw == self._END
        begin = np.zeros(len(raw), bool)
        begin[1:] = end[:-1] | end[1:] | (space[1:] & ~space[:-1]) | ((kind[1:] == 4) & (kind[:-1] == 2))
        begin[1:-1] |= (raw[1:-1] == 32) & ~space[2:] & ~end[2:]
        begin[2:] |= ~space[2:] & space[1:-1] & (raw[1:-1] != 32) & ~space[:-2]
        begin[0] = True
        return np.flatnonzero(begin)

    def _keys(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        place = np.minimum(np.arange(len(raw)) - np.repeat(starts, sizes), self.LONG)
        return mix(np.add.reduceat(self.of_byte[raw] * self.of_place[place], starts), sizes.astype(np.uint64))

    def _learn(self, keys: np.ndarray, raw: bytes, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Makes the young ones hold keys (distinct), from the old ones or by encoding."""
        at = self.old.find(keys)
        known = at >= 0
        n, ids = self.old.get(at[known])
        own = np.flatnonzero(~known)
        new = self.encode([raw[a : a + k].decode() for a, k in zip(starts[own].tolist(), sizes[own].tolist(), strict=True)]) if len(own) else []
        n = np.concatenate([n, np.fromiter(map(len, new), np.int64, len(new)) // 4])
        if len(self.young.keys) + len(keys) > self.LIMIT // 2:
            self.old, self.young = self.young, _Held.none()
        self.young = self.young.joined(np.concatenate([keys[known], keys[own]]), n, np.concatenate([ids, np.frombuffer(b"".join(new), np.uint32)]))

    def _some(self, texts: list[bytes]) -> list[bytes]:
        mark = bytes([self._END])
        joined = mark + mark.join(texts) + mark
        raw = np.frombuffer(joined, np.uint8)
        starts = self._starts(raw)
        sizes = np.diff(np.append(starts, len(raw)))
        end = raw[starts] == self._END
        keys = np.concatenate([self._keys(raw[starts[a] : starts[b - 1] + sizes[b - 1]], starts[a:b] - starts[a], sizes[a:b]) for a, b in ((i, min(i + (1 << 16), len(starts))) for i in range(0, len(starts), 1 << 16))])
        at = np.where(end, 0, self.young.find(keys))
        long = (sizes > self.LONG) & ~end
        miss = np.flatnonzero((at < 0) & ~long)
        if len(miss):
            new, first = np.unique(keys[miss], return_index=True)
            # the known ones are met here too: they go with the new ones where the young ones grow old
            met, again = np.unique(at[(at >= 0) & ~end & ~long], return_index=False), len(self.young.keys) + len(new) > self.LIMIT // 2
            kept = self.young.keys[met] if again and len(met) else None
            self._learn(new, joined, starts[miss[first]], sizes[miss[first]])
            if kept is not None:
                lost = kept[self.young.find(kept) < 0]
                n, ids = self.old.get(self.old.find(lost))
                self.young = self.young.joined(lost, n, ids)
            at = np.where(end, 0, self.young.find(keys))
        held = self.young
        use = ~end & ~long
        n = np.zeros(len(starts), np.int64)
        n[use] = held.sizes[at[use]]
        apart: dict[int, np.ndarray] = {}
        where = np.flatnonzero(long)
        if len(where):
            for i, x in zip(where.tolist(), self.encode([joined[a : a + k].decode() for a, k in zip(starts[where].tolist(), sizes[where].tolist(), strict=True)]), strict=True):
                apart[i] = np.frombuffer(x, np.uint32)
                n[i] = len(apart[i])
        out = np.empty(int(n.sum()), np.uint32)
        before = np.cumsum(n) - n
        _, ids = held.get(at[use])
        if apart:
            out[np.repeat(use, n)] = ids
            for i, x in apart.items():
                out[before[i] : before[i] + n[i]] = x
        else:
            out = ids
        cut = np.append(before, len(out))[np.flatnonzero(end)].tolist()
        whole = out.astype("<u4", copy=False).tobytes()
        return [whole[4 * a : 4 * b] for a, b in zip(cut, cut[1:], strict=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        special = [i for i, x in enumerate(texts) if (self.added and "<" in x and self.added.search(x)) or _WIDE.search(x)]
        if special:
            for i, x in zip(special, self.encode([texts[i] for i in special]), strict=True):
                out[i] = x
        skip = set(special)
        held: list[int] = []
        parts: list[bytes] = []
        size = 0
        for i, x in enumerate(texts):
            if i not in skip:
                held.append(i)
                parts.append((x.lower() if self.lower and x.isascii() else x).encode())
                size += len(x)
            if held and (size >= self.SIZE or i + 1 == len(texts)):
                for k, y in zip(held, self._some(parts), strict=True):
                    out[k] = y
                held, parts, size = [], [], 0
        return out


_ENCODERS: dict = cache_of("encoders", {})


def library_encoder(path: str, mark: str) -> ChunkCache:
    """Ids by the tokenizers library from a vocabulary file; one per Python worker.

    Unknown chunks are encoded many at a time, joined by ``mark``: a string that the vocabulary's rules always make one
    token of its own. Chunks that hold a character of the mark, or white space within, are encoded by themselves.
    """
    own_caches("encoders")
    if path not in _ENCODERS:
        _ENCODERS.clear()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        added = [x.content for x in tok.get_added_tokens_decoder().values()]
        (mark_id,) = tok.encode(mark, add_special_tokens=False).ids
        sign = mark.strip() or mark

        def encode(chunks: list[str]) -> list[bytes]:
            out = [b""] * len(chunks)
            alone = [i for i, x in enumerate(chunks) if not x or sign in x or "<" in x or len(x.split()) != 1 or (x[0].isspace() and x[0] != " ") or x[-1].isspace()]
            for i, e in zip(alone, tok.encode_batch_fast([chunks[i] for i in alone], add_special_tokens=False), strict=True):
                out[i] = np.asarray(e.ids, "<u4").tobytes()
            skip = set(alone)
            plain = [i for i in range(len(chunks)) if i not in skip] if skip else list(range(len(chunks)))
            for a in range(0, len(plain), 2048):
                own = plain[a : a + 2048]
                ids = np.asarray(tok.encode_batch_fast([mark.join([chunks[i] for i in own])], add_special_tokens=False)[0].ids, "<u4")
                at = np.flatnonzero(ids == mark_id)
                if len(at) != len(own) - 1:
                    raise ValueError("the mark is no token of its own in this vocabulary")
                raw, starts, ends = ids.tobytes(), [0, *((at + 1) * 4).tolist()], [*(at * 4).tolist(), len(ids) * 4]
                for i, x, y in zip(own, starts, ends, strict=True):
                    out[i] = raw[x:y]
            return out

        lower = tok.encode("A B", add_special_tokens=False).ids == tok.encode("a b", add_special_tokens=False).ids
        _ENCODERS[path] = ChunkCache(encode, lower, added)
    return _ENCODERS[path]


def vocabulary(name: str) -> str:
    """A public vocabulary file's place."""
    import public_tokenizers

    return public_tokenizers.path(name)
