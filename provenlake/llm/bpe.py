"""Byte-level BPE encoding and decoding (operator 1): a segment tree over byte positions finds each merge.

Leaves are the byte positions of a piece. A live leaf holds the rank of the pair that starts there, and inner nodes hold
the leftmost least pair below them. A merge takes the root's pair, drops its right neighbour's leaf, and renews the leaves
of the merged symbol and of its live left neighbour: three point updates of logarithmic depth. Short pieces are merged side
by side as rows of numpy arrays; long ones by a scalar tree, so that one piece of n bytes takes n log n steps.

Nulls: a null text encodes as an empty one, a null doc_id stays null. Repeated rows, ties and extra columns: each row is
encoded by itself and extra columns are not read. Empty table: no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from provenlake.llm.common import ChunkCache, arrow_batches, spread

_NONE = np.iinfo(np.int64).max
#: Pieces of at most so many bytes are merged side by side.
SHORT = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank, from lines of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class ByteBPE:
    """Encoder and decoder for a table of ranks, pieces cut by a pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.findall = ranks, regex.compile(pattern).findall
        self.tokens = {r: t for t, r in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self.keys = np.fromiter(sorted(pairs), np.int64, len(pairs))
        self.values = np.fromiter((pairs[k] for k in self.keys.tolist()), np.int64, len(pairs))
        self.cache = ChunkCache(self._chunks)

    # -- one long piece

    def merge_long(self, piece: bytes) -> list[int]:
        n, pairs = len(piece), self.pairs
        size = 1 << max(1, (n - 1).bit_length())
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        big = 1 << 62
        tree = [big] * (2 * size)
        for i in range(n - 1):
            r = pairs.get(ids[i] << 32 | ids[i + 1])
            if r is not None:
                tree[size + i] = r << 30 | i
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(leaf: int, value: int) -> None:
            i = size + leaf
            tree[i] = value
            i >>= 1
            while i:
                tree[i] = min(tree[2 * i], tree[2 * i + 1])
                i >>= 1

        def pair(i: int) -> int:
            j = after[i]
            r = pairs.get(ids[i] << 32 | ids[j]) if j < n else None
            return big if r is None else r << 30 | i

        alive = [True] * n
        while (top := tree[1]) != big:
            i, rank = top & ((1 << 30) - 1), top >> 30
            j = after[i]
            ids[i], alive[j] = rank, False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            put(j, big)
            put(i, pair(i))
            if before[i] >= 0:
                put(before[i], pair(before[i]))
        return [x for x, a in zip(ids, alive, strict=True) if a]

    # -- many short pieces

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, or _NONE."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], _NONE) if len(self.keys) else np.full(len(key), _NONE)

    def merge_short(self, pieces: list[bytes]) -> list[bytes]:
        """Token ids (little-endian uint32) of pieces of 2 to SHORT bytes; rows are merged side by side."""
        out: list[bytes] = [b""] * len(pieces)
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        depth = np.maximum(np.ceil(np.log2(np.maximum(length, 2))).astype(np.int64), 1)
        for d in np.unique(depth):
            own = np.flatnonzero(depth == d)
            for a in range(0, len(own), 20_000):
                part = own[a : a + 20_000]
                for i, x in zip(part.tolist(), self._merge_rows([pieces[i] for i in part.tolist()], 1 << int(d)), strict=True):
                    out[i] = x
        return out

    def _merge_rows(self, pieces: list[bytes], size: int) -> list[bytes]:
        n = len(pieces)
        length = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(n, size)
        ids = self.byte_ids[raw]
        at = np.arange(size)
        alive = at[None] < length[:, None]
        after = np.tile(np.arange(1, size + 1), (n, 1))
        before = np.tile(np.arange(-1, size), (n, 1))  # one column more, for the end
        leaf = self._rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, size - 1)
        leaf = np.where((leaf != _NONE) & (at[None, 1:] < length[:, None]), leaf << 8 | at[None, :-1], _NONE)
        tree = np.full((n, 2 * size), _NONE)
        tree[:, size : 2 * size - 1] = leaf
        width = size // 2
        while width:
            tree[:, width : 2 * width] = np.minimum(tree[:, 2 * width : 4 * width : 2], tree[:, 2 * width + 1 : 4 * width : 2])
            width //= 2
        rows = np.flatnonzero(tree[:, 1] != _NONE)
        while len(rows):
            top = tree[rows, 1]
            i, rank = top & 255, top >> 8
            j = after[rows, i]
            k = after[rows, j]
            ids[rows, i] = rank
            alive[rows, j] = False
            after[rows, i] = k
            before[rows, k] = i
            h = before[rows, i]
            ends = k >= length[rows]
            right = self._rank(rank, ids[rows, np.where(ends, 0, k)])
            right = np.where(ends | (right == _NONE), _NONE, right << 8 | i)
            left = self._rank(ids[rows, np.maximum(h, 0)], rank)
            left = np.where((h < 0) | (left == _NONE), _NONE, left << 8 | h)
            tree[rows, size + j] = _NONE
            tree[rows, size + i] = right
            some = h >= 0
            tree[rows[some], size + h[some]] = left[some]
            nodes = [size + j, size + i, size + np.where(some, h, i)]
            while nodes[0][0] > 1:
                nodes = [x >> 1 for x in nodes]
                for x in nodes:
                    tree[rows, x] = np.minimum(tree[rows, 2 * x], tree[rows, 2 * x + 1])
            rows = rows[tree[rows, 1] != _NONE]
        flat = ids[alive].astype("<u4").tobytes()
        ends = np.cumsum(alive.sum(1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece: a whole token, or merged."""
        out = [b""] * len(pieces)
        short = []
        for i, p in enumerate(pieces):
            if (r := self.ranks.get(p)) is not None:
                out[i] = r.to_bytes(4, "little")
            elif len(p) <= SHORT:
                short.append(i)
            else:
                out[i] = np.array(self.merge_long(p), "<u4").tobytes()
        for i, x in zip(short, self.merge_short([pieces[i] for i in short]), strict=True):
            out[i] = x
        return out

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        parts = [self.findall(c) for c in chunks]
        distinct = list({p for x in parts for p in x})
        ids = dict(zip(distinct, self.pieces([p.encode() for p in distinct]), strict=True))
        return [b"".join([ids[p] for p in x]) for x in parts]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian uint32."""
        return self.cache(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[tuple[str, str], ByteBPE] = {}


def codec(path: str, pattern: str) -> ByteBPE:
    """One codec per Python worker."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = ByteBPE(read_ranks(path), pattern)
    return _CODECS[path, pattern]


def encode_column(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, ids (binary, little-endian uint32), decoded (binary). Map-side only: no shuffle."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            ids = bpe.encode([x or "" for x in batch.column(1).to_pylist()])
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.binary())], ["id", "ids", "decoded"])

    return spread(docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, ids binary, decoded binary")


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode_column's ids and of the bytes decoded from them."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            n, a, b = [], [], []
            for ids in bpe.encode([x or "" for x in batch.column(1).to_pylist()]):
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return spread(docs.select("doc_id", docs["text"].cast("string").alias("text"))).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
