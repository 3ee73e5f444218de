"""Interpolated modified Kneser-Ney language model (operator 7) of any order from 2, counted in Spark.

p_k(w | x v) = max(c(x v w) - D(c(x v w)), 0) / c(x v .) + gamma(x v) * p_k-1(w | v),  x v: the k - 1 tokens before w
gamma(x v)   = (D1 N1(x v .) + D2 N2(x v .) + D3 N3+(x v .)) / c(x v .)
p_1(w)       = max(c(w) - D(c(w)), 0) / c(.) + gamma / (V + 1),  V: distinct tokens

c counts occurrences in the highest order, and in those below it the distinct words before; discounts D1, D2, D3+ per order are
from the counts of counts (Chen and Goodman). An unseen context leaves p_k-1; an unseen word has gamma / (V + 1). A text's
context begins with marks of their own, and its end is a token.

Counting: tasks send each shard (a range of the hash) sorted arrays of their distinct words and n-grams with counts; a frequent
n-gram is one entry of a task, and a frequent context is spread over the shards of its n-grams. Shards are merged, and written
as sorted hash arrays to the shared folder, values as numbers of rows in a small table; contexts and the n-grams of the order
below are summed in the next round. Workers map those files into memory, ``MOST`` shards of a kind at a time, and look up a
batch's distinct n-grams in order. Files are written beside their place and renamed, so that tasks can be run again. Words are
64-bit hashes for base counts, 48-bit ones within n-grams; n-grams are known by 64-bit hashes.

Nulls: a null text is the end token alone; a null doc_id counts as id text "". Repeated rows count as often as they occur.
Extra columns are not read. Without training texts N = V = 0 and the model is uniform over the unknown. Empty table: no rows.
Very long texts: a text's tokens are one array. A model file that is missing is an error.
"""

from __future__ import annotations

import io
import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenlake.llm.common import U64, WordHashes, arrow_batches, by_shard, cache_of, discard, exchange, grouped, mix, pack, shards_for, shared_dir, spread, stash, unpack, words_of

FOLDS, HELD = 7, 2
#: Contexts and ends of texts, as words that no text has (they hold spaces).
BEGIN, END = b"< begin >", b"< end >"
SHORT = U64(16)  # bits dropped from a word's hash within n-grams
MOST = 2048  # shards of a kind that a worker maps at once
_WORDS = cache_of("kneser_ney", WordHashes())
_WORDS.LIMIT = 400_000  # beside the arrays of a flush

# -- files in the shared folder -------------------------------------------------------------------------------------------


def _local(path: str) -> str | None:
    """A shared folder's place in the file system, if it is mounted there. Paths are whole URIs: see qualified."""
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else None


def qualified(spark, path: str) -> str:
    """path with the scheme of its file system: a path without one belongs to Spark's default one, mounted or not."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def save(path: str, **arrays: np.ndarray) -> None:
    """Arrays as path.name.npy; written beside and renamed."""
    for name, a in arrays.items():
        own = f"{path}.{name}.npy"
        if (place := _local(own)) is not None:
            os.makedirs(os.path.dirname(place), exist_ok=True)
            with open(part := f"{place}.{uuid.uuid4().hex}", "wb") as f:
                np.save(f, a)
            os.replace(part, place)
        else:
            from pyarrow import fs

            store, where = fs.FileSystem.from_uri(own)
            held = io.BytesIO()
            np.save(held, a)
            with store.open_output_stream(where) as f:
                f.write(held.getvalue())


def mapped(path: str, name: str) -> np.ndarray:
    """A saved array, memory-mapped; from other stores by way of a file that is unlinked once it is mapped."""
    own = f"{path}.{name}.npy"
    if (place := _local(own)) is not None:
        return np.load(place, mmap_mode="r")
    import tempfile

    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(own)
    with tempfile.NamedTemporaryFile(suffix=".npy") as f:
        with store.open_input_stream(where) as source:
            while block := source.read(1 << 24):
                f.write(block)
        f.flush()
        return np.load(f.name, mmap_mode="r")


# -- counting -------------------------------------------------------------------------------------------------------------

WORD, GRAM, CONTEXT, SUMS = range(4)
_BLOBS = "shard int, kind int, a binary, b binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.record_batch([pa.array(list(c), t) for c, t in zip(cols, [pa.int32()] * 2 + [pa.binary()] * 2, strict=True)], ["shard", "kind", "a", "b"])


def summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of their values."""
    if not len(key):
        return key, *values
    order = np.argsort(key, kind="stable")
    key = key[order]
    cut = grouped(key)
    return key[cut], *(np.add.reduceat(v[order], cut) for v in values)


def is_held(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens, an end after each text; tokens in each text)."""
    parts = [words_of(x) for x in texts]
    n = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    return _WORDS.array([w for x in parts for w in (*x, END)]), n


def contexts(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The token before each, the beginning before the first."""
    v = np.empty_like(h)
    v[1:] = h[:-1]
    v[np.cumsum(n) - n] = U64(_WORDS[BEGIN])
    return v


def grams(h: np.ndarray, n: np.ndarray, order: int) -> np.ndarray:
    """A row for each token: the order - 1 tokens before it and itself, as 48-bit hashes."""
    cols = [h]
    for _ in range(order - 1):
        cols.append(contexts(cols[-1], n))
    return np.stack(cols[::-1], 1) >> SHORT


def gram_key(rows: np.ndarray) -> np.ndarray:
    """64-bit keys of n-grams (rows), spread over all the shards."""
    if rows.shape[1] == 1:
        return rows[:, 0] << SHORT
    key = rows[:, 0]
    for i in range(1, rows.shape[1]):
        key = mix(key, rows[:, i])
    return key


def counted(rows: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys in order, n-grams, their counts) of n-grams that may repeat."""
    key = gram_key(rows)
    order = np.argsort(key, kind="stable")
    key = key[order]
    cut = grouped(key)
    total = np.diff(np.append(cut, len(key))) if count is None else np.add.reduceat(count[order], cut) if len(cut) else count
    return key[cut], rows[order[cut]], total


def _sent(kind: int, key: np.ndarray, rows: np.ndarray, values: np.ndarray, n_shards: int) -> Iterator[tuple]:
    """Blobs of n-grams and their values by shard; in the order of their words, which packs better."""
    for shard, own in by_shard(key, n_shards):
        part = rows[own]
        inner = np.lexsort(part.T[::-1])
        yield shard, kind, pack(part[inner].T.ravel()), pack(values[own][inner])


def _count(n_shards: int, flush: int, order: int):
    def emit(h: list[np.ndarray], g: list[np.ndarray]) -> pa.RecordBatch:
        h = np.concatenate(h)
        word, count = summed(h, np.ones(len(h), np.int64))
        rows = [(shard, WORD, pack(word[own]), pack(count[own])) for shard, own in by_shard(word, n_shards)]
        return _rows([*rows, *_sent(GRAM, *counted(np.concatenate(g)), n_shards)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs: list[np.ndarray] = []
        gs: list[np.ndarray] = []
        size = 0
        for batch in batches:
            texts = [t or b"" for d, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True) if not is_held(d)]
            if texts:
                h, n = tokens(texts)
                hs.append(h)
                gs.append(grams(h, n, order))
                size += len(h)
            if size >= flush:
                yield emit(hs, gs)
                hs, gs, size = [], [], 0
        if hs:
            yield emit(hs, gs)

    return run


def _save_values(path: str, key: np.ndarray, values: np.ndarray) -> None:
    """Sorted keys, and for each the number of its value's row in a table of the distinct values."""
    mark = values if values.ndim == 1 else mix(mix(mix(values[:, 0].astype(np.uint64), values[:, 1].astype(np.uint64)), values[:, 2].astype(np.uint64)), values[:, 3].astype(np.uint64))
    _, first, code = np.unique(mark, return_index=True, return_inverse=True)
    save(path, hash=key, code=code.astype(np.uint8 if len(first) <= 1 << 8 else np.uint16 if len(first) <= 1 << 16 else np.uint32), table=values[first])


def _merge(path: str, n_shards: int, level: int, first: bool):
    """A round: n-grams of this level, contexts of the level above and words go to files; this level's contexts and the
    n-grams below go on, and the sums of each level by shard."""

    def reduce(shard: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        kinds, a, b = rows["kind"].to_pylist(), rows["a"].to_pylist(), rows["b"].to_pylist()

        def read(kind: int, width: int, values: int) -> tuple[np.ndarray, np.ndarray]:
            own = [i for i, k in enumerate(kinds) if k == kind]
            return tuple(np.concatenate([np.zeros((0, w), t), *(unpack(x[i], t).reshape(w, -1).T for i in own)]) for x, w, t in ((a, width, np.uint64), (b, values, np.int64)))

        out = [(shard, SUMS, a[i], None) for i, k in enumerate(kinds) if k == SUMS]
        sums = [level, 0, 0]
        if not first:  # later rounds have contexts where the first has words
            key, n, *kind = summed(*(x for y in read(CONTEXT, 1, 4) for x in y.T))
            _save_values(f"{path}/context{level + 1}-{shard:06d}", key, np.stack([n, *kind], 1))
        else:
            word, count = summed(*(x.ravel() for x in read(WORD, 1, 1)))
            _save_values(f"{path}/word-{shard:06d}", word, count)
            sums = [level, int(count.sum()), len(count)]
        own, count = read(GRAM, level, 1)
        key, own, total = counted(own, count.ravel())
        _save_values(f"{path}/gram{level}-{shard:06d}", key, total)
        sums += [*(int((total == k).sum()) for k in (1, 2, 3, 4)), int((total >= 3).sum()), int(total.sum())]
        out.append((shard, SUMS, pack(np.array(sums, np.int64)), None))
        if level > 1:
            before = gram_key(own[:, :-1])
            at, *stats = summed(before, total, *((total == k).astype(np.int64) for k in (1, 2)), (total >= 3).astype(np.int64))
            stats = np.stack(stats, 1)
            out += [(to, CONTEXT, pack(at[x]), pack(stats[x].T.ravel())) for to, x in by_shard(at, n_shards)]
            out += _sent(GRAM, *counted(own[:, 1:]), n_shards)
        yield _rows(out)

    return reduce


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """D1, D2, D3+ from counts of counts; where one is missing, an absolute discount of a half at most."""
    if not (n1 and n2):
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2 - 3 * y * n3 / n2]
    return [float(min(max(d, 0.0), k)) for d, k in zip(raw, (1, 2, 3), strict=True)]


#: Sums of a level in a shard: training tokens and distinct words (highest level only), n-grams counted 1, 2, 3, 4, over 2, all.
_SUMS = ["level", "tokens", "distinct", "n1", "n2", "n3", "n4", "over", "mass"]


def _summed_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(shard, *unpack(a, np.int64).tolist()) for shard, kind, a in zip(*(batch.column(x).to_pylist() for x in ("shard", "kind", "a")), strict=True) if kind == SUMS]
        if rows:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["shard", *_SUMS])


def train(docs: DataFrame, order: int = 2, flush: int = 4_000_000) -> dict:
    """Count the training documents and write the model; its description (a few numbers and a path)."""
    if order < 2:
        raise ValueError("the order is 2 at least")
    n_shards = shards_for(docs)
    path = qualified(docs.sparkSession, f"{shared_dir(docs.sparkSession)}/kneser-ney-{uuid.uuid4().hex}")
    arrow_batches(docs.sparkSession)
    read = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    rows = read.mapInArrow(_count(n_shards, flush, order), _BLOBS)
    for level in range(order, 0, -1):
        done, rows = rows, stash(exchange(rows, n_shards, _merge(path, n_shards, level, level == order), _BLOBS), "counts")
        if level < order:
            discard(done)
    sums = stash(rows.mapInArrow(_summed_up, "shard long, " + ", ".join(f"{x} long" for x in _SUMS)), "totals")
    discard(rows)
    filled: dict[int, set] = {level: set() for level in range(1, order + 1)}
    for r in sums.select("shard", "level").collect():  # a number a shard and level
        filled[r["level"]].add(r["shard"])
    total = {r["level"]: r for r in sums.groupBy("level").agg(*(F.sum(x).alias(x) for x in _SUMS[1:])).collect()}
    discard(sums)
    top = total.get(order)
    of = lambda level: [int(total[level][x]) for x in _SUMS[3:]] if level in total else [0] * 6
    levels = {level: {"discounts": discounts(*of(level)[:4]), "kinds": [*of(level)[:2], of(level)[4]], "mass": of(level)[5], "empty": sorted(set(range(n_shards)) - filled[level])} for level in range(1, order + 1)}
    return {"path": path, "shards": n_shards, "order": order, "tokens": int(top["tokens"]) if top else 0, "distinct": int(top["distinct"]) if top else 0, "levels": levels}


# -- scoring --------------------------------------------------------------------------------------------------------------


class _Sharded:
    """Sorted hash arrays over shards: values of keys (sorted) by shard, memory-mapped when first needed."""

    def __init__(self, path: str, n: int, empty: list[int], kind: str, width: int = 0):
        self.path, self.n, self.empty, self.kind, self.width = path, n, set(empty), kind, width
        self.held: dict[int, tuple[np.ndarray, ...]] = {}

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of sorted distinct keys; 0 where there is none."""
        out = np.zeros((len(keys), self.width) if self.width else len(keys), np.int64)
        for shard, own in by_shard(keys, self.n):
            if shard in self.empty:  # nothing fell into it; any other file that is missing is an error
                continue
            if shard not in self.held:
                if len(self.held) >= MOST:
                    self.held.clear()
                self.held[shard] = tuple(mapped(f"{self.path}/{self.kind}-{shard:06d}", name) for name in ("hash", "code", "table"))
            h, code, table = self.held[shard]
            if len(h):
                k = keys[own]
                at = np.minimum(np.searchsorted(h, k), len(h) - 1)
                hit = np.flatnonzero(h[at] == k)
                out[own.start + hit] = table[code[at[hit]]]
        return out

    def each(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys in any order, which may repeat."""
        distinct, back = np.unique(keys, return_inverse=True)
        return self.get(distinct)[back]


class Model:
    """A trained model, opened by a worker."""

    def __init__(self, info: dict):
        self.info, self.order = info, info["order"]
        self.levels = {int(k): v for k, v in info["levels"].items()}
        place = (info["path"], info["shards"])
        self.words = _Sharded(*place, self.levels[self.order]["empty"], "word")
        self.grams = {k: _Sharded(*place, v["empty"], f"gram{k}") for k, v in self.levels.items()}
        self.contexts = {k + 1: _Sharded(*place, v["empty"], f"context{k + 1}", 4) for k, v in self.levels.items() if k < self.order}

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, known tokens, base score, model score) of each text, scores as log10."""
        info = self.info
        h, n = tokens(texts)
        rows = grams(h, n, self.order)
        starts = np.cumsum(n) - n
        count = self.words.each(h)
        base = np.log10((count + 1) / (info["tokens"] + info["distinct"] + 1))
        p = np.ones(len(h)) / (info["distinct"] + 1)
        for level in range(1, self.order + 1):
            own, said = rows[:, -level:], self.levels[level]
            d = np.array([0, *said["discounts"]])
            if level == 1:
                seen, weight = np.full(len(h), said["mass"]), float(np.dot(d[1:], said["kinds"]))
            else:
                stats = self.contexts[level].each(gram_key(own[:, :-1]))
                seen, weight = stats[:, 0], stats[:, 1:] @ d[1:]
            c = self.grams[level].each(gram_key(own))
            some = np.maximum(seen, 1)
            p = np.maximum(c - d[np.minimum(c, 3)], 0) / some + np.where(seen > 0, weight / some, 1.0) * p
        return n, np.add.reduceat((count > 0).astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(np.log10(p), starts)


_MODELS: dict[str, Model] = {}


def score_documents(docs: DataFrame, info: dict) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    arrow_batches(docs.sparkSession)
    said = json.dumps(info)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _MODELS.get(info["path"])
        if model is None:
            _MODELS.clear()
            model = _MODELS[info["path"]] = Model(json.loads(said))
        for batch in batches:
            if not len(batch):
                continue
            ids = batch.column(0).to_pylist()
            n, known, base, score = model.score([x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()])
            yield pa.record_batch(
                [batch.column(0), pa.array([is_held(i) for i in ids]), pa.array(n), pa.array(known), pa.array(np.full(len(ids), info["tokens"])), pa.array(base), pa.array(score)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    read = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return read.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def train_and_score(docs: DataFrame, order: int = 2) -> DataFrame:
    return score_documents(docs, train(docs, order))
