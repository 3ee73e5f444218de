"""Importance resampling as a quality filter (operator 10).

Two generative models over hashed n-grams, one of the target (labelled good texts) and one of the raw corpus, give each
document the log ratio of its probabilities, its importance weight; the k documents with the greatest weight plus Gumbel
noise are kept, a sample without replacement in proportion to the weights (Gumbel top-k).

* n-grams: word unigrams, word bigrams, bigrams of word shapes; each kind has 2^bits buckets, and a
  bucket counts once in a document, as a word that one text uses a hundred times says no more of the corpus. Where four of
  seven neighbouring pairs are of equal words, the bigram is replaced by the quarter of the text that
  such bigrams make up.
* Counts of the raw model cover all documents. Those of the target come from at most ``max_labelled`` labelled documents
  (the documented bound; by hash of doc_id, so the same for any partitioning).
* Buckets whose share in target and raw does not clearly differ share one parameter: they cancel, and long clean texts gain
  nothing from their length (see log_ratio). Nor do they lose: held-out target texts tell how much evidence against a text
  comes by chance with each n-gram, and ALLOWED times that is made good, up to a weight of 0.
* k: as many documents as reach the cut that parts a third of the labelled sample best (true less false positive rate); that
  third, of each class, takes no part in the counts.
* ``sharpness`` is the exponent of the weights in the sampling: 1 samples in proportion to them, a greater one lets the noise
  decide among fewer documents. See the README for what 1, 2, 4 and 8 keep and lose on labelled documents.

Nulls: a null text is empty, has no n-grams and weight 0. A null doc_id is kept or not like any other (its noise is that of
id 0, but no label is its own). Repeated rows get equal weights and noise, so are kept or dropped together. Without labels of both classes nothing is
rejected. Extra columns come along in filter_documents and are not read otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenlake.llm.common import U64, WordHashes, arrow_batches, cache_of, grouped, mix, own_caches, spread, stash, sum_counters, utf8, words_of

KINDS = 3
#: How many times the evidence that held-out target texts have against them by chance every text is allowed.
ALLOWED = 3.0
_LETTERS, _DIGITS = re.compile(rb"[A-Za-z\x80-\xff]+"), re.compile(rb"[0-9]+")


class _Shapes(WordHashes):
    """word -> hash of its shape: letters as a, digits as 9."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(_DIGITS.sub(b"9", _LETTERS.sub(b"a", word)))
        return h


_WORDS, _SHAPES = cache_of("quality", WordHashes()), cache_of("quality", _Shapes())
_WORDS.LIMIT = _SHAPES.LIMIT = 300_000  # two of them in a worker
_SAME = U64(0x5851F42D4C957F2D)


def features(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of a batch's n-grams, each bucket once per row."""
    words = [words_of(x) for x in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    flat = [w for x in words for w in x]
    row = np.repeat(np.arange(len(texts)), n)
    h, s = _WORDS.array(flat), _SHAPES.array(flat)
    shift = U64(64 - bits)
    inner = row[1:] == row[:-1]
    two = mix(h[:-1], h[1:])
    same = np.cumsum(np.concatenate([[False], (h[:-1] == h[1:]) & inner, np.zeros(6, bool)]))
    again = same[7:] - same[:-7] >= 4
    share = np.bincount(row[:-1][again], minlength=len(texts)) / np.maximum(n, 1)
    two[again] = mix(np.full(int(again.sum()), _SAME), np.ceil(4 * share)[row[:-1][again]].astype(np.uint64))
    one = mix(h, U64(1)) >> shift
    pair = (mix(two, U64(2)) >> shift)[inner] + U64(1 << bits)
    shape = (mix(mix(s[:-1], s[1:]), U64(3)) >> shift)[inner] + U64(2 << bits)
    found = np.concatenate([one, pair, shape]).astype(np.int64) | np.concatenate([row, row[1:][inner], row[1:][inner]]) << 40
    found.sort()
    found = found[grouped(found)]
    return found & (1 << 40) - 1, found >> 40


def labelled_sample(labels: DataFrame, max_labelled: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted doc_ids, good) of at most max_labelled labelled documents: the first by hash. Good: quality 1, not toxic."""
    one = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    rows = one.where(F.col("q").isNotNull() | F.col("t").isNotNull()).select("doc_id", ((F.coalesce("q", F.lit(1)) == 1) & (F.coalesce("t", F.lit(0)) == 0)).alias("good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).toArrow()
    ids = rows["doc_id"].to_numpy().astype(np.int64)
    good = rows["good"].to_numpy(zero_copy_only=False).astype(bool)
    order = np.argsort(ids)
    return ids[order], good[order]


class Weights:
    """Log ratio of target to raw for each bucket, and how to sample."""

    def __init__(self, ratio: np.ndarray, bits: int, sharpness: float, seed: int, background: float = 0.0):
        self.ratio, self.bits, self.sharpness, self.seed, self.background = ratio.astype(np.float32), bits, sharpness, seed, background

    def sums(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(sum of the log ratios of a text's n-grams, their number)."""
        bucket, row = features(texts, self.bits)
        return np.bincount(row, self.ratio[bucket], len(texts)), np.bincount(row, minlength=len(texts))

    def score(self, texts: list[bytes]) -> np.ndarray:
        total, n = self.sums(texts)
        return np.minimum(total + self.background * n, np.maximum(total, 0)).round(6)

    def keys(self, doc_ids: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Gumbel key of each document; the noise is a function of doc_id and seed."""
        u = ((mix(mix(doc_ids.astype(np.uint64), U64(self.seed)), U64(9)) >> U64(11)).astype(np.float64) + 0.5) / 2.0**53
        return self.sharpness * score - np.log(-np.log(u))


def _ids(col: pa.Array) -> np.ndarray:
    return np.array([0 if x is None else x for x in col.to_pylist()], np.int64)


def _counts(docs: DataFrame, ids: np.ndarray, good: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Raw and target counts of each bucket. Each task sums its own; the result is bounded by the buckets."""
    shared = docs.sparkSession.sparkContext.broadcast(ids[good])
    size = KINDS << bits

    def count(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
        own_caches("quality")
        raw, target = np.zeros(size, np.int32), np.zeros(size, np.int32)
        for batch in batches:
            bucket, row = features(utf8(batch.column(1)), bits)
            np.add.at(raw, bucket, 1)
            own = np.isin(_ids(batch.column(0)), shared.value) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            np.add.at(target, bucket[own[row]], 1)
        return [raw, target]

    raw, target = sum_counters(docs, count, size, 2)
    return raw.astype(np.float64), target.astype(np.float64)


def log_ratio(raw: np.ndarray, target: np.ndarray, bits: int, prior: float = 1.0, by_chance: float = 50.0) -> np.ndarray:
    """Log of target over raw share of each bucket, kind by kind; buckets that do not clearly differ get 0: those within a
    factor of three, and those whose target count a Poisson variable of the raw model's mean would have by chance (Chernoff's
    bound of its tail) in more than ``by_chance`` of all buckets."""
    out = np.zeros(len(raw))
    for k in range(KINDS):
        own = slice(k << bits, (k + 1) << bits)
        r, t = raw[own], target[own]
        if r.sum() and t.sum():
            e = r * (t.sum() / r.sum())
            x = np.log((t + prior) / (e + prior))
            often = e >= 1
            with np.errstate(divide="ignore", invalid="ignore"):
                evidence = np.where(t > 0, t * np.log(np.where(t > 0, t, 1) / np.where(e > 0, e, 1)), 0) - t + e
            out[own] = np.where(often & (evidence >= np.log(max(1, often.sum()) / by_chance)) & (np.abs(x) >= np.log(3)), x, 0)
    return out


def _scores(docs: DataFrame, weights: Weights) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            score = w.score(utf8(batch.column(1)))
            yield pa.record_batch([batch.column(0), pa.array(score), pa.array(w.keys(_ids(batch.column(0)), score))], ["doc_id", "log_weight", "gumbel_key"])

    return docs.mapInArrow(run, "doc_id long, log_weight double, gumbel_key double")


def best_cut(score: np.ndarray, good: np.ndarray) -> float:
    """The score at or over which documents count as good: where true less false positive rate is greatest."""
    if good.all() or not good.any():
        return -np.inf
    order = np.argsort(-score, kind="stable")
    s, g = score[order], good[order]
    gain = np.cumsum(g) / g.sum() - np.cumsum(~g) / (~g).sum()
    gain[:-1][s[:-1] == s[1:]] = -np.inf
    at = int(np.argmax(gain))
    return float(s[at] + s[at + 1]) / 2 if at + 1 < len(s) else -np.inf


def kth_largest(scored: DataFrame, k: int) -> float:
    """The k-th largest gumbel_key, exactly, by histograms over 16 bits of its place in order at a time."""
    bits = F.expr("(gumbel_key)")
    ordered = scored.select(bits.alias("x"))
    low, high = (float(x) if x is not None else 0.0 for x in ordered.agg(F.min("x"), F.max("x")).first())
    want = k
    for _ in range(64):
        if low >= high:
            break
        width = (high - low) / 4096
        if low + width <= low:
            values = sorted((r["x"] for r in ordered.where((F.col("x") >= low) & (F.col("x") <= high)).select("x").distinct().collect()), reverse=True)
            counts = {r["x"]: r["n"] for r in ordered.where((F.col("x") >= low) & (F.col("x") <= high)).groupBy("x").agg(F.count("*").alias("n")).collect()}
            for v in values:
                want -= counts[v]
                if want <= 0:
                    return v
        cell = F.least(F.lit(4095), F.floor((F.col("x") - F.lit(low)) / F.lit(width)).cast("int"))
        rows = ordered.where((F.col("x") >= low) & (F.col("x") <= high)).groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        for r in sorted(rows, key=lambda r: -r["c"]):
            if want <= r["n"]:
                low, high = r["lo"], r["hi"]
                break
            want -= r["n"]
    return low


def fit(docs: DataFrame, labels: DataFrame, bits: int = 20, max_labelled: int = 20_000, sharpness: float = 4.0, seed: int = 17) -> tuple[Weights, DataFrame, float]:
    """(weights, stashed scores (doc_id, log_weight, gumbel_key) of all documents, least key that is kept)."""
    arrow_batches(docs.sparkSession)
    read = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")))
    ids, good = labelled_sample(labels, max_labelled)
    held = held_out(ids, good)
    raw, target = _counts(read, ids[~held], good[~held], bits)
    spark = docs.sparkSession
    weights = Weights(log_ratio(raw, target, bits), bits, sharpness, seed)
    weights.background = ALLOWED * _background(read, ids[held & good], weights)
    scored = stash(_scores(read, weights), "scores")
    known = spark.createDataFrame(pa.table({"doc_id": ids[held], "good": good[held]})) if held.any() else None  # at most max_labelled rows
    sample = scored.join(F.broadcast(known), "doc_id").select("log_weight", "good").toArrow() if known is not None else pa.table({"log_weight": pa.array([], pa.float64()), "good": pa.array([], pa.bool_())})
    cut = best_cut(sample["log_weight"].to_numpy(), sample["good"].to_numpy(zero_copy_only=False).astype(bool)) if len(sample) else -np.inf
    k = scored.where(F.col("log_weight") >= F.lit(cut)).count() if np.isfinite(cut) else 0
    return weights, scored, kth_largest(scored, k) if k else -np.inf


def _background(read: DataFrame, ids: np.ndarray, weights: Weights) -> float:
    """What held-out target texts (max_labelled at most) lose for each n-gram: evidence by chance, which grows with length."""
    if not len(ids):
        return 0.0
    spark = read.sparkSession
    few = spread(read.join(F.broadcast(spark.createDataFrame(pa.table({"doc_id": ids}))), "doc_id", "left_semi"))
    shared = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, n = shared.value.sums(utf8(batch.column(1)))
            yield pa.record_batch([pa.array([float(total.sum())]), pa.array([int(n.sum())])], ["total", "n"])

    found = few.mapInArrow(run, "total double, n long").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).first()
    return max(0.0, -found["total"] / found["n"]) if found["n"] else 0.0


def held_out(ids: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Which labelled documents find k and take no part in the counts: a third of each class, by hash; all that there are
    where a class has fewer than three."""
    out = np.zeros(len(ids), bool)
    for c in (True, False):
        own = np.flatnonzero(good == c)
        order = own[np.argsort(mix(ids[own].astype(np.uint64), U64(5)), kind="stable")]
        out[order[::3] if len(order) > 2 else order] = True
    return out


def select(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The kept documents: doc_id, log_weight, gumbel_key."""
    _, scored, least = fit(docs, labels, **params)
    return scored.where(F.col("gumbel_key") >= F.lit(float(least)))


def filter_documents(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """docs without the rejected ones, all columns; scored again where they lie, so that no text is shuffled."""
    weights, _, least = fit(docs, labels, **params)
    shared = docs.sparkSession.sparkContext.broadcast((weights, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, cut = shared.value
        for batch in batches:
            key = w.keys(_ids(batch.column("doc_id").cast(pa.int64())), w.score(utf8(batch.column("text"))))
            yield batch.filter(pa.array(key >= cut))

    return docs.mapInArrow(run, docs.schema)
