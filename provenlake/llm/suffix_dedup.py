"""Removal of long repeats by a run-length suffix index (operator 2).

Every byte is removed that is covered by a string of ``length`` bytes which also starts earlier (smaller doc_id, or the same
document, earlier start), judged on the input. The result is exact.

1. Windows of ``length`` bytes go where their minimizer, the least hash among their ``anchor``-grams, sends them: equal
   windows have equal minimizers. A run of windows with one minimizer is a fragment; one record per fragment (40-bit hashes
   of anchor and content, document, place) goes to the anchor's shard. Each task keeps its first copy of a fragment and
   marks its later ones at once, so that a fragment with millions of copies is a few records for each task.
2. A shard marks every copy of a fragment but the first. Where an anchor has several different fragments, the first copies
   remain open: some of their windows may repeat within another fragment.
3. The texts of open fragments go to their shard once more. There the earlier half of an anchor's fragments is indexed
   (``RunLengthIndex``: run-compressed Burrows-Wheeler transform with sampled run ends and thresholds), the later half
   streamed through it as matching statistics, and windows whose match is long enough and has a lower rank are marked; the
   halves' own halves follow in the same way. An anchor with over ``crowd`` different fragments (a common line before ever
   different texts) sends its windows by their own hash instead: then equal windows meet whatever stands around them, and no
   group is large.
4. Marks meet their documents, once.

doc_id identifies a document: rows that repeat both doc_id and text are the same document and get the same result; rows that
repeat a doc_id, or null ids, with another text are told apart by it (the order of the texts' SHA-256 decides which comes
first; null ids come before all others). A null text is empty. Texts shorter than ``length`` lose nothing. Long texts are
hashed in pieces, never cut. Empty table: no rows. Columns with any name come along in remove_repeats, as one struct until
the end, and are not read otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenlake.llm.common import U64, arrow_batches, by_shard, dealt, exchange, grouped, mix, pack, shards_for, spans, spread, stash, unpack

_BYTES = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_STEP = U64(0xD6E8FEB86659FD93)
#: Texts are hashed in pieces of about so many bytes: their arrays then stay in the processor's cache.
PIECE = 1 << 17


# -- windows ------------------------------------------------------------------------------------------------------------


def gram_hashes(raw: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """64-bit hash of the n bytes from each place on, for each n (ascending): by doubling."""
    out, have, h = [], 1, _BYTES[raw]
    power = {1: _STEP}

    def step(n: int) -> np.uint64:
        if n not in power:
            power[n] = U64(pow(int(_STEP), n, 1 << 64))
        return power[n]

    for n in lengths:
        while 2 * have <= n:
            h = h[:-have] * step(have) + h[have:] if len(h) > have else h[:0]
            have *= 2
        k = n - have
        own = h if not k else (mix(h[:-k], h[k:]) if len(h) > k else h[:0])
        x = own ^ (own >> U64(31))
        x *= U64(0xC2B2AE3D27D4EB4F)
        x ^= x >> U64(29)
        out.append(x)
    return out


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        v = np.minimum(v[:-have], v[have:]) if len(v) > have else v[:0]
        have *= 2
    k = width - have
    return v if not k else (np.minimum(v[:-k], v[k:]) if len(v) > k else v[:0])


class Fragments:
    """Fragments of a batch of texts, as arrays: anchor (40 bits), content (40 bits), row, start, windows, lead."""

    def __init__(self, texts: list[bytes], length: int, anchor: int, windows: bool = False):
        self.parts: list[tuple] = []
        self.length, self.anchor, self.windows = length, anchor, windows
        held: list[bytes] = []
        rows: list[int] = []
        shift: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if len(text) < length:
                continue
            for a in range(0, len(text) - length + 1, PIECE):  # pieces of a long text share length - 1 bytes
                part = text[a : a + PIECE + length - 1]
                held.append(part)
                rows.append(i)
                shift.append(a)
                size += len(part)
                if size >= PIECE:
                    self._add(held, rows, shift)
                    held, rows, shift, size = [], [], [], 0
        if held:
            self._add(held, rows, shift)
        cols = list(zip(*self.parts, strict=True)) if self.parts else [[np.zeros(0, np.uint64)]] * 2 + [[np.zeros(0, np.int64)]] * 4
        self.key, self.content, self.row, self.start, self.count, self.lead = (np.concatenate(c) for c in cols[:6])
        self.hashes = np.concatenate([p[6] for p in self.parts]) if windows and self.parts else np.zeros(0, np.uint64)

    def _add(self, held: list[bytes], rows: list[int], shift: list[int]) -> None:
        length, anchor = self.length, self.anchor
        sizes = np.fromiter(map(len, held), np.int64, len(held))
        ends = np.cumsum(sizes)
        raw = np.frombuffer(b"".join(held), np.uint8)
        grams, whole = gram_hashes(raw, anchor, length)
        bits = U64(max(1, (len(raw)).bit_length()))
        packed = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
        least = (sliding_min(packed, length - anchor + 1) & ((U64(1) << bits) - U64(1))).astype(np.int64)
        own = np.repeat(np.arange(len(held)), sizes)[: len(least)]
        valid = np.arange(len(least)) + length <= ends[own]
        at = np.flatnonzero(valid)
        least, own = least[at], own[at]
        cut = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (own[1:] != own[:-1])]))
        last = np.append(cut[1:], len(at)) - 1
        first, piece, place = at[cut], own[cut], least[cut]
        count = at[last] - first
        lead = place - first
        content = mix(mix(whole[first], whole[at[last]]), (count * 256 + lead).astype(np.uint64))
        row = np.asarray(rows, np.int64)[piece]
        start = first - (ends - sizes)[piece] + np.asarray(shift, np.int64)[piece]
        # a piece's border may part a run of a long text: the parts are fragments of their own
        # minimizers are small numbers: mixed again, they spread over all shards
        self.parts.append((mix(grams[place], U64(3)) >> U64(24), content >> U64(24), row, start, count + 1, lead) + ((whole[at],) if self.windows else ()))


# -- the index ------------------------------------------------------------------------------------------------------------


def to_separator(text: np.ndarray) -> np.ndarray:
    """How far it is from each place to the next separator (0, the last symbol)."""
    ends = np.flatnonzero(text == 0)
    return np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(len(text))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols at least. Symbols are 0..256; 0 separates, and no two separators are
    equal: they come in the order of their places, so that what stands behind them orders nothing. With a depth over the
    longest part the order is total, which the steps from a row to that of the symbol before it rely on."""
    n = len(text)
    padded = np.concatenate([text.astype(np.int64), np.zeros(8, np.int64)])
    key = np.zeros(n, np.int64)
    have = 6
    reach = to_separator(text)
    for i in range(have):
        key = key * 512 + np.where(reach < i, 0, padded[i : i + n])
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (reach[order[1:]] < have)]))
    rank = np.empty(n, np.int64)  # the first place of the suffix's group
    rank[order] = np.repeat(head, np.diff(np.append(head, n)))
    while have < depth:
        size = np.diff(np.append(head, n))
        places = np.flatnonzero(np.repeat(size > 1, size))
        if not len(places):
            break
        own = order[places]
        after = own + have
        key = rank[own] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        again = np.argsort(key, kind="stable")
        own, key = own[again], key[again]
        order[places] = own
        cut = grouped(key)
        rank[own] = np.repeat(places[cut], np.diff(np.append(cut, len(key))))
        head = np.flatnonzero(rank[order] == np.arange(n))
        have *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Symbols that each suffix shares with the one before it in order, up to a separator, counted four at a time."""
    n = len(text)
    reach = to_separator(text)[order]
    raw = np.concatenate([text.astype(np.uint16), np.zeros(4, np.uint16)])
    four = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, 4)[:n]).view(np.uint64).ravel()
    out = np.zeros(n, np.int64)
    left, right, at = order[:-1].copy(), order[1:].copy(), np.arange(1, n)
    while len(at):
        x = four[left] ^ four[right]
        low = x & (~x + U64(1))
        out[at] += np.where(x == 0, 4, np.searchsorted(np.array([1 << 16, 1 << 32, 1 << 48], np.uint64), low, "right"))
        on = (x == 0) & (out[at] < reach[at]) & (left + 4 < n) & (right + 4 < n)
        at, left, right = at[on], left[on] + 4, right[on] + 4
    return np.minimum(out, reach)


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of a text of symbols 1..256, with 0 as separator and last symbol.

    Kept per run: symbol, start, end, the row that its start is mapped to, the text places sampled at both its ends, and the
    threshold towards the next run of its symbol. ``statistics`` streams patterns through it, all side by side, from their
    last symbols to their first. order and prefixes (the suffix array and its common prefixes) serve to build it only.
    """

    def __init__(self, text: np.ndarray, order: np.ndarray, prefixes: np.ndarray):
        n = len(text)
        bwt = text[order - 1]
        self.starts = grouped(bwt)
        self.ends = np.append(self.starts[1:], n) - 1
        self.symbols = bwt[self.starts].astype(np.int64)
        self.sample_first, self.sample_last = order[self.starts], order[self.ends]
        size = self.ends - self.starts + 1
        self.by_symbol = np.argsort(self.symbols, kind="stable")
        self.mapped = np.empty(len(size), np.int64)
        self.mapped[self.by_symbol] = np.cumsum(size[self.by_symbol]) - size[self.by_symbol]
        self.keys = self.symbols[self.by_symbol] * (len(size) + 1) + self.by_symbol
        a, b = self.by_symbol[:-1], self.by_symbol[1:]
        same = self.symbols[a] == self.symbols[b]
        self.threshold = np.full(len(size), n, np.int64)
        if same.any():
            packed = np.append(prefixes << 40 | np.arange(n), np.int64(1) << 62)
            bounds = np.stack([self.ends[a[same]] + 1, self.starts[b[same]] + 1], 1).ravel()
            self.threshold[a[same]] = np.minimum.reduceat(packed, bounds)[::2] & ((1 << 40) - 1)

    def _runs_beside(self, symbol: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last run of a symbol before a run, and the first after it; -1 where there is none."""
        at = np.searchsorted(self.keys, symbol * (len(self.symbols) + 1) + run)
        up = self.by_symbol[np.maximum(at - 1, 0)]
        down = self.by_symbol[np.minimum(at, len(self.keys) - 1)]
        return np.where((at > 0) & (self.symbols[up] == symbol), up, -1), np.where((at < len(self.keys)) & (self.symbols[down] == symbol), down, -1)

    def statistics(self, patterns: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of patterns (symbols patterns[end - length : end]): for each of their places, the row and the
        text place of a suffix that shares with the pattern from there on as much as any does; -1 where no symbol matches."""
        rows, places = np.full(len(patterns), -1, np.int64), np.full(len(patterns), -1, np.int64)
        lanes = np.argsort(-lengths, kind="stable")
        last, left = ends[lanes] - 1, -lengths[lanes]
        all_rows, all_places = np.zeros(len(lanes), np.int64), np.full(len(lanes), self.sample_first[0], np.int64)
        for step in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(left, -step, "left"))
            at = last[:live] - step
            c, row, place = patterns[at], all_rows[:live], all_places[:live]
            run = np.searchsorted(self.starts, row, "right") - 1
            miss = np.flatnonzero(self.symbols[run] != c)
            lost = miss[:0]
            if len(miss):
                up, down = self._runs_beside(c[miss], run[miss])
                use_up = (up >= 0) & ((down < 0) | (row[miss] < self.threshold[up]))
                to = np.where(use_up, up, down)
                lost = miss[to < 0]
                row[miss] = np.where(use_up, self.ends[to], self.starts[to])
                place[miss] = np.where(use_up, self.sample_last[to], self.sample_first[to])
                run[miss] = to
            row[:] = self.mapped[run] + (row - self.starts[run])
            place -= 1
            rows[at], places[at] = row, place
            if len(lost):
                rows[at[lost]] = places[at[lost]] = -1
                row[lost], place[lost] = 0, self.sample_first[0]
        return rows, places


def match_lengths(text: np.ndarray, patterns: np.ndarray, ends: np.ndarray, lengths: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The lengths that go with ``statistics``: each falls by one at most from one place to the next."""
    out = np.zeros(len(patterns), np.int64)
    for e, m in zip(ends.tolist(), lengths.tolist(), strict=True):
        k = 0
        for i in range(e - m, e):
            p, k = int(places[i]), max(k - 1, 0)
            if p < 0:
                k = 0
                continue
            while i + k < e and p + k < len(text) and text[p + k] == patterns[i + k]:
                k += 1
            out[i] = k
    return out


class EarlierText:
    """A run-length index of fragments, with the least rank of each group of suffixes that share ``length`` symbols."""

    def __init__(self, fragments: list[bytes], rank: np.ndarray, length: int):
        self.length = length
        joined, text, ends, sizes = _laid_out(fragments)
        order = suffix_array(text, int(sizes.max()) + 2)
        prefixes = common_prefixes(text, order)
        self.index = RunLengthIndex(text, order, prefixes)
        of_place = np.full(len(text), np.iinfo(np.int64).max)
        of_place[np.repeat(ends - sizes, sizes) + _counting(sizes)] = np.repeat(rank, sizes)
        self.heads = np.flatnonzero(prefixes < length)
        self.least = np.minimum.reduceat(of_place[order], self.heads)
        (self.windows,) = gram_hashes(joined, length)
        self.whole = to_separator(text) >= length  # no separator within the window: in bytes it would pass for a NUL

    def marks(self, fragments: list[bytes], rank: np.ndarray) -> np.ndarray:
        """Which windows of the fragments, one after another, match a window of the index that has a lower rank."""
        joined, text, ends, sizes = _laid_out(fragments)
        rows, places = self.index.statistics(text, ends, sizes)
        count = np.maximum(sizes - self.length + 1, 0)
        at = np.repeat(ends - sizes, count) + _counting(count)
        rows, places = rows[at], places[at]
        (own,) = gram_hashes(joined, self.length)
        fits = (places >= 0) & (places < len(self.windows))
        place = np.where(fits, places, 0)
        long = fits & self.whole[place] & (self.windows[place] == own[at])
        least = self.least[np.searchsorted(self.heads, np.maximum(rows, 0), "right") - 1]
        return long & (least < np.repeat(rank, count))


def _laid_out(fragments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, symbols 1..256 with 0 after each fragment, the fragments' ends, their sizes)."""
    sizes = np.fromiter(map(len, fragments), np.int64, len(fragments))
    joined = np.frombuffer(b"\0".join(fragments) + b"\0", np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    text = joined.astype(np.int64) + 1
    text[ends] = 0
    return joined, text, ends, sizes


def repeated_windows(fragments: list[bytes], rank: np.ndarray, key: np.ndarray, length: int) -> list[np.ndarray]:
    """Of fragments (rank: their order by document and start; key: their anchor), which windows occur in a fragment of lower
    rank: a boolean array for each. Equal windows have one anchor, and no fragment holds a window twice.

    Of each anchor's fragments, the earlier half of every block of 2, 4, 8 ... is indexed, and the later half streamed through
    the index: any two fragments meet in that way once. Most anchors have few fragments, so most end after the first block.
    """
    order = np.lexsort((rank, key))
    cut = grouped(key[order])
    size = np.repeat(np.diff(np.append(cut, len(order))), np.diff(np.append(cut, len(order))))
    nth = _counting(np.diff(np.append(cut, len(order))))
    count = np.fromiter((max(0, len(x) - length + 1) for x in fragments), np.int64, len(fragments))
    marked = [np.zeros(k, bool) for k in count.tolist()]
    for b in range(int(size.max(initial=1) - 1).bit_length()):
        later = (nth >> b & 1) == 1
        earlier = ~later & ((nth >> b | 1) << b < size)
        left, right = order[earlier], order[later]
        right = right[[not marked[i].all() for i in right.tolist()]]
        if len(left) and len(right):
            found = EarlierText([fragments[i] for i in left.tolist()], rank[left], length).marks([fragments[i] for i in right.tolist()], rank[right])
            for i, x in zip(right.tolist(), np.split(found, np.cumsum(count[right])[:-1]), strict=True):
                marked[i] |= x
    return marked


def _counting(sizes: np.ndarray) -> np.ndarray:
    """0 .. size - 1 for each size, one after another."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


# -- marks ----------------------------------------------------------------------------------------------------------------


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges by document, overlapping and touching ones made one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    number = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]).astype(np.int64)])) << 40
    reach = np.maximum.accumulate(number + end)
    cut = np.flatnonzero(np.concatenate([[True], number[1:] + start[1:] > reach[:-1]]))
    last = np.append(cut[1:], len(doc)) - 1
    return doc[cut], start[cut], reach[last] - number[last]


_BLOBS = "shard int, kind int, a binary, b binary, c binary, d binary, e binary"
_NAMES = ["shard", "kind", "a", "b", "c", "d", "e"]
MARKS, OPEN, RECORDS, TEXTS, WINDOWS = range(5)


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (shard, kind, arrays or bytes ...) as a batch of _BLOBS."""
    cols: list[list] = [[], [], [], [], [], [], []]
    for shard, kind, *arrays in rows:
        cols[0].append(shard)
        cols[1].append(kind)
        for i in range(5):
            x = arrays[i] if i < len(arrays) else None
            cols[2 + i].append(x if x is None or isinstance(x, bytes) else pack(x))
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, [pa.int32()] * 2 + [pa.binary()] * 5, strict=True)], _NAMES)


def _by_doc(kind: int, n: int, doc: np.ndarray, *arrays: np.ndarray) -> list[tuple]:
    """Rows of arrays, dealt by document: shard doc mod n."""
    own = doc % n
    order = np.lexsort((doc, own))
    cut = grouped(own[order])
    return [(int(own[order[a]]), kind, doc[order[a:b]], *(x[order[a:b]] for x in arrays)) for a, b in spans(cut, len(doc))]


def _columns(rows: pa.Table, kind: int, *dtypes) -> list[np.ndarray]:
    own = rows.filter(pa.compute.equal(rows["kind"], kind))
    return [np.concatenate([unpack(x, t) for x in own[c].to_pylist()]) if len(own) else np.zeros(0, t) for c, t in zip("abcde", dtypes, strict=False)]


def _first_copies(key: np.ndarray, content: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by key, content, document, start; is the first copy; is a later copy)."""
    order = np.lexsort((start, doc, content, key))
    k, c, d, s = key[order], content[order], doc[order], start[order]
    head = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
    at = np.flatnonzero(head)
    size = np.diff(np.append(at, len(k)))
    later = (d != np.repeat(d[at], size)) | (s != np.repeat(s[at], size))  # a repeated row is no copy of itself
    return order, head, later


class RepeatFinder:
    """The steps over a table of (doc long, text string): see the module's head."""

    def __init__(self, docs: DataFrame, length: int = 100, anchor: int = 40, crowd: int = 8192, flush: int = 12_000_000):
        if not 8 <= anchor < length <= 255:
            raise ValueError("8 <= anchor < length <= 255")
        self.docs, self.length, self.anchor, self.crowd, self.flush = docs, length, anchor, crowd, flush
        self.n = shards_for(docs) | 1
        self.texts = 4 * self.n  # an index holds a hundred bytes for each byte of its shard while it is built

    def marks(self) -> list[DataFrame]:
        """Stashed tables of marked byte ranges by document (kind MARKS; other kinds are to be passed over)."""
        found = stash(exchange(spread(self.docs).mapInArrow(self._fragments(), _BLOBS), self.n, self._copies(), _BLOBS), "repeats")
        if found.where(F.col("kind") == OPEN).limit(1).isEmpty():
            return [found]
        texts = self.beside(found.where(F.col("kind") == OPEN)).mapInArrow(self._open_texts(), _BLOBS)
        more = stash(exchange(texts, self.texts, self._windows(), _BLOBS), "repeats-open")
        return [found, more]

    def beside(self, blobs: DataFrame, docs: DataFrame | None = None) -> DataFrame:
        """Documents with the rows of blobs that concern them: by shard, blobs first."""
        docs = self.docs if docs is None else docs
        own = docs.withColumns({"shard": F.pmod(F.col("doc"), F.lit(self.n)).cast("int"), "kind": F.lit(99)})
        return dealt(blobs.unionByName(own, allowMissingColumns=True), self.n).sortWithinPartitions("shard", "kind")

    def _fragments(self):
        n, length, anchor, flush = self.n, self.length, self.anchor, self.flush

        def emit(docs: np.ndarray, texts: list[bytes]) -> pa.RecordBatch:
            f = Fragments(texts, length, anchor)
            doc = docs[f.row]
            order, head, later = _first_copies(f.key, f.content, doc, f.start) if len(doc) else (np.zeros(0, np.int64),) * 3
            copies, keep = order[later.astype(bool)], order[head.astype(bool)]
            rows = _by_doc(MARKS, n, *merged(doc[copies], f.start[copies], f.start[copies] + f.count[copies] - 1 + length))
            for shard, own in by_shard(f.key[keep] << U64(24), n):
                k = keep[own]
                rows.append((shard, RECORDS, f.key[k], f.content[k], doc[k], f.start[k], (f.count[k] << 8 | f.lead[k])))
            return _blobs(rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            docs: list[int] = []
            texts: list[bytes] = []
            size = 0
            for batch in batches:
                for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    docs.append(doc)
                    texts.append(text or b"")
                    size += len(texts[-1])
                    if size >= flush:
                        yield emit(np.array(docs, np.int64), texts)
                        docs, texts, size = [], [], 0
            yield emit(np.array(docs, np.int64), texts)

        return run

    def _copies(self):
        n, length, crowd = self.n, self.length, self.crowd

        def reduce(shard: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
            doc, start, end = _columns(rows, MARKS, "<i8", "<i8", "<i8")
            out = _by_doc(MARKS, n, *merged(doc, start, end))
            key, content, doc, start, shape = _columns(rows, RECORDS, "<u8", "<u8", "<i8", "<i8", "<i8")
            if len(key):
                order, head, later = _first_copies(key, content, doc, start)
                copies = order[later]
                out += _by_doc(MARKS, n, *merged(doc[copies], start[copies], start[copies] + (shape[copies] >> 8) - 1 + length))
                first = order[head]
                cut = grouped(key[first])
                size = np.diff(np.append(cut, len(first)))
                several = np.repeat(size > 1, size)
                if several.any():
                    own = first[several]
                    crowded = np.repeat(size > crowd, size)[several]
                    out += _by_doc(OPEN, n, doc[own], start[own], shape[own] >> 8, key[own], crowded.astype(np.int64))
            if out:
                yield _blobs(out)

        return reduce

    def _open_texts(self):
        n, shards, length, flush = self.n, self.texts, self.length, self.flush

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held, entries, seen = None, [], None, set()
            texts: list[tuple] = []
            size = 0

            def emit() -> pa.RecordBatch:
                key, doc, start, count, crowded = (np.array([t[i] for t in texts], t) for i, t in ((0, np.uint64), (1, np.int64), (2, np.int64), (3, np.int64), (4, np.int64)))
                parts = [t[5] for t in texts]
                rows = []
                plain = np.flatnonzero(crowded == 0)
                plain = plain[np.argsort(key[plain], kind="stable")]
                for shard, own in by_shard(key[plain] << U64(24), shards):
                    k = plain[own]
                    rows.append((shard, TEXTS, doc[k], start[k], count[k], np.frombuffer(b"".join([parts[i] for i in k]), np.uint8), key[k]))
                hot = np.flatnonzero(crowded)
                if len(hot):
                    h, d, s = [], [], []
                    for i in hot.tolist():
                        (x,) = gram_hashes(np.frombuffer(parts[i], np.uint8), length)
                        h.append(x)
                        d.append(np.full(len(x), doc[i]))
                        s.append(start[i] + np.arange(len(x)))
                    h, d, s = np.concatenate(h), np.concatenate(d), np.concatenate(s)
                    order, head, later = _first_copies(h, np.zeros(len(h), np.uint64), d, s)
                    copies, keep = order[later], order[head]
                    rows += _by_doc(MARKS, n, *merged(d[copies], s[copies], s[copies] + length))
                    for shard, own in by_shard(h[keep], shards):
                        k = keep[own]
                        rows.append((shard, WINDOWS, h[k], d[k], s[k]))
                return _blobs(rows)

            for batch in batches:
                for row in batch.select(["shard", "kind", "a", "b", "c", "d", "e", "doc", "text"]).to_pylist():
                    if row["shard"] != at:
                        at, held, entries, seen = row["shard"], [], None, set()
                    if row["kind"] != 99:
                        held.append([unpack(row[c], t) for c, t in zip("abcde", ("<i8", "<i8", "<i8", "<u8", "<i8"), strict=True)])
                        continue
                    if entries is None:
                        entries = [np.concatenate(x) for x in zip(*held, strict=True)] if held else [np.zeros(0, np.int64)] * 5
                        order = np.argsort(entries[0], kind="stable")
                        entries = [x[order] for x in entries]
                    if row["doc"] in seen:
                        continue
                    a, b = np.searchsorted(entries[0], row["doc"], "left"), np.searchsorted(entries[0], row["doc"], "right")
                    if a == b:
                        continue
                    seen.add(row["doc"])
                    raw = (row["text"] or "").encode()
                    for i in range(a, b):
                        s, count = int(entries[1][i]), int(entries[2][i])
                        part = raw[s : s + count - 1 + length]
                        texts.append((int(entries[3][i]), row["doc"], s, count, int(entries[4][i]), part))
                        size += 40 * len(part) if entries[4][i] else len(part)
                    if size >= flush:
                        yield emit()
                        texts, size = [], 0
            if texts:
                yield emit()

        return run

    def _windows(self):
        n, length = self.n, self.length

        def reduce(shard: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
            out = []
            marks = [_columns(rows, MARKS, "<i8", "<i8", "<i8")]
            h, doc, start = _columns(rows, WINDOWS, "<u8", "<i8", "<i8")
            if len(h):
                order, _, later = _first_copies(h, np.zeros(len(h), np.uint64), doc, start)
                copies = order[later]
                marks.append([doc[copies], start[copies], start[copies] + length])
            doc, start, count, raw, key = _columns(rows, TEXTS, "<i8", "<i8", "<i8", "u1", "<u8")
            if len(doc):
                size = count - 1 + length
                ends = np.cumsum(size)
                raw = raw.tobytes()
                rank = np.empty(len(doc), np.int64)
                rank[np.lexsort((start, doc))] = np.arange(len(doc))
                found = repeated_windows([raw[e - s : e] for e, s in zip(ends.tolist(), size.tolist(), strict=True)], rank, key, length)
                hit = np.concatenate(found)
                d, s = np.repeat(doc, count)[hit], (np.repeat(start, count) + _counting(count))[hit]
                marks.append([d, s, s + length])
            out = _by_doc(MARKS, n, *merged(*(np.concatenate(x) for x in zip(*marks, strict=True))))
            if out:
                yield _blobs(out)

        return reduce


def _numbered(docs: DataFrame) -> DataFrame:
    """doc (long), which identifies and orders documents, text, and the caller's whole row as a struct. Where doc_ids are
    unique and none is null, doc is doc_id; else the place of (doc_id, nulls first, SHA-256 of the text) among all of them."""
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    if own.groupBy("id").count().where("id IS NULL OR count > 1").limit(1).isEmpty():
        return own.select(F.col("id").alias("doc"), "text", "row")
    own = own.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.record_batch([*batch.columns, pa.array(np.full(len(batch), part, np.int32)), pa.array(np.arange(n, n + len(batch)))], ["id", "sha", "part", "nth"])
            n += len(batch)

    order = (F.col("id").asc_nulls_first(), F.col("sha"))
    known = own.select("id", "sha").distinct().repartitionByRange(docs.sparkSession.sparkContext.defaultParallelism, *order).sortWithinPartitions(*order)
    known = stash(known.mapInArrow(place, "id long, sha string, part int, nth long"), "numbers")
    sizes = {r["part"]: r["n"] for r in known.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row a partition
    first, at = {}, 0
    for part in sorted(sizes):
        first[part], at = at, at + sizes[part]
    start = F.create_map(*(F.lit(x) for item in first.items() for x in item))
    known = known.select(F.col("id").alias("_id"), F.col("sha").alias("_sha"), (start[F.col("part")] + F.col("nth")).cast("long").alias("doc"))
    return own.join(known, own["id"].eqNullSafe(known["_id"]) & (own["sha"] == known["_sha"])).select("doc", "text", "row")


def _ranges(docs: DataFrame, length: int, anchor: int, use, schema: str, **params) -> DataFrame:
    """use(a document's row as a dict, starts, ends) for each document with its removed ranges -> row dict."""
    arrow_batches(docs.sparkSession)
    own = _numbered(docs)
    finder = RepeatFinder(own.select("doc", "text"), length, anchor, **params)
    found = finder.marks()
    blobs = found[0].where(F.col("kind") == MARKS)
    for more in found[1:]:
        blobs = blobs.unionByName(more.where(F.col("kind") == MARKS))
    joined = finder.beside(blobs.select("shard", "kind", "a", "b", "c"), own.select("doc", "row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, marks = None, [], None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["shard"] != at:
                    at, held, marks = row["shard"], [], None
                if row["kind"] != 99:
                    held.append([unpack(row[c], "<i8") for c in "abc"])
                    continue
                if marks is None:
                    marks = merged(*(np.concatenate(x) for x in zip(*held, strict=True))) if held else (np.zeros(0, np.int64),) * 3
                a, b = np.searchsorted(marks[0], row["doc"], "left"), np.searchsorted(marks[0], row["doc"], "right")
                rows.append(use(row["row"], marks[1][a:b], marks[2][a:b]))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    target = to_arrow_schema(kind)
    return joined.mapInArrow(run, kind)


def digest(docs: DataFrame, length: int = 100, anchor: int = 40, **params) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""

    def use(row: dict, start: np.ndarray, end: np.ndarray) -> dict:
        raw = (row["text"] or "").encode()
        kept, at = hashlib.sha256(), 0
        for a, b in zip(start.tolist(), end.tolist(), strict=True):
            kept.update(raw[at:a])
            at = b
        kept.update(raw[at:])
        return {"doc_id": row["doc_id"], "n_bytes": len(raw), "n_removed": int((end - start).sum()), "n_spans": len(start), "kept_sha256": kept.hexdigest()}

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return _ranges(docs, length, anchor, use, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", **params)


def keep_text(raw: bytes, start: np.ndarray, end: np.ndarray) -> str:
    """The text without the ranges; a character of which only some bytes lie in a range stays whole."""
    out, at = [], 0
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b < len(raw) and b > a and raw[b] & 0xC0 == 0x80:
            b -= 1
        out.append(raw[at:a])
        at = max(a, b)
    return b"".join([*out, raw[at:]]).decode()


def remove_repeats(docs: DataFrame, length: int = 100, anchor: int = 40, **params) -> DataFrame:
    """docs with repeats cut from text, whole characters only; n_chars, where there is such a column, counts anew. A null
    text stays null."""
    names = docs.columns

    def use(row: dict, start: np.ndarray, end: np.ndarray) -> dict:
        out = {c: row[c] for c in names}
        if out["text"] is not None and len(start):
            out["text"] = keep_text(out["text"].encode(), start, end)
            if "n_chars" in out:
                out["n_chars"] = len(out["text"])
        return out

    return _ranges(docs, length, anchor, use, docs.schema, **params)
