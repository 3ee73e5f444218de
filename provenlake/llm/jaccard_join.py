"""N-gram Jaccard self-join of documents and its groups (operator 4), exact.

A document is the set of its distinct shingles of ``words`` words. Two sets link where their Jaccard similarity is at least
per / 100. Steps:

1. Shingles are ordered rare-first, by their exact frequency over the sets (classes of it, then hash): tasks send their tokens
   to shards by hash range, shards count them and send back those that several sets have. Documents with equal sets are one
   node. A set of n shingles has a prefix of n - ceil(per * n / 100) + 1: linked sets share a shingle of both prefixes, so
   prefixes are joined by shingle, behind length and positional filters. Shingles of one set only come first in the order and
   are never exchanged again: most documents end there.
2. In each prefix shingle's bucket every node is first paired with one pivot only. Pairs are distinct and pass a bitmap
   filter (parities of shingles by hash: sets differ in at least as many shingles as their bitmaps in bits); each is then
   verified once, on whole sets behind a suffix filter. The links give first components.
3. Pairs within a component need no check any more. Buckets that hold several components get other pivots, twice; what then
   is left across components of one bucket is joined, behind all filters, and verified too. A group of thousands of near
   copies so takes a few pairs per node, yet no link that matters is lost; components and classes are exact.

Buckets are never collected: pivots are aggregates that are joined back, which adaptive execution splits.

Nulls: a null or blank text has no shingles and links with nothing. A null doc_id takes part, but is never the least id of
its component unless all of it is null. Repeated rows have equal sets: one node. Fewer words than ``words``: the whole sequence is the one shingle. Empty table: no rows. Other
columns are not read (they come along in one_of_each). Sets and shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenlake.llm.common import U64, WordHashes, arrow_batches, by_shard, cache_of, discard, exchange, grouped, mix, own_caches, pack, shards_for, spans, spread, stash, unpack, utf8, words_of
from provenlake.llm.components import components

MEMBER, POSTING, HEADER = range(3)
_WORDS = cache_of("jaccard", WordHashes())


def shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each text's shingles in their order, row by row."""
    parts = [words_of(x) for x in texts]
    n = np.fromiter(map(len, parts), np.int64, len(parts))
    h = _WORDS.array([w for x in parts for w in x])
    row = np.repeat(np.arange(len(parts)), n)
    ends = np.cumsum(n)
    size = max(0, len(h) - words + 1)
    s = h[:size].copy()
    for i in range(1, words):
        s = mix(s, h[i : i + size])
    whole = row[:size] == row[words - 1 :][:size]
    row, s = row[:size][whole], s[whole]
    short = np.flatnonzero((n > 0) & (n < words))
    if len(short):
        extra = []
        for i in short.tolist():
            x = np.array([n[i]], np.uint64)
            for w in h[ends[i] - n[i] : ends[i]]:
                x = mix(x, w)
            extra.append(x)
        row, s = np.concatenate([row, short]), np.concatenate([s, *extra])
        order = np.argsort(row, kind="stable")
        row, s = row[order], s[order]
    return row, s


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each text's distinct shingles, by row and hash."""
    row, s = shingles(texts, words)
    for a, b in spans(grouped(row), len(row)):
        s[a:b].sort()
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (s[1:] != s[:-1])
    return row[keep], s[keep]


def _nodes(row: np.ndarray, s: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(set size, node) per row; node: a hash of the set."""
    n = np.bincount(row, minlength=count)
    node = np.zeros(count, np.uint64)
    if len(row):
        cut = grouped(row)
        node[row[cut]] = np.add.reduceat(mix(s, U64(0x51ED270B)), cut)
    return n, mix(node, n.astype(np.uint64)).view(np.int64)


#: 64-bit words of a bitmap.
MAPS = 8


def _bitmaps(row: np.ndarray, s: np.ndarray, count: int) -> np.ndarray:
    """Parities of each row's shingles by 9 bits of hash: count x MAPS int64."""
    bits = 64 * MAPS
    odd = (np.bincount(row * bits + (s >> U64(64 - 9)).astype(np.int64), minlength=count * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(count, bits), axis=1).view(np.int64)


_SHINGLED = "kind int, doc_id long, key long, n int, node long, " + ", ".join(f"m{i} long" for i in range(MAPS)) + ", shard int, flush long, a binary, b binary"


def _filled(columns: dict[str, pa.Array], size: int) -> pa.RecordBatch:
    """A batch of _SHINGLED: the given columns, nulls in the others."""
    types = {"kind": pa.int32(), "n": pa.int32(), "shard": pa.int32(), "a": pa.binary(), "b": pa.binary()}
    names = [x.split()[0] for x in _SHINGLED.split(", ")]
    return pa.record_batch([columns[c] if c in columns else pa.nulls(size, types.get(c, pa.int64())) for c in names], names)


def suffix_filter(x: np.ndarray, y: np.ndarray, need: int, depth: int = 3) -> bool:
    """Whether sorted sets may share ``need`` elements, by halving both at a common value: sums of lesser halves."""
    if depth == 0 or len(x) < 8 or len(y) < 8:
        return min(len(x), len(y)) >= need

    def bound(a: np.ndarray, b: np.ndarray, d: int) -> int:
        if d == 0 or not len(a) or not len(b):
            return min(len(a), len(b))
        i = len(a) // 2
        j = int(np.searchsorted(b, a[i]))
        return bound(a[:i], b[:j], d - 1) + bound(a[i:], b[j:], d - 1)

    return bound(x, y, depth) >= need


def text_key(text: Column) -> Column:
    """What tells texts of one doc_id, or without one, apart."""
    return F.xxhash64(text)


#: A key is hot from this many rows on, and with a HOT_PART-th of all rows.
HOT_ROWS, HOT_PART = 1000, 1000
#: Rounds after the first: one pivot per bucket in all but the last, which pairs what is left across components.
PIVOTS = 4
#: First prefix shingles of a node by which the last round makes a pair at one shingle only.
EARLY = 32
#: Shingles that a task holds before it sends them off.
FLUSH = 1_200_000
#: Bits dropped from a shingle's hash in a token. Two shingles of one token only make candidates that verification drops.
SHORT = U64(16)


def beside(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """rows joined with found (one row a key, ``rows``: how many rows have it). Keys with a HOT_PART-th of all rows or more,
    HOT_PART at most, are broadcast, so that no frequent key is one task."""
    found = stash(found, "beside")
    total = found.agg(F.sum("rows")).first()[0] or 0
    hot = F.col("rows") >= max(HOT_ROWS, total // HOT_PART)
    few, rest = F.broadcast(found.where(hot)), found.where(~hot)
    if total < HOT_ROWS:
        return rows.join(rest, key)
    return rows.join(few, key).unionByName(rows.join(F.broadcast(found.where(hot).select(key)), key, "left_anti").join(rest, key))


class JaccardJoin:
    def __init__(self, docs: DataFrame, words: int, per: int):
        self.words, self.per = words, per
        self.spark = docs.sparkSession
        arrow_batches(self.spark)
        text = F.col("text").cast("string")
        self.shards = shards_for(docs, 6_000_000)
        self.docs = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text_key(text).alias("key")))

    # -- step 1

    def _shingled(self) -> DataFrame:
        """One pass over the texts, three kinds of rows. Members: every row's doc_id, key of its text, set size n, node and
        bitmap m0... Postings: the tokens of a flush that fall into a shard, with the places of their nodes in the flush
        (equal sets of a flush are one node). Headers: the nodes of a flush and their sizes."""
        words, shards = self.words, self.shards

        def emit(flush: int, tokens: list[np.ndarray], places: list[np.ndarray], nodes: list[np.ndarray], sizes: list[np.ndarray]) -> pa.RecordBatch:
            token, place = np.concatenate(tokens), np.concatenate(places)
            order = np.argsort(token, kind="stable")
            token, place = token[order], place[order].astype(np.uint32)
            rows = [(HEADER, None, pack(np.concatenate(nodes)), pack(np.concatenate(sizes)))]
            rows += [(POSTING, shard, pack(token[own]), pack(place[own])) for shard, own in by_shard(token << SHORT, shards)]
            kind, shard, x, y = zip(*rows, strict=True)
            return _filled({"kind": pa.array(kind, pa.int32()), "shard": pa.array(shard, pa.int32()), "flush": pa.array([flush] * len(rows), pa.int64()), "a": pa.array(x, pa.binary()), "b": pa.array(y, pa.binary())}, len(rows))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            flush = TaskContext.get().partitionId() << 24
            own_caches("jaccard")
            seen: set[int] = set()
            held: tuple[list, list, list, list] = ([], [], [], [])
            size = 0
            for batch in batches:
                row, s = shingle_sets(utf8(batch.column(1)), words)
                n, node = _nodes(row, s, len(batch))
                maps = _bitmaps(row, s, len(batch))
                yield _filled({"kind": pa.array(np.full(len(batch), MEMBER, np.int32)), "doc_id": batch.column(0), "key": batch.column(2), "n": pa.array(n.astype(np.int32)), "node": pa.array(node), **{f"m{i}": pa.array(maps[:, i].copy()) for i in range(MAPS)}}, len(batch))
                place = np.full(len(batch), -1, np.int64)
                for i in np.sort(np.unique(node, return_index=True)[1]).tolist():
                    if n[i] and (x := int(node[i])) not in seen:
                        place[i] = len(seen)
                        seen.add(x)
                new = np.flatnonzero(place >= 0)
                if len(new):
                    use = place[row] >= 0
                    for part, x in zip(held, (s[use] >> SHORT, place[row[use]], node[new], n[new].astype(np.int32)), strict=True):
                        part.append(x)
                    size += int(use.sum())
                if size >= FLUSH:
                    yield emit(flush, *held)
                    flush, seen, held, size = flush + 1, set(), ([], [], [], []), 0
            if seen:
                yield emit(flush, *held)

        return self.docs.mapInArrow(run, _SHINGLED)

    def _answers(self):
        """A shard's postings: the tokens that several nodes have, back to their flushes, each with the class of its exact
        frequency."""

        def reduce(shard: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
            tokens = [unpack(x, np.uint64) for x in rows["a"].to_pylist()]
            places = [unpack(x, np.uint32) for x in rows["b"].to_pylist()]
            token, place = np.concatenate(tokens), np.concatenate(places)
            source = np.repeat(np.arange(len(tokens), dtype=np.int32), [len(x) for x in tokens])
            del tokens, places
            order = np.argsort(token, kind="stable")
            token = token[order]
            cut = grouped(token)
            size = np.diff(np.append(cut, len(token)))
            several = np.repeat(size > 1, size)
            level = np.repeat(np.minimum(255, 4 * np.log2(size)).astype(np.uint8), size)[several]
            order, token = order[several], token[several]
            place, source = place[order], source[order]
            again = np.argsort(source, kind="stable")
            flush = rows["flush"].to_pylist()
            out = [(flush[int(source[again[a]])], pack(token[x]), pack(place[x]), pack(level[x])) for a, b in spans(grouped(source[again]), len(again)) for x in (again[a:b],)]
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["flush", "a", "b", "c"])

        return reduce

    def _prefixes(self):
        """A flush's header and answers: token, node, n, pos of the prefix shingles that other nodes have as well. The ones
        that no other has come first in the order; they need no names."""
        per = self.per

        def reduce(flush: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
            cols = [rows[c].to_pylist() for c in "abc"]
            head = next(i for i, c in enumerate(cols[2]) if c is None)
            node, n = unpack(cols[0][head], np.int64), unpack(cols[1][head], np.int32).astype(np.int64)
            token, place, level = (np.concatenate([np.zeros(0, t), *(unpack(x, t) for i, x in enumerate(col) if i != head)]) for col, t in zip(cols, (np.uint64, np.uint32, np.uint8), strict=True))
            order = np.lexsort((token, level, place))
            token, place = token[order], place[order].astype(np.int64)
            known = np.bincount(place, minlength=len(node))
            pos = np.arange(len(place)) - np.repeat(np.cumsum(known) - known, known) + (n - known)[place]
            use = pos < (n - -(-per * n // 100) + 1)[place]
            token, place, pos = token[use], place[use], pos[use]
            for a in range(0, len(token), 1 << 16):
                x, own = slice(a, a + (1 << 16)), place[a : a + (1 << 16)]
                yield pa.record_batch([pa.array(token[x].view(np.int64)), pa.array(node[own]), pa.array(n[own].astype(np.int32)), pa.array(pos[x].astype(np.int32))], ["token", "node", "n", "pos"])

        return reduce

    def _entries(self, shingled: DataFrame) -> DataFrame:
        """token, node, n, pos: prefix shingles that several nodes have, once for each flush with the node."""
        answers = exchange(shingled.where(F.col("kind") == POSTING).select("shard", "flush", "a", "b"), self.shards, self._answers(), "flush long, a binary, b binary, c binary")
        heads = shingled.where(F.col("kind") == HEADER).select("flush", "a", "b", F.lit(None).cast("binary").alias("c"))
        both = heads.unionByName(answers).withColumn("to", F.pmod(F.xxhash64("flush"), F.lit(self.shards)).cast("int"))
        return exchange(both, self.shards, self._prefixes(), "token long, node long, n int, pos int", key="flush", deal="to")

    # -- filters: conditions on two entries of one token

    def _need(self, n1: str, n2: str) -> str:
        """Least number of common shingles of linked sets: ceil(per (n1 + n2) / (100 + per))."""
        return f"(({self.per} * ({n1} + {n2}) + {99 + self.per}) div {100 + self.per})"

    def _may_link(self, a: str, b: str) -> str:
        """Length filter, and positional filter: no more than the lesser places before, this one, the lesser rests."""
        length = f"100 * least({a}n, {b}n) >= {self.per} * greatest({a}n, {b}n)"
        return f"{length} AND least({a}pos, {b}pos) + 1 + least({a}n - {a}pos, {b}n - {b}pos) - 1 >= {self._need(f'{a}n', f'{b}n')}"

    def _bitmaps_allow(self, a: str, b: str) -> str:
        """Bitmap filter: linked sets differ in n1 + n2 - 2 need shingles at most."""
        bits = " + ".join(f"bit_count({a}m{i} ^ {b}m{i})" for i in range(MAPS))
        return f"{bits} <= {a}n + {b}n - 2 * {self._need(f'{a}n', f'{b}n')}"

    # -- verification

    def _sets(self, first: DataFrame) -> DataFrame:
        """node, s (sorted hashes): the sets of some nodes (node, doc_id, key), from one document each: the least doc_id's, or the least text's where no row has one."""
        words = self.words
        wanted = first.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("node").alias("_node"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, s = shingle_sets(utf8(batch.column("text")), words)
                _, node = _nodes(row, s, len(batch))
                right = node == batch.column("_node").to_numpy()  # a doc_id may have several rows
                ends = np.searchsorted(row, np.arange(len(batch)), "right")
                starts = np.searchsorted(row, np.arange(len(batch)), "left")
                at = np.flatnonzero(right)
                yield pa.record_batch([pa.array(node[at]), pa.array([s[a:b].tobytes() for a, b in zip(starts[at], ends[at], strict=True)], pa.binary())], ["node", "s"])

        joined = self.docs.join(wanted, self.docs["doc_id"] == wanted["_id"]).select("_node", "text")
        if self.nameless:
            texts = self.docs.where("doc_id IS NULL").groupBy("key").agg(F.first("text").alias("text"))
            joined = joined.union(texts.join(wanted.where("_id IS NULL"), texts["key"] == wanted["_key"]).select("_node", "text"))
        return joined.mapInArrow(run, "node long, s binary").dropDuplicates(["node"])

    def _verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) that link."""
        per = self.per

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    need = -(-per * (len(x) + len(y)) // (100 + per))
                    ok = suffix_filter(x, y, need)
                    if ok:
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        ok = 100 * both >= per * (len(x) + len(y) - both)
                    keep.append(ok)
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
        return joined.mapInArrow(run, "a long, b long")

    # -- all of it

    def links(self) -> tuple[DataFrame, DataFrame]:
        """(stashed members doc_id, key, n, node; links a, b between nodes that give the right components)."""
        maps = [f"m{i}" for i in range(MAPS)]
        shingled = stash(self._shingled(), "shingled")
        members = shingled.where(F.col("kind") == MEMBER).select("doc_id", "key", "n", "node", *maps)
        self.nameless = not members.where("n > 0 AND doc_id IS NULL").limit(1).isEmpty()
        entries = stash(self._entries(shingled), "prefixes")
        pivots = entries.groupBy("token").agg(F.count("*").alias("rows"), F.min(F.struct("node", "n", "pos")).alias("p"), F.max("node").alias("most")).where("p.node != most").drop("most")
        shared = beside(entries, pivots, "token").select("token", "node", "n", "pos", F.col("p.node").alias("pnode"), F.col("p.n").alias("pn"), F.col("p.pos").alias("ppos"))
        shared = stash(shared, "shared-prefixes")
        discard(entries)
        if shared.limit(1).isEmpty():
            return members, shared.select(F.col("node").alias("a"), F.col("pnode").alias("b"))
        star = shared.where("node != pnode").where(self._may_link("", "p")).select(F.col("pnode").alias("a"), F.col("node").alias("b")).distinct()
        asked = shared.select("node").distinct()  # only nodes that share a prefix shingle are looked at again
        # copies are counted before they meet: a node that a third of all rows have is a row of each task
        single = members.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min(F.expr("if(doc_id IS NULL, key, NULL)")).alias("key"), F.first("n").alias("n"), *(F.first(m).alias(m) for m in maps))
        nodes = stash(single.join(asked, "node", "left_semi"), "nodes")
        first = nodes.select("node", "doc_id", "key")

        def side(name: str) -> DataFrame:
            return nodes.select(F.col("node").alias(name), F.col("n").alias(f"{name}_n"), *(F.col(m).alias(f"{name}_{m}") for m in maps))

        pairs = star.join(side("a"), "a").join(side("b"), "b").where(self._bitmaps_allow("a_", "b_")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        tried = stash(pairs, "pairs")
        links = self._checked(tried, first)
        # buckets of more than two nodes may hold pairs without the pivot
        several = shared.where("node != pnode").groupBy("token").agg(F.count("*").alias("rows"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi").select("token", "rows")
        open_ = beside(shared, several, "token").select("token", "node", "n", "pos").distinct().join(nodes.select("node", *maps), "node")
        held = [shared]
        for turn in range(PIVOTS):
            found = components(links)
            last = turn == PIVOTS - 1
            open_ = stash(self._across(open_.drop("component"), found), "open")
            discard(found, *held)
            held = [open_]
            if open_.limit(1).isEmpty():
                break
            cols = ["node", "n", "pos", "component", *maps]
            if last:
                # at each pair's first common shingle only, where both have it early: else it is made once for every one they share
                first_ones = open_.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("e")).select("node", F.slice(F.transform("e", lambda e: e["token"]), 1, EARLY).alias("early"))
                open_, cols = open_.join(stash(first_ones, "early"), "node"), [*cols, "early"]
            x = open_.select("token", *(F.col(c).alias(f"x_{c}") for c in cols))
            if last:
                y = open_.select("token", *(F.col(c).alias(f"y_{c}") for c in cols))
                both = x.join(y, "token").where("x_node < y_node")
            else:
                if turn:  # nodes that agree on the least shingle by another hash are more alike: a part of a bucket has its own pivot
                    picks = open_.groupBy("node").agg(F.min(F.xxhash64("token", F.lit(turn))).alias("pick"))
                    open_ = open_.join(picks, "node").withColumn("part", F.xxhash64("token", "pick")).drop("pick")
                    x = x.join(picks.withColumnRenamed("node", "x_node"), "x_node").withColumn("part", F.xxhash64("token", "pick")).drop("pick")
                else:
                    open_, x = open_.withColumn("part", F.col("token")), x.withColumn("part", F.col("token"))
                y = open_.groupBy("part").agg(F.count("*").alias("rows"), F.min(F.struct(F.xxhash64("node", "token", F.lit(turn)), *cols)).alias("p"))
                both = beside(x, y.select("part", "rows", *(F.col(f"p.{c}").alias(f"y_{c}") for c in cols)), "part")
                open_ = open_.drop("part")
            both = both.where(f"x_component != y_component AND {self._may_link('x_', 'y_')} AND {self._bitmaps_allow('x_', 'y_')}" + last * " AND coalesce(get(array_intersect(x_early, y_early), 0), token) = token")
            pairs = both.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()
            pairs = stash(pairs.join(tried, ["a", "b"], "left_anti"), "pairs-across")
            more = self._checked(pairs, first)
            links, old = stash(links.union(more), "links-all"), (links, more)
            tried, own = stash(tried.union(pairs), "tried") if not last else tried, (tried, pairs)
            discard(*{id(x): x for x in (*old, *own) if hasattr(x, "stash_path")}.values())
        discard(*held, nodes)
        return members, links

    @staticmethod
    def _across(entries: DataFrame, found: DataFrame) -> DataFrame:
        """Entries with the component of their node, of those buckets that hold several components."""
        own = entries.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = own.groupBy("token").agg(F.count("*").alias("rows"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("token", "rows")
        return beside(own, mixed, "token").drop("rows")

    def _checked(self, pairs: DataFrame, first: DataFrame) -> DataFrame:
        """The pairs that link, as a stashed table."""
        if pairs.limit(1).isEmpty():
            return pairs
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        wanted = stash(first.join(wanted, "node"), "wanted")  # its size is known now: Spark broadcasts it while it is small
        sets = stash(self._sets(wanted), "sets")
        discard(wanted)
        links = stash(self._verified(pairs, sets), "links")
        discard(sets)
        return links

    def placed(self) -> DataFrame:
        """doc_id, key, n_shingles, node of every row and the least (none, doc_id, key) of its component; null for rows without
        shingles. Leasts are found over nodes, and joined so that no group of copies is one task."""
        members, links = self.links()
        found = components(links)
        named = members.where("n > 0").groupBy("node").agg(F.count("*").alias("rows"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("own"))
        named = stash(named.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "named")
        joined = named.where("component != node").select("component").distinct()  # components of several nodes
        least = named.join(joined, "component", "left_semi").groupBy("component").agg(F.min("own").alias("least"))
        known = stash(named.join(least, "component", "left").select("node", "rows", F.coalesce("least", "own").alias("least")), "least")
        rows = members.select("doc_id", "key", F.col("n").alias("n_shingles"), "node")
        real = beside(rows.where("n_shingles > 0"), known, "node")
        none = rows.where("n_shingles = 0").withColumn("least", F.lit(None).cast(known.schema["least"].dataType))
        cols = ["doc_id", "key", "n_shingles", "node", "least"]
        return real.select(cols).union(none.select(cols))

    def groups(self) -> DataFrame:
        """doc_id, n_shingles, component_id of every row."""
        return self.placed().select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"))


def group_documents(docs: DataFrame, words: int = 5, per: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    return JaccardJoin(docs, words, per).groups()


def one_of_each(docs: DataFrame, words: int = 5, per: int = 80) -> DataFrame:
    """docs without near duplicates, all columns: of each group one text stays, that with the least doc_id (null last; of
    several, the least key), in one row. A text of no shingles stays, once for each doc_id, every time without one."""
    placed = stash(JaccardJoin(docs, words, per).placed(), "groups")
    gone = placed.where("n_shingles > 0 AND NOT (doc_id <=> least.doc_id AND key = least.key)").select("doc_id", "key").distinct()
    own = docs.withColumn("_text_key", text_key(F.col("text").cast("string")))

    def same(texts: DataFrame) -> Column:
        return own["doc_id"].cast("long").eqNullSafe(texts["doc_id"]) & (own["_text_key"] == texts["key"])

    again = placed.where("n_shingles > 0 OR doc_id IS NOT NULL").groupBy("doc_id", "key").count().where("count > 1").select("doc_id", "key")
    if again.limit(1).isEmpty():
        return own.join(gone, same(gone), "left_anti").drop("_text_key")
    again = stash(again, "again")
    either = gone.union(again)
    once = own.join(either, same(either), "left_anti")
    several = again.join(gone, again["doc_id"].eqNullSafe(gone["doc_id"]) & (again["key"] == gone["key"]), "left_anti")
    return once.unionByName(own.join(several, same(several), "left_semi").dropDuplicates(["doc_id", "_text_key"])).drop("_text_key")
