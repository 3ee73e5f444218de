r"""Prefix trie of conversations, built level by level: how many conversations share a beginning, and what sharing it would save.

Going down, each level groups the live conversations by (the node they are in, their next turn); a group is a node, named by its
depth and its least conv_id. A conversation that has a node to itself is no longer live: the rest of it is a chain that its
length alone tells. So levels end where no two conversations share anything more. Going up, level by level, nodes send their
leaves and savings to their parents by a join.

Texts stay where they are read: turns are known by 128-bit digests of role and text, with their words counted beside. Groups are
counted before they are shuffled, so that a beginning that a third of all conversations have is one row of each task; members find
their group by a join whose large side Spark may split. Ids that end at one node are joined to pieces of text where ranges of
(node, id) put them, and only pieces meet for a node's digest, which is taken as they pass. Each level is written to the shared folder.

Rebuilding: conversation c's first h turns are those of conversation c - c mod 20 (c mod 20 from 0 to 19, for negative ids, too), h = crc32
of its decimal id mod 4; then follow its own turns after its first h.

Nulls: a null role or text is empty, a null turn comes first; rows without conv_id take no part. Equal turns are ordered by their
digest; repeated rows are turns of their own. An empty table (or one without ids) has no node, not even a root. Other columns are
ignored. Very long texts are digested where they are read; one conversation's turns, narrow rows, are numbered in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provenlake.llm.common import discard, stash, tuned

WORD = r"[^\x20\x09-\x0D]+"
FAMILY, HEADS = 20, 4  # conversations that may share their first turns; h is less than HEADS
#: Characters of a piece of joined ids.
PIECE = 1 << 16


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), key (a digest of role and text), words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("key"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    own = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "key")
    return rows.select("conv_id", (F.row_number().over(own) - 1).alias("place"), "key", "words")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length) of rebuilt conversations and their turns (conv_id, depth from 1, key, words), of turns' rows."""
    base = F.expr(f"try_subtract(conv_id, pmod(conv_id, {FAMILY}L))")
    heads = own.filter((F.pmod("conv_id", F.lit(FAMILY)) == 0) & (F.col("place") < HEADS - 1))
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("place", "key", "words"))).alias("head"))  # three at most
    ids = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumns({"base": base, "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS})
    ids = ids.join(heads, "base", "left").select("conv_id", "n", "h", F.coalesce(F.slice("head", 1, F.col("h").cast("int")), F.array()).alias("head"))
    first = F.size("head").cast("long")
    lengths = ids.select("conv_id", (first + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length"))
    shared = ids.select("conv_id", F.explode("head").alias("x")).select("conv_id", (F.col("x.place") + 1).cast("long").alias("depth"), "x.key", "x.words")
    rest = own.join(ids.select("conv_id", "h", first.alias("first")), "conv_id").filter(F.col("place") >= F.col("h"))
    rest = rest.select("conv_id", (F.col("first") + F.col("place") - F.col("h") + 1).alias("depth"), "key", "words")
    return lengths, shared.unionByName(rest)


# -- down ---------------------------------------------------------------------------------------------------------------


def _levels(lengths: DataFrame, rows: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """(nodes of each level, members of each level's shared nodes), from the root on; all stashed.

    Nodes: conv_id, parent_conv_id, n_convs, words (of the last turn). Members: conv_id, node, length."""
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    nodes = [stash(root.select("conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.lit(0).cast("long").alias("words")), "trie-nodes")]
    top = nodes[0].first()
    if top is None:
        return nodes, []
    members = [stash(lengths.select("conv_id", F.lit(top.conv_id).alias("node"), "length"), "trie-members")] if top.n_convs > 1 else []
    while members and len(members) == len(nodes):
        depth = len(nodes)
        live = members[-1].filter(F.col("length") >= depth).join(rows.filter(F.col("depth") == depth).select("conv_id", "key", "words"), "conv_id")
        live = stash(live, "trie-live")
        groups = stash(live.groupBy("node", "key").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words")), "trie-groups")
        nodes.append(groups.select("conv_id", F.col("node").alias("parent_conv_id"), "n_convs", "words"))
        shared = groups.filter("n_convs > 1")
        if not shared.isEmpty():
            met = live.select("conv_id", "node", "key", "length").join(shared.select("node", "key", F.col("conv_id").alias("head")), ["node", "key"])
            members.append(stash(met.select("conv_id", F.col("head").alias("node"), "length"), "trie-members"))
        discard(live)
    return nodes, members


# -- up -----------------------------------------------------------------------------------------------------------------


def _totals(nodes: list[DataFrame]) -> list[DataFrame]:
    """Each level's nodes with children (of shared nodes: those met so far), n_leaves and saved_tokens, from the root on; stashed."""
    out: list[DataFrame] = []
    for level in reversed(nodes):
        own = level.withColumn("own", (F.col("n_convs") - 1) * F.col("words"))
        if out:
            sent = out[-1].groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            own = own.join(sent, "conv_id", "left")
        else:
            own = own.withColumns({c: F.lit(None).cast("long") for c in ("children", "leaves", "saved")})
        own = own.select("conv_id", "parent_conv_id", "n_convs", F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"), (F.col("own") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"))
        out.append(stash(own, "trie-totals"))
    return out[::-1]


# -- ends ---------------------------------------------------------------------------------------------------------------


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, node, conv_id): each run of a node as pieces of its joined ids."""
    at, first, held, size = None, 0, [], 0

    def cut() -> pa.RecordBatch:
        return pa.record_batch([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([first], pa.int64()), pa.array([",".join(held)], pa.string())], ["depth", "node", "first", "ids"])

    for batch in batches:
        for depth, node, c in zip(*(batch.column(k).to_pylist() for k in ("depth", "node", "conv_id")), strict=True):
            if held and ((depth, node) != at or size >= PIECE):
                yield cut()
                held, size = [], 0
            if not held:
                at, first = (depth, node), c
            held.append(str(c))
            size += len(held[-1]) + 1
    if held:
        yield cut()


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, node, first, ids): a node's pieces as one digest."""
    at, sha, out = None, None, []

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"depth": d, "node": n, "sha": s} for d, n, s in out], pa.schema([("depth", pa.int64()), ("node", pa.int64()), ("sha", pa.string())]))

    for batch in batches:
        for depth, node, ids in zip(*(batch.column(k).to_pylist() for k in ("depth", "node", "ids")), strict=True):
            if (depth, node) == at:
                sha.update(b",")
            else:
                if at is not None:
                    out.append((*at, sha.hexdigest()))
                at, sha = (depth, node), hashlib.sha256()
            sha.update(ids.encode())
        if len(out) >= 1024:
            yield flush()
            out = []
    if at is not None:
        out.append((*at, sha.hexdigest()))
    yield flush()


def _ends(members: list[DataFrame]) -> DataFrame | None:
    """depth, node, sha: the digest of the ids that end at each shared node where any do."""
    ended = None
    for depth, own in enumerate(members):
        own = own.filter(F.col("length") == depth).select(F.lit(depth).cast("long").alias("depth"), "node", "conv_id")
        ended = own if ended is None else ended.unionByName(own)
    if ended is None:
        return None
    pieces = ended.repartitionByRange("depth", "node", "conv_id").sortWithinPartitions("depth", "node", "conv_id").mapInArrow(_pieces, "depth long, node long, first long, ids string")
    return pieces.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(_digests, "depth long, node long, sha string")


def build(conversations: DataFrame) -> DataFrame:
    """The trie's nodes: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark: SparkSession = conversations.sparkSession
    with tuned(spark):
        own = stash(turns(conversations), "trie-turns")
        lengths, rows = rebuilt(own)
        lengths, rows = stash(lengths, "trie-lengths"), stash(rows, "trie-rows")
        discard(own)
        nodes, members = _levels(lengths, rows)
        totals = _totals(nodes)
    levels = None
    for depth, own in enumerate(totals):
        own = own.withColumn("depth", F.lit(depth).cast("long"))
        levels = own if levels is None else levels.unionByName(own)
    none, alone = F.lit(hashlib.sha256().hexdigest()), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)
    shared = levels.filter("n_convs > 1")
    ended = _ends(members)
    sha = F.coalesce("sha", none) if ended is not None else none
    if ended is not None:
        shared = shared.join(ended.withColumnRenamed("node", "conv_id"), ["conv_id", "depth"], "left")
    shared = shared.select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("children").alias("n_children"), "n_leaves", "saved_tokens", sha.alias("ends_sha256"))
    # A node that a conversation has to itself, and the chain below it.
    chains = levels.filter("n_convs = 1").join(lengths, "conv_id").select("conv_id", "depth", "parent_conv_id", "length", F.explode(F.sequence("depth", "length")).alias("at"))
    one = F.lit(1).cast("long")
    chains = chains.select(
        "conv_id", F.col("at").alias("depth"), F.when(F.col("at") == F.col("depth"), F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one.alias("n_convs"),
        F.when(F.col("at") < F.col("length"), 1).otherwise(0).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("at") == F.col("length"), alone).otherwise(none).alias("ends_sha256"),
    )
    return shared.unionByName(chains)
