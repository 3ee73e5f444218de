r"""Repair of conversation structure: the cheapest edits that make a conversation's roles lawful, by dynamic programming over a trie.

A conversation's rows become a *signature*, one letter a row that says what the costs depend on: the role's initial (s, u, a,
or o for any other), in upper case where the text is cut off, and d where the row has to go. Signatures are dealt out by ranges
and sorted, which is the order in which a walk through their prefix trie meets them: a task keeps the layers of the current
path, goes back to where the next signature leaves it, and computes layers for what is new only. A layer holds, for each of the
four states (nothing yet, after s, after u, after a), the cheapest cost of the rows so far and what decides ties; a terminal
node gives its answer to every conversation that ends there. Conversations of one signature may spread over several tasks (ranges
are cut by conv_id, too), so a signature that a third of all conversations have is no hot key.

Ties: of the cheapest edits the one whose letters are least in ASCII. Letters D, K, R lead from a state and a row to one state
each, I from a state to one, so letters alone say which roles come out. Two scripts that have consumed the same rows with a
row's letter last are never prefixes of each other, so a rank among the four states and the inserts since are all that a layer
needs to compare them: costs do not grow with a conversation's length.

Nulls: in conv_id, turn, role and text stand for one space (in the key that chooses the damage, and as role and text); rows
without conv_id are one conversation; a null turn comes first and counts in no gap. Equal turns are ordered by role, then text.
A role whose first character is not s, u or a (an empty one, too) cannot be kept. An empty table gives no rows; a conversation
whose rows are all dropped gives zeros, an empty audit and the digest of nothing. Other columns are ignored. Texts, however
long, are looked at one row at a time; of a conversation, a letter for each row is held in one place, never its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenlake.llm.common import arrow_batches, stash, tuned

#: The six bytes that are no part of a word.
SPACE = " \t\n\x0b\x0c\r"
DELETE, REROLE, INSERT, CUT_OFF = 4, 3, 3, 3
ROLES = {"u": "user", "a": "assistant"}

# -- damage and faults: DataFrame functions --------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, alive: a fifth of all rows damaged, as crc32 of ``conv_id:turn`` says. Dropped rows stay, without
    text, as alive = false: their conversation is still to be answered for."""
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(own("conv_id"), F.lit(":"), own("turn")).cast("binary")) % 20
    text = F.when(kind <= 1, "").when(kind == 2, F.translate(own("text"), ".!?", "")).otherwise(own("text"))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(own("role")).alias("role"),
        text.alias("text"),
        (kind != 0).alias("alive"),
        F.explode(F.array_repeat(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("_"),
    ).drop("_")


def _letter(initial: Column, fault: Column, cut: Column) -> Column:
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return F.when(fault.isin("blank", "duplicate"), "d").when(cut, F.upper(kind)).otherwise(kind)


def faults(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, alive) with pos (place among the conversation's live rows, from 0), fault, letter, illegal
    (the row's initial may not follow the one before) and fresh (the first row of a turn that is not null)."""
    order = [F.col("alive").desc(), F.col("turn").asc_nulls_first(), "role", "text"]
    own, same = Window.partitionBy("conv_id").orderBy(*order), Window.partitionBy("conv_id", "alive", "role", "text").orderBy("turn")
    end = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    initial, live = F.substring("role", 1, 1), F.col("alive")
    rows = rows.withColumns({"pos": F.row_number().over(own) - 1, "before": F.lag(initial).over(own), "turn_before": F.lag("turn").over(own)})
    rows = rows.withColumn("nth", F.row_number().over(same))
    fault = F.when(end == "", "blank").when(F.col("nth") > 1, "duplicate").when(~end.isin(".", "!", "?"), "truncated")
    rows = rows.withColumn("fault", F.when(live, fault))
    return rows.select(
        "conv_id", "turn", "role", "text", "alive", "pos", "fault",
        F.when(live, _letter(initial, F.coalesce("fault", F.lit("")), F.coalesce(F.col("fault") == "truncated", F.lit(False)))).alias("letter"),
        (live & F.col("before").isNotNull() & ~F.concat("before", initial).isin("su", "ua", "au")).alias("illegal"),
        (live & F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before"))).alias("fresh"),
    )


def signatures(rows: DataFrame) -> DataFrame:
    """One row a conversation: its counts and its signature. gaps is null where it is no long."""
    live, count = F.col("alive"), lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    wide = lambda c: F.when(live, F.col(c)).cast("decimal(20,0)")
    gaps = F.max(wide("turn")) - F.min(wide("turn")) + F.lit(1) - F.sum(F.col("fresh").cast("int"))
    return rows.groupBy("conv_id").agg(
        F.when(F.max(F.when(live, F.col("turn"))).isNull(), F.lit(0).cast("long")).otherwise(F.expr("null")).alias("none"),
        gaps.alias("wide"),
        *[count(live & F.col("fault").eqNullSafe(k)).alias(k) for k in ("blank", "duplicate", "truncated")],
        count(F.col("illegal")).alias("illegal"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(live, F.struct("pos", "letter")))), lambda x: x["letter"]), "").alias("signature"),
    ).select("conv_id", F.coalesce("none", F.expr("try_cast(wide as long)")).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "signature")


# -- dynamic programming over the trie --------------------------------------------------------------------------------

#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. What an insert or a new role leads to, and the accepting ones.
FOLLOW, DONE = (2, 2, 3, 2), (0, 3)
#: Where keeping a row of some initial leads to.
KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "o": {}}
#: (state, inserts) from which a state is reached by inserts alone; more of them would come back to where they were.
FILLED = [[(0, 0)], [(1, 0)], [(2, 0), (0, 1), (1, 1), (3, 1)], [(3, 0), (2, 1), (0, 2), (1, 2)]]


def _moves(letter: str) -> list[list[tuple[str, int, int]]]:
    """By state: (edit, state that it leads to, cost) of a row."""
    out: list[list[tuple[str, int, int]]] = []
    extra = CUT_OFF if letter.isupper() else 0
    for state in range(4):
        own = [("D", state, DELETE)]
        if letter != "d":
            own.append(("R", FOLLOW[state], REROLE + extra))
            if state in KEEP[letter.lower()]:
                own.append(("K", KEEP[letter.lower()][state], extra))
        out.append(own)
    return out


MOVES = {c: _moves(c) for c in "suaoSUAOd"}


class Layer:
    """A trie node's layer. By state: base (cost, rank, letters since the layer above, state there) of the cheapest edits that end
    with the node's row, and full (cost, rank, inserts, state of base) once inserts may follow; None where there are none."""

    __slots__ = ("base", "full")

    def __init__(self, base: list):
        ranks = {k: i for i, k in enumerate(sorted(b[1:3] for b in base if b))}
        self.base = [b and (b[0], ranks[b[1:3]], *b[2:]) for b in base]
        self.full = [min(((b[0] + INSERT * n, b[1], n, state) for state, n in ways if (b := self.base[state])), default=None) for ways in FILLED]

    @classmethod
    def root(cls) -> Layer:
        return cls([(0, 0, "", None), None, None, None])

    def below(self, letter: str) -> Layer:
        base: list = [None] * 4
        for state, (at, own) in enumerate(zip(self.full, MOVES[letter], strict=True)):
            if at:
                cost, rank, inserts, _ = at
                for edit, to, price in own:
                    found = (cost + price, rank, "I" * inserts + edit, state)
                    if base[to] is None or found < base[to]:
                        base[to] = found
        return Layer(base)


class Trie:
    """The layers on the path to the last signature. Signatures come sorted, so this path is all of the trie that is still needed."""

    def __init__(self):
        self.letters, self.path, self.layers = "", [Layer.root()], 1
        self.answer = self._terminal()

    def solve(self, signature: str) -> tuple[int, str]:
        """(cost, edits) of a signature."""
        if signature == self.letters:
            return self.answer
        shared = next((i for i, (x, y) in enumerate(zip(signature, self.letters, strict=False)) if x != y), min(len(signature), len(self.letters)))
        del self.path[shared + 1 :]
        for letter in signature[shared:]:
            self.path.append(self.path[-1].below(letter))
        self.layers += len(signature) - shared
        self.letters = signature
        self.answer = self._terminal()
        return self.answer

    def _terminal(self) -> tuple[int, str]:
        cost, _, _, state = min((self.path[-1].full[s][:3] + (s,) for s in DONE if self.path[-1].full[s]))
        out = []
        for layer in reversed(self.path):
            _, _, inserts, ended = layer.full[state]
            out.append("I" * inserts)
            own = layer.base[ended]
            out.append(own[2][-1:])
            state = own[3]
        return cost, "".join(reversed(out))


def repairs(found: DataFrame) -> DataFrame:
    """found (conv_id, signature and others) with cost and audit: the cheapest edits' initials."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for batch in batches:
            answers = [trie.solve(x) for x in batch.column("signature").to_pylist()]
            cost, audit = pa.array([c for c, _ in answers], pa.int64()), pa.array([a for _, a in answers], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, cost, audit], [*batch.schema.names, "cost", "audit"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields)
    return found.repartitionByRange("signature", "conv_id").sortWithinPartitions("signature").mapInArrow(run, f"{schema}, cost long, audit string")


# -- repaired conversations -------------------------------------------------------------------------------------------


class Mender:
    """One conversation's rows, in order, as edits leave them."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _new(self) -> tuple[str, str]:
        self.state = FOLLOW[self.state]
        return ROLES["u" if self.state == 2 else "a"]

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._new(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = {"s": 1, "u": 2, "a": 3}[role[0]]
            yield role, text
        elif edit == "R":
            yield self._new(), text


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _met(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows and answers by conversation, the answer first, then the rows in order."""
    answers = found.select("conv_id", F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), *COUNTS, "audit")
    own = rows.filter("alive").select("conv_id", "pos", "role", "text", *[F.lit(None).cast("long").alias(c) for c in COUNTS], F.lit(None).cast("string").alias("audit"))
    return answers.unionByName(own).repartition("conv_id").sortWithinPartitions("conv_id", "pos")


def _walk(batches: Iterable[pa.RecordBatch], begin, row, end) -> Iterator:
    """Yields what begin(answer) -> held, row(held, role, text) and end(held) give for each conversation; the latter two are iterators."""
    held = None
    for batch in batches:
        at, role, text = (batch.column(c).to_pylist() for c in ("pos", "role", "text"))
        for i, pos in enumerate(at):
            if pos >= 0:
                yield from row(held, role[i], text[i])
                continue
            if held is not None:
                yield from end(held)
            held = begin({c: batch.column(c)[i].as_py() for c in ("conv_id", *COUNTS, "audit")})
    if held is not None:
        yield from end(held)


def _batches(rows: Iterator[dict], fields: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    """Rows as batches of 512, or of 16 MB of text."""
    schema, out, size = pa.schema(fields), [], 0
    for x in rows:
        out.append(x)
        size += len(x.get("text", ""))
        if len(out) >= 512 or size >= 1 << 24:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, size = [], 0
    yield pa.RecordBatch.from_pylist(out, schema)


def digest(conversations: DataFrame) -> DataFrame:
    """One row for each conv_id: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows, found = _solved(conversations)

    def begin(answer: dict):
        return answer, Mender(answer["audit"]), hashlib.sha256(), [b""]

    def put(held, pairs: Iterator[tuple[str, str]]) -> Iterator[dict]:
        sha, before = held[2:]
        for role, text in pairs:
            sha.update(before[0] + f"{role}:".encode())
            sha.update(text.encode())
            before[0] = b"\n"
        return iter(())

    def end(held) -> Iterator[dict]:
        put(held, held[1].inserted())
        yield held[0] | {"repaired_sha256": held[2].hexdigest()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("conv_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())]
        yield from _batches(_walk(batches, begin, lambda held, role, text: put(held, held[1].row(role, text)), end), fields)

    arrow_batches(conversations.sparkSession)
    return _met(rows, found).mapInArrow(run, f"conv_id long, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string")


def repaired(conversations: DataFrame) -> DataFrame:
    """The repaired rows themselves: conv_id, turn (from 0), role, text."""
    rows, found = _solved(conversations)

    def put(held, pairs: Iterator[tuple[str, str]]) -> Iterator[dict]:
        for role, text in pairs:
            yield {"conv_id": held[0]["conv_id"], "turn": held[2][0], "role": role, "text": text}
            held[2][0] += 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]
        begin = lambda answer: (answer, Mender(answer["audit"]), [0])
        yield from _batches(_walk(batches, begin, lambda held, role, text: put(held, held[1].row(role, text)), lambda held: put(held, held[1].inserted())), fields)

    arrow_batches(conversations.sparkSession)
    return _met(rows, found).mapInArrow(run, "conv_id long, turn long, role string, text string")


def _solved(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(damaged rows with their places, answers by conversation), both stashed."""
    rows = stash(faults(damaged(conversations)), "repair-rows")
    with tuned(conversations.sparkSession):
        found = stash(repairs(signatures(rows)), "repair-answers")
    return rows, found
