"""Prefix trie of conversations (operator 12) against a trie of tuples in Python."""

import hashlib
import random
import zlib

import pytest

from provenlake.llm import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, node string, key string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(conversations):
    own = {}
    for c, t, role, text in conversations:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    digest = lambda x: hashlib.md5(f"{len(x[2].encode())}:{x[2]}{x[3]}".encode()).digest()
    own = {c: [x[2:] for x in sorted(rows, key=lambda x: (x[:2], digest(x)))] for c, rows in own.items()}
    members = {}
    whole = {}
    for c, rows in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - c % 20, [])[:h] + rows[h:])
        for d in range(len(whole[c]) + 1):
            members.setdefault(whole[c][:d], []).append(c)
    name = {p: min(m) for p, m in members.items()}
    children = {p: 0 for p in members}
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1].encode().split()) if p else 0)
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if whole[c] == p).encode()).hexdigest()
    return sorted((name[p], len(p), name[p[:-1]] if p else None, len(members[p]), children[p], leaves[p], saved[p], ends(p)) for p in members)


def built(spark, rows, parts=3):
    df = conversation_trie.build(spark.createDataFrame([(*x, 1, "x", "y") for x in rows], SCHEMA).repartition(parts))
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=lambda x: (x[0], x[1], x[2] or 0))


def conversations(seed=2, n=130):
    r, rows = random.Random(seed), []
    for c in range(-30, n):
        for t in range(r.choice([0, 1, 2, 3, 4, 6])):
            role = r.choice(["user", "assistant", None, ""])
            rows.append((c, r.choice([t, t, None]), role, r.choice(["a b", "a  b", "c", "", None, "\xa0 x", "many words here\nand there"])))
    rows += [(None, 0, "user", "of no one"), (5, 0, "user", "a b"), (5, 0, "user", "a b"), (-(1 << 63), 0, "user", "least"), (1 << 62, 1, "user", "far")]
    return rows


def test_is_brute_force(spark):
    rows = conversations()
    assert built(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(None, 0, "user", "x")], [(7, 0, "user", "x")], [(7, None, None, None)], [(c, 0, "user", "x") for c in range(50)]])
def test_small(spark, rows):
    assert built(spark, rows) == brute(rows)


def test_hot_beginning_and_long_conversations(spark):
    """Copies of one conversation by the hundred, whose ids go through several pieces; long copies that part late; a very long text."""
    rows = [(c, t, "user", f"turn {t}") for c in range(600) for t in range(3)]
    rows += [(1000 + 20 * c, t, "user", f"turn {t}" if t < 9 else f"{c} at {t}") for c in range(3) for t in range(40)]
    rows += [(2000, 0, "user", "long " * 7_000_000)]
    was, conversation_trie.PIECE = conversation_trie.PIECE, 100
    try:
        assert built(spark, rows) == brute(rows)
    finally:
        conversation_trie.PIECE = was
