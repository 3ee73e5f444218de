"""Repair of conversations (operator 11) against enumeration of all edit scripts, and against a row-by-row version in Python."""

import hashlib
import itertools
import random
import zlib

import pytest

from provenlake.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, pos int, letter string, audit string"
LAWFUL = __import__("re").compile(r"(s?(ua)+)?")


def scripts(rows):
    """Every script with at most one cycle of inserts at a place, as (cost, letters, out): rows are (role, text, fault)."""
    out = [(0, "", ())]
    fills = [(), *itertools.product(["user", "assistant"], repeat=1), *itertools.product(["user", "assistant"], repeat=2)]

    def filled(found):
        return [(c + 3 * len(f), a + "I" * len(f), o + tuple((r, "") for r in f)) for c, a, o in found for f in fills]

    for role, text, fault in rows:
        out = filled(out)
        step = [(c + 4, a + "D", o) for c, a, o in out]
        if fault not in ("blank", "duplicate"):
            more = 3 if fault == "truncated" else 0
            step += [(c + more, a + "K", (*o, (role, text))) for c, a, o in out]
            step += [(c + 3 + more, a + "R", (*o, (r, text))) for c, a, o in out for r in ("user", "assistant")]
        out = step
    return [x for x in filled(out) if all(r for r, _ in x[2]) and LAWFUL.fullmatch("".join(r[:1] for r, _ in x[2]))]


def cheapest(rows):
    """(cost, letters, out), by costs to go and then the least letter at each step: independent of any layer from the front."""
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    n, big = len(rows), 10**9
    go = [dict.fromkeys(follow, big) for _ in range(n + 1)]

    def ways(i, at):
        found = [("I", i, follow[at], 3, ({"u": "user", "a": "assistant"}[follow[at]], ""))]
        if i < n:
            role, text, fault = rows[i]
            found.append(("D", i + 1, at, 4, None))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                new = {"u": "user", "a": "assistant"}[follow[at]]
                found.append(("R", i + 1, follow[at], 3 + more, (new, text)))
                k = role[:1]
                if k and (k == follow[at] or (k == "s" and at == "")):
                    found.append(("K", i + 1, k, more, (role, text)))
        return found

    for i in range(n, -1, -1):
        if i == n:
            go[i][""] = go[i]["a"] = 0
        for _ in range(4):
            for at in follow:
                go[i][at] = min([go[i][at], *(c + go[j][to] for _, j, to, c, _ in ways(i, at))])
    i, at, letters, out = 0, "", "", []
    left = go[0][""]
    while i < n or left:
        letter, i, at, cost, new = min(w for w in ways(i, at) if w[3] + go[w[1]][w[2]] == left)
        letters, left = letters + letter, left - cost
        if new:
            out.append(new)
    return go[0][""], letters, tuple(out)


def brute(conversations):
    groups = {}
    one = lambda x: " " if x is None else str(x)
    for c, t, role, text in conversations:
        kind = zlib.crc32(f"{one(c)}:{one(t)}".encode()) % 20
        role, text = one(role), one(text)
        text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
        groups.setdefault(c, []).extend([(t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    out = {}
    for c, rows in groups.items():
        rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        seen, own = set(), []
        for _, role, text in rows:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            own.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""))
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        count = lambda k, own=own: sum(f == k for _, _, f in own)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, kept = cheapest(own)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps if gaps < 1 << 63 else None, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, sha)
    return out


def conversations(seed=5, n=150):
    r, rows = random.Random(seed), []
    lines = ["Yes.", "No!", "What?", "cut", " ", "", None, "\t\n", "Tail. \n", "é ends", "(ok.)", "\xa0", "a" * 40 + "."]
    for c in range(n):
        for t in range(r.choice([0, 1, 2, 3, 5, 8, 13])):
            rows.append((c - 3, r.choice([t, t, t, 2 * t, None]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), r.choice(lines) if r.random() < 0.5 else f"text {r.randint(0, 9)}."))
    rows += [(None, 0, "user", "No one."), (None, 1, "assistant", "Here."), (n, None, None, None), (n + 1, -(1 << 63), "user", "a."), (n + 1, (1 << 63) - 1, "assistant", "b.")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*x, 1, "x", "y") for x in rows], SCHEMA)


@pytest.mark.parametrize("seed", range(3))
def test_trie_is_every_script(seed):
    r = random.Random(seed)
    kinds = [(role, f"t{i}.", f) for i, role in enumerate(["user", "assistant", "system", "x"]) for f in ("", "truncated", "blank")]
    letter = lambda role, fault: "d" if fault == "blank" else (role[0] if role[0] in "sua" else "o").upper() if fault else (role[0] if role[0] in "sua" else "o")
    cases = [[]] + [[r.choice(kinds) for _ in range(r.randint(1, 3))] for _ in range(60)]
    trie = repair.Trie()
    for rows in sorted(cases, key=lambda x: [letter(a, f) for a, _, f in x]):
        cost, audit, out = min(scripts(rows), key=lambda x: x[:2])
        assert trie.solve("".join(letter(a, f) for a, _, f in rows)) == (cost, audit)
        assert cheapest(rows) == (cost, audit, out)


def test_layers_are_shared():
    """A layer for each node of the trie, not for each letter; long signatures cost no more a letter."""
    signatures = sorted("".join(x) for x in itertools.product("usa", repeat=5))
    trie = repair.Trie()
    for x in signatures:
        trie.solve(x)
    assert trie.layers == len({x[:k] for x in signatures for k in range(6)})
    cost, audit = repair.Trie().solve("ua" * 50_000 + "A")
    assert (cost, audit) == (4, "K" * 100_000 + "D")


def test_digest_is_brute_force(spark):
    rows = conversations()
    got = {r.conv_id: tuple(r)[1:] for r in repair.digest(frame(spark, rows).repartition(3)).collect()}
    assert got == brute(rows)


def test_repaired_rows(spark):
    rows = conversations(8, 40)
    out = {}
    for r in repair.repaired(frame(spark, rows)).orderBy("conv_id", "turn").collect():
        out.setdefault(r.conv_id, []).append((r.role, r.text))
    want = brute(rows)
    for c, kept in out.items():
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in kept).encode()).hexdigest() == want[c][-1]
        assert LAWFUL.fullmatch("".join(a[:1] for a, _ in kept))


def test_empty_dropped_and_long(spark):
    none = repair.digest(frame(spark, []))
    assert none.count() == 0 and none.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    gone = next(c for c in range(10**6) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    whole = next(c for c in range(10**6) if zlib.crc32(f"{c}:0".encode()) % 20 > 4)
    long = "very long text " * 2_400_000 + "."  # 36 MB: more than a batch of Arrow's
    rows = [(gone, 0, "user", "dropped."), (whole, 0, "user", long)]
    assert {r.conv_id: tuple(r)[1:] for r in repair.digest(frame(spark, rows)).collect()} == brute(rows)


def test_hot_signature_and_long_conversation(spark):
    """Most conversations have one signature, and one conversation has most rows."""
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"said {c} {t}.") for c in range(400) for t in range(2)] + [(1000, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for t in range(1500)]
    assert {r.conv_id: tuple(r)[1:] for r in repair.digest(frame(spark, rows)).collect()} == brute(rows)
