"""Each operator against brute force or a library, with nulls, empty and long texts, ties, repeated rows, extra columns."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenlake.llm import bpe, common, cross_polytope, jaccard_join, kneser_ney, packing, quality, rans, suffix_dedup, voronoi_knn, warc

SCHEMA = "doc_id long, text string, shard int, n string"  # two columns with names that operators use themselves


def texts(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["the", "an", "er", "ion", "é", "ß", "th", "qu", "12"]) for _ in range(r.randint(1, 4)))
    line = " ".join(word() for _ in range(30))
    out = [" ".join(word() + r.choice(["", "", ",", ".\n"]) for _ in range(r.randint(1, 120))) for _ in range(40)]
    out += [line + " " + out[0], line + "\n" + out[1], out[2], out[2], out[3] + " end", "", None, " ", "  two  spaces ", "x", "word", "a b", "'s it's 's", "tab\tand\nline ", "ab" * 400, "<|endoftext|> 0 0x0 \n\n", out[5] * 20, "ẞΣς İ 🙂 é"]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "n") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    rows = list(enumerate(texts()))
    return rows, frame(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def odd(spark):
    """A null doc_id, and rows that repeat."""
    rows = [(None, "some words of no one"), (1, "alpha beta gamma delta"), (1, "alpha beta gamma delta"), (2, None), (3, "alpha beta gamma delta")]
    return rows, frame(spark, rows)


def empty(spark):
    return frame(spark, [])


# -- 1


def test_bpe_is_tiktoken(spark, docs, odd):
    import public_tokenizers
    import tiktoken

    path = common.vocabulary("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for rows, df in (docs, odd):
        want = sorted((str(i), len(ids := enc.encode_ordinary(t or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
        assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in bpe.digest(df, path, public_tokenizers.PATTERN).collect()) == want
    assert bpe.digest(empty(spark), path, public_tokenizers.PATTERN).count() == 0


def test_bpe_trees_agree():
    import public_tokenizers

    codec = bpe.codec(common.vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    r = random.Random(1)
    pieces = [bytes(r.choice(b"theandion ") for _ in range(r.randint(2, 60))) for _ in range(200)]
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.merge_short(pieces)] == [codec.merge_long(p) for p in pieces]


# -- 2


def repeats(rows, length):
    seen, out = set(), {}
    for i, t in sorted({(-1 if i is None else i, t or "") for i, t in rows}):
        b = t.encode()
        hit = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                hit[s : s + length] = True
            seen.add(b[s : s + length])
        kept = np.frombuffer(b, np.uint8)[~hit].tobytes()
        spans = int((hit & ~np.concatenate([[False], hit[:-1]])).sum()) if len(b) else 0
        out[i] = (len(b), int(hit.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("length", "anchor", "crowd"), [(20, 8, 8192), (40, 16, 1), (100, 40, 8192)])
def test_repeats_are_exact(spark, docs, odd, length, anchor, crowd):
    for rows, df in (docs, odd):
        got = {(-1 if r.doc_id is None else r.doc_id): tuple(r)[1:] for r in suffix_dedup.digest(df, length, anchor, crowd=crowd).collect()}
        assert got == repeats(rows, length)


def test_repeats_of_nothing_and_of_texts(spark, docs):
    assert suffix_dedup.digest(empty(spark)).count() == 0
    rows, df = docs
    out = suffix_dedup.remove_repeats(df, 40, 16)
    assert out.schema == df.schema and out.count() == len(rows)
    two = frame(spark, [(5, "x" * 50), (5, "y" * 50 + "x" * 50)])  # one doc_id, two texts
    assert sorted(r.n_removed for r in suffix_dedup.digest(two, 40, 16).collect())[1] > 0


def test_repeats_of_several_null_ids(spark):
    """Each text without an id is a document of its own, before those with ids."""
    r = random.Random(6)
    part = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    shared, other = part(60), part(50)
    rows = [(None, shared), (None, shared + part(30)), (None, part(200)), (None, part(45)), (None, None), (None, ""), (None, part(70) + other), (None, shared)]
    rows += [(-3, other + part(20)), (4, part(10) + shared), (4, part(90)), (5, None)]
    for rows in (rows, [x for k, x in enumerate(rows) if k != len(rows) - 2]):  # with and without an id that repeats
        seen, want = {}, {}
        for i, t in sorted({(i, t or "") for i, t in rows}, key=lambda x: (x[0] is not None, x[0] or 0, hashlib.sha256(x[1].encode()).hexdigest())):
            hit = np.zeros(len(t), bool)
            for s in range(len(t) - 39):
                if seen.setdefault(t[s : s + 40], (i, t, s)) != (i, t, s):
                    hit[s : s + 40] = True
            want[i, t] = (len(t), int(hit.sum()), "".join(c for c, h in zip(t, hit, strict=True) if not h))
        df = frame(spark, rows).repartition(3)
        got = sorted((str(x.doc_id), x.n_bytes, x.n_removed, x.kept_sha256) for x in suffix_dedup.digest(df, 40, 16).collect())
        assert got == sorted((str(i), *want[i, t or ""][:2], hashlib.sha256(want[i, t or ""][2].encode()).hexdigest()) for i, t in rows)
        kept = suffix_dedup.remove_repeats(df, 40, 16).collect()
        assert sorted((str(x.doc_id), str(x.text)) for x in kept) == sorted((str(i), str(t if t is None else want[i, t][2])) for i, t in rows)


def test_repeats_keep_clashing_columns_and_large_ids(spark):
    """Columns named as the operator's own keep their values; ids at the ends of the range, repeated and null, overflow nothing."""
    r = random.Random(8)
    part = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    shared = part(60)
    rows = [(2**62 + 5, part(80) + shared, 700, 55, "x", [1, 2]), (2**62 + 5, shared, 701, 56, None, None), (-(2**63), shared + part(9), 702, 57, "z", []), (2**63 - 1, None, 703, 58, "w", [3])]
    rows += [(None, t, 704 + i, 59, "v", [i]) for i, t in enumerate((part(50), shared + "q", part(45)))]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, doc long, kind string, a array<int>").repartition(3)
    out = {x.shard: x for x in suffix_dedup.remove_repeats(df, 40, 16).collect()}
    assert sorted(out) == sorted(x[2] for x in rows) and suffix_dedup.remove_repeats(df, 40, 16).schema == df.schema
    for x in rows:
        assert (out[x[2]].doc_id, out[x[2]].doc, out[x[2]].kind, out[x[2]].a) == (x[0], *x[3:])
    assert out[705].text == shared + "q" and [len(out[k].text) for k in (700, 701, 702)] == [80, 0, 9] and out[703].text is None


def test_index_decides(monkeypatch):
    """Marks come from matching statistics of later fragments against an index of earlier ones."""
    r = random.Random(2)
    part = lambda n: bytes(r.choice(b"ab") for _ in range(n))
    shared = part(30)
    fragments = [part(20) + shared, shared + part(9), part(5) + shared[3:], part(40), shared]
    rank, key = np.array([4, 1, 2, 0, 3]), np.zeros(5, np.uint64)
    want = [[any(w[i : i + 20] in fragments[j] for j in range(5) if rank[j] < rank[k]) for i in range(len(w) - 19)] for k, w in enumerate(fragments)]
    assert [x.tolist() for x in suffix_dedup.repeated_windows(fragments, rank, key, 20)] == want and any(map(any, want))
    nothing = lambda self, patterns, ends, lengths: (np.full(len(patterns), -1), np.full(len(patterns), -1))
    monkeypatch.setattr(suffix_dedup.RunLengthIndex, "statistics", nothing)
    assert not any(x.any() for x in suffix_dedup.repeated_windows(fragments, rank, key, 20))


def marked_by_hand(fragments, rank, length):
    return [[any(rank[j] < rank[k] and w[i : i + length] in x for j, x in enumerate(fragments)) for i in range(len(w) - length + 1)] for k, w in enumerate(fragments)]


def test_index_keeps_fragments_apart():
    """Separators are no bytes and no two are equal: neither NULs nor what stands behind a fragment decide anything in it."""
    few = [b"x" * 12 + b"y" * 4 + b"\0" * 4, b"y" * 3 + b"\0" * 17, b"x" * 11 + b"y" * 4 + b"\0" * 5]
    got = suffix_dedup.repeated_windows(few, np.arange(3), np.zeros(3, np.uint64), 20)
    assert [x.tolist() for x in got] == marked_by_hand(few, np.arange(3), 20) == [[False], [False], [False]]
    _, text, ends, sizes = suffix_dedup._laid_out([b"ab" * 8, b"b" + b"ab" * 8, b"ab" * 8 + b"c", b"b"])
    of = lambda i: [(x, i + k if not x else 0) for k, x in enumerate(text[i : ends[np.searchsorted(ends, i)] + 1].tolist())]
    order = suffix_dedup.suffix_array(text, int(sizes.max()) + 2)
    assert order.tolist() == sorted(range(len(text)), key=of)
    shared = [next((k for k, (x, y) in enumerate(zip(of(i), of(j), strict=False)) if x != y), 0) for i, j in zip(order, order[1:], strict=False)]
    assert suffix_dedup.common_prefixes(text, order).tolist() == [0, *shared]


def test_index_misses_no_window():
    """Fragments cut from one text and from periodic ones, where many suffixes agree over more than a fragment."""
    wrong = 0
    for seed in range(150):
        r = random.Random(seed)
        letters = r.choice([b"ab", b"a\0", b"\0ab "])
        core = bytes(r.choice(letters) for _ in range(r.choice([2, 5, 30, 60]))) * 40
        core = core[:60] + bytes(r.choice(letters) for _ in range(r.choice([0, 1, 30]))) + core[:60]
        fragments = list(dict.fromkeys(core[a : a + r.randint(20, 32)] for a in (r.randint(0, len(core) - 32) for _ in range(14))))
        rank, key = np.array(r.sample(range(len(fragments)), len(fragments))), np.array([r.randrange(3) for _ in fragments], np.uint64)
        got = suffix_dedup.repeated_windows(fragments, rank, key, 20)
        # what is marked occurs before; what occurs before within the anchor is marked
        every = marked_by_hand(fragments, rank, 20)
        for k in range(len(fragments)):
            own = [j for j in range(len(fragments)) if key[j] == key[k]]
            least = marked_by_hand([fragments[j] for j in own], rank[own], 20)[own.index(k)]
            wrong += any(g < n or g > e for g, n, e in zip(got[k].tolist(), least, every[k], strict=True))
    assert wrong == 0


def test_repeats_of_texts_with_nul(spark):
    """A text's NULs are bytes like others, and end nothing."""
    r = random.Random(5)
    part = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    core = part(100)
    rows = [(k, core[: r.randint(60, 100)] + r.choice(["\0", "\0\0"]) * r.randint(1, 60) + core) for k in range(40)]
    df = frame(spark, rows).repartition(2)
    assert {x.doc_id: tuple(x)[1:] for x in suffix_dedup.digest(df).collect()} == repeats(rows, 100)


def test_index_statistics():
    r = np.random.default_rng(5)
    text = np.concatenate([r.integers(1, 4, 200), [0]])
    order = suffix_dedup.suffix_array(text, 300)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    index = suffix_dedup.RunLengthIndex(text, order, suffix_dedup.common_prefixes(text, order))
    pattern = r.integers(1, 5, 60)
    ends, lengths = np.array([60]), np.array([60])
    _, places = index.statistics(pattern, ends, lengths)
    got = suffix_dedup.match_lengths(text, pattern, ends, lengths, places)
    hay = bytes(text.tolist())
    want = [max(k for k in range(61 - i) if bytes(pattern[i : i + k].tolist()) in hay) for i in range(60)]
    assert got.tolist() == want


# -- 3


def check_packing(rows, out, capacity, ids_of):
    bins, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    for i, t in rows:
        ids = np.array(ids_of(t or ""), "<u4")
        assert sum(r.length for r in by_doc[i]) % len(ids) == 0
        for r in by_doc[i]:
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and (r.piece == 0 or r.length == capacity)
    return len(bins), sum(r.length for r in out)


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(common.vocabulary("byte_bpe_50k.json"))
    ids_of = lambda t: tok.encode(t, add_special_tokens=False).ids + [0]
    for capacity in (64, 512):
        rows, df = docs
        bins, total = check_packing(rows, packing.pack_documents(df, common.vocabulary("byte_bpe_50k.json"), capacity, 0).collect(), capacity, ids_of)
        assert bins <= math.ceil(total / capacity) * 1.2 + 1
    assert packing.pack_documents(empty(spark), common.vocabulary("byte_bpe_50k.json")).count() == 0


def test_plan_places_all_and_large_ones_in_pairs():
    r = random.Random(4)
    counts = collections.Counter(r.randint(1, 100) for _ in range(5000))
    runs, bins = packing.plan(dict(counts), 100)
    fill, large = collections.Counter(), collections.Counter()
    for n, own in runs.items():
        assert sum(k for _, k, *_ in own) == counts[n]
        for _, k, first, _, per in own:
            for j in range(k):
                fill[first + j // per] += n
                large[first + j // per] += n > 100 / 3
    assert max(fill.values()) <= 100 and max(large.values()) <= 2 and len(fill) == bins
    assert bins <= sum(n * c for n, c in counts.items()) / 100 * 1.02 + 1


# -- 4


def classes(rows, words, per):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[j : j + words]) for j in range(len(w) - words + 1)) or (frozenset([tuple(w)]) if w else frozenset())))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= per * len(x | y):
                parent[find(a)] = find(b)
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)].append(i)
    return sorted((str(i), len(s), str(i) if not s else str(min(least[find(k)], default=None))) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize(("words", "per"), [(3, 90), (2, 60)])
def test_jaccard_groups(spark, docs, odd, words, per):
    r = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    near = [(1000 + k, " ".join(x if r.random() > 0.02 else f"z{r.random()}" for x in base)) for k in range(40)]
    for rows, df in ((docs[0] + near, frame(spark, docs[0] + near)), odd):
        got = sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in jaccard_join.group_documents(df, words, per).collect())
        assert got == classes(rows, words, per)


def test_jaccard_of_nothing_and_one_of_each(spark, odd):
    assert jaccard_join.group_documents(empty(spark)).count() == 0
    left = jaccard_join.one_of_each(odd[1], 3, 90)
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "2", "None"] and left.columns == odd[1].columns


def test_jaccard_of_several_null_ids(spark):
    """Sets that no row with an id has link like others; near copies without an id go."""
    base = [f"w{k}" for k in range(60)]
    text = lambda n: " ".join([*base[n:], *(f"z{k}" for k in range(n))])
    rows = [(1, text(0)), (None, text(2)), (2, text(4)), (None, text(2)), (None, "one of its own kind here"), (None, "one of its own kind here"), (None, text(30)), (None, text(31)), (3, "far from all of them"), (None, None), (None, " ")]
    df = frame(spark, rows).repartition(3)
    got = sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in jaccard_join.group_documents(df, 3, 90).collect())
    assert got == classes(rows, 3, 90) and ("2", 58, "1") in got
    kept = sorted((str(x.doc_id), str(x.text)) for x in jaccard_join.one_of_each(df, 3, 90).collect())
    assert [x for x in kept if "w59" not in x[1]] == [("3", "far from all of them"), ("None", " "), ("None", "None"), ("None", "one of its own kind here")]
    assert [i for i, t in kept if "w59" in t] == ["1", "None"]


def test_one_of_each_tells_texts_of_a_doc_id_apart(spark):
    base = [f"w{k}" for k in range(60)]
    near = " ".join(base[:-1])
    rows = [(1, " ".join(base)), (2, near), (2, "quite another text of number two"), (3, "same same same"), (3, "same same same"), (3, "a third text"), (4, None), (4, None), (5, near + " x")]
    want = ["1 " + rows[0][1], "2 " + rows[2][1], "3 a third text", "3 same same same", "4 None"]
    for n in (1, 4):
        assert sorted(f"{x.doc_id} {x.text}" for x in jaccard_join.one_of_each(frame(spark, rows).repartition(n), 3, 80).collect()) == want


def test_last_round_makes_each_pair_once(spark, monkeypatch):
    """Texts close under the threshold share many prefix shingles; what is made grows with the pairs, not with the shingles of each."""
    r = random.Random(9)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(20):
        own = list(base)
        for i in r.sample(range(2, 400, 5), 5):
            own[i] = f"x{k}y{i}"
        rows.append((k, " ".join(own)))
    monkeypatch.setattr(jaccard_join, "PIVOTS", 1)
    made, distinct, across = [], type(frame(spark, rows)).distinct, []
    monkeypatch.setattr(type(frame(spark, rows)), "distinct", lambda self: (made.append(self) if self.columns == ["a", "b"] else None, distinct(self))[1])
    stash = jaccard_join.stash

    def seen(df, name):
        if name == "pairs-across":
            across.append((made[-1].count(), distinct(made[-1]).count()))
        return stash(df, name)

    monkeypatch.setattr(jaccard_join, "stash", seen)
    got = {x.doc_id: x.component_id for x in jaccard_join.group_documents(frame(spark, rows), words=5, per=80).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(396)} for _, t in rows]
    want = list(range(20))
    for i in range(20):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and want[i] != want[j]:
                want = [min(want[i], want[j]) if x in (want[i], want[j]) else x for x in want]
    assert got == dict(enumerate(want))
    assert len(across) == 1 and across[-1][0] == across[-1][1] > 10


# -- 5 and 8


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 16))
    x[50:90] = x[50]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(400, None, 1), (450, [float("nan")] * 16, 1), (500, [None] * 16, 1), (550, [0.0] * 16, 1), (None, [1.0] * 16, 1), (7, x[7].tolist(), 1)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard int")


def test_voronoi_is_exact(spark, vectors):
    rows, df = vectors
    good = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v, _ in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)}
    want = sorted((q, k + 1, i, s) for q in good if q % 50 == 0 for k, (s, i) in enumerate(sorted(((int(good[q] @ x), i) for i, x in good.items() if i != q), key=lambda p: (-p[0], p[1]))[:5]))
    assert sorted(tuple(r) for r in voronoi_knn.search(df, pivots=8).collect()) == want
    assert voronoi_knn.search(df.limit(0)).count() == 0


def test_voronoi_writes_data_once_and_prunes(spark):
    """Clustered vectors: every row goes to one block, and most queries to few of them."""
    r = np.random.default_rng(7)
    centre = r.normal(size=(40, 8)) * 5
    x = np.concatenate([c + 0.05 * r.normal(size=(100, 8)) for c in centre])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    join = voronoi_knn.Join(df, 5, 20, 256, None, "vec_id", "embedding")
    join.groups = 16
    join.told = spark.sparkContext.broadcast((voronoi_knn.Cells(join.told.value[0].p, 16), *join.told.value[1:]))
    rows, blocks = join.routed()
    sent = {r.kind: r["count"] for r in rows.groupBy("kind").count().collect()}
    assert sent[0] == len(x) and sent[1] < 0.3 * blocks * len(x) / 20
    e = np.floor(256 * x).astype(int)
    want = sorted((q, k + 1, int(i), int(e[q] @ e[i])) for q in range(0, len(x), 20) for k, i in enumerate([i for i in np.lexsort((np.arange(len(x)), -(e @ e[q]))) if i != q][:5]))
    assert sorted(tuple(r) for r in voronoi_knn.search(df, every=20).collect()) == want


def test_cross_polytope_recall(spark, vectors):
    rows, df = vectors
    got = collections.defaultdict(dict)
    for r in cross_polytope.search(df, tables=16, probes=8).collect():
        got[r.query_id][r.vec_id] = r.score
    good = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    hits = 0
    for q in (q for q in good if q % 50 == 0):
        cos = {i: float(x @ good[q] / np.linalg.norm(x) / np.linalg.norm(good[q])) for i, x in good.items() if i != q}
        best = sorted(cos, key=lambda i: (-round(cos[i], 9), i))[:5]
        hits += len(set(best) & set(got[q]))
        assert all(abs(cos[i] - s) < 1e-12 for i, s in got[q].items())
    assert 550 not in got and hits >= 0.9 * 5 * len(got)


def test_cross_polytope_answers_every_query_in_full(spark):
    """Tiny and clustered tables, with the query's own parameters: five rows, or all others where there are fewer."""
    r = np.random.default_rng(12)
    tight = r.normal(size=64) + 1e-3 * r.normal(size=(600, 64))
    tight[::100] = r.normal(size=(6, 64))
    for x, every in ((r.normal(size=(6, 64)), 50), (r.normal(size=(3, 64)), 1), (r.normal(size=(1, 64)), 1), (tight, 50)):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
        got = collections.defaultdict(list)
        for row in sorted(cross_polytope.search(df, k=5, every=every).collect()):
            got[row.query_id].append((row.rank, row.vec_id, row.score))
        assert set(got) == ({q for q in range(len(x)) if q % every == 0} if len(x) > 1 else set())
        for q, found in got.items():
            cos = x @ x[q] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[q])
            n = min(5, len(x) - 1)
            assert [f[0] for f in found] == list(range(1, n + 1)) and q not in [f[1] for f in found]
            assert all(abs(cos[i] - s) < 1e-9 for _, i, s in found)
            if len(x) <= 6:
                assert [f[1] for f in found] == [i for i in np.argsort(-cos).tolist() if i != q][:n]


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 32))
    assert np.allclose(np.linalg.norm(cross_polytope.hadamard(x), axis=1), np.linalg.norm(x, axis=1))


# -- 6


def test_revisits(spark):
    h = {"etag": '"a"', "content-type": "text/html", "date": "1"}
    rows = [
        (1, "response", "http://www.Example.org/a/", 10, 200, h, "d1"),
        (2, "revisit", "https://example.org/a#x", 20, 304, {"etag": 'W/"a"', "date": "2", "content-type": "no"}, None),
        (3, "response", "http://example.org:80/a?utm_source=z", 30, 200, {"etag": '"b"'}, "d3"),
        (4, "revisit", "http://example.org/a", 40, 304, {"etag": '"a"'}, None),
        (5, "revisit", "http://example.org/a", 5, 304, None, "d1"),
        (6, "revisit", "http://example.org/a", 50, 304, None, "d3"),
        (7, "revisit", "http://example.org/a", 60, 304, {}, None),
        (8, "revisit", None, 60, 304, {}, None),
        (9, "response", "http://example.org/a", 55, 404, h, "d9"),
    ]
    df = spark.createDataFrame(rows, "record_id long, kind string, url string, at long, status int, headers map<string,string>, digest string")
    got = {r.record_id: r for r in warc.resolve_revisits(df, slices=4).collect()}
    assert {k: r.resolution for k, r in got.items()} == {2: "resolved", 4: "validator_mismatch", 5: "no_original", 6: "resolved", 7: "no_validator", 8: "no_original"}
    assert got[2].original_id == 1 and got[2].headers == {"etag": 'W/"a"', "date": "2", "content-type": "text/html"} and got[4].original_id == 3
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-A: 1\r\n folded\r\n\r\n<p>hi</p>"
    fields = {"WARC-Record-ID": "<urn:1>", "WARC-Target-URI": "http://a.org/", "WARC-Date": "2024-01-01T00:00:00Z"}
    (tmp_path / "a.warc.gz").write_bytes(warc.to_warc("response", fields, block) * 2)
    (tmp_path / "b.warc").write_bytes(warc.to_warc("response", fields, block, compress=False) + b"WARC/1.1\r\nContent-Length: 99\r\n\r\ncut")
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert [r.at for r in rows] == [1704067200] * 3
    assert len(rows) == 3 and all(r.status == 200 and r.payload == b"<p>hi</p>" and r.headers == {"content-type": "text/html", "x-a": "1 folded"} and r.at == 1704067200 for r in rows)


def test_damaged_warc_files(spark, tmp_path):
    one = lambda name, date="2024-01-01T00:00:00Z", **more: warc.to_warc("response", {"WARC-Record-ID": name, "WARC-Date": date}, b"HTTP/1.1 200 OK\r\nVia: a\r\nVia: b\r\n\r\nhi", **more)
    files = {
        "cut.gz": one("a") + one("b")[:-12],
        "rubbish.gz": one("c") + b"\x1f\x8b\x08\x00rubbish that is no gzip data",
        "length": b"WARC/1.1\r\nContent-Length: -7\r\n\r\nx\r\n\r\n" + one("d", "no date", compress=False) + b"WARC/1.1\r\nContent-Length: many\r\n\r\n",
        "empty.gz": b"",
        "other": b"no such file\r\n" * 3,
        "zone": one("e", "2024-01-01T00:00:00", compress=False),
    }
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    rows = sorted(warc.read_warc(spark, str(tmp_path)).collect(), key=lambda r: r.record_id)
    assert [(r.record_id, r.at) for r in rows] == [("a", 1704067200), ("c", 1704067200), ("d", None), ("e", 1704067200)]
    assert all(r.headers == {"via": "a, b"} and r.payload == b"hi" for r in rows)


def test_revisits_with_times_far_off(spark):
    """Against brute force: a hot URL, times of 0 and far ahead, null times, ties and repeats, few and many slices."""
    r = random.Random(6)
    rows = []
    for i in range(600):
        at = r.choice([None, 0, 1 << 55, -(1 << 40), *(r.randrange(1000, 1100) for _ in range(12))])
        rows.append((i, r.choice(["response", "revisit"]), "http://hot.org/" if r.random() < 0.5 else f"http://{r.randrange(9)}.org/", at, r.choice([200, 200, 404]), {"etag": r.choice("ab")}, "x"))
    rows += rows[:20]
    df = spark.createDataFrame(rows, "record_id long, kind string, url string, at long, status int, headers map<string,string>, digest string")
    key = lambda x: (-(1 << 62) if x[3] is None else x[3], x[0])
    want = collections.Counter()
    for x in rows:
        if x[1] == "revisit":
            full = [y for y in rows if y[1] == "response" and y[4] == 200 and y[2] == x[2] and key(y) < key(x)]
            want[x[0], max(full, key=key)[0] if full else None] += 1
    for slices in (1, 2, 7, 512):
        assert collections.Counter((g.record_id, g.original_id) for g in warc.resolve_revisits(df, slices=slices).collect()) == want


def test_keys_are_found_where_they_are():
    r = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 1000):
        keys = np.unique(np.concatenate([r.integers(0, 1 << 64, n, dtype=np.uint64), np.arange(min(n, 40), dtype=np.uint64), (1 << 64) - 1 - np.arange(min(n, 3), dtype=np.uint64)]))
        asked = np.concatenate([keys, keys[::-1], keys + np.uint64(1), r.integers(0, 1 << 64, 50, dtype=np.uint64)])
        where = {int(k): i for i, k in enumerate(keys)}
        held = common._Held(keys, keys, keys, keys)
        assert held.find(asked).tolist() == held.find(asked).tolist() == [where.get(int(k), -1) for k in asked]


# -- 7


def own_discounts(n1, n2, n3, n4):
    """Chen and Goodman's, from counts of counts that are all there."""
    y = n1 / (n1 + 2 * n2)
    return [0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model(spark, docs, odd, order):
    rows, df = docs
    got = {r.doc_id: r for r in kneser_ney.train_and_score(df, order).collect()}
    toks = {i: (t or "").encode().lower().split() + ["</end>"] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in toks}
    padded = lambda ws: ["<begin>"] * (order - 1) + ws
    one, counts = collections.Counter(), {k: collections.Counter() for k in range(1, order + 1)}
    for i, ws in toks.items():
        if not held[i]:
            one.update(ws)
            x = padded(ws)
            counts[order].update(tuple(x[j : j + order]) for j in range(len(ws)))
    for k in range(order - 1, 0, -1):
        counts[k].update(g[1:] for g in counts[k + 1])
    total, size = sum(one.values()), len(one)
    ds, ctx = {}, collections.defaultdict(list)
    for k, c in counts.items():
        kinds = [sum(v == n for v in c.values()) for n in (1, 2, 3, 4)]
        ds[k] = own_discounts(*kinds) if all(kinds) else [0, *kneser_ney.discounts(*kinds)]
        ds[k] = [min(max(d, 0), n) for n, d in enumerate(ds[k])]
        for g, n in c.items():
            ctx[k, g[:-1]].append(n)

    def p(g):
        if not g:
            return 1 / (size + 1)
        own = ctx.get((len(g), g[:-1]))
        if own is None:
            return p(g[1:])
        c, d = counts[len(g)][g], ds[len(g)]
        return max(c - d[min(c, 3)], 0) / sum(own) + sum(d[min(n, 3)] for n in own) / sum(own) * p(g[1:])

    for i, ws in toks.items():
        r, x = got[i], padded(ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(one[w] > 0 for w in ws), total)
        assert abs(r.base_score - sum(math.log10((one[w] + 1) / (total + size + 1)) for w in ws)) < 1e-6
        assert abs(r.score - sum(math.log10(p(tuple(x[j : j + order]))) for j in range(len(ws)))) < 1e-6
    begin = ("<begin>",) * (order - 1)
    assert abs(sum(p((*begin, w)) for w in one) + p((*begin, "never seen")) - 1) < 1e-9  # it is a distribution
    assert kneser_ney.train_and_score(odd[1], order).count() == 5 and kneser_ney.train_and_score(empty(spark), order).count() == 0


def test_language_model_of_few_open_shards(docs, monkeypatch):
    info = kneser_ney.train(docs[1])
    want = [(r.doc_id, r.score) for r in kneser_ney.score_documents(docs[1], info).collect()]
    model = kneser_ney.Model(info)
    monkeypatch.setattr(kneser_ney, "MOST", 1)
    texts = dict(docs[0])
    for i, score in want:
        assert abs(model.score([(texts[i] or "").encode()])[3][0] - score) < 1e-9


def test_a_missing_model_file_is_an_error(spark, docs):
    import glob
    import os

    info = kneser_ney.train(docs[1])
    for f in glob.glob(info["path"].removeprefix("file:") + "/gram2-*.code.npy"):
        os.remove(f)
    with pytest.raises(Exception, match="gram2-"):
        kneser_ney.score_documents(docs[1], info).collect()
    with pytest.raises(ValueError, match="order"):
        kneser_ney.train(docs[1], order=1)


# -- 9


def test_rans_blocks():
    r = np.random.default_rng(3)
    for n in (0, 1, 5, 1000, 140_000):
        ids = r.zipf(1.3, n).clip(0, 4000).astype(np.uint32)
        table = rans.Table(rans.scaled(np.bincount(ids, minlength=2)))
        block = rans.to_block(np.array([4]), np.array([n]), ids, table)
        own, lengths, back = rans.from_block(block, table)
        assert back.tolist() == ids.tolist() and own.tolist() == [4] and lengths.tolist() == [n]
    lanes, words, states, marks = rans.encode(r.integers(0, 9, 400_000).astype(np.uint32), table9 := rans.Table(rans.scaled(np.ones(9, np.int64))))
    assert marks and table9
    ids = r.integers(0, 9, 400_000).astype(np.uint32)
    block = rans.to_block(np.array([1]), np.array([len(ids)]), ids, table9)
    step = rans.CHECKPOINT * rans.lanes_for(len(ids))
    assert rans.from_block(block, table9, checkpoint=0)[2].tolist() == ids[step:].tolist()
    with pytest.raises(ValueError):
        rans.from_block(block[:-1] + bytes([block[-1] ^ 1]), table9)


def test_rans_round_trip(spark, docs, odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(common.vocabulary("word_bpe_49k.json"))
    for rows, df in (docs, odd):
        want, at = [], 0
        for i, t in sorted(rows, key=lambda x: (-1 if x[0] is None else x[0])):
            ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
            want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        assert sorted((tuple(r) for r in rans.round_trip(df, common.vocabulary("word_bpe_49k.json")).collect()), key=lambda r: r[1]) == want
    assert rans.round_trip(empty(spark), common.vocabulary("word_bpe_49k.json")).count() == 0


# -- 10


def test_quality_rejects_what_labels_reject(spark):
    r = random.Random(8)
    clean = lambda: " ".join(r.choice(["river", "stone", "light", "wind", "grass", "cloud", "tree", "road"]) for _ in range(40))
    rows = [(i, clean()) for i in range(300)] + [(300 + i, " ".join(f"buy{r.randint(0, 3)}$$$" for _ in range(40))) for i in range(100)] + [(900, None), (901, "")]
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int")
    kept = {x.doc_id for x in quality.filter_documents(frame(spark, rows), labels).collect()}
    assert {i for i in range(300)} <= kept and not kept & set(range(300, 400)) and {900, 901} <= kept
    assert {x.doc_id for x in quality.select(frame(spark, rows), labels).collect()} == kept
    assert quality.filter_documents(frame(spark, rows), labels.limit(0)).count() == len(rows)
    assert quality.filter_documents(empty(spark), labels).count() == 0


def test_quality_takes_no_null_id_for_a_labelled_one(spark):
    """Document 0 is labelled good and drawn; junk without an id is none of the target's texts."""
    r = random.Random(8)
    clean = lambda: " ".join(r.choice(["river", "stone", "light", "wind", "grass", "cloud", "tree", "road"]) for _ in range(40))
    junk = lambda: " ".join(f"buy{r.randint(0, 3)}$$$" for _ in range(40))
    rows = [(i, clean()) for i in range(100)] + [(100 + i, junk()) for i in range(50)] + [(None, junk()) for _ in range(100)]
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i in range(0, 150, 2)], "doc_id long, quality int, toxic int")
    kept = [x.doc_id for x in quality.filter_documents(frame(spark, rows), labels).collect()]
    assert None not in kept and set(range(100)) <= set(kept) and not set(kept) & set(range(100, 150))


def test_log_ratio_and_sums_by_hand():
    """Weights from the models' definition, in plain Python: sums over a text's distinct n-grams."""
    raw, target = np.zeros(quality.KINDS << 4), np.zeros(quality.KINDS << 4)
    raw[:4], target[:4] = [1000, 400, 60, 2], [500, 10, 2, 2]
    e = [x * 514 / 1462 for x in (1000, 400, 60, 2)]
    want = []
    for t, m in zip((500, 10, 2, 2), e, strict=True):
        tail = t * math.log(t / m) - t + m
        x = math.log((t + 1) / (m + 1))
        want.append(x if m >= 1 and tail >= math.log(3 / 0.5) and abs(x) >= math.log(3) else 0)
    got = quality.log_ratio(raw, target, 4, by_chance=0.5)
    assert np.allclose(got[:4], want) and want[1] < 0 and want[0] == 0 and not got[4:].any()
    w = quality.Weights(np.arange(quality.KINDS << 6) / 7, 6, 1.0, 17)
    total, n = w.sums([b"one two two", b""])
    parts = [set(quality.features([b"one two two"], 6)[0].tolist())]
    assert n.tolist() == [len(parts[0]), 0] and np.allclose(total, [sum(np.float32(x / 7) for x in parts[0]), 0])


def test_gumbel_top_k_samples_in_proportion():
    """Of two documents, one of three times the weight comes first three times in four."""
    first = 0
    for seed in range(4000):
        key = quality.Weights(np.zeros(1), 4, 1.0, seed).keys(np.array([11, 12]), np.array([math.log(3), 0.0]))
        first += key[0] > key[1]
    assert abs(first / 4000 - 0.75) < 0.03


def test_kth_largest(spark):
    df = spark.createDataFrame([(float(x),) for x in [5, 1, 5, 3, 2, 2, 9]], "gumbel_key double")
    assert [quality.kth_largest(df, k) for k in (1, 2, 3, 4, 7)] == [9, 5, 5, 3, 1]


# -- shared


def test_components(spark):
    from provenlake.llm.components import components

    edges = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 300), (5, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 200: 100, 300: 100}


def test_counters(spark):
    df = spark.range(1000).repartition(7)

    def count(batches):
        a = np.zeros(70_000, np.int64)
        for b in batches:
            a += np.bincount(b.column(0).to_numpy() * 69, minlength=70_000)
        return [a, a * 2]

    a, b = common.sum_counters(df, count, 70_000, 2)
    assert a.sum() == 1000 and a[69 * 999] == 1 and (b == 2 * a).all()
    assert F is not None
