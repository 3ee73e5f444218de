"""License scans (operator 13) against a scan of every place in Python."""

import random
import re

import pytest

from provenlake.llm import licenses

SCHEMA = "doc_id long, text string, words int, places string"


def brute(docs, templates=licenses.TEMPLATES, share=licenses.SHARE):
    """Every template at every place; the index's rule (two of its rarest words in place) is checked on the words themselves."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [(i, re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))) for i, t in docs]
    counts = {}
    for _, words in texts:
        for w in set(words):
            counts[w] = counts.get(w, 0) + 1
    out = []
    for i, words in texts:
        places = []
        for t in templates:
            own = t.words
            rare = sorted(set(own), key=lambda w: (counts.get(w, 0), w))[: max(2, min(4, len(own) // 2))]
            for s in range(len(words)):
                stands = [j for j in range(len(own)) if s + j < len(words) and words[s + j] == own[j]]
                if sum(own[j] in rare for j in stands) >= 2 and set(t.required) <= set(stands) and len(stands) / len(own) >= share:
                    places.append((t, s, len(stands) / len(own)))
        base = [p for p in places if p[0].base]
        join = lambda ps: ",".join(sorted({p[0].label for p in ps}))
        starts = [p[1] for p in base]
        out.append((i, len(words), len(base), min(starts, default=None), max(starts, default=None), join(base), join(places), max([p[2] for p in places], default=0.0)))
    return out


def texts(seed=4):
    r, out = random.Random(seed), []
    pool = sorted({w for t in licenses.TEMPLATES for w in t.words})
    for _ in range(120):
        words = []
        for _ in range(r.randint(0, 12)):
            t = r.choice(licenses.TEMPLATES).words
            if r.random() < 0.5:
                t = [w if r.random() < 0.9 else r.choice(pool) for w in t]
            words += t[: r.randint(1, len(t))] if r.random() < 0.3 else t
            words += [r.choice(pool + ["é", "мир", "Zeile"]) for _ in range(r.randint(0, 4))]
        out.append("".join(w.upper() + r.choice([" ", "\n", "--", ". "]) if r.random() < 0.3 else w + " " for w in words))
    out += ["", None, " ", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "Apache License, Version 2.0", "cc by nc by nc cc by nc", "under the mit licensé", "under the mIt lIcense", "under the MİT license", "K cc BY-nc", "mit license", "is hereby granted free of charge"]
    return out


def scanned(spark, rows, **more):
    df = licenses.scan(spark.createDataFrame([(*x, 1, "x") for x in rows], SCHEMA), **more)
    return df.drop("places").collect()


def test_is_every_place(spark):
    rows = list(enumerate(texts()))
    rows += [(None, rows[0][1]), (3, rows[3][1]), (3, rows[3][1])]
    got = [tuple(r) for r in scanned(spark, rows)]
    key = lambda x: (x[0] is not None, x[0] or 0, *map(str, x[1:]))
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert {x for r in got for x in r[6].split(",")} >= {"mit", "apache-2", "cc-by-nc", "gpl-3", "bsd", "isc"}


def test_empty_and_long(spark):
    assert scanned(spark, []) == []
    long = "license of mit " * 600_000 + "under the MIT license"  # 9 MB, most of its words in the index
    ((i, n, base, first, last, own, labels, score),) = (tuple(r) for r in scanned(spark, [(1, long)]))
    assert (i, n, base, first, last, own, labels, score) == (1, 1_800_004, 1, 1_800_000, 1_800_000, "mit", "mit", 1.0)


def test_templates_of_the_caller(spark):
    own = [licenses.Template("own", "alpha beta gamma delta epsilon", ("gamma delta",)), licenses.Template("base", "alpha beta", base=True)]
    rows = [(1, "alpha beta gamma delta"), (2, "x beta gamma delta epsilon"), (3, "alpha beta gamma x epsilon")]
    assert [tuple(r) for r in scanned(spark, rows, templates=own)] == brute(rows, own)
    with pytest.raises(ValueError):
        licenses.scan(spark.createDataFrame([], SCHEMA), [licenses.Template("short", "one")])


def test_no_python_in_the_plan(spark):
    df = licenses.digest(spark.createDataFrame([(1, "under the mit license", 1, "x")], SCHEMA))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
