"""Inverted lists against the nested loop."""

import random

from pyspark.sql import functions as F

from provenlake.operators import passages, retrieval, scoring, selection
from provenlake.plans.store import settled

BLOCKS = "source_id string, block_ord int, block_id string, text string, heading string, page int, span string"
CLAIMS = "claim_id string, source_id string, claim_text string, local_context string"
MONTHS = ["January", "March", "June", "October"]
METRICS = ["revenue", "net sales", "operating margin", "headcount", "ebitda", "market share", "backlog ratio", "churn rate"]


def corpus(spark, n, seed=1):
    """Random blocks, and a bare fragment beside a passage that tells its story."""
    r, rows = random.Random(seed), []
    for i in range(n):
        number, year, month, metric = r.choice([7, 45, 1200, 88]), r.choice([2019, 2020, 2021, 2022]), r.choice(MONTHS), r.choice(METRICS)
        text = r.choice([
            f"The {metric} was ${number} million in {month} {year}.", f"${number} million", f"{number}%, fiscal year {year}", f"In Q{r.randint(1, 4)} {year} the {metric} rose.",
            f"In the second quarter of fiscal year {year} Harbour Tools grew.", "the weather was calm and harbour traffic was light", f"Machinery and harbour orders: {number} units.", f"Definitions of {metric}.", f"In {month} {year} tools were sold.",
        ])
        rows.append((f"s{i % 3}" if i % 4 else "s0", i, f"b{i}", text, r.choice(["Results", "Results", "Notes", None, "Technical notes"]), r.choice([1, 1, 2, None]), None))
    rows += [("s0", n, "x", "7%", "Results", 1, None), ("s0", n + 1, "y", "The share of harbour machinery came to 7% in that season.", "Results", 1, None)]
    return spark.createDataFrame(rows, BLOCKS)


def claims(spark, seed=2, n=24):
    r, rows = random.Random(seed), []
    for i in range(n):
        metric, year, month = r.choice(METRICS), r.choice([2019, 2020, 2021]), r.choice(MONTHS)
        text = r.choice([f"{metric} was $45 million in {month} {year}.", f"Harbour machinery {metric} fell to 7% in the second quarter of {year}.", f"Tools and machinery traffic, fiscal year {year}.", "Weather.", "harbour weather was light", f"The {metric} rose in Q1 {year}.", "88 units", ""])
        rows.append((f"c{i}", r.choice(["s0", "s0", "s1", "s2", "s9"]), text, r.choice(["", None, "The machinery segment of Harbour Tools."])))
    return spark.createDataFrame([*rows, ("nowhere", None, "revenue", None)], CLAIMS)


def test_is_the_nested_loop(spark):
    own, asked = passages.passages(corpus(spark, 160)), claims(spark)
    columns = ["claim_id", "passage_id", "coverage", "base_score", "identity_bonus", "fragment_penalty", "score"]
    every = scoring.adjusted(scoring.scored(asked, own)).select(*columns).collect()
    want = [r for r in every if r.score > 0]
    got = retrieval.found(asked, own).select(*columns).collect()
    key = lambda r: (r.claim_id, r.passage_id)
    assert len(want) > 200 and any(r.fragment_penalty > 0 for r in every)
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == sorted(map(tuple, want), key=lambda r: r[:2])
    assert len({key(r) for r in got}) == len(got)


def test_few_pairs_of_one_large_source(spark):
    """One source of 100,000 passages: what meets is far less than what a nested loop makes, and holds all that can score."""
    n, q = 100_000, 40
    at, word = F.col("id"), lambda c: F.concat(F.lit("crane"), F.translate(c.cast("string"), "0123456789", "abcdefghij"))
    month = F.element_at(F.array(*map(F.lit, MONTHS)), (at % 4 + 1).cast("int"))
    text = F.concat(word(at % 997), F.lit(" and "), word(at * 31 % 4999), F.lit(" at "), (at * 7 % 30011).cast("string"), F.lit(" in "), month, F.lit(" "), (F.lit(1950) + at % 70).cast("string"), F.lit("."))
    rows = spark.range(n).select(F.lit("s").alias("source_id"), at.cast("int").alias("cand_idx"), F.concat(F.lit("p"), at).alias("passage_id"), text.alias("text"), F.lit(None).cast("string").alias("heading"), F.lit(1).alias("page"))
    said = F.concat(word(at), F.lit(" and "), word(at * 31 % 4999), F.lit(" reached "), (at * 2400 + 11).cast("string"), F.lit(" in June "), (at + 1951).cast("string"), F.lit("."))
    asked = spark.range(q).select(F.concat(F.lit("c"), "id").alias("claim_id"), F.lit("s").alias("source_id"), said.alias("claim_text"), F.lit("").alias("local_context"))
    read = settled(scoring.passages_read(rows))
    pairs = settled(retrieval.met(scoring.claims_read(asked), read))
    assert 0 < pairs.count() < 0.2 * n * q
    one = asked.where("claim_id = 'c3'")
    own = scoring.marked(scoring.based(scoring.claims_read(one).join(read, "source_id")))
    possible = {r.passage_id for r in own.where(F.col("central") | (scoring.identity_bonus(F.col("overlap"), F.col("q_terms")) > 0)).select("passage_id").collect()}
    assert possible and possible <= {f"p{r.cand_idx}" for r in pairs.where("claim_id = 'c3'").collect()}


def test_rarest_terms_are_looked_up(spark):
    rows = [("s", i, f"b{i}", t, None, 1, None) for i, t in enumerate(["harbour crane", "harbour boats", "harbour crane winch", "nothing else"])]
    read = scoring.passages_read(passages.passages(spark.createDataFrame(rows, BLOCKS)))
    q = scoring.claims_read(spark.createDataFrame([("c", "s", "harbour crane winch", ""), ("d", "s", "harbour", "")], CLAIMS))
    keys = {}
    for r in retrieval.asked(q, retrieval.postings(read)).collect():
        keys.setdefault(r.claim_id, set()).add(r.key)
    assert keys == {"c": {"term:crane", "term:winch"}, "d": {"term:harbour"}}


def test_choice_has_its_texts(spark):
    own = settled(passages.passages(corpus(spark, 40)))
    chosen = retrieval.texts(selection.diverse(retrieval.found(claims(spark), own)), own).collect()
    texts = {(r.source_id, r.passage_id): r.text for r in own.collect()}
    assert chosen and all(r.text == texts[r.source_id, r.passage_id] for r in chosen)
