from pyspark.sql import functions as F

from provenlake.operators import passages, scoring, selection

BLOCKS = "source_id string, block_ord int, block_id string, text string, heading string, page int, span string"


def blocks(spark, *texts, headings=None):
    return spark.createDataFrame([("s", i + 1, f"b{i + 1}", t, (headings or ["Results"] * len(texts))[i], None, None) for i, t in enumerate(texts)], BLOCKS)


def evidence(spark, claim, *texts, headings=None, context=""):
    claims = spark.createDataFrame([("c", "s", claim, context)], "claim_id string, source_id string, claim_text string, local_context string")
    return scoring.adjusted(scoring.scored(claims, passages.passages(blocks(spark, *texts, headings=headings)))).cache()


def test_chunks_overlap_and_windows(spark):
    long = " ".join(f"Sentence number {i} is here." for i in range(30))
    rows = passages.passages(blocks(spark, long), max_chars=100, overflow=60).orderBy("cand_idx").collect()
    assert len(rows) > 5 and all(len(r.text) <= 160 for r in rows)
    for a, b in zip(rows, rows[1:], strict=False):
        assert a.text.split(". ")[-1].rstrip(".") in b.text
    both = passages.passages(blocks(spark, "Left side.", "Right side.")).collect()
    assert {r.passage_id for r in both} == {"b1-chunk-1", "b2-chunk-1", "b1+b2-boundary-window"}
    apart = passages.passages(blocks(spark, "Left side.", "Right side.", headings=["One", "Two"])).count()
    rows = passages.passages(blocks(spark, "Table: T. Row: a. Value: 1.", "Text.")).collect()
    assert apart == 2 and {r.passage_id for r in rows} == {"b1-chunk-1", "b2-chunk-1"}


def test_matching_number_is_first_and_unrelated_is_dropped(spark):
    found = evidence(spark, "Total revenue was $120 million in May 2026.", "Revenue reached $120 million in May 2026 for the company.", "the weather was calm.", "Revenue was $90 million in May 2026.", headings=["A", "B", "C"])
    ranked = [r.passage_id for r in selection.ranked(found).orderBy("rank").collect()]
    assert ranked[0] == "b1-chunk-1" and "b2-chunk-1" not in ranked
    conflict = found.where("passage_id = 'b3-chunk-1'").first().coverage
    assert "number_conflict:present" in conflict


def test_segment_and_boilerplate_lose_points(spark):
    found = {r.passage_id: r.score for r in evidence(spark, "Total revenue was $5 million in 2025.", "Revenue was $5 million in 2025.", "Segment revenue was $5 million in 2025.", "Revenue definitions for $5 million in 2025.", headings=["A", "B", "Technical notes"]).collect()}
    assert found["b1-chunk-1"] > found["b2-chunk-1"] and found["b1-chunk-1"] > found["b3-chunk-1"]


def test_bare_fragment_is_penalised(spark):
    rows = {r.passage_id: r for r in evidence(spark, "Battery storage revenue was $120 in 2025.", "$120", "Battery storage revenue reached $120 in 2025 overall.").collect()}
    assert rows["b1-chunk-1"].fragment_penalty > 0 and rows["b2-chunk-1"].fragment_penalty == 0


def test_selection_is_diverse_and_bounded(spark):
    found = evidence(spark, "Total revenue was $120 million in May 2026.", *[f"Revenue reached $120 million in May 2026 case {i}." for i in range(8)], headings=[f"H{i}" for i in range(8)])
    chosen = selection.diverse(found).collect()
    assert 1 <= len(chosen) <= 5 and [r.position for r in sorted(chosen, key=lambda r: r.position)] == list(range(1, len(chosen) + 1))
    assert selection.diverse(found, 0).count() == 0


def test_near_duplicates(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d", "e"], ["a", "b", "c", "d", "e"]), (["a"], ["b"]), ([], [])], "a array<string>, b array<string>")
    assert [r.x for r in df.select(selection.near_duplicate(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False, False]


def test_fragments_meet_their_band_only(spark):
    """Against brute force: a fragment and a richer passage of its story, at all distances around the edges of bands."""
    tokens = "c string, p string, i int, frag boolean, heading string, page int"
    rows = [("c", f"f{i}-{h}-{g}", i, True, h, g) for i in (0, 15, 16, 31, 40) for h, g in (("A", 1), ("A", None), (None, None))]
    rows += [("c", f"r{i}-{h}-{g}", i, False, h, g) for i in (1, 17, 32, 47, 48, 57) for h, g in ((" a ", 1), ("A", None), ("B", 1), ("", None))]
    df = spark.createDataFrame(rows, tokens)
    words = lambda *w: F.array(*map(F.lit, w)).cast("array<string>")
    own = df.select(
        F.col("c").alias("claim_id"), F.col("p").alias("passage_id"), F.lit("s").alias("source_id"), F.col("i").alias("cand_idx"), "heading", "page", F.lit(5.0).alias("base_score"),
        F.when(F.col("frag"), "$5 million").otherwise("Revenue was $5 million in the whole year.").alias("text"), words("number:5").alias("coverage"), words("revenue").alias("q_terms"),
        F.when(F.col("frag"), words()).otherwise(words("revenue")).alias("terms"), words("5", "million").alias("tokens"), F.struct(words("5").alias("numbers"), words("5:million").alias("number_units"), words().alias("dates")).alias("c"),
    )
    place = lambda h: (h or "").strip().lower()
    for band in (1, 3, 16):
        got = {r.passage_id for r in scoring.adjusted(own, band).where("fragment_penalty > 0").collect()}
        assert got == {f[1] for f in rows if f[3] and any(not r[3] and place(r[4]) == place(f[4]) and r[5] == f[5] and abs(r[2] - f[2]) <= band for r in rows)} != set()
