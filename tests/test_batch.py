from pyspark.sql import functions as F

from provenlake.operators import batch, coherence, review
from provenlake.sources import fetch

CLAIMS = [("c1", "s1", "Net revenue was $5 million in 2023.", "", 1), ("c2", "s2", "Net revenue was $5 million in 2023.", "", 2), ("c3", "s3", "Prices rose 3% in May 2024.", "", 3), ("c4", "s9", "Prices rose 3% in May 2024.", "", 4), ("c5", "s1", "Wolves sleep.", "", 5)]
SOURCES = [("s1", "html", "fetched", None), ("s2", "text_pdf", "fetched", None), ("s3", "html", "failed", "HTTP 503"), ("s4", "scroll", "fetched", None)]
HTML = "<main><h1>Results</h1><p>Net revenue was $5 million in 2023, up from $4 million.</p><p>The weather was calm.</p></main>"


def _inputs(spark):
    claims = spark.createDataFrame(CLAIMS, "claim_id string, source_id string, claim_text string, local_context string, extra int")
    sources = spark.createDataFrame(SOURCES, "source_id string, source_kind string, fetch_status string, failure_reason string")
    payloads = {"html": spark.createDataFrame([("s1", HTML), ("s3", HTML)], "source_id string, payload string"), "text_pdf": spark.createDataFrame([("s2", 1, "", "")], "source_id string, page int, layout_text string, plain_text string")}
    return claims, sources, payloads


def test_claims_against_sources(spark):
    claims, sources, payloads = _inputs(spark)
    blocks, unknown = batch.read_sources(sources, payloads)
    assert {r["source_id"] for r in blocks.collect()} == {"s1"}  # s3 was not fetched, s2 has no text
    assert [r["source_id"] for r in unknown.collect()] == ["s4"]
    got = {r["claim_id"]: r for r in batch.review_claims(claims, sources, blocks).collect()}
    assert {k: r["warning"] for k, r in got.items()} == {"c1": None, "c2": "ocr_required", "c3": "source_fetch_failed", "c4": "source_fetch_failed", "c5": "weak_retrieval_coverage"}
    assert got["c1"]["status"] == "awaiting_model_config" and got["c1"]["passages"][0]["text"].startswith("Net revenue was $5 million")
    assert got["c3"]["reason"] == "HTTP 503" and got["c4"]["reason"] and got["c5"]["extra"] == 5


def test_a_judge_sees_open_claims_only(spark):
    claims, sources, payloads = _inputs(spark)
    blocks, _ = batch.read_sources(sources, payloads)

    def judge(frames):
        for f in frames:
            yield f.assign(verdict="contradicted", reason="said")[["claim_id", "verdict", "reason"]]

    got = {r["claim_id"]: (r["status"], r["verdict"]) for r in batch.review_claims(claims, sources, blocks, judge).collect()}
    assert got["c1"] == ("completed", "contradicted") and {v for k, v in got.items() if k != "c1"} == {("prejudge_unverified", "unverified")}


def test_no_claims_and_no_sources(spark):
    claims, sources, _ = _inputs(spark)
    blocks, _ = batch.read_sources(sources, {})
    assert batch.review_claims(claims.limit(0), sources, blocks).isEmpty()
    assert {r["warning"] for r in batch.review_claims(claims, sources.limit(0), blocks).collect()} == {"source_fetch_failed"}


def test_pages_of_prose_and_rows_are_one_table(spark):
    layout = "SUMMARY OF SALES\nin thousands, year ended\nNorth    10   11\nSouth    12   13\nThe year went well."
    pages = spark.createDataFrame([("p", 1, layout, layout), ("p", 2, "", "More text.")], "source_id string, page int, layout_text string, plain_text string")
    rows = batch.text_pages(pages).orderBy("block_ord").collect()
    assert [r["span"] for r in rows] == ["page-1", "page-1-table-1-row-1", "page-1-table-2-row-2", "page-2"]
    assert len({r["block_id"] for r in rows}) == 4


def test_groups_retries_attention_timeouts(spark):
    cols = "review_id long, ord long, sentence_id string, reference_id string, status string, fetch_status string, extraction_status string, canonical_url string, failure_reason string"
    items = spark.createDataFrame([(1, 1, "a", "r2", "completed", "fetched", "extracted", "u1", None), (1, 2, "b", "r1", "prejudge_unverified", "failed", None, "u2", None), (1, 3, "c", "r2", "awaiting_model_config", "fetched", "extracted", "u3", None), (1, 4, "d", "r1", "prejudge_unverified", "failed", None, "u4", "HTTP 500")], cols)
    groups = [(r["reference_id"], r["sentence_ids"]) for r in batch.source_groups(items).orderBy("group_ord").collect()]
    assert groups == [("r2", ["a", "c"]), ("r1", ["b", "d"])]
    asked = spark.createDataFrame([(1, "r1"), (1, "r2"), (1, "r3"), (2, "r1")], "review_id long, reference_id string")
    assert {(r[0], r[1]): r[2] for r in batch.retry_problem(items, asked).collect()} == {(1, "r1"): None, (1, "r2"): "nothing_to_retry", (1, "r3"): "unknown_source", (2, "r1"): "unknown_review"}
    one = review.attention_sources(items).first()
    assert (one["canonical_url"], one["failure_reason"], one["sentence_ids"]) == ("u2", review.UNREADABLE, ["b", "d"])
    errors = spark.createDataFrame([("ReadTimeout", None), ("ConnectError", "it Timed out"), ("ConnectError", "refused"), (None, None)], "kind string, message string")
    assert [r[0] for r in errors.select(fetch.is_timeout(F.col("kind"), F.col("message"))).collect()] == [True, True, False, False]


def test_section_and_report_packets(spark):
    texts = spark.createDataFrame([(1, "section-2", 2, "Results", ["One two three.", "Four five"], "One two three.\n\nFour five", 5), (1, "section-3", 3, "Outlook", ["Six."], "Six.", 1)], "report_id long, section_id string, section_ord int, heading string, parts array<string>, text string, word_count int")
    outcomes = spark.createDataFrame([(1, "section-2", "sentence-9", "x", "contradicted"), (1, "section-2", "sentence-10", "y", "unsupported")], "report_id long, section_id string, sentence_id string, claim_text string, verdict string")
    claims = spark.createDataFrame([(1, "section-2")] * 3 + [(1, "section-3")], "report_id long, section_id string")
    gates = spark.createDataFrame([(1, "stop_and_fix", 1, 1, 0)], "report_id long, status string, contradicted long, unsupported long, unverified long")
    packets = coherence.section_packets(texts, outcomes, claims, gates, limit=4, piece=3)
    a, b = packets.orderBy("section_ord").collect()
    assert [c["sentence_id"] for c in a["checked_claims"]] == ["sentence-10", "sentence-9"] and b["checked_claims"] is None
    assert (a["oversized"], a["section_text"], a["deselected"], len(a["risks"])) == (True, "One two three. Four five", 1, 3)
    assert (b["oversized"], b["section_text"], b["checked"], b["deselected"], b["risks"]) == (False, "Six.", 0, 1, [b["risks"][0]])
    waiting = coherence.assessed(packets)
    reports = spark.createDataFrame([(1,), (2,)], "report_id long")
    assert {r[0]: r[1] for r in coherence.coherence_problem(reports, waiting).collect()} == {1: "sections_not_completed", 2: "sections_not_run"}

    def judge(frames):
        for f in frames:
            yield f.assign(summary="read", needs_human_attention=f["contradicted"] > 0)[["report_id", "section_id", "summary", "needs_human_attention"]]

    done = coherence.assessed(packets.drop("checked_claims"), judge, "report_id long, section_id string, summary string, needs_human_attention boolean")
    assert [r[1] for r in coherence.coherence_problem(reports, done).collect() if r[0] == 1] == [None]
    whole = coherence.report_packets(reports.where("report_id = 1"), gates, done).first()
    assert (whole["eligible_sections"], whole["completed_sections"], whole["human_sections"]) == (2, 2, 1)
    assert [d["section_id"] for d in whole["digests"]] == ["section-2", "section-3"] and "section_text" not in whole["digests"][0].asDict()
    assert whole["risks"][:3] == ["1 checked claims remain contradicted.", "1 checked claims remain unsupported.", "1 sections need a human."]
