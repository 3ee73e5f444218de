"""Markdown of small reviews, prompts and answers of section and report judges."""

import json

from provenlake.operators import coherence, export, review

ITEMS = "review_id int, ord int, sentence_id string, reference_id string, status string, verdict string, reason string, fetch_status string, extraction_status string, canonical_url string, failure_reason string"


def test_review_as_markdown(spark):
    rows = [(1, 2, "s2", "r1", "completed", "unsupported", "No word of it.", "fetched", "extracted", None, None), (1, 1, "s1", "r2", "prejudge_unverified", "unverified", None, "failed", None, "u", None), (2, 1, "s1", "r1", "awaiting_model_config", None, None, "fetched", "extracted", None, None)]
    items = spark.createDataFrame(rows, ITEMS)
    lines = export.markdown_lines(items, review.coverage(items)).cache()
    text = {r.review_id: r.markdown for r in export.markdown(lines).collect()}
    assert text[1].split("\n")[:4] == ["# Claim review", "", "- Review: 1", "- Selected claims: 2"]
    assert text[1].index("### s1") < text[1].index("### s2") < text[1].index("## Sources that need a copy")
    assert "- Reason: No word of it." in text[1] and f"- Reason: {export.NO_REASON}" in text[1] and "- Recommendation: continue_with_warnings" in text[1]
    assert "## Verdicts" not in text[2] and "## Sources" not in text[2] and "- Verdict or stage: awaiting_model_config" in text[2]
    assert sorted(r.line_no for r in lines.where("review_id = 2").collect()) == list(range(1, len(text[2].split("\n")) + 1))
    none = items.limit(0)
    assert export.markdown_lines(none, review.coverage(none)).count() == 0


def test_answers_have_a_schema(spark):
    good = {"summary": "s", "unresolved_risks": ["a"], "factual_gaps": [], "needs_human_attention": True}
    said = [good, {"summary": "s"}, {"summary": None}, {"summary": "s", "factual_gaps": [1]}, {"summary": "s", "factual_gaps": ["a", 1]}, [good], "s"]
    raw = spark.createDataFrame([*((i, json.dumps(x)) for i, x in enumerate(said)), (7, "no json"), (8, None), (9, "")], "k int, output string")
    got = {r.k: r for r in coherence.answers(raw).collect()}
    assert [k for k, r in sorted(got.items()) if r.valid] == [0, 1]
    assert got[0].unresolved_risks == ["a"] and got[0].needs_human_attention and got[1].factual_gaps == [] and got[1].needs_human_attention is False
    assert all(got[k].summary is None and got[k].factual_gaps is None for k in range(2, 10))
    report = coherence.answers(raw.where("k = 1").replace("summary", "report_summary"), "summary", coherence.REPORT_LISTS)
    assert report.first().priority_actions == []


def test_prompts(spark):
    section = spark.createDataFrame(
        [(1, "section-1", 4, False, "Some text.", [("s1", "It rose.", "unsupported")], 1, 0, 1, 0, 2, "continue", False, ["one risk"]), (1, "section-2", 90, True, None, None, 0, 0, 0, 0, 0, None, False, [])],
        "report_id int, section_id string, word_count int, oversized boolean, section_text string, checked_claims array<struct<sentence_id:string,claim_text:string,verdict:string>>, checked int, contradicted int, unsupported int, unverified int, deselected int, status string, stop_recommended boolean, risks array<string>",
    )
    got = {r.section_id: r.prompt for r in coherence.section_prompts(section).collect()}
    assert "- s1 [unsupported] It rose." in got["section-1"] and "Open risks:\n- one risk" in got["section-1"] and "Gate: continue" in got["section-1"]
    assert "Checked claims:\n- none" in got["section-2"] and "Gate: unknown" in got["section-2"]
    report = spark.createDataFrame([(1, "continue", 3, 1, 0, 1, 0, 2, 1, [("section-1", "Results", 1, 0, 1, 0, 2, True, "Read.")], None)], "report_id int, gate string, selected int, deselected int, contradicted int, unsupported int, unverified int, eligible_sections int, completed_sections int, digests array<struct<section_id:string,heading:string,checked:int,contradicted:int,unsupported:int,unverified:int,deselected:int,needs_human_attention:boolean,summary:string>>, risks array<string>")
    (row,) = coherence.report_prompts(report).collect()
    assert "1 of 2 sections read" in row.prompt and "- section-1 (Results) checked 1" in row.prompt and "needs a human - Read." in row.prompt and "Open risks:\n- none" in row.prompt


def test_a_judge_that_repeats_itself(spark):
    said = spark.createDataFrame([("a", "x", "1"), ("a", "x", "1"), ("b", "x", "1"), ("b", "y", "1")], "claim_id string, verdict string, reason string")
    assert sorted((r.claim_id, r.verdict, r._differ) for r in review.once_each(said, ["claim_id"]).collect()) == [("a", "x", False), ("b", "x", True)]
