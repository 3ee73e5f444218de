from pyspark.sql import functions as F

from provenlake.operators import evaluate, intake, review, sections


def report(spark, *paragraphs):
    rows = [("r", i + 1, s, t) for i, (s, t) in enumerate(paragraphs)]
    return intake.sections(spark.createDataFrame(rows, "report_id string, ord long, style_id string, text string"))


def claims_of(spark, *texts):
    parts = report(spark, ("Heading1", "Findings"), *[("Normal", t) for t in texts], ("Heading1", "References"), ("Normal", "[1] A https://a.org/x.pdf."), ("Normal", "2. B"), ("Normal", "[3] C"), ("Normal", "[3] D"), ("Normal", "no label"))
    refs = intake.references(parts)
    return parts, refs, intake.claim_sentences(intake.report_sentences(parts), refs)


def test_references_and_mapping(spark):
    _, refs, c = claims_of(spark, "Sales rose.[1] Costs fell [3]. Nothing [9].")
    rows = refs.orderBy("ord").collect()
    assert [(r.label, r.url, r.source_kind) for r in rows][0] == ("1", "https://a.org/x.pdf", "text_pdf") and rows[-1].label is None
    status = [r.citations[0].status for r in c.orderBy("idx").collect()]
    assert status == ["mapped", "ambiguous", "unmapped"]


def test_directions(spark):
    _, _, c = claims_of(spark, "[1] Sales rose.", "Costs fell. [2] Prices held.", "Costs fell. [1].")
    assert [r.direction for r in c.orderBy("ord", "idx").collect()] == ["forward", "ambiguous", "backward"]
    last = c.orderBy("ord", "idx").collect()[-1]
    assert last.claim_text == "Costs fell. [1]" and last.anchor == 0


def test_selection_errors(spark):
    _, _, c = claims_of(spark, "Sales rose [1].", "Costs fell. [2] Prices held.")
    ids = [r.sentence_id for r in c.orderBy("ord", "idx").collect()]
    chosen = spark.createDataFrame([("r", ids[0], "reference-1", None, None), ("r", ids[0], "reference-2", None, None), ("r", "sentence-99", "reference-1", None, None), ("r", ids[1], "reference-2", None, None), ("r", ids[1], "reference-2", None, "both")], "report_id string, sentence_id string, reference_id string, approved_text string, direction string")
    errors = {(r.sentence_id, r.reference_id): r.error for r in intake.selected_claims(c, chosen).collect()}
    assert errors[ids[0], "reference-1"] is None and errors[ids[0], "reference-2"] == "reference_not_linked"
    assert errors["sentence-99", "reference-1"] == "unknown_sentence" and errors[ids[1], "reference-2"] == "repeated_pair"


def test_structure_errors(spark):
    parts = report(spark, ("Normal", "Only text."))
    refs = intake.references(parts)
    found = intake.structure_errors(parts, refs, intake.claim_sentences(intake.report_sentences(parts), refs))
    assert {r.error for r in found.collect()} == {"no_reference_heading", "no_references", "no_citations"}


def items(spark, *verdicts):
    rows = [("v", i, f"s{i}", "r1", "completed" if v else "awaiting_model_config", v, "fetched", "extracted") for i, v in enumerate(verdicts)]
    return spark.createDataFrame(rows, "review_id string, ord long, sentence_id string, reference_id string, status string, verdict string, fetch_status string, extraction_status string")


def test_gate_precedence(spark):
    status = lambda *v: review.gate(items(spark, *v)).first().status
    assert status("contradicted", None, "unsupported") == "stop_and_fix"
    assert status(None, "unsupported") == "review_incomplete"
    assert status("unverified") == "continue_with_warnings"
    assert status("supported_by_cited_source") == "continue"


def test_judge_is_a_plug_in(spark):
    rows = [("c1", "failed", "pending", "gone", 0), ("c2", "fetched", "ocr_required", None, 3), ("c3", "fetched", "extracted", None, 0), ("c4", "fetched", "extracted", None, 2)]
    claims = spark.createDataFrame(rows, "claim_id string, fetch_status string, extraction_status string, failure_reason string, n_passages int")
    assert {r.claim_id: r.status for r in review.reviewed(claims).collect()} == {"c1": "prejudge_unverified", "c2": "prejudge_unverified", "c3": "prejudge_unverified", "c4": "awaiting_model_config"}

    def judge(batches):
        for b in batches:
            assert set(b["claim_id"]) <= {"c4"}
            yield b[["claim_id"]].assign(verdict="contradicted", reason="x")

    assert {r.claim_id: r.status for r in review.reviewed(claims, judge).collect()}["c4"] == "completed"


def test_retry_keeps_completed(spark):
    own = items(spark, "unsupported", None).select("review_id", "sentence_id", "reference_id", "status")
    out = review.retried(own, own.withColumn("status", F.lit("again")))
    assert {r.sentence_id: r.status for r in out.collect()} == {"s0": "completed", "s1": "again"}


def test_subchunks_and_synopsis(spark):
    parts = report(spark, ("Heading1", "Body"), ("Normal", "one two three."), ("Normal", "four five."), ("Normal", " ".join(f"w{i}" for i in range(12))), ("Normal", "end."))
    texts = sections.section_texts(parts)
    chunks = sections.subchunks(texts, 5).orderBy("ord").collect()
    assert [c.word_count for c in chunks] == [5, 5, 5, 2, 1]
    assert sections.packets(texts, sections.subchunks(texts, 5), 10).first().oversized


def test_accuracy_and_concurrency(spark):
    e = spark.createDataFrame([(1, 1, "unsupported"), (1, 2, "contradicted"), (2, 1, "unverified")], "report_id int, ord int, verdict string")
    a = spark.createDataFrame([(1, 1, "supported_by_cited_source"), (1, 2, "contradicted")], "report_id int, ord int, verdict string")
    total = evaluate.accuracy(e, a).where("report_id IS NULL").first()
    assert (total.cases, total.passed, total.false_support, total.gate) == (3, 1, 1, False)
    w = spark.createDataFrame([("r", "a", 0, 10), ("r", "b", 5, 15), ("r", "c", 10, 20)], "review_id string, worker_id string, start_ms long, finish_ms long")
    got = review.timings(w).first()
    assert (got.max_concurrency, got.sequential_ms) == (2, 30)
