from pyspark.sql import functions as F

from provenlake.operators import evaluate, review
from provenlake.sources import records


def test_selections(spark):
    bodies = ['[{"sentence_id":"s1","reference_id":"r1"},{"sentence_id":"s2"}]', "[]", "no", '[{"sentence_id":"a","reference_id":"b"},{"sentence_id":"a","reference_id":"b"}]']
    got = records.selections(spark.createDataFrame(list(enumerate(bodies)), "report_id int, body string")).collect()
    by = lambda k: sorted(str(r.error) for r in got if r.report_id == k)
    assert by(0) == ["None", "missing_key"] and by(1) == by(2) == ["no_selection"] and by(3) == ["repeated_pair", "repeated_pair"]
    back = records.selections(records.selection_body(spark.createDataFrame([(1, 2, "s2", "r", None), (1, 1, "s1", "r", "t")], "report_id int, ord int, sentence_id string, reference_id string, approved_text string")))
    assert [(r.sentence_id, r.approved_text) for r in back.collect()] == [("s1", "t"), ("s2", None)]


def test_answer_key(spark):
    lines = ["Report 1", "A title", "Claim 1: verdict = Partially supported", "Excerpt: x", "Citation: [1]", "Why: y", "Claim 2: verdict = unsupported", "Report 2", "Claim 1: verdict = contradicted"]
    rows = records.answer_key(spark.createDataFrame([("k", i, t) for i, t in enumerate(lines)], "key_id string, ord int, text string")).orderBy("report", "claim").collect()
    assert [(r.report, r.claim, r.verdict, r.excerpt) for r in rows] == [(1, 1, "partially_supported", "x"), (1, 2, "unsupported", None), (2, 1, "contradicted", None)]


def test_manifest_uploads_and_times(spark):
    m = records.manifest(spark.createDataFrame([("u", 1, "old"), ("u", 2, "new")], "url string, fetched_at int, kind string"))
    got = records.from_manifest(spark.createDataFrame([("u",), ("v",)], "url string"), m).collect()
    assert {r.url: (r.kind, r.fetch_status) for r in got} == {"u": ("new", "fetched"), "v": (None, "failed")}
    df = spark.createDataFrame([("a.pdf", None, bytearray(b"x")), ("a", "text/html; x", bytearray(b"x")), ("a.txt", None, bytearray(b"x")), ("a.pdf", None, bytearray(b""))], "n string, t string, b binary")
    assert [r.k for r in df.select(records.uploaded_kind(F.col("n"), F.col("t"), F.col("b")).alias("k")).collect()] == ["text_pdf", "html", "!unsupported", "!empty"]
    ms = spark.createDataFrame([(850,), (2400,), (65000,)], "ms long").select(records.elapsed(F.col("ms")).alias("e"))
    assert [r.e for r in ms.collect()] == ["850 ms", "2.4 s", "1 min 5 s"]


def test_judge_seam(spark):
    claims = spark.createDataFrame([("c", "s", "Sales rose.")], "claim_id string, source_id string, claim_text string")
    packet = spark.createDataFrame([("c", 2, "p2", "two", "s"), ("c", 1, "p1", "one", "s"), ("c", 3, "p3", "x", "other")], "claim_id string, position int, passage_id string, text string, source_id string")
    packed = review.payloads(claims, packet)
    assert [p.passage_id for p in packed.first().passages] == ["p1", "p2"] and "[p1] one" in review.prompts(packed, "Judge.").first().prompt
    said = review.judged(spark.createDataFrame([("c", '{"verdict":"contradicted","passage_ids":["p9","p1","p1"]}'), ("d", "junk")], "claim_id string, output string"))
    assert {r.claim_id: r.verdict for r in said.collect()} == {"c": "contradicted", "d": None}
    assert review.judge_passages(said.where("claim_id = 'c'"), packet).first().passage_ids == ["p1", "p1"]


def test_outcome_cases(spark):
    e = spark.createDataFrame([("a", "unsupported", True, [["month", "may"]]), ("b", "contradicted", False, None)], "case_id string, verdict string, high_impact boolean, concepts array<array<string>>")
    a = spark.createDataFrame([("a", "supported_by_cited_source", "in May"), ("b", "contradicted", None)], "case_id string, verdict string, reason string")
    rows = {r.case_id: r for r in evaluate.outcome_cases(e, a).collect()}
    assert (rows["a"].failure, rows["a"].false_support, rows["b"].passed) == ("verdict_mismatch", True, True)
    total = evaluate.outcome_summary(evaluate.outcome_cases(e, a)).first()
    assert (total.accuracy, total.accuracy_gate, total.safety_gate) == (0.5, False, False)
