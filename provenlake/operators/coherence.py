"""After the review: section packets with their checked claims and coverage, and the packet of the whole report.

outcomes: report_id, section_id, sentence_id, claim_text, verdict (see review.section_outcomes).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenlake.operators import review, sections

COUNTS = ["contradicted", "unsupported", "unverified"]


def section_coverage(texts: DataFrame, outcomes: DataFrame, claims: DataFrame) -> DataFrame:
    """Per section with text: checked claims by verdict, and how many of its citing sentences (claims) were not selected."""
    keys = ["report_id", "section_id"]
    checked = outcomes.groupBy(*keys).agg(F.count("*").alias("checked"), *(F.count_if(F.col("verdict") == v).alias(v) for v in COUNTS))
    total = claims.groupBy(*keys).agg(F.count("*").alias("total"))
    own = texts.select(*keys, "section_ord", "heading").join(checked, keys, "left").join(total, keys, "left")
    own = own.fillna(0, ["checked", *COUNTS, "total"])
    return own.withColumn("deselected", F.greatest(F.col("total") - F.col("checked"), F.lit(0).cast("long"))).drop("total")


def section_packets(texts: DataFrame, outcomes: DataFrame, claims: DataFrame, gates: DataFrame, limit: int = 800, piece: int = 250) -> DataFrame:
    """What a section judge gets: text or synopsis, checked claims by sentence id (as text), coverage, gate and risks.
    gates: report_id, status."""
    keys = ["report_id", "section_id"]
    said = outcomes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("sentence_id", "claim_text", "verdict"))).alias("checked_claims"))
    body = sections.packets(texts, sections.subchunks(texts, piece), limit).drop("section_ord", "heading")
    own = body.join(section_coverage(texts, outcomes, claims), keys).join(said, keys, "left").join(gates.select("report_id", "status"), "report_id", "left")
    stop = F.coalesce(F.col("status") == "stop_and_fix", F.lit(False))
    risks = [F.when(F.col(v) > 0, F.lit(t)) for v, t in sections.RISKS] + [F.when(stop, F.lit(sections.STOP))]
    return own.withColumns(
        {
            "stop_recommended": stop,
            "has_contradiction": F.col("contradicted") > 0,
            "has_warning": (F.col("unsupported") > 0) | (F.col("unverified") > 0),
            "risks": F.array_compact(F.array(*risks)),
        }
    )


def assessed(packets: DataFrame, judge: Callable | None = None, schema: str = "report_id string, section_id string, summary string, needs_human_attention boolean") -> DataFrame:
    """Packets with a judge's words (a mapInPandas function giving ``schema``); without one, or where it says nothing of a
    packet or several things, their output is invalid; without a judge they await one. Serves sections and, with a schema without section_id, whole reports."""
    names = [x.split()[0] for x in schema.split(", ")]
    keys = [k for k in ("report_id", "section_id") if k in names]
    if judge is None:
        blank = packets.withColumns({n: F.lit(None).cast(t) for n, t in (x.split() for x in schema.split(", ")) if n not in keys})
        return blank.withColumn("status", F.lit("awaiting_model_config"))
    said = review.once_each(packets.mapInPandas(judge, schema), keys)
    out = packets.join(said, keys, "left")
    return out.withColumn("status", F.when(~F.col("_differ"), "completed").otherwise("invalid_model_output")).drop("_differ")


def coherence_problem(reports: DataFrame, assessments: DataFrame) -> DataFrame:
    """reports (report_id) with why the whole cannot be judged yet: no section was, or not all are completed."""
    per = assessments.groupBy("report_id").agg(F.bool_and(F.coalesce(F.col("status") == "completed", F.lit(False))).alias("all"))
    return reports.join(per, "report_id", "left").select("report_id", F.when(F.col("all").isNull(), "sections_not_run").when(~F.col("all"), "sections_not_completed").alias("problem"))


def report_packets(coverage: DataFrame, gates: DataFrame, assessments: DataFrame) -> DataFrame:
    """Per report: coverage (selected, completed, unresolved, deselected) and gate counts, how many sections there are, are
    completed and need a human, digests of completed sections in order without their texts, and the open risks."""
    done = F.col("status") == "completed"
    needs = done & F.coalesce("needs_human_attention", F.lit(False))
    digest = F.when(done, F.struct("section_ord", "section_id", "heading", "checked", *COUNTS, "deselected", "has_contradiction", "has_warning", needs.alias("needs_human_attention"), "summary"))
    per = assessments.groupBy("report_id").agg(F.count("*").alias("eligible_sections"), F.count_if(done).alias("completed_sections"), F.count_if(needs).alias("human_sections"), F.array_sort(F.collect_list(digest)).alias("digests"))
    renamed = assessments.where(done).select(F.col("report_id").alias("review_id"), "section_ord", "heading", F.coalesce("needs_human_attention", F.lit(False)).alias("needs_human_attention"), "risks")
    risks = sections.report_risks(gates.withColumnRenamed("report_id", "review_id"), renamed).withColumnRenamed("review_id", "report_id")
    return coverage.join(gates.select("report_id", F.col("status").alias("gate"), *COUNTS), "report_id").join(per, "report_id", "left").join(risks, "report_id", "left")


# -- what section and report judges are asked, and what they may answer ---------------------------------------------------

#: Fields of a section judge's answer and of a report judge's (fixed values): a summary, lists of sentences, and a flag.
SECTION_LISTS = ["factual_strengths", "factual_gaps", "insight_issues", "unresolved_risks", "recommended_revisions"]
REPORT_LISTS = ["coherence_strengths", "coherence_issues", "soundness_issues", "noteworthy_patterns", "priority_actions", "unresolved_risks"]


def _bullets(values: Column, none: str = "- none") -> Column:
    lines = F.array_join(F.transform(values, lambda v: F.concat(F.lit("- "), v)), "\n")
    return F.when(F.size(values) > 0, lines).otherwise(none)


def section_prompts(packets: DataFrame) -> DataFrame:
    """report_id, section_id, prompt of section packets: the section, its text or synopsis, checked claims, coverage, gate, risks."""
    claims = _bullets(F.coalesce(F.transform("checked_claims", lambda c: F.concat(c["sentence_id"], F.lit(" ["), c["verdict"], F.lit("] "), c["claim_text"])), F.array().cast("array<string>")))
    counts = F.concat_ws(", ", *(F.concat(F.lit(f"{n} "), n) for n in ("checked", *COUNTS, "deselected")))
    gate = F.concat(F.lit("Gate: "), F.coalesce("status", F.lit("unknown")), F.when(F.col("stop_recommended"), "; stop and fix first").otherwise(""))
    kind = F.when(F.col("oversized"), "Synopsis (the section is long)").otherwise("Text")
    parts = [F.concat(F.lit("Section "), "section_id", F.lit(", "), "word_count", F.lit(" words")), F.concat(kind, F.lit(":\n"), F.coalesce("section_text", F.lit(""))), F.concat(F.lit("Checked claims:\n"), claims), F.concat(F.lit("Coverage: "), counts), gate, F.concat(F.lit("Open risks:\n"), _bullets(F.col("risks")))]
    return packets.select("report_id", "section_id", F.concat_ws("\n\n", *parts).alias("prompt"))


def report_prompts(packets: DataFrame) -> DataFrame:
    """report_id, prompt of report packets: coverage, the gate, a line for each section's digest, open risks."""
    digest = F.transform("digests", lambda d: F.concat_ws(" ", d["section_id"], F.concat(F.lit("("), d["heading"], F.lit(")")), F.concat_ws(", ", *(F.concat(F.lit(f"{n} "), d[n]) for n in ("checked", *COUNTS, "deselected"))), F.when(d["needs_human_attention"], "needs a human"), F.concat(F.lit("- "), d["summary"])))
    parts = [F.concat(F.lit("Report "), "report_id", F.lit(": "), "completed_sections", F.lit(" of "), "eligible_sections", F.lit(" sections read")), F.concat_ws(", ", F.concat(F.lit("Gate: "), "gate"), *(F.concat(F.lit(f"{n} "), n) for n in ("selected", "deselected", *COUNTS))), F.concat(F.lit("Sections:\n"), _bullets(F.col("digests_said"))), F.concat(F.lit("Open risks:\n"), _bullets(F.coalesce("risks", F.array().cast("array<string>"))))]
    return packets.withColumn("digests_said", F.coalesce(digest, F.array().cast("array<string>"))).select("report_id", F.concat_ws("\n\n", *parts).alias("prompt"))


def answers(raw: DataFrame, summary: str = "summary", lists: list[str] | None = None) -> DataFrame:
    """raw (keys, output JSON) with the fields of a judge's answer. An answer is valid if it is an object whose summary is a text and
    whose lists, where given, are lists of texts; lists that are not given are empty, the flag is false. Others have nulls."""
    lists = SECTION_LISTS if lists is None else lists
    o = F.try_parse_json("output")
    text = F.try_variant_get(o, f"$.{summary}", "string")
    is_text = F.schema_of_variant(F.try_variant_get(o, f"$.{summary}", "variant")) == "STRING"
    own = {n: F.try_variant_get(o, f"$.{n}", "array<string>") for n in lists}
    given = {n: F.try_variant_get(o, f"$.{n}", "variant") for n in lists}
    typed = [given[n].isNull() | F.schema_of_variant(given[n]).isin("ARRAY<STRING>", "ARRAY<VOID>") for n in lists]
    flag = F.try_variant_get(o, "$.needs_human_attention", "boolean")
    valid = F.coalesce(is_text & F.forall(F.array(*typed), lambda x: F.coalesce(x, F.lit(False))), F.lit(False))
    rest = [c for c in raw.columns if c != "output"]
    found = raw.select(*rest, valid.alias("valid"), text.alias(summary), *(own[n].alias(n) for n in lists), flag.alias("needs_human_attention"))
    empty = F.array().cast("array<string>")
    return found.select(*rest, "valid", F.when(F.col("valid"), F.col(summary)).alias(summary), *(F.when(F.col("valid"), F.coalesce(n, empty)).alias(n) for n in lists), F.when(F.col("valid"), F.coalesce("needs_human_attention", F.lit(False))).alias("needs_human_attention"))
