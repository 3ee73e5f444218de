"""A review as Markdown: a table of lines, so that a review of any number of items is never one value, and the text of small ones.

Each part of the document is a frame of line groups (review_id, part, place, lines); groups are exploded and numbered within their
review. Parts that a review has nothing for are left out with their headings. Nulls: a missing count is 0, a missing text is said to
be missing; a review that only items know has no header and no gate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenlake.operators import review
from provenlake.sources.records import elapsed

MISSING = "not available"
#: What is said where a judge said nothing.
NO_REASON, NO_ACTION, NO_SUMMARY = "No reason was given.", "Settle the current stage before relying on this claim.", "No assessment was returned."


def _said(name: str, value: Column, otherwise: str = MISSING) -> Column:
    return F.concat(F.lit(f"- {name}: "), F.coalesce(value.cast("string"), F.lit(otherwise)))


def _count(name: str, column: str) -> Column:
    return _said(name, F.col(column), "0")


def _lines(*lines: str | Column) -> Column:
    return F.array(*(F.lit(x) if isinstance(x, str) else x for x in lines))


def _listed(name: str, values: Column) -> Column:
    """A line with its values below it; nothing where there are none."""
    return F.when(F.size(values) > 0, F.concat(F.array(F.lit(f"- {name}:")), F.transform(values, lambda v: F.concat(F.lit("  - "), v)))).otherwise(F.array().cast("array<string>"))


def _group(df: DataFrame, part: int, place: Column, lines: Column, id_col: str = "review_id") -> DataFrame:
    return df.select(F.col(id_col).alias("review_id"), F.lit(part).alias("part"), place.cast("long").alias("place"), lines.alias("lines"))


def _titled(df: DataFrame, part: int, title: str, id_col: str = "review_id") -> DataFrame:
    return _group(df.select(id_col).distinct(), part, F.lit(-1), _lines("", f"## {title}", ""), id_col)


def _overview(coverage: DataFrame, workers: DataFrame | None) -> DataFrame:
    own = coverage if workers is None else coverage.join(workers.select("review_id", "max_concurrency", "sequential_ms"), "review_id", "left")
    head = _lines("# Claim review", "", _said("Review", F.col("review_id")), _count("Selected claims", "selected"), _count("Sources", "unique_sources"), _count("Completed", "completed"), _count("Awaiting a model", "awaiting"), _count("Settled without a judge", "prejudged"))
    if workers is not None:
        timing = _lines(_count("Workers at once", "max_concurrency"), _said("Worker time", elapsed(F.col("sequential_ms"))))
        head = F.concat(head, F.when(F.col("max_concurrency").isNotNull(), timing).otherwise(F.array().cast("array<string>")))
    total = F.coalesce("total_available", "selected")
    covered = _lines("", "## Coverage", "", F.concat(F.lit("- Selected of available: "), "selected", F.lit(" of "), total), _count("Unresolved", "unresolved"), _count("Deselected", "deselected"))
    return _group(own, 0, F.lit(0), F.concat(head, covered))


def _gated(gates: DataFrame) -> DataFrame:
    return _group(gates, 1, F.lit(0), _lines("", "## Gate", "", _said("Recommendation", F.col("status")), *(_count(n.capitalize(), n) for n in ("contradicted", "unsupported", "unverified", "pending"))))


def _claims(items: DataFrame) -> DataFrame:
    """A group for each item. items: ord, sentence_id, reference_id, status, verdict, and claim_text, reason, action, passages where they are."""
    has = lambda c: F.col(c) if c in items.columns else F.lit(None).cast("string")
    head = _lines(
        F.concat(F.lit("### "), F.coalesce(has("claim_text"), F.col("sentence_id"))), "", _said("Sentence", F.col("sentence_id")), _said("Source", F.col("reference_id")), _said("Status", F.col("status"), "unknown"),
        _said("Verdict or stage", F.coalesce("verdict", "status"), "unknown"), _said("Reason", has("reason"), NO_REASON), _said("Recommended action", has("action"), NO_ACTION),
    )
    passages = _listed("Passages", F.transform("passages", lambda p: F.concat(p["passage_id"], F.lit(": "), p["text"]))) if "passages" in items.columns else F.array().cast("array<string>")
    return _group(items, 3, F.col("ord"), F.concat(head, passages, _lines("")))


def _sections(assessed: DataFrame) -> DataFrame:
    """A group for each section. assessed: review_id, section_ord, heading, status, summary, risks, revisions."""
    head = _lines(F.concat(F.lit("### "), F.coalesce("heading", F.lit("Document"))), "", _said("Status", F.col("status"), "unknown"), _said("Summary", F.col("summary"), NO_SUMMARY))
    return _group(assessed, 5, F.col("section_ord"), F.concat(head, _listed("Unresolved risks", F.col("risks")), _listed("Recommended revisions", F.col("revisions")), _lines("")))


def _whole(reports: DataFrame) -> DataFrame:
    """reports: review_id, status, summary, patterns, actions, risks."""
    own = F.concat(_lines(_said("Status", F.col("status"), "unknown"), _said("Report", F.col("summary"), NO_SUMMARY)), _listed("Patterns", F.col("patterns")), _listed("Actions", F.col("actions")), _listed("Unresolved risks", F.col("risks")), _lines(""))
    return _group(reports, 6, F.lit(0), own)


def markdown_lines(items: DataFrame, coverage: DataFrame, workers: DataFrame | None = None, sections: DataFrame | None = None, reports: DataFrame | None = None) -> DataFrame:
    """review_id, line_no (from 1), line. coverage: as review.coverage gives it, with totals or without; workers: review.timings."""
    full = coverage if "deselected" in coverage.columns else coverage.withColumns({"deselected": F.lit(0).cast("long"), "total_available": F.col("selected")})
    counts = review.verdict_histogram(items)
    needs = review.attention_sources(items)
    sources = F.row_number().over(Window.partitionBy("review_id").orderBy("reference_id"))
    groups = [
        _overview(full, workers), _gated(review.gate(items)),
        _titled(counts, 2, "Verdicts"), _group(counts, 2, F.row_number().over(Window.partitionBy("review_id").orderBy("verdict")), _lines(F.concat(F.lit("- "), "verdict", F.lit(": "), "n"))),
        _titled(items, 3, "Claims"), _claims(items),
        _titled(needs, 4, "Sources that need a copy"), _group(needs, 4, sources, _lines(_said_source())),
    ]
    if sections is not None:
        groups += [_titled(sections, 5, "Sections"), _sections(sections)]
    if reports is not None:
        groups += [_titled(reports, 6, "The whole report"), _whole(reports)]
    every = reduce(DataFrame.unionByName, groups).select("review_id", "part", "place", F.posexplode("lines").alias("k", "line"))
    order = Window.partitionBy("review_id").orderBy("part", "place", "k")
    return every.select("review_id", F.row_number().over(order).alias("line_no"), "line")


def _said_source() -> Column:
    return F.concat(F.lit("- "), "reference_id", F.lit(": "), F.coalesce("failure_reason", F.lit("Upload an exact copy.")))


def markdown(lines: DataFrame) -> DataFrame:
    """review_id, markdown: lines as one text a review, for reviews that fit a value."""
    return lines.groupBy("review_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("markdown"))
