"""Evaluation of expected against actual outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy(expected: DataFrame, actual: DataFrame, high: str = "supported_by_cited_source") -> DataFrame:
    """expected and actual (report_id, ord, verdict): per report and over all (report_id null) the cases, passes, false
    support, accuracy, and whether accuracy is 0.85 at least without false support."""
    j = expected.select("report_id", "ord", F.col("verdict").alias("want")).join(actual.select("report_id", "ord", F.col("verdict").alias("got")), ["report_id", "ord"], "left")
    ok = F.coalesce(F.col("want") == F.col("got"), F.lit(False))
    out = j.rollup("report_id").agg(F.count("*").alias("cases"), F.count_if(ok).alias("passed"), F.count_if((F.col("got") == high) & (F.col("want") != high)).alias("false_support"))
    return out.withColumn("accuracy", F.round(F.col("passed") / F.col("cases"), 6)).withColumn("gate", (F.col("passed") / F.col("cases") >= 0.85) & (F.col("false_support") == 0))


def concepts_pass(text: Column, groups: Column) -> Column:
    """Whether each group of phrases has one that the text holds."""
    low = F.lower(text)
    return F.forall(groups, lambda g: F.exists(g, lambda p: low.contains(F.lower(p))))


def failure_kind(want: Column, got: Column, reason_ok: Column) -> Column:
    return F.when(~want.eqNullSafe(got), "verdict_mismatch").when(~reason_ok, "reason_mismatch").otherwise("none")


def usage(events: DataFrame, fields: list[str]) -> DataFrame:
    """Sums of the counts in a map column ``usage``."""
    return events.agg(*(F.sum(F.coalesce(F.try_element_at("usage", F.lit(f)), F.lit(0))).cast("long").alias(f) for f in fields))


def outcome_cases(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """expected (case_id, verdict, high_impact, concepts array<array<string>>) and actual (case_id, verdict, reason): pass,
    false support of high impact, and why a case fails."""
    j = expected.select("case_id", F.col("verdict").alias("want"), "high_impact", "concepts").join(actual.select("case_id", F.col("verdict").alias("got"), "reason"), "case_id", "left")
    reason_ok = concepts_pass(F.coalesce("reason", F.lit("")), F.coalesce("concepts", F.array().cast("array<array<string>>")))
    kind = failure_kind(F.col("want"), F.col("got"), reason_ok)
    false = F.col("high_impact") & (F.col("got") == "supported_by_cited_source") & (F.col("want") != "supported_by_cited_source")
    return j.select("case_id", "want", "got", (kind == "none").alias("passed"), F.coalesce(false, F.lit(False)).alias("false_support"), kind.alias("failure"))


def outcome_summary(results: DataFrame) -> DataFrame:
    rate = F.avg(F.col("passed").cast("double"))
    return results.agg(F.count("*").alias("cases"), F.round(rate, 6).alias("accuracy"), (rate >= 0.85).alias("accuracy_gate"), (F.count_if("false_support") == 0).alias("safety_gate"))


def contract_errors(want_flag: Column, got_flag: Column, fields: dict[str, tuple[Column, Column]], risks: Column, least: Column, most: Column) -> Column:
    """What a section or report assessment breaks: its flag, concept groups by field, number of risks; joined text."""
    errors = [F.when(~want_flag.eqNullSafe(got_flag), F.lit("needs_human_attention"))]
    errors += [F.when(~concepts_pass(text, groups), F.lit(name)) for name, (text, groups) in fields.items()]
    errors += [F.when(F.size(risks) < F.coalesce(least, F.lit(0)), F.lit("too_few_risks")), F.when(F.size(risks) > F.coalesce(most, F.lit(1 << 30)), F.lit("too_many_risks"))]
    return F.array_join(F.array_compact(F.array(*errors)), "; ")


def response_errors(http: Column, status: tuple[Column, Column], verdict: tuple[Column, Column], forbidden: Column, warnings: tuple[Column, Column]) -> Column:
    """What a response breaks of its case: (wanted, got) pairs; a wanted null asks for nothing."""
    said = [
        F.when(http != 200, F.lit("http")),
        F.when(status[0].isNotNull() & ~status[0].eqNullSafe(status[1]), F.lit("status")),
        F.when(verdict[0].isNotNull() & ~verdict[0].eqNullSafe(verdict[1]), F.lit("verdict")),
        F.when(F.array_contains(F.coalesce(forbidden, F.array().cast("array<string>")), verdict[1]), F.lit("forbidden_verdict")),
        F.when(F.size(F.array_except(F.coalesce(warnings[0], F.array().cast("array<string>")), warnings[1])) > 0, F.lit("warnings")),
    ]
    return F.array_join(F.array_compact(F.array(*said)), "; ")
