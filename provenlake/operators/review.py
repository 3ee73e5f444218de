"""Reviews: short circuits before a judge, item status, traces, coverage, the gate, sources that need attention, retries.

items: review_id, ord, sentence_id, reference_id, status, verdict, and for attention fetch_status, extraction_status.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WARNED = ["unsupported", "unverified"]


def prejudged(claims: DataFrame) -> DataFrame:
    """claims (fetch_status, extraction_status, failure_reason, n_passages) with what settles them without a judge."""
    failed, ocr, broken, empty = F.col("fetch_status") == "failed", F.col("extraction_status") == "ocr_required", F.col("extraction_status") == "extraction_failed", F.coalesce("n_passages", F.lit(0)) == 0
    warning = F.when(failed, "source_fetch_failed").when(ocr, "ocr_required").when(broken, "source_extraction_failed").when(empty, "weak_retrieval_coverage")
    stage = F.when(failed, "source_fetch").when(ocr | broken, "source_extraction").when(empty, "passage_retrieval")
    default = F.when(failed, "The source could not be fetched.").when(ocr, "The source has no text layer.").when(broken, "The source's text could not be extracted.").when(empty, "No passage of the source bears on the claim.")
    reason = F.when(warning.isNotNull(), F.coalesce(F.when(failed | broken, F.col("failure_reason")), default))
    return claims.select("*", F.when(warning.isNotNull(), "unverified").alias("verdict"), reason.alias("reason"), warning.alias("warning"), stage.alias("stopped_stage"))


def reviewed(claims: DataFrame, judge: Callable | None = None, verdicts: str = "claim_id string, verdict string, reason string") -> DataFrame:
    """Items: settled ones as they are; the others by ``judge`` (a mapInPandas function over them giving ``verdicts``), or
    awaiting one. Only rows that need a judge reach it. An item that it names twice with different words has no valid answer."""
    settled = prejudged(claims)
    done = settled.where("verdict IS NOT NULL").withColumn("status", F.lit("prejudge_unverified"))
    open_ = settled.where("verdict IS NULL").drop("verdict", "reason")
    if judge is None:
        rest = open_.withColumns({"verdict": F.lit(None).cast("string"), "reason": F.lit(None).cast("string"), "status": F.lit("awaiting_model_config"), "stopped_stage": F.lit("model_configuration")})
    else:
        from provenlake.plans.corpus import VERDICTS

        said = once_each(open_.mapInPandas(judge, verdicts).select("claim_id", "verdict", "reason"), ["claim_id"]).where("NOT _differ").drop("_differ")
        rest = open_.join(said, "claim_id", "left").withColumn("status", F.when(F.col("verdict").isin(VERDICTS), "completed").otherwise("invalid_model_output")).withColumn("stopped_stage", F.lit("completed"))
    return done.unionByName(rest)


def once_each(said: DataFrame, keys: list[str]) -> DataFrame:
    """A judge's rows, one for each key; _differ where it said several things of it (the least of which stays)."""
    own = Window.partitionBy(*keys)
    rest = [c for c in said.columns if c not in keys]
    rows = said.distinct().withColumns({"_differ": F.count(F.lit(1)).over(own) > 1, "_nth": F.row_number().over(own.orderBy(*rest))})
    return rows.where("_nth = 1").drop("_nth")


def judge_passages(said: DataFrame, packet: DataFrame) -> DataFrame:
    """Passage ids that a judge named, of those it was given only, in its order and as often."""
    given = packet.groupBy("claim_id").agg(F.collect_set("passage_id").alias("given"))
    return said.join(given, "claim_id", "left").withColumn("passage_ids", F.filter("passage_ids", lambda p: F.array_contains(F.coalesce("given", F.array().cast("array<string>")), p))).drop("given")


def coverage(items: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Per review: selected, completed, unresolved and, with totals (review_id, total_available), deselected."""
    own = items.groupBy("review_id").agg(F.count("*").alias("selected"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "awaiting_model_config").alias("awaiting"), F.count_if(F.col("status") == "prejudge_unverified").alias("prejudged"), F.countDistinct("reference_id").alias("unique_sources"))
    own = own.withColumn("unresolved", F.col("selected") - F.col("completed"))
    return own if totals is None else own.join(totals, "review_id", "left").withColumn("deselected", F.greatest(F.coalesce("total_available", F.lit(0)) - F.col("selected"), F.lit(0)))


def verdict_histogram(items: DataFrame) -> DataFrame:
    return items.where("verdict IS NOT NULL").groupBy("review_id", "verdict").agg(F.count("*").alias("n"))


def gate(items: DataFrame) -> DataFrame:
    """Per review: counts and the recommendation; contradictions come before open items, those before warnings."""
    has = lambda *v: F.count_if(F.col("verdict").isin(*v))
    ids = lambda *v: F.transform(F.array_sort(F.collect_list(F.when(F.col("verdict").isin(*v), F.struct("ord", "sentence_id")))), lambda x: x["sentence_id"])
    g = items.groupBy("review_id").agg(F.count("verdict").alias("checked"), (F.count("*") - F.count("verdict")).alias("pending"), has("contradicted").alias("contradicted"), has("unsupported").alias("unsupported"), has("unverified").alias("unverified"), ids("contradicted").alias("contradicted_ids"), ids(*WARNED).alias("warning_ids"))
    return g.withColumn("status", F.when(F.col("contradicted") > 0, "stop_and_fix").when(F.col("pending") > 0, "review_incomplete").when(F.col("unsupported") + F.col("unverified") > 0, "continue_with_warnings").otherwise("continue"))


UNREADABLE = "The cited source has to be supplied as a readable copy."


def attention_sources(items: DataFrame) -> DataFrame:
    """Per review and reference that could not be read: the sentences it leaves open, in order, and with items that have
    them the first one's canonical_url and failure_reason."""
    bad = items.where("fetch_status = 'failed' OR extraction_status IN ('ocr_required', 'extraction_failed')")
    first = [F.min_by(F.struct(c), "ord")[c].alias(c) for c in ("canonical_url", "failure_reason") if c in items.columns]
    out = bad.groupBy("review_id", "reference_id").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "sentence_id"))), lambda x: x["sentence_id"]).alias("sentence_ids"), *first)
    return out.withColumn("failure_reason", F.coalesce("failure_reason", F.lit(UNREADABLE))) if "failure_reason" in out.columns else out


def retried(items: DataFrame, again: DataFrame) -> DataFrame:
    """Items with those of ``again`` (same columns) in place of the ones not completed; completed ones stay."""
    keys = ["review_id", "sentence_id", "reference_id"]
    open_ = items.where("status != 'completed'").select(*keys)
    new = again.join(open_, keys, "left_semi")
    return items.join(new.select(*keys), keys, "left_anti").unionByName(new)


def timings(workers: DataFrame) -> DataFrame:
    """workers (review_id, worker_id, start_ms, finish_ms): most at once, and the time they would take one by one. Of events
    at one moment, ends come first."""
    from pyspark.sql.window import Window

    ends = workers.select("review_id", F.explode(F.array(F.struct(F.col("start_ms").alias("at"), F.lit(1).alias("d")), F.struct(F.col("finish_ms").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    run = F.sum("e.d").over(Window.partitionBy("review_id").orderBy("e.at", "e.d").rowsBetween(Window.unboundedPreceding, 0))
    most = ends.withColumn("active", run).groupBy("review_id").agg(F.max("active").alias("max_concurrency"))
    return most.join(workers.groupBy("review_id").agg(F.sum(F.col("finish_ms") - F.col("start_ms")).alias("sequential_ms")), "review_id")


def merged_attention(remembered: DataFrame, current: DataFrame) -> DataFrame:
    """Sources that needed attention before and now (review_id, reference_id, ...): current rows win, others count as settled."""
    keys = ["review_id", "reference_id"]
    old = remembered.join(current.select(*keys), keys, "left_anti").withColumn("settled", F.lit(True))
    return current.withColumn("settled", F.lit(False)).unionByName(old)


def payloads(claims: DataFrame, packet: DataFrame, most: int = 5) -> DataFrame:
    """What a judge gets: claims with up to ``most`` passages (claim_id, position, passage_id, text) of their own source."""
    own = packet.join(claims.select("claim_id", F.col("source_id").alias("_source")), "claim_id").where("source_id = _source")
    packed = own.groupBy("claim_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("position", "passage_id", "text"))), 1, most).alias("passages"))
    return claims.join(packed, "claim_id", "left").withColumn("n_passages", F.coalesce(F.size("passages"), F.lit(0)))


def prompts(packed: DataFrame, policy: str) -> DataFrame:
    """A judge's prompt for each payload."""
    said = F.array_join(F.transform("passages", lambda p: F.concat(F.lit("["), p["passage_id"], F.lit("] "), p["text"])), "\n")
    return packed.select("claim_id", F.concat_ws("\n\n", F.lit(policy), F.concat(F.lit("Claim: "), "claim_text"), F.concat(F.lit("Passages:\n"), said)).alias("prompt"))


def judged(raw: DataFrame) -> DataFrame:
    """raw (claim_id, output JSON) to verdict, reason, action, passage_ids, warnings; verdict null where the output is not valid."""
    from provenlake.plans.corpus import VERDICTS

    own = raw.withColumn("o", F.from_json("output", "verdict string, reason string, recommended_action string, passage_ids array<string>, warnings array<string>"))
    return own.select("claim_id", F.when(F.col("o.verdict").isin(VERDICTS), F.col("o.verdict")).alias("verdict"), "o.reason", "o.recommended_action", F.coalesce("o.passage_ids", F.array().cast("array<string>")).alias("passage_ids"), F.coalesce("o.warnings", F.array().cast("array<string>")).alias("warnings"))


def traces(reviewed_items: DataFrame, method: str = "exact_fetch", model: str = "none") -> DataFrame:
    """One row for each item: where it stopped, what it had, whether a model was called."""
    called = F.col("status").isin("completed", "invalid_model_output")
    return reviewed_items.select("claim_id", F.lit(method).alias("source_method"), "stopped_stage", "fetch_status", "extraction_status", F.coalesce("n_passages", F.lit(0)).alias("n_passages"), called.alias("model_called"), F.lit(model).alias("model"), "status")


def section_outcomes(results: DataFrame, claims: DataFrame) -> DataFrame:
    """Verdicts by section, in the order of sentence ids as text; items without a verdict are left out."""
    keys = ["report_id", "sentence_id"]
    own = results.where("verdict IS NOT NULL").join(claims.select(*keys, "section_id", "claim_text"), keys)
    return own.select("report_id", "section_id", "sentence_id", "reference_id", "claim_text", "verdict", F.coalesce("reason", F.lit("")).alias("reason"))


def may_go_on(gates: DataFrame) -> DataFrame:
    """Whether sections may be analysed: not where the gate stops or the review is open."""
    return gates.withColumn("may_go_on", ~F.col("status").isin("stop_and_fix", "review_incomplete"))
