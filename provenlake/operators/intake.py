"""Reports: sections, references, sentences, citations and claims.

paragraphs: report_id, ord, style_id, text. Windows partition by report; a report is one document, so its group is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenlake.functions.text import collapse, markers, sentences, strip_markers

REFERENCE_HEADINGS = ["references", "bibliography", "sources"]


def _order():
    return Window.partitionBy("report_id").orderBy("ord")


def is_heading(style: Column) -> Column:
    return F.lower(F.coalesce(style, F.lit(""))).startswith("heading")


def sections(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs with section_id, heading and whether they are references. The first section is an implied "Document"; a
    reference heading begins the references, any later heading ends them; headings are no paragraphs of their own."""
    p = paragraphs.withColumn("text", collapse(F.coalesce("text", F.lit("")))).withColumn("is_heading", is_heading(F.col("style_id")) & (F.col("text") != ""))
    kind = F.when(F.col("is_heading"), F.lower("text").isin(REFERENCE_HEADINGS))
    p = p.withColumn("in_references", F.coalesce(F.last(kind, ignorenulls=True).over(_order()), F.lit(False)))
    body = F.col("is_heading") & ~F.lower("text").isin(REFERENCE_HEADINGS)
    p = p.withColumn("section_ord", F.sum(body.cast("int")).over(_order()) + 1)
    p = p.withColumn("heading", F.coalesce(F.last(F.when(body, F.col("text")), ignorenulls=True).over(_order()), F.lit("Document")))
    return p.withColumn("section_id", F.concat(F.lit("section-"), F.col("section_ord")))


def references(sectioned: DataFrame) -> DataFrame:
    """Entries "[n] text", "n. text" or "n) text" of the references; label null where an entry is not understood."""
    own = sectioned.where("in_references AND NOT is_heading AND text != ''")
    label = F.coalesce(*(F.when(F.col("text").rlike(p), F.regexp_extract("text", p, 1)) for p in (r"^\[(\d+)\]\s*(.+)$", r"^(\d+)[.)]\s*(.+)$")))
    own = own.withColumn("label", label).withColumn("url", source_url(F.col("text")))
    return own.withColumn("reference_id", F.concat(F.lit("reference-"), F.row_number().over(_order()))).select("report_id", "ord", "reference_id", "label", F.col("text").alias("raw_text"), "url", kind_of_url(F.col("url")).alias("source_kind"))


def source_url(text: Column) -> Column:
    """The first URL, without punctuation after it."""
    found = F.regexp_replace(F.regexp_extract(text, r"(https?://\S+)", 1), r"[.,;:)\]]+$", "")
    return F.when(found != "", found)


def kind_of_url(url: Column) -> Column:
    return F.when(F.lower(F.coalesce(url, F.lit(""))).contains(".pdf"), "text_pdf").otherwise("html")


def report_sentences(sectioned: DataFrame) -> DataFrame:
    own = sectioned.where("NOT is_heading AND NOT in_references AND text != ''")
    own = own.withColumn("paragraph_id", F.concat(F.lit("paragraph-"), F.row_number().over(_order())))
    return own.select("report_id", "section_id", "section_ord", "heading", "paragraph_id", "ord", F.posexplode(sentences(F.col("text"), cited=True)).alias("idx", "sentence"))


def claim_sentences(sents: DataFrame, refs: DataFrame) -> DataFrame:
    """Sentences with citations: direction, anchor, candidates, scope, following context, references by label.

    A marker that leads a sentence with text of its own, after another sentence, is ambiguous; leading with text it points
    forward; alone it points back to the sentence before; else it belongs to its own sentence."""
    by_paragraph = Window.partitionBy("report_id", "paragraph_id").orderBy("idx")
    s = sents.withColumn("plain", strip_markers(F.col("sentence"))).withColumn("all", F.collect_list("sentence").over(by_paragraph.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    s = s.withColumn("before", F.lag("plain").over(by_paragraph)).withColumn("labels", markers(F.col("sentence"))).where(F.size("labels") > 0)
    leads, text, prev = F.col("sentence").rlike(r"^\s*\[\d+\]"), F.col("plain").rlike(r"(?U)\w"), F.col("before").isNotNull()
    back = leads & ~text & prev
    s = s.withColumn("direction", F.when(leads & text & prev, "ambiguous").when(leads & text, "forward").otherwise("backward"))
    s = s.withColumn("anchor", F.when(back, F.col("idx") - 1).otherwise(F.col("idx")))
    candidate = lambda d, t, i: F.struct(F.lit(d).alias("direction"), t.alias("sentence_text"), i.alias("sentence_index"))
    s = s.withColumn(
        "candidates",
        F.when(F.col("direction") == "ambiguous", F.array(candidate("backward", F.col("before"), F.col("idx") - 1), candidate("forward", F.col("plain"), F.col("idx"))))
        .when(F.col("direction") == "forward", F.array(candidate("forward", F.col("plain"), F.col("idx"))))
        .otherwise(F.array(candidate("backward", F.when(back, F.col("before")).otherwise(F.col("plain")), F.col("anchor")))),
    )
    end = F.when(F.col("direction") == "ambiguous", F.col("idx")).otherwise(F.col("anchor"))
    first = F.greatest(F.lit(0), end - 2)
    s = s.withColumn("scope", F.filter(F.slice("all", first + 1, end - first + 1), lambda x: strip_markers(x).rlike(r"(?U)\w"))).withColumn("following", F.slice("all", F.col("anchor") + 2, 1))
    joined = F.concat_ws(" ", F.col("before"), F.array_join(F.transform("labels", lambda x: F.concat(F.lit("["), x, F.lit("]"))), ""))
    s = s.withColumn("claim_text", F.when(back, joined).otherwise(F.col("sentence")))
    s = s.withColumn("sentence_id", F.concat(F.lit("sentence-"), F.row_number().over(Window.partitionBy("report_id").orderBy("ord", "idx"))))
    known = refs.where("label IS NOT NULL").groupBy("report_id", "label").agg(F.count("*").alias("n"), F.min("reference_id").alias("reference_id"))
    cites = s.select("report_id", "sentence_id", F.posexplode("labels").alias("k", "label")).join(known, ["report_id", "label"], "left")
    status = F.when(F.col("n") == 1, "mapped").when(F.col("n") > 1, "ambiguous").otherwise("unmapped")
    cites = cites.select("report_id", "sentence_id", F.struct("k", "label", status.alias("status"), F.when(F.col("n") == 1, F.col("reference_id")).alias("reference_id")).alias("c")).groupBy("report_id", "sentence_id").agg(F.array_sort(F.collect_list("c")).alias("citations"))
    out = s.join(cites, ["report_id", "sentence_id"]).withColumn("reference_ids", F.array_distinct(F.array_compact(F.transform("citations", lambda c: c["reference_id"]))))
    return out.select("report_id", "section_id", "paragraph_id", "sentence_id", "ord", "idx", "sentence", "plain", "claim_text", "direction", "anchor", "candidates", "scope", "following", "citations", "reference_ids", (F.col("direction") == "ambiguous").alias("needs_confirmation"))


def structure_errors(sectioned: DataFrame, refs: DataFrame, claims: DataFrame) -> DataFrame:
    """Reports that lack references or citations, with what they lack."""
    reports = sectioned.select("report_id").distinct()
    lacks = lambda df, what: reports.join(df.select("report_id").distinct(), "report_id", "left_anti").withColumn("error", F.lit(what))
    return lacks(sectioned.where("is_heading AND in_references"), "no_reference_heading").union(lacks(refs.where("label IS NOT NULL"), "no_references")).union(lacks(claims, "no_citations"))


def selected_claims(claims: DataFrame, selections: DataFrame) -> DataFrame:
    """selections (report_id, sentence_id, reference_id, approved_text, direction) bound to claims, with an error where a
    selection is not valid: unknown sentence, reference not linked, direction not confirmed, or a repeated pair."""
    want = F.col("direction_wanted")
    j = selections.withColumnRenamed("direction", "direction_wanted").withColumn("times", F.count("*").over(Window.partitionBy("report_id", "sentence_id", "reference_id"))).join(claims, ["report_id", "sentence_id"], "left")
    picked = F.try_element_at(F.transform(F.filter("candidates", lambda c: c["direction"] == want), lambda c: c["sentence_text"]), F.lit(1))
    both = F.array_join(F.transform("candidates", lambda c: c["sentence_text"]), " ")
    text = F.coalesce(F.when(F.trim("approved_text") != "", F.trim("approved_text")), F.when(want == "both", both), picked, F.col("plain"))
    error = F.when(F.col("times") > 1, "repeated_pair").when(F.col("sentence").isNull(), "unknown_sentence").when(~F.array_contains("reference_ids", F.col("reference_id")), "reference_not_linked").when(F.col("needs_confirmation") & want.isNull(), "direction_needs_confirmation")
    return j.select("report_id", "sentence_id", "reference_id", F.concat(F.lit("claim-"), "sentence_id").alias("claim_id"), F.coalesce(want, F.col("direction")).alias("direction"), F.when(error.isNull(), text).alias("claim_text"), error.alias("error"))
