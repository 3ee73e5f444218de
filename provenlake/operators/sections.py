"""Sections and whole reports after a review: texts, subchunks, packets, risks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenlake.functions.text import word_count
from provenlake.operators.intake import REFERENCE_HEADINGS

RISKS = [
    ("contradicted", "Checked claims of this section are contradicted by their source."),
    ("unsupported", "Checked claims of this section are not supported by their source."),
    ("unverified", "Checked claims of this section could not be verified."),
]
STOP = "The gate says to fix evidence before going on."


def section_texts(sectioned: DataFrame) -> DataFrame:
    """Sections with text: paragraphs in order, a blank line between; references are none."""
    own = sectioned.where("NOT is_heading AND NOT in_references").where(F.trim("text") != "").where(~F.lower("heading").isin(REFERENCE_HEADINGS))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.trim("text").alias("t")))), lambda x: x["t"])
    return own.groupBy("report_id", "section_id", "section_ord", "heading").agg(parts.alias("parts")).withColumn("text", F.array_join("parts", "\n\n")).withColumn("word_count", word_count(F.col("text")))


def _pieces(paragraph: Column, limit: int) -> Column:
    """A long paragraph in pieces of ``limit`` words."""
    ws = F.split(F.trim(F.regexp_replace(paragraph, r"(?U)\s+", " ")), " ")
    n = F.ceil(F.size(ws) / F.lit(limit)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(ws, i * limit + 1, limit), " "))


def subchunks(texts: DataFrame, limit: int = 250) -> DataFrame:
    """Sections over ``limit`` words and all others in chunks of whole paragraphs up to it; a longer paragraph is cut by words."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("now"), F.lit(0).alias("n"))
    none = F.array().cast("array<string>")

    def step(s: Column, p: Column) -> Column:
        n = word_count(p)
        flushed = F.when(F.size(s["now"]) > 0, F.concat(s["done"], F.array(F.array_join(s["now"], "\n\n")))).otherwise(s["done"])
        return (
            F.when(n > limit, F.struct(F.concat(flushed, _pieces(p, limit)).alias("done"), none.alias("now"), F.lit(0).alias("n")))
            .when((F.size(s["now"]) > 0) & (s["n"] + n > limit), F.struct(flushed.alias("done"), F.array(p).alias("now"), n.alias("n")))
            .otherwise(F.struct(s["done"].alias("done"), F.concat(s["now"], F.array(p)).alias("now"), (s["n"] + n).alias("n")))
        )

    chunks = F.aggregate("parts", empty, step, lambda s: F.when(F.size(s["now"]) > 0, F.concat(s["done"], F.array(F.array_join(s["now"], "\n\n")))).otherwise(s["done"]))
    out = texts.select("report_id", "section_id", F.posexplode(chunks).alias("k", "content"))
    return out.select("report_id", "section_id", F.concat("section_id", F.lit("-subchunk-"), F.col("k") + 1).alias("subchunk_id"), (F.col("k") + 1).alias("ord"), "content", word_count(F.col("content")).alias("word_count"))


def first_sentence(text: Column) -> Column:
    """Up to the first end mark in the first line; the whole text where that line has none and others follow."""
    t = F.trim(text)
    return F.trim(F.coalesce(F.nullif(F.regexp_extract(t, r"^(.*?(?:[.!?](?:\s|$)|$))", 1), F.lit("")), t))


def synopsis(chunks: DataFrame, first: int = 3) -> DataFrame:
    own = chunks.where(F.col("ord") <= first)
    return own.groupBy("report_id", "section_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", first_sentence(F.col("content")).alias("s")))), lambda x: x["s"]), " ").alias("synopsis"))


def section_risks(outcomes: DataFrame, gates: DataFrame) -> DataFrame:
    """outcomes (review_id, section_id, verdict): up to four messages per section."""
    seen = outcomes.groupBy("review_id", "section_id").agg(F.collect_set("verdict").alias("v"))
    said = [F.when(F.array_contains("v", k), F.lit(t)) for k, t in RISKS] + [F.when(F.col("status") == "stop_and_fix", F.lit(STOP))]
    return seen.join(gates.select("review_id", "status"), "review_id", "left").select("review_id", "section_id", F.array_compact(F.array(*said)).alias("risks"))


def report_risks(gates: DataFrame, assessments: DataFrame, most: int = 12) -> DataFrame:
    """assessments (review_id, section_ord, heading, needs_human_attention, risks): counters, then "heading: risk", distinct."""
    per = assessments.groupBy("review_id").agg(F.count_if("needs_human_attention").alias("human"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("section_ord", "heading", "risks"))), lambda s: F.transform(s["risks"], lambda r: F.concat(s["heading"], F.lit(": "), r)))).alias("own"))
    counted = lambda c, t: F.when(F.coalesce(F.col(c), F.lit(0)) > 0, F.concat(F.col(c).cast("string"), F.lit(t)))
    head = F.array_compact(F.array(counted("contradicted", " checked claims remain contradicted."), counted("unsupported", " checked claims remain unsupported."), counted("unverified", " checked claims remain unverified."), counted("human", " sections need a human.")))
    return gates.join(per, "review_id", "left").select("review_id", F.slice(F.array_distinct(F.concat(head, F.coalesce("own", F.array().cast("array<string>")))), 1, most).alias("risks"))


def packets(texts: DataFrame, chunks: DataFrame, limit: int = 800) -> DataFrame:
    """Per section: its text, or for one over ``limit`` words a synopsis and its subchunks."""
    cut = chunks.groupBy("report_id", "section_id").agg(F.count("*").alias("n_subchunks"))
    j = texts.join(cut, ["report_id", "section_id"], "left").join(synopsis(chunks), ["report_id", "section_id"], "left")
    return j.select("report_id", "section_id", "section_ord", "heading", "word_count", (F.col("word_count") > limit).alias("oversized"), F.when(F.col("word_count") > limit, F.col("synopsis")).otherwise(F.col("text")).alias("section_text"), F.when(F.col("word_count") > limit, F.col("n_subchunks")).otherwise(0).cast("long").alias("n_subchunks"))


def markdown(gates: DataFrame, items: DataFrame) -> DataFrame:
    """A review as Markdown text."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.concat(F.lit("- "), "sentence_id", F.lit(" ("), "reference_id", F.lit("): "), F.coalesce("verdict", "status")).alias("t")))), lambda x: x["t"]), "\n")
    return items.groupBy("review_id").agg(lines.alias("lines")).join(gates.select("review_id", "status"), "review_id").select("review_id", F.concat(F.lit("# Review\n\nGate: "), "status", F.lit("\n\n"), "lines").alias("markdown"))
