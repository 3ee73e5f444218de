"""JSON and text records around reviews: selections, payload manifests, answer keys, uploaded copies, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenlake.functions.text import collapse

SELECTION = "array<struct<sentence_id:string,reference_id:string,approved_claim_text:string,citation_direction:string>>"


def selections(requests: DataFrame) -> DataFrame:
    """requests (report_id, body JSON) to one row for each selected pair; error where the body is no list, is empty, lacks a
    key or repeats a pair."""
    own = requests.withColumn("s", F.from_json("body", SELECTION))
    bad = own.where("s IS NULL OR size(s) = 0").select("report_id", *(F.lit(None).cast("string").alias(c) for c in ("sentence_id", "reference_id", "approved_text", "direction")), F.lit("no_selection").alias("error"))
    rows = own.where("size(s) > 0").select("report_id", F.explode("s").alias("x"))
    rows = rows.select("report_id", "x.sentence_id", "x.reference_id", F.col("x.approved_claim_text").alias("approved_text"), F.col("x.citation_direction").alias("direction"))
    times = F.count("*").over(Window.partitionBy("report_id", "sentence_id", "reference_id"))
    lacks = F.coalesce("sentence_id", F.lit("")).isin("") | F.coalesce("reference_id", F.lit("")).isin("")
    return rows.withColumn("error", F.when(lacks, "missing_key").when(times > 1, "repeated_pair")).unionByName(bad)


def selection_body(expected: DataFrame) -> DataFrame:
    """The JSON body that selects a report's pairs (report_id, ord, sentence_id, reference_id, approved_text), in order."""
    item = F.struct("sentence_id", "reference_id", F.col("approved_text").alias("approved_claim_text"))
    return expected.groupBy("report_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ord", item.alias("x")))), lambda e: e["x"])).alias("body"))


def manifest(payloads: DataFrame) -> DataFrame:
    """One row per URL of fetched payloads (url, fetched_at, ...): the latest; with the name of its snapshot file."""
    latest = payloads.withColumn("_n", F.row_number().over(Window.partitionBy("url").orderBy(F.desc("fetched_at"))))
    return latest.where("_n = 1").drop("_n").withColumn("filename", F.concat(F.substring(F.sha1("url"), 1, 16), F.when(F.lower("url").contains(".pdf"), ".pdf").otherwise(".html")))


def from_manifest(references: DataFrame, known: DataFrame) -> DataFrame:
    """References with their snapshot's payload, or a failed fetch where there is none."""
    out = references.join(known, "url", "left")
    return out.withColumn("fetch_status", F.when(F.col("filename").isNull(), "failed").otherwise("fetched")).withColumn("failure_reason", F.when(F.col("filename").isNull(), F.concat(F.lit("No snapshot of "), "url")))


def uploaded_kind(filename: Column, content_type: Column, body: Column) -> Column:
    """html or text_pdf of an uploaded copy by its type, name or first bytes; an error name after "!" where it is neither."""
    name, kind = F.lower(F.coalesce(filename, F.lit(""))), F.lower(F.coalesce(content_type, F.lit("")))
    pdf = kind.startswith("application/pdf") | name.endswith(".pdf")
    page = kind.startswith("text/html") | kind.startswith("application/xhtml") | name.rlike(r"\.html?$")
    return F.when(body.isNull() | (F.length(body) == 0), "!empty").when(pdf, "text_pdf").when(page, "html").otherwise("!unsupported")


def answer_key(lines: DataFrame) -> DataFrame:
    """Lines of an answer key (key_id, ord, text) to expected verdicts: reports begin with "Report n", claims with
    "Claim n: verdict = ...", followed by excerpt, citation and reason lines."""
    by_key = Window.partitionBy("key_id").orderBy("ord")
    t = collapse("text")
    report = F.when(t.rlike(r"(?i)^report\s+\d+"), F.regexp_extract(t, r"(?i)^report\s+(\d+)", 1).cast("int"))
    claim = F.when(t.rlike(r"(?i)^claim\s+\d+\s*:\s*verdict\s*="), F.regexp_extract(t, r"(?i)^claim\s+(\d+)", 1).cast("int"))
    verdict = F.when(claim.isNotNull(), F.lower(F.regexp_replace(F.trim(F.regexp_extract(t, r"=\s*(.+)$", 1)), r"[\s-]+", "_")))
    field = lambda name: F.when(t.rlike(rf"(?i)^{name}\s*:"), F.trim(F.regexp_extract(t, r":\s*(.*)$", 1)))
    own = lines.select("key_id", "ord", F.last(report, ignorenulls=True).over(by_key).alias("report"), F.last(claim, ignorenulls=True).over(by_key).alias("claim"), report.isNotNull().alias("is_report"), verdict.alias("verdict"), field("excerpt").alias("excerpt"), field("citation").alias("citation"), field("why").alias("why"))
    own = own.where("report IS NOT NULL AND claim IS NOT NULL AND NOT is_report")
    return own.groupBy("key_id", "report", "claim").agg(*(F.max(c).alias(c) for c in ("verdict", "excerpt", "citation", "why"))).where("verdict IS NOT NULL")


def claim_key(text: Column) -> Column:
    """A claim's text as it is compared: plain apostrophes, no markers, no blank before punctuation."""
    t = F.regexp_replace(F.regexp_replace(text, "[‘’]", "'"), r"\s*\[\d+\]", "")
    return collapse(F.regexp_replace(t, r"\s+([.,;:!?])", "$1"))


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of JSON files."""
    return spark.read.option("multiLine", True).json(path)


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def elapsed(ms: Column) -> Column:
    """Milliseconds for people: 850 ms, 2.4 s, 1 min 5 s."""
    s = ms / F.lit(1000)
    return F.when(ms < 1000, F.concat(ms.cast("long").cast("string"), F.lit(" ms"))).when(s < 60, F.concat(F.format_number(s, 1), F.lit(" s"))).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit(" min "), F.floor(s % 60).cast("string"), F.lit(" s")))
