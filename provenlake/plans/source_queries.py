"""Queries over sources, records and evaluations, with their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenlake.operators import evaluate, item_log, judging, review
from provenlake.plans import corpus
from provenlake.plans.registry import joined, query, table
from provenlake.plans.store import shared_folder
from provenlake.sources import addresses, docx, fetch, records, snapshots

# -- reports as packages ----------------------------------------------------------------------------------------------------


def _packages(spark, sf_dir) -> DataFrame:
    """A Word package of each conversation, its turns the paragraphs. Of ten one is cut off, one has no document, one another suffix."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                content = docx.write_docx([(r["role"], f"{r['text']}\t{r['turn']}\nend") for r in rows])
                content = {9: content[: len(content) // 2], 7: content.replace(b"word/document.xml", b"word/elsewhere.xm")}.get(conv % 10, content)
                yield pa.record_batch([pa.array([f"report-{conv}.{'doc' if conv % 10 == 8 else 'docx'}"]), pa.array([content], pa.binary())], ["path", "content"])

    own = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND text IS NOT NULL")
    turns = own.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))
    return turns.mapInArrow(write, "path string, content binary")


@query("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, conv_id % 10 AS d FROM conversations WHERE conv_id IS NOT NULL AND text IS NOT NULL)
SELECT 'report-' || conv_id || '.docx' AS report_id, CAST(k AS int) AS ord, role AS style_id, trim(regexp_replace(text || ' ' || turn || ' end', '\\s+', ' ', 'g')) AS text, CAST(NULL AS varchar) AS error FROM t WHERE d < 7
UNION ALL SELECT DISTINCT 'report-' || conv_id || CASE WHEN d = 8 THEN '.doc' ELSE '.docx' END, 0, NULL, NULL, CASE d WHEN 7 THEN 'no_document' WHEN 8 THEN 'suffix' ELSE 'no_zip' END FROM t WHERE d >= 7""")
def docx_paragraphs(spark, sf_dir):
    """Paragraphs of Word reports, by a table function joined laterally."""
    return docx.docx_paragraphs(_packages(spark, sf_dir))


# -- addresses ----------------------------------------------------------------------------------------------------------------

#: Beginnings of addresses: of IPv4 as numbers, of IPv6 as the first two groups.
_V4 = [0, 167772160, 1681915904, 2130706432, 2851995648, 2886729728, 3221225472, 3221225984, 3232235520, 3323068416, 3325256704, 3405803776, 3758096384, 4026531840, 134744064, 1684300800, 2887778304, 3221226496]
_V6 = [(0, 0), (0x2001, 0), (0x2001, 0xDB8), (0x2001, 0x20), (0x2002, 0x7F00), (0x2606, 0x4700), (0xFC12, 1), (0xFD00, 2), (0xFE80, 0), (0xFEBF, 9), (0xFEC0, 0), (0xFF02, 0), (0x100, 0), (0x3FFF, 0x1000), (0x3FFF, 0xFFF), (0x4000, 1), (0x2400, 0xCB00)]


def _hosts() -> tuple[str, str]:
    """An event's host as SQL, and its number as DuckDB's."""
    v4 = f"(element_at(array({', '.join(f'{x}L' for x in _V4)}), CAST(event_id % {len(_V4)} AS int) + 1) + event_id * 37 % 1024)"
    g0, g1 = (f"element_at(array({', '.join(str(x[i]) for x in _V6)}), CAST(event_id % {len(_V6)} AS int) + 1)" for i in (0, 1))
    byte = lambda i: f"CAST(shiftright({v4}, {8 * i}) & 255 AS string)"
    dotted = f"concat_ws('.', {byte(3)}, {byte(2)}, {byte(1)}, {byte(0)})"
    short = f"concat({byte(3)}, '.', CAST({v4} & 16777215 AS string))"
    octal = f"concat('0', conv({byte(3)}, 10, 8), '.', {byte(2)}, '.', CAST({v4} & 65535 AS string))"
    low = "lower(hex(event_id * 7 % 65536))"
    v6 = f"concat('[', lower(hex({g0})), ':', lower(hex({g1})), '::', {low}, ']')"
    forms = [dotted, f"CAST({v4} AS string)", f"concat('0x', lower(hex({v4})))", short, octal, f"concat('[::ffff:', {dotted}, ']')", v6, f"replace({v6}, '::', ':0:0:0:0:0:')", "concat('host', event_id, '.example.org')", f"concat({dotted}, '.', {byte(0)})"]
    return "CASE event_id % 10 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(forms)) + " END", v4


_LIST = lambda xs: "[" + ", ".join(map(str, xs)) + "]"


@query(f"""WITH r(low, high, len, kind) AS (VALUES {', '.join(f"(CAST('{a}' AS uhugeint), CAST('{b}' AS uhugeint), {n}, '{k}')" for a, b, n, k in addresses.ranges())}),
h AS (SELECT event_id, event_id % 10 AS form, CAST({_LIST(_V4)}[event_id % {len(_V4)} + 1] + event_id * 37 % 1024 AS uhugeint) + CAST('{addresses.MAPPED}' AS uhugeint) AS v4,
  CAST({_LIST(x for x, _ in _V6)}[event_id % {len(_V6)} + 1] AS uhugeint) * CAST('{1 << 112}' AS uhugeint) + CAST({_LIST(x for _, x in _V6)}[event_id % {len(_V6)} + 1] AS uhugeint) * CAST('{1 << 96}' AS uhugeint) + CAST(event_id * 7 % 65536 AS uhugeint) AS v6 FROM events),
a AS (SELECT event_id, form, CASE WHEN form < 6 THEN v4 WHEN form < 8 THEN v6 END AS n FROM h)
SELECT event_id, CASE WHEN form = 9 THEN 'bad' ELSE (SELECT max_by(kind, len) FROM r WHERE n BETWEEN low AND high) END AS kind,
  CASE WHEN form = 9 THEN 'host' WHEN form < 8 AND (SELECT max_by(kind, len) FROM r WHERE n BETWEEN low AND high) <> 'public' THEN 'private_address' END AS problem FROM a""")
def network_classes(spark, sf_dir):
    """Hosts written in ten ways, the class of their network, and whether a URL of theirs is fetched."""
    own = table(spark, sf_dir, "events").select("event_id", F.expr(_hosts()[0]).alias("host")).withColumn("a", addresses.address(F.col("host")))
    kind = F.when(F.col("a") == "bad", "bad").otherwise(addresses.network_class(F.col("a")))
    return own.select("event_id", kind.alias("kind"), fetch.url_problem(F.concat(F.lit("https://"), "host", F.lit("/x"))).alias("problem"))


# -- payloads ------------------------------------------------------------------------------------------------------------------

_TYPES = ["Application/PDF; charset=x", "text/html", " text/HTML ; charset=utf-8", "", None, "application/xhtml+xml", "image/png"]
_TYPE = "CASE page_id % 7 " + " ".join(f"WHEN {i} THEN {repr(t) if t is not None else 'CAST(NULL AS varchar(99))'}" for i, t in enumerate(_TYPES)) + " END"
_NAME = "CASE page_id % 5 WHEN 0 THEN 'Copy.PDF' WHEN 1 THEN 'copy.html' WHEN 2 THEN 'copy.HTM' WHEN 3 THEN 'copy.txt' END"


@query(f"""WITH p AS (SELECT *, {_TYPE} AS ct, {_NAME} AS name, CASE WHEN page_id % 3 = 0 THEN url || '.pdf?x=1' ELSE url END AS u, CASE WHEN page_id % 4 = 0 THEN 403 WHEN page_id % 4 = 1 THEN 200 END AS status FROM pages),
m AS (SELECT *, nullif(lower(trim(split_part(coalesce(ct, ''), ';', 1))), '') AS media FROM p),
k AS (SELECT *, CASE WHEN media = 'application/pdf' OR lower(split_part(u, '?', 1)) LIKE '%.pdf' THEN 'text_pdf' WHEN media IN ('text/html', 'application/xhtml+xml') THEN 'html' ELSE 'unknown' END AS kind FROM m)
SELECT page_id, media, kind, kind = 'html' AND (coalesce(status = 403, false) OR page_id % 6 = 0) AS needs_browser, page_id % 6 = 0 OR page_id % 9 = 1 AS timeout,
  CASE WHEN strlen(html) > 3000 THEN 'The source is too large.' END AS refused, CASE WHEN html IS NULL OR html = '' THEN '!empty' WHEN lower(coalesce(ct, '')) LIKE 'application/pdf%' OR lower(coalesce(name, '')) LIKE '%.pdf' THEN 'text_pdf'
    WHEN lower(coalesce(ct, '')) LIKE 'text/html%' OR lower(coalesce(ct, '')) LIKE 'application/xhtml%' OR regexp_matches(lower(coalesce(name, '')), '\\.html?$') THEN 'html' ELSE '!unsupported' END AS uploaded
FROM k""")
def payload_rules(spark, sf_dir):
    """Content types, kinds, the browser's turn, timeouts, size bounds and uploaded copies of pages' payloads."""
    own = table(spark, sf_dir, "pages").select("page_id", "html", F.expr(_TYPE.replace("varchar(99)", "string")).alias("ct"), F.expr(_NAME).alias("name"), F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit(".pdf?x=1"))).otherwise(F.col("url")).alias("u"), F.when(F.col("page_id") % 4 == 0, 403).when(F.col("page_id") % 4 == 1, 200).alias("status"))
    late = F.when(F.col("page_id") % 6 == 0, F.array(F.lit("fetch_timeout"))).otherwise(F.array().cast("array<string>"))
    error, message = F.when(F.col("page_id") % 6 == 0, "ReadTimeout").otherwise("ConnectError"), F.when(F.col("page_id") % 9 == 1, "The read TIMED OUT.")
    own = own.withColumns({"body": F.col("html").cast("binary"), "fetch_status": F.lit("fetched"), "failure_reason": F.lit(None).cast("string"), "kind": fetch.kind(F.col("u"), F.col("ct"), F.lit("unknown"))})
    up, media = records.uploaded_kind(F.col("name"), F.col("ct"), F.col("html").cast("binary")), fetch.media_type(F.col("ct"))
    return fetch.bounded(own, 3000).select("page_id", media.alias("media"), "kind", fetch.needs_browser(F.col("kind"), F.col("status"), late).alias("needs_browser"), fetch.is_timeout(error, message).alias("timeout"), F.col("failure_reason").alias("refused"), up.alias("uploaded"))


@query("""SELECT page_id AS reference_id, CASE WHEN page_id % 3 = 0 THEN 'uploaded' WHEN page_id % 2 = 0 THEN 'exact_fetch' WHEN page_id % 5 = 0 THEN 'browser' ELSE 'failed' END AS method,
  CASE WHEN page_id % 3 = 0 OR page_id % 2 = 0 OR page_id % 5 = 0 THEN 'fetched' ELSE 'failed' END AS fetch_status, CASE WHEN page_id % 3 = 0 OR page_id % 2 = 0 OR page_id % 5 = 0 THEN md5(html) END AS digest FROM pages WHERE html IS NOT NULL""")
def resolved_copies(spark, sf_dir):
    """The copy of each page that counts: uploaded, fetched, rendered."""
    p = table(spark, sf_dir, "pages").where("html IS NOT NULL").select(F.col("page_id").alias("reference_id"), F.col("html").cast("binary").alias("body"))
    own = lambda k: p.where(F.col("reference_id") % k == 0)
    return fetch.resolved(p.select("reference_id"), own(3), own(2), own(5)).select("reference_id", "method", "fetch_status", F.md5("body").alias("digest"))


@query("""WITH c AS (SELECT split_part(url, '?', 1) AS url, page_id AS fetched_at, md5(html) AS digest FROM pages WHERE url IS NOT NULL UNION ALL SELECT 'https://example.org/page-' || page_id % 40, page_id, md5(html) FROM pages),
l AS (SELECT url, max(fetched_at) AS fetched_at, max_by(digest, fetched_at) AS digest FROM c GROUP BY 1),
k AS (SELECT 'https://example.org/page-' || c_custkey % 60 AS url, c_custkey AS reference_id FROM customer)
SELECT reference_id, k.url, substr(sha1(l.url), 1, 16) || CASE WHEN contains(lower(l.url), '.pdf') THEN '.pdf' ELSE '.html' END AS filename, digest, CASE WHEN l.url IS NULL THEN 'failed' ELSE 'fetched' END AS fetch_status, CASE WHEN l.url IS NULL THEN 'No snapshot of ' || k.url END AS failure_reason FROM k LEFT JOIN l ON k.url = l.url""")
def snapshot_manifest(spark, sf_dir):
    """The latest capture of each URL under its file's name, and references that ask for it."""
    p = table(spark, sf_dir, "pages")
    own = p.where("url IS NOT NULL").select(F.split_part("url", F.lit("?"), F.lit(1)).alias("url"), F.col("page_id").alias("fetched_at"), F.md5("html").alias("digest"))
    known = records.manifest(own.unionByName(p.select(F.concat(F.lit("https://example.org/page-"), F.col("page_id") % 40).alias("url"), F.col("page_id").alias("fetched_at"), F.md5("html").alias("digest"))))
    asked = table(spark, sf_dir, "customer").select(F.concat(F.lit("https://example.org/page-"), F.col("c_custkey") % 60).alias("url"), F.col("c_custkey").alias("reference_id"))
    return records.from_manifest(asked, known).select("reference_id", "url", "filename", "digest", "fetch_status", "failure_reason")


# -- selections and answer keys --------------------------------------------------------------------------------------------------


@query("""WITH i AS (SELECT o_custkey AS report_id, o_orderkey AS ord, 's' || o_orderkey % 40 AS sentence_id, CASE WHEN o_orderkey % 9 <> 0 THEN 'r' || o_orderkey % 3 END AS reference_id, CASE WHEN o_orderkey % 4 = 0 THEN 'Text "of" ' || o_orderkey END AS approved_text FROM orders)
SELECT report_id, sentence_id, reference_id, approved_text, CASE WHEN reference_id IS NULL THEN 'missing_key' WHEN count(*) OVER (PARTITION BY report_id, sentence_id, reference_id) > 1 THEN 'repeated_pair' END AS error FROM i
UNION ALL SELECT c_custkey, NULL, NULL, NULL, 'no_selection' FROM customer WHERE NOT EXISTS (SELECT 1 FROM i WHERE report_id = c_custkey)""")
def selection_bodies(spark, sf_dir):
    """Selections as JSON bodies, one for each customer's orders, and read back; a customer without orders sends an empty one."""
    o = table(spark, sf_dir, "orders")
    own = o.select(F.col("o_custkey").alias("report_id"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("s"), F.col("o_orderkey") % 40).alias("sentence_id"), F.when(F.col("o_orderkey") % 9 != 0, F.concat(F.lit("r"), F.col("o_orderkey") % 3)).alias("reference_id"), F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit('Text "of" '), "o_orderkey")).alias("approved_text"))
    bodies = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("report_id")).join(records.selection_body(own), "report_id", "left")
    return records.selections(bodies.select("report_id", F.coalesce("body", F.when(F.col("report_id") % 2 == 0, "[]").otherwise("no list")).alias("body"))).drop("direction")


_KEY = "WITH o AS (SELECT o_custkey AS key_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, ['Partially supported', 'unsupported', 'Supported-by cited  source', 'CONTRADICTED'][o_orderkey % 4 + 1] AS verdict FROM orders)"


@query(f"""{_KEY} SELECT key_id, CAST((k - 1) // 3 + 1 AS int) AS report, CAST((k - 1) % 3 + 1 AS int) AS claim, regexp_replace(lower(verdict), '[\\s-]+', '_', 'g') AS verdict, 'Order ' || o_orderkey || ' was late.' AS excerpt, CASE WHEN o_orderkey % 2 = 0 THEN '[' || o_orderkey % 5 || ']' END AS citation,
  'order ' || o_orderkey || '''s value fell, again' AS compared FROM o""")
def answer_keys(spark, sf_dir):
    """Answer keys written line by line of customers' orders, three claims a report, and read as expected verdicts."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").withColumn("k", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1)
    verdict = F.element_at(F.array(*map(F.lit, ["Partially supported", "unsupported", "Supported-by cited  source", "CONTRADICTED"])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    said = F.concat(F.lit("order "), "o_orderkey", F.lit("’s value [3] fell , again"))
    lines = [F.when(F.col("k") % 3 == 0, F.concat(F.lit("Report "), F.floor(F.col("k") / 3) + 1)), F.lit("A title"), F.concat(F.lit("Claim "), F.col("k") % 3 + 1, F.lit(" : verdict = "), verdict), F.concat(F.lit("Excerpt: Order "), "o_orderkey", F.lit(" was  late.")), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("citation : ["), F.col("o_orderkey") % 5, F.lit("]"))), F.concat(F.lit("Why: "), said)]
    rows = o.select(F.col("o_custkey").alias("key_id"), "k", F.posexplode(F.array(*lines)).alias("p", "text")).where("text IS NOT NULL").select("key_id", (F.col("k") * 10 + F.col("p")).alias("ord"), "text")
    return records.answer_key(rows).select("key_id", "report", "claim", "verdict", "excerpt", "citation", records.claim_key(F.col("why")).alias("compared"))


# -- evaluations ---------------------------------------------------------------------------------------------------------------

_CASES = """SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 5 = 0 THEN 'unsupported' ELSE 'supported_by_cited_source' END AS want, CASE WHEN o_orderkey % 11 <> 3 THEN CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 7 <> 0 THEN 'unsupported' ELSE 'supported_by_cited_source' END END AS got,
  o_orderkey % 2 = 0 AS high_impact, CASE WHEN o_orderkey % 13 = 0 THEN 'No words.' ELSE 'Value of ' || o_orderpriority || ' in ' || o_orderkey END AS reason FROM orders"""


def _cases(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    want = F.when(k % 5 == 0, "unsupported").otherwise("supported_by_cited_source")
    got = F.when((k % 5 == 0) & (k % 7 != 0), "unsupported").otherwise("supported_by_cited_source")
    concepts = F.array(F.array(F.lit("value of"), F.lit("price")), F.array(F.lower("o_orderpriority")))
    own = table(spark, sf_dir, "orders").select(k.alias("case_id"), want.alias("want"), F.when(k % 11 != 3, got).alias("got"), (k % 2 == 0).alias("high_impact"), concepts.alias("concepts"), F.when(k % 13 == 0, "No words.").otherwise(F.concat(F.lit("Value of "), "o_orderpriority", F.lit(" in "), k)).alias("reason"))
    return evaluate.outcome_cases(own.select("case_id", F.col("want").alias("verdict"), "high_impact", "concepts"), own.where("got IS NOT NULL").select("case_id", F.col("got").alias("verdict"), "reason"))


_OUTCOMES = f"SELECT case_id, want, got, high_impact, CASE WHEN want IS DISTINCT FROM got THEN 'verdict_mismatch' WHEN reason = 'No words.' THEN 'reason_mismatch' ELSE 'none' END AS failure FROM ({_CASES})"
_FALSE = "coalesce(high_impact AND got = 'supported_by_cited_source' AND want <> 'supported_by_cited_source', false)"


@query(f"SELECT case_id, want, got, failure = 'none' AS passed, {_FALSE} AS false_support, failure FROM ({_OUTCOMES})")
def outcome_cases(spark, sf_dir):
    return _cases(spark, sf_dir)


@query(f"SELECT count(*) AS cases, round(avg(CASE WHEN failure = 'none' THEN 1e0 ELSE 0e0 END), 6) AS accuracy, avg(CASE WHEN failure = 'none' THEN 1e0 ELSE 0e0 END) >= 0.85 AS accuracy_gate, NOT bool_or({_FALSE}) AS safety_gate FROM ({_OUTCOMES})")
def outcome_summary(spark, sf_dir):
    return evaluate.outcome_summary(_cases(spark, sf_dir))


@query("""SELECT item_id, concat_ws('; ', CASE WHEN item_id % 3 = 0 THEN 'needs_human_attention' END, CASE WHEN NOT contains(lower(text), 'the') THEN 'summary' END, CASE WHEN item_id % 4 < 1 THEN 'too_few_risks' END, CASE WHEN item_id % 4 > 2 THEN 'too_many_risks' END) AS section,
  concat_ws('; ', CASE WHEN item_id % 5 = 0 THEN 'http' END, CASE WHEN item_id % 7 = 0 THEN 'status' END, CASE WHEN item_id % 2 = 1 AND item_id % 6 <> 1 THEN 'verdict' END, CASE WHEN item_id % 6 = 0 THEN 'forbidden_verdict' END, CASE WHEN item_id % 8 = 1 THEN 'warnings' END) AS response FROM benchmark""")
def contract_errors(spark, sf_dir):
    """What assessments and responses made of the benchmark's items break of their contracts."""
    i = F.col("item_id")
    risks = F.array_repeat(F.lit("risk"), (i % 4).cast("int"))
    section = evaluate.contract_errors(i % 3 == 0, F.lit(False), {"summary": (F.col("text"), F.array(F.array(F.lit("The"))))}, risks, F.lit(1), F.lit(2))
    got = F.when(i % 6 == 0, "contradicted").when(i % 6 == 1, "unsupported").otherwise("unverified")
    response = evaluate.response_errors(F.when(i % 5 == 0, 500).otherwise(200), (F.when(i % 7 == 0, "completed"), F.lit("open")), (F.when(i % 2 == 1, "unsupported"), got), F.array(F.lit("contradicted")), (F.when(i % 8 == 1, F.array(F.lit("w"))), F.array(F.lit("v"))))
    return table(spark, sf_dir, "benchmark").select("item_id", section.alias("section"), response.alias("response"))


@query("SELECT CAST(sum(CAST(json_extract_string(props, '$.k') AS bigint)) AS bigint) AS k, CAST(0 AS bigint) AS missing FROM events")
def usage_totals(spark, sf_dir):
    return evaluate.usage(table(spark, sf_dir, "events").select(F.from_json("props", "map<string,bigint>").alias("usage")), ["k", "missing"])


# -- reviews --------------------------------------------------------------------------------------------------------------------


def _results(spark, sf_dir) -> DataFrame:
    sql = corpus.ITEMS.replace("FROM orders", f"FROM parquet.`{sf_dir}/orders.parquet`")
    return spark.sql(sql).select(F.col("review_id").alias("report_id"), "ord", "sentence_id", "reference_id", "status", "verdict", F.when(F.col("ord") % 3 == 0, F.concat(F.lit("Reason "), "ord")).alias("reason"), "fetch_status", "extraction_status")


@query(f"""SELECT i.review_id AS report_id, 'section-' || i.ord % 4 AS section_id, i.sentence_id, i.reference_id, 'Claim ' || i.ord AS claim_text, verdict, CASE WHEN i.ord % 3 = 0 THEN 'Reason ' || i.ord ELSE '' END AS reason FROM ({corpus.ITEMS}) i WHERE verdict IS NOT NULL AND i.ord % 8 <> 0""")
def section_outcomes(spark, sf_dir):
    """Verdicts beside the claims of their sentences, by section; of every eight sentences one has no claim."""
    own = _results(spark, sf_dir)
    asked = own.where("ord % 8 != 0").select("report_id", "sentence_id", F.concat(F.lit("section-"), F.col("ord") % 4).alias("section_id"), F.concat(F.lit("Claim "), "ord").alias("claim_text"))
    return review.section_outcomes(own, asked)


@query(f"""WITH g AS (SELECT review_id, count(*) - count(verdict) AS pending, count(*) FILTER (verdict = 'contradicted') AS contradicted FROM ({corpus.ITEMS}) GROUP BY 1)
SELECT review_id, contradicted = 0 AND pending = 0 AS may_go_on FROM g""")
def sections_may_go_on(spark, sf_dir):
    own = _results(spark, sf_dir).withColumnRenamed("report_id", "review_id")
    return review.may_go_on(review.gate(own)).select("review_id", "may_go_on")


@query(f"""SELECT sentence_id AS claim_id, 'exact_fetch' AS source_method, CASE WHEN status = 'completed' THEN 'completed' ELSE 'model_configuration' END AS stopped_stage, fetch_status, extraction_status, CASE WHEN ord % 6 = 0 THEN 0 ELSE CAST(ord % 6 AS int) END AS n_passages, status = 'completed' AS model_called, 'none' AS model, status FROM ({corpus.ITEMS})""")
def item_traces(spark, sf_dir):
    own = _results(spark, sf_dir).withColumns({"claim_id": F.col("sentence_id"), "n_passages": F.when(F.col("ord") % 6 != 0, (F.col("ord") % 6).cast("int")), "stopped_stage": F.when(F.col("status") == "completed", "completed").otherwise("model_configuration")})
    return review.traces(own)


@query("""SELECT o_orderkey AS claim_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'unsupported' END AS verdict, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 5 = 0 THEN '' ELSE 'p2|p1|p2' END AS passage_ids FROM orders""")
def judge_outputs(spark, sf_dir):
    """A judge's JSON read, and of the passages that it names those that it was given; every third says no known verdict."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(k.alias("claim_id"))
    said = o.select("claim_id", F.when(F.col("claim_id") % 3 == 0, '{"verdict": "maybe"}').otherwise('{"verdict": "unsupported", "reason": "r", "passage_ids": ["p2", "p9", "p1", "p2"]}').alias("output"))
    packet = o.where("claim_id % 5 != 0").select("claim_id", F.explode(F.array(F.lit("p1"), F.lit("p2"), F.lit("p3"))).alias("passage_id"))
    return review.judge_passages(review.judged(said), packet).select("claim_id", "verdict", joined(F.col("passage_ids")).alias("passage_ids"))


@query("""WITH o AS (SELECT DISTINCT o_custkey AS review_id, 'reference-' || o_orderkey % 5 AS reference_id FROM orders), c AS (SELECT * FROM o WHERE review_id % 2 = 0)
SELECT review_id, reference_id, false AS settled FROM c UNION ALL SELECT review_id, reference_id, true FROM o WHERE review_id % 2 <> 0 AND review_id % 3 = 0""")
def remembered_attention(spark, sf_dir):
    """Sources that needed attention before (of every third review) and now (of every second)."""
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("review_id"), F.concat(F.lit("reference-"), F.col("o_orderkey") % 5).alias("reference_id")).distinct()
    return review.merged_attention(own.where("review_id % 3 = 0"), own.where("review_id % 2 = 0"))


@query("""WITH d AS (SELECT event_id, CAST(floor(value * 1000) AS bigint) AS ms FROM events WHERE value IS NOT NULL)
SELECT event_id, CASE WHEN ms < 1000 THEN ms || ' ms' WHEN ms < 60000 THEN printf('%.1f', ms / 1000) || ' s' ELSE ms // 60000 || ' min ' || ms % 60000 // 1000 || ' s' END AS elapsed FROM d""")
def elapsed_times(spark, sf_dir):
    """Durations for people."""
    own = table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_id", F.floor(F.col("value") * 1000).cast("long").alias("ms"))
    return own.select("event_id", records.elapsed(F.col("ms")).alias("elapsed"))


# -- snapshots, judges, metrics, logs -------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT split_part(url, '?', 1) AS url, page_id AS fetched_at, html AS body FROM pages WHERE url IS NOT NULL UNION ALL SELECT 'https://example.org/page-' || page_id % 40, page_id, html FROM pages)
SELECT url, fetched_at, md5(body) AS digest, length(body) AS chars FROM c""")
def snapshot_pages(spark, sf_dir):
    """Pages written as a snapshot in two commits, and read back."""
    path = f"{shared_folder(spark)}/snapshot-{uuid.uuid4().hex}"
    p = table(spark, sf_dir, "pages")
    snapshots.write(p.where("url IS NOT NULL").select(F.split_part("url", F.lit("?"), F.lit(1)).alias("url"), F.col("page_id").alias("fetched_at"), F.col("html").alias("body")), path)
    snapshots.write(p.select(F.concat(F.lit("https://example.org/page-"), F.col("page_id") % 40).alias("url"), F.col("page_id").alias("fetched_at"), F.col("html").alias("body")), path)
    return snapshots.read(spark, path).select("url", "fetched_at", F.md5("body").alias("digest"), F.length("body").cast("long").alias("chars"))


def _rule(row: dict) -> tuple[str, str]:
    """A judge without a model: by the last digits of an order, which fails for some."""
    if row["ord"] % 97 == 0:
        raise TimeoutError(f"no answer for {row['ord']}")
    verdict = corpus.VERDICTS[row["ord"] % 5]
    return verdict, f"{verdict} by order {row['ord']}"


@query(f"""SELECT 'claim-' || o_orderkey AS claim_id, 'source-' || o_custkey % 7 AS source_id, CASE WHEN o_orderkey % 97 <> 0 THEN {corpus.VERDICTS!r}[o_orderkey % 5 + 1] END AS verdict, CASE WHEN o_orderkey % 97 <> 0 THEN {corpus.VERDICTS!r}[o_orderkey % 5 + 1] || ' by order ' || o_orderkey END AS reason,
  CASE WHEN o_orderkey % 97 = 0 THEN 'TimeoutError: no answer for ' || o_orderkey END AS error, CAST(CASE WHEN o_orderkey % 97 = 0 THEN 2 ELSE 1 END AS int) AS attempts FROM orders""")
def judged_claims(spark, sf_dir):
    """Claims through the judge's seam: calls with bounded concurrency, failures as rows."""
    own = table(spark, sf_dir, "orders").select(F.concat(F.lit("claim-"), "o_orderkey").alias("claim_id"), F.concat(F.lit("source-"), F.col("o_custkey") % 7).alias("source_id"), F.col("o_orderkey").alias("ord"))
    return judging.judge(own, _rule, at_once=8, per_source=3)


@query("""WITH v AS (SELECT o_custkey % 100 AS report_id, CASE WHEN o_orderkey % 5 = 0 THEN 'unsupported' ELSE 'supported' END AS want, CASE WHEN o_orderkey % 11 <> 3 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'unsupported' ELSE 'supported' END END AS got FROM orders),
n AS (SELECT report_id, count(got) AS n, avg(CASE WHEN want = got THEN 1e0 ELSE 0e0 END) FILTER (got IS NOT NULL) AS agreed, avg(CASE WHEN want = 'supported' THEN 1e0 ELSE 0e0 END) FILTER (got IS NOT NULL) AS w, avg(CASE WHEN got = 'supported' THEN 1e0 ELSE 0e0 END) FILTER (got IS NOT NULL) AS g FROM v GROUP BY 1),
b AS (SELECT report_id, avg(s) AS balanced FROM (SELECT report_id, want, avg(CASE WHEN want = got THEN 1e0 ELSE 0e0 END) AS s FROM v GROUP BY 1, 2) GROUP BY 1)
SELECT report_id, round(CASE WHEN n = 0 THEN 0 WHEN w * g + (1 - w) * (1 - g) = 1 THEN 1 ELSE (agreed - (w * g + (1 - w) * (1 - g))) / (1 - (w * g + (1 - w) * (1 - g))) END, 6) AS agreement, round(balanced, 6) AS balanced_accuracy FROM n JOIN b USING (report_id)""")
def custom_metrics(spark, sf_dir):
    """Two registered metrics of expected and given verdicts, by report, in SQL."""
    k = F.col("o_orderkey")
    v = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("report_id"), F.when(k % 5 == 0, "unsupported").otherwise("supported").alias("want"), F.when(k % 11 != 3, F.when(k % 3 == 0, "unsupported").otherwise("supported")).alias("got"))
    return judging.measured(v, "report_id", ["agreement", "balanced_accuracy"])


_LOG = "SELECT user_id AS review_id, 'sentence-' || event_id % 5 AS sentence_id, 'reference-' || event_id % 3 AS reference_id, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'invalid_model_output' ELSE 'awaiting_model_config' END AS status, CASE WHEN event_type = 'purchase' THEN 'verdict-' || event_id % 4 END AS verdict FROM events"


@query(f"""WITH l AS ({_LOG}), r AS (SELECT *, min(seq) OVER w AS first_seq, max(seq) OVER w AS last_seq, row_number() OVER (PARTITION BY review_id, sentence_id, reference_id ORDER BY status <> 'completed', CASE WHEN status = 'completed' THEN seq ELSE -seq END) AS k FROM l WINDOW w AS (PARTITION BY review_id, sentence_id, reference_id))
SELECT review_id, sentence_id, reference_id, status, verdict, seq, first_seq, last_seq FROM r WHERE k = 1""")
def item_states(spark, sf_dir):
    """The latest state of each pair of a log of items; every event comes twice, and in no order."""
    e = table(spark, sf_dir, "events")
    i, kind = F.col("event_id"), F.col("event_type")
    log = e.select(F.col("user_id").alias("review_id"), F.concat(F.lit("sentence-"), i % 5).alias("sentence_id"), F.concat(F.lit("reference-"), i % 3).alias("reference_id"), i.alias("seq"), F.when(kind == "purchase", "completed").when(kind == "error", "invalid_model_output").otherwise("awaiting_model_config").alias("status"), F.when(kind == "purchase", F.concat(F.lit("verdict-"), i % 4)).alias("verdict"))
    return item_log.latest(log.unionByName(log))
