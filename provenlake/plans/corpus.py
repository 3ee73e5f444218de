"""A corpus of claims and sources made from the orders table, in SQL that Spark and DuckDB read alike.

Each month's revenue is a claim; a year is a source whose blocks repeat, contradict, narrow or only resemble the claim.
"""

from __future__ import annotations

MONTH_NAMES = "January February March April May June July August September October November December".split()
MONTH = "CASE m " + " ".join(f"WHEN {i + 1} THEN '{n}'" for i, n in enumerate(MONTH_NAMES)) + " END"
NEXT = "CASE m " + " ".join(f"WHEN {i + 1} THEN '{MONTH_NAMES[(i + 1) % 12]}'" for i in range(12)) + " END"

MONTHLY = f"""SELECT y, m, n, {MONTH} AS mon, {NEXT} AS nxt FROM (
  SELECT CAST(year(o_orderdate) AS int) AS y, CAST(month(o_orderdate) AS int) AS m, CAST(sum(CAST(floor(o_totalprice) AS bigint)) AS bigint) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1, 2) t"""

_N, _Y = "CAST(n AS varchar(20))", "CAST(y AS varchar(9))"
#: Claims by m % 6: plain; with a currency, a direction and a qualifier; of a quarter; of a fiscal year; universal; of one metric phrase.
CLAIM_TEXTS = [
    f"'Total revenue was $' || {_N} || ' in ' || mon || ' ' || {_Y} || '.'",
    f"'Net sales rose to US$' || {_N} || ' in ' || mon || ' ' || {_Y} || ', seasonally adjusted.'",
    f"'Operating margin fell to ' || CAST(m AS varchar(9)) || '.5% in the third quarter of ' || {_Y} || '.'",
    f"'Consolidated operating expenses of Harbour Tools were €' || CAST(m AS varchar(9)) || ',250 million in fiscal year ' || {_Y} || '.'",
    f"'Prices were unchanged across all regions in ' || mon || ' ' || {_Y} || ', with 1,' || CAST(m + 100 AS varchar(9)) || ' jobs added.'",
    f"'Machinery order value grew ' || CAST(m AS varchar(9)) || ' percentage points during ' || {_Y} || ', an adjusted estimate.'",
]
CLAIM = "CASE m % 6 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(CLAIM_TEXTS)) + " END"

CLAIMS = f"""SELECT 'claim-' || CAST(y AS varchar(9)) || '-' || CAST(m AS varchar(9)) AS claim_id, 'source-' || CAST(y AS varchar(9)) AS source_id,
  {CLAIM} AS claim_text, CASE WHEN m % 4 = 0 THEN 'The machinery segment of Harbour Tools led the growth.' ELSE '' END AS local_context, y, m, n, mon FROM ({MONTHLY}) k"""

#: (variant, heading, text as SQL)
VARIANTS = [
    ("exact", "Results", "'In ' || mon || ' ' || CAST(y AS varchar(9)) || ', total revenue reached $' || CAST(n AS varchar(20)) || '.'"),
    ("conflict", "Results", "'Total revenue was $' || CAST(n + 7 AS varchar(20)) || ' in ' || mon || ' ' || CAST(y AS varchar(9)) || ' after review.'"),
    ("wrong_month", "Results", "'Total revenue was $' || CAST(n AS varchar(20)) || ' in ' || nxt || ' ' || CAST(y AS varchar(9)) || '.'"),
    ("segment", "Segments", "'In the machinery segment, revenue was $' || CAST(n - 1000 AS varchar(20)) || ' in ' || mon || ' ' || CAST(y AS varchar(9)) || '.'"),
    ("down", "Results", "'Total revenue fell in ' || mon || ' ' || CAST(y AS varchar(9)) || ' against the year before.'"),
    ("thousand", "Results", "'Revenue was $' || CAST(n - n % 1000 AS varchar(20)) || ' in ' || mon || ' ' || CAST(y AS varchar(9)) || ', or about $' || CAST(CAST(floor((n - n % 1000) / 1000) AS bigint) AS varchar(20)) || ' thousand.'"),
    ("fragment", "Results", "'$' || CAST(n AS varchar(20))"),
    ("boilerplate", "Technical notes", "'Definitions of total revenue for ' || mon || ' ' || CAST(y AS varchar(9)) || ' are subject to revision.'"),
    ("table_row", "Results", "'Table: Monthly revenue. Row: ' || mon || ' ' || CAST(y AS varchar(9)) || '. Value: $' || CAST(n AS varchar(20)) || '.'"),
    ("usd", "Key findings", f"'Net sales increased to US$' || {_N} || ' in ' || mon || ' ' || {_Y} || ' on an organic basis.'"),
    ("eur", "Key findings", f"'Net sales were €' || {_N} || ' in ' || mon || ' ' || {_Y} || ', a preliminary figure.'"),
    ("quarter", "Overview", f"'Operating margin declined to ' || CAST(m AS varchar(9)) || '.5% in Q3 ' || {_Y} || ' and 7 bps more in the fourth quarter of fiscal year ' || {_Y} || '.'"),
    ("fiscal", "Overview", f"'Harbour Tools kept operating expenses at €' || CAST(m AS varchar(9)) || ',250 million in FY ' || {_Y} || ', down from 2 billion.'"),
    ("jobs", "Overview", f"'Prices were flat in some states; 1,' || CAST(m + 100 AS varchar(9)) || ' jobs were added in ' || mon || ' ' || {_Y} || '.'"),
    ("points", "Results", f"'The order value of machinery grew ' || CAST(m AS varchar(9)) || ' percentage points from ' || {_Y} || ' through ' || CAST(y + 1 AS varchar(9)) || ', a forecast.'"),
    ("share", "Results", f"CAST(m AS varchar(9)) || ',250 million, fiscal year ' || {_Y}"),
    ("unrelated", "Other", "'the weather stayed mild and the harbour was calm that week.'"),
]

BLOCKS = " UNION ALL ".join(
    f"SELECT 'source-' || CAST(y AS varchar(9)) AS source_id, m * 40 + {i} AS block_ord, 'source-' || CAST(y AS varchar(9)) || '-block-' || CAST(m * 40 + {i} AS varchar(9)) AS block_id, "
    f"{text} AS text, '{heading}' AS heading, CAST(floor((m + 2) / 3) AS int) AS page, CAST(NULL AS varchar(99)) AS span, '{name}' AS variant FROM ({MONTHLY}) k{i}"
    for i, (name, heading, text) in enumerate(VARIANTS)
)

#: Verdict items: a review for each customer, an item for each of its orders.
VERDICTS = ["supported_by_cited_source", "partially_supported", "unsupported", "contradicted", "unverified"]
ITEMS = """SELECT o_custkey AS review_id, o_orderkey AS ord, 'sentence-' || CAST(o_orderkey AS varchar(20)) AS sentence_id, 'reference-' || CAST(o_orderkey % 3 + 1 AS varchar(20)) AS reference_id,
  CASE WHEN o_orderkey % 11 = 0 THEN 'awaiting_model_config' WHEN o_orderkey % 7 = 0 THEN 'prejudge_unverified' ELSE 'completed' END AS status,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'unverified' ELSE CASE o_orderkey % 5 WHEN 0 THEN 'supported_by_cited_source' WHEN 1 THEN 'partially_supported' WHEN 2 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'contradicted' ELSE 'unsupported' END WHEN 3 THEN 'unverified' ELSE 'supported_by_cited_source' END END AS verdict,
  CASE WHEN o_orderkey % 13 = 0 THEN 'failed' ELSE 'fetched' END AS fetch_status,
  CASE WHEN o_orderkey % 17 = 0 THEN 'extraction_failed' WHEN o_orderkey % 19 = 0 THEN 'ocr_required' ELSE 'extracted' END AS extraction_status FROM orders"""

#: Report paragraphs: a conversation is a report, a turn a paragraph; user turns are headings, each cites one source.
PARAGRAPHS = """SELECT conv_id AS report_id, turn AS ord, CASE WHEN role = 'user' THEN 'Heading 2' ELSE 'Normal' END AS style_id,
  CASE WHEN role = 'user' THEN text ELSE text || ' [' || CAST(turn % 5 + 1 AS varchar(9)) || ']' END AS text FROM conversations WHERE text IS NOT NULL"""
