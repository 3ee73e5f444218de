"""Pages in SQL: what DuckDB says of HTML pages and of tables made from line items."""

from __future__ import annotations

from provenlake.sources import html

_TOKEN = "(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<[^>]*>|[^<]+"
_PLAIN = "regexp_replace(replace(replace(replace(replace(replace(t, '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g')"


def _in(x: str, values) -> str:
    return f"{x} IN ({', '.join(repr(v) for v in sorted(values))})"


def _squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


_BLOCK = html.HEADINGS | html.BLOCKS | html.CONTAINERS
_PROSE = f"(length(said) >= 40 AND len(regexp_extract_all(said, '{html.WORD.replace(chr(39), chr(39) * 2)}')) >= 5 OR length(said) >= 16 AND len(regexp_extract_all(said, '{html.WORD.replace(chr(39), chr(39) * 2)}')) >= 3 AND regexp_matches(said, '[0-9]'))"
_FRAME = "STRUCT(tag varchar, main boolean, leaf boolean, text varchar)[]"
_OUT = "STRUCT(text varchar, heading varchar, main boolean)[]"

#: Blocks of pages (without tables): a page's markup folded tag by tag, the open elements a list.
PAGE_BLOCKS = f"""
WITH RECURSIVE token AS (
  SELECT page_id, list_filter(regexp_extract_all(html, '{_TOKEN}'), lambda t: NOT starts_with(t, '<!') AND NOT starts_with(t, '<script') AND NOT starts_with(t, '<style')) AS ts FROM pages WHERE html IS NOT NULL),
event AS (
  SELECT page_id, list_transform(ts, lambda t: {{'kind': CASE WHEN starts_with(t, '</') THEN 'close' WHEN starts_with(t, '<') THEN 'open' ELSE 'text' END,
    'tag': CASE WHEN starts_with(t, '<') THEN lower(regexp_extract(t, '^</?([a-zA-Z0-9]+)', 1)) ELSE '' END, 'text': CASE WHEN starts_with(t, '<') THEN '' ELSE {_PLAIN} END}}) AS es FROM token),
fold AS (
  SELECT page_id, es, 0 AS i, 0 AS unread, '' AS region, 0 AS depth, CAST([] AS {_FRAME}) AS stack, CAST(NULL AS varchar) AS heading, 0 AS main, false AS saw_main, CAST([] AS {_OUT}) AS out FROM event
  UNION ALL
  SELECT page_id, es, i + 1,
    CASE WHEN is_unread AND NOT is_void THEN CASE kind WHEN 'open' THEN unread + 1 ELSE greatest(0, unread - 1) END ELSE unread END,
    CASE WHEN is_unread OR kind = 'text' THEN region WHEN region <> '' THEN CASE WHEN kind = 'close' AND tag = region AND depth = 1 THEN '' ELSE region END WHEN kind = 'open' AND is_aside THEN tag ELSE region END,
    CASE WHEN is_unread OR kind = 'text' THEN depth WHEN region <> '' THEN CASE WHEN tag <> region THEN depth WHEN kind = 'open' THEN depth + 1 ELSE depth - 1 END WHEN kind = 'open' AND is_aside THEN 1 ELSE depth END,
    CASE WHEN pops THEN stack[1:len(stack) - 1]
      WHEN pushes THEN list_concat(CASE WHEN is_heading OR len(stack) = 0 THEN stack ELSE list_concat(stack[1:len(stack) - 1], [{{'tag': top.tag, 'main': top.main, 'leaf': false, 'text': top.text}}]) END, [{{'tag': tag, 'main': main > 0, 'leaf': true, 'text': ''}}])
      WHEN adds THEN list_concat(stack[1:len(stack) - 1], [{{'tag': top.tag, 'main': top.main, 'leaf': top.leaf, 'text': top.text || said_raw}}]) ELSE stack END,
    CASE WHEN pops AND said <> '' AND {_in("top.tag", html.HEADINGS)} THEN said ELSE heading END,
    CASE WHEN NOT shown OR tag <> 'main' THEN main WHEN kind = 'open' THEN main + 1 ELSE greatest(0, main - 1) END,
    saw_main OR (shown AND tag = 'main' AND kind = 'open'),
    CASE WHEN pops AND said <> '' AND NOT {_in("top.tag", html.HEADINGS)} AND (NOT {_in("top.tag", html.CONTAINERS)} OR top.leaf AND {_PROSE}) THEN list_concat(out, [{{'text': said, 'heading': heading, 'main': top.main}}]) ELSE out END
  FROM (
    SELECT *, shown AND kind = 'open' AND is_block AS pushes, shown AND kind = 'text' AND len(stack) > 0 AS adds, len(stack) > 0 AND (kind = 'end' OR shown AND kind = 'close' AND is_block AND top.tag = tag) AS pops, {_squeezed("top.text")} AS said
    FROM (
      SELECT *, es[i + 1].text AS said_raw, stack[len(stack)] AS top, NOT is_unread AND unread = 0 AND region = '' AND NOT (kind = 'open' AND is_aside) AS shown
      FROM (
        SELECT *, {_in("tag", html.UNREAD)} AS is_unread, {_in("tag", html.VOID)} AS is_void, {_in("tag", html.ASIDE)} AS is_aside, {_in("tag", _BLOCK)} AS is_block, {_in("tag", html.HEADINGS)} AS is_heading
        FROM (SELECT *, CASE WHEN i < len(es) THEN es[i + 1].kind ELSE 'end' END AS kind, CASE WHEN i < len(es) THEN es[i + 1].tag ELSE '' END AS tag FROM fold WHERE i < len(es) OR len(stack) > 0))))),
found AS (SELECT page_id, list_filter(out, lambda b: b.main OR NOT saw_main) AS bs FROM fold WHERE i >= len(es) AND len(stack) = 0),
block AS (SELECT page_id, unnest(range(1, len(bs) + 1)) AS k, unnest(bs) AS b FROM found)"""

HTML_BLOCKS = f"{PAGE_BLOCKS} SELECT CAST(page_id AS varchar) AS source_id, CAST(k AS int) AS block_ord, page_id || '-block-' || k AS block_id, b.text AS text, b.heading AS heading, 'html-block-' || k AS span FROM block"
HTML_STATUS = f"""{PAGE_BLOCKS}, n AS (SELECT page_id, count(*) AS n FROM block GROUP BY 1)
SELECT CAST(page_id AS varchar) AS source_id, 'html' AS source_kind, coalesce(n, 0) AS n_blocks, CASE WHEN n IS NULL THEN 'extraction_failed' ELSE 'extracted' END AS extraction_status FROM pages LEFT JOIN n USING (page_id)"""

#: Headers of the line item tables by supplier mod 4, and where their cells lie: (kind, row, left, columns, text).
HEADERS = [
    "<thead><tr><th rowspan=2>Part</th><th colspan=3>Amounts</th></tr><tr><th>Quantity</th><th>Price</th><th>Tax</th></tr></thead>",
    "<tr><th>Part</th><th rowspan='2'>Quantity</th><th colspan='2'>Money</th></tr><tr><th>number</th><th>Price</th><th>Tax</th></tr>",
    "",
    "<tr><th rowspan=9>A</th><th colspan=2>B</th><th>C</th></tr><tr><th>D</th><th rowspan=2>E</th><th>F</th></tr><tr><th>G</th><th>H</th></tr>",
]
PLACED = [
    (0, 1, 0, 1, "Part"), (0, 1, 1, 3, "Amounts"), (0, 2, 1, 1, "Quantity"), (0, 2, 2, 1, "Price"), (0, 2, 3, 1, "Tax"),
    (1, 1, 0, 1, "Part"), (1, 1, 1, 1, "Quantity"), (1, 1, 2, 2, "Money"), (1, 2, 0, 1, "number"), (1, 2, 2, 1, "Price"), (1, 2, 3, 1, "Tax"),
    (3, 1, 0, 1, "A"), (3, 1, 1, 2, "B"), (3, 1, 3, 1, "C"), (3, 2, 1, 1, "D"), (3, 2, 2, 1, "E"), (3, 2, 3, 1, "F"), (3, 3, 1, 1, "G"), (3, 3, 3, 1, "H"),
]
HEADER_GRID = f"""
WITH line AS (
  SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice) AS r,
    CAST(CAST(l_quantity AS bigint) AS varchar) AS quantity, CAST(CAST(floor(l_extendedprice) AS bigint) AS varchar) AS price, l_linenumber % 3 = 0 AS wide, l_linenumber = 7 AS words
  FROM lineitem),
cell AS (
  SELECT l_suppkey, r, 0 AS col, 'Line ' || l_orderkey || '/' || l_linenumber AS text FROM line
  UNION ALL SELECT l_suppkey, r, 1, CASE WHEN words THEN 'none' ELSE quantity END FROM line
  UNION ALL SELECT l_suppkey, r, 2, CASE WHEN words THEN 'none' WHEN wide THEN quantity ELSE price END FROM line
  UNION ALL SELECT l_suppkey, r, 3, CASE WHEN words THEN '' ELSE price END FROM line),
head(kind, top, low, cols, text) AS (VALUES {", ".join(map(str, PLACED))}),
name AS (SELECT kind, col, string_agg(text, ' ' ORDER BY top) AS name FROM head JOIN range(4) c(col) ON col BETWEEN low AND low + cols - 1 GROUP BY 1, 2),
said AS (
  SELECT l_suppkey, r, max(CASE WHEN c.col = 0 THEN c.text END) AS label, string_agg(coalesce(n.name, 'Column ' || (c.col + 1)) || ': ' || c.text, '. ' ORDER BY c.col) FILTER (c.col > 0 AND c.text <> '') AS said, bool_or(c.col > 0 AND regexp_matches(c.text, '[0-9]')) AS counts
  FROM cell c LEFT JOIN name n ON n.kind = l_suppkey % 4 AND n.col = c.col GROUP BY 1, 2)
SELECT CAST(l_suppkey AS varchar) AS source_id, CAST(k AS int) AS block_ord, 'Table: Lines of ' || l_suppkey || '. Row: ' || label || '. ' || said || '.' AS text, 'Supplier ' || l_suppkey AS heading
FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY r) AS k FROM said WHERE counts)"""
