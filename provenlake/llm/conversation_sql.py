"""DuckDB SQL of the operators on conversations and of the license scan (operators 11 to 13)."""

from __future__ import annotations

from provenlake.llm import licenses

#: crc32 (the usual polynomial, 0xEDB88320 reversed) of an ASCII string, by a table of 256 entries made by rule.
_TABLE = "crc(t) AS (SELECT list(v ORDER BY i) FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"


def _crc32(text: str) -> str:
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS bigint), list_transform(string_split({text}, ''), lambda x: CAST(ord(x) AS bigint))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _add(state: str, cost: str, edits: str) -> str:
    """A state is six digits of cost, then the edits."""
    return f"lpad(CAST(CAST(left({state}, 6) AS int) + {cost} AS varchar), 6, '0') || substr({state}, 7) || '{edits}'"


def _best(state: str, *more: str) -> str:
    return f"least({', '.join([state, *more])})"


def _if(test: str, value: str) -> str:
    return f"CASE WHEN {test} THEN {value} END"


_EXTRA = "(CASE WHEN c <> lower(c) THEN 3 ELSE 0 END)"
_NEW = lambda s: _if("c <> 'd'", _add(s, f"3 + {_EXTRA}", "R"))
_KEPT = lambda role, s: _if(f"lower(c) = '{role}'", _add(s, _EXTRA, "K"))
_FULL = f"b0 AS f0, b1 AS f1, {_best('b2', _add('b0', '3', 'I'), _add('b1', '3', 'I'), _add('b3', '3', 'I'))} AS f2, {_best('b3', _add('b2', '3', 'I'), _add('b0', '6', 'II'), _add('b1', '6', 'II'))} AS f3"

STRUCTURE_REPAIR = rf"""
WITH RECURSIVE {_TABLE},
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(CAST(conv_id AS varchar), ' ') || ':' || coalesce(CAST(turn AS varchar), ' ')")} % 20 AS kind FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN replace(replace(replace(text, '.', ''), '!', ''), '?', '') ELSE text END AS text
  FROM raw, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS r(copy) WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos, rtrim(text, {_SPACE}) AS bare FROM damaged),
judged AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before,
    CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
lettered AS (
  SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'd' WHEN fault = 'truncated' THEN upper(kind) ELSE kind END AS c
  FROM (SELECT *, CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END AS kind FROM judged)),
conv AS (
  SELECT o.conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, coalesce(string_agg(c, '' ORDER BY pos), '') AS letters
  FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN lettered l ON o.conv_id IS NOT DISTINCT FROM l.conv_id GROUP BY o.conv_id),
signature AS (SELECT DISTINCT letters FROM conv),
layer AS (
  SELECT letters, 0 AS i, {_FULL} FROM (SELECT letters, '000000' AS b0, CAST(NULL AS varchar) AS b1, CAST(NULL AS varchar) AS b2, CAST(NULL AS varchar) AS b3 FROM signature)
  UNION ALL
  SELECT letters, i + 1, {_FULL} FROM (
    SELECT letters, i, {_add("f0", "4", "D")} AS b0,
      {_best(_add("f1", "4", "D"), _KEPT("s", "f0"))} AS b1,
      {_best(_add("f2", "4", "D"), _NEW("f0"), _NEW("f1"), _NEW("f3"), _KEPT("u", "f0"), _KEPT("u", "f1"), _KEPT("u", "f3"))} AS b2,
      {_best(_add("f3", "4", "D"), _NEW("f2"), _KEPT("a", "f2"))} AS b3
    FROM (SELECT *, substr(letters, i + 1, 1) AS c FROM layer WHERE i < length(letters)))),
answer AS (SELECT letters, CAST(left(best, 6) AS bigint) AS cost, substr(best, 7) AS audit FROM (SELECT letters, least(f0, f3) AS best FROM layer WHERE i = length(letters))),
edits AS (
  SELECT conv_id, n, edit, sum(CASE WHEN edit <> 'I' THEN 1 ELSE 0 END) OVER w - 1 AS pos, sum(CASE WHEN edit <> 'D' THEN 1 ELSE 0 END) OVER w AS nth
  FROM (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS n, unnest(string_split(audit, '')) AS edit FROM conv JOIN answer USING (letters) WHERE audit <> '')
  WINDOW w AS (PARTITION BY conv_id ORDER BY n)),
kept AS (
  SELECT e.conv_id, n, nth, edit, CASE WHEN edit = 'I' THEN '' ELSE text END AS text, role, max(CASE WHEN nth = 1 AND edit = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS lead
  FROM edits e LEFT JOIN lettered l ON e.conv_id IS NOT DISTINCT FROM l.conv_id AND e.pos = l.pos WHERE edit <> 'D'),
repaired AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (nth - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY n)) AS sha FROM kept GROUP BY conv_id)
SELECT c.conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM conv c JOIN answer USING (letters) LEFT JOIN repaired r ON c.conv_id IS NOT DISTINCT FROM r.conv_id"""

_KEY = "md5(CAST(strlen(role) AS varchar) || ':' || role || text)"
PREFIX_TRIE = rf"""
WITH {_TABLE},
own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
whole AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, {_KEY}) AS rows, conv_id - ((conv_id % 20) + 20) % 20 AS base, any_value({_crc32("CAST(conv_id AS varchar)")}) % 4 AS h
  FROM own, crc GROUP BY conv_id),
rebuilt AS (
  SELECT w.conv_id, list_concat(coalesce(b.rows, [])[1:w.h], w.rows[w.h + 1:]) AS rows
  FROM whole w LEFT JOIN whole b ON w.base = b.conv_id),
node AS (
  SELECT depth, rows[1:depth] AS prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS varchar), ',' ORDER BY conv_id) FILTER (len(rows) = depth), '')) AS ends_sha256
  FROM (SELECT conv_id, rows, unnest(range(0, len(rows) + 1)) AS depth FROM rebuilt) GROUP BY 1, 2),
weighed AS (
  SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(prefix[depth].text, '[^\x20\x09-\x0D]+')) END AS saved,
    (SELECT count(*) FROM node c WHERE c.depth = n.depth + 1 AND c.prefix[1:n.depth] = n.prefix) AS n_children
  FROM node n)
SELECT n.conv_id, CAST(n.depth AS bigint) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, count(*) FILTER (c.n_children = 0) AS n_leaves, CAST(sum(c.saved) AS bigint) AS saved_tokens, n.ends_sha256
FROM weighed n JOIN weighed c ON c.depth >= n.depth AND c.prefix[1:n.depth] = n.prefix
LEFT JOIN weighed p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]
GROUP BY n.conv_id, n.depth, n.prefix, p.conv_id, n.n_convs, n.n_children, n.ends_sha256"""


def _templates() -> str:
    rows = [f"({t}, '{x.label}', {str(x.base).lower()}, {x.words!r}, {x.required!r})" for t, x in enumerate(licenses.TEMPLATES)]
    return ", ".join(rows)


LICENSE_SCAN = rf"""
WITH template(t, label, base, words, required) AS (VALUES {_templates()}),
doc AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
word AS MATERIALIZED (SELECT rid, unnest(words) AS word, unnest(range(len(words))) AS spot FROM doc),
counts AS (SELECT word, count(DISTINCT rid) AS n FROM word GROUP BY word),
part AS (SELECT t, len(words) AS size, unnest(words) AS word, unnest(range(len(words))) AS i FROM template),
rare AS (
  SELECT t, word FROM (
    SELECT t, size, word, row_number() OVER (PARTITION BY t ORDER BY n, word) AS r
    FROM (SELECT DISTINCT t, size, word, coalesce(n, 0) AS n FROM part LEFT JOIN counts USING (word)))
  WHERE r <= greatest(2, least(4, size // 2))),
starts AS (SELECT rid, t, start FROM (SELECT rid, t, spot - i AS start FROM word JOIN part USING (word) JOIN rare USING (t, word)) WHERE start >= 0 GROUP BY rid, t, start HAVING count(*) >= 2),
met AS (
  SELECT rid, t, start, sum(CASE WHEN doc.words[start + i + 1] = word THEN 1 ELSE 0 END) / any_value(size) AS share,
    bool_and(doc.words[start + i + 1] IS NOT DISTINCT FROM word OR NOT list_contains(template.required, i)) AS stands
  FROM starts JOIN doc USING (rid) JOIN part USING (t) JOIN template USING (t) GROUP BY rid, t, start),
place AS (SELECT rid, start, share, label, base FROM met JOIN template USING (t) WHERE stands AND share >= 0.8)
SELECT any_value(doc_id) AS doc_id, CAST(any_value(len(words)) AS bigint) AS n_words, count(*) FILTER (base) AS n_base, CAST(min(start) FILTER (base) AS bigint) AS first_word, CAST(max(start) FILTER (base) AS bigint) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(share), 0.0) AS score
FROM doc LEFT JOIN place USING (rid) GROUP BY rid"""
