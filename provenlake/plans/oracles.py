"""DuckDB SQL of the rules for anchors, scores and the choice of evidence, for comparison with the engine.

Patterns come from ``fixed``, put in RE2's words: it has no look-around, so a number's left neighbour is matched with it, and
its flag U means something else. Written as set operations of its own over lists, step by step, not from the Column code.
"""

from __future__ import annotations

from provenlake.functions import fixed
from provenlake.functions.periods import _QUARTER_OF
from provenlake.plans import corpus

MASK = "~~"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def mapping(table: dict, cast: str = "") -> str:
    return "MAP {" + ", ".join(f"{quoted(k)}: {v if cast else quoted(v)}" for k, v in table.items()) + "}"


def re2(pattern: str) -> str:
    return quoted(pattern.replace("(?iU)", "(?i)").replace("(?U)", "").replace(r"(?<![\w.])", r"(?:^|[^\w.])"))


def distinct(x: str) -> str:
    return f"list_sort(list_distinct({x}))"


def meet(a: str, b: str) -> str:
    return f"list_has_any({a}, {b})"


def common(a: str, b: str) -> str:
    return f"list_filter({a}, lambda v: list_contains({b}, v))"


def apart(a: str, b: str) -> str:
    return f"(len({a}) > 0 AND len({b}) > 0 AND NOT {meet(a, b)})"


def total(x: str) -> str:
    return f"list_reduce(list_concat([0e0], {x}), lambda s, v: s + v)"


def named(text: str, table) -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches({text}, {quoted('(?i)' + p)}) THEN {quoted(n)} END" for n, p in table)
    return f"list_sort(list_filter([{cases}], lambda v: v IS NOT NULL))"


def tokens(text: str) -> str:
    pattern = quoted(fixed.TOKEN.replace("A-Z", ""))
    return f"list_sort(list_filter(list_distinct(regexp_extract_all(lower({text}), {pattern})), lambda v: NOT list_contains({listed(fixed.STOPWORDS)}, v)))"


def identity_terms(text: str) -> str:
    bare = "regexp_replace(regexp_replace(t, '^[-''/]+', ''), '[-''/]+$', '')"
    own = f"list_transform(list_filter({tokens(text)}, lambda t: NOT regexp_matches(t, '[0-9]')), lambda t: {bare})"
    one = (
        "CASE WHEN length(t) > 4 AND ends_with(t, 'ies') THEN t[:-4] || 'y' WHEN length(t) > 4 AND regexp_matches(t, '(ch|sh|x|z|s)es$') THEN t[:-3] "
        "WHEN length(t) > 4 AND regexp_matches(t, '[^s]s$') THEN t[:-2] ELSE t END"
    )
    return f"list_sort(list_filter(list_distinct(list_transform({own}, lambda t: {one})), lambda t: length(t) >= 4 AND NOT list_contains({listed(fixed.IDENTITY_EXCLUSIONS)}, t)))"


def anchors(source: str, text: str = "text") -> str:
    """source's columns and, as lists, the anchors of its column ``text``."""
    masked = text
    masks = [
        (fixed.YEAR_RANGE, MASK + r"\2" + MASK),
        (fixed.MONTH_PERIOD, r"\1\2" + MASK),
        (r"(?i)\b((?:q[1-4]|(?:first|second|third|fourth)\s+quarter)\s+(?:of\s+)?(?:fy|fiscal\s+year)?\s*)(?:19|20)\d{2}\b", r"\1" + MASK),
        (fixed.FISCAL_YEAR, r"\1\2" + MASK),
        (fixed.TEMPORAL_YEAR, r"\1" + MASK),
    ]
    for pattern, new in masks:
        masked = f"regexp_replace({masked}, {re2(pattern)}, {quoted(new)}, 'g')"
    group = [f"regexp_extract_all(masked, {re2(fixed.NUMBER)}, {i})" for i in range(1, 6)]
    unit = "regexp_replace(lower(coalesce(r[4], '')), '\\s+', ' ', 'g')"
    canonical = (
        f"CASE WHEN {unit} = '' THEN NULL WHEN {unit} = '%' OR starts_with({unit}, 'percent') THEN CASE WHEN contains({unit}, 'point') THEN 'percentage_point' ELSE 'percent' END "
        f"WHEN {unit} IN ('basis point', 'basis points', 'bp', 'bps') THEN 'basis_point' WHEN {unit} = 'people' THEN {unit} ELSE regexp_replace({unit}, 's+$', '') END"
    )
    times = f"coalesce({mapping(fixed.MAGNITUDES, 'n')}[lower(coalesce(r[3], ''))], 1)"
    value = f"CAST(CAST(TRY_CAST(replace(r[2], ',', '') AS DECIMAL(24, 10)) * CAST({times} AS DECIMAL(13, 0)) AS DECIMAL(38, 10)) AS VARCHAR)"
    plain = f"regexp_replace(regexp_replace({value}, '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"
    both = "replace(lower(coalesce(r[1], '') || coalesce(r[5], '')), ' ', '')"
    record = f"{{'value': {plain}, 'unit': {canonical}, 'signal': coalesce(r[1], '') <> '' OR coalesce(r[5], '') <> '' OR starts_with(lower(coalesce(r[4], '')), 'dollar'), 'currency': {mapping(fixed.CURRENCIES)}[{both}]}}"
    units = "list_filter(flatten(list_transform(records, lambda r: CASE WHEN r.signal THEN [r.value || ':currency', r.value || ':currency:' || r.currency] ELSE [r.value || ':' || r.unit] END)), lambda v: v IS NOT NULL)"
    months = {m[:3].lower(): m.lower() for m in corpus.MONTH_NAMES}
    month = f"list_transform(list_zip(regexp_extract_all(text_, {re2(fixed.MONTH_PERIOD)}, 1), regexp_extract_all(text_, {re2(fixed.MONTH_PERIOD)}, 3)), lambda r: 'month:' || r[2] || '-' || {mapping(months)}[lower(coalesce(r[1], '')[:3])])"
    q = ", ".join(f"regexp_extract_all(text_, {re2(fixed.QUARTER)}, {i})" for i in range(1, 5))
    nth = f"CASE WHEN coalesce(r[1], '') <> '' THEN coalesce(r[1], '') ELSE {mapping({'first': '1', 'second': '2', 'third': '3', 'fourth': '4'})}[lower(r[2])] END"
    quarter = f"list_transform(list_zip({q}), lambda r: CASE WHEN coalesce(r[4], '') = '' THEN 'quarter:unspecified:' || {nth} ELSE 'quarter:' || CASE WHEN coalesce(r[3], '') <> '' THEN 'fiscal' ELSE 'calendar' END || ':' || {nth} || ':' || coalesce(r[4], '') END)"
    years = f"list_transform(regexp_extract_all(text_, {re2(fixed.YEAR)}), lambda v: 'year:' || v)"
    fiscal = f"list_transform(regexp_extract_all(text_, {re2(fixed.FISCAL_YEAR)}, 3), lambda v: 'fiscal_year:' || v)"
    metric = ", ".join(f"CASE WHEN contains(lower(text_), {quoted(p)}) THEN {quoted(m)} END" for p, m in fixed.METRICS)
    bounded = quoted("(?:^|[^\\p{L}\\p{M}\\p{N}_])(" + fixed.ENTITY.removeprefix(r"(?U)\b") + ")")  # RE2 knows no word boundary but ASCII's
    entity = f"list_transform(regexp_extract_all(text_, {bounded}, 1), lambda v: regexp_replace(lower(v), '\\s+', ' ', 'g'))"
    cue = f"(list_contains({listed(fixed.METRIC_CUES)}, w) OR list_contains({listed(fixed.METRIC_CUES)}, regexp_replace(w, 's+$', '')))"
    grams = []
    for k in range(1, 6):
        ok = f"len(list_filter(g, lambda w: {cue})) > 0 AND NOT list_contains({listed(fixed.STOPWORDS)}, g[1]) AND NOT list_contains({listed(fixed.STOPWORDS)}, g[{k}])"
        if k == 1:
            ok += f" AND list_contains({listed(fixed.SINGLE_WORD_METRICS)}, g[1])"
        all_ = f"list_transform(range(1, len(ws) - {k} + 2), lambda i: ws[i:i + {k - 1}])"
        grams.append(f"list_transform(list_filter({all_}, lambda g: {ok}), lambda g: {{'w': {k}, 'n': length(array_to_string(g, ' ')), 'p': array_to_string(g, ' ')}})")
    known = listed([p for p, _ in fixed.METRICS])
    phrase = " || ".join(grams)
    return f"""SELECT * EXCLUDE (masked, ws, records, text_),
  {distinct("list_transform(records, lambda r: r.value)")} AS numbers, {distinct(units)} AS number_units,
  {distinct("list_filter(list_transform(records, lambda r: CASE WHEN r.signal THEN r.currency END), lambda v: v IS NOT NULL)")} AS currencies,
  {distinct(f"{month} || {years} || {quarter} || {fiscal}")} AS dates,
  {distinct(f"list_filter([{metric}], lambda v: v IS NOT NULL)")} AS metrics,
  list_sort(list_transform(list_sort(list_distinct(list_filter({phrase}, lambda x: NOT list_contains({known}, x.p))), 'DESC')[:24], lambda x: x.p)) AS metric_phrases,
  list_sort(list_filter(list_distinct({entity}), lambda v: length(v) > 1 AND NOT list_contains({listed(fixed.ENTITY_EXCLUSIONS)}, v))) AS entities,
  {named("text_", fixed.DIRECTIONS)} AS directions, {named("text_", fixed.SCOPES)} AS scopes, {named("text_", fixed.QUALIFIERS)} AS qualifiers, {tokens("text_")} AS keywords
FROM (SELECT *, list_filter(list_transform(list_zip({', '.join(group)}), lambda r: {record}), lambda r: r.value IS NOT NULL) AS records FROM (
  SELECT *, {text} AS text_, {masked} AS masked, regexp_extract_all(lower({text}), {quoted(fixed.TOKEN.replace("A-Z", ""))}) AS ws FROM ({source}) s0) s1) s2"""


NAMES = ["numbers", "number_units", "currencies", "dates", "metrics", "metric_phrases", "entities", "directions", "scopes", "qualifiers", "keywords"]


def packed(source: str, name: str, text: str) -> str:
    """source's columns and one struct ``name`` of the anchors of ``text``."""
    return f"SELECT * EXCLUDE ({', '.join(NAMES)}), {{{', '.join(f'{quoted(n)}: {n}' for n in NAMES)}}} AS {name} FROM ({anchors(source, text)}) p_{name}"


def matching(q: str, c: str) -> str:
    """Periods of c that match those of q: the first relation that gives any."""
    quarter_of = f"lambda t: 'quarter:calendar:' || {mapping(_QUARTER_OF)}[split_part(t, '-', 2)] || ':' || regexp_extract(t, '^month:(\\d+)-', 1)"
    kind = lambda x, k: f"list_filter({x}, lambda t: starts_with(t, '{k}:'))"
    cm, dm, dq = kind(q, "month"), kind(c, "month"), kind(c, "quarter")
    steps = [
        common(kind(q, "quarter"), c),
        f"list_filter({dm}, lambda m: list_contains({q}, list_transform([m], {quarter_of})[1]))",
        common(cm, c),
        f"list_filter({dq}, lambda x: list_contains(list_transform({cm}, {quarter_of}), x))",
        common(kind(q, "fiscal_year"), c),
        f"list_filter({dq}, lambda x: starts_with(x, 'quarter:fiscal:') AND list_contains({q}, 'fiscal_year:' || split_part(x, ':', 4)))",
        common(kind(q, "year"), c),
    ]
    return "list_sort(CASE " + " ".join(f"WHEN len({s}) > 0 THEN {s}" for s in steps) + " ELSE CAST([] AS VARCHAR[]) END)"


CHUNKS = f"SELECT source_id, 0 AS kind, block_ord, block_id || '-chunk-1' AS passage_id, text, heading, page FROM ({corpus.BLOCKS}) b0"
WINDOWS = f"""SELECT source_id, 1 AS kind, block_ord, block_id || '+' || rid || '-boundary-window' AS passage_id, text || ' ' || rt AS text, heading, rp AS page
FROM (SELECT *, lead(block_id) OVER w AS rid, lead(text) OVER w AS rt, lead(heading) OVER w AS rh, lead(page) OVER w AS rp FROM ({corpus.BLOCKS}) b1 WINDOW w AS (PARTITION BY source_id ORDER BY block_ord)) b2
WHERE rid IS NOT NULL AND heading = rh AND page IS NOT DISTINCT FROM rp AND NOT starts_with(text, 'Table: ') AND NOT starts_with(rt, 'Table: ')"""
PASSAGES = f"SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY kind, block_ord, passage_id) - 1 AS cand_idx FROM ({CHUNKS} UNION ALL {WINDOWS}) b3"

_PAIRS = {"number": "numbers", "number_unit": "number_units", "currency": "currencies", "metric": "metrics", "entity": "entities", "direction": "directions", "scope": "scopes", "qualifier": "qualifiers", "keyword": "keywords"}


def scored() -> str:
    """CTEs that end in ``scored``: every claim with every passage of its source, all parts of its score."""
    tag = lambda k, x: f"list_transform({x}, lambda v: '{k}:' || v)"
    none = "CAST([] AS VARCHAR[])"
    pairs = " || ".join(tag(k, common(f"q.{n}", f"c.{n}")) for k, n in _PAIRS.items())
    phrases = f"CASE WHEN {meet('q.metrics', 'c.metrics')} THEN {none} ELSE {tag('metric_phrase', common('q.metric_phrases', 'c.metric_phrases'))} END"
    some = lambda x, p: f"(len(list_filter({x}, lambda v: regexp_matches(v, '^({p}):'))) > 0)"
    kinds = "list_distinct(list_filter(list_transform(coverage, lambda v: split_part(v, ':', 1)), lambda k: k <> 'keyword'))"
    unit = lambda x: f"list_transform({x}.number_units, lambda v: split_part(v, ':', 2))"
    identity = f"({meet('q.metrics', 'c.metrics')} OR {meet('q.metric_phrases', 'c.metric_phrases')} OR {meet('q.entities', 'c.entities')} OR len(md) > 0)"
    extra = f"""list_filter([CASE WHEN {apart('q.directions', 'c.directions')} THEN 'direction_conflict:' || array_to_string(c.directions, ',') END,
      CASE WHEN {apart('q.numbers', 'c.numbers')} AND {identity} AND {some('cov', 'metric|metric_phrase|date')} AND {meet(unit('q'), unit('c'))} THEN 'number_conflict:present' END], lambda v: v IS NOT NULL)
      || {tag('qualifier_context', "list_filter(c.qualifiers, lambda v: NOT list_contains(q.qualifiers, v))")}"""
    has = lambda k: f"len(list_filter(q.dates, lambda v: starts_with(v, '{k}:'))) > 0"
    penalty = f"""(CASE WHEN NOT {some('cov', 'metric|metric_phrase')} AND {apart('q.metrics', 'c.metrics')} THEN 10e0 ELSE 0e0 END
      + CASE WHEN len(q.dates) > 0 AND len(c.dates) > 0 AND len(md) = 0 THEN CASE WHEN {has('quarter')} THEN 10e0 WHEN {has('month')} THEN 9e0 WHEN {has('fiscal_year')} THEN 8e0 WHEN {has('year')} THEN 6e0 ELSE 0e0 END ELSE 0e0 END
      + CASE WHEN {apart('q.currencies', 'c.currencies')} THEN 10e0 ELSE 0e0 END
      + CASE WHEN list_contains(q.scopes, 'total_company') AND list_contains(c.scopes, 'narrowed') THEN 10e0 WHEN list_contains(q.scopes, 'universal') AND list_has_any(c.scopes, ['segment', 'geography', 'narrowed']) THEN 8e0 ELSE 0e0 END)"""
    hits = " + ".join(f"CAST(regexp_matches(text, {quoted('(?i)' + p)}) AS INT)" for p in fixed.BOILERPLATE_TEXT)
    boiler = f"(CASE WHEN regexp_matches(heading, {quoted('(?i)' + fixed.BOILERPLATE_HEADING)}) THEN 36e0 ELSE 0e0 END + least(({hits}) * 10e0, 30e0))"
    boost = f"CASE WHEN regexp_matches(lower(heading), {quoted(fixed.HEADING_STRONG)}) THEN 6e0 WHEN regexp_matches(lower(heading), {quoted(fixed.HEADING_WEAK)}) THEN 2e0 ELSE 0e0 END"
    weights = mapping({k: f"{w}e0" for k, w in fixed.WEIGHTS.items()}, "n")
    base = f"""{total(f"list_transform(coverage, lambda v: {weights}[split_part(v, ':', 1)])")} + 0.35e0 * len({common('x.keywords', 'c.keywords')}) + 1.35e0 * len({common('x.entities', 'c.entities')})
      + least(0.45e0 * len(kinds) * len(kinds), 7e0) + {boost} - {penalty} - 0.35e0 * {boiler}"""
    fragment = "base_score > 0 AND length(trim(text)) <= 64 AND len(list_filter(kinds, lambda k: k NOT IN ('number', 'number_unit', 'date'))) = 0 AND list_has_any(kinds, ['number', 'number_unit']) AND len(terms) = 0 AND len(toks) <= 6"
    bonus = "CASE WHEN overlap >= 2 THEN least(2.5e0 * overlap, 6e0) WHEN overlap = 1 AND len(q_terms) = 1 THEN 1.5e0 ELSE 0e0 END"
    story = f"{meet('f.c.numbers', 'o.c.numbers')} AND ({meet('f.c.number_units', 'o.c.number_units')} OR len({matching('f.c.dates', 'o.c.dates')}) > 0)"
    pen = "6e0 + CASE WHEN o.overlap > f.overlap THEN least((o.overlap - f.overlap) * 0.75e0, 2e0) ELSE 0e0 END + CASE WHEN len(o.kinds) > len(f.kinds) THEN 0.75e0 ELSE 0e0 END"
    claims = packed(packed(f"SELECT claim_id, source_id, claim_text, local_context, {identity_terms('claim_text')} AS q_terms FROM ({corpus.CLAIMS}) k0", "q", "claim_text"), "x", "local_context")
    found = packed(f"SELECT *, trim(heading || ' ' || text) AS said, {identity_terms('text')} AS terms, {tokens('text')} AS toks FROM ({PASSAGES}) k1", "c", "said")
    return f"""claims_ AS MATERIALIZED ({claims}), passages_ AS MATERIALIZED ({found}),
joined AS MATERIALIZED (SELECT *, {matching('q.dates', 'c.dates')} AS md FROM claims_ JOIN passages_ USING (source_id)),
covered AS MATERIALIZED (SELECT *, {pairs} || {phrases} || {tag('date', 'md')} AS cov FROM joined),
central_ AS (SELECT *, {some('cov', 'number|number_unit|date|metric|metric_phrase|entity')} AS central FROM covered),
full_ AS MATERIALIZED (SELECT *, CASE WHEN central THEN {distinct(f'cov || {extra}')} ELSE {none} END AS coverage FROM central_),
kinds_ AS (SELECT *, {kinds} AS kinds, len({common('q_terms', 'terms')}) AS overlap FROM full_),
based AS MATERIALIZED (SELECT *, CASE WHEN central THEN {base} ELSE 0e0 END AS base_score FROM kinds_),
marked AS MATERIALIZED (SELECT *, {fragment} AS fragment FROM based),
worst AS (SELECT f.claim_id, f.passage_id, max({pen}) AS fragment_penalty FROM marked f JOIN marked o ON f.claim_id = o.claim_id AND f.fragment AND NOT o.fragment AND lower(trim(f.heading)) = lower(trim(o.heading)) AND f.page IS NOT DISTINCT FROM o.page AND abs(o.cand_idx - f.cand_idx) <= 16
  WHERE {story} AND length(o.text) >= length(f.text) + 20 AND (o.overlap > f.overlap OR len(o.kinds) > len(f.kinds)) GROUP BY 1, 2),
scored AS MATERIALIZED (SELECT m.*, {bonus} AS identity_bonus, coalesce(w.fragment_penalty, 0e0) AS fragment_penalty, base_score + {bonus} - coalesce(w.fragment_penalty, 0e0) AS score FROM marked m LEFT JOIN worst w USING (claim_id, passage_id)),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, coalesce(page, 0), passage_id DESC) AS rank FROM scored WHERE score > 0)"""


def scores() -> str:
    return f"WITH {scored()} SELECT claim_id, passage_id, array_to_string(coverage, '|') AS coverage, round(base_score, 6) AS base_score, identity_bonus, fragment_penalty, round(score, 6) AS score FROM scored"


def top_passages(most: int = 5) -> str:
    return f"WITH {scored()} SELECT claim_id, CAST(rank AS INT) AS rank, passage_id, round_even(score, 3) AS score FROM ranked WHERE rank <= {most}"


def diverse_passages(most: int = 5) -> str:
    """Each step of the choice is a pair of CTEs: what each candidate left would gain, and the one that is taken."""
    weights = mapping({k: f"{w}e0" for k, w in fixed.WEIGHTS.items()}, "n")
    kind = "split_part(v, ':', 1)"
    is_in = lambda k: f"list_contains(list_transform(coverage, lambda v: {kind}), '{k}')"
    metric = f"({is_in('metric')} OR {is_in('metric_phrase')})"
    steps = [
        f"own AS MATERIALIZED (SELECT claim_id, rank, passage_id, source_id, text, score, toks, list_filter(coverage, lambda v: NOT starts_with(v, 'keyword:')) AS fresh, CASE WHEN {metric} AND {is_in('number')} THEN 2e0 WHEN {metric} AND {is_in('date')} THEN 1.5e0 ELSE 0e0 END AS proof FROM ranked)",
        "t1 AS MATERIALIZED (SELECT claim_id, 1 AS position, rank, passage_id, source_id, text, score, toks, fresh FROM own WHERE rank = 1)",
    ]
    alike = "(t.rank = o.rank OR (len(o.toks) > 0 AND len(t.toks) > 0 AND len(list_intersect(o.toks, t.toks)) / len(list_distinct(o.toks || t.toks)) >= 0.82e0))"
    for i in range(2, most + 1):
        taken = " UNION ALL ".join(f"SELECT * FROM t{k}" for k in range(1, i))
        steps.append(f"taken{i} AS MATERIALIZED ({taken})")
        steps.append(f"seen{i} AS MATERIALIZED (SELECT claim_id, flatten(list(fresh)) AS seen FROM taken{i} GROUP BY 1)")
        steps.append(f"left{i} AS (SELECT o.*, list_filter(o.fresh, lambda v: NOT list_contains(s.seen, v)) AS new FROM own o JOIN seen{i} s USING (claim_id) WHERE NOT EXISTS (SELECT 1 FROM taken{i} t WHERE t.claim_id = o.claim_id AND {alike}))")
        context = " + ".join(f"CASE WHEN list_contains(list_transform(new, lambda v: {kind}), '{k}') THEN {w}e0 ELSE 0e0 END" for k, w in (("qualifier_context", 4.0), ("direction_conflict", 5.0), ("number_conflict", 5.0)))
        steps.append(f"gain{i} AS (SELECT *, score + 1.35e0 * {total(f'list_transform(new, lambda v: {weights}[{kind}])')} + ({context}) + proof AS gain, len(new) > 0 OR ({context}) > 0 OR proof > 0 AS adds FROM left{i})")
        steps.append(
            f"t{i} AS MATERIALIZED (SELECT claim_id, {i} AS position, rank, passage_id, source_id, text, score, toks, fresh FROM gain{i} QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY adds DESC, CASE WHEN adds THEN gain END DESC, CASE WHEN adds THEN passage_id END DESC, CASE WHEN adds THEN -rank ELSE rank END) = 1)"
        )
    all_ = " UNION ALL ".join(f"SELECT * FROM t{k}" for k in range(1, most + 1))
    return f"WITH {scored()}, {', '.join(steps)} SELECT claim_id, CAST(position AS INT) AS position, passage_id, source_id, text, round_even(score, 3) AS retrieval_score FROM ({all_}) z"


# -- reports -----------------------------------------------------------------------------------------------------------


def stripped(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace({x}, '\\s*\\[\\d+\\]', '', 'g'), '\\s+([.,;:!?])', '\\1', 'g'), '\\s+', ' ', 'g'))"


def chunks_documents(sentences: str, soft: int = 420, hard: int = 600) -> str:
    fits = f"length(array_to_string(list_append(now, x), ' ')) <= {soft}"
    return f"""WITH RECURSIVE s AS MATERIALIZED (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, {sentences} AS p FROM documents)),
r(doc_id, i, now, done) AS (SELECT doc_id, i, [x], CAST(NULL AS VARCHAR) FROM s WHERE i = 1 UNION ALL
  SELECT s.doc_id, s.i, CASE WHEN {fits} THEN list_append(now, x) WHEN length(now[-1] || ' ' || x) <= {hard} THEN [now[-1], x] ELSE [x] END, CASE WHEN NOT {fits} THEN array_to_string(now, ' ') END FROM r JOIN s ON s.doc_id = r.doc_id AND s.i = r.i + 1),
c AS (SELECT doc_id, i, done FROM r WHERE done IS NOT NULL UNION ALL SELECT doc_id, max(i) + 1, array_to_string(arg_max(now, i), ' ') FROM r GROUP BY 1)
SELECT CAST(doc_id AS VARCHAR) AS source_id, CAST(k - 1 AS INT) AS cand_idx, 'doc-' || doc_id || '-chunk-' || k AS passage_id, CAST(length(done) AS INT) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM c)"""


def claims_of_reports(sentences: str) -> str:
    """Each answer of a conversation cites one source, after its last sentence."""
    text = f"SELECT report_id, ord, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM ({corpus.PARAGRAPHS}) c0 WHERE style_id = 'Normal'"
    back = "regexp_matches(s[-1], '^\\s*\\[\\d+\\]') AND NOT said AND len(s) > 1"
    return f"""SELECT *, 'sentence-' || row_number() OVER (PARTITION BY report_id ORDER BY ord) AS sentence_id, CASE k WHEN '3' THEN [] WHEN '5' THEN [] WHEN '4' THEN ['reference-5'] ELSE ['reference-' || k] END AS refs,
  CASE WHEN back THEN before || ' [' || k || ']' ELSE s[-1] END AS claim_text, CASE WHEN back THEN s[:-2] ELSE s END AS upto, CASE WHEN back THEN s[-1] ELSE '' END AS following, CASE WHEN back THEN before ELSE plain END AS candidate
FROM (SELECT *, {back} AS back FROM (SELECT *, regexp_matches(plain, '[\\p{{L}}\\p{{N}}_]') AS said FROM (SELECT report_id, ord, s, regexp_extract(s[-1], '\\[(\\d+)\\]', 1) AS k, {stripped('s[-1]')} AS plain, {stripped('s[-2]')} AS before
  FROM (SELECT report_id, ord, {sentences} AS s FROM ({text}) c1) c2) c3) c4) c5"""


def claim_sentences(sentences: str) -> str:
    kept = f"list_filter(upto[greatest(1, len(upto) - 2):], lambda x: regexp_matches({stripped('x')}, '[\\p{{L}}\\p{{N}}_]'))"
    return f"SELECT report_id, sentence_id, 'backward' AS direction, claim_text, coalesce(array_to_string({kept}, '|'), '') AS scope, following, coalesce(array_to_string(refs, '|'), '') AS reference_ids FROM ({claims_of_reports(sentences)})"


def claim_selection(sentences: str) -> str:
    """Selections: one for each claim, every fifth twice, and one of an unknown sentence for each report."""
    return f"""WITH c AS ({claims_of_reports(sentences)}), one AS (SELECT report_id, sentence_id, ord, CASE WHEN ord % 7 = 0 THEN 'reference-9' ELSE coalesce(refs[1], 'reference-1') END AS reference_id, CASE WHEN ord % 3 = 0 THEN 'Approved text.' END AS approved, CASE WHEN ord % 4 = 1 THEN 'both' END AS want FROM c),
w AS (SELECT * FROM one UNION ALL SELECT * FROM one WHERE ord % 5 = 0 UNION ALL SELECT DISTINCT report_id, 'sentence-0', CAST(NULL AS BIGINT), 'reference-1', NULL, NULL FROM one),
e AS (SELECT w.*, c.candidate, c.plain, CASE WHEN w.ord IS NULL THEN 'unknown_sentence' WHEN w.ord % 5 = 0 THEN 'repeated_pair' WHEN NOT list_contains(refs, reference_id) THEN 'reference_not_linked' END AS error FROM w LEFT JOIN c USING (report_id, sentence_id))
SELECT report_id, sentence_id, reference_id, 'claim-' || sentence_id AS claim_id, coalesce(want, CASE WHEN ord IS NOT NULL THEN 'backward' END) AS direction, CASE WHEN error IS NULL THEN coalesce(approved, CASE want WHEN 'both' THEN candidate END, plain) END AS claim_text, error FROM e"""


def chunked(sectioned: str, limit: int = 250) -> str:
    """CTEs that end in ``chunk``: report_id, section_ord, k, content."""
    pieces = f"list_transform(range(0, CAST(ceil(len(ws) / {limit}.0) AS BIGINT)), lambda i: array_to_string(ws[i * {limit} + 1:(i + 1) * {limit}], ' '))"
    held = "CASE WHEN len(now) > 0 THEN [array_to_string(now, chr(10) || chr(10))] ELSE CAST([] AS VARCHAR[]) END"
    return f"""para AS MATERIALIZED (SELECT report_id, section_ord, text, string_split(text, ' ') AS ws, row_number() OVER (PARTITION BY report_id, section_ord ORDER BY ord, text) AS i FROM ({sectioned}) WHERE NOT is_heading AND text <> ''),
fold(report_id, section_ord, i, now, n, done) AS (SELECT DISTINCT report_id, section_ord, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST(0 AS BIGINT), CAST([] AS VARCHAR[]) FROM para UNION ALL
  SELECT p.report_id, p.section_ord, p.i, CASE WHEN len(ws) > {limit} THEN [] WHEN len(now) > 0 AND n + len(ws) > {limit} THEN [text] ELSE list_append(now, text) END,
  CASE WHEN len(ws) > {limit} THEN 0 WHEN len(now) > 0 AND n + len(ws) > {limit} THEN len(ws) ELSE n + len(ws) END,
  CASE WHEN len(ws) > {limit} THEN {held} || {pieces} WHEN len(now) > 0 AND n + len(ws) > {limit} THEN {held} ELSE [] END FROM fold f JOIN para p ON p.report_id = f.report_id AND p.section_ord = f.section_ord AND p.i = f.i + 1),
flat AS (SELECT report_id, section_ord, i, unnest(done) AS content, generate_subscripts(done, 1) AS j FROM fold UNION ALL SELECT report_id, section_ord, max(i) + 1, array_to_string(arg_max(now, i), chr(10) || chr(10)), 1 FROM fold GROUP BY 1, 2 HAVING len(arg_max(now, i)) > 0),
chunk AS MATERIALIZED (SELECT report_id, section_ord, content, row_number() OVER (PARTITION BY report_id, section_ord ORDER BY i, j) AS k FROM flat)"""


def subchunks(sectioned: str) -> str:
    words = "len(string_split(trim(regexp_replace(content, '\\s+', ' ', 'g')), ' '))"
    return f"WITH RECURSIVE {chunked(sectioned)} SELECT report_id, 'section-' || section_ord AS section_id, 'section-' || section_ord || '-subchunk-' || k AS subchunk_id, CAST(k AS INT) AS ord, content, CAST({words} AS INT) AS word_count FROM chunk"


def report_risks(section_risks: str, gate: str, most: int = 12) -> str:
    said = ", ".join(f"CASE WHEN {c} > 0 THEN {c} || '{t}' END" for c, t in (("contradicted", " checked claims remain contradicted."), ("unsupported", " checked claims remain unsupported."), ("unverified", " checked claims remain unverified."), ("human", " sections need a human.")))
    return f"""WITH own AS (SELECT review_id, section_id, string_split(risks, '|') AS r FROM ({section_risks}) WHERE risks <> ''),
each AS (SELECT review_id, section_id, unnest(r) AS risk, generate_subscripts(r, 1) AS j FROM own),
per AS (SELECT review_id, list(section_id || ': ' || risk ORDER BY section_id, j) AS own FROM each GROUP BY 1), h AS (SELECT review_id, count(*) FILTER (len(r) > 1) AS human FROM own GROUP BY 1)
SELECT review_id, coalesce(array_to_string((list_filter([{said}], lambda x: x IS NOT NULL) || coalesce(own, CAST([] AS VARCHAR[])))[:{most}], '|'), '') AS risks FROM ({gate}) LEFT JOIN per USING (review_id) LEFT JOIN h USING (review_id)"""
