"""Scores of passages as evidence for claims: coverage, conflicts, bonuses, penalties, and the specificity adjustments.

Anchors of passages and claims are computed once each, before they are joined on the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenlake.functions import fixed
from provenlake.functions.anchors import anchors, entities
from provenlake.functions.periods import matching_dates
from provenlake.functions.text import collapse, identity_terms, tokens

_PAIRS = [("number", "numbers"), ("number_unit", "number_units"), ("currency", "currencies"), ("metric", "metrics"), ("entity", "entities"), ("direction", "directions"), ("scope", "scopes"), ("qualifier", "qualifiers"), ("keyword", "keywords")]


def _tagged(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(kind + ":"), v))


def _meet(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) > 0


def _apart(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.size(b) > 0) & ~_meet(a, b)


def _kinds(coverage: Column) -> Column:
    """Distinct anchor kinds of a coverage but keywords."""
    return F.array_distinct(F.filter(F.transform(coverage, lambda a: F.split_part(a, F.lit(":"), F.lit(1))), lambda k: k != "keyword"))


def weight(anchor: Column) -> Column:
    kind = F.split_part(anchor, F.lit(":"), F.lit(1))
    out = F.lit(0.0)
    for k, w in fixed.WEIGHTS.items():
        out = F.when(kind == k, F.lit(w)).otherwise(out)
    return out


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def coverage(q: Column, c: Column) -> Column:
    own = [_tagged(kind, F.array_intersect(q[name], c[name])) for kind, name in _PAIRS]
    phrases = F.when(_meet(q["metrics"], c["metrics"]), F.array().cast("array<string>")).otherwise(_tagged("metric_phrase", F.array_intersect(q["metric_phrases"], c["metric_phrases"])))
    return F.concat(*own, phrases, _tagged("date", matching_dates(q["dates"], c["dates"])))


def is_central(cov: Column) -> Column:
    return F.exists(cov, lambda a: a.rlike("^(number|number_unit|date|metric|metric_phrase|entity):"))


def unit_kinds(units: Column) -> Column:
    return F.array_distinct(F.transform(units, lambda u: F.split_part(u, F.lit(":"), F.lit(2))))


def conflicts(q: Column, c: Column, cov: Column) -> Column:
    """Conflict and context tags that a central match adds."""
    direction = F.when(_apart(q["directions"], c["directions"]), F.concat(F.lit("direction_conflict:"), F.array_join(c["directions"], ",")))
    identity = _meet(q["metrics"], c["metrics"]) | _meet(q["metric_phrases"], c["metric_phrases"]) | _meet(q["entities"], c["entities"]) | (F.size(matching_dates(q["dates"], c["dates"])) > 0)
    number = F.when(_apart(q["numbers"], c["numbers"]) & identity & F.exists(cov, lambda a: a.rlike("^(metric|metric_phrase|date):")) & _meet(unit_kinds(q["number_units"]), unit_kinds(c["number_units"])), F.lit("number_conflict:present"))
    return F.concat(F.array_compact(F.array(direction, number)), _tagged("qualifier_context", F.array_except(c["qualifiers"], q["qualifiers"])))


def heading_boost(heading: Column) -> Column:
    h = F.lower(collapse(F.coalesce(heading, F.lit(""))))
    return F.when(h.rlike(fixed.HEADING_STRONG), 6.0).when(h.rlike(fixed.HEADING_WEAK), 2.0).otherwise(0.0)


def boilerplate(heading: Column, text: Column) -> Column:
    hits = sum((text.rlike("(?i)" + p).cast("int") for p in fixed.BOILERPLATE_TEXT), F.lit(0))
    return F.when(F.coalesce(heading, F.lit("")).rlike("(?i)" + fixed.BOILERPLATE_HEADING), 36.0).otherwise(0.0) + F.least(hits * F.lit(10.0), F.lit(30.0))


def penalties(q: Column, c: Column, cov: Column) -> Column:
    metric = F.when(~F.exists(cov, lambda a: a.rlike("^(metric|metric_phrase):")) & _apart(q["metrics"], c["metrics"]), 10.0).otherwise(0.0)
    has = lambda k: F.exists(q["dates"], lambda t: t.startswith(k + ":"))
    period = F.when((F.size(q["dates"]) > 0) & (F.size(c["dates"]) > 0) & (F.size(matching_dates(q["dates"], c["dates"])) == 0), F.when(has("quarter"), 10.0).when(has("month"), 9.0).when(has("fiscal_year"), 8.0).when(has("year"), 6.0).otherwise(0.0)).otherwise(0.0)
    currency = F.when(_apart(q["currencies"], c["currencies"]), 10.0).otherwise(0.0)
    scope = F.when(F.array_contains(q["scopes"], "total_company") & F.array_contains(c["scopes"], "narrowed"), 10.0).when(F.array_contains(q["scopes"], "universal") & F.arrays_overlap(c["scopes"], F.array(F.lit("segment"), F.lit("geography"), F.lit("narrowed"))), 8.0).otherwise(0.0)
    return metric + period + currency + scope


def claims_read(claims: DataFrame) -> DataFrame:
    """claims (claim_id, source_id, claim_text, local_context) with their anchors q, the keywords and entities x of their
    context, and identity terms q_terms."""
    near = F.coalesce("local_context", F.lit(""))
    return claims.select("claim_id", "source_id", anchors(F.col("claim_text")).alias("q"), F.struct(tokens(near).alias("keywords"), entities(near).alias("entities")).alias("x"), identity_terms(F.col("claim_text")).alias("q_terms"))


def passages_read(passages: DataFrame) -> DataFrame:
    """passages with their anchors c (heading and text), identity terms and tokens."""
    said = F.trim(F.concat_ws(" ", F.coalesce("heading", F.lit("")), "text"))
    return passages.withColumn("c", anchors(said)).withColumn("terms", identity_terms(F.col("text"))).withColumn("tokens", tokens(F.col("text")))


def based(pairs: DataFrame) -> DataFrame:
    """Pairs of claims_read and passages_read with central, coverage and base_score."""
    j = pairs.withColumn("cov", coverage(F.col("q"), F.col("c"))).withColumn("central", is_central(F.col("cov")))
    j = j.withColumn("coverage", F.array_sort(F.array_distinct(F.when(F.col("central"), F.concat("cov", conflicts(F.col("q"), F.col("c"), F.col("cov")))).otherwise(F.array().cast("array<string>")))))
    base = (
        total(F.transform("coverage", weight))
        + F.lit(0.35) * F.size(F.array_intersect("x.keywords", "c.keywords"))
        + F.lit(1.35) * F.size(F.array_intersect("x.entities", "c.entities"))
        + F.least(F.lit(0.45) * F.size(_kinds(F.col("coverage"))) * F.size(_kinds(F.col("coverage"))), F.lit(7.0))
        + heading_boost(F.col("heading"))
        - penalties(F.col("q"), F.col("c"), F.col("cov"))
        - F.lit(0.35) * boilerplate(F.col("heading"), F.col("text"))
    )
    return j.withColumn("base_score", F.when(F.col("central"), base).otherwise(0.0))


def scored(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """claims with every passage of their source: coverage, base score. Of the anchors only those stay with a pair that adjusted
    compares: pairs are many, and are written. (retrieval.found makes only the pairs that can score.)"""
    j = based(claims_read(claims).join(passages_read(passages), "source_id"))
    return j.drop("cov", "x", "q").withColumn("c", F.struct("c.numbers", "c.number_units", "c.dates"))


def marked(candidates: DataFrame) -> DataFrame:
    """candidates with overlap (shared identity terms), kinds (of coverage, a number), fragment and place (the heading)."""
    material = _kinds(F.col("coverage"))
    only_numbers = F.size(F.array_except(material, F.array(F.lit("number"), F.lit("number_unit"), F.lit("date")))) == 0
    fragment = (F.col("base_score") > 0) & (F.length(F.trim("text")) <= 64) & only_numbers & (F.array_contains(material, "number") | F.array_contains(material, "number_unit")) & (F.size("terms") == 0) & (F.size("tokens") <= 6)
    return candidates.withColumn("overlap", F.size(F.array_intersect("q_terms", "terms"))).withColumn("kinds", F.size(material)).withColumn("fragment", fragment).withColumn("place", placed(F.col("heading")))


def placed(heading: Column) -> Column:
    return F.lower(F.trim(F.coalesce(heading, F.lit(""))))


def identity_bonus(overlap: Column, terms: Column) -> Column:
    """What shared identity terms add: two or more, or the only one that a claim has."""
    return F.when(overlap >= 2, F.least(F.lit(2.5) * overlap, F.lit(6.0))).when((overlap == 1) & (F.size(terms) == 1), 1.5).otherwise(0.0)


def fragment_penalty() -> Column:
    """Of a fragment (overlap, kinds) beside a richer passage (o_overlap, o_kinds)."""
    return F.lit(6.0) + F.when(F.col("o_overlap") > F.col("overlap"), F.least((F.col("o_overlap") - F.col("overlap")) * F.lit(0.75), F.lit(2.0))).otherwise(0.0) + F.when(F.col("o_kinds") > F.col("kinds"), 0.75).otherwise(0.0)


def same_story() -> Column:
    """Whether a fragment (n, u, d) and a passage beside it (on, ou, od) tell of one number, with its unit or its period."""
    return _meet(F.col("n"), F.col("on")) & (_meet(F.col("u"), F.col("ou")) | (F.size(matching_dates(F.col("d"), F.col("od"))) > 0))


def richer() -> Column:
    return (F.col("o_len") >= F.length("text") + 20) & ((F.col("o_overlap") > F.col("overlap")) | (F.col("o_kinds") > F.col("kinds")))


def adjusted(candidates: DataFrame, band: int = 16) -> DataFrame:
    """Adds score: base score and identity bonus, less the penalty of bare fragments beside which a richer passage of the same
    story stands (same source, page and heading, at most ``band`` places away). Fragments meet the passages of their own and
    the two neighbouring bands only, by an equal join: a claim's passages are never paired with all of its fragments."""
    own = marked(candidates)
    bonus = identity_bonus(F.col("overlap"), F.col("q_terms"))
    at = F.floor(F.col("cand_idx") / F.lit(max(band, 1)))
    f = own.where("fragment").select("claim_id", "passage_id", "place", "page", "cand_idx", F.explode(F.array(at - 1, at, at + 1)).alias("band"), "text", "overlap", "kinds", F.col("c.numbers").alias("n"), F.col("c.number_units").alias("u"), F.col("c.dates").alias("d"))
    o = own.where("NOT fragment").select("claim_id", at.alias("band"), "place", F.col("page").alias("o_page"), F.col("cand_idx").alias("o_idx"), F.length("text").alias("o_len"), F.col("overlap").alias("o_overlap"), F.col("kinds").alias("o_kinds"), F.col("c.numbers").alias("on"), F.col("c.number_units").alias("ou"), F.col("c.dates").alias("od"))
    beside = F.col("page").eqNullSafe(F.col("o_page")) & (F.abs(F.col("o_idx") - F.col("cand_idx")) <= band)
    worst = f.join(o, ["claim_id", "place", "band"]).where(beside & same_story() & richer()).groupBy("claim_id", "passage_id").agg(F.max(fragment_penalty()).alias("fragment_penalty"))
    return own.join(worst, ["claim_id", "passage_id"], "left").withColumn("identity_bonus", bonus).withColumn("fragment_penalty", F.coalesce("fragment_penalty", F.lit(0.0))).withColumn("score", F.col("base_score") + F.col("identity_bonus") - F.col("fragment_penalty"))
