"""Claims meet passages through an inverted list of what can make a pair score: central anchors and identity terms.

A pair scores above 0 only if it shares a central anchor (number, period, metric, metric phrase, entity) or enough identity terms
(two, or the only one that the claim has). So both sides send keys, and meet by an equal join of source and key:

* a central anchor is a key of its own. Periods that match without being equal (a month within a quarter, a fiscal quarter within
  its year) have the wider period as a key, too;
* of a claim's identity terms all but the most frequent one in its source are keys, rarest first: two shared terms cannot both be
  the one left out.

What meets is scored as any pair is; the lists only spare pairs that would have scored 0. Pairs are ids until then, and what is
written of a scored pair holds no text: a claim's passages get theirs when they are chosen. A bare fragment is still compared
with all passages beside it, whether these are candidates or not: these few meet by source, heading and band.

Nulls: claims and passages without source_id, and claims without claim_id, meet nothing. A passage_id is unique in its source. Repeated claims or
passages are pairs each by their own rows' ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenlake.functions.periods import calendar_quarter
from provenlake.operators import scoring
from provenlake.plans.store import settled


def _own(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(kind + ":"), v))


def _wider(dates: Column, fiscal: bool) -> Column:
    """Calendar quarters of months, and (of a passage) the fiscal years of fiscal quarters."""
    quarters = F.transform(F.filter(dates, lambda t: t.startswith("month:")), calendar_quarter)
    if not fiscal:
        return quarters
    return F.concat(quarters, F.transform(F.filter(dates, lambda t: t.startswith("quarter:fiscal:")), lambda t: F.concat(F.lit("fiscal_year:"), F.split_part(t, F.lit(":"), F.lit(4)))))


def central_keys(a: Column, passage: bool) -> Column:
    """Keys of anchors such that a pair with a central match shares one. (Equal numbers with units are equal numbers.)"""
    dates = F.concat(a["dates"], _wider(a["dates"], passage))
    return F.array_distinct(F.array_compact(F.concat(_own("number", a["numbers"]), _own("date", dates), _own("metric", a["metrics"]), _own("phrase", a["metric_phrases"]), _own("entity", a["entities"]))))


def postings(passages: DataFrame) -> DataFrame:
    """source_id, key, cand_idx: one row for each key of a passage (of passages_read)."""
    return passages.where("source_id IS NOT NULL").select("source_id", "cand_idx", F.explode(F.concat(central_keys(F.col("c"), True), _own("term", F.col("terms")))).alias("key"))


def asked(claims: DataFrame, lists: DataFrame) -> DataFrame:
    """claim_id, source_id, key: what each claim (of claims_read) looks up. Of several identity terms the one that most passages
    of the source have is left out (of equally frequent ones the greater)."""
    own = claims.where("claim_id IS NOT NULL AND source_id IS NOT NULL")
    central = own.select("claim_id", "source_id", F.explode(central_keys(F.col("q"), False)).alias("key"))
    terms = own.select("claim_id", "source_id", F.size("q_terms").alias("n"), F.explode(_own("term", F.col("q_terms"))).alias("key"))
    # a claim's source is asked for once: rows of frequencies are those of terms that some claim names
    often = lists.where(F.col("key").startswith("term:")).groupBy("source_id", "key").agg(F.count(F.lit(1)).alias("often"))
    rarest = Window.partitionBy("claim_id", "source_id").orderBy(F.coalesce("often", F.lit(0)), "key")
    terms = terms.join(often, ["source_id", "key"], "left").withColumn("r", F.row_number().over(rarest)).where("n = 1 OR r < n")
    return central.unionByName(terms.select("claim_id", "source_id", "key"))


def met(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """claim_id, source_id, cand_idx: pairs that share a key, each once."""
    lists = postings(passages)
    pairs = asked(claims, lists).join(lists, ["source_id", "key"]).select("claim_id", "source_id", "cand_idx")
    # a number of partitions of our own: pairs are few bytes, but each costs a whole score
    n = int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(n, "source_id", "cand_idx").distinct()


def _penalties(own: DataFrame, read: DataFrame, band: int) -> DataFrame:
    """claim_id, passage_id, fragment_penalty of fragments beside which something richer stands. own: marked candidates."""
    at = F.floor(F.col("cand_idx") / F.lit(max(band, 1)))
    f = own.where("fragment").select("claim_id", "passage_id", "source_id", "place", "page", "cand_idx", F.explode(F.array(at - 1, at, at + 1)).alias("band"), "text", "q_terms", "overlap", "kinds", F.col("c.numbers").alias("n"), F.col("c.number_units").alias("u"), F.col("c.dates").alias("d"))
    o = read.select("source_id", at.alias("band"), scoring.placed(F.col("heading")).alias("place"), F.col("page").alias("o_page"), F.col("cand_idx").alias("o_idx"), F.length("text").alias("o_len"), F.col("terms").alias("o_terms"), F.col("c.numbers").alias("on"), F.col("c.number_units").alias("ou"), F.col("c.dates").alias("od"))
    beside = F.col("page").eqNullSafe(F.col("o_page")) & (F.abs(F.col("o_idx") - F.col("cand_idx")) <= band) & (F.col("o_len") >= F.length("text") + 20)
    near = f.join(o, ["source_id", "place", "band"]).where(beside & scoring.same_story()).withColumn("o_overlap", F.size(F.array_intersect("q_terms", "o_terms")))
    known = own.select("claim_id", F.col("source_id"), F.col("cand_idx").alias("o_idx"), F.col("kinds").alias("o_kinds"), F.col("fragment").alias("o_fragment"))
    near = near.join(known, ["claim_id", "source_id", "o_idx"], "left").where(~F.coalesce("o_fragment", F.lit(False))).withColumn("o_kinds", F.coalesce("o_kinds", F.lit(0)))
    return near.where(scoring.richer()).groupBy("claim_id", "passage_id").agg(F.max(scoring.fragment_penalty()).alias("fragment_penalty"))


def found(claims: DataFrame, passages: DataFrame, band: int = 16) -> DataFrame:
    """Pairs of claims and passages of their source that score above 0: claim_id, source_id, cand_idx, passage_id, page, coverage,
    tokens (hashed: only compared with each other), base_score, identity_bonus, fragment_penalty, score. The texts stay behind."""
    q, read = settled(scoring.claims_read(claims)), settled(scoring.passages_read(passages))
    pairs = met(q, read).join(read, ["source_id", "cand_idx"]).join(q, ["claim_id", "source_id"])
    own = scoring.marked(scoring.based(pairs)).withColumn("identity_bonus", scoring.identity_bonus(F.col("overlap"), F.col("q_terms")))
    own = own.where((F.col("base_score") + F.col("identity_bonus") > 0) | (F.col("kinds") > 0))
    text = F.when(F.col("fragment"), F.col("text"))  # short ones, by definition
    own = settled(own.select("claim_id", "source_id", "cand_idx", "passage_id", "page", "place", text.alias("text"), "coverage", F.transform("tokens", lambda t: F.xxhash64(t)).alias("tokens"), "base_score", "identity_bonus", "q_terms", "overlap", "kinds", "fragment", F.when(F.col("fragment"), F.struct("c.numbers", "c.number_units", "c.dates")).alias("c")))
    worst = _penalties(own, read, band)
    out = own.join(worst, ["claim_id", "passage_id"], "left").withColumn("fragment_penalty", F.coalesce("fragment_penalty", F.lit(0.0)))
    out = out.withColumn("score", F.col("base_score") + F.col("identity_bonus") - F.col("fragment_penalty")).where("score > 0")
    return out.select("claim_id", "source_id", "cand_idx", "passage_id", "page", "coverage", "tokens", "base_score", "identity_bonus", "fragment_penalty", "score")


def texts(chosen: DataFrame, passages: DataFrame) -> DataFrame:
    """chosen (source_id, passage_id and others) with the passages' texts."""
    return chosen.join(passages.select("source_id", "passage_id", "text"), ["source_id", "passage_id"])
