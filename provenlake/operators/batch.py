"""The main query: claims against the sources they cite, from blocks of sources to reviewed items.

sources: source_id, source_kind, fetch_status, failure_reason. claims: claim_id, source_id, claim_text, local_context, and
any other columns, which come along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenlake.operators import passages, retrieval, review, selection
from provenlake.plans.store import settled
from provenlake.sources import html, pdf_lines

READ = "source_id string, block_ord int, block_id string, text string, heading string, page int, span string"


def text_pages(pages: DataFrame) -> DataFrame:
    """Blocks of PDF pages with text layers: each page's prose, then its table rows."""
    prose = pdf_lines.prose(pages).select("source_id", F.col("page").cast("int").alias("page"), F.lit(0).alias("part"), F.lit(0).alias("k"), F.concat_ws("-page-", "source_id", "page").alias("block_id"), "text", F.lit(None).cast("string").alias("heading"), F.format_string("page-%d", F.col("page").cast("int")).alias("span"))
    rows = pdf_lines.table_rows(pages).select("source_id", "page", F.lit(1).alias("part"), F.col("block_ord").alias("k"), "block_id", "text", "heading", "span")
    both = prose.unionByName(rows)
    # the place of a block: by page, prose first
    order = Window.partitionBy("source_id").orderBy("page", "part", "k", "block_id")
    return both.select("source_id", F.row_number().over(order).alias("block_ord"), "block_id", "text", "heading", "page", "span")


#: Readers by source kind: sources of that kind (source_id and a payload) to blocks. Others may be added.
READERS: dict[str, Callable[[DataFrame], DataFrame]] = {"html": lambda rows: html.html_blocks(rows.select("source_id", F.col("payload").alias("html"))), "text_pdf": text_pages}


def read_sources(sources: DataFrame, payloads: dict[str, DataFrame], readers: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(blocks of all sources that were fetched, sources of kinds that have no reader): each kind's payload rows (source_id
    and what its reader asks for) go to its reader. A failed source is not read, whatever payload it has."""
    readers = READERS if readers is None else readers
    own = sources.where("fetch_status <=> 'fetched'")
    parts = [readers[kind](rows.join(own.where(F.col("source_kind") == kind).select("source_id"), "source_id", "left_semi")) for kind, rows in payloads.items() if kind in readers]
    blocks = sources.sparkSession.createDataFrame([], READ)
    for part in parts:
        blocks = blocks.unionByName(part.select(*blocks.columns))
    return blocks, sources.where(~F.coalesce(F.col("source_kind").isin(*readers), F.lit(False)))


def source_groups(items: DataFrame) -> DataFrame:
    """Per review the sources in the order in which items first name them, with their sentences: each is read once."""
    own = items.groupBy("review_id", "reference_id").agg(F.min("ord").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "sentence_id"))), lambda x: x["sentence_id"]).alias("sentence_ids"))
    return own.withColumn("group_ord", F.row_number().over(Window.partitionBy("review_id").orderBy("first", "reference_id"))).drop("first")


def source_status(sources: DataFrame, blocks: DataFrame) -> DataFrame:
    """sources with extraction_status; null for those that were not fetched: a failed fetch wins over blocks."""
    read = html.extraction_status(sources, blocks)
    return read.withColumn("extraction_status", F.when(F.col("fetch_status") == "fetched", F.col("extraction_status")))


def evidence(claims: DataFrame, blocks: DataFrame, k: int = selection.MOST) -> DataFrame:
    """Up to k passages of each claim's source (claim_id, position, passage_id, source_id, text, retrieval_score)."""
    own = settled(passages.passages(blocks))
    chosen = retrieval.texts(selection.diverse(retrieval.found(claims, own), k), own)
    return chosen.select("claim_id", "position", "passage_id", "source_id", "text", "retrieval_score")


def review_claims(claims: DataFrame, sources: DataFrame, blocks: DataFrame, judge: Callable | None = None, k: int = selection.MOST) -> DataFrame:
    """Items: each claim with the state of its source, its packet of passages, and what became of it. Claims whose source is
    not among the sources count as not fetched; of several rows of a source one that was fetched counts, so that claims stay single.
    A source of a kind that no reader knows has no blocks, and counts as not extracted. One claim or many: the same plan."""
    best = Window.partitionBy("source_id").orderBy((F.col("fetch_status") == "fetched").desc_nulls_last(), "source_kind", "failure_reason")
    single = sources.withColumn("_nth", F.row_number().over(best)).where("_nth = 1").drop("_nth")
    known = source_status(single, blocks).select("source_id", "fetch_status", "failure_reason", "extraction_status")
    own = claims.join(known, "source_id", "left").withColumn("fetch_status", F.coalesce("fetch_status", F.lit("failed")))
    readable = blocks.join(known.where("extraction_status = 'extracted'").select("source_id"), "source_id", "left_semi")
    packed = review.payloads(own, evidence(claims, readable, k), k)
    return review.reviewed(settled(packed), judge)  # both of its branches read it


def retry_problem(items: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (review_id, reference_id) with why a retry is refused: a review that is not there, a source that it does not
    cite, or one without open items that need it; null where it may go on."""
    needs = needs_attention()
    per = items.groupBy("review_id", "reference_id").agg(F.count_if((F.col("status") != "completed") & needs).alias("open"))
    reviews = items.select("review_id").distinct().withColumn("known", F.lit(True))
    j = asked.join(reviews, "review_id", "left").join(per, ["review_id", "reference_id"], "left")
    return j.select("review_id", "reference_id", F.when(F.col("known").isNull(), "unknown_review").when(F.col("open").isNull(), "unknown_source").when(F.col("open") == 0, "nothing_to_retry").alias("problem"))


def needs_attention() -> Column:
    """Whether an item's source keeps it from review."""
    return F.coalesce((F.col("fetch_status") == "failed") | F.col("extraction_status").isin("ocr_required", "extraction_failed"), F.lit(False))
