"""Passages of source blocks: table rows whole, prose in sentence-safe chunks, and windows across neighbouring blocks.

blocks: source_id, block_ord, block_id, text, heading, page, span. Passages: source_id, cand_idx, passage_id, text, heading, page, span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenlake.functions.text import sentences



def is_table_row(span: Column, text: Column) -> Column:
    t = F.ltrim(text)
    return F.coalesce(span, F.lit("")).rlike(r"(?:^|-)table-\d+-row-\d+(?:$|-)") | (t.startswith("Table: ") & t.contains(" Row: ")) | t.startswith("Row: ")


def chunks_of(parts: Column, soft: int, hard: int) -> Column:
    """Sentences gathered up to ``soft`` characters; the last one of a chunk also begins the next where both fit ``hard``."""
    join = lambda a: F.array_join(a, " ")
    empty = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("now"))

    def step(s: Column, x: Column) -> Column:
        more = F.concat(s["now"], F.array(x))
        last = F.element_at(s["now"], -1)
        overlap = F.concat_ws(" ", last, x)
        start = F.when(F.length(overlap) <= hard, F.array(last, x)).otherwise(F.array(x))
        return F.when(F.size(s["now"]) == 0, F.struct(s["done"].alias("done"), F.array(x).alias("now"))).when(F.length(join(more)) <= soft, F.struct(s["done"].alias("done"), more.alias("now"))).otherwise(F.struct(F.concat(s["done"], F.array(s["now"])).alias("done"), start.alias("now")))

    return F.aggregate(parts, empty, step, lambda s: F.transform(F.when(F.size(s["now"]) > 0, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]), join))


def window_of(left: Column, right: Column, left_parts: Column, right_parts: Column, limit: int) -> Column:
    """Both texts if they fit; else sentences from the seam outwards, left and right in turn, while they fit; or null."""
    whole = F.trim(F.concat_ws(" ", left, right))
    text = lambda a, b: F.concat_ws(" ", F.array_join(F.slice(left_parts, F.size(left_parts) - a + 1, a), " "), F.array_join(F.slice(right_parts, 1, b), " "))
    one = F.lit(1)
    start = F.struct(one.alias("a"), one.alias("b"), F.lit(True).alias("on"))

    def step(s: Column, _: Column) -> Column:
        more_a = (s["a"] < F.size(left_parts)) & (F.length(text(s["a"] + 1, s["b"])) <= limit)
        a = F.when(more_a, s["a"] + 1).otherwise(s["a"])
        more_b = (s["b"] < F.size(right_parts)) & (F.length(text(a, s["b"] + 1)) <= limit)
        b = F.when(more_b, s["b"] + 1).otherwise(s["b"])
        return F.when(s["on"], F.struct(a.alias("a"), b.alias("b"), (more_a | more_b).alias("on"))).otherwise(s)

    rounds = F.sequence(one, F.greatest(one, F.least(F.size(left_parts) + F.size(right_parts), F.lit(limit))))
    grown = F.aggregate(rounds, start, step, lambda s: text(s["a"], s["b"]))
    seam = (F.size(left_parts) > 0) & (F.size(right_parts) > 0)
    return F.when(F.length(whole) <= limit, whole).when(seam, F.when(F.length(text(one, one)) <= limit, grown))


def passages(blocks: DataFrame, max_chars: int = 420, overflow: int = 180) -> DataFrame:
    own = blocks.withColumn("table_row", is_table_row(F.col("span"), F.col("text"))).withColumn("parts", sentences(F.col("text")))
    label = F.coalesce("span", "block_id")
    rows = F.when(F.col("table_row"), F.array(F.trim("text"))).otherwise(chunks_of(F.col("parts"), max_chars, max_chars + overflow))
    chunks = own.select("source_id", "block_ord", "block_id", "heading", "page", label.alias("label"), F.posexplode(rows).alias("k", "text"))
    chunks = chunks.select("source_id", F.lit(0).alias("kind"), "block_ord", "k", F.concat("block_id", F.lit("-chunk-"), F.col("k") + 1).alias("passage_id"), "text", "heading", "page", F.concat("label", F.lit("-chunk-"), F.col("k") + 1).alias("span"))
    nxt = own.withColumn("r", F.lead(F.struct("block_id", "text", "heading", "page", label.alias("label"), "table_row", "parts")).over(Window.partitionBy("source_id").orderBy("block_ord", "block_id"))).where("r IS NOT NULL")
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    shared = ~F.col("table_row") & ~F.col("r.table_row") & F.col("page").eqNullSafe(F.col("r.page")) & ((low(F.col("heading")) == "") | (low(F.col("r.heading")) == "") | (low(F.col("heading")) == low(F.col("r.heading"))))
    windows = nxt.where(shared).withColumn("w", window_of(F.col("text"), F.col("r.text"), F.col("parts"), F.col("r.parts"), max_chars + overflow)).where("w IS NOT NULL AND w != ''")
    windows = windows.select("source_id", F.lit(1).alias("kind"), "block_ord", F.lit(0).alias("k"), F.concat("block_id", F.lit("+"), "r.block_id", F.lit("-boundary-window")).alias("passage_id"), F.col("w").alias("text"), F.coalesce(F.when(F.trim("r.heading") != "", F.col("r.heading")), F.col("heading")).alias("heading"), F.col("r.page").alias("page"), F.concat(label, F.lit("+"), "r.label", F.lit("-boundary-window")).alias("span"))
    order = Window.partitionBy("source_id").orderBy("kind", "block_ord", "k", "passage_id")
    return chunks.unionByName(windows).withColumn("cand_idx", F.row_number().over(order) - 1).drop("kind", "block_ord", "k")
