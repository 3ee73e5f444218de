"""Review items as an append-only log of what happened to them, folded to the latest state of each pair.

Events: review_id, sentence_id, reference_id, seq (their order), status, verdict. The rule is that of a retry: what is completed stays
(of several completions the first), what is open is replaced by what came later. It asks neither for the order in which events
arrive nor for each to come once, so the fold is one aggregate, the same over a table and over a stream: late and repeated events
change nothing that they should not, and a pair's state is two rows, however many events it has. Events of one seq: the one
that sorts last by status and verdict counts as the later.

Nulls: events without seq come before all others; null keys are keys. An empty log has no items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["review_id", "sentence_id", "reference_id"]


def latest(events: DataFrame) -> DataFrame:
    """The state of each pair: status, verdict, seq of the event that made it, and the first and last seq it has seen. For streams, in
    update or complete mode."""
    done = F.col("status") == "completed"
    seq = F.coalesce("seq", F.lit(-(1 << 63)))
    event = F.struct(seq.alias("order"), "status", "verdict", "seq")
    first_done, last = F.min(F.when(done, event)).alias("done"), F.max(event).alias("last")
    per = events.groupBy(*KEYS).agg(first_done, last, F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    now = F.coalesce("done", "last")
    return per.select(*KEYS, now["status"].alias("status"), now["verdict"].alias("verdict"), now["seq"].alias("seq"), "first_seq", "last_seq")


def open_items(events: DataFrame) -> DataFrame:
    """What a retry may take up: pairs that are not completed."""
    return latest(events).where("status != 'completed' OR status IS NULL")


def write_states(events: DataFrame, out: str, checkpoint: str):
    """Start a query that keeps the states of an arriving log in a Parquet table, a version for each batch."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/version={number}")

    return latest(events).writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).start()
