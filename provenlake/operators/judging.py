"""Calls of a judge with bounded concurrency, and custom metrics over what it says.

Calls wait on a network, not on a processor: each task holds a pool of threads, gives out no more calls than the pool takes, and
no more of one source than ``per_source``; answers are yielded as they come. A call that fails is a row with its error, after
``attempts`` tries. A source's items are spread over all tasks (its limit holds in each task), so that one much-cited source does
not wait in one.

Nulls: a null source_id is a source of its own. An empty table calls nothing. Repeated items are called each.
"""

from __future__ import annotations

import time
from collections import Counter, deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

SAID = "claim_id string, source_id string, verdict string, reason string, error string, attempts int"


def calls(rows: Iterable[dict], call: Callable[[dict], tuple[str, str]], at_once: int = 8, per_source: int = 2, attempts: int = 2, pause: float = 0.0) -> Iterator[dict]:
    """Answers of call(row) -> (verdict, reason), as they come: at most ``at_once`` are open, ``per_source`` of one source. Rows are read
    ahead only as far as the pool needs: eight rows a place at most wait for their source."""
    open_: dict[Future, dict] = {}
    busy: Counter = Counter()
    waiting: deque = deque()
    rest = iter(rows)

    def ask(row: dict) -> dict:
        said = {"claim_id": row["claim_id"], "source_id": row["source_id"], "verdict": None, "reason": None, "error": None, "attempts": 0}
        for n in range(1, attempts + 1):
            said["attempts"] = n
            try:
                verdict, reason = call(row)
                return said | {"verdict": verdict, "reason": reason, "error": None}
            except Exception as problem:  # a failed call is an answer, too
                said["error"] = f"{type(problem).__name__}: {problem}"
                time.sleep(pause * n)
        return said

    with ThreadPoolExecutor(at_once) as pool:
        while True:
            while len(waiting) < 8 * at_once and (row := next(rest, None)) is not None:
                waiting.append(row)
            for _ in range(len(waiting)):
                row = waiting.popleft()
                if len(open_) < at_once and busy[row["source_id"]] < per_source:
                    busy[row["source_id"]] += 1
                    open_[pool.submit(ask, row)] = row
                else:
                    waiting.append(row)
            if not open_:
                return
            done, _ = wait(open_, return_when=FIRST_COMPLETED)
            for f in done:
                busy[open_.pop(f)["source_id"]] -= 1
                yield f.result()


def judge(items: DataFrame, call: Callable[[dict], tuple[str, str]], partitions: int | None = None, **limits) -> DataFrame:
    """items (claim_id, source_id and what call reads) with a judge's words: claim_id, source_id, verdict, reason, error, attempts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = pa.schema([("claim_id", pa.string()), ("source_id", pa.string()), ("verdict", pa.string()), ("reason", pa.string()), ("error", pa.string()), ("attempts", pa.int32())])
        held: list[dict] = []
        for said in calls((row for batch in batches for row in batch.to_pylist()), call, **limits):
            held.append(said)
            if len(held) == 256:
                yield pa.RecordBatch.from_pylist(held, fields)
                held = []
        yield pa.RecordBatch.from_pylist(held, fields)

    n = partitions or items.sparkSession.sparkContext.defaultParallelism
    return items.repartition(n).mapInArrow(run, SAID)


# -- metrics ----------------------------------------------------------------------------------------------------------------


def _agreement(want: pa.Array, got: pa.Array) -> float:
    """Cohen's kappa of two raters; 1 where both always say the same one thing."""
    pairs = [(a, b) for a, b in zip(want.to_pylist(), got.to_pylist(), strict=True) if a is not None and b is not None]
    if not pairs:
        return 0.0
    n = len(pairs)
    left, right = Counter(a for a, _ in pairs), Counter(b for _, b in pairs)
    agreed, chance = sum(a == b for a, b in pairs) / n, sum(left[k] * right[k] for k in left) / n / n
    return 1.0 if chance == 1 else (agreed - chance) / (1 - chance)


def _balanced(want: pa.Array, got: pa.Array) -> float:
    """The mean over wanted verdicts of the share that was met."""
    seen, met = Counter(), Counter()
    for a, b in zip(want.to_pylist(), got.to_pylist(), strict=True):
        if a is not None:
            seen[a] += 1
            met[a] += a == b
    return sum(met[k] / seen[k] for k in sorted(seen)) / len(seen) if seen else 0.0


#: Metrics of (wanted, given) verdicts of a group; a configuration names those that it wants.
METRICS: dict[str, Callable[[pa.Array, pa.Array], float]] = {"agreement": _agreement, "balanced_accuracy": _balanced}


def _grouped(metric: Callable[[pa.Array, pa.Array], float]):
    """A metric as a grouped aggregate."""

    def of(want: pa.Array, got: pa.Array) -> float:
        return float(metric(want, got))

    return arrow_udf(of, "double")


def register_metrics(spark: SparkSession, names: list[str], metrics: dict[str, Callable] | None = None) -> list[str]:
    """Registers grouped metrics for SQL; unknown names are an error. A group's verdicts are held by one task, as short words."""
    known = METRICS | (metrics or {})
    if unknown := sorted(set(names) - set(known)):
        raise ValueError(f"unknown metrics: {', '.join(unknown)}")
    for name in names:
        spark.udf.register(name, _grouped(known[name]))
    return names


def measured(verdicts: DataFrame, by: str, names: list[str], metrics: dict[str, Callable] | None = None) -> DataFrame:
    """verdicts (by, want, got): the metrics of each group, rounded to 6 places."""
    own = ", ".join(f"round({n}(want, got), 6) AS {n}" for n in register_metrics(verdicts.sparkSession, names, metrics))
    return verdicts.sparkSession.sql(f"SELECT {by}, {own} FROM {{v}} GROUP BY {by}", v=verdicts.select(by, F.col("want").cast("string"), F.col("got").cast("string")))
