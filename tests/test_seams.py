"""Snapshots as a data source, calls with bounded concurrency, metrics, logs of items, the table function of reports."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from provenlake.operators import item_log, judging
from provenlake.sources import docx, snapshots

PAGE = "url string, fetched_at long, body string"


def test_snapshot_reads_what_was_committed(spark, tmp_path):
    path = str(tmp_path / "snap")
    rows = [(f"https://example.org/{i % 30}", i, f"<p>é {i}\n\"x\"</p>") for i in range(100)] + [(None, None, None)]
    df = spark.createDataFrame(rows, PAGE)
    snapshots.write(df.repartition(3), path, buckets=8)
    snapshots.write(df.where("fetched_at < 5"), path)
    (tmp_path / "snap" / "files" / "0001-lost.jsonl.gz").write_bytes(b"left by a lost task")
    got = sorted(map(str, (tuple(r) for r in snapshots.read(spark, path).collect())))
    assert got == sorted(map(str, rows + [r for r in rows if r[1] is not None and r[1] < 5]))
    one = snapshots.read(spark, path).where("url = 'https://example.org/7'")
    assert sorted(r.fetched_at for r in one.collect()) == [7, 37, 67, 97]
    reader = snapshots.SnapshotSource({"path": path}).reader(None)
    every = sum(len(p.names) for p in reader.partitions())
    list(reader.pushFilters([snapshots.EqualTo(("url",), "https://example.org/7")]))
    assert 0 < sum(len(p.names) for p in reader.partitions()) < every
    snapshots.write(df.limit(0), path, mode="overwrite")
    assert snapshots.read(spark, path).count() == 0


def test_snapshot_stream_has_a_batch_for_each_commit(spark, tmp_path):
    path, seen = str(tmp_path / "snap"), []
    df = spark.createDataFrame([("u", 1, "a"), ("v", 2, "b")], PAGE)
    snapshots.write(df, path)
    q = snapshots.stream(spark, path).writeStream.foreachBatch(lambda b, n: seen.append(sorted(r.fetched_at for r in b.collect()))).option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        snapshots.write(df.where("url = 'v'"), path)
        q.processAllAvailable()
    finally:
        q.stop()
    assert [x for x in seen if x] == [[1, 2], [2]]


def test_calls_are_bounded():
    lock, now, most, by_source = threading.Lock(), [0], [0], {}

    def call(row):
        with lock:
            now[0] += 1
            by_source[row["source_id"]] = by_source.get(row["source_id"], 0) + 1
            most[0] = max(most[0], now[0])
            assert by_source[row["source_id"]] <= 2
        time.sleep(0.01)
        with lock:
            now[0] -= 1
            by_source[row["source_id"]] -= 1
        if row["claim_id"].endswith("3"):
            raise ValueError("no")
        return "unsupported", row["claim_id"]

    rows = [{"claim_id": f"c{i}", "source_id": "hot" if i % 2 else f"s{i % 7}"} for i in range(80)]
    said = list(judging.calls(rows, call, at_once=5, per_source=2, attempts=3))
    assert sorted(x["claim_id"] for x in said) == sorted(r["claim_id"] for r in rows)
    assert 2 < most[0] <= 5
    assert {x["claim_id"]: (x["error"], x["attempts"]) for x in said if x["error"]} == {f"c{i}3": ("ValueError: no", 3) for i in ("", 1, 2, 3, 4, 5, 6, 7)}
    read = []
    endless = ({"claim_id": str(read.append(i) or i), "source_id": None} for i in range(10**9))
    first = next(judging.calls(endless, lambda row: ("x", "y"), at_once=2))
    assert first["verdict"] == "x" and len(read) <= 40 and list(judging.calls([], call)) == []


def test_judge_in_tasks(spark):
    def call(row):
        return ("unsupported", "r") if row["n"] else ("contradicted", "z")

    df = spark.createDataFrame([("a", "s", 0), ("b", None, 1), ("b", None, 1)], "claim_id string, source_id string, n int")
    assert sorted((r.claim_id, r.verdict, r.attempts) for r in judging.judge(df, call, partitions=2).collect()) == [("a", "contradicted", 1), ("b", "unsupported", 1), ("b", "unsupported", 1)]


def test_metrics(spark):
    v = spark.createDataFrame([(1, "a", "a"), (1, "b", "b"), (1, "b", "a"), (2, "a", "a"), (3, "a", None), (4, None, None)], "g int, want string, got string")
    got = {r.g: (r.agreement, r.balanced_accuracy, r.n) for r in judging.measured(v, "g", ["agreement", "balanced_accuracy", "n"], {"n": lambda want, got: len(want)}).collect()}
    assert got == {1: (0.4, 0.75, 3.0), 2: (1.0, 1.0, 1.0), 3: (0.0, 0.0, 1.0), 4: (0.0, 0.0, 1.0)}
    with pytest.raises(ValueError, match="unknown metrics: other"):
        judging.register_metrics(spark, ["other"])


LOG = "review_id int, sentence_id string, reference_id string, seq long, status string, verdict string"


def test_log_in_any_order(spark, tmp_path):
    """Late and repeated events, as a table and as a stream in three batches."""
    events = [(1, "s", "r", 3, "completed", "x"), (1, "s", "r", 1, "open", None), (1, "s", "r", 5, "open", None), (1, "s", "r", 4, "completed", "y"), (1, "t", "r", 2, "open", None), (1, "t", "r", 7, "invalid", None), (1, "t", "r", 2, "open", None), (2, None, "r", None, "open", None)]
    want = {(1, "s", "completed", "x", 3), (1, "t", "invalid", None, 7), (2, None, "open", None, None)}
    state = lambda df: {(r.review_id, r.sentence_id, r.status, r.verdict, r.seq) for r in df.collect()}
    assert state(item_log.latest(spark.createDataFrame(events, LOG))) == want
    assert {r.sentence_id for r in item_log.open_items(spark.createDataFrame(events, LOG)).collect()} == {"t", None}
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    log = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(source + "/*")
    for k, part in enumerate((events[2:5], events[:3], events[4:])):
        spark.createDataFrame(part, LOG).coalesce(1).write.parquet(f"{source}/{k}")
    q = item_log.write_states(log, out, str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    last = spark.read.parquet(out)
    assert state(last.where(F.col("version") == last.agg(F.max("version")).first()[0])) == want


def test_report_packages(spark):
    good = docx.write_docx([("Heading1", "A & <b>"), (None, "x\ty\nz"), ("Normal", "  ")])
    files = [("a.docx", good), ("b.docx", good[:40]), ("c.docx", good.replace(b"word/document.xml", b"word/documens.xml")), ("d.txt", good), ("e.docx", None), (None, good), ("f.docx", docx.write_docx([]))]
    df = spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in files], "path string, content binary")
    rows = docx.docx_paragraphs(df).collect()
    assert [(r.ord, r.style_id, r.text) for r in rows if r.report_id == "a.docx"] == [(1, "Heading1", "A & <b>"), (2, None, "x y z")]
    assert {r.report_id: r.error for r in rows if r.error} == {"b.docx": "no_zip", "c.docx": "no_document", "d.txt": "suffix", "e.docx": "no_zip", None: "suffix"}
