"""Snapshots of fetched pages as a data source of Spark's: written in commits, read in whole, by URL, or as a stream of commits.

A snapshot is a folder that driver and executors share. Each task of a write puts its rows into files by bucket of their URL; the
driver then lists all files of the write in one commit, so that files of lost or repeated tasks are never read. A filter on one URL
reads its bucket alone. As a stream, each commit is an offset.

Rows: url, fetched_at, body. A null url is in bucket 0, and no filter on a URL meets it. An empty write is a commit of no files. Commits are
numbered; two writes at one time get two numbers, as a commit's file is made exclusively.
"""

from __future__ import annotations

import gzip
import json
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, InputPartition, WriterCommitMessage

SCHEMA = "url string, fetched_at long, body string"


def bucket_of(url: str | None, buckets: int) -> int:
    return zlib.crc32((url or "").encode()) % buckets if url is not None else 0


def commits(path: str) -> list[dict]:
    """The commits of a snapshot, in order."""
    folder = os.path.join(path, "commits")
    names = sorted(os.listdir(folder)) if os.path.isdir(folder) else []
    out = []
    for name in names:
        if name.endswith(".json"):
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                out.append(json.load(f))
    return out


@dataclass
class Files(InputPartition):
    """Files that one task reads."""

    names: list[str]


@dataclass
class Written(WriterCommitMessage):
    """(bucket, file, rows) of one task."""

    files: list[tuple[int, str, int]]


def _rows(path: str, part: Files) -> Iterator[tuple]:
    for name in part.names:
        with gzip.open(os.path.join(path, "files", name), "rt", encoding="utf-8") as f:
            for line in f:
                yield tuple(json.loads(line))


def _parts(files: list[tuple[int, str, int]]) -> list[Files]:
    """A partition for each bucket."""
    by_bucket: dict[int, list[str]] = {}
    for bucket, name, _ in files:
        by_bucket.setdefault(bucket, []).append(name)
    return [Files(names) for _, names in sorted(by_bucket.items())]


class _Reader(DataSourceReader):
    def __init__(self, path: str, buckets: int):
        self.path, self.buckets, self.url = path, buckets, None

    def pushFilters(self, filters):
        """One URL chooses a bucket; every filter is applied to the rows as well."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("url",):
                self.url = f.value
            yield f

    def partitions(self):
        files = [tuple(f) for c in commits(self.path) for f in c["files"]]
        if self.url is not None:
            files = [f for f in files if f[0] == bucket_of(self.url, self.buckets)]
        return _parts(files) or [Files([])]

    def read(self, partition):
        return _rows(self.path, partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"commits": 0}

    def latestOffset(self) -> dict:
        return {"commits": len(commits(self.path))}

    def partitions(self, start: dict, end: dict):
        return _parts([tuple(f) for c in commits(self.path)[start["commits"] : end["commits"]] for f in c["files"]]) or [Files([])]

    def read(self, partition):
        return _rows(self.path, partition)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, buckets: int, overwrite: bool):
        self.path, self.buckets, self.overwrite = path, buckets, overwrite

    def write(self, iterator) -> Written:
        os.makedirs(os.path.join(self.path, "files"), exist_ok=True)
        own, open_files = uuid.uuid4().hex, {}
        try:
            for row in iterator:
                bucket = bucket_of(row["url"], self.buckets)
                if bucket not in open_files:
                    name = f"{bucket:04d}-{own}.jsonl.gz"
                    open_files[bucket] = [name, gzip.open(os.path.join(self.path, "files", name), "wt", encoding="utf-8"), 0]
                held = open_files[bucket]
                held[1].write(json.dumps([row["url"], row["fetched_at"], row["body"]]) + "\n")
                held[2] += 1
        finally:
            for _, f, _ in open_files.values():
                f.close()
        return Written([(bucket, name, n) for bucket, (name, _, n) in sorted(open_files.items())])

    def commit(self, messages) -> None:
        folder = os.path.join(self.path, "commits")
        os.makedirs(folder, exist_ok=True)
        if self.overwrite:
            for name in os.listdir(folder):
                os.unlink(os.path.join(folder, name))
        body = json.dumps({"buckets": self.buckets, "files": [f for m in messages if m is not None for f in m.files]})
        number = len(os.listdir(folder))
        while True:
            try:
                with open(os.path.join(folder, f"{number:08d}.json"), "x", encoding="utf-8") as f:
                    f.write(body)
                return
            except FileExistsError:
                number += 1

    def abort(self, messages) -> None:
        for m in messages:
            for _, name, _ in m.files if m is not None else []:
                os.unlink(os.path.join(self.path, "files", name))


class SnapshotSource(DataSource):
    """Options: path (a shared folder), buckets (of a write; 16)."""

    @classmethod
    def name(cls) -> str:
        return "snapshot"

    def schema(self) -> str:
        return SCHEMA

    def _path(self) -> str:
        return self.options["path"].removeprefix("file://").removeprefix("file:")

    def reader(self, schema) -> DataSourceReader:
        known = commits(self._path())
        return _Reader(self._path(), known[-1]["buckets"] if known else 1)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self._path())

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        known = [] if overwrite else commits(self._path())
        return _Writer(self._path(), known[-1]["buckets"] if known else int(self.options.get("buckets", "16")), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format "snapshot" known, and lets Spark hand it filters."""
    spark.dataSource.register(SnapshotSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write(pages: DataFrame, path: str, buckets: int = 16, mode: str = "append") -> None:
    """pages (url, fetched_at, body) as a commit of a snapshot."""
    register(pages.sparkSession)
    pages.selectExpr("url", "CAST(fetched_at AS long) AS fetched_at", "CAST(body AS string) AS body").write.format("snapshot").mode(mode).option("buckets", buckets).save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("snapshot").load(path)


def stream(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.readStream.format("snapshot").load(path)
