"""WARC records: reading, writing, and resolving not-modified revisits (operator 6).

A revisit record says that a server answered "not modified": it has headers and no payload. It is resolved by an as-of join,
by canonical URL, to the latest earlier full response (status 200); the join is right only if a validator agrees, and the
resolved record has the original's headers with those of the revisit that a 304 answer may renew.

The as-of join is skew-safe: time is cut into ``slices`` of about as many records each, by a quantile sketch of bounded size, so
that single times far off or a busy month crowd no slice; the last full response of each (URL, slice) is carried forward over
at most ``slices`` rows per URL, and only within one slice are rows ordered. A URL captured a billion times is so spread over
many tasks; captures of one URL at one and the same time stay together. Payloads take no part: only record ids, validators and
headers move.

Nulls: a record with a null or unparsable url resolves to nothing ("no_original"); null times come first; null headers count
as empty. Ties in time: the smaller record_id is earlier. Repeated rows are resolved each. Empty table: no rows. Other columns
are not read.

Files: a header field that comes again is joined by a comma; a date that is none is null. What lies behind damaged gzip data, and
a record that is cut off, is left out; after a record without a whole number as its length, reading goes on at the next line
that begins a record. A file is one row of Spark's reader, 2 GB at most.
"""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Header fields that a 304 answer may renew in a stored response (fixed values, of the HTTP caching standard).
RENEWED = ["age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Query parameters that do not tell pages apart (fixed values).
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|ref)="

URL_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www and default port, path without a trailing slash, query sorted and without tracking
    parameters, no scheme and no fragment; null where there is no scheme and host."""
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, URL_PARTS, 2)), r"^www[0-9]*\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(url, URL_PARTS, 3), "/$", "")
    query = F.regexp_replace(F.regexp_extract(url, URL_PARTS, 4), r"^\?", "")
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


def _validator(headers: Column, name: str) -> Column:
    """A validator of headers with lower-case names; weak tags compare like strong ones."""
    return F.regexp_replace(F.try_element_at(headers, F.lit(name)), "^W/", "")


def _slice(at: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts lie at or before a time: a binary search by falling steps."""
    if not cuts:
        return F.lit(0)
    steps = F.lit([1 << i for i in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(F.lit(cuts), n + step - 1) <= at, n + step).otherwise(n))


def resolve_revisits(records: DataFrame, slices: int = 512) -> DataFrame:
    """records: record_id, kind ('response' or 'revisit'), url, at (long), status, headers (map, lower-case names), digest.

    Per revisit: record_id, canonical, resolution (resolved, validator_mismatch, no_validator, no_original), original_id,
    original_at, digest (of the original, if resolved), headers (merged, if resolved).
    """
    own = records.select("record_id", "kind", canonical_url(F.col("url")).alias("canonical"), F.coalesce("at", F.lit(-(1 << 62))).alias("at"), "status", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), "digest")
    known = own.where("canonical IS NOT NULL")
    cuts = known.agg(F.percentile_approx("at", [i / slices for i in range(1, slices)], 20 * slices)).first()[0] if slices > 1 else []
    known = known.withColumn("slice", _slice(F.col("at"), sorted(set(cuts or []))))
    full = F.when((F.col("kind") == "response") & (F.col("status") == 200), F.struct("at", "record_id", "digest", "headers"))
    known = known.withColumn("full", full)
    last = known.where("full IS NOT NULL").groupBy("canonical", "slice").agg(F.max_by("full", F.struct("at", "record_id")).alias("full"))
    asked = known.where("kind = 'revisit'").select("canonical", "slice").distinct()
    steps = asked.join(last, ["canonical", "slice"], "full_outer")
    carried = steps.withColumn("carried", F.last("full", ignorenulls=True).over(Window.partitionBy("canonical").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))).select("canonical", "slice", "carried")
    within = Window.partitionBy("canonical", "slice").orderBy("at", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    found = known.withColumn("near", F.last("full", ignorenulls=True).over(within)).where("kind = 'revisit'").join(carried, ["canonical", "slice"], "left").withColumn("o", F.coalesce("near", "carried"))
    found = found.unionByName(own.where("canonical IS NULL AND kind = 'revisit'"), allowMissingColumns=True)
    agree = F.lit(None).cast("boolean")
    for mine, theirs in ((F.col("digest"), F.col("o.digest")), (_validator(F.col("headers"), "last-modified"), _validator(F.col("o.headers"), "last-modified")), (_validator(F.col("headers"), "etag"), _validator(F.col("o.headers"), "etag"))):
        agree = F.coalesce(mine == theirs, agree)  # an etag counts before a date, and that before a digest
    resolution = F.when(F.col("o").isNull(), "no_original").when(agree.isNull(), "no_validator").when(agree, "resolved").otherwise("validator_mismatch")
    renewed = F.map_filter("headers", lambda k, v: k.isin(RENEWED))
    merged = F.map_concat(F.map_filter("o.headers", lambda k, v: ~F.array_contains(F.map_keys(renewed), k)), renewed)
    return found.withColumn("resolution", resolution).select("record_id", "canonical", "resolution", F.col("o.record_id").alias("original_id"), F.col("o.at").alias("original_at"), F.when(F.col("resolution") == "resolved", F.col("o.digest")).alias("digest"), F.when(F.col("resolution") == "resolved", merged).alias("headers"))


# -- files ------------------------------------------------------------------------------------------------------------------


def to_warc(kind: str, fields: dict[str, str], block: bytes, compress: bool = True) -> bytes:
    """One WARC/1.1 record, as a gzip member of its own if compress."""
    head = "".join(f"{k}: {v}\r\n" for k, v in {"WARC-Type": kind, **fields, "Content-Length": str(len(block))}.items())
    raw = b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"
    return gzip.compress(raw, mtime=0) if compress else raw


def _head(stream) -> dict[str, str] | None:
    """Header lines up to the blank one; names in lower case, folded lines joined."""
    out: dict[str, str] = {}
    name = None
    while True:
        line = stream.readline()
        if not line:
            return None
        line = line.rstrip(b"\r\n")
        if not line:
            return out
        if line[:1] in b" \t" and name:
            out[name] += " " + line.strip().decode("utf-8", "replace")
            continue
        key, _, value = line.partition(b":")
        name = key.strip().lower().decode("utf-8", "replace")
        value = value.strip().decode("utf-8", "replace")
        out[name] = f"{out[name]}, {value}" if name in out else value


def _record(stream) -> tuple[dict[str, str], bytes] | None:
    """Fields and block of the next record that is whole; None at the end."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields = _head(stream)
        if fields is None:
            return None
        size = fields.get("content-length", "0")
        if size.isascii() and size.isdigit():
            block = stream.read(int(size))
            return (fields, block) if len(block) == int(size) else None
    return None


def _seconds(date: str | None) -> int | None:
    """Seconds of a WARC date, UTC where it says no zone; null where it is none."""
    try:
        at = datetime.fromisoformat(date or "")
    except ValueError:
        return None
    return int((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp())


def parse_warc(raw: bytes) -> Iterator[tuple[dict[str, str], int | None, dict[str, str], bytes]]:
    """(WARC fields, HTTP status, HTTP headers, payload) of each whole record; gzip members or plain."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(raw)) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)  # neither reads ahead of damage
    while True:
        try:
            if (found := _record(stream)) is None:
                return
        except (EOFError, gzip.BadGzipFile, zlib.error):
            return
        fields, block = found
        status, headers, payload = None, {}, block
        if fields.get("warc-type") in ("response", "revisit") and block.startswith(b"HTTP/"):
            inner = io.BytesIO(block)
            said = inner.readline().split()
            status = int(said[1]) if len(said) > 1 and said[1].isdigit() else None
            headers = _head(inner) or {}
            payload = inner.read()
        yield fields, status, headers, payload


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files by any store that Spark reads: record_id, kind, url, at (seconds), status, headers, digest, payload."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                rows = []
                for fields, status, headers, payload in parse_warc(raw):
                    rows.append((fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri"), _seconds(fields.get("warc-date")), status, list(headers.items()), fields.get("warc-payload-digest"), payload))
                    if len(rows) == 256:
                        yield _records(rows)
                        rows = []
                if rows:
                    yield _records(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "record_id string, kind string, url string, at long, status int, headers map<string,string>, digest string, payload binary")


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.string(), pa.binary()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(map(list, zip(*rows, strict=True)), kinds, strict=True)], ["record_id", "kind", "url", "at", "status", "headers", "digest", "payload"])


def captures(pages: DataFrame) -> DataFrame:
    """A crawl made of a table of pages (page_id, url, html): each page is a full response at its page_id in minutes, and is
    asked for again 1,000 pages later; that revisit knows the tag, the date or the digest of the page, or nothing."""
    page = pages.where("page_id IS NOT NULL").select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("digest"))
    day = F.date_format(F.timestamp_seconds(F.col("page_id") * 60), "yyyy-MM-dd HH:mm:ss")
    tag = F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"'))
    first = page.select((F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("kind"), "url", (F.col("page_id") * 60).alias("at"), F.lit(200).alias("status"), F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("date"), day, F.lit("etag"), tag, F.lit("last-modified"), day).alias("headers"), "digest")
    rule = F.col("page_id") % 4
    again = F.when(rule == 0, F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("date"), F.lit("again"), F.lit("content-type"), F.lit("text/plain"))).when(rule == 1, F.create_map(F.lit("last-modified"), day)).otherwise(F.create_map(F.lit("date"), F.lit("again")))
    second = page.select((F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), "url", ((F.col("page_id") + 1000) * 60 + 30).alias("at"), F.lit(304).alias("status"), again.alias("headers"), F.when(rule == 2, F.col("digest")).alias("digest"))
    return first.unionByName(second)
