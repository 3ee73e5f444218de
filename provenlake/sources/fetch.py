"""Rules around fetched sources: public URLs, content types, kinds, resolution of copies. Payloads come as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenlake.functions.text import once
from provenlake.sources.addresses import address, network_class

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)"


def url_problem(url: Column) -> Column:
    """Why a URL is not fetched, or null: only http(s) with a public host is. Names are resolved elsewhere."""
    scheme, host = F.lower(F.regexp_extract(url, _PARTS, 1)), F.lower(F.regexp_extract(url, _PARTS, 2))
    name = F.regexp_replace(host, r"\.$", "")
    is_local = name.isin("localhost", "localhost.localdomain") | name.endswith(".localhost")
    place = once(address(host), lambda at: F.when(at == "bad", "host").when(network_class(at) != "public", "private_address"))
    return F.when(url.isNull() | ~scheme.isin("http", "https"), "scheme").when(host == "", "host").when(is_local, "private_address").otherwise(place)


def media_type(content_type: Column) -> Column:
    t = F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    return F.when(t != "", t)


def kind(url: Column, content_type: Column, fallback: Column) -> Column:
    t = media_type(content_type)
    return F.when((t == "application/pdf") | F.lower(F.split_part(url, F.lit("?"), F.lit(1))).endswith(".pdf"), "text_pdf").when(t.isin("text/html", "application/xhtml+xml"), "html").otherwise(fallback)


def needs_browser(kind_: Column, status: Column, warnings: Column) -> Column:
    return (kind_ == "html") & (F.coalesce(status == 403, F.lit(False)) | F.array_contains(warnings, "fetch_timeout"))


def bounded(payloads: DataFrame, most: int = 4 * 1024 * 1024) -> DataFrame:
    """Payloads (body binary, fetch_status, failure_reason); those over ``most`` bytes fail."""
    over = F.length("body") > most
    return payloads.withColumn("fetch_status", F.when(over, "failed").otherwise(F.col("fetch_status"))).withColumn("failure_reason", F.when(over, "The source is too large.").otherwise(F.col("failure_reason"))).withColumn("body", F.when(~over, F.col("body")))


def resolved(references: DataFrame, uploads: DataFrame, fetched: DataFrame, rendered: DataFrame) -> DataFrame:
    """The first copy there is of each reference: uploaded, fetched, rendered; else a failure. Tables: reference_id, body."""
    out = references
    for name, table in (("uploaded", uploads), ("exact_fetch", fetched), ("browser", rendered)):
        out = out.join(table.where("body IS NOT NULL").groupBy("reference_id").agg(F.max("body").alias(f"_{name}")), "reference_id", "left")
    method = F.when(F.col("_uploaded").isNotNull(), "uploaded").when(F.col("_exact_fetch").isNotNull(), "exact_fetch").when(F.col("_browser").isNotNull(), "browser").otherwise("failed")
    return out.withColumn("body", F.coalesce("_uploaded", "_exact_fetch", "_browser")).withColumn("method", method).withColumn("fetch_status", F.when(method == "failed", "failed").otherwise("fetched")).drop("_uploaded", "_exact_fetch", "_browser")


def is_timeout(kind: Column, message: Column) -> Column:
    """Whether a failed fetch counts as a timeout: by the kind of its error, or by what it says."""
    return F.coalesce(F.lower(kind).contains("timeout"), F.lit(False)) | F.coalesce(F.lower(message).contains("timed out"), F.lit(False))
