"""Word reports (.docx): a table function from a package to its paragraphs, and the writer of plain packages.

docx_paragraphs joins each file laterally with the function's rows. A file that is no report, or is damaged, gives one row with its error; a
null path has no suffix, null content is no package, an empty document gives no rows. A package is held by one task while it is read."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

MOST_BYTES = 20 * 1024 * 1024
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def upload_problem(filename: str, size: int, content: bytes | None) -> str | None:
    """Why a file is not read as a report, or None."""
    if not filename.lower().endswith(".docx"):
        return "suffix"
    if size > MOST_BYTES:
        return "too_large"
    if content is None or not zipfile.is_zipfile(io.BytesIO(content)):
        return "no_zip"
    return None


def read_docx(content: bytes) -> list[tuple[str | None, str]]:
    """(style, text) of the body's own paragraphs; tabs stay tabs before white space is squeezed, breaks are spaces."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out = []
    for p in body.findall(f"{_W}p") if body is not None else []:
        style = p.find(f"{_W}pPr/{_W}pStyle")
        parts = []
        for e in p.iter():
            if e.tag == f"{_W}t":
                parts.append(e.text or "")
            elif e.tag == f"{_W}tab":
                parts.append("\t")
            elif e.tag in (f"{_W}br", f"{_W}cr"):
                parts.append(" ")
        out.append((style.get(f"{_W}val") if style is not None else None, " ".join("".join(parts).split())))
    return out


@udtf(returnType="ord int, style_id string, text string, error string")
class DocxParagraphs:
    """(path, content) to the package's paragraphs that have text, or to one row with the error."""

    def eval(self, path: str, content: bytes) -> Iterator[tuple]:
        problem = upload_problem(path or "", len(content or b""), content)
        paragraphs: list[tuple[str | None, str]] = []
        if problem is None:
            try:
                paragraphs = read_docx(bytes(content))
            except (KeyError, ElementTree.ParseError, zipfile.BadZipFile, zlib.error):
                problem = "no_document"
        if problem:
            yield 0, None, None, problem
        for i, (style, text) in enumerate(paragraphs):
            if text:
                yield i + 1, style, text, None


def docx_paragraphs(files: DataFrame) -> DataFrame:
    """files (path, content) to report_id, ord, style_id, text, error; a file that is no report gives one row with its error."""
    spark = files.sparkSession
    spark.udtf.register("docx_paragraphs", DocxParagraphs)
    return spark.sql("SELECT f.path AS report_id, p.ord, p.style_id, p.text, p.error FROM {files} f, LATERAL docx_paragraphs(f.path, f.content) p", files=files.select("path", "content"))


def write_docx(paragraphs: list[tuple[str | None, str]]) -> bytes:
    """A package of (style, text) paragraphs: a tab in a text is a tab, a line end a break."""
    out = []
    for style, text in paragraphs:
        runs = re.sub("\n", "</w:t><w:br/><w:t>", re.sub("\t", "</w:t><w:tab/><w:t>", escape(text)))
        look = f"<w:pPr><w:pStyle w:val={quoteattr(style)}/></w:pPr>" if style else ""
        out.append(f"<w:p>{look}<w:r><w:t>{runs}</w:t></w:r></w:p>")
    package = io.BytesIO()
    with zipfile.ZipFile(package, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{_W[1:-1]}"><w:body>{"".join(out)}</w:body></w:document>')
    return package.getvalue()


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Reports of a folder."""
    return docx_paragraphs(spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select(F.col("path"), "content"))
