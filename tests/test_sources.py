import io
import re
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from provenlake.plans import queries
from provenlake.sources import docx, fetch, html, pdf_lines
from provenlake.sources.html import html_blocks
from provenlake.streaming import files


HEAD = "<tr><th rowspan=2>Unit</th><th colspan=2>Year</th><th rowspan=99999999>Note</th></tr><tr><th>2024</th><th>2025</th></tr>"
BODY = "<tr><td>Sales</td><td>5</td><td>7</td><td>usd</td><td>9</td></tr><tr><td></td><td>Rate</td><td>3%</td></tr><tr><td>words</td><td>only</td></tr><tr><td>7</td></tr>"
PAGES = {
    "main": "<nav><p>menu entry here</p></nav><h1>Top</h1><p>outside</p><main><h2>Inner</h2><p>Kept <b>text</b>.</p><div><div>ad</div></div><pre>code  x</pre></main>",
    "roles": "<input><p>a</p><div role=dialog><div>x</div><p>hidden</p></div><p>b</p>",
    "unclosed": "<p>one<p>two</p><p>three</p>",
    "table": "<h2>T</h2><table><caption>Sales</caption><thead><tr><th></th><th colspan=2>Year</th></tr><tr><th></th><th>2024</th><th>2025</th></tr></thead><tr><td>Units</td><td>5</td><td>7</td></tr><tr><td>Note</td><td>x</td><td>y</td></tr></table><table><tr><td>Rate</td><td>3%</td></tr></table>",
    "spans": f"<table>{HEAD}{BODY}</table>",
    "thead": f"<table><thead>{HEAD}</thead>{BODY}</table>",
    "wide": "<table><tr><th>a</th><th colspan=150>b</th><th>c</th></tr><tr><td>x</td>" + "<td>1</td>" * 151 + "</tr></table>",
    "many": "<table>" + "<tr><td>r</td><td>1</td></tr>" * 50 + "</table>",
    "bare": "<table><tr></tr></table><td>5</td>",
    "nested": "<table><tr><td>a</td><td>1<table><tr><td>in</td><td>2</td></tr></table></td></tr><tr><td>b</td><td>3</td></tr></table>",
    "late": "<p>before</p><table><caption>C</caption><td>Loose</td><td>4</td></table><h3>After</h3><table><h4>no heading</h4><tr><td>x</td><td>5</td></table><div>a short one</div><div>revenue rose by 15 today</div>",
    "odd": "<nav><div><nav>x</nav>y</div></nav><svg><p>gone</p></svg><main/><p>seen &amp; kept<br/>on</p></p></div><section>A wrapper with forty characters and more in it.<p>inner</p></section>",
    "empty": "",
    "grid": "<table><tr><th rowspan=3>A</th><th colspan=2>B</th><th>C</th></tr><tr><th>D</th><th rowspan=2>E</th><th>F</th></tr><tr><th>G</th><th>H</th></tr><tr><td>r</td><td>1</td><td>2</td><td>3</td></tr></table>",
    "script": "<script>var a = '<p>no</p>';</script><p>yes</p><style>p{}</style>",
}


@pytest.fixture(scope="module")
def html_pages(spark):
    out = {k: [] for k in PAGES}
    for r in html_blocks(spark.createDataFrame(list(PAGES.items()), "source_id string, html string")).orderBy("source_id", "block_ord").collect():
        assert r.block_id == f"{r.source_id}-block-{r.block_ord}" and r.block_ord == len(out[r.source_id]) + 1
        out[r.source_id].append((r.text, r.heading))
    return out


def test_html_prefers_main_and_skips_chrome(html_pages):
    assert html_pages["main"] == [("Kept text.", "Inner"), ("code x", "Inner")]
    assert html_pages["script"] == [("yes", None)]


def test_html_void_tags_roles_and_unclosed_paragraphs(html_pages):
    assert html_pages["roles"] == [("a", None), ("b", None)]
    assert [t for t, _ in html_pages["unclosed"]] == ["two", "three", "one"]
    assert html_pages["odd"] == [] and html_pages["empty"] == []  # its <main> is empty


def test_html_tables(html_pages):
    assert html_pages["table"] == [("Table: Sales. Row: Units. Year 2024: 5. Year 2025: 7.", "T"), ("Row: Rate. Value: 3%.", "T")]
    assert html_pages["late"] == [("before", None), ("Table: C. Row: Loose. Value: 4.", None), ("Row: x. Value: 5.", "After"), ("revenue rose by 15 today", "After")]


def test_html_header_cells_over_rows_and_columns(html_pages):
    want = ["Row: Sales. Year 2024: 5. Year 2025: 7. Note: usd. Column 5: 9.", "Row: Rate. Year 2024: Rate. Year 2025: 3%."]
    assert [t for t, _ in html_pages["spans"]] == want and [t for t, _ in html_pages["thead"]] == want
    assert html_pages["wide"][0][0].endswith(". b: 1. c: 1.") and "Column" not in html_pages["wide"][0][0]
    assert len(html_pages["many"]) == 40 and html_pages["bare"] == []
    assert html_pages["grid"] == [("Row: r. B D G: 1. B E: 2. C F H: 3.", None)]


def test_html_nested_table_does_not_close_the_outer(html_pages):
    assert [t for t, _ in html_pages["nested"]] == ["Row: in. Value: 2.", "Row: a. Value: 1.", "Row: b. Value: 3."]


def test_html_pages_of_one_id_and_none(spark):
    rows = [("p", "<h1>A</h1><p>one</p>"), ("p", "<h1>B</h1><p>two</p>"), (None, "<p>three</p>"), ("q", None)]
    got = html_blocks(spark.createDataFrame(rows, "source_id string, html string")).collect()
    assert sorted((str(r.source_id), r.block_ord, r.text, str(r.heading)) for r in got) == [("None", 1, "three", "None"), ("p", 1, "one", "A"), ("p", 1, "two", "B")]


def test_html_blocks_frame(spark):
    df = spark.createDataFrame([("p", "<p>hello there</p>"), ("q", None)], "source_id string, html string")
    assert [(r.block_id, r.text) for r in html_blocks(df).collect()] == [("p-block-1", "hello there")]


def _docx(*paragraphs) -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t><w:tab/><w:t>x</w:t></w:r></w:p>' for s, t in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    return out.getvalue()


def test_docx(spark):
    df = spark.createDataFrame([("a.docx", bytearray(_docx(("Heading1", "Title"), ("Normal", "Body")))), ("b.docx", bytearray(b"no zip")), ("c.txt", bytearray(b""))], "path string, content binary")
    rows = docx.docx_paragraphs(df).collect()
    assert [(r.style_id, r.text) for r in rows if r.report_id == "a.docx"] == [("Heading1", "Title x"), ("Normal", "Body x")]
    assert {r.report_id: r.error for r in rows if r.error} == {"b.docx": "no_zip", "c.txt": "suffix"}


def test_url_guard(spark):
    urls = ["https://example.org/a", "ftp://example.org", "http://127.0.0.1/x", "http://192.168.1.4", "http://8.8.8.8/", "http://localhost:80/", "http://[::1]/", None, "https://user@10.0.0.1/"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(fetch.url_problem(F.col("u")).alias("p"))
    assert [r.p for r in df.collect()] == [None, "scheme", "private_address", "private_address", None, "private_address", "private_address", "scheme", "private_address"]


def test_url_guard_in_other_words(spark):
    local = ["[::ffff:127.0.0.1]", "[::]", "[fe90::1]", "2130706433", "0x7f.0.0.1", "127.1", "localhost.", "192.0.0.1", "198.18.0.1", "0177.0.0.1", "10.1", "[fe80::1%25eth0]", "[64:ff9b::7f00:1]", "[2002:7f00:1::]", "0", "a.localhost", "224.0.0.1", "[2001:db8::8]", "[::ffff:a00:1]", "127.0.0.1."]
    public = ["8.8.8.8", "134744072", "192.0.0.9", "example.org.", "[2606:4700::1111]", "[::ffff:8.8.8.8]", "1e100.net", "0x08080808", "[2001:20::1]", "3com.com", "x.1a"]
    bad = ["1.2.3.4.5", "256.1.1.1", "[::1", "[1:2:3]", "[1::2::3]", "09.1.1.1", "4294967296", "1.2.3.", "a.7", "[12345::]", "[::1.2.3.400]"]
    df = spark.createDataFrame([(h, f"http://{h}/x") for h in [*local, *public, *bad]], "h string, u string").select("h", fetch.url_problem(F.col("u")).alias("p"))
    got = {r.h: r.p for r in df.collect()}
    assert {h: got[h] for h in local} == dict.fromkeys(local, "private_address")
    assert {h: got[h] for h in public} == dict.fromkeys(public, None)
    assert {h: got[h] for h in bad if h != "1.2.3."} == {h: "host" for h in bad if h != "1.2.3."}


def test_network_classes_are_those_of_the_standard_library(spark):
    import ipaddress
    import random

    from provenlake.sources import addresses

    r, hosts = random.Random(3), []
    for a, b, _, _ in addresses.ranges():
        hosts += [max(a - 1, 0), a, b, min(b + 1, (1 << 128) - 1), r.randint(a, b)]
    text = lambda x: str(ipaddress.ip_address(x - addresses.MAPPED)) if x >> 32 == 0xFFFF else f"[{ipaddress.IPv6Address(x)}]"
    rows = spark.createDataFrame([(str(x), text(x)) for x in hosts], "x string, h string").select("x", addresses.address(F.col("h")).alias("a"), addresses.network_class(addresses.address(F.col("h"))).alias("k"))
    for row in rows.collect():
        x = int(row.x)
        assert int(row.a, 16) == x
        ip = ipaddress.ip_address(x - addresses.MAPPED) if x >> 32 == 0xFFFF else ipaddress.IPv6Address(x)
        blocked = ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved or ip.is_unspecified or ip in ipaddress.ip_network("100.64.0.0/10") or (ip.version == 6 and (ip.is_site_local or ip in ipaddress.ip_network("3fff::/20")))
        assert (row.k != "public") == blocked, (ip, row.k)


def test_resolution_order(spark):
    refs = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "reference_id string")
    t = lambda *rows: spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "reference_id string, body binary")
    got = fetch.resolved(refs, t(("r1", b"up")), t(("r1", b"net"), ("r2", b"net")), t())
    assert {r.reference_id: (r.method, r.fetch_status) for r in got.collect()} == {"r1": ("uploaded", "fetched"), "r2": ("exact_fetch", "fetched"), "r3": ("failed", "failed")}


def test_pdf_rows_and_prose(spark):
    layout = "STATEMENTS OF INCOME\nin millions\nRevenue      120   110\nCosts        80    70\n1 / 9\nThe end."
    df = spark.createDataFrame([("s", 1, layout, "Prose here.\n1 2 3 4 5 6 7\n2 / 3")], "source_id string, page int, layout_text string, plain_text string")
    rows = [r.text for r in pdf_lines.table_rows(df).orderBy("block_ord").collect()]
    assert rows == ["Table: STATEMENTS OF INCOME. Headers: in millions. Row: Revenue 120 110.", "Table: STATEMENTS OF INCOME. Headers: in millions. Row: Costs 80 70."]
    assert pdf_lines.prose(df).first().text == "Prose here."


def test_stream_of_pages(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.html").write_text("<p>streamed page</p>")
    q = files.write_blocks(files.page_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert [r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["streamed page"]


def test_only_elements_are_sorted_for_main_and_only_said_rows_are_laid_out(spark):
    """Disk: texts and parts of tables do not travel for in_main, and of a long table the rows that are said are laid out, no more."""
    rows = "".join(f"<tr><td>Line {i}</td><td>{'none' if i % 3 == 0 else i}</td></tr>" for i in range(200))
    pages = spark.createDataFrame([("a", f"<main><table>{rows}</table></main>")], "source_id string, html string")
    found = html.events(pages)
    assert {r.kind for r in html._in_main(found).select("kind").collect()} == {"main", "table"}
    cells = html.with_header(html.table_cells(found))
    said = html.row_sentences(cells, html.column_names(html.placed_header(cells))).collect()
    assert sorted(r.row for r in said) == [i + 1 for i in range(200) if i % 3][: html.MOST_ROWS]


def test_header_grid_says_every_row_of_a_long_table(spark, tmp_path):
    """No row is left out after the 40th, neither by the query nor by its SQL."""
    rows = [(s, o, k % 7 + 1, float(k), 10.5 * k) for s in (4, 5, 6, 7) for k in range(1, 91) for o in [k // 7 + 1]]
    spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = queries.QUERIES["html_header_grid"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(f"SELECT source_id, block_ord, text, heading FROM ({queries.ORACLE_SQL['html_header_grid']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert len(want) == sum(k != 7 for _, _, k, _, _ in rows) > 4 * html.MOST_ROWS


def test_html_blocks_reads_references_as_its_sql(spark, tmp_path):
    """Its SQL leaves references without a semicolon as they are, all but &amp; the operator reads them as HTML does."""
    said = ["<h1>A cut title &quot</h1><p>b &amp c &ampd &lt x &copy z &quot;k&quot;</p>", "<p>k &quot;l&quot &quo &am & &amp;quot &amp;quot; &lt;i&gt;</p><p>x &middot; y &copy;&amp", "<p>&quot</p>", None]
    spark.createDataFrame(list(enumerate(said)), "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(queries.ORACLE_SQL["html_blocks"]).fetchall()
    got = queries.QUERIES["html_blocks"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and {r.heading for r in got if r.source_id == "0"} == {"A cut title &quot"}
    assert [e["text"] for e in html.lexed("<p>&quot</p>") if e["kind"] == "text"] == ['"']


def test_columns_without_a_name_between_named_ones(spark):
    """Names reach rows by place, also where some columns have none; rows are laid out without another exchange."""
    page = "<table><tr><th>a</th><th>b</th><th></th><th colspan=2>d</th></tr><tr><td>r</td><td>1</td><td>2</td><td>3</td><td></td><td>4</td></tr></table>"
    found = html.events(spark.createDataFrame([("p", page)], "source_id string, html string"))
    cells = html.with_header(html.table_cells(found).where("cell > 0").repartition("page", "in_table"))
    said = html.row_sentences(cells, html.column_names(html.placed_header(cells)), None)
    assert [r.text for r in said.collect()] == ["Row: r. b: 1. Column 3: 2. d: 3. Column 6: 4."]
    plan = re.sub(r"#\d+L?", "", said._jdf.queryExecution().executedPlan().toString())
    assert "hashpartitioning(page, in_table" in plan and "hashpartitioning(page, in_table, row" not in plan
