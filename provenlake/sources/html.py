"""HTML pages to text blocks with their headings: markup as a table of events, everything else as relations over it.

Python only lexes: a page becomes rows (events), each with its place, the innermost open table and text element around it, and for
elements where they end. Regions that are not read make no rows. From there on Spark works:

* text elements are groups of events; which of them are leaves, prose or headings is told of groups;
* being inside <main> is a running maximum of where main elements end; the active heading is a window's last heading;
* rows, cells and captions of tables are windows over a table's events; header cells are placed on the grid by a fold over a
  table's header, and meet the body by column; a body row is a group of its cells.

A page is one input row, whatever its id: pages of one id do not mix. Pages with a null id count, too; a null page is empty. Elements that
are never closed end with the page, tables first, then the innermost one. An end tag closes the innermost open text element if it has its
name, and nothing otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenlake.functions.text import collapse
from provenlake.plans.store import settled, spread

# Tags and roles.
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = {"p", "li", "blockquote", "figcaption", "pre"}
CONTAINERS = {"div", "section", "article", "dd"}
UNREAD = {"script", "style", "noscript", "svg", "template", "canvas", "iframe", "object", "embed", "button", "input", "select", "textarea", "option"}
VOID = {"embed", "input", "br", "img", "hr", "meta", "link", "area", "base", "col", "source", "track", "wbr"}
ASIDE = {"nav", "footer", "aside"}
ASIDE_ROLES = {"alertdialog", "banner", "complementary", "contentinfo", "dialog", "menu", "menubar", "navigation", "search", "tablist", "toolbar"}
TABLE_PARTS = {"thead", "tbody", "tfoot"}
QUANTITY = r"(?iU)\d|%|percent|percentage points|basis points|bps|\$|usd|eur|gbp|cad|million|billion|trillion"
WORD = "[A-Za-z0-9][A-Za-z0-9&'-]*"
#: Rows said of a table, unless a caller asks for more or (None) for all.
MOST_ROWS = 40
#: The & of a named reference that lacks its semicolon (&quot at the end of a title that was cut), but of &amp.
BARE_REFERENCE = re.compile(r"&(?!amp)(?=[A-Za-z][A-Za-z0-9]*(?![A-Za-z0-9;]))")
#: Widest cell of the HTML standard; wider ones count as this.
MOST_COLUMNS = 1000

#: kind: main, table or block (elements, with upto), text, open or close (of parts of a table). in_table and in_block: the place
#: (n) of the innermost open one, 0 for none; of a table its own, of a block the one around it.
FIELDS = {"source_id": pa.string(), "page": pa.int64(), "n": pa.int32(), "kind": pa.string(), "tag": pa.string(), "in_table": pa.int32(), "in_block": pa.int32(), "upto": pa.int32(), "text": pa.string(), "cols": pa.int32(), "spans": pa.int32()}
EVENTS = "source_id string, page long, n int, kind string, tag string, in_table int, in_block int, upto int, text string, cols int, spans int"

#: What kind of element a tag makes. (Regions that are not read are told apart first.)
KINDS = {"main": "main", "table": "table"} | dict.fromkeys(HEADINGS | BLOCKS | CONTAINERS, "block") | dict.fromkeys(TABLE_PARTS | {"tr", "td", "th", "caption"}, "part")


def _span(value: str | None) -> int:
    """A colspan or rowspan; 1 where it is none."""
    digits = (value or "").strip()
    return max(1, min(int(digits), 1 << 30)) if digits.isdecimal() and len(digits) < 20 else 1


class _Lexer(HTMLParser):
    """One page's events. Elements of a kind nest among themselves: each kind has its own stack of open ones."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.events: list[dict] = []
        self.n = 0
        self.open: dict[str, list[dict]] = {"main": [], "table": [], "block": []}
        self.unread = 0
        self.region: tuple[str, int] | None = None  # an excluded element and how many of its name are open in it

    def _innermost(self, kind: str) -> int:
        return self.open[kind][-1]["n"] if self.open[kind] else 0

    def _place(self, kind: str, tag: str = "", **more) -> dict:
        self.n += 1
        event = {"n": self.n, "kind": kind, "tag": tag, "in_table": self._innermost("table"), "in_block": self._innermost("block"), "upto": None, "text": None, "cols": None, "spans": None} | more
        self.events.append(event)
        return event

    def _end(self, kind: str) -> None:
        self.n += 1
        self.open[kind].pop()["upto"] = self.n

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        kind = KINDS.get(tag)
        if tag in UNREAD:
            self.unread += tag not in VOID
        elif self.region:
            name, depth = self.region
            self.region = name, depth + (tag == name)
        elif tag in ASIDE or (given.get("role") or "").strip().lower() in ASIDE_ROLES:
            self.region = None if tag in VOID else (tag, 1)
        elif kind is None or self.unread or (kind == "part") != bool(self.open["table"] and kind not in ("main", "table")):
            pass  # nothing here, or text elements within tables and parts outside of them
        elif kind == "part":
            self._place("open", tag, cols=min(_span(given.get("colspan")), MOST_COLUMNS), spans=_span(given.get("rowspan")))
        else:
            event = self._place(kind, tag)
            self.open[kind].append(event)
            if kind == "table":
                event["in_table"] = event["n"]

    def handle_startendtag(self, tag, attrs):
        if tag not in UNREAD or tag in VOID:
            self.handle_starttag(tag, attrs)
            if tag not in VOID:
                self.handle_endtag(tag)

    def handle_endtag(self, tag):
        kind = KINDS.get(tag)
        if tag in UNREAD:
            self.unread = max(0, self.unread - (tag not in VOID))
        elif self.region:
            name, depth = self.region
            depth -= tag == name
            self.region = (name, depth) if depth else None
        elif self.unread or kind is None:
            pass
        elif kind == "part":
            if self.open["table"]:
                self._place("close", tag)
        elif self.open[kind] and self.open[kind][-1]["tag"] == tag and (kind == "table" or not self.open["table"]):
            self._end(kind)

    def handle_data(self, data):
        if not self.unread and not self.region and (self.open["table"] or self.open["block"]):
            self._place("text", text=data)

    def page(self, html: str) -> list[dict]:
        self.feed(html)
        self.close()
        for kind in ("table", "block", "main"):
            while self.open[kind]:
                self._end(kind)
        return self.events


def lexed(html: str, bare: bool = True) -> list[dict]:
    """The events of one page. Named references without a semicolon are read as HTML reads them; not bare: they are text, all but &amp."""
    return _Lexer().page(html if bare else BARE_REFERENCE.sub("&amp;", html))


def events(pages: DataFrame, id_col: str = "source_id", html_col: str = "html", bare: bool = True) -> DataFrame:
    """The events of all pages, a row each; settled, as several relations are made of them. bare: see lexed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, page, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = [e | {"source_id": source, "page": page} for e in lexed(html or "", bare)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(list(FIELDS.items())))

    own = spread(pages.select(F.col(id_col).cast("string").alias("source_id"), F.col(html_col).cast("string").alias("html")))
    return settled(own.select("source_id", F.monotonically_increasing_id().alias("page"), "html").mapInArrow(run, EVENTS))


def _said(parts: str = "parts") -> Column:
    """Texts collected as (n, text) in one, white space collapsed."""
    return collapse(F.array_join(F.transform(F.array_sort(parts), lambda x: x["text"]), ""))


def _in_main(found: DataFrame) -> DataFrame:
    """Adds in_main (an open main element around it) and saw_main (the page has one) to the elements; texts and parts of tables, by
    far the most events, need neither and are not sorted for it."""
    found = found.where(F.col("kind").isin("main", "table", "block"))
    page = Window.partitionBy("page").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    main = F.col("kind") == "main"
    found = found.withColumn("in_main", F.coalesce(F.max(F.when(main, F.col("upto"))).over(page) > F.col("n"), F.lit(False)))
    return found.withColumn("saw_main", F.max(main).over(Window.partitionBy("page")))


def text_elements(elements: DataFrame, found: DataFrame) -> DataFrame:
    """Of elements (with in_main) and events: source_id, page, at (where it ends), tag, text, leaf, in_main, saw_main of every element that has text."""
    text, block = F.col("kind") == "text", F.col("kind") == "block"
    own = found.where(text & (F.col("in_table") == 0)).unionByName(elements.where(block), allowMissingColumns=True)
    # a text counts for the element around it; an element for itself and, if it is no heading, as a child
    inside = F.when(F.col("tag").isin(*HEADINGS), F.array("n")).otherwise(F.array("n", "in_block"))
    own = own.withColumn("element", F.explode(F.when(text, F.array("in_block")).otherwise(inside))).where("element > 0")
    itself = block & (F.col("element") == F.col("n"))
    per = own.groupBy("page", "element").agg(
        F.max(F.when(itself, F.struct("upto", "tag", "in_main", "saw_main", "source_id"))).alias("e"),
        F.collect_list(F.when(text, F.struct("n", "text"))).alias("parts"),
        (~F.max(block & ~itself)).alias("leaf"),
    )
    return per.select("e.source_id", "page", F.col("e.upto").alias("at"), "e.tag", _said().alias("text"), "leaf", "e.in_main", "e.saw_main").where("text != ''")


def _is_prose(text: Column) -> Column:
    words, size = F.regexp_count(text, F.lit(WORD)), F.length(text)
    return ((size >= 40) & (words >= 5)) | ((size >= 16) & (words >= 3) & text.rlike(r"(?U)\d"))


# -- tables ---------------------------------------------------------------------------------------------------------------


def table_cells(found: DataFrame) -> DataFrame:
    """Of events: page, in_table, cell (0: the caption), row, part, head, cols, spans, text. Rows are numbered from 1 among those
    that have cells; a row that was never opened counts as one."""
    table = Window.partitionBy("page", "in_table").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened, closed = F.col("kind") == "open", F.col("kind") == "close"
    is_part, is_cell, row, caption = F.col("tag").isin(*TABLE_PARTS), F.col("tag").isin("td", "th"), F.col("tag") == "tr", F.col("tag") == "caption"
    last = lambda value: F.last(value, ignorenulls=True).over(table)
    own = found.where("in_table > 0").select("page", "in_table", "n", "kind", "tag", "text", "cols", "spans").withColumns({
        "part": F.coalesce(last(F.when(opened & is_part, F.col("tag")).when(closed & is_part, "")), F.lit("")),
        "tr": F.count(F.when(opened & row, 1)).over(table),
        "cell": F.coalesce(last(F.when(opened & is_cell, F.col("n")).when(row | (closed & is_cell), 0)), F.lit(0)),
        "captioned": F.coalesce(last(F.when(caption, opened)), F.lit(False)),
    })
    text = (F.col("kind") == "text") & ((F.col("cell") > 0) | F.col("captioned"))
    cells = own.where(text | (opened & is_cell)).groupBy("page", "in_table", "cell").agg(
        F.max(F.when(opened & is_cell, F.struct("tr", "part", (F.col("tag") == "th").alias("head"), "cols", "spans"))).alias("c"),
        F.collect_list(F.when(text, F.struct("n", "text"))).alias("parts"),
    )
    cells = cells.select("page", "in_table", "cell", "c.tr", "c.part", "c.head", "c.cols", "c.spans", _said().alias("text"))
    rows = Window.partitionBy("page", "in_table").orderBy("tr")
    return cells.withColumn("row", F.when(F.col("cell") > 0, F.dense_rank().over(rows) - F.max((F.col("cell") == 0).cast("int")).over(Window.partitionBy("page", "in_table"))))


def with_header(cells: DataFrame) -> DataFrame:
    """Adds in_head: rows of <thead> where a table has any with cells, else the leading rows of header cells alone."""
    table, row = Window.partitionBy("page", "in_table"), Window.partitionBy("page", "in_table", "row")
    own = cells.where("cell > 0").withColumn("all_head", F.min("head").over(row))
    own = own.withColumn("thead", F.max(F.col("part") == "thead").over(row))
    own = own.withColumn("leading", F.min("all_head").over(table.orderBy("row"))).withColumn("marked", F.max("thead").over(table))
    return own.withColumn("in_head", F.when(F.col("marked"), F.col("thead")).otherwise(F.col("leading"))).drop("all_head", "thead", "leading", "marked")


def placed_header(cells: DataFrame) -> DataFrame:
    """page, in_table, top (header row from 1), left, cols, text: header cells on the grid, each at the first place of its row that no
    cell from above covers. A fold over a table's header cells: where the next cell may lie, and what reaches down."""
    order = Window.partitionBy("page", "in_table").orderBy("row")
    heads = cells.where("in_head").withColumn("top", F.dense_rank().over(order))
    heads = heads.groupBy("page", "in_table").agg(F.array_sort(F.collect_list(F.struct("top", "cell", "cols", "spans", "text"))).alias("heads"))
    nothing = F.struct(F.lit(0).alias("top"), F.lit(0).alias("next"), F.array().cast("array<struct<last:int,left:int,right:int>>").alias("held"), F.array().cast("array<struct<top:int,left:int,cols:int,text:string>>").alias("placed"))

    def place(s: Column, x: Column) -> Column:
        start = F.when(x["top"] == s["top"], s["next"]).otherwise(0)
        held = F.filter(s["held"], lambda h: h["last"] >= x["top"])
        free = F.filter(F.concat(F.array(start), F.transform(held, lambda h: h["right"])), lambda c: (c >= start) & ~F.exists(held, lambda h: (h["left"] <= c) & (c < h["right"])))
        left = F.array_min(free)
        reach = F.array(F.struct((x["top"] + x["spans"] - 1).alias("last"), left.alias("left"), (left + x["cols"]).alias("right")))
        return F.struct(
            x["top"].alias("top"), (left + x["cols"]).alias("next"), F.when(x["spans"] > 1, F.concat(held, reach)).otherwise(held).alias("held"),
            F.concat(s["placed"], F.array(F.struct(x["top"].alias("top"), left.alias("left"), x["cols"].alias("cols"), x["text"].alias("text")))).alias("placed"),
        )

    return heads.select("page", "in_table", F.explode(F.aggregate("heads", nothing, place, lambda s: s["placed"])).alias("p")).select("page", "in_table", "p.top", "p.left", "p.cols", "p.text")


def column_names(placed: DataFrame) -> DataFrame:
    """page, in_table, col, name: the distinct texts of the header cells over each column, from the top."""
    over = placed.where("text != ''").select("page", "in_table", "top", "text", F.explode(F.sequence("left", F.col("left") + F.col("cols") - 1)).alias("col"))
    texts = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("top", "text"))), lambda x: x["text"]))
    return over.groupBy("page", "in_table", "col").agg(F.array_join(texts, " ").alias("name"))


def row_sentences(cells: DataFrame, names: DataFrame, most_rows: int | None = MOST_ROWS) -> DataFrame:
    """page, in_table, row, text: each body row that has a label and a quantity, as a sentence; most_rows a table at most, all of
    them for None."""
    row = Window.partitionBy("page", "in_table", "row").orderBy("cell")
    body = cells.where("NOT in_head").withColumn("start", F.sum("cols").over(row).cast("int") - F.col("cols"))
    # which rows will be said is told by their cells: only those are laid out column by column
    counts = (F.col("start") + F.col("cols") > 1) & (F.col("text") != "") & F.col("text").rlike(QUANTITY)
    body = body.withColumn("counts", F.max(counts).over(Window.partitionBy("page", "in_table", "row"))).where("counts")
    if most_rows is not None:
        body = body.withColumn("r", F.dense_rank().over(Window.partitionBy("page", "in_table").orderBy("row"))).where(F.col("r") <= most_rows)
    body = body.groupBy("page", "in_table", "row").agg(F.array_sort(F.collect_list(F.struct("start", "cols", "text"))).alias("cells"))
    # a table's names come to its rows whole, by place (null where there is none), so that rows are dealt out by table and no more
    own = names.groupBy("page", "in_table").agg(F.array_sort(F.collect_list(F.struct("col", "name"))).alias("known"))
    gap = lambda x, i: x["col"] - F.coalesce(F.get("known", i - 1)["col"], F.lit(-1)) - 1
    own = own.select("page", "in_table", F.flatten(F.transform("known", lambda x, i: F.concat(F.array_repeat(F.lit(None).cast("string"), gap(x, i)), F.array(x["name"])))).alias("names"))
    columns = F.transform("cells", lambda c: F.transform(F.sequence(c["start"], c["start"] + c["cols"] - 1), lambda k: F.struct(k.alias("col"), c["text"].alias("text"), F.get("names", k).alias("name"))))
    body = body.join(own, ["page", "in_table"], "left").select("page", "in_table", "row", F.flatten(columns).alias("values"))
    plain = lambda v: F.when(F.size("values") == 2, "Value").otherwise(F.concat(F.lit("Column "), (v["col"] + 1).cast("string")))
    named = F.filter("values", lambda v: (v["col"] > 0) & (v["text"] != ""))
    label = F.get(F.filter("values", lambda v: v["text"] != ""), F.lit(0))["text"]
    said = F.array_join(F.transform(named, lambda v: F.concat(F.coalesce(v["name"], plain(v)), F.lit(": "), v["text"])), ". ")
    return body.select("page", "in_table", "row", F.concat(F.lit("Row: "), label, F.lit(". "), said, F.lit(".")).alias("text"))


def table_rows(elements: DataFrame, found: DataFrame, most_rows: int | None = MOST_ROWS) -> DataFrame:
    """Of elements (with in_main) and events: source_id, page, at (where the table ends), head_at (where it begins), row, text, in_main,
    saw_main. Cells are settled: events are sorted for them once. From then on they are dealt out by table, once."""
    cells = settled(table_cells(found))
    headed = with_header(cells.where("cell > 0").repartition("page", "in_table"))
    rows = row_sentences(headed, column_names(placed_header(headed)), most_rows)
    captions = cells.where("cell = 0 AND text != ''").select("page", "in_table", F.col("text").alias("caption"))
    tables = elements.where("kind = 'table'").select("page", "in_table", "source_id", F.col("upto").alias("at"), "in_main", "saw_main")
    whole = rows.join(captions, ["page", "in_table"], "left").join(tables, ["page", "in_table"])
    return whole.select("source_id", "page", "at", F.col("in_table").alias("head_at"), "row", F.concat(F.coalesce(F.concat(F.lit("Table: "), "caption", F.lit(". ")), F.lit("")), "text").alias("text"), "in_main", "saw_main")


# -- blocks ---------------------------------------------------------------------------------------------------------------


def blocks_of(found: DataFrame, most_rows: int | None = MOST_ROWS) -> DataFrame:
    """Blocks of events: those of <main> where a page has one, in the order in which they end, under the heading that ended last
    before them (before it began, for a table)."""
    own = _in_main(found)
    is_heading = F.col("tag").isin(*HEADINGS)
    elements = text_elements(own, found).where(~F.col("tag").isin(*CONTAINERS) | (F.col("leaf") & _is_prose(F.col("text"))))
    elements = elements.select("source_id", "page", "at", F.col("at").alias("head_at"), F.lit(0).alias("row"), "text", "in_main", "saw_main", F.when(is_heading, F.col("text")).alias("own_heading"))
    both = elements.unionByName(table_rows(own, found, most_rows).withColumn("own_heading", F.lit(None).cast("string")))
    before = Window.partitionBy("page").orderBy("head_at", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    headed = both.withColumn("heading", F.last("own_heading", ignorenulls=True).over(before)).where(F.col("own_heading").isNull() & (F.col("in_main") | ~F.col("saw_main")))
    k = F.row_number().over(Window.partitionBy("page").orderBy("at", "row"))
    numbered = headed.withColumn("k", k)
    return numbered.select("source_id", F.col("k").alias("block_ord"), F.concat("source_id", F.lit("-block-"), "k").alias("block_id"), "text", "heading", F.lit(None).cast("int").alias("page"), F.concat(F.lit("html-block-"), "k").alias("span"))


def html_blocks(pages: DataFrame, id_col: str = "source_id", html_col: str = "html", most_rows: int | None = MOST_ROWS, bare: bool = True) -> DataFrame:
    """source_id, block_ord, block_id, text, heading, page, span of every page; pages without text give no rows. most_rows: of a
    table, None for all; bare: see lexed."""
    return blocks_of(events(pages, id_col, html_col, bare), most_rows)


def extraction_status(sources: DataFrame, blocks: DataFrame) -> DataFrame:
    """sources (source_id, source_kind) with how many blocks were read and what that means."""
    n = blocks.groupBy("source_id").agg(F.count("*").alias("n_blocks"))
    none = F.coalesce("n_blocks", F.lit(0)) == 0
    out = sources.join(n, "source_id", "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(0)))
    return out.withColumn("extraction_status", F.when(~none, "extracted").when(F.col("source_kind") == "text_pdf", "ocr_required").otherwise("extraction_failed"))
