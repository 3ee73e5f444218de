import duckdb
import pytest
from pyspark.sql import functions as F

from provenlake.functions import anchors, periods, text
from provenlake.plans import queries


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("Growth was 3.5 percent. Then it fell! Why?", ["Growth was 3.5 percent.", "Then it fell!", "Why?"]),
        ("Dr. Smith works at Acme Inc. now. Yes.", ["Dr. Smith works at Acme Inc. now.", "Yes."]),
        ("They run programs. Next one.", ["They run programs.", "Next one."]),
        ("The U.S. economy grew. It did.", ["The U.S. economy grew.", "It did."]),
        ("", []),
        ("   ", []),
        (None, None),
    ],
)
def test_sentences(spark, value, expected):
    assert one(spark, text.sentences, value) == expected


def test_cited_sentences_keep_markers_and_urls(spark):
    assert one(spark, lambda c: text.sentences(c, cited=True), "Sales rose.[1] See https://a.example.org/x.html for it. End.") == ["Sales rose[1].", "See https://a.example.org/x.html for it.", "End."]


def test_tokens_markers_and_words(spark):
    assert one(spark, text.tokens, "The Net-Sales of AT&T and the net-sales") == ["at&t", "net-sales"]
    assert one(spark, text.markers, "a [1][22] b") == ["1", "22"]
    assert one(spark, text.strip_markers, "It rose [1] , then [2].") == "It rose, then."
    assert one(spark, text.word_count, " a b  c ") == 3


@pytest.mark.parametrize(
    ("value", "numbers", "units"),
    [
        ("147 thousand jobs", ["147000"], ["147000:job"]),
        ("147,000 jobs", ["147000"], ["147000:job"]),
        ("It was $5.50 million", ["5500000"], ["5500000:currency"]),
        ("EUR 12", ["12"], ["12:currency", "12:currency:eur"]),
        ("up 25 basis points", ["25"], ["25:basis_point"]),
        ("in May 2026", [], []),
        ("2026 stores", ["2026"], []),
        ("in 2026.5", ["2026.5"], []),
        ("from 2025 to 2026", [], []),
        ("Q3 2025 and FY2025", [], []),
    ],
)
def test_numbers(spark, value, numbers, units):
    assert one(spark, lambda c: anchors.numbers(anchors.number_records(c)), value) == numbers
    assert one(spark, lambda c: anchors.number_units(anchors.number_records(c)), value) == units


@pytest.mark.parametrize(
    ("value", "tags"),
    [
        ("May 3, 2026", ["month:2026-may", "year:2026"]),
        ("Q3 2025", ["quarter:calendar:3:2025", "year:2025"]),
        ("third quarter of fiscal year 2025", ["fiscal_year:2025", "quarter:fiscal:3:2025", "year:2025"]),
        ("Q3 fiscal 2026", ["quarter:unspecified:3", "year:2026"]),
        ("FY2025", ["fiscal_year:2025"]),
    ],
)
def test_dates(spark, value, tags):
    assert one(spark, anchors.dates, value) == tags


@pytest.mark.parametrize(
    ("claim", "candidate", "expected"),
    [
        (["quarter:calendar:2:2026"], ["month:2026-may"], ["month:2026-may"]),
        (["month:2026-may"], ["quarter:calendar:2:2026"], ["quarter:calendar:2:2026"]),
        (["fiscal_year:2025"], ["quarter:fiscal:3:2025"], ["quarter:fiscal:3:2025"]),
        (["month:2026-may", "year:2026"], ["month:2026-june", "year:2026"], ["year:2026"]),
        (["year:2025"], ["year:2026"], []),
        ([], ["year:2026"], []),
    ],
)
def test_period_relations(spark, claim, candidate, expected):
    df = spark.createDataFrame([(claim, candidate)], "a array<string>, b array<string>")
    assert df.select(periods.matching_dates(F.col("a"), F.col("b")).alias("x")).first()["x"] == expected


def test_metrics_and_phrases(spark):
    assert one(spark, anchors.metrics, "Net sales and EBITDA") == ["ebit", "ebitda", "net_sales", "sales"]
    phrases = one(spark, anchors.metric_phrases, "the store renewal rate")
    assert "store renewal rate" in phrases and "renewal rate" in phrases and all(not p.startswith("the ") for p in phrases)
    assert one(spark, anchors.entities, "Acme Corp met May and Beta") == ["acme corp", "beta"]


def test_every_full_stop_of_a_url_is_kept(spark):
    said = "See https://a.b.c.d.e.f.g.H/x.I and http://q.r.S.T/u.V. Then A.B.C. done. Mr. Co. No. e.g. Fine."
    df = spark.createDataFrame([(said,)], "t string")
    got = df.select(text.sentences(F.col("t"), cited=True).alias("s")).first().s
    assert got[0] == "See https://a.b.c.d.e.f.g.H/x.I and http://q.r.S.T/u.V." and len(got) == 3


def test_document_anchors_counts_the_numbers_of_its_sql(spark, tmp_path):
    """Its SQL reads a number's left neighbour with it; the function itself, without with_left, looks behind as the reference does."""
    said = [
        "Call 555-4081 190.137.223.204 now", "4451718024887799 27.65.93.188 end", "5 7 9", "x$5 and $$6, US$7 million USD 8%", "$5 CAD", " 12 people",
        "1,234.5 million (3) 4bn EUR", "in 2024 5 rose", "", "none", None, "v1.2 and .5 and 6.", "10 % 20 %", "3-4/5",
    ]
    spark.createDataFrame(list(enumerate(said)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["document_anchors"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet' WHERE text IS NOT NULL")
    want = {r[0]: r for r in con.execute(queries.ORACLE_SQL["document_anchors"]).fetchall()}
    assert {k: v for k, v in got.items() if said[k] is not None} == want and len(got) == len(said)
    assert want[0][1] == 2 and one(spark, lambda c: anchors.numbers(anchors.number_records(c)), said[0]) == ["190.137", "4081", "555"]
