"""Column functions and rules against cases written by hand."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from sievework.functions import text, urls
from sievework.operators import catalog, classify


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "folded"), [("  A  b\n", "a b"), ("Straße", "strasse"), ("ΣΟΦΟΣ", "σοφοσ"), ("", "")])
def test_fold(spark, raw, folded):
    assert one(spark, text.fold(F.lit(raw))) == folded


def test_slugs_and_titles(spark):
    assert one(spark, text.slugify(F.lit("--Law & Groß Ö 2"))) == "law-and-gross-2"
    assert one(spark, text.normal_title(F.lit(" A&B/C :"))) == "a b c "


@pytest.mark.parametrize(
    ("raw", "title", "day", "invalid"),
    [
        ("[03.02.2021]  Study", "Study", dt.date(2021, 2, 3), False),
        ("Study (Published at 03/02/2021) ", "Study", dt.date(2021, 2, 3), False),
        ("Studie (VERÖFFENTLICHT am 03.02.2021)", "Studie", dt.date(2021, 2, 3), False),
        ("[32/01/2021] Study", "Study", None, True),
        ("Study (2021)", "Study (2021)", None, False),
        ("[01.01.2020] Study (published on 02.02.2022)", "Study (published on 02.02.2022)", dt.date(2020, 1, 1), False),
    ],
)
def test_publication(spark, raw, title, day, invalid):
    got = one(spark, text.publication(F.lit(raw)))
    assert (got["title"], got["published_at"], got["invalid"]) == (title, day, invalid)


@pytest.mark.parametrize(("days", "kind", "band"), [(0, "current", "lt3"), (2, "current", "lt3"), (3, "current", "lt30"), (59, "current", "lt60"), (179, "current", "lt180"), (180, "current", "gt180"), (181, "old", "gt180")])
def test_ages(spark, days, kind, band):
    today = dt.date(2024, 7, 1)
    published = F.lit(today - dt.timedelta(days))
    assert one(spark, text.freshness(published, F.lit(today))) == kind
    assert one(spark, text.age_band(published, F.lit(None), F.lit(today))) == band
    assert one(spark, text.freshness(F.lit(None).cast("date"), F.lit(today))) == "undated"
    assert one(spark, text.age_band(F.lit(None).cast("date"), F.lit(dt.datetime(2024, 6, 30)), F.lit(today))) == "lt3"
    assert one(spark, text.in_age_band(F.lit(band), "gt180")) == (band == "gt180")


def test_keys(spark):
    want = hashlib.sha256(b"s|u|a title").hexdigest()
    assert one(spark, text.stable_key(F.lit("s"), F.lit("u"), F.lit(" A  Title"))) == want[:32]
    assert one(spark, text.reference_code(F.lit("ps"), F.lit(1000))) == "ps-1000" and one(spark, text.reference_code(F.lit("ps"), F.lit(7))) == "ps-007"


@pytest.mark.parametrize(
    ("header", "url", "want"),
    [("Text/HTML; charset=x", "u", "text/html"), ("", "https://a/b.PDF?x", "application/pdf"), (None, "https://a/b/", "text/html"), ("application/octet-stream", "https://a/b.htm", "text/html"), ("", "https://a/b.zip", "")],
)
def test_media_type(spark, header, url, want):
    assert one(spark, urls.media_type(F.lit(header).cast("string"), F.lit(url))) == want


def test_urls(spark):
    url = F.lit("https://user@A.example:8080/p/x.pdf;v=1?q#f")
    assert [one(spark, f(url)) for f in (urls.host_of, urls.origin_of, urls.path_of, urls.is_pdf_url)] == ["a.example", "https://user@A.example:8080", "/p/x.pdf", True]
    assert one(spark, urls.is_pdf_url(F.lit("https://a/x?y=.pdf"))) is False
    rows = spark.createDataFrame([("https://a.example/b/c", "../d"), ("https://a.example/b/", "?x"), (None, "e"), ("https://a", None), ("https://a", "http://[bad")], "base string, link string")
    assert [r[0] for r in rows.select(urls.resolve("base", "link")).collect()] == ["https://a.example/d", "https://a.example/b/?x", "e", None, "http://[bad"]


def test_classification_takes_the_first_rule_that_applies(spark):
    rule = {k: list(classify.DEFAULTS[k]) for k in ("active_markers", "archive_markers", "excluded_markers")} | {"source_implies_active_type": False, "opportunity_type": "project_study"}
    cases = [("A Project\n Study", False, (True, True)), ("project study, completed", False, (False, True)), ("project study and Internship", False, (False, True)), ("something", False, (False, False)), ("project study", True, (False, True))]
    rows = spark.createDataFrame([(t, a, *rule.values()) for t, a, _ in cases], ["text", "in_archive", *rule])
    got = classify.classify(rows, "text", F.col("in_archive")).collect()
    assert [(r["classification"]["accepted"], r["classification"]["certain"]) for r in got] == [w for *_, w in cases]
    implied = rows.withColumn("source_implies_active_type", F.lit(True)).where("text = 'something'")
    assert classify.classify(implied, "text").first()["classification"]["reason"] == "explicit project_study marker"


def test_page_bounds(spark):
    rows = spark.createDataFrame([("a", "T")], "slug string, title string")
    with pytest.raises(ValueError):
        catalog.page(rows, "title", 0)
    with pytest.raises(ValueError):
        catalog.page(rows, "title", 1, 101)
    assert [catalog.clamped_page(n, 41, 20) for n in (1, 3, 9)] == [1, 3, 3] and catalog.clamped_page(4, 0, 20) == 1
