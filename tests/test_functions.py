"""Golden cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from siftwood.functions import dates, signals, urls
from siftwood.functions import text as X


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], [*values]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("https://www.x.org/a/?utm_source=f", "http://x.org/a"),
        ("https://x.org/a/index.html", "https://x.org/a"),
        ("https://x.org:443/a?b=2&a=1", "http://x.org/a?a=1&b=2"),
        ("https://m.x.org/a/amp", "https://x.org/a"),
        ("https://www.m.x.org/", "https://x.org"),
        ("https://x.org/a?reference=1", "https://x.org/a"),
    ],
)
def test_same_page(spark, a, b):
    assert one(spark, urls.url_key(F.col("u")), u=a) == one(spark, urls.url_key(F.col("u")), u=b)


@pytest.mark.parametrize(("a", "b"), [("https://x.org/a", "https://x.org/b"), ("https://x.org:8080/a", "https://x.org/a"), ("https://x.org/a?id=1", "https://x.org/a?id=2"), ("https://blog.x.org/a", "https://x.org/a")])
def test_different_pages(spark, a, b):
    assert one(spark, urls.url_key(F.col("u")), u=a) != one(spark, urls.url_key(F.col("u")), u=b)


@pytest.mark.parametrize("value", ["", "not a url", "mailto:a@b.c"])
def test_rubbish_stays(spark, value):
    assert one(spark, urls.url_key(F.col("u")), u=value) == value


def test_site(spark):
    assert one(spark, urls.site(F.col("h")), h="news.bbc.co.uk") == "bbc.co.uk"
    assert one(spark, urls.site(F.col("h")), h="a.b.example.com") == "example.com"
    assert one(spark, urls.site(F.col("h")), h="localhost") == "localhost"
    assert one(spark, urls.site(F.col("h")), h="") == ""


@pytest.mark.parametrize(("url", "kind"), [("https://github.com/a/b", "repo"), ("https://arxiv.org/abs/1", "paper"), ("https://x.org/news/1", "news"), ("https://docs.x.org/", "docs"), ("https://blog.x.org/", "blog"), ("https://x.org/", "other"), ("", "other")])
def test_source_type(spark, url, kind):
    assert one(spark, signals.source_type(F.col("u")), u=url) == kind


def test_token_estimate(spark):
    assert one(spark, X.token_estimate(F.col("t")), t="") == 0
    assert one(spark, X.token_estimate(F.col("t")), t="ab") == 1
    assert one(spark, X.token_estimate(F.col("t")), t="abcdefghij") == 2
    assert one(spark, X.token_estimate(F.col("t")), t="漢字ab") == 3


def test_smart_truncate(spark):
    text = "One sentence here. Another sentence follows it, and more."
    assert one(spark, X.smart_truncate(F.col("t"), 100), t=text) == text
    cut = one(spark, X.smart_truncate(F.col("t"), 30), t=text)
    assert cut.endswith(" …") and len(cut) <= 30 and text.startswith(cut[:-2])


def test_digest(spark):
    assert one(spark, X.digest(F.col("t")), t="Hello,  World!") == one(spark, X.digest(F.col("t")), t="hello world")
    assert one(spark, X.digest(F.col("t")), t="?!") == ""


def test_dates(spark):
    now = F.lit("2024-02-01 12:00:00").cast("timestamp")
    assert str(one(spark, dates.first_date(F.col("t")), t="it was 3 March 2024 then")) == "2024-03-03"
    assert one(spark, dates.first_date(F.col("t")), t="no date") is None
    assert str(one(spark, dates.relative_date(F.col("t"), now), t="2 weeks ago, x")) == "2024-01-18"
    assert one(spark, dates.relative_date(F.col("t"), now), t="x 2 weeks ago") is None
    assert one(spark, dates.recency(F.lit(2.0), F.col("a"), 0.5), a=21) == pytest.approx(1.5)
    assert one(spark, dates.recency(F.lit(2.0), F.lit(None).cast("int"), 0.9), a=1) == 2.0


def test_gates(spark):
    kind = signals.gate_kind(F.col("a"), F.col("b"))
    assert one(spark, kind, a="Log in", b="enter your password") == "login"
    assert one(spark, kind, a="Log in to better sleep", b="prose") == ""
    assert one(spark, kind, a="403 Forbidden", b="") == "access_denied"


def test_csv_cell(spark):
    assert one(spark, X.csv_cell(F.col("t")), t="=1+1") == "'=1+1"
    assert one(spark, X.csv_cell(F.col("t")), t="plain") == "plain"
