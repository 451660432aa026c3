"""Merges, stores, file formats, page metadata and classifiers against plain Python and fixed cases."""

import datetime
import gzip
import io
import json
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from siftwood import sources
from siftwood.functions import dates, pages, signals, urls
from siftwood.functions import text as X
from siftwood.operators import html, merge, metadata, order, rank, retrieval, store
from siftwood.sources import formats

NOW = "2024-02-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def test_numbered_within_splits_large_keys(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot"] * 8 + ["a", None]), rng.randint(1, 9)) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, key string, size long").repartition(6)
    got = {r["id"]: (r["place"], r["held"]) for r in order.numbered_within(df, "key", [F.col("id").desc()], "place", {"held": "size"}).collect()}
    seen, held = {}, {}
    for i, k, n in sorted(rows, reverse=True):
        seen[k], held[k] = seen.get(k, 0) + 1, held.get(k, 0) + n
        assert got[i] == (seen[k], held[k])
    assert [r["position"] for r in order.numbered(df, [F.col("id").asc()]).orderBy("id").collect()] == [*range(1, 801)]
    assert order.numbered(df.limit(0), [F.col("id").asc()]).count() == 0


def test_survivors_are_the_greedy_ones(spark):
    rng = random.Random(4)
    links = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(70)}
    kept: dict[int, int] = {}
    for i in range(60):
        first = [j for j in range(i) if kept.get(j) == j and (j, i) in links]
        kept[i] = first[0] if first else i
    got = merge.survivors(spark.range(60).withColumnRenamed("id", "id"), spark.createDataFrame([(b, a) for a, b in links], "a long, b long"))
    assert {r["id"]: r["survivor"] for r in got.collect()} == kept


def test_menu_admits_a_copy_of_a_full_family(spark):
    rows = [(i, f"k{i}", "web") for i in range(12)] + [(12, "k11", "other"), (13, "k0", "other"), (14, "x", "other"), (15, "y", "other"), (16, "z", "other")]
    got = merge.bounded_menu(spark.createDataFrame(rows, "position long, url_key string, family string"), ("web",)).orderBy("place").collect()
    assert [r["position"] for r in got] == [*range(10), 12, 14, 15]


def test_union_keeps_the_order_of_providers(spark):
    a, b = spark.createDataFrame([(1, "x")], "position int, url string"), spark.createDataFrame([(1, 0.5)], "position int, score double")
    got = merge.union_in_order([("b", b), ("a", a)], "position").collect()
    assert [(r["provider"], r["provider_order"], r["url"], r["score"]) for r in got] == [("b", 0, None, 0.5), ("a", 1, "x", None)]


def test_skip_plan(spark):
    t = lambda hours: datetime.datetime(2024, 2, 1) - datetime.timedelta(hours=hours)
    records = [("a", "direct", "blocked", 3, t(1), ["me"]), ("b", "direct", "blocked", 2, t(1), ["me"]), ("c", "direct", "blocked", 5, t(7), ["me", "you"]), ("d", "tls", "timeout", 4, t(2), ["you"]), ("e", "headed", "wall:login", 9, t(1), ["me"]), ("f", "direct", "blocked", 3, t(1), ["me", "you"])]
    won = [("a", "render", t(5)), ("b", "render", t(5)), ("c", "render", t(5)), ("d", "render", t(5)), ("f", "direct", t(5))]
    got = store.skip_plan(spark.createDataFrame(records, "host string, tier string, kind string, streak int, last_fail timestamp, callers array<string>"), spark.createDataFrame(won, "host string, tier string, ts timestamp"), now(), "me")
    assert [(r["host"], r["tier"]) for r in got.collect()] == [("a", "direct")]


def test_promotion_moves_the_pointer(spark, tmp_path):
    folder = str(tmp_path)
    assert store.promoted(spark, spark.range(3), folder, "1").count() == 3
    assert store.promoted(spark, spark.range(5), folder, "2").count() == 5 == store.active(spark, folder).count()


def test_jobs_after_a_failure(spark):
    jobs = spark.createDataFrame([(1, "running", 0), (2, "running", 2)], "id long, state string, attempts int")
    got = {r["id"]: r for r in store.after_failure(jobs, now()).collect()}
    assert (got[1]["state"], got[1]["attempts"], got[1]["available"]) == ("pending", 1, datetime.datetime(2024, 2, 1, 0, 0, 2))
    assert (got[2]["state"], got[2]["available"]) == ("failed", None)


def test_pages_of_results(spark):
    got = store.page_of(spark.range(7), ["id"], 5, 5).collect()
    assert [r["id"] for r in got] == [5, 6] and {r["next_offset"] for r in got} == {None}
    assert {r["next_offset"] for r in store.page_of(spark.range(7), ["id"], 0, 5).collect()} == {5}


def test_upsert_keeps_what_is_there(spark, tmp_path):
    rows = lambda x: spark.createDataFrame(x, "k long, v string, ts long")
    path = f"{tmp_path}/t"
    first = sources.upsert(spark, path, rows([(1, "a", 1), (2, "b", 1)]), ["k"], [F.desc("ts")])
    first.write.parquet(path)
    got = {r["k"]: r["v"] for r in sources.upsert(spark, path, rows([(2, "c", 2), (3, "d", 2)]), ["k"], [F.desc("ts")]).collect()}
    assert got == {1: "a", 2: "c", 3: "d"}


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name.replace("__", "/"), data)
    return out.getvalue()


W = "http://w"
FILES = {
    "a.docx": zipped(**{"word__document.xml": f'<w:document xmlns:w="{W}"><w:body><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:p><w:r><w:t>three</w:t></w:r></w:p></w:body></w:document>'}),
    "a.pptx": zipped(**{"ppt__presentation.xml": "<p/>", "ppt__slides__slide2.xml": f'<a:x xmlns:a="{W}"><a:p><a:t>second</a:t></a:p></a:x>', "ppt__slides__slide1.xml": f'<a:x xmlns:a="{W}"><a:p><a:t>first</a:t></a:p></a:x>'}),
    "a.xlsx": zipped(**{"xl__workbook.xml": "<w/>", "xl__sharedStrings.xml": "<sst><si><t>name</t></si></sst>", "xl__worksheets__sheet1.xml": '<x><row><c t="s"><v>0</v></c><c><v>7</v></c><c><f>A1+1</f></c></row></x>'}),
    "a.odt": zipped(**{"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": '<o:x xmlns:o="http://o"><o:h>Title</o:h><o:p>Body <o:s>text</o:s></o:p></o:x>'}),
    "a.epub": zipped(**{"mimetype": "application/epub+zip", "OPS__c.opf": '<package><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/><itemref idref="b"/><itemref idref="a"/></package>', "OPS__a.xhtml": "<html><p>later</p></html>", "OPS__b.xhtml": "<html><h1>sooner</h1></html>"}),
    "a.zip": zipped(**{"in__x.csv": "a;b\n1;2\n", "y.txt": "plain"}),
    "a.csv": "näme,n|o\n\"x, y\",2\n".encode("cp1252"),
    "a.json": b'{"b": [1, 2]}',
    "a.jsonl": b'{"a": 1}\n\n{"a": 2}\n',
    "a.xml": b"<r><a>x</a> <b>y</b></r>",
    "a.eml": b"From: a@b.c\nSubject: Hi\nContent-Type: text/plain; charset=utf-8\n\nHello there\n",
    "a.rtf": rb"{\rtf1{\fonttbl{\f0 Arial;}}\f0 Hello \'e9t\'e9\par next}",
    "a.txt.gz": gzip.compress(b"packed"),
    "a.pdf": b"%PDF-1.4 x",
    "bad.zip": b"PK\x03\x04broken",
}
TEXTS = {
    "a.docx": ("docx", "One two\nthree"),
    "a.pptx": ("pptx", "## Slide 1\nfirst\n## Slide 2\nsecond"),
    "a.xlsx": ("xlsx", "## sheet1\n| name | 7 | =A1+1 |"),
    "a.odt": ("odf", "Title\nBody text"),
    "a.epub": ("epub", "sooner\nlater"),
    "a.zip": ("zip", "# in/x.csv\n| a | b |\n| 1 | 2 |\n# y.txt\nplain"),
    "a.csv": ("csv", "| näme | n&#124;o |\n| x, y | 2 |"),
    "a.json": ("json", json.dumps({"b": [1, 2]}, indent=1)),
    "a.jsonl": ("jsonl", '{"a": 1}\n{"a": 2}'),
    "a.xml": ("xml", "x y"),
    "a.eml": ("eml", "From: a@b.c\nSubject: Hi\n\nHello there"),
    "a.rtf": ("rtf", "Hello été\nnext"),
    "a.txt.gz": ("gzip", "packed"),
    "a.pdf": ("pdf", ""),
}


def test_readers(spark, tmp_path):
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w") as t:
        info = tarfile.TarInfo("m.txt")
        info.size = 4
        t.addfile(info, io.BytesIO(b"tape"))
    for name, data in {**FILES, "a.tar": tar.getvalue()}.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[-1]: r for r in formats.read_files(spark, str(tmp_path)).collect()}
    for name, (kind, text) in {**TEXTS, "a.tar": ("tar", "# m.txt\ntape")}.items():
        assert (got[name]["kind"], got[name]["text"], got[name]["error"]) == (kind, text, None), name
    assert got["bad.zip"]["error"] and got["bad.zip"]["text"] == ""


def test_kinds_in_columns_are_the_readers(spark):
    rows = [(name, bytearray(data)) for name, data in FILES.items()] + [("x.html", bytearray(b"<!DOCTYPE html><p>")), ("x.vtt", bytearray(b"WEBVTT\n")), ("x.png", bytearray(b"\x89PNG\r\n")), ("x", bytearray(b""))]
    got = spark.createDataFrame(rows, "name string, data binary").select("name", formats.kind_of(F.col("data"), F.col("name"), F.lit(None).cast("string")).alias("k")).collect()
    for r, (name, data) in zip(got, rows, strict=True):
        assert r["k"] == formats.sniffed(bytes(data), name, ""), name


@pytest.mark.parametrize(("data", "kind", "text"), [(b"\xef\xbb\xbfa", "", "a"), ("é".encode("latin-1"), "text/html; charset=iso-8859-1", "é"), ('<meta charset="cp1252">€'.encode("cp1252"), "", '<meta charset="cp1252">€'), (b"\x93x\x94", "", "“x”"), ("日本".encode("utf-16"), "", "日本"), (b"a", "text/html; charset=nonsense", "a")])
def test_decoded(data, kind, text):
    assert formats.decoded(data, kind) == text


def test_page_metadata():
    page = """<html><head><meta name="description" content="A description of some length"><meta property="og:description" content="a description of some LENGTH">
    <meta name="citation_doi" content="10.1/x"><meta property="article:published_time" content="2024-01-02"><meta property="og:type" content="article"><link rel="canonical" href="/c">
    <script type="application/ld+json">{"@graph": [{"@type": ["Product", "Thing"], "sku": 7, "isbn": {"value": "9"}, "dateModified": "2024-02-03"}], "@type": "WebPage", "description": "another description, also long"}</script>
    <script type="application/ld+json">{broken</script></head><body><span itemprop="mpn">m 1</span><time itemprop="dateModified" datetime="2024-01-05">x</time></body></html>"""
    found = metadata.page_metadata(page)
    assert found["descriptions"] == ["a description of some LENGTH", "another description, also long"]
    assert found["types"] == ["WebPage", "Product", "Thing", "article"]
    assert dict(found["identifiers"]) == {"doi": "10.1/x", "mpn": "m 1", "sku": "7", "isbn": "9"}
    assert (found["published"], found["modified"], found["canonical"]) == ("2024-01-02", "2024-01-05", "/c")
    assert metadata.page_metadata(None)["types"] == []


def test_links_of_pages_and_sitemaps(spark):
    rows = [(1, "https://a.b/c/d", '<a href="e">x</a><a href="/f">y</a><a href="mailto:x@y">z</a>'), (2, "https://a.b/s.xml", "<urlset><url><loc> https://a.b/1 </loc></url><url><loc>https://a.b/2</loc></url></urlset>"), (3, "https://a.b", None)]
    got = metadata.linked(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [(r["page_id"], r["place"], r["href"]) for r in sorted(got, key=lambda r: r[:2])] == [(1, 0, "https://a.b/c/e"), (1, 1, "https://a.b/f"), (2, 0, "https://a.b/1"), (2, 1, "https://a.b/2")]
    assert metadata.declared(spark.createDataFrame(rows, "page_id long, url string, html string")).count() == 3


def test_chunks_cover_the_text():
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice(["word ", "longer-word ", "\n", "\n\n", "# Title\n", "## Page 3\n", "x" * 40, "line of text\n"]) for _ in range(rng.randint(0, 120)))
        runs = html.chunk_text(text, 100)
        assert "".join(r[2] for r in runs) == text and all(text[a:b] == t and 0 < b - a <= 100 for a, b, t, _ in runs)
        heading = ""
        for a, _, t, found in runs:
            own = html.HEADING.match(t.split("\n", 1)[0])
            assert found == (own[1].strip() if own else heading)
            titles = [m[1].strip() for m in (html.HEADING.match(x) for x in t.split("\n")) if m]
            heading = titles[-1] if titles else heading
    assert [r[2] for r in html.chunk_text("a\n## Page 1\nb\n## Page 2\nc")] == ["a\n", "## Page 1\nb\n", "## Page 2\nc"]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("title", "text", "kind"),
    [("Sign in", "your password", "login"), ("Log in to a very long page title that says a great deal more than sixty characters", "password", ""), ("News", "Available to subscribers. Subscribe now", "paywall"), ("Subscribe to continue", "subscribe", "paywall"), ("403 Forbidden", "", "access_denied"), ("Maintenance", "temporarily unavailable", "maintenance"), ("Maintenance of bikes", "oil the chain", ""), (None, None, "")],
)
def test_gates(spark, title, text, kind):
    assert one(spark, signals.gate_kind(F.lit(title).cast("string"), F.lit(text).cast("string"))) == kind


@pytest.mark.parametrize(("url", "kind"), [("https://github.com/a/b", "repo"), ("https://x.arxiv.org/1", "paper"), ("https://old.reddit.com/r", "forum"), ("https://fr.wikipedia.org/", "reference"), ("https://a.test/news/1", "news"), ("https://blog.a.test/", "blog"), ("https://docs.a.test/", "docs"), ("https://notgithub.com/", "other"), ("nonsense", "other")])
def test_source_types(spark, url, kind):
    assert one(spark, signals.source_type(F.lit(url))) == kind


@pytest.mark.parametrize(("said", "want"), [("Fri, 05 Jan 2024 10:00:00 +0200", "2024-01-05 08:00:00"), ("05 Jan 2024 10:00 EST", "2024-01-05 15:00:00"), ("2024-01-05T10:00:00.5Z", "2024-01-05 10:00:00"), ("2024-01-05 10:00:00-01:30", "2024-01-05 11:30:00"), ("2024-01-05", "2024-01-05 00:00:00"), ("seen on January 7, 2024", "2024-01-07 00:00:00"), ("2024-13-45", None), ("", None), (None, None)])
def test_dates(spark, said, want):
    got = one(spark, dates.parse_date(F.lit(said).cast("string")))
    assert got == (datetime.datetime.fromisoformat(want) if want else None)


def test_page_dates(spark):
    assert one(spark, dates.page_date(F.lit("2024-01-01"), F.lit("2010-03-14"), F.lit("x"))) == "2024-01-01"
    assert one(spark, dates.page_date(F.lit(""), F.lit("2010-03-14"), F.lit("series 3.14"))) == ""
    assert one(spark, dates.page_date(F.lit(""), F.lit("2010-03-14"), F.lit("in 2010"))) == "2010-03-14"


@pytest.mark.parametrize(("url", "ok"), [("https://a.test/x", True), ("https://a.test:8080/", False), ("ftp://a.test/", False), ("https://u:p@a.test/", False), ("http://127.0.0.1/", False), ("http://172.20.1.1/", False), ("http://8.8.8.8/", True), ("https://printer.local/", False), ("https://a.test/#x", False)])
def test_public_targets(spark, url, ok):
    assert one(spark, urls.is_public(F.lit(url))) is ok


def test_question_helpers(spark):
    assert one(spark, X.expanded(F.lit("how to install spark"))) == ["how to install spark", "how to install spark step by step guide"]
    assert one(spark, X.expanded(F.lit("the"))) == ["the"] and one(spark, X.expanded(F.lit(" "))) == []
    got = one(spark, X.anchors(F.lit("Where is the red harbour bridge"), F.lit("A red bridge")))
    assert (got["matched_count"], got["matched"], got["unmatched"]) == (2, ["bridge", "red"], ["harbour"])
    assert one(spark, pages.fragment_text(F.lit("<p>a<br>b</p><ul><li>c &amp; d</li></ul><pre>x <b>y</b></pre>"))).startswith("a\nb\n- c & d")
    assert one(spark, pages.is_static(F.lit("<html><p>plain text here</p></html>"), F.lit(15))) and not one(spark, pages.is_static(F.lit('<div id="root"></div>'), F.lit(500)))


def test_every_row_has_a_rank(spark):
    docs = spark.createDataFrame([(1, "apple"), (2, "pear"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in rank.rank_rows(docs, spark.createDataFrame([(0, "apple apple")], "query_id long, text string")).collect()}
    assert set(got) == {1, 2, 3} and got[1] > 0 == got[2] == got[3]


def test_evidence_windows_read_the_text_once(spark):
    text = "".join(random.Random(2).choice(["red ", "blue ", "plain words "]) for _ in range(900))
    got = one(spark, retrieval.evidence_windows(F.lit(text), F.array(F.lit("red"), F.lit("blue"))))
    scored = sorted((-sum(t in text[a : a + 600].lower() for t in ("red", "blue")), a) for a in range(0, len(text), 450))
    want = []
    for minus, a in scored:
        if minus < 0 and len(want) < 3 and all(abs(a - b) >= 600 for b, _ in want):
            want.append((a, -minus))
    assert [(r["offset"], r["matches"]) for r in got] == want


def test_feeds(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<rss><channel><item><title>old</title><link>l1</link><pubDate>Fri, 05 Jan 2024 10:00:00 GMT</pubDate></item><item><title>none</title><link>l2</link></item></channel></rss>')
    (tmp_path / "b.xml").write_text('<feed><entry><title>new</title><link href="l3"/><updated>2024-01-06T00:00:00Z</updated></entry></feed>')
    assert [(r["title"], r["link"]) for r in sources.feed(spark, str(tmp_path)).collect()] == [("new", "l3"), ("old", "l1"), ("none", "l2")]
