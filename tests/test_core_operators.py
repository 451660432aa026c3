"""Operators against plain Python, and streams against batches."""

import math
import random

from pyspark.sql import functions as F

from siftwood import sources
from siftwood.operators import dedupe, html, menu, rank, state
from siftwood.plans import catalogue


def test_collapse_keeps_the_first_and_lists_eight(spark):
    rows = spark.createDataFrame([("k", i, f"u{i}") for i in range(200)] + [("l", 500, "v")], "key string, position int, url string")
    out = {r["key"]: r for r in dedupe.collapse(rows, "key", "position", "url").collect()}
    assert out["k"]["position"] == 0 and out["k"]["copies"] == 200 and out["k"]["duplicates"] == [f"u{i}" for i in range(1, 9)]
    assert out["l"]["duplicates"] == [] and out["l"]["copies"] == 1


def test_near_pairs_are_all_pairs(spark):
    rng = random.Random(5)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 6) for _ in range(120)] for _ in range(6)]
    texts = []
    for words in base:
        texts.append(words)
        for n in (1, 4, 9):
            changed = list(words)
            for i in rng.sample(range(len(words)), n):
                changed[i] = f"w{rng.random()}"
            texts.append(changed)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    prints = dedupe.fingerprints(docs, "doc_id", "text")
    got = {(r["a"], r["b"]) for r in dedupe.near_pairs(prints).collect()}
    sets = {r["doc_id"]: set(r["s"]) for r in prints.collect()}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] != sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.65}
    assert got == want and want


def test_near_duplicates_name_every_copy(spark, tmp_path):
    rng = random.Random(8)
    one, two = ([f"w{rng.randrange(10**6)}" for _ in range(120)] for _ in range(2))
    near = [*one[:119], "changed"]
    texts = [one, two, one, near, near, *[two] * 30]
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = catalogue.QUERIES["near_duplicates_jaccard"](spark, str(tmp_path)).collect()
    copies = {(r["a"], r["b"]) for r in rows if r["likeness"] == 1}
    assert copies == {(0, 2), (3, 4)} | {(1, i) for i in range(5, 35)}
    assert [(r["a"], r["b"]) for r in rows if r["likeness"] < 1] == [(0, 3)] and len(rows) == 33


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "apple pear apple"), (2, "pear plum"), (3, "plum")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "apple pear pear")], "query_id long, text string")
    got = {r["doc_id"]: r["score"] for r in rank.bm25(docs, asked).collect()}

    def part(tf, df, n):
        return math.log(1 + (3 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / 2))

    assert got == {1: round(part(2, 1, 3) + 2 * part(1, 2, 3), 6), 2: round(2 * part(1, 2, 2), 6)}


def test_whole_texts_are_read(spark):
    rng = random.Random(4)
    start, one, two = ([f"w{rng.randrange(10**6)}" for _ in range(n)] for n in (700, 700, 700))
    texts = [start + one, start + two, ["few", "words"], ["few", "words"], [], None]
    docs = spark.createDataFrame([(i, None if t is None else " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    prints = dedupe.fingerprints(docs, "doc_id", "text")
    assert {r["doc_id"] for r in prints.collect()} == {0, 1, 2, 3}
    assert dedupe.near_pairs(prints).count() == 0
    assert {(r["doc_id"], r["id"]) for r in dedupe.shingle_representatives(prints).collect()} == {(0, 0), (1, 1), (2, 2), (3, 2)}
    asked = spark.createDataFrame([(7, one[-1])], "query_id long, text string")
    assert [r["doc_id"] for r in rank.bm25(docs, asked).collect()] == [0]
    assert rank.bm25(docs, asked, head=600).count() == 0


def test_moving_average_and_streaks(spark):
    rows = [(1, i, float(v)) for i, v in enumerate([3, 1, 4, 1, 5, 9])]
    events = spark.createDataFrame(rows, "k long, i long, value double")
    want = rows[0][2]
    for _, _, v in rows[1:]:
        want = 0.9 * want + 0.1 * v
    assert abs(state.moving_average(events, "k", ["i"], "value").first()["average"] - want) < 1e-12
    marked = state.streaks(events, "k", ["i"], F.col("value") > 2).orderBy("i").collect()
    assert [r["streak"] for r in marked] == [1, 0, 1, 0, 1, 2]


def test_caps_and_budget(spark):
    rows = spark.createDataFrame([("a", i, 10) for i in range(5)] + [("b", 9, 50)], "g string, i int, n int")
    assert menu.capped(rows, "g", ["i"], 2).count() == 3
    assert {(r["g"], r["i"]) for r in menu.within_budget(rows, ["g"], ["i"], "n", 30).collect()} == {("a", 0), ("a", 1), ("a", 2)}


def test_chunks_cover_the_text():
    rng = random.Random(1)
    for _ in range(50):
        text = "".join(rng.choice(["word ", "line\n", "para\n\n", "# Head\n", "x" * 40]) for _ in range(rng.randint(0, 300)))
        found = html.chunk_text(text)
        assert "".join(c[2] for c in found) == text
        assert all(text[a:b] == piece and 0 < len(piece) <= 900 for a, b, piece, _ in found)


def test_page(spark):
    page = html.read_page("<title>A &amp; B</title><nav><a href='/x'>x</a></nav><article><p>" + "word " * 200 + "<script>no()</script><p>end</article>")
    assert page["title"] == "A & B" and "no()" not in page["content"] and page["content"].endswith("end")
    assert page["links"] == [{"href": "/x", "text": "x"}] and page["content_status"] == "complete"
    assert html.read_page(None)["content_status"] == "unknown"


def test_sources(spark, tmp_path):
    (tmp_path / "m.txt").write_text("# c\nhttps://a.b/c,k1\n\nhttps://d.e\n")
    assert {(r["url"], r["item_key"]) for r in sources.manifest(spark, str(tmp_path / "m.txt")).collect()} == {("https://a.b/c", "k1"), ("https://d.e", None)}
    (tmp_path / "b.txt").write_text("||ads.example^\n! note\n||x.y^\n")
    assert {r["host"] for r in sources.blocklist(spark, str(tmp_path / "b.txt")).collect()} == {"ads.example", "x.y"}
    vtt = "WEBVTT\n\n1\n00:00:01.500 --> 00:00:03.000\nHello <b>you</b>\n\n01:02:03.000 --> 01:02:04.250\nmore\ntext"
    rows = sources.captions(spark.createDataFrame([(1, vtt)], "id long, t string"), "id", "t").orderBy("segment").collect()
    assert [(r["start_seconds"], r["end_seconds"], r["text"]) for r in rows] == [(1.5, 3.0, "Hello you"), (3723.0, 3724.25, "more text")]
    sources.write_csv(spark.createDataFrame([("=x", 1)], "a string, n int"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).first()["a"] == "'=x"
    new = spark.createDataFrame([(1, 2, "new"), (2, 1, "only")], "k long, at long, v string")
    spark.createDataFrame([(1, 1, "old"), (3, 1, "stays")], "k long, at long, v string").write.parquet(str(tmp_path / "t"))
    got = sources.upsert(spark, str(tmp_path / "t"), new, ["k"], [F.desc("at")])
    assert {(r["k"], r["v"]) for r in got.collect()} == {(1, "new"), (2, "only"), (3, "stays")}
