"""Titles of result lists, held against their SQL."""

import duckdb
import pytest

from siftwood.plans import evidence

HTML = [
    "<title>a &amp b &amp</title>",
    "<title>a &amp; b &amp;lt; &lt;i&gt; &quot;q&quot; &#39; &copy; &copy</title>",
    "<title lang='x'>\n two\t\tlines\x0b\x0b  </title><title>second</title>",
    "<title>\u2003\xa0 wide\u3000 spaces \u3000 </title>",
    "<TITLE>upper</TITLE>",
    "<title>open",
    "<title></title>",
    "no title",
    "",
    None,
]


@pytest.mark.parametrize("name", ["page_title", "recovered_destinations"])
def test_titles_are_those_of_the_sql(spark, tmp_path, name):
    five = ["<title>one two three four five &amp six</title>", "<title>one two three four five &amp six seven</title>"]
    rows = [(i, f"https://h{i // 2}.example/p{i}", x) for i, x in enumerate(HTML + five + [None])]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.execute(evidence.ORACLES[name]).fetchall(), key=str)
    assert sorted(map(tuple, evidence.QUERIES[name](spark, str(tmp_path)).collect()), key=str) == want and want
