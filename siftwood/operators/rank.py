"""BM25, recency, rank fusion and preference bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwood.functions import text as X
from siftwood.session import checkpointed

K1, B, RRF = 1.5, 0.75, 60


def postings(docs: DataFrame, id_col: str, body: Column, wanted: DataFrame | None = None) -> DataFrame:
    """(doc_id, len, term, tf) of tokens longer than two characters, of the ``wanted``
    terms only if they are given, and a row with the empty term for each document."""
    own = docs.select(F.col(id_col).alias("doc_id"), X.tokens(body).alias("w"))
    # outer, so that Spark doesn't cut the text again to look for empty ones
    rows = own.select("doc_id", F.size("w").alias("len"), F.explode_outer(F.concat(F.array(F.lit("")), F.filter("w", lambda t: F.length(t) > 2))).alias("term"))
    if wanted is not None:
        mark = wanted.sparkSession.createDataFrame([("",)], "term string")
        rows = rows.join(wanted.select("term").distinct().union(mark), "term", "left_semi")
    return rows.groupBy("doc_id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int | None = None) -> DataFrame:
    """(query_id, doc_id, score) of the documents that share a term with a query.

    ``queries`` has query_id and text; a term that a query repeats counts as
    often. The texts are cut into words once: the postings of the queries' terms
    and a mark for each document, from which all counts come, are written and
    joined with the queries. Whole texts are scored, or their first ``head`` characters.
    """
    body = F.col(text_col) if head is None else F.substring(F.col(text_col), 1, head)
    asked = queries.select("query_id", F.explode_outer(X.tokens(F.col("text"))).alias("term")).where(F.length("term") > 2).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    found = checkpointed(postings(docs, id_col, body, asked))
    size = found.where("term = ''").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.avg("len"), F.lit(1.0)).alias("avg"))  # one row
    hits = found.where("term <> ''")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    scored = hits.join(df, "term").crossJoin(F.broadcast(size)).select("term", "doc_id", (idf * weight).alias("s"))
    return scored.join(asked, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("s") * F.col("times")), 6).alias("score"))


def rank_rows(docs: DataFrame, query: DataFrame, recency_of: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with its score for one query, 0 where it shares no term; ``recency_of``
    turns a score column into the blended one."""
    scored = bm25(docs, query, id_col, text_col).select(F.col("doc_id").alias(id_col), "score")
    out = docs.join(scored, id_col, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return out if recency_of is None else out.withColumn("score", recency_of)


def reciprocal_rank_fusion(ranked: DataFrame, k: int = RRF) -> DataFrame:
    """(id, score) of rows (list, id, rank): the sum of 1 / (k + rank) over lists."""
    return ranked.groupBy("id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"), F.count(F.lit(1)).alias("lists"))


def fuse(upstream: Column, lexical: Column) -> Column:
    """Fusion of the given order (from 1) and a lexical order (from 0)."""
    return 1 / (RRF + upstream) + 0.4 / (RRF + 1 + lexical)
