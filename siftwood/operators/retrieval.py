"""Evidence windows, samples, structure blocks, support and crawl frontiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwood.functions import text as X

from .order import numbered_within


def distributed(rows: DataFrame, key: str, position: str, most: int) -> DataFrame:
    """Evenly spaced rows of each key, both ends included; all where there are few."""
    if most <= 0:
        return rows.limit(0)
    placed = numbered_within(rows, key, [F.col(position).asc()], "_i")
    sizes = rows.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    placed = placed.join(sizes, placed[key].eqNullSafe(sizes["_k"])).withColumn("_i", F.col("_i") - 1)
    if most == 1:
        return placed.where("_i = 0").select(*rows.columns)
    picks = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / (most - 1)).cast("long"))
    return placed.where((F.col("_n") <= most) | F.array_contains(picks, F.col("_i"))).select(*rows.columns)


def evidence_windows(text: Column, terms: Column, width: int = 600, most: int = 3) -> Column:
    """Up to ``most`` windows (offset, matches) that hold most distinct terms and
    don't overlap: best first, earlier ones win ties."""
    runs = X.windows(text, width, max(width - 150, 200))
    scored = F.transform(runs, lambda r: F.struct((-F.size(F.filter(terms, lambda t: F.contains(F.lower(r["text"]), t)))).alias("minus"), r["start"].alias("offset")))
    ordered = F.array_sort(F.filter(scored, lambda r: r["minus"] < 0))
    none = F.array().cast("array<struct<minus:int,offset:int>>")
    kept = F.aggregate(ordered, none, lambda had, r: F.when((F.size(had) < most) & F.forall(had, lambda h: F.abs(h["offset"] - r["offset"]) >= width), F.array_append(had, r)).otherwise(had))
    return F.transform(kept, lambda r: F.struct(r["offset"].alias("offset"), (-r["minus"]).alias("matches")))


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A text's lines with their offsets: text[start:end] is the line. The kind is
    heading, list, table or paragraph; ``heading`` is the one in force."""
    lines = F.split(F.col(text_col), "\n")
    sized = F.transform(lines, lambda x: F.length(x) + 1)
    own = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.arrays_zip(lines.alias("line"), sized.alias("size"))).alias("block", "b")).select("doc_id", "block", F.col("b.line").alias("text"), F.col("b.size").alias("size"))
    w = Window.partitionBy("doc_id").orderBy("block")
    start = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kind = F.when(F.col("text").rlike(r"^#{1,6}\s+\S"), "heading").when(F.col("text").rlike(r"^\s*([-*•]|\d+[.)])\s+"), "list").when(F.col("text").rlike(r"^\s*\|.*\|\s*$"), "table").otherwise("paragraph")
    placed = own.withColumn("start", start.cast("long")).withColumn("end", (start + F.length("text")).cast("long")).withColumn("kind", kind)
    title = F.when(F.col("kind") == "heading", F.regexp_extract("text", r"^#{1,6}\s+(.*)$", 1))
    return placed.withColumn("heading", F.last(title, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.trim("text") != "").select("doc_id", "block", "kind", "start", "end", "text", "heading")


def representative(passages: DataFrame, key: str, position: str, text_col: str, most: int) -> DataFrame:
    """Passages worth embedding: the first of each text, six words or more, not
    mostly links; evenly spaced over each key."""
    n = F.size(X.words(F.col(text_col)))
    links = F.regexp_count(F.col(text_col), F.lit(r"\]\("))
    good = passages.where((n >= 6) & (links <= F.greatest(F.lit(3), F.floor(n / 8)))).withColumn("_d", X.digest(F.col(text_col)))
    first = good.withColumn("_rn", F.row_number().over(Window.partitionBy(key, "_d").orderBy(position))).where("_rn = 1").drop("_rn", "_d")
    return distributed(first, key, position, most)


def support(models: Column, query_terms: Column, text: Column) -> Column:
    """Why a passage is believed: lexical_match, model_agreement, query_terms or unconfirmed."""
    anchors = F.size(F.array_intersect(query_terms, X.terms(text)))
    n = F.size(query_terms)
    return F.when(F.array_contains(models, "lexical"), "lexical_match").when(F.size(F.array_distinct(models)) >= 2, "model_agreement").when((n > 0) & (anchors >= F.least(F.lit(2), n)), "query_terms").otherwise("unconfirmed")


def frontier(links: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, depth) reachable over (src, dst) in at most ``depth`` steps, each at
    its least depth. The loop is as long as ``depth``; each step is a join."""
    from siftwood.session import checkpointed

    seen = checkpointed(seeds.select("node", F.lit(0).alias("depth")).distinct())
    last = seen
    for d in range(1, depth + 1):
        last = checkpointed(last.select(F.col("node").alias("src")).join(links, "src").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(d)))
        seen = checkpointed(seen.union(last))
    return seen


def first_usable(attempts: DataFrame, key: str, order: list[str], usable: Column, size: str, *cols: str) -> DataFrame:
    """Of each key the first acceptable attempt, else the one with most text."""
    best = F.struct((~usable).cast("int").alias("_bad"), *[F.when(usable, F.col(c)).otherwise(-F.col(size) if i == 0 else F.lit(0)).alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c) for c in order], *[F.col(c).alias(f"_v_{c}") for c in cols])
    return attempts.groupBy(key).agg(F.min(best).alias("_b")).select(key, (F.col("_b._bad") == 0).alias("accepted"), *[F.col(f"_b._v_{c}").alias(c) for c in cols])


def merge_read(found: DataFrame, read: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Search rows with what was read of them; a read value replaces a found one."""
    had = read.select(key, *[F.col(c).alias(f"_r_{c}") for c in cols])
    out = found.join(had, key, "left")
    return out.select(*[F.coalesce(f"_r_{c}", c).alias(c) if c in cols else F.col(c) for c in found.columns])


def same_version(a: Column, b: Column) -> Column:
    """Whether two digests are of one version: same, different or unknown."""
    return F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), "unknown").when(a == b, "same").otherwise("different")


def shared_terms(queries: DataFrame, docs: DataFrame, least: int = 2) -> DataFrame:
    """(item_id, doc_id, shared): documents that hold at least ``least`` of a question's
    terms, or all where it has fewer. One join of terms, aggregated; ``queries`` has
    item_id and text, ``docs`` doc_id and text."""
    asked = queries.select("item_id", X.terms(F.col("text")).alias("t")).select("item_id", F.size("t").alias("n"), F.explode("t").alias("term"))
    held = docs.select("doc_id", X.terms(F.col("text")).alias("t")).select("doc_id", F.explode_outer("t").alias("term"))
    met = asked.join(held, "term").groupBy("item_id", "doc_id", "n").agg(F.count(F.lit(1)).alias("shared"))
    return met.where(F.col("shared") >= F.least(F.lit(least), F.col("n"))).select("item_id", "doc_id", "shared")
