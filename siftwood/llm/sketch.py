"""Bottom-k sketches of word-shingle hashes [DataFrame functions only].

A sketch is the ascending array of the ``k`` smallest distinct 64-bit hashes of
a text's shingles. Sketches of parts merge into the sketch of the whole, and
two sketches estimate resemblance, containment and distinct shingle counts.
While a text has no more than ``k`` distinct shingles all estimates are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, parts, quantile_bounds

K, WIDTH = 128, 5
BLANKS = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """Runs of anything but ASCII white space; of an empty text, one empty word."""
    return F.split(F.btrim(text, F.lit(BLANKS)), "[\\t-\\r ]+")


def shingle_hashes(words: Column, width: int = WIDTH) -> Column:
    """A hash for each run of ``width`` words; of fewer words, one of them all.

    ``words`` must be a column of the frame, as it is used for each shingle.
    """
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (width - 1), F.lit(1)))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, width)))


def sketch_of(words: Column, k: int = K, width: int = WIDTH) -> Column:
    """The bottom-k sketch; of an empty text, an empty array."""
    full = F.slice(F.sort_array(F.array_distinct(shingle_hashes(words, width))), 1, k)
    return F.when((F.size(words) == 1) & (F.element_at(words, 1) == ""), F.array().cast("array<bigint>")).otherwise(full)


def with_sketch(df: DataFrame, text_col: str, into: str, k: int = K, width: int = WIDTH) -> DataFrame:
    """``df`` with the sketch of ``text_col`` (null: as empty) in ``into``."""
    split = df.withColumn("_words", words_of(F.coalesce(F.col(text_col), F.lit(""))))
    return split.withColumn(into, sketch_of(F.col("_words"), k, width)).drop("_words")


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what ``a`` and ``b`` are sketches of."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merged(df: DataFrame, keys: list[str], sketch_col: str, k: int = K) -> DataFrame:
    """One sketch for each key: the ``k`` smallest distinct hashes of its rows.

    Hashes are made distinct per key before ranking, so a hot key's rows are
    aggregated before the shuffle, and a key's window holds distinct hashes only.
    """
    hashes = df.select(*keys, F.explode(sketch_col).alias("_h")).distinct()
    salted = hashes.withColumn("_salt", F.pmod(F.col("_h"), F.lit(64)))
    few = salted.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy("_h"))).where(F.col("_r") <= k)
    return few.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list("_h")), 1, k).alias(sketch_col))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness, 0 to 1: of the ``k`` smallest hashes of the
    union, the share that both have. Two empty sketches are alike."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else from the
    k-th smallest hash's place in the range of hashes."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / F.greatest(share, F.lit(1e-300)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of ``a``'s distinct shingles that ``b`` has; 1 for an empty ``a``."""
    j, na, nb = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j / (1 + j) * (na + nb) / na))


def as_text(a: Column) -> Column:
    """16 hex digits for each hash, smallest first."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def with_next_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, next_text, with _bucket, _ghost and _tie) in descending order of id, the last followed by the first.

    Ids fall into buckets by quantiles; the first rows of each bucket are
    repeated as ghosts (``_ghost`` = 1) behind the bucket before it, so each
    bucket's window has the row that follows. The text is shuffled once. Equal
    ids follow each other by hash of the text; a null id comes last. Rows that
    share an id are in one bucket, as nothing but the id orders them.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = F.col("doc_id").cast("long")
    ids = docs.select(F.col(id_col).cast("long").alias("k"))
    # drawn once: approximate quantiles may differ from call to call
    bounds = quantile_bounds(ids, "k", 4 * parts(docs.sparkSession))
    bucket = bucket_of(key, bounds)
    first = ids.groupBy(bucket_of(F.col("k"), bounds).alias("_at")).agg(F.max("k").alias("_head")).orderBy(F.desc("_at")).collect()
    # one row a bucket: the head of each goes to the bucket before it in this order, that of the first to the last
    goes = [(first[i]["_head"], first[i - 1]["_at"]) for i in range(len(first))]
    if not goes:
        return base.withColumns({"_bucket": F.lit(0), "_ghost": F.lit(0), "_tie": F.lit(0), "next_text": F.lit("")})
    to = docs.sparkSession.createDataFrame(goes, "_head long, _to int")
    placed = base.withColumn("_bucket", bucket).join(F.broadcast(to), key.eqNullSafe(F.col("_head")), "left")
    both = F.when(F.col("_to").isNull(), F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("g")))).otherwise(F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("g")), F.struct(F.col("_to").alias("b"), F.lit(1).alias("g"))))
    rows = placed.select("doc_id", "text", F.xxhash64("text").alias("_tie"), F.explode(both).alias("_x")).select("doc_id", "text", "_tie", F.col("_x.b").alias("_bucket"), F.col("_x.g").alias("_ghost"))
    return rows.withColumn("next_text", F.lead("text").over(order()))


def order():
    return Window.partitionBy("_bucket").orderBy("_ghost", F.col("doc_id").desc_nulls_last(), "_tie")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """Sketches of every whole text, of its edited text, and their likeness.

    The edited text replaces the last floor(n_chars / 3) code points by the
    first as many (or all) of the next row's text in descending order of id,
    the last row being followed by the first. A null text is empty; an empty
    text has an empty sketch, which is like another empty one only. Returns
    doc_id, n_chars, edited (text), sketch, edited_sketch, next_sketch.
    """
    rows = with_next_text(docs, id_col, text_col).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("edited", F.when(F.col("_ghost") == 0, F.concat(F.substring("text", 1, (F.col("n_chars") - cut).cast("int")), F.substring(F.coalesce("next_text", F.lit("")), 1, cut))).otherwise(F.lit("")))
    rows = with_sketch(with_sketch(rows.drop("next_text"), "text", "sketch", k, width), "edited", "edited_sketch", k, width)
    return rows.withColumn("next_sketch", F.lead("sketch").over(order())).where("_ghost = 0").select("doc_id", "n_chars", "edited", "sketch", "edited_sketch", "next_sketch")
