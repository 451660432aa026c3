"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown, lines, mixing, neardup_vectors, packing, sharding, simhash, sketch, toxicity, warc
from .common import read


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of all documents, the component of each and the line kept of it."""
    return lines.line_groups(read(spark, sf_dir, "documents")).select("doc_id", "line_no", "line_id", "component_id", "kept_doc_id", "kept_line_no", "kept")


def op2_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-based n-gram scores of all documents."""
    return brown.score(read(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack(read(spark, sf_dir, "documents"))


def op4_neardup_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings with cosine 0.95 or more."""
    return neardup_vectors.link(read(spark, sf_dir, "embeddings"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 contiguous shards of near equal bytes."""
    placed = sharding.shard_by_bytes(read(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixity of a replica of all pages, with known damage, against the primary.

    The replica has lost the last character of every 97th page's payload and
    has no record of every 211th page. One row for each record of the primary.
    """
    pages = read(spark, sf_dir, "pages")
    number, html = F.col("page_id"), F.col("html")
    damaged = F.when(F.pmod(number, F.lit(97)) == 13, F.substring(html, 1, F.greatest(F.length(html) - 1, F.lit(0)))).otherwise(html)
    primary = warc.manifest(pages.select("page_id", warc.record(F.col("url"), number, html).alias("record")), "page_id", "record")
    copy = pages.where(F.pmod(F.coalesce(number, F.lit(0)), F.lit(211)) != 5)
    replica = warc.manifest(copy.select("page_id", warc.record(F.col("url"), number, damaged).alias("record")), "page_id", "record")
    found = warc.report(primary, replica)
    return found.select(F.col("id").alias("page_id"), F.col("place").cast("long").alias("place"), F.col("offset").cast("long").alias("offset"), "length", "digest", "replica_digest", "state")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents by SimHash within 4 bits."""
    found = simhash.groups(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of(F.col("fingerprint")).alias("fingerprint"), "component_id", "kept")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from two of three folds of the labels."""
    docs, held = read(spark, sf_dir, "documents"), toxicity.fold() == 1
    model = toxicity.fit(toxicity.sample(docs, read(spark, sf_dir, "labels"), ~held))
    found = toxicity.score(docs, model)
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their raked weight, probability and whether they are sampled."""
    docs = read(spark, sf_dir, "documents")
    names = mixing.added(docs)
    return mixing.mix(docs).select("doc_id", *[F.col(names[n]).alias("n_tokens" if n == "tokens" else n) for n in mixing.ADDED])


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom-k sketches of all documents and of their edited texts."""
    rows = sketch.fingerprints(read(spark, sf_dir, "documents"))
    a, b, c = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        sketch.as_text(a).alias("fingerprint"),
        sketch.as_text(b).alias("edited_fingerprint"),
        sketch.resemblance(a, b).alias("near_edited"),
        sketch.resemblance(a, c).alias("near_next"),
        sketch.distinct_shingles(a).alias("distinct_shingles"),
        sketch.containment(a, b).alias("contained_in_edited"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lines": op1_lines,
    "op2_brown": op2_brown,
    "op3_packing": op3_packing,
    "op4_neardup_vectors": op4_neardup_vectors,
    "op5_sharding": op5_sharding,
    "op6_warc": op6_warc,
    "op7_simhash": op7_simhash,
    "op8_toxicity": op8_toxicity,
    "op9_mixing": op9_mixing,
    "op10_fingerprints": op10_fingerprints,
}

ORACLES: dict[str, str] = {
    "op6_warc": """
WITH records AS (
  SELECT page_id, url, html, CASE WHEN ((page_id % 97) + 97) % 97 = 13 THEN substr(html, 1, greatest(length(html) - 1, 0)) ELSE html END AS damaged FROM pages
), built AS (
  SELECT page_id,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:record:' || page_id::VARCHAR || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html)::VARCHAR || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS mine,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:record:' || page_id::VARCHAR || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(damaged)::VARCHAR || chr(13) || chr(10) || chr(13) || chr(10) || damaged || chr(13) || chr(10) || chr(13) || chr(10) AS theirs
  FROM records
), hashed AS (
  SELECT page_id, strlen(mine)::BIGINT AS length, sha256(mine) AS digest, CASE WHEN ((page_id % 211) + 211) % 211 = 5 THEN NULL ELSE sha256(theirs) END AS replica_digest FROM built
)
SELECT page_id,
  (row_number() OVER (ORDER BY page_id) - 1)::BIGINT AS place,
  coalesce(sum(length) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
  length, digest, replica_digest,
  CASE WHEN replica_digest IS NULL THEN 'lost' WHEN replica_digest <> digest THEN 'altered' ELSE 'intact' END AS state
FROM hashed""",
}
