"""A corpus pipeline over ``documents``: five stages, each an operator of the llm subpackage.

Each stage takes the documents its predecessor kept, written and read again as
Parquet; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.llm import lines, mixing, packing, simhash, toxicity
from siftwood.llm.common import free_prefix, read, stored

#: The share of tokens that mixing keeps.
KEEP = 0.75


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier doesn't reject.

    It learns from the labels of two of three folds, as the query does.
    """
    model = toxicity.fit(toxicity.sample(docs, read(spark, sf_dir, "labels"), toxicity.fold() != 1))
    into = free_prefix(docs.columns, ["toxicity"]) + "toxicity"
    return toxicity.score(docs, model, keep_columns=True, into=into).where(F.col(into) < toxicity.THRESHOLD).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines, exact or fuzzy; ``n_chars`` follows the text."""
    return lines.dedup_lines(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group whose five-word shingles
    are 0.8 alike or more, met by balls around SimHash fingerprints."""
    kept = free_prefix(docs.columns, ["row", "component", "kept"]) + "kept"
    return simhash.similar(docs).where(kept).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to tempered source, language and topic shares."""
    return mixing.mix(docs, keep=KEEP).where(mixing.added(docs)["sampled"]).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents and the sequence and offset of each."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, what each returns stored for the next."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs


#: Compression lengths, MinHash, SimHash components and tokenizers aren't SQL.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
