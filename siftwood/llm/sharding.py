"""Balanced contiguous shards from global byte-size prefix sums [DataFrame functions only]."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, with_global_order


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """Puts all rows into ``shards`` runs of the order by id whose sizes are near equal.

    A row's size is its text's UTF-8 bytes (null: none) plus ``overhead``. The
    text is read once; from then on only (id, size, crc32) move. Rows are range
    partitioned by id, per-partition totals give every partition's byte base,
    and a row goes to the shard in which its middle byte falls, so a shard's
    size differs from the equal target by less than one row's size at each end.
    Equal ids follow each other in order of crc32 and then of reading; a null id
    comes first. No rows: no rows. Returns doc_id, size, text_crc32, shard,
    slot (gapless from 0 in each shard, in the same order); other columns of
    ``docs`` aren't read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("_row"))
    narrow = checkpointed(narrow)
    total = narrow.agg(F.sum("size")).first()[0] or 1
    placed = with_global_order(narrow, ["doc_id", "text_crc32", "_row"], {"_start": "size"}, "_index")
    shard = F.expr(f"cast((cast(2 * _start + size as decimal(25,0)) * {shards}) div cast({2 * total} as decimal(25,0)) as int)")
    placed = placed.withColumn("shard", F.least(shard, F.lit(shards - 1)))
    heads = placed.groupBy("shard").agg(F.min("_index").alias("_first"))
    return placed.join(F.broadcast(heads), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("_index") - F.col("_first")).cast("long").alias("slot"))
