"""Positions over whole tables and large groups, without one task that sorts them all.

Rows are range partitioned by the order; a partition's count gives the next its
base, and a window inside each partition gives the rest. So a table, or a key
that most rows share, is numbered by as many tasks as it has partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwood.session import checkpointed


def numbered(rows: DataFrame, order: list[Column], into: str = "position", sums: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with their place (from 1) in ``order`` and running sums, themselves
    included: ``sums`` maps a result column to the column summed. ``order`` should
    make rows unique."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sums = sums or {}
    totals = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s_{k}") for k, c in sums.items()])
    # one row a partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_n", *[f"_s_{k}" for k in sums])])
    inside = Window.partitionBy("_part").orderBy(*order)
    out = ranged.join(F.broadcast(bases), "_part").withColumn(into, (F.col("_n_before") + F.row_number().over(inside)).cast("long"))
    for k, c in sums.items():
        out = out.withColumn(k, F.col(f"_s_{k}_before") + F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return out.select(*rows.columns, into, *sums)


def numbered_within(rows: DataFrame, key: str, order: list[Column], into: str = "place", sums: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with their place (from 1) among those of their key, and running sums
    within it. Keys may be few and large: they are split like the whole table."""
    sums = sums or {}
    totals = {f"_r_{k}": c for k, c in sums.items()}
    placed = checkpointed(numbered(rows, [F.col(key).asc(), *order], "_place", totals))
    first = placed.groupBy(key).agg(F.min("_place").alias("_first"), *[F.min_by(F.col(t) - F.col(c), "_place").alias(f"{t}_base") for t, c in totals.items()])
    renamed = first.withColumnRenamed(key, "_key")
    out = placed.join(renamed, placed[key].eqNullSafe(renamed["_key"])).withColumn(into, (F.col("_place") - F.col("_first") + 1).cast("long"))
    for k in sums:
        out = out.withColumn(k, F.col(f"_r_{k}") - F.col(f"_r_{k}_base"))
    return out.select(*rows.columns, into, *sums)
