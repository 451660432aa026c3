"""Caps, interleaves and orders of result lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def capped(rows: DataFrame, key: str, order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each key. Spark keeps no more of a key in a task
    than that before the shuffle (the window's group limit)."""
    return rows.withColumn("rank_in_group", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank_in_group") <= most)


def round_robin(rows: DataFrame, group: str, position: str) -> DataFrame:
    """Rows with their place among their group and the order rank, then group."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(position)))


def splice(primary: DataFrame, extra: DataFrame, every: int = 3) -> DataFrame:
    """Sort keys (major, minor) that put an extra row after every three primary ones.

    Both have a 1-based ``place``."""
    a = primary.withColumn("major", F.col("place").cast("double")).withColumn("minor", F.lit(0))
    b = extra.withColumn("major", (F.col("place") * every).cast("double")).withColumn("minor", F.lit(1))
    return a.unionByName(b)


def lead_limited(rows: DataFrame, key: str, order: list, lead: int = 2) -> DataFrame:
    """The first rows of each key lead, the others follow: ``follows`` is 0 or 1."""
    return rows.withColumn("follows", (F.row_number().over(Window.partitionBy(key).orderBy(*order)) > lead).cast("int"))


def within_budget(rows: DataFrame, partition: list[str], order: list, size: str, most: int) -> DataFrame:
    """Rows of each partition while their running size stays within the budget."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(size).over(w)).where(F.col("running") <= most)
