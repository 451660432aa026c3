"""Decaying, counting and expiring state over event tables; ``now`` is a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HALF_LIFE_DAYS, LEAST_ATTEMPTS, POOR = 14.0, 5, 0.2


def health(events: DataFrame, host: str, ok: Column, ts: str, now: Column) -> DataFrame:
    """Decayed successes and failures, score and whether a host is poor.

    Decay composes, so the sums need no order and are aggregated before the shuffle.
    """
    age = (F.unix_micros(now) - F.unix_micros(F.col(ts).cast("timestamp"))) / 86_400e6
    weight = F.pow(F.lit(0.5), age / HALF_LIFE_DAYS)
    out = events.groupBy(host).agg(F.sum(F.when(ok, weight).otherwise(0.0)).alias("ok"), F.sum(F.when(ok, 0.0).otherwise(weight)).alias("fail"))
    score = (F.col("ok") + 1) / (F.col("ok") + F.col("fail") + 2)
    return out.withColumn("score", score).withColumn("poor", (F.col("ok") + F.col("fail") >= LEAST_ATTEMPTS) & (score < POOR))


def moving_average(events: DataFrame, key: str, order: list[str], value: str, keep: float = 0.9) -> DataFrame:
    """Exponential moving average in order: the first value starts it.

    In closed form over running numbers, so no group is gathered: value i of n
    weighs keep^(n-i) times (1 - keep), the first one keep^(n-1).
    """
    w = Window.partitionBy(key).orderBy(*order)
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    placed = events.withColumn("_i", F.row_number().over(w)).withColumn("_n", n)
    weight = F.pow(F.lit(keep), F.col("_n") - F.col("_i")) * F.when(F.col("_i") == 1, 1.0).otherwise(1 - keep)
    return placed.groupBy(key).agg(F.sum(weight * F.col(value)).alias("average"), F.count(F.lit(1)).alias("n"))


def streaks(events: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """Every event with the length of the run of failures that it ends (0 for a success)."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = events.withColumn("_f", failed.cast("int")).withColumn("_run", F.sum(1 - F.col("_f")).over(w))
    return marked.withColumn("streak", F.sum("_f").over(Window.partitionBy(key, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).drop("_f", "_run")


def rolling_count(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Every event with the number of its key's in the ``seconds`` up to it."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    return events.withColumn("recent", F.count(F.lit(1)).over(Window.partitionBy(key).orderBy(at).rangeBetween(-seconds * 1_000_000, 0)))


def latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The last version of each key."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")
