"""Order-sensitive state over streams, and sinks that a replayed batch doesn't change."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEEP, HALF_LIFE_DAYS, STREAK_CAP = 0.9, 14.0, 3600


def moving_averages(events: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Moving average of each key, events of a micro-batch taken in order; emits
    (key, average, n) for the keys that a batch touches."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        average, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(order)
        for v in rows[value]:
            average = float(v) if average is None else KEEP * average + (1 - KEEP) * float(v)
            n += 1
        state.update((average, n))
        yield pd.DataFrame({key: [group[0]], "average": [average], "n": [n]})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, average double, n long", "average double, n long", "update", GroupStateTimeout.NoTimeout)


def cooldowns(events: DataFrame, key: str, order: list[str], failed: str, first: int = 300, most: int = STREAK_CAP) -> DataFrame:
    """Failures in a row of each key and how long it rests: ``first`` seconds,
    doubled with every further failure, at most ``most``; an answer resets it."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(order)
        for bad in rows[failed]:
            run = run + 1 if bad else 0
        state.update((run,))
        yield pd.DataFrame({key: [group[0]], "streak": [run], "rest_seconds": [min(most, first * 2 ** (min(run, 20) - 1)) if run else 0]})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, streak long, rest_seconds long", "streak long", "update", GroupStateTimeout.NoTimeout)


def admit(spark: SparkSession, rows: DataFrame, folder: str, key: list[str], digest: str, order: str):
    """A sink function for ``foreachBatch``: new versions of documents.

    Each batch writes its own folder by batch number, so a replayed batch
    replaces what it wrote; a version that the batch repeats is written once.
    """

    def put(batch: DataFrame, number: int) -> None:
        first = batch.groupBy(*key, digest).agg(F.min(order).alias("first_seen"), F.count(F.lit(1)).alias("seen"))
        first.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return rows.writeStream.foreachBatch(put).trigger(availableNow=True)


def versions(spark: SparkSession, folder: str, key: list[str], digest: str) -> DataFrame:
    """All versions that batches admitted, each with when it was first seen."""
    return spark.read.parquet(folder).groupBy(*key, digest).agg(F.min("first_seen").alias("first_seen"), F.sum("seen").alias("seen"))
