"""Structured Streaming counterparts of the event operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwood.session import shared_folder

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def events(spark: SparkSession, path: str, delay: str = "10 minutes") -> DataFrame:
    """Event files (a pattern of theirs) as a stream with a watermark on ``ts``."""
    rows = spark.readStream.schema(EVENTS).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def tumbling(rows: DataFrame, size: str = "1 hour") -> DataFrame:
    return rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(rows: DataFrame, size: str = "2 hours", step: str = "1 hour") -> DataFrame:
    return rows.groupBy(F.window("ts", size, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(rows: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(rows: DataFrame) -> DataFrame:
    """Each user and type once within the watermark's delay."""
    return rows.dropDuplicatesWithinWatermark(["user_id", "event_type"])


def drained(spark: SparkSession, rows: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there and returns the result as a batch table.

    Each micro-batch is written to the shared folder (by number, so a replayed one
    replaces what it wrote; with a complete mode the last stands for all), where the
    stream's state is kept as well; no row passes the driver. Results in update mode
    have the number of their batch in ``batch``.
    """
    folder = f"{shared_folder(spark)}/stream-{name}-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows" if mode == "complete" else f"{folder}/rows/batch={number}")

    query = rows.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(place)
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/rows")):
        return spark.createDataFrame([], rows.schema if mode == "complete" else T.StructType([*rows.schema.fields, T.StructField("batch", T.IntegerType())]))
    return spark.read.parquet(f"{folder}/rows")
