"""The session and its settings."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str = "local[*]", partitions: int = 8, **more: str) -> SparkSession:
    """A session for tests and local use; a cluster brings its own settings."""
    builder = SparkSession.builder.master(master).appName("siftwood").config("spark.sql.shuffle.partitions", str(partitions)).config("spark.ui.enabled", "false")
    for key, value in (SETTINGS | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: that of ``spark.checkpoint.dir``; a
    temporary one is made only where Spark runs in this machine alone."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='siftwood-')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found.rstrip("/")


@contextlib.contextmanager
def _own_shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Frames made here remove their shuffle files when their action ends."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, its lineage cut.

    A checkpoint keeps the planner's estimate of its size, and a join's is the product
    of its sides'. Through rounds of joins its digits would double each time until the
    driver's memory is full, so estimates beyond a long are forgotten.
    """
    spark = df.sparkSession
    shared_folder(spark)
    with _own_shuffles_removed(spark):
        out = df.select("*").checkpoint()
    plan = out._jdf.queryExecution().logical()
    if plan.stats().sizeInBytes() < 2**63:
        return out
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.rdd(), out._jdf.schema(), False), spark)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a compressed Parquet table in the shared folder; removed when the
    session ends, or by ``drop_stored``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/siftwood-{uuid.uuid4().hex}"
    with _own_shuffles_removed(spark):
        df.select("*").write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._siftwood_path = path
    return out


def drop_stored(df: DataFrame) -> None:
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(df._siftwood_path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
