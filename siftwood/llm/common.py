"""Session helpers that the operators of this subpackage share.

Intermediate tables go to the folder named in ``spark.checkpoint.dir`` (set to
a temporary folder only where it is unset, as in tests), so that they survive
the loss of executors and cut lineage.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; ``checkpoint()`` uses it as well. A
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
    shared_dir(spark)
    with _own_shuffles_removed(spark):
        out = df.select("*").checkpoint()
    plan = out._jdf.queryExecution().logical()
    if plan.stats().sizeInBytes() < 2**63:
        return out
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.rdd(), out._jdf.schema(), False), spark)


def collected(df: DataFrame) -> list:
    """The rows of a small result; what was shuffled for them is removed."""
    with _own_shuffles_removed(df.sparkSession):
        return df.select("*").collect()


def dealt_by(df: DataFrame, key: str) -> DataFrame:
    """``df`` checkpointed, dealt by ``key`` and in order of it: joins and groups by
    the key don't move it again. (Adaptive plans don't tell how they are dealt.)"""
    spark = df.sparkSession
    setting = "spark.sql.adaptive.enabled"
    was = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        return checkpointed(df.repartition(parts(spark), key).sortWithinPartitions(key))
    finally:
        spark.conf.set(setting, was)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a compressed Parquet table in the shared folder, so that later
    reads fetch only the columns they need; removed when the session ends, or
    by ``drop_stored``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siftwood-{uuid.uuid4().hex}"
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


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_global_order(df: DataFrame, order: list[str], sums: dict[str, str], index: str) -> DataFrame:
    """Global row numbers and exclusive prefix sums over ``order``, without a
    single-task sort.

    Rows are range partitioned; each partition's count and sums give the
    partition's bases (one row per partition, so they are broadcast), and a
    window inside each partition gives the rest. ``sums`` maps a result column
    to the column summed. ``order`` must make rows unique, or hold only rows
    that may change places.
    """
    spark = df.sparkSession
    ranged = checkpointed(df.repartitionByRange(parts(spark), *order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"), *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums])
    inside = Window.partitionBy("_part").orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(bases), "_part")
    out = out.withColumn(index, F.col("_b") + F.row_number().over(inside) - 1)
    for k, c in sums.items():
        out = out.withColumn(k, F.col(f"_b_{k}") + F.coalesce(F.sum(c).over(earlier), F.lit(0)))
    return out.drop("_part", "_b", *[f"_b_{k}" for k in sums])


def bucket_of(key: Column, bounds: list) -> Column:
    """The number of ``bounds`` (ascending) not above ``key``, by binary search;
    0 for a null key. The expression's size doesn't depend on ``bounds``."""
    if not bounds:
        return F.lit(0)
    array = F.array(*[F.lit(int(b)) for b in bounds])
    steps, s = [], 1
    while s <= len(bounds):
        steps.insert(0, s)
        s *= 2
    found = F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.element_at(array, F.least(at + step, F.lit(len(bounds)))) <= key), at + step).otherwise(at))
    return F.coalesce(found, F.lit(0))


def quantile_bounds(df: DataFrame, key: str, buckets: int) -> list[int]:
    """At most ``buckets - 1`` cut points of an integer column; one row of that
    bounded size comes to the driver."""
    if buckets < 2:
        return []
    at = [i / buckets for i in range(1, buckets)]
    found = df.select(F.percentile_approx(key, at, 10_000).alias("q")).first()["q"]
    return sorted(set(found or []))


def _memory_returned() -> None:
    """Gives freed memory back to the system, so that an idle worker holds little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        _memory_returned()

    return df.mapInArrow(run, schema)


def free_prefix(columns: list[str], names: list[str]) -> str:
    """Underscores that, before any of ``names``, make none of ``columns``."""
    prefix = "_"
    taken = {c.lower() for c in columns}
    while any((prefix + n).lower() in taken for n in names):
        prefix += "_"
    return prefix
