"""Tables, feeds, manifests and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwood.functions.dates import parse_date
from siftwood.functions.text import csv_cell

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``url[,item_key]`` as (url, item_key); empty lines and comments dropped."""
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    parts = F.split(F.trim("value"), ",", 2)
    return rows.select(F.trim(parts[0]).alias("url"), F.when(F.size(parts) > 1, F.trim(parts[1])).alias("item_key"))


def feed(spark: SparkSession, path: str, most: int = 60) -> DataFrame:
    """Items of RSS and Atom files, newest first, undated last."""
    rss = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, description string, pubDate string").load(path)
    atom = spark.read.format("xml").option("rowTag", "entry").schema("title string, link struct<_href:string>, summary string, published string, updated string").load(path)
    items = rss.select("title", "link", F.col("description").alias("summary"), F.col("pubDate").alias("dated")).union(atom.select("title", "link._href", "summary", F.coalesce("published", "updated")))
    return items.withColumn("published", parse_date(F.col("dated"))).drop("dated").orderBy(F.desc_nulls_last("published"), "link").limit(most)


def blocklist(spark: SparkSession, path: str) -> DataFrame:
    """Hosts of ``||host^`` lines."""
    return spark.read.text(path).select(F.regexp_extract("value", r"^\|\|([a-z0-9.-]+)\^$", 1).alias("host")).where("host <> ''").distinct()


def captions(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, segment, start_seconds, end_seconds, text) of VTT or SRT captions."""
    stamp = r"((?:\d+:)?\d{1,2}:\d{2}[.,]\d{3})"
    blocks = texts.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.replace(F.col(text_col), F.lit("\r"), F.lit("")), r"\n\s*\n")).alias("segment", "block"))
    found = blocks.withColumn("a", F.regexp_extract("block", stamp + r"\s*-->", 1)).withColumn("b", F.regexp_extract("block", r"-->\s*" + stamp, 1)).where("a <> ''")
    seconds = lambda c: F.aggregate(F.transform(F.split(F.replace(F.col(c), F.lit(","), F.lit(".")), ":"), lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s * 60 + x)
    body = F.trim(F.regexp_replace(F.regexp_replace("block", r"(?s)^.*?-->[^\n]*\n?", ""), "<[^>]+>", ""))
    return found.select("id", "segment", seconds("a").alias("start_seconds"), seconds("b").alias("end_seconds"), F.regexp_replace(body, r"\s+", " ").alias("text"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV whose text cells no spreadsheet takes for formulas."""
    df.select(*[csv_cell(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]).write.mode("overwrite").csv(path, header=True)


def upsert(spark: SparkSession, path: str, rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """What a keyed table holds after ``rows``: the last version of each key. The
    caller writes it to a new folder and then points readers at that one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    both = spark.read.schema(rows.schema).parquet(path).unionByName(rows) if there else rows
    return both.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")
