"""Caches, corpora, queues and provider chains as tables: what is kept, admitted, due or usable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwood.functions import urls

from .order import numbered, numbered_within

#: Seconds that entries of a kind are good for, and the share of the cap that maintenance leaves.
TTL = {"search": 6 * 3600, "extract": 21 * 86_400, "fetch": 21 * 86_400, "news": 30 * 60}
EVICT_TARGET, CHUNKER = 0.90, "lines-1"


def _age(ts: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(ts)) / 1e6


def lifetime_of(kind: Column, ttl: dict[str, int] = TTL, other: int = 3600) -> Column:
    return F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in ttl.items()], F.lit(other))


def cache_hits(entries: DataFrame, now: Column, max_age: int | None = None, mode: str = "use", ttl: dict[str, int] = TTL) -> DataFrame:
    """Entries (kind, ts) that a request may use: no older than their kind allows and
    the request asks, with the age and when they expire. A negative lifetime never
    ends; other modes than "use" find nothing."""
    if mode != "use":
        entries = entries.limit(0)
    age, life = _age(F.col("ts"), now), lifetime_of(F.col("kind"), ttl)
    life = life if max_age is None else F.least(F.when(life < 0, F.lit(max_age)).otherwise(life), F.lit(max_age))
    return entries.withColumns({"age_seconds": age, "expires": F.timestamp_micros(F.unix_micros("ts") + (life * 1_000_000).cast("long"))}).where((life < 0) | (age <= life))


def maintained(entries: DataFrame, now: Column, max_bytes: int, ttl: dict[str, int] = TTL) -> DataFrame:
    """Entries (key, kind, bytes, ts) with their fate: expired by their kind (unknown
    kinds live as long as the longest), evicted, or kept. The oldest are evicted
    until the others hold no more than nine tenths of ``max_bytes``."""
    longest = max([v for v in ttl.values() if v >= 0], default=86_400)
    life = lifetime_of(F.col("kind"), ttl, longest)
    dead = (life >= 0) & (_age(F.col("ts"), now) > life)
    target = max(1, int(max_bytes * EVICT_TARGET))
    alive = numbered(entries.where(~dead), [F.col("ts").desc(), F.col("key").asc()], "_place", {"_held": "bytes"})
    kept = alive.withColumn("fate", F.when(F.col("_held") <= target, "kept").otherwise("evicted"))
    return entries.where(dead).withColumn("fate", F.lit("expired")).unionByName(kept.drop("_place", "_held"))


def admitted(rows: DataFrame, harvest_chars: int = 8_000_000) -> DataFrame:
    """Rows (url, title, text, visibility, private, quality, content_status, ts) with
    why they can't enter a public corpus (null: they can), their canonical address,
    version id, and whether a later acquisition of the address supersedes them."""
    place, text = urls.corpus_url(F.col("url")), F.coalesce("text", F.lit(""))
    reason = (
        F.when((F.coalesce("visibility", F.lit("")) != "public") | F.coalesce("private", F.lit(False)), "public_provenance_required")
        .when(F.coalesce("quality", F.lit("")).isin("failed", "thin") | F.coalesce("content_status", F.lit("")).isin("navigation_only", "image_content"), "ineligible_content")
        .when(F.length(text) > harvest_chars, "harvest_limit")
        .when(place.isNull(), "invalid_address")
        .when(F.trim(text) == "", "empty_text")
    )
    digest = F.sha2(F.concat_ws("\0", text, F.coalesce("title", F.lit("")), F.lit(CHUNKER)), 256)
    seen = rows.withColumns({"reason": reason, "address": place, "version": F.when(reason.isNull(), F.sha2(F.concat_ws("\0", place, digest), 256))})
    last = seen.where("reason is null").groupBy("address").agg(F.max_by("version", F.struct("ts", "version")).alias("_last"))
    return seen.join(last, "address", "left").withColumn("superseded", F.coalesce(F.col("reason").isNull() & (F.col("version") != F.col("_last")), F.lit(False))).drop("_last")


def migrated(rows: DataFrame, now: Column, trust: bool = False) -> DataFrame:
    """Retained documents (id, url, expires, visibility, private) with their outcome:
    expired, private, unknown_visibility, obsolete (a public one of the address
    expires later) or accepted."""
    public = (F.lit(trust) | (F.coalesce("visibility", F.lit("")) == "public")) & ~F.coalesce("private", F.lit(False))
    latest = rows.where(public).groupBy(F.col("url").alias("_url")).agg(F.max("expires").alias("_latest"))
    told = F.when(F.col("expires") <= now, "expired").when(F.coalesce("private", F.lit(False)), "private").when(~public, "unknown_visibility").when(F.col("_latest") > F.col("expires"), "obsolete").otherwise("accepted")
    return rows.join(latest, rows["url"] == F.col("_url"), "left").withColumn("outcome", told).drop("_url", "_latest")


def pruned(sources: DataFrame, now: Column, days: int = 90, failed_days: int = 7, most: int = 1_000) -> DataFrame:
    """Sources (id, model, state, touched, passages) that stay: touched in ``days``,
    failed or superseded ones in ``failed_days``, and of each model the last touched
    while their passages are no more than ``most``."""
    age = _age(F.col("touched"), now) / 86_400
    young = sources.where((age <= days) & (~F.col("state").isin("failed", "superseded") | (age <= failed_days)))
    held = numbered_within(young, "model", [F.col("touched").desc(), F.col("id").asc()], "_place", {"_held": "passages"})
    return held.where(F.col("_held") <= most).drop("_place", "_held")


def promoted(spark: SparkSession, rows: DataFrame, folder: str, version: str) -> DataFrame:
    """Writes a new version of an index beside those in use and points readers at it:
    the pointer is replaced only when the version is whole. Returns the rows in use."""
    rows.write.mode("overwrite").parquet(f"{folder}/version={version}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    new, pointer = path(f"{folder}/pointer.new"), path(f"{folder}/pointer")
    out = fs.create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    fs.delete(pointer, False)
    fs.rename(new, pointer)
    return active(spark, folder)


def active(spark: SparkSession, folder: str) -> DataFrame:
    """The version that the pointer names."""
    version = spark.read.text(f"{folder}/pointer").first()[0]
    return spark.read.parquet(f"{folder}/version={version}")


def with_reused(passages: DataFrame, vectors: DataFrame) -> DataFrame:
    """Passages (digest, model) with a vector that was made of the same text by the same model."""
    known = vectors.groupBy("digest", "model").agg(F.min_by("vector", "id").alias("vector"), F.min("id").alias("reused_from"))
    return passages.join(known, ["digest", "model"], "left")


def nearest_cached(asked: DataFrame, cached: DataFrame, now: Column, ttl: int, floor: float = 0.55) -> DataFrame:
    """(query_id, id, similarity) of the most similar cached query of the same context
    that hasn't expired, the earlier of equals; only from the floor on. ``asked`` has
    query_id, context, vector, ``cached`` id, context, vector, ts."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    good = cached.where((F.lit(ttl) < 0) | (_age(F.col("ts"), now) <= ttl)).select("id", "context", F.col("vector").alias("_v"))
    met = asked.join(good, "context").select("query_id", "id", (dot("vector", "_v") / F.sqrt(dot("vector", "vector") * dot("_v", "_v"))).alias("similarity"))
    return met.where(F.col("similarity") >= floor).groupBy("query_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "id")).alias("x")).select("query_id", "x.id", (-F.col("x.s")).alias("similarity"))


def repaired(sources: DataFrame, documents: DataFrame) -> DataFrame:
    """Sources whose namespace is that of the document they name, where there's one."""
    known = documents.groupBy("document_id").agg(F.min("namespace").alias("_known"))
    return sources.join(known, "document_id", "left").withColumn("namespace", F.coalesce("_known", "namespace")).drop("_known")


def rested(engines: DataFrame, failures: DataFrame, now: Column, rest: int = 1_800) -> DataFrame:
    """Engines without a failure in the last ``rest`` seconds."""
    return engines.join(failures.where(_age(F.col("ts"), now) < rest), "engine", "left_anti")


def first_provider(answers: DataFrame, key: str = "query_id") -> DataFrame:
    """Of each query the first provider in order whose answer is usable (rows, no
    decoy); later ones are only asked where all before were not."""
    usable = (F.col("results") > 0) & ~F.col("decoy")
    return answers.groupBy(key).agg(F.min_by("provider", F.when(usable, F.col("provider_order"))).alias("provider"), F.count_if(usable).alias("usable"), F.count(F.lit(1)).alias("offered"))


def claimable(jobs: DataFrame, now: Column, most_attempts: int = 3) -> DataFrame:
    """Jobs (id, state, attempts, available, lease) that a worker may claim, in order:
    pending ones that are due, and running ones whose lease has run out."""
    due = (F.col("state") == "pending") & (F.coalesce("available", now) <= now)
    lost = (F.col("state") == "running") & (F.col("lease") < now)
    return jobs.where((due | lost) & (F.col("attempts") < most_attempts)).orderBy(F.coalesce("available", F.lit("1970-01-01").cast("timestamp")), "id")


def after_failure(jobs: DataFrame, now: Column, most_attempts: int = 3) -> DataFrame:
    """Jobs after a failed attempt: due again in 2, 4, 8 ... seconds, or failed for good."""
    n = F.col("attempts") + 1
    again = F.timestamp_micros(F.unix_micros(now) + (F.pow(F.lit(2.0), n) * 1_000_000).cast("long"))
    return jobs.withColumns({"attempts": n, "state": F.when(n >= most_attempts, "failed").otherwise("pending"), "available": F.when(n < most_attempts, again), "lease": F.lit(None).cast("timestamp")})


LADDER = ("direct", "tls", "render", "headed")


def skip_plan(records: DataFrame, won: DataFrame, now: Column, caller: str) -> DataFrame:
    """(host, tier, kind, streak) of steps that a caller's next read of a host skips.

    ``records`` has host, tier, kind, streak, last_fail, callers; ``won`` host, tier,
    ts. A step is skipped after three failures in a row, the last within a day and
    six hours, seen by two callers or by this one alone, if a later step has worked
    in a week. Walls aren't skipped but waited for.
    """
    step = lambda c: F.array_position(F.array(*[F.lit(x) for x in LADDER]), F.col(c))
    age = _age(F.col("last_fail"), now)
    applies = (F.col("streak") >= 3) & (age <= 6 * 3600) & ((F.size("callers") >= 2) | (F.col("callers") == F.array(F.lit(caller))))
    open_ = records.where(applies & ~F.col("kind").startswith("wall:") & step("tier").between(1, len(LADDER) - 1)).withColumn("_step", step("tier"))
    later = won.where(_age(F.col("ts"), now) < 7 * 86_400).groupBy("host").agg(F.max(step("tier")).alias("_won"))
    return open_.join(later, "host").where(F.col("_won") > F.col("_step")).select("host", "tier", "kind", "streak")


def flattened(rows: DataFrame, id_col: str, report: str) -> DataFrame:
    """A nested report (JSON object) as rows (id, name, value)."""
    held = F.from_json(F.col(report), "map<string,string>")
    return rows.select(F.col(id_col), F.explode(held).alias("name", "value"))


def page_of(rows: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """One page of results in order, with its rows' places and the next offset (null at the end)."""
    total = rows.count()
    some = rows.orderBy(*order).offset(offset).limit(limit)
    return some.withColumn("next_offset", F.lit(offset + limit if offset + limit < total else None).cast("long"))


def export(rows: DataFrame, folder: str) -> DataFrame:
    """Rows as JSON lines; returns how many of each outcome were written."""
    rows.write.mode("overwrite").json(folder)
    return rows.groupBy("outcome").count()


def last_observations(observed: DataFrame, quiet: int = 60) -> DataFrame:
    """Each provider's last observation; a cached answer within ``quiet`` seconds of the
    one before it doesn't count as one."""
    w = Window.partitionBy("provider").orderBy("ts", "id")
    gap = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) / 1e6
    real = observed.withColumn("_gap", gap).where((F.col("status") != "cached") | F.col("_gap").isNull() | (F.col("_gap") >= quiet))
    return real.groupBy("provider").agg(F.max_by("status", F.struct("ts", "id")).alias("status"), F.max("ts").alias("ts"))
