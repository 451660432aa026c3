"""Result rows of several providers: keyed merges, collapses, menus and recovered destinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwood.functions import urls
from siftwood.session import checkpointed

MOST_LISTED, CONFLICT_DAYS = 8, 7


def union_in_order(tables: list[tuple[str, DataFrame]], position: str) -> DataFrame:
    """Rows of all providers, each with its provider and the provider's place in the
    list; missing columns are null. The order is (provider_order, position)."""
    out = None
    for i, (name, rows) in enumerate(tables):
        one = rows.withColumns({"provider": F.lit(name), "provider_order": F.lit(i)})
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out.orderBy("provider_order", position)


def merge_by_key(rows: DataFrame, key: str = "url_key", position: str = "position") -> DataFrame:
    """One row for each key, that of its first position, with what the others add.

    ``rows`` has url, snippet, provider, published (date) and date_source
    (structured, snippet or none). The first snippet that isn't blank and the
    first structured date are taken, else the first snippet date; a snippet date
    that stands behind the structured one and is more than a week from it is named
    as a conflict. Providers are listed in order of their first row, other
    addresses up to eight. Everything is a minimum by position, aggregated before
    the shuffle, so a key that most rows share costs no more than others.
    """
    place = F.col(position)
    dated = lambda kind: F.when((F.col("date_source") == kind) & F.col("published").isNotNull(), F.struct(place.alias("p"), F.col("published").alias("d")))
    spoken = F.when(F.trim(F.coalesce("snippet", F.lit(""))) != "", F.struct(place.alias("p"), F.col("snippet").alias("s")))
    heads = checkpointed(
        rows.groupBy(key).agg(
            F.min(F.struct(place.alias("p"), F.col("url").alias("url"))).alias("first"),
            F.min(spoken).alias("spoken"),
            F.min(dated("structured")).alias("structured"),
            F.min(dated("snippet")).alias("hinted"),
            F.count(F.lit(1)).alias("copies"),
        )
    )
    hints = rows.where((F.col("date_source") == "snippet") & F.col("published").isNotNull()).join(heads.select(key, "structured"), key)
    far = (place > F.col("structured.p")) & (F.abs(F.datediff("published", F.col("structured.d"))) > CONFLICT_DAYS)
    conflicts = hints.where(far).groupBy(key).agg(F.min(F.struct(place.alias("p"), F.col("url").alias("url"))).alias("conflict"))
    seen = rows.groupBy(key, "provider").agg(F.min(place).alias("p")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("p", "provider"))).alias("seen"))
    other = rows.groupBy(key, "url").agg(F.min(place).alias("p")).join(heads.select(key, F.col("first.url").alias("_kept")), key).where(F.col("url") != F.col("_kept"))
    # the first of each of 64 parts, then of those: no task holds all addresses of a key
    near = other.withColumn("_rn", F.row_number().over(Window.partitionBy(key, F.pmod(F.xxhash64("url"), F.lit(64))).orderBy("p", "url"))).where(F.col("_rn") <= MOST_LISTED)
    listed = near.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct("p", "url"))), 1, MOST_LISTED).alias("others"))
    out = heads.join(conflicts, key, "left").join(seen, key, "left").join(listed, key, "left")
    return out.select(
        key,
        F.col("first.p").alias(position),
        F.col("first.url").alias("url"),
        F.col("spoken.s").alias("snippet"),
        F.coalesce("structured.d", "hinted.d").alias("published"),
        F.when(F.col("structured").isNotNull(), "structured").when(F.col("hinted").isNotNull(), "snippet").otherwise("none").alias("date_source"),
        F.col("conflict.url").alias("conflicting_url"),
        F.transform("seen", lambda x: x["provider"]).alias("providers"),
        F.coalesce(F.transform("others", lambda x: x["url"]), F.array().cast("array<string>")).alias("duplicates"),
        "copies",
    )


def survivors(nodes: DataFrame, links: DataFrame, node: str = "id", rounds: int = 200) -> DataFrame:
    """(node, survivor): the greedy collapse in order of ``node``.

    Each node, in order, joins its first earlier survivor that it is linked with,
    or survives itself; it isn't compared with nodes that were collapsed. In each
    round the nodes without an undecided earlier neighbour are decided, so rounds
    are as many as the longest chain, not as nodes. ``links`` has (a, b), in
    either order, any number of times.
    """
    pairs = checkpointed(links.select(F.greatest("a", "b").alias("late"), F.least("a", "b").alias("early")).where("late <> early").distinct())
    decided = None
    open_ = pairs
    waiting = checkpointed(pairs.select(F.col("late").alias("n")).distinct())
    alone = nodes.select(F.col(node).alias("n")).distinct().join(waiting, "n", "left_anti").select("n", F.col("n").alias("survivor"))
    decided = checkpointed(alone)
    for _ in range(rounds):
        if waiting.isEmpty():
            break
        state = open_.join(decided.select(F.col("n").alias("early"), "survivor"), "early", "left")
        told = state.groupBy("late").agg(F.min(F.when(F.col("survivor") == F.col("early"), F.col("early"))).alias("kept"), F.min(F.when(F.col("survivor").isNull(), F.col("early"))).alias("open"))
        # decided where the first surviving neighbour stands before any that is open, or none is open
        ready = F.col("open").isNull() | (F.col("kept") < F.col("open"))
        now = checkpointed(told.where(ready).select(F.col("late").alias("n"), F.coalesce("kept", "late").alias("survivor")))
        decided = checkpointed(decided.union(now))
        waiting = checkpointed(waiting.join(now, "n", "left_anti"))
        open_ = open_.join(waiting.withColumnRenamed("n", "late"), "late", "left_semi")
    else:
        raise RuntimeError("survivors did not settle")
    return decided.select(F.col("n").alias(node), "survivor")


def bounded_menu(rows: DataFrame, primary: tuple[str, ...], key: str = "url_key", family: str = "family", position: str = "position", limit: int = 15, most_primary: int = 10, most_other: int = 3, all_other: int = 6) -> DataFrame:
    """The first rows that fit a menu, with their place in it: one for each key, at
    most ``most_primary`` of a primary family and ``most_other`` of another,
    ``all_other`` of the others together, ``limit`` in all.

    A row of a full family doesn't take its key, so a later copy by another
    family may. Only rows that can matter come to the driver: of each family the
    first distinct keys, one for each place and each key another family may hold,
    and of families that aren't primary together as many.
    """
    own = rows.where(F.col(key) != "").groupBy(key, family).agg(F.min(position).alias(position))
    few = own.withColumn("_rn", F.row_number().over(Window.partitionBy(family).orderBy(position))).where(F.col("_rn") <= max(most_primary, most_other) + limit)
    lead = F.col(family).isin(*primary)
    some = few.where(lead).select(key, family, position).collect()
    some += few.where(~lead).orderBy(position).limit((all_other + limit) * (limit + 1)).select(key, family, position).collect()
    seen, counts, others, out = set(), {}, 0, []
    for r in sorted(some, key=lambda r: r[position]):
        first = r[family] in primary
        if r[key] in seen or counts.get(r[family], 0) >= (most_primary if first else most_other) or (not first and others >= all_other):
            continue
        seen.add(r[key])
        counts[r[family]] = counts.get(r[family], 0) + 1
        others += not first
        out.append((r[position], len(out) + 1))
        if len(out) == limit:
            break
    kept = rows.sparkSession.createDataFrame(out, f"{position} long, place int")
    return rows.join(F.broadcast(kept), position)


def title_words(title: Column) -> Column:
    """A title's folded words, joined by blanks, without the dots of a cut one."""
    plain = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"\s*(\.\.\.|…)\s*$", "")
    return F.array_join(F.regexp_extract_all(plain, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), " ")


def recovered(items: DataFrame, pool: DataFrame) -> DataFrame:
    """(item_id, url_key): the one address of the pool that is plainly an item's.

    Items have item_id, domain and title, the pool url and title. A row of the
    same host qualifies if the titles are equal or one of four words or more
    begins the other; two addresses that qualify are none. Titles meet by their
    first three words, or whole, so rows of one large host don't all meet.
    """
    words = lambda c: F.split(c, " ")
    lead = lambda c: F.when(F.size(words(c)) > 3, F.array_join(F.slice(words(c), 1, 3), " ")).otherwise(c)
    a = items.select("item_id", F.regexp_replace(F.lower("domain"), r"^www\.", "").alias("host"), title_words(F.col("title")).alias("wanted")).where("host <> '' and wanted <> ''")
    b = pool.select(urls.host(F.col("url")).alias("host"), title_words(F.col("title")).alias("other"), urls.url_key(F.col("url")).alias("url_key")).where("other <> ''").distinct()
    met = a.withColumn("lead", lead(F.col("wanted"))).join(b.withColumn("lead", lead(F.col("other"))), ["host", "lead"])
    short, long = F.when(F.length("wanted") <= F.length("other"), F.col("wanted")).otherwise(F.col("other")), F.when(F.length("wanted") <= F.length("other"), F.col("other")).otherwise(F.col("wanted"))
    fits = (F.col("wanted") == F.col("other")) | ((F.size(words(short)) >= 4) & F.startswith(long, short))
    return met.where(fits).groupBy("item_id").agg(F.min("url_key").alias("url_key"), F.max("url_key").alias("_last")).where("url_key = _last").select("item_id", "url_key")


def engine_name(route: Column) -> Column:
    """The engine behind a route's name: its way (browser, tls) doesn't count."""
    out = F.regexp_replace(route, "^searxng:", "")
    for prefix in ("web-browser-", "web-tls-", "web-", "tls-"):  # each at most once, in order
        out = F.regexp_replace(out, f"^{prefix}", "")
    return out


def variants_merged(rows: DataFrame, key: str, variant: str, route: str, position: str) -> DataFrame:
    """(key, position, variants, engines, score) over the results of several
    wordings of a query: a point for each engine, half for each further wording."""
    own = rows.groupBy(key).agg(F.min(position).alias(position), F.count_distinct(variant).alias("variants"), F.count_distinct(engine_name(F.col(route))).alias("engines"))
    return own.withColumn("score", F.round(F.col("engines") + 0.5 * (F.col("variants") - 1), 3))


def supplemented(pool: DataFrame, corpus: DataFrame, key: str = "url") -> DataFrame:
    """The pool and the corpus rows whose address it lacks, marked."""
    extra = corpus.join(pool.select(key).distinct(), key, "left_anti")
    return pool.withColumn("from_corpus", F.lit(False)).unionByName(extra.withColumn("from_corpus", F.lit(True)), allowMissingColumns=True)


def blended(rows: DataFrame, bucket: Column, position: str) -> DataFrame:
    """``rows`` with (turn, bucket): their order when buckets take turns."""
    from .order import numbered_within

    return numbered_within(rows.withColumn("bucket", bucket), "bucket", [F.col(position).asc()], "turn")


def engine_order(rows: DataFrame, engine: str, position: str, demoted: DataFrame) -> DataFrame:
    """``rows`` with (late, turn): engines take turns, those of ``demoted`` follow
    whole, one after the other; no row is dropped."""
    from .order import numbered_within

    placed = numbered_within(rows, engine, [F.col(position).asc()], "turn")
    back = demoted.select(F.col(engine), F.lit(1).alias("late")).distinct()
    return placed.join(back, engine, "left").withColumn("late", F.coalesce("late", F.lit(0)))


def select_sources(rows: DataFrame, key: str, host: str, rank: str, query: str, limit: int, per_host: int = 2) -> DataFrame:
    """At most ``limit`` sources, by rank and then query: first no more than
    ``per_host`` of a host, then those passed over. A key's first row stands for it."""
    first = rows.groupBy(key).agg(F.min(F.struct(rank, query, host)).alias("x")).select(key, F.col(f"x.{rank}").alias(rank), F.col(f"x.{query}").alias(query), F.col(f"x.{host}").alias(host))
    # no host can give more rows than there is room for
    few = first.withColumn("_rn", F.row_number().over(Window.partitionBy(host).orderBy(rank, query, key))).where(F.col("_rn") <= limit + per_host)
    lead = few.where(F.col("_rn") <= per_host).orderBy(rank, query, key).limit(limit)
    left = few.join(lead.select(key), key, "left_anti")
    both = lead.withColumn("deferred", F.lit(0)).unionByName(left.withColumn("deferred", F.lit(1)))
    return both.orderBy("deferred", rank, query, key).limit(limit).drop("_rn")
