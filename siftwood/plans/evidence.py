"""Queries over search rows, reads, caches and corpora, and the SQL that gives the same rows.

Search rows are pages with the document and event of the same number: its source
is the provider, its text the snippet, the event's time and kind the date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwood.functions import dates, urls
from siftwood.functions import pages as P
from siftwood.functions import text as X
from siftwood.operators import dedupe, merge, metadata, order, store
from siftwood.plans.catalogue import _TITLE, _URL_CTE, NOW, ORACLES, QUERIES, now, query
from siftwood.session import checkpointed, drop_stored, stored
from siftwood.sources import table

__all__ = ["ORACLES", "QUERIES"]

_NOW = f"TIMESTAMP '{NOW}'"
_ROWS = _URL_CTE + ", rows AS (SELECT page_id AS position, k.url, key AS url_key, host, source AS provider, lang, substr(text, 1, 200) AS snippet, CASE WHEN event_type IN ('purchase', 'view', 'click') THEN ts::DATE END AS published, CASE WHEN event_type = 'purchase' THEN 'structured' WHEN event_type IN ('view', 'click') THEN 'snippet' ELSE 'none' END AS date_source, event_type, ts, value FROM k JOIN documents ON doc_id = page_id JOIN events ON event_id = page_id)"


def rows(spark, sf_dir) -> DataFrame:
    pages, docs, events = (table(spark, sf_dir, t) for t in ("pages", "documents", "events"))
    both = pages.join(docs, F.col("page_id") == F.col("doc_id")).join(events, F.col("page_id") == F.col("event_id"))
    u, kind = F.col("url"), F.col("event_type")
    return both.select(
        F.col("page_id").alias("position"),
        "url",
        urls.url_key(u).alias("url_key"),
        urls.host(u).alias("host"),
        F.col("source").alias("provider"),
        "lang",
        F.substring("text", 1, 200).alias("snippet"),
        F.when(kind.isin("purchase", "view", "click"), F.to_date("ts")).alias("published"),
        F.when(kind == "purchase", "structured").when(kind.isin("view", "click"), "snippet").otherwise("none").alias("date_source"),
        "event_type",
        "ts",
        "value",
    )


# --- merges and menus ---------------------------------------------------------------------------


@query(
    _ROWS
    + """, mr AS (SELECT *, host AS k FROM rows),
mf AS (SELECT k, min(position) AS position, arg_min(url, position) AS url, arg_min(snippet, position) FILTER (trim(snippet) <> '') AS snippet,
  min(position) FILTER (date_source = 'structured') AS sp, arg_min(published, position) FILTER (date_source = 'structured') AS sd, arg_min(published, position) FILTER (date_source = 'snippet') AS hd, count(*) AS copies FROM mr GROUP BY k),
mc AS (SELECT r.k, arg_min(r.url, r.position) AS conflicting_url FROM mr r JOIN mf f USING (k) WHERE date_source = 'snippet' AND r.position > sp AND abs(date_diff('day', sd, published)) > 7 GROUP BY r.k),
mp AS (SELECT k, string_agg(provider, ',' ORDER BY p) AS providers FROM (SELECT k, provider, min(position) AS p FROM mr GROUP BY k, provider) GROUP BY k),
md AS (SELECT k, array_to_string(list_slice(list(url ORDER BY p), 1, 8), ',') AS duplicates FROM (SELECT r.k, r.url, min(r.position) AS p FROM mr r JOIN mf f USING (k) WHERE r.url <> f.url GROUP BY r.k, r.url) GROUP BY k)
SELECT k AS host, position, url, md5(snippet) AS snippet, coalesce(sd, hd) AS published, CASE WHEN sd IS NOT NULL THEN 'structured' WHEN hd IS NOT NULL THEN 'snippet' ELSE 'none' END AS date_source, conflicting_url, providers, coalesce(duplicates, '') AS duplicates, copies FROM mf LEFT JOIN mc USING (k) LEFT JOIN mp USING (k) LEFT JOIN md USING (k)"""
)
def merged_rows(spark, sf_dir):
    """Search rows folded by host: dates by precedence, conflicts, providers, other addresses."""
    found = merge.merge_by_key(rows(spark, sf_dir), "host")
    return found.select("host", "position", "url", F.md5("snippet").alias("snippet"), "published", "date_source", "conflicting_url", F.array_join("providers", ",").alias("providers"), F.array_join("duplicates", ",").alias("duplicates"), "copies")


_MENU = """, n AS (SELECT *, row_number() OVER (ORDER BY position) AS i FROM (SELECT position, host AS url_key, CASE WHEN provider IN ('src0', 'src1') THEN provider ELSE 'other-' || lang END AS family FROM rows)),
walk(i, keys, fams, others, taken) AS (
  SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[], 0, NULL::BIGINT
  UNION ALL
  SELECT n.i, CASE WHEN ok THEN list_append(keys, url_key) ELSE keys END, CASE WHEN ok THEN list_append(fams, family) ELSE fams END, others + CASE WHEN ok AND NOT lead THEN 1 ELSE 0 END, CASE WHEN ok THEN position END
  FROM (SELECT n.*, w.keys, w.fams, w.others, n.family IN ('src0', 'src1') AS lead,
    NOT list_contains(w.keys, n.url_key) AND len(list_filter(w.fams, lambda x: x = n.family)) < CASE WHEN n.family IN ('src0', 'src1') THEN 10 ELSE 3 END AND (n.family IN ('src0', 'src1') OR w.others < 6) AND len(w.keys) < 15 AS ok
    FROM walk w JOIN n ON n.i = w.i + 1) n)"""


@query(_ROWS.replace("WITH p0", "WITH RECURSIVE p0", 1) + _MENU + " SELECT taken AS position, row_number() OVER (ORDER BY taken)::INTEGER AS place FROM walk WHERE taken IS NOT NULL")
def bounded_menu(spark, sf_dir):
    """The first rows that fit a menu: one a host, ten of a leading provider, three of another family, six of those."""
    found = rows(spark, sf_dir).select("position", F.col("host").alias("url_key"), F.when(F.col("provider").isin("src0", "src1"), F.col("provider")).otherwise(F.concat(F.lit("other-"), F.col("lang"))).alias("family"))
    return merge.bounded_menu(found, ("src0", "src1")).select("position", "place")


@query()
def greedy_collapse(spark, sf_dir):
    """Each document and the earlier one it was folded into: same text or shingles 0.65
    alike, compared with survivors only, in order."""
    prints = stored(dedupe.fingerprints(table(spark, sf_dir, "documents"), "doc_id", "text"))
    near = dedupe.near_pairs(prints).select("a", "b")
    same = checkpointed(dedupe.shingle_representatives(prints))
    drop_stored(prints)
    # copies follow their first; only firsts are compared
    kept = merge.survivors(same.select(F.col("id")).distinct(), near)
    return same.join(kept, "id").select("doc_id", "survivor")


@query(_URL_CTE + rf", t AS (SELECT k.page_id, host, key, array_to_string(regexp_extract_all(lower(trim(regexp_replace({_TITLE}, '\s+', ' ', 'g'))), '[\p{{L}}\p{{N}}]+'), ' ') AS title FROM k JOIN pages USING (page_id)), i AS (SELECT page_id AS item_id, host, array_to_string(list_slice(string_split(title, ' '), 1, 5), ' ') AS wanted FROM t), m AS (SELECT item_id, key FROM i JOIN t USING (host) WHERE wanted <> '' AND title <> '' AND (wanted = title OR (len(string_split(CASE WHEN length(wanted) <= length(title) THEN wanted ELSE title END, ' ')) >= 4 AND starts_with(CASE WHEN length(wanted) <= length(title) THEN title ELSE wanted END, CASE WHEN length(wanted) <= length(title) THEN wanted ELSE title END)))) SELECT item_id, min(key) AS url_key FROM m GROUP BY item_id HAVING count(DISTINCT key) = 1")
def recovered_destinations(spark, sf_dir):
    """Results listed with a cut title and a host only, and the one page that each plainly is."""
    titled = table(spark, sf_dir, "pages").select("page_id", "url", P.listed_title(F.col("html")).alias("title"))
    cut = F.array_join(F.slice(F.split(merge.title_words(F.col("title")), " "), 1, 5), " ")
    items = titled.select(F.col("page_id").alias("item_id"), urls.host(F.col("url")).alias("domain"), cut.alias("title"))
    return merge.recovered(items, titled.select("url", "title"))


@query("WITH r AS (SELECT doc_id AS position, md5(text) AS key, lang, CASE lang WHEN 'en' THEN 'web-tls-' WHEN 'fr' THEN 'web-' WHEN 'de' THEN 'web-browser-' ELSE '' END || source AS route FROM documents) SELECT key, min(position) AS position, count(DISTINCT lang) AS variants, count(DISTINCT regexp_replace(route, '^(web-tls-|web-browser-|web-)', '')) AS engines, round(count(DISTINCT regexp_replace(route, '^(web-tls-|web-browser-|web-)', '')) + 0.5::DOUBLE * (count(DISTINCT lang) - 1), 3) AS score FROM r GROUP BY key")
def variants_consensus(spark, sf_dir):
    """Texts found by several engines, whatever their route, and in several wordings."""
    route = F.concat(F.when(F.col("lang") == "en", "web-tls-").when(F.col("lang") == "fr", "web-").when(F.col("lang") == "de", "web-browser-").otherwise(""), F.col("source"))
    found = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("position"), F.md5("text").alias("key"), "lang", route.alias("route"))
    return merge.variants_merged(found, "key", "lang", "route", "position")


@query(_URL_CTE + "SELECT url, host LIKE '%.com' = FALSE AS from_corpus FROM k")
def supplemented_pool(spark, sf_dir):
    """Pages of .com hosts as the pool, all pages as the corpus: those it lacks are added."""
    pages = table(spark, sf_dir, "pages").select("url")
    return merge.supplemented(pages.where(urls.host(F.col("url")).endswith(".com")), pages)


@query(_ROWS + " SELECT position, provider, event_type AS bucket, row_number() OVER (PARTITION BY event_type ORDER BY position) AS turn FROM rows")
def news_blend(spark, sf_dir):
    """Rows and the turn of their bucket: buckets take turns in order (turn, bucket)."""
    return merge.blended(rows(spark, sf_dir).select("position", "provider", "event_type"), F.col("event_type"), "position").select("position", "provider", "bucket", "turn")


@query(_ROWS + ", e AS (SELECT provider, avg(CASE WHEN event_type IN ('purchase', 'view') THEN 1.0 ELSE 0.0 END) AS y, count(*) AS n FROM rows GROUP BY provider), b AS (SELECT provider FROM e WHERE n >= 3 AND y < 0.5 * (SELECT max(y) FROM e WHERE n >= 3)) SELECT position, provider, row_number() OVER (PARTITION BY provider ORDER BY position) AS turn, (provider IN (SELECT provider FROM b))::INTEGER AS late FROM rows")
def engine_order(spark, sf_dir):
    """Rows in turns of their providers; those of providers that yield less than half of the best follow."""
    found = rows(spark, sf_dir).select("position", "provider", "event_type")
    yields = found.groupBy("provider").agg(F.avg(F.when(F.col("event_type").isin("purchase", "view"), 1.0).otherwise(0.0)).alias("y"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    best = yields.agg(F.max("y").alias("best"))  # one row
    demoted = yields.crossJoin(F.broadcast(best)).where("y < 0.5 * best").select("provider")
    return merge.engine_order(found, "provider", "position", demoted).select("position", "provider", "turn", "late")


@query(_ROWS + ", f AS (SELECT url_key, min({'rank': position, 'query': provider, 'host': host}) AS x FROM rows GROUP BY url_key), g AS (SELECT url_key, x.rank AS rank, x.query AS query, x.host AS host, row_number() OVER (PARTITION BY x.host ORDER BY x.rank, x.query, url_key) AS rn FROM f), lead AS (SELECT * FROM g WHERE rn <= 2 ORDER BY rank, query, url_key LIMIT 20), b AS (SELECT *, 0 AS deferred FROM lead UNION ALL SELECT *, 1 FROM g WHERE url_key NOT IN (SELECT url_key FROM lead)) SELECT url_key, rank, query, host, deferred FROM b ORDER BY deferred, rank, query, url_key LIMIT 20")
def selected_sources(spark, sf_dir):
    """Twenty sources, two a host, filled up with those passed over."""
    found = rows(spark, sf_dir).select("url_key", F.col("position").alias("rank"), F.col("provider").alias("query"), "host")
    return merge.select_sources(found, "url_key", "host", "rank", "query", 20)


@query(_ROWS + r", t AS (SELECT position, ts, CASE WHEN regexp_matches(url, '^https?://[^/]*(/[^/?#]{0,24}/?)?([?#]|$)') OR contains(url, '/topics/') THEN 3 WHEN date_source = 'none' THEN 1 WHEN epoch_us(" + _NOW + ") - epoch_us(ts) <= 7 * 86400e6 THEN 0 ELSE 2 END AS tier FROM rows) SELECT position, tier, row_number() OVER (ORDER BY tier, position) AS place FROM t")
def news_order(spark, sf_dir):
    """Fresh rows, undated ones, stale ones, then front pages; the order kept within each."""
    tier = P.news_tier(F.col("url"), F.lit(""), F.when(F.col("date_source") != "none", F.col("ts").cast("timestamp")), now())
    tiered = rows(spark, sf_dir).select("position", tier.alias("tier"))
    return order.numbered(tiered, [F.col("tier").asc(), F.col("position").asc()], "place")


# --- addresses ----------------------------------------------------------------------------------


@query(r"SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '^(https?://[^/?#]+)$', '\1/') AS crawl, regexp_replace(regexp_replace(url, '#.*$', ''), '^(https?://[^/?#]+)$', '\1/') AS corpus, NOT contains(url, '#') AS public FROM pages UNION ALL SELECT page_id + 1000000, NULL, NULL, FALSE FROM pages UNION ALL SELECT page_id + 2000000, regexp_replace(url, '[?#].*$', '') || '?api_key=1', NULL, TRUE FROM pages UNION ALL SELECT page_id + 3000000, 'http://192.168.0.' || (page_id % 200) || '/', 'http://192.168.0.' || (page_id % 200) || '/', FALSE FROM pages")
def address_rules(spark, sf_dir):
    """Crawl and corpus addresses and public targets: pages' own, with credentials, with a key, and inner hosts."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    bare = F.regexp_replace("url", "[?#].*$", "")
    variants = pages.union(pages.select(F.col("page_id") + 1_000_000, F.regexp_replace("url", "://", "://user:pass@")))
    variants = variants.union(pages.select(F.col("page_id") + 2_000_000, F.concat(bare, F.lit("?api_key=1")))).union(pages.select(F.col("page_id") + 3_000_000, F.concat(F.lit("http://192.168.0."), (F.col("page_id") % 200).cast("string"), F.lit("/"))))
    u = F.col("url")
    return variants.select("page_id", urls.crawl_url(u).alias("crawl"), urls.corpus_url(u).alias("corpus"), urls.is_public(u).alias("public"))


@query(r"SELECT page_id, url AS by_parameter, url AS by_base64, split_part(url, '/R', 1) AS by_path, url AS plain FROM pages")
def redirect_targets(spark, sf_dir):
    """Addresses wrapped in three kinds of redirects, and unwrapped again."""
    u = F.col("url")
    coded = F.rtrim(F.translate(F.base64(F.encode(u, "UTF-8")), "+/", "-_"), F.lit("="))
    ways = {
        "by_parameter": F.concat(F.lit("https://www.bing.com/news/apiclick.aspx?ref=x&url="), F.url_encode(u)),
        "by_base64": F.concat(F.lit("https://www.bing.com/ck/a?p=1&u=a1"), F.regexp_replace(coded, r"\s", "")),
        "by_path": F.concat(F.lit("https://r.search.yahoo.com/_ylt=1/RU="), F.url_encode(u), F.lit("/RK=2/RS=3")),
        "plain": u,
    }
    return table(spark, sf_dir, "pages").select("page_id", *[urls.unwrapped(w).alias(k) for k, w in ways.items()])


@query("SELECT page_id, left(md5(url), 11) AS watch, left(md5(url), 11) AS short, left(md5(url), 11) AS embed, '' AS other FROM pages")
def video_ids(spark, sf_dir):
    one = F.substring(F.md5("url"), 1, 11)
    ways = {"watch": ("https://www.youtube.com/watch?t=1&v=", "&x=2"), "short": ("https://youtu.be/", "/?t=1"), "embed": ("https://m.youtube.com/embed/", ""), "other": ("https://example.com/watch?v=", "")}
    return table(spark, sf_dir, "pages").select("page_id", *[urls.video_id(F.concat(F.lit(a), one, F.lit(b))).alias(k) for k, (a, b) in ways.items()])


@query(_URL_CTE + "SELECT page_id, TRUE AS plain, FALSE AS with_scheme, FALSE AS with_port, regexp_matches(host, '^[a-z0-9.-]+$') AS starred FROM k".replace("regexp_matches(host, '^[a-z0-9.-]+$') AS starred", "FALSE AS starred"))
def hostnames(spark, sf_dir):
    h = urls.host(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", urls.is_hostname(h).alias("plain"), urls.is_hostname(F.col("url")).alias("with_scheme"), urls.is_hostname(F.concat(h, F.lit(":80"))).alias("with_port"), urls.is_hostname(F.concat(F.lit("*."), h)).alias("starred"))


@query(_URL_CTE + "SELECT page_id, key AS own, NULL AS elsewhere, 'https://' || regexp_replace(h1, ':(80|443)?$', '') || '/other' AS relative FROM k")
def declared_keys(spark, sf_dir):
    """Declared addresses count where they are on the page's own site."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.declared_key(u, u).alias("own"), urls.declared_key(u, F.lit("https://elsewhere.test/x")).alias("elsewhere"), urls.declared_key(u, F.lit("/other")).alias("relative"))


# --- dates --------------------------------------------------------------------------------------


@query("SELECT event_id, date_trunc('second', ts) AS mail, date_trunc('second', ts) AS zoned, date_trunc('second', ts) AS iso, date_trunc('day', ts) AS day, date_trunc('day', ts) AS written, date_trunc('day', ts) AS american FROM events")
def parsed_dates(spark, sf_dir):
    """Every event's time written in the forms that feeds and engines send, and read again."""
    t = F.col("ts")
    later = F.timestampadd("HOUR", F.lit(2), t) if hasattr(F, "timestampadd") else t + F.expr("INTERVAL 2 HOURS")
    ways = {
        "mail": F.date_format(t, "EEE, dd MMM yyyy HH:mm:ss 'GMT'"),
        "zoned": F.date_format(later, "dd MMM yyyy HH:mm:ss '+0200'"),
        "iso": F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
        "day": F.date_format(t, "yyyy-MM-dd"),
        "written": F.concat(F.lit("Published on "), F.date_format(t, "d MMMM yyyy"), F.lit(" in full")),
        "american": F.date_format(t, "MMM d, yyyy"),
    }
    return table(spark, sf_dir, "events").select("event_id", *[dates.parse_date(w).cast("timestamp_ntz").alias(k) for k, w in ways.items()])


@query("WITH e AS (SELECT event_id, event_type, CASE WHEN event_type IN ('purchase', 'signup') THEN ts::DATE END AS given, CASE WHEN event_type IN ('view', 'click') THEN ts::DATE END AS said FROM events) SELECT event_id, given AS published_at, strftime(said, '%Y-%m-%d') AS hint, NULL AS rejected, CASE WHEN given IS NOT NULL THEN CASE WHEN event_type = 'signup' THEN 'page' ELSE 'structured' END WHEN said IS NOT NULL THEN 'snippet' ELSE 'none' END AS source FROM e UNION ALL SELECT event_id + 100000000, NULL, NULL, 'future', 'structured' FROM events")
def date_fields(spark, sf_dir):
    """Publication dates, hints from snippets, and dates that lie ahead (each event's again, a year on)."""
    day = F.date_format("ts", "yyyy-MM-dd")
    kind = F.col("event_type")
    own = table(spark, sf_dir, "events").select("event_id", F.when(kind.isin("purchase", "signup"), day).alias("published"), F.when(kind == "signup", "page").alias("declared"), F.when(kind.isin("view", "click"), F.concat(F.lit("seen "), day)).alias("snippet"))
    ahead = table(spark, sf_dir, "events").select(F.col("event_id") + 100_000_000, F.date_format(F.col("ts") + F.expr("INTERVAL 1 YEAR"), "yyyy-MM-dd"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    found = own.union(ahead).withColumn("p", dates.provenance(F.col("published"), F.col("declared"), F.col("snippet")))
    fields = dates.public_fields(F.col("p"), now())
    return found.select("event_id", fields["published_at"].alias("published_at"), fields["hint"].alias("hint"), fields["rejected"].alias("rejected"), F.col("p.source").alias("source"))


@query("SELECT count(*) FILTER (event_type = 'purchase') AS provider, count(*) FILTER (event_type = 'signup') AS page, count(*) FILTER (event_type IN ('view', 'click')) AS snippet, count(*) FILTER (event_type = 'error') AS none FROM events")
def date_coverage(spark, sf_dir):
    """How rows are dated: by the provider, the page, a snippet, or not."""
    found = date_fields(spark, sf_dir).where("rejected is null")
    return found.agg(*[F.count_if(F.col("source") == s).alias(n) for n, s in (("provider", "structured"), ("page", "page"), ("snippet", "snippet"), ("none", "none"))])


# --- caches, corpora, queues --------------------------------------------------------------------

_ENTRY = "SELECT event_id AS key, CASE event_type WHEN 'view' THEN 'search' WHEN 'click' THEN 'news' WHEN 'purchase' THEN 'extract' ELSE 'other' END AS kind, (value * 100)::BIGINT AS bytes, ts FROM events"


def _entries(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "search").when(F.col("event_type") == "click", "news").when(F.col("event_type") == "purchase", "extract").otherwise("other")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), kind.alias("kind"), F.round(F.col("value") * 100).cast("long").alias("bytes"), F.col("ts").cast("timestamp").alias("ts"))


_THEN = "TIMESTAMP '2024-01-20 00:00:00'"
_LIFE = "CASE kind WHEN 'search' THEN 21600 WHEN 'extract' THEN 1814400 WHEN 'fetch' THEN 1814400 WHEN 'news' THEN 1800 ELSE {} END"


@query(f"WITH e AS ({_ENTRY}) SELECT key, kind FROM e WHERE ts <= {_THEN} AND epoch_us({_THEN}) - epoch_us(ts) <= least({_LIFE.format(3600)}, 86400) * 1e6")
def cache_hits(spark, sf_dir):
    """Entries that a request may use: as old as their kind and the request (a day) allow."""
    then = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return store.cache_hits(_entries(spark, sf_dir).where(F.col("ts") <= then), then, 86_400).select("key", "kind")


@query(f"WITH e AS ({_ENTRY}), d AS (SELECT *, epoch_us({_NOW}) - epoch_us(ts) > {_LIFE.format(1814400)} * 1e6 AS dead FROM e), r AS (SELECT key, sum(bytes) OVER (ORDER BY ts DESC, key ROWS UNBOUNDED PRECEDING) AS held FROM d WHERE NOT dead) SELECT key, kind, bytes, CASE WHEN dead THEN 'expired' WHEN held <= 90000 THEN 'kept' ELSE 'evicted' END AS fate FROM d LEFT JOIN r USING (key)")
def cache_maintained(spark, sf_dir):
    """Expired entries, and of the others the newest that fill nine tenths of 100,000 bytes."""
    return store.maintained(_entries(spark, sf_dir), now(), 100_000).select("key", "kind", "bytes", "fate")


@query(
    _ROWS
    + """, d AS (SELECT position AS id, url, substr(snippet, 1, 80) AS title, snippet AS text, event_type, ts FROM rows),
a AS (SELECT *, CASE WHEN event_type = 'error' THEN 'public_provenance_required' WHEN event_type = 'signup' THEN 'ineligible_content' WHEN trim(text) = '' THEN 'empty_text' END AS reason, regexp_replace(regexp_replace(url, '#.*$', ''), '^(https?://[^/?#]+)$', '\\1/') AS address FROM d),
v AS (SELECT *, CASE WHEN reason IS NULL THEN sha256(address || chr(0) || sha256(text || chr(0) || title || chr(0) || 'lines-1')) END AS version FROM a),
l AS (SELECT address, arg_max(version, {'t': ts, 'v': version}) AS last FROM v WHERE reason IS NULL GROUP BY address)
SELECT id, reason, address, version, reason IS NULL AND version <> last AS superseded FROM v LEFT JOIN l USING (address)"""
)
def corpus_admission(spark, sf_dir):
    """Why rows may not enter the public corpus, their version ids, and which are superseded."""
    found = rows(spark, sf_dir).select(
        F.col("position").alias("id"),
        "url",
        F.substring("snippet", 1, 80).alias("title"),
        F.col("snippet").alias("text"),
        F.when(F.col("event_type") == "error", "private").otherwise("public").alias("visibility"),
        F.lit(False).alias("private"),
        F.when(F.col("event_type") == "signup", "thin").otherwise("ok").alias("quality"),
        F.lit("complete").alias("content_status"),
        "ts",
    )
    return store.admitted(found).select("id", "reason", "address", "version", F.coalesce("superseded", F.lit(False)).alias("superseded"))


@query(_ROWS + f", d AS (SELECT position AS id, host, ts + INTERVAL 31 DAY AS expires, event_type FROM rows), p AS (SELECT host, max(expires) AS latest FROM d WHERE event_type NOT IN ('error', 'signup') GROUP BY host) SELECT CASE WHEN expires <= {_NOW} THEN 'expired' WHEN event_type = 'signup' THEN 'private' WHEN event_type = 'error' THEN 'unknown_visibility' WHEN latest > expires THEN 'obsolete' ELSE 'accepted' END AS outcome, count(*) AS n FROM d LEFT JOIN p USING (host) GROUP BY 1")
def migration_outcomes(spark, sf_dir):
    """What becomes of retained documents when they are moved: a count for each outcome."""
    found = rows(spark, sf_dir).select(F.col("position").alias("id"), F.col("host").alias("url"), (F.col("ts") + F.expr("INTERVAL 31 DAYS")).cast("timestamp").alias("expires"), F.when(F.col("event_type") == "error", "unknown").otherwise("public").alias("visibility"), (F.col("event_type") == "signup").alias("private"))
    return store.migrated(found, now()).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH s AS (SELECT event_id AS id, event_type AS model, CASE WHEN value < 2 THEN 'failed' ELSE 'ready' END AS state, ts AS touched, 1 + event_id % 7 AS passages FROM events), y AS (SELECT *, (epoch_us({_NOW}) - epoch_us(touched)) / 86400e6 AS age FROM s), h AS (SELECT *, sum(passages) OVER (PARTITION BY model ORDER BY touched DESC, id ROWS UNBOUNDED PRECEDING) AS held FROM y WHERE age <= 20 AND (state NOT IN ('failed', 'superseded') OR age <= 7)) SELECT id, model FROM h WHERE held <= 1000")
def corpus_pruned(spark, sf_dir):
    """Sources that stay: young ones, failed ones for a week, and as many as a model's passages allow."""
    found = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("model"), F.when(F.col("value") < 2, "failed").otherwise("ready").alias("state"), F.col("ts").cast("timestamp").alias("touched"), (1 + F.col("event_id") % 7).alias("passages"))
    return store.pruned(found, now(), 20, 7, 1_000).select("id", "model")


@query("WITH d AS (SELECT doc_id, md5(text) AS digest, lang AS model FROM documents), v AS (SELECT vec_id AS id, digest, model FROM embeddings JOIN d ON doc_id = vec_id) SELECT doc_id, first AS reused_from FROM d LEFT JOIN (SELECT digest, model, min(id) AS first FROM v GROUP BY ALL) USING (digest, model)")
def reused_vectors(spark, sf_dir):
    """Documents and the vector that the same text has already, by the same model."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"), F.col("lang").alias("model"))
    vectors = table(spark, sf_dir, "embeddings").join(docs, F.col("vec_id") == F.col("doc_id")).select(F.col("vec_id").alias("id"), "digest", "model", F.col("embedding").alias("vector"))
    return store.with_reused(docs, vectors).select("doc_id", "reused_from")


_COSINE = "list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_inner_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))"


@query(f"WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0), m AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {_COSINE} AS s FROM q a JOIN embeddings b ON a.label = b.label AND b.vec_id % 50 <> 0) SELECT query_id, arg_min(id, {{'s': -s, 'i': id}}) AS id, round(max(s), 9) AS similarity FROM m WHERE s >= 0.55 GROUP BY query_id")
def semantic_nearest(spark, sf_dir):
    """The nearest cached query of the same context, 0.55 alike or more; every vector whose id is divisible by 50 asks."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("context"), F.col("embedding").alias("vector"))
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "context", "vector")
    cached = vectors.where("vec_id % 50 <> 0").select(F.col("vec_id").alias("id"), "context", "vector", now().alias("ts"))
    return store.nearest_cached(asked, cached, now(), -1).withColumn("similarity", F.round("similarity", 9))


@query("SELECT l.doc_id AS document_id, coalesce(d.source, 'unknown') AS namespace FROM labels l LEFT JOIN documents d USING (doc_id)")
def namespace_repair(spark, sf_dir):
    sources = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"), F.lit("unknown").alias("namespace"))
    return store.repaired(sources, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("namespace"))).select("document_id", "namespace")


@query("SELECT DISTINCT user_id AS engine FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND epoch_us(TIMESTAMP '2024-01-30 00:00:00') - epoch_us(ts) < 6 * 3600e6)")
def rested_engines(spark, sf_dir):
    """Engines without a failure in the last six hours."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("engine"), "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return store.rested(events.select("engine").distinct(), events.where("event_type = 'error'"), F.lit("2024-01-30 00:00:00").cast("timestamp"), 6 * 3600)


@query("WITH a AS (SELECT conv_id AS query_id, role AS provider, turn AS provider_order, length(text) AS results, text LIKE '%the%' AS decoy FROM conversations) SELECT query_id, arg_min(provider, provider_order) FILTER (results > 0 AND NOT decoy) AS provider, count(*) FILTER (results > 0 AND NOT decoy) AS usable, count(*) AS offered FROM a GROUP BY query_id")
def provider_fallback(spark, sf_dir):
    """The first provider of each query whose answer is neither empty nor a decoy."""
    answers = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("role").alias("provider"), F.col("turn").alias("provider_order"), F.length("text").alias("results"), F.col("text").contains("the").alias("decoy"))
    return store.first_provider(answers)


@query("SELECT event_id, 'k' AS name, json_extract_string(props, '$.k') AS value FROM events")
def attempts_flattened(spark, sf_dir):
    return store.flattened(table(spark, sf_dir, "events"), "event_id", "props")


@query(f"WITH j AS (SELECT event_id AS id, CASE WHEN event_type IN ('error', 'view') THEN 'pending' ELSE 'running' END AS state, event_id % 4 AS attempts, ts AS available, ts + INTERVAL 2 MINUTE AS lease FROM events) SELECT id FROM j WHERE attempts < 3 AND ((state = 'pending' AND available <= {_THEN}) OR (state = 'running' AND lease < {_THEN}))")
def claimable_jobs(spark, sf_dir):
    jobs = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type").isin("error", "view"), "pending").otherwise("running").alias("state"), (F.col("event_id") % 4).alias("attempts"), F.col("ts").cast("timestamp").alias("available"), (F.col("ts").cast("timestamp") + F.expr("INTERVAL 2 MINUTES")).alias("lease"))
    return store.claimable(jobs, F.lit("2024-01-20 00:00:00").cast("timestamp")).select("id")


@query("WITH o AS (SELECT event_id AS id, user_id AS provider, CASE WHEN event_type = 'view' THEN 'cached' ELSE event_type END AS status, ts, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events) SELECT provider, arg_max(status, {'t': ts, 'i': id}) AS status, max(ts) AS ts FROM o WHERE status <> 'cached' OR gap IS NULL OR gap >= 3600e6 GROUP BY provider")
def last_observations(spark, sf_dir):
    """What was last seen of each provider; a cached answer within the hour doesn't count."""
    seen = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("provider"), F.when(F.col("event_type") == "view", "cached").otherwise(F.col("event_type")).alias("status"), F.col("ts").cast("timestamp").alias("ts"))
    return store.last_observations(seen, 3600).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# --- classifiers --------------------------------------------------------------------------------


@query("SELECT event_id, CASE event_type WHEN 'view' THEN NULL WHEN 'error' THEN 'timeout' WHEN 'click' THEN 'blocked' WHEN 'signup' THEN 'wall:login' ELSE 'challenge' END AS kind, event_type = 'error' AS refusal FROM events")
def failure_kinds(spark, sf_dir):
    e = F.col("event_type")
    tier, outcome = F.when(e == "signup", "headed").otherwise("direct"), F.when(e == "view", "extracted").when(e == "purchase", "challenge").otherwise("failed")
    reason = F.when(e == "error", "ReadTimeout").when(e == "click", "http_403").when(e == "signup", "challenge_unresolved:login").otherwise("")
    return table(spark, sf_dir, "events").select("event_id", P.failure_kind(tier, outcome, reason).alias("kind"), (P.is_refusal(reason) & (e == "error")).alias("refusal"))


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 'blocked' WHEN quality = 0 THEN 'failed' WHEN lang <> 'en' THEN 'partial' ELSE 'usable' END AS outcome, CASE WHEN toxic = 1 OR quality = 1 THEN FALSE ELSE TRUE END AS retryable FROM labels JOIN documents USING (doc_id)")
def resolve_outcomes(spark, sf_dir):
    read = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    text, status = F.when(F.col("quality") == 0, F.lit("")).otherwise(F.lit("text")), F.when(F.col("quality") == 0, 503).otherwise(200)
    outcome = P.resolve_outcome(F.col("toxic") == 1, text, F.lit(False), status, F.when(F.col("lang") == "en", "ok").otherwise("thin"), F.lit(False))
    return read.select("doc_id", outcome.alias("outcome"), P.retryable(outcome, status).alias("retryable"))


@query("WITH t AS (SELECT doc_id, lang, source, length(text) AS n FROM documents) SELECT doc_id, CASE WHEN n + 30 < 1000 AND lang = 'fr' THEN 'generic' WHEN n + 30 < 1000 AND lang = 'de' THEN 'cloudflare' ELSE '' END AS challenge, n > 0 AND n < 2048 AND source = 'src1' AS shell FROM t")
def page_challenges(spark, sf_dir):
    """Challenge pages made of documents: a French one opens with a prompt, a German one has a vendor's marks and title."""
    lang, text = F.col("lang"), F.col("text")
    # white space that folding drops is made up for, so that lengths are the texts'
    visible = F.when(lang == "fr", F.concat(F.rpad(F.lit("checking your browser"), 30, "."), F.regexp_replace(text, r"\s", "_"))).otherwise(F.concat(F.rpad(F.lit("page"), 30, "."), F.regexp_replace(text, r"\s", "_")))
    title, marks = F.when(lang == "de", "Just a moment...").otherwise("A page"), F.when(lang == "de", '<div class="cf-challenge">').otherwise("<p>")
    shell = P.is_shell(F.lit("direct"), F.length(text), F.when(F.col("source") == "src1", F.length(text) * 20).otherwise(F.length(text) * 19))
    return table(spark, sf_dir, "documents").select("doc_id", P.challenge(title, visible, marks).alias("challenge"), shell.alias("shell"))


@query(_ROWS + ", s AS (SELECT position, host, value, max(value) OVER () AS best FROM rows) SELECT position, CASE WHEN value / best >= 0.6 THEN 'high' WHEN value / best <= 0.15 THEN 'low' WHEN host LIKE '%docs.%' OR host LIKE '%developer.%' THEN 'high' ELSE 'medium' END AS relevance FROM s")
def fetch_relevance(spark, sf_dir):
    found = rows(spark, sf_dir).select("position", "url", "value")
    best = found.agg(F.max("value").alias("best"))  # one row
    return found.crossJoin(F.broadcast(best)).select("position", P.fetch_relevance(F.col("value"), F.col("best"), F.lit(1), F.col("url")).alias("relevance"))


@query(_URL_CTE + "SELECT page_id, CASE WHEN regexp_matches(p, '(?i)(^|[/_-])live([/_-]|$)|live-?(updates|blog|news)') THEN 'live' WHEN len(list_filter(string_split(p, '/'), lambda x: x <> '')) = 0 OR (len(list_filter(string_split(p, '/'), lambda x: x <> '')) = 1 AND length(list_filter(string_split(p, '/'), lambda x: x <> '')[1]) <= 24) THEN 'hub' ELSE 'stable' END AS volatility, CASE WHEN regexp_matches(p, '(?i)(^|[/_-])live([/_-]|$)|live-?(updates|blog|news)') THEN 300 WHEN len(list_filter(string_split(p, '/'), lambda x: x <> '')) <= 1 THEN 900 ELSE 3600 END AS seconds FROM k")
def page_volatility(spark, sf_dir):
    """How fast pages change, and how long a limited read of them may be served."""
    kind = P.volatility(F.col("url"), F.lit("text/html"), F.lit(False))
    return table(spark, sf_dir, "pages").select("page_id", kind.alias("volatility"), P.lifetime(kind, F.lit(True)).alias("seconds"))


@query("SELECT doc_id, CASE WHEN source = 'src3' THEN 'document' WHEN lang = 'es' THEN 'list' WHEN text = '' THEN 'unreadable' ELSE 'article' END AS type, CASE WHEN lang = 'de' THEN 'thin' WHEN lang = 'es' THEN 'navigation_only' WHEN source = 'src3' THEN 'partial_capture' ELSE '' END AS gap FROM documents")
def page_types(spark, sf_dir):
    lang, source = F.col("lang"), F.col("source")
    status = F.when(lang == "es", "navigation_only").otherwise("complete")
    return table(spark, sf_dir, "documents").select("doc_id", P.page_type(F.when(source == "src3", "application/pdf").otherwise("text/html"), status, F.lit("ok"), F.col("text")).alias("type"), P.reading_gap(F.when(lang == "de", "thin").otherwise("ok"), status, source == "src3", F.lit("")).alias("gap"))


@query("SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 AND count(*) FILTER (event_type = 'error') > 0 THEN 'degraded' WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'available' WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'unavailable' ELSE 'empty' END AS availability FROM events GROUP BY user_id")
def provider_availability(spark, sf_dir):
    seen = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("n"), F.count_if(F.col("event_type") == "error").alias("bad"))
    return seen.select("user_id", P.availability(F.col("n"), F.lit("ok"), F.when(F.col("bad") > 0, "unavailable").otherwise("ok")).alias("availability"))


# --- texts --------------------------------------------------------------------------------------


@query(r"WITH w AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, list_filter(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')), lambda x: length(x) > 3) AS c FROM benchmark) SELECT item_id, array_to_string(list_sort(c), ' ') AS coherence, left(array_to_string(list_slice(list_filter(string_split_regex(trim(regexp_replace(lower(t), '[^a-z0-9 ]+', ' ', 'g')), ' +'), lambda x: length(x) > 2), 1, 8), ' '), 1000) AS headline FROM w")
def query_words(spark, sf_dir):
    """The words of a question that an answer should repeat, and its key as a headline."""
    t = F.trim(F.regexp_replace("text", r"\s+", " "))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(X.coherence_terms(F.col("text"))), " ").alias("coherence"), P.headline_key(t).alias("headline"))


@query(r"SELECT doc_id, md5(replace(replace(substr(trim(replace(text, chr(10), ' ')), 1, 2000), '&', '&amp;'), '|', '&#124;')) AS cell, md5(CASE WHEN length(t) <= 240 THEN t ELSE trim(regexp_replace(substr(t, 1, 240), ' [^ ]*$', '')) END) AS clipped FROM (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)")
def cells_and_clips(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(P.table_cell(F.col("text"))).alias("cell"), F.md5(P.clipped(F.col("text"), 240)).alias("clipped"))


@query(r"SELECT doc_id, 'id-' || doc_id || '_' || md5(text) AS found FROM documents")
def opaque_identifiers(spark, sf_dir):
    """Identifiers that a question names, among its words."""
    said = F.concat(F.lit("where is id-"), F.col("doc_id").cast("string"), F.lit("_"), F.md5("text"), F.lit(" and not-a-number or short-1"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.opaque_identifiers(said), " ").alias("found"))


@query(r"SELECT page_id, list_distinct(['https://' || split_part(split_part(url, '://', 2), '/', 1) || '/']) IS NOT NULL AS there, len(regexp_extract_all(html, '<a[^>]* href=\"')) AS links FROM pages")
def resolved_links(spark, sf_dir):
    """How many links each page has, all resolved against its address."""
    pages = table(spark, sf_dir, "pages")
    counted = metadata.linked(pages).groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.bool_and(F.col("href").rlike("^https?://")).alias("there"))
    return pages.select("page_id").join(counted, "page_id", "left").select("page_id", F.coalesce("there", F.lit(True)).alias("there"), F.coalesce("links", F.lit(0)).alias("links"))
