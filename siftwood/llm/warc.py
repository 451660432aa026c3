"""Merkle fixity audit of WARC replicas.

Records are hashed, and ordered ranges of them (by id, so also by offset) into a
tree for each replica. Replicas are compared from the root: only the children of
nodes whose hashes differ are looked at, and only records below them are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, with_global_order

FANOUT = 64


def record(uri: Column, number: Column, payload: Column) -> Column:
    """A WARC/1.1 resource record as text: header lines, a blank line, the payload, two line ends."""
    body = F.coalesce(payload, F.lit(""))
    lines = [F.lit("WARC/1.1"), F.lit("WARC-Type: resource"), F.concat(F.lit("WARC-Record-ID: <urn:record:"), F.coalesce(number.cast("string"), F.lit("")), F.lit(">")), F.concat(F.lit("WARC-Target-URI: "), F.coalesce(uri, F.lit(""))), F.lit("Content-Type: text/html"), F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def manifest(records: DataFrame, id_col: str, record_col: str) -> DataFrame:
    """(id, place, offset, length, digest) of an archive's records in order of id.

    Equal ids are one record of the smallest digest first, their other copies
    following in order of digest; a null id comes first. The text is hashed
    where it is read; only digests and lengths are ordered.
    """
    narrow = records.select(F.col(id_col).alias("id"), F.sha2(F.col(record_col), 256).alias("digest"), F.octet_length(record_col).cast("long").alias("length"))
    ordered = with_global_order(stored(narrow.withColumn("_row", F.monotonically_increasing_id())), ["id", "digest", "_row"], {"offset": "length"}, "place")
    return stored(ordered.select("id", "place", "offset", "length", "digest"))


def _key(level: int, fanout_bits: int) -> Column:
    """The number of the range of ids that a record is in; a null id is with 0."""
    return F.shiftright(F.coalesce(F.col("id").cast("long"), F.lit(0)), min(63, fanout_bits * level))


def _height(manifests: list[DataFrame], fanout_bits: int) -> int:
    """Levels after which one range holds all ids, or one all of either sign."""
    ends = [m.agg(F.min(_key(0, fanout_bits)).alias("a"), F.max(_key(0, fanout_bits)).alias("b")).first() for m in manifests]
    known = [x for e in ends for x in (e["a"], e["b"]) if x is not None]
    height = 1
    # ids of either sign have a root each
    while known and fanout_bits * height < 63 and min(known) >> min(63, fanout_bits * height) != max(known) >> min(63, fanout_bits * height):
        height += 1
    return height


def tree(records: DataFrame, height: int, fanout: int = FANOUT) -> list[DataFrame]:
    """A manifest's tree from its lowest ranges up: (node, hash, first, bytes) each,
    the root last.

    A range of ``fanout`` ids covers its records' own hashes (of id, length and
    digest) by their number and their sums, so an id that most records share is
    aggregated before the shuffle; a higher node covers the hashes of at most
    ``fanout`` ranges in order. ``first`` and ``bytes`` say which offsets of the
    archive a node covers.
    """
    bits = fanout.bit_length() - 1
    own = records.select("offset", "length", _key(1, bits).alias("node"), F.sha2(F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("none")), F.col("length").cast("string"), "digest"), 256).alias("h"))
    piece = lambda i: F.sum(F.conv(F.substring("h", 15 * i + 1, 15), 16, 10).cast("decimal(20,0)"))
    sums = own.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *[piece(i).alias(f"s{i}") for i in range(4)], F.min("offset").alias("first"), F.sum("length").alias("bytes"))
    out = [stored(sums.select("node", F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("n", "s0", "s1", "s2", "s3")]), 256).alias("hash"), "first", "bytes"))]
    for _ in range(height - 1):
        children = F.sort_array(F.collect_list(F.struct("node", "hash")))
        up = out[-1].groupBy(F.shiftright("node", bits).alias("up")).agg(children.alias("c"), F.min("first").alias("first"), F.sum("bytes").alias("bytes"))
        covered = F.concat_ws("|", F.transform("c", lambda x: F.concat(x["node"].cast("string"), x["hash"])))
        out.append(stored(up.select(F.col("up").alias("node"), F.sha2(covered, 256).alias("hash"), "first", "bytes")))
    return out


def differing(left: list[DataFrame], right: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """(node) of the lowest ranges that differ, from the roots down: below a node
    that is equal on both sides nothing is read."""
    bits = fanout.bit_length() - 1
    bad = None
    for a, b in zip(reversed(left), reversed(right), strict=True):
        a, b = a.select("node", "hash"), b.select("node", F.col("hash").alias("other"))
        if bad is not None:
            a, b = (x.withColumn("up", F.shiftright("node", bits)).join(bad.select(F.col("node").alias("up")), "up", "left_semi").drop("up") for x in (a, b))
        bad = stored(a.join(b, "node", "full").where(~F.col("hash").eqNullSafe(F.col("other"))).select("node"))
        if bad.isEmpty():
            break
    return bad


def audit(primary: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Compares a replica with the primary's manifest and locates what differs.

    Both are manifests of integer ids; either's tree is built from its own
    manifest alone, over ranges of ids, which are ranges of offsets as archives
    are in order of id; so a lost record changes no range but its own. The roots
    are compared, then only children of differing nodes, and only records of
    differing ranges are joined. ``fanout`` is a power of two. Copies of an id
    pair up by digest, the remaining ones in order of digest. Returns one row
    for each place that differs: id, place, offset, length, digest,
    replica_digest (null: lost), state (altered or lost). Records that the
    manifest lacks are listed with null place, state extra. No records: no rows.
    """
    height = _height([primary, replica], fanout.bit_length() - 1)
    bad = differing(tree(primary, height, fanout), tree(replica, height, fanout), fanout)
    at = _key(1, fanout.bit_length() - 1)
    mine, theirs = (stored(m.withColumn("node", at).join(bad, "node", "left_semi").drop("node")) for m in (primary, replica))

    def unmatched(own: DataFrame, other: DataFrame) -> DataFrame:
        """Rows beyond the number of the other side's copies of the same id and digest."""
        first = own.groupBy("id", "digest").agg(F.min("place").alias("_first")).select(F.col("id").alias("_a"), F.col("digest").alias("_b"), "_first")
        n = other.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("_n")).select(F.col("id").alias("_c"), F.col("digest").alias("_d"), "_n")
        rows = own.join(first, F.col("id").eqNullSafe(F.col("_a")) & (F.col("digest") == F.col("_b")))
        # equal records stand side by side, so a copy's number is its distance from the first
        rows = rows.join(n, F.col("id").eqNullSafe(F.col("_c")) & (F.col("digest") == F.col("_d")), "left").where(F.col("place") - F.col("_first") >= F.coalesce("_n", F.lit(0)))
        return rows.select("id", "place", "offset", "length", "digest").withColumn("copy", F.row_number().over(Window.partitionBy("id").orderBy("digest", "place")))

    a = unmatched(mine, theirs)
    b = unmatched(theirs, mine).select(F.col("id").alias("_id"), F.col("copy").alias("_copy"), F.col("digest").alias("replica_digest"), F.col("length").alias("_length"))
    pairs = a.join(b, F.col("id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_copy")), "full")
    state = F.when(F.col("replica_digest").isNull(), "lost").when(F.col("place").isNull(), "extra").otherwise("altered")
    extra = F.col("place").isNull()
    return pairs.select(F.when(extra, F.col("_id")).otherwise(F.col("id")).alias("id"), "place", "offset", F.when(extra, F.col("_length")).otherwise(F.col("length")).alias("length"), "digest", "replica_digest", state.alias("state"))


def report(primary: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Every record of the primary with its state: intact, or as ``audit`` found
    it; extra records of the replica follow. An intact record's replica digest
    is its own."""
    found = stored(audit(primary, replica, fanout))
    at = found.where("place is not null").select("place", F.col("replica_digest").alias("_d"), F.col("state").alias("_s"))
    known = primary.join(at, "place", "left")
    mine = known.select("id", "place", "offset", "length", "digest", F.when(F.col("_s").isNull(), F.col("digest")).otherwise(F.col("_d")).alias("replica_digest"), F.coalesce("_s", F.lit("intact")).alias("state"))
    return mine.unionByName(found.where("place is null"))
