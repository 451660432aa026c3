"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``radius`` bits have a variant in
common that differs from either in at most half as many. Every distinct
fingerprint emits all variants within ``radius // 2`` bits, the variants are
shuffled, and fingerprints that meet on one are linked. As any two that meet
are within ``radius`` of each other, a bucket needs one link a member, to its
smallest, not one a pair; the components are the same.

``similar`` finds texts by the likeness of their shingle sets in the same way:
a pair of likeness 0.8 differs in one bit of seven, too far for a ball over one
long fingerprint, so balls are laid around several short ones, each kept apart by
MinHash anchors of its table, and texts that meet are verified exactly.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, drop_stored, free_prefix, map_arrow, parts, stored
from .graph import components, forest
from .lines import bucketed_keys, divided, meet, mix, verified

BITS, RADIUS, WIDTH, SEED, PASSES = 64, 4, 4, 42, 8
#: Classes of variants, and the mark of a mask number whose fingerprint has another's root.
FINE, LED = 64, np.uint16(2**15)
#: Links that make up for telling components anew, or a hundredth of the fingerprints if that is more.
LINKS = 4096
#: Links that one task joins, and links of a turn that one task reads.
FEW, TASK_LINKS = 1_000_000, 65_536
#: Of ``similar``: tables, MinHash anchors in each, bits of its fingerprint, and the radius
#: around that; a pair of likeness 0.8 meets in some table with a probability of 0.99.
TABLES, ANCHORS, SHORT, REACH, LIKENESS = 8, 3, 16, 4, 0.8
#: Bytes of variants that one reducing task should hold.
TASK_BYTES = 24_000_000
#: Fingerprints whose variants one mapping task emits at a time.
TASK_FPS = 4096
#: Keys whose variants one task of ``similar`` compares at a time.
NEAR_KEYS = 16_384


def simhash(text: str | None, width: int = WIDTH) -> int:
    """The 64-bit fingerprint of a whole text: lower-cased A-Z, words between
    ASCII white space, shingles of ``width`` words with repeats (fewer words:
    all of them); zero for a null, an empty or a blank text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    stops = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], stops[:-1] + 1])
    stops = stops[min(width, len(words)) - 1 :].tolist()
    starts = starts[: len(stops)].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(starts), 65_536):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + 65_536], stops[at : at + 65_536], strict=True)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def ball(radius: int, bits: int = BITS) -> np.ndarray:
    """All masks of at most ``radius`` ones among ``bits`` bits."""
    one = [1 << i for i in range(bits)]
    return np.array([sum(c) for n in range(radius + 1) for c in itertools.combinations(one, n)], dtype=np.uint64)


def _class(x: np.ndarray, passes: int) -> np.ndarray:
    """A number below ``passes`` (a power of two) with class(a ^ b) = class(a) ^ class(b)."""
    out, mask = np.zeros(x.shape, dtype=np.uint8), 0x9E3779B97F4A7C15
    for bit in range(passes.bit_length() - 1):
        out |= (np.bitwise_count(x & np.uint64(mask)) & 1) << bit
        mask = (mask * 0xBF58476D1CE4E5B9 + 0x94D049BB133111EB) % 2**64
    return out


def _part(x: np.ndarray, n: int) -> np.ndarray:
    return ((((x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.uint16 if n <= 65_536 else np.uint32)


def turns(passes: int = PASSES) -> list[range]:
    """Classes of variants by turn: one, one more, as many as before, and so on up
    to a ``passes``-th of all."""
    out = [range(0, 1)]
    while out[-1].stop < FINE:
        at = out[-1].stop
        out.append(range(at, min(2 * at, at + FINE // passes)))
    return out


def ball_links(fps: DataFrame, col: str, radius: int = RADIUS, passes: int = PASSES) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within ``radius`` bits.

    Variants go through the shuffle in turns, by a linear class of the variant, so
    disk holds one turn's at a time, a ``passes``-th at most; the number of turns is
    fixed. They travel as packed arrays of variant and mask number. What the small
    first turns connect is one later: only fingerprints of different components are
    linked, so a dense group makes links in proportion to its size.
    """
    spark, masks = fps.sparkSession, ball(radius // 2)
    of = _class(masks, FINE)
    n = fps.count()
    reducers = max(parts(spark), math.ceil(n * len(masks) * 10 / passes / TASK_BYTES))
    tasks = max(1, math.ceil(n / TASK_FPS))
    spread = checkpointed(fps.select(F.col(col).cast("long").alias("fp"), F.col(col).cast("long").alias("root")).repartition(tasks))
    found, told, waiting = [], 0, 0
    for turn in turns(passes):

        def emit(batches: Iterator[pa.RecordBatch], turn: range = turn) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, TASK_FPS):
                    own, root = (batch.column(i).to_numpy()[at : at + TASK_FPS].view(np.uint64) for i in (0, 1))
                    group = _class(own, FINE)
                    variants, numbers, whose = [], [], []
                    for g in range(FINE):
                        mine = np.flatnonzero(group == g)
                        if not len(mine):
                            continue
                        now = of ^ np.uint8(g)
                        which = np.flatnonzero((now >= turn.start) & (now < turn.stop))
                        variants.append((own[mine][:, None] ^ masks[which][None, :]).ravel())
                        numbers.append(np.tile(which.astype(np.uint16), len(mine)))
                        whose.append(np.repeat(mine.astype(np.uint16), len(which)))
                    v, m, w = np.concatenate(variants), np.concatenate(numbers), np.concatenate(whose)
                    del variants, numbers, whose
                    part = _part(v, reducers)
                    order = np.argsort(part, kind="stable")
                    v, m, w, part = v[order], m[order], w[order], part[order]
                    # a root travels only with what isn't its own
                    led = (root != own)[w]
                    roots, passed = root[w[led]], np.append(0, np.cumsum(led))
                    m = np.where(led, m | LED, m)
                    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
                    spans = list(zip(starts, [*starts[1:], len(part)], strict=False))
                    yield pa.RecordBatch.from_arrays([pa.array([int(part[x]) for x in starts], pa.int32()), *(pa.array(x, pa.binary()) for x in ([v[x:y].tobytes() for x, y in spans], [m[x:y].tobytes() for x, y in spans], [roots[passed[x] : passed[y]].tobytes() for x, y in spans]))], ["part", "variants", "masks", "roots"])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v, m, r = [], [], []
            for batch in batches:
                v += [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in batch.column(1)]
                m += [np.frombuffer(x.as_buffer(), dtype=np.uint16) for x in batch.column(2)]
                r += [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in batch.column(3)]
            if not v:
                return
            variants, numbers, roots = np.concatenate(v), np.concatenate(m), np.concatenate(r)
            del v, m, r
            order = np.argsort(variants)
            variants = variants[order]
            same = variants[1:] == variants[:-1]
            member = np.zeros(len(variants), dtype=bool)
            member[1:] |= same
            member[:-1] |= same
            variants, order = variants[member], order[member]
            if not len(variants):
                return
            led = numbers >= LED
            passed = np.cumsum(led) - led
            own = (variants ^ masks[numbers[order] & ~LED]).view(np.int64)
            root = own.copy()
            root[led[order]] = roots[passed[order[led[order]]]]
            starts = np.flatnonzero(np.concatenate([[True], variants[1:] != variants[:-1]]))
            sizes = np.diff(np.append(starts, len(own)))
            # in order of fingerprint within a bucket, so that its first is its smallest
            first = np.repeat(starts, sizes)
            place = np.lexsort((own, first))
            own, root = own[place], root[place]
            near = (root[first] != root) & (np.bitwise_count((own[first] ^ own).view(np.uint64)) <= radius)
            a, b = forest(root[first][near], root[near])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        sent = map_arrow(spread, emit, "part int, variants binary, masks binary, roots binary")
        linked = checkpointed(map_arrow(sent.repartition(reducers, "part"), meet, "a long, b long"))
        many = linked.coalesce(tasks).count()
        # a turn has few links in many tasks
        found.append(linked.coalesce(max(1, math.ceil(many / TASK_LINKS))))
        waiting += many
        if turn.stop < FINE and waiting > max(n // 100, LINKS):
            new = functools.reduce(DataFrame.union, found[told:])
            roots = components(new, "a", "b", few=FEW).select(F.col("node").alias("root"), F.col("root").alias("top"))
            spread = checkpointed(spread.join(roots, "root", "left").select("fp", F.coalesce("top", "root").alias("root")).repartition(tasks))
            told, waiting = len(found), 0
    return functools.reduce(DataFrame.union, found)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, width: int = WIDTH) -> DataFrame:
    """Near-duplicate groups: components of fingerprints within ``radius`` bits.

    Equal fingerprints count once, pre-aggregated, so copies cost nothing more.
    Texts without words have fingerprint zero and are linked like any other.
    Returns for every row doc_id, fingerprint (long), component_id (smallest id
    of the group; null only if all its ids are null) and kept: true for one row
    of each group, that of the smallest id, of equal ids the first read. Other
    columns aren't read.
    """
    rows = _narrow(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), width)
    first = checkpointed(rows.groupBy("_fp").agg(F.min(F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("d"), F.col("_row").alias("r"))).alias("_first")))
    linked = components(ball_links(first, "_fp", radius), "a", "b", few=FEW)
    rooted = checkpointed(first.join(linked.withColumnRenamed("node", "_fp"), "_fp", "left").select("_fp", "_first", F.coalesce("root", "_fp").alias("_root")))
    heads = checkpointed(rooted.groupBy("_root").agg(F.min("_first").alias("_head")))
    labels = checkpointed(rooted.select("_fp", "_root").join(heads, "_root").select("_fp", F.col("_head.d").alias("_component"), F.col("_head.r").alias("_head_row")))
    out = rows.join(labels, "_fp").withColumn("_kept", F.col("_row") == F.col("_head_row"))
    return out.select(F.col("_id").alias("doc_id"), F.col("_fp").alias("fingerprint"), F.col("_component").alias("component_id"), F.col("_kept").alias("kept"))


def _narrow(docs: DataFrame, width: int) -> DataFrame:
    """(_id, _fp, _row), stored: the text goes no further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(x.as_py(), width) for x in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["_id", "_fp"])

    schema = T.StructType([docs.schema["_id"], T.StructField("_fp", T.LongType())])
    return stored(map_arrow(docs, run, schema).withColumn("_row", F.monotonically_increasing_id()))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Distinct hashes of the runs of ``width`` words of a whole text (fewer words:
    of them all), in order; of a text without words, none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    stops = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], stops[:-1] + 1])
    stops = stops[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), stops, strict=False)), dtype=np.uint64, count=len(stops)))


def table_keys(h: np.ndarray) -> np.ndarray:
    """A key for each table: a hash of its anchors, the least hashes of the set by
    its orders, above a fingerprint of ``SHORT`` bits."""
    ones = np.zeros(TABLES * SHORT, dtype=np.int64)
    for at in range(0, len(h), 65_536):
        seeds = mix(np.arange(1, TABLES * SHORT // 64 + 1, dtype=np.uint64))
        some = mix(h[at : at + 65_536, None] ^ seeds[None, :])
        ones += np.unpackbits(some.view(np.uint8).reshape(len(some), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    short = np.packbits(2 * ones > len(h), bitorder="little").view("<u2").astype(np.uint64)
    keys = np.arange(TABLES, dtype=np.uint64) + np.uint64(1)
    for i in range(ANCHORS):
        seeds = mix(np.arange(TABLES, dtype=np.uint64) * np.uint64(ANCHORS) + np.uint64(1_000 + i))
        keys = mix(keys ^ np.array([mix(h ^ s).min() for s in seeds]))
    return (keys & ~np.uint64(2**SHORT - 1)) | short


def _sent(keys: np.ndarray, by: np.ndarray, ids: np.ndarray, sizes: np.ndarray, component: np.ndarray, n: int) -> pa.RecordBatch:
    """Keys and what goes with them, packed for each of ``n`` reducers, dealt ``by`` numbers."""
    part = _part(by, n)
    order = np.argsort(part, kind="stable")
    rows = np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(keys) else []
    return pa.RecordBatch.from_arrays([pa.array([int(part[r[0]]) for r in rows], pa.int32()), *(pa.array([x[r].tobytes() for r in rows], pa.binary()) for x in (keys, ids, sizes, component))], ["part", "keys", "ks", "sizes", "components"])


def meet_near(batches: Iterator[pa.RecordBatch], masks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (part, keys, ks, sizes, components) of packed arrays -> buckets, as ``meet``
    has them, of what has a variant of its key in common: keys with the same anchors
    are in one task, and their variants are made there, some at a time."""
    held = [np.concatenate(x) for x in zip(*([np.frombuffer(x.as_buffer(), kind) for x, kind in zip(row, (np.uint64, np.uint64, np.uint32, np.int64), strict=True)] for batch in batches for row in zip(*batch.columns[1:5], strict=True)), strict=True)]
    if not held:
        return
    order = np.argsort(held[0], kind="stable")
    keys, ks, sizes, component = (x[order] for x in held)
    del held, order
    anchors = keys >> np.uint64(SHORT)
    starts = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    apart = np.minimum.reduceat(component, starts) != np.maximum.reduceat(component, starts)
    rows = np.repeat(apart, np.diff(np.append(starts, len(keys))))
    keys, ks, sizes, component, anchors = keys[rows], ks[rows], sizes[rows], component[rows], anchors[rows]
    if not len(keys):
        return
    starts = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    ends = np.append(starts[1:], len(keys))
    at = 0
    while at < len(starts):
        # as many anchors as fit, one at least
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + NEAR_KEYS, side="right")))
        lo, hi = starts[at], ends[upto - 1]
        at = upto
        rounds = 1 << max(0, math.ceil(math.log2((hi - lo) / NEAR_KEYS)))
        rounds = min(rounds, FINE)
        of, group = _class(masks, rounds), _class(keys[lo:hi], rounds)
        for turn in range(rounds):
            variants, whose = [], []
            for g in range(rounds):
                mine = lo + np.flatnonzero(group == g)
                which = masks[of == turn ^ g]
                variants.append((keys[mine][:, None] ^ which[None, :]).ravel())
                whose.append(np.repeat(mine, len(which)))
            w = np.concatenate(whose)
            yield from bucketed_keys(np.concatenate(variants), ks[w], sizes[w], component[w])


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", likeness: float = LIKENESS, width: int = 5) -> DataFrame:
    """``docs`` with the component of each row and whether it is kept, in columns
    named component and kept behind a free prefix (see ``free_prefix``).

    Texts whose sets of ``width``-word shingles have a Jaccard likeness of at
    least ``likeness`` are linked. Equal sets are one class, so copies cost
    nothing more. Texts meet that share a key of a table, first, and then a
    variant of one within half the radius; all pairs that meet are compared
    exactly where they meet, but for those connected already. Texts without words
    are alike. component is the smallest id of the group (null only if all are
    null); kept is true for one row of each, of the smallest id, of equal ids the
    first read. No rows: no rows.
    """
    spark = docs.sparkSession
    prefix = free_prefix(docs.columns, ["row", "component", "kept"])
    row = f"{prefix}row"
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    narrow = rows.select(F.col(row).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, chars, keys = [], [], []
            for x in batch.column(2):
                text = x.as_py()
                h = shingle_set(text, width)
                digests.append(xxhash.xxh128_digest(h.tobytes()))
                chars.append(min(len(text or ""), 2**31))
                keys.append(table_keys(h).view(np.int64) if len(h) else np.zeros(0, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(chars, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["_row", "_id", "_set", "_chars", "_keys"])

    kind = narrow.schema["_id"].dataType.simpleString()
    signed = stored(map_arrow(narrow, sign, f"_row long, _id {kind}, _set binary, _chars long, _keys array<long>"))
    place = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("d"), F.col("_row").alias("r"))
    first = signed.groupBy("_set").agg(F.min(place).alias("first"))
    classes = checkpointed(first.join(signed.select(F.col("_row").alias("cls"), "_chars", "_keys"), F.col("first.r") == F.col("cls")).select("cls", "first", "_set", "_chars", "_keys"))
    n = classes.count()
    masks = ball(REACH // 2, SHORT)

    def met(df: DataFrame, near: bool) -> DataFrame:
        """Buckets of (cls, chars, component, keys): of equal keys, or of a variant in common.
        Variants of a key have its anchors, so keys are dealt by these and variants don't travel."""
        reducers = max(parts(spark), math.ceil(n * TABLES * 28 / TASK_BYTES))

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, TASK_FPS):
                    some = batch.slice(at, TASK_FPS)
                    ids, sizes, component = (some.column(i).to_numpy() for i in range(3))
                    keys = some.column(3).flatten().to_numpy().view(np.uint64)
                    yield _sent(keys, keys >> np.uint64(SHORT) if near else keys, np.repeat(ids, TABLES), np.repeat(sizes.astype(np.uint32), TABLES), np.repeat(component, TABLES), reducers)

        # few tasks of many keys each, so that packed arrays aren't many and short
        sent = map_arrow(df.coalesce(max(1, math.ceil(n / TASK_FPS))), emit, "part int, keys binary, ks binary, sizes binary, components binary")
        return checkpointed(map_arrow(sent.repartition(reducers, "part"), (lambda batches: meet_near(batches, masks)) if near else meet, "bucket long, k long, lead long, chars long"))

    def linked(buckets: DataFrame) -> DataFrame:
        buckets = checkpointed(buckets.distinct())
        texts = rows.select(F.col(row).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("line")).join(buckets.select("k").distinct(), "k", "left_semi")

        def shingled(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
            sets = [shingle_set(x, width) for x in lines]
            return np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)

        return verified(divided(buckets).join(texts, "k"), likeness, shingled)

    asked = classes.where(F.size("_keys") > 0).select("cls", F.col("_chars").cast("long").alias("chars"), F.col("cls").alias("component"), "_keys")
    links = linked(met(asked, near=False))
    roots = checkpointed(components(links, "a", "b"))
    asked = checkpointed(asked.drop("component").join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "chars", F.coalesce("root", "cls").alias("component"), "_keys"))
    roots = components(links.union(linked(met(asked, near=True))), "a", "b")
    rooted = checkpointed(classes.select("cls", "first", "_set").join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("_set", "first", F.coalesce("root", "cls").alias("root")))
    heads = checkpointed(rooted.groupBy("root").agg(F.min("first").alias("head")))
    labels = checkpointed(rooted.select("_set", "root").join(heads, "root").select("_set", F.col("head.d").alias("component"), F.col("head.r").alias("head")))
    told = checkpointed(signed.select("_row", "_set").join(labels, "_set").select(F.col("_row").alias(row), F.col("component").alias(f"{prefix}component"), (F.col("_row") == F.col("head")).alias(f"{prefix}kept")))
    drop_stored(signed)
    return rows.join(told, row).select(*docs.columns, f"{prefix}component", f"{prefix}kept")


def hex_of(fp: Column) -> Column:
    """16 lower-case hex digits of a signed long."""
    return F.lpad(F.lower(F.hex(fp)), BITS // 4, "0")
