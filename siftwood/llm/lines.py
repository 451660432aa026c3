"""Fuzzy line deduplication by MinHash.

Every distinct line gets a one-permutation MinHash signature of its character
shingles. Lines that share a band are candidates; their exact Jaccard
likeness decides. Lines are united by distributed union-find and one line of
each component is kept.

All pairs of a band bucket are compared in the task that holds the bucket, by
counting shared shingles; pairs don't leave it, only a spanning forest of the
links found does. Buckets of many lines or characters are divided so that every
two divisions meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .brown import part_of
from .common import checkpointed, drop_stored, map_arrow, parts, stored
from .graph import components, forest

SHINGLE, BANDS, ROWS, THRESHOLD, SEED = 8, 20, 6, 0.8, 42
CHUNK_CHARS, CHUNK_LINES = 2_000_000, 50_000
#: Lines and characters of a bucket's division; a task compares two at a time.
BUCKET, BUCKET_CHARS = 1024, 4_000_000
#: Rows of buckets with one lead that are dealt to one task.
LEAD_ROWS = 4096
EMPTY = np.uint64(2**32)
BLANK = " \t\r\x0b\x0c"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(line: str, n: int = SHINGLE) -> set[str]:
    """Runs of ``n`` characters; a shorter line is one shingle."""
    return {line[i : i + n] for i in range(len(line) - n + 1)} if len(line) > n else {line}


def signatures(lines: list[str]) -> np.ndarray:
    """One-permutation MinHash: in each of BANDS x ROWS bins the least hash of the
    shingles that fall there; an empty bin takes that of a bin drawn for it."""
    bins = BANDS * ROWS
    padded = [x if len(x) >= SHINGLE else x + "\0" * (SHINGLE - len(x)) for x in lines]
    chars = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.array([len(x) for x in padded])
    h = np.zeros(len(chars) - SHINGLE + 1, dtype=np.uint64)
    for j in range(SHINGLE):
        h = h * np.uint64(0x100000001B3) + chars[j : len(chars) - SHINGLE + 1 + j]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    own = np.repeat(np.arange(len(lines)), sizes - SHINGLE + 1)
    each = sizes - SHINGLE + 1
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum())
    h = mix(h[at])
    code = (own.astype(np.uint64) * np.uint64(bins) + (((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32))) << np.uint64(32)
    packed = np.sort(code | (h & np.uint64(0xFFFFFFFF)))
    place = packed >> np.uint64(32)
    first = np.concatenate([[True], place[1:] != place[:-1]])
    out = np.full(len(lines) * bins, EMPTY)
    out[place[first].astype(np.int64)] = packed[first] & np.uint64(0xFFFFFFFF)
    filled = out.copy()
    gaps = np.flatnonzero(out == EMPTY)
    rng = np.random.default_rng(SEED)
    for turn in range(40 + bins):
        if not len(gaps):
            break
        line, bin_ = gaps // bins, gaps % bins
        donor = rng.integers(0, bins, bins)[bin_] if turn < 40 else (bin_ + turn - 39) % bins
        value = filled[line * bins + donor]
        out[gaps] = value
        gaps = gaps[value == EMPTY]
    return out.reshape(len(lines), bins)


def band_keys(lines: list[str]) -> np.ndarray:
    """A key for each line and band; lines with equal rows in a band share its key."""
    sig = signatures(lines).reshape(len(lines), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(lines), BANDS))
    for r in range(ROWS):
        key = mix(key ^ (sig[:, :, r] + np.uint64(0x632BE59BD9B4E019)))
    return key


def line_id(line: str) -> int:
    """XXH64 of the line, as ``xxhash64`` has it; lines are told apart by it."""
    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)


def bucketed(docs: DataFrame, text_col: str) -> DataFrame:
    """(bucket, k, lead, chars): the lines of every band bucket of two or more; buckets
    of the same lines are one. ``lead`` is one line of the bucket."""
    reducers = parts(docs.sparkSession)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = 0

        def sent() -> pa.RecordBatch:
            keys, ks, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
            part = part_of(keys, reducers)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order])) + 1
            rows = np.split(order, cuts)
            return pa.RecordBatch.from_arrays([pa.array([int(part[r[0]]) for r in rows], pa.int32()), pa.array([keys[r].tobytes() for r in rows], pa.binary()), pa.array([ks[r].tobytes() for r in rows], pa.binary()), pa.array([sizes[r].tobytes() for r in rows], pa.binary())], ["part", "keys", "ks", "sizes"])

        def add(lines: list[str], ids: list[int]) -> None:
            held.append((band_keys(lines).ravel(), np.repeat(np.array(ids, dtype=np.uint64), BANDS), np.repeat(np.array([len(x) for x in lines], dtype=np.uint32), BANDS)))

        lines: list[str] = []
        ids: list[int] = []
        chars = 0
        for batch in batches:
            for text in batch.column(0):
                for line in (text.as_py() or "").split("\n"):
                    if not line.strip(BLANK):
                        continue
                    k = line_id(line)
                    if k in seen:  # a line of this task already; asking twice would only be more work
                        continue
                    seen.add(k)
                    lines.append(line)
                    ids.append(k)
                    chars += len(line)
                    if chars >= CHUNK_CHARS:
                        add(lines, ids)
                        count += len(lines)
                        lines, ids, chars = [], [], 0
                        if count >= CHUNK_LINES:
                            yield sent()
                            held, count = [], 0
            if len(seen) > 1_000_000:
                seen.clear()
        if lines:
            add(lines, ids)
        if held:
            yield sent()

    asks = map_arrow(docs.select(F.col(text_col).alias("text")), ask, "part int, keys binary, ks binary, sizes binary")
    return stored(map_arrow(asks.repartition(reducers, "part"), meet, "bucket long, k long, lead long, chars long").distinct())


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, keys, ks, sizes) of packed arrays -> (bucket, k, lead, chars) of
    every key that two or more have; keys of the same members are one bucket,
    named by its members. With a fifth column, components of the members, keys
    whose members are of one component already make no bucket."""
    a, b, c, d = [], [], [], []
    for batch in batches:
        if batch.num_columns > 4:
            d += [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(4)]
        a += [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(1)]
        b += [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(2)]
        c += [np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column(3)]
    if not a:
        return
    keys, ks, sizes = np.concatenate(a), np.concatenate(b), np.concatenate(c)
    component = np.concatenate(d) if d else None
    del a, b, c, d
    yield from bucketed_keys(keys, ks, sizes, component)


def bucketed_keys(keys: np.ndarray, ks: np.ndarray, sizes: np.ndarray, component: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """The buckets that ``meet`` makes of keys and what goes with them."""
    order = np.argsort(keys)
    sorted_keys = keys[order]
    same = sorted_keys[1:] == sorted_keys[:-1]
    several = np.zeros(len(keys), dtype=bool)
    several[1:] |= same
    several[:-1] |= same
    keys, order = sorted_keys[several], order[several]
    del sorted_keys
    ks, sizes = ks[order], sizes[order]
    if component is not None and len(keys):
        component = component[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        apart = np.minimum.reduceat(component, starts) != np.maximum.reduceat(component, starts)
        rows = np.repeat(apart, np.diff(np.append(starts, len(keys))))
        keys, ks, sizes = keys[rows], ks[rows], sizes[rows]
    order = np.lexsort((mix(ks), keys))
    keys, ks, sizes = keys[order], ks[order], sizes[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (ks[1:] != ks[:-1])
    keys, ks, sizes = keys[new], ks[new], sizes[new]
    if not len(keys):
        return
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(starts, len(keys)))
    name = mix(np.add.reduceat(mix(ks ^ np.uint64(0xD1B54A32D192ED03)), starts) + size.astype(np.uint64))
    _, once = np.unique(name, return_index=True)
    take = np.zeros(len(starts), dtype=bool)
    take[once] = True
    take &= size > 1
    rows = np.repeat(take, size)
    lead = np.minimum.reduceat(ks, starts)
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, size)[rows].view(np.int64)), pa.array(ks[rows].view(np.int64)), pa.array(np.repeat(lead, size)[rows].view(np.int64)), pa.array(sizes[rows].astype(np.int64))], ["bucket", "k", "lead", "chars"])


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct shingles of each text, in order of both.

    Shingles are told apart by 64-bit hashes; a text no longer than a shingle is one.
    """
    padded = [x if len(x) >= SHINGLE else x + "\0" * (SHINGLE - len(x)) for x in texts]
    chars = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.array([len(x) for x in padded])
    h = np.zeros(len(chars) - SHINGLE + 1, dtype=np.uint64)
    for j in range(SHINGLE):
        h = h * np.uint64(0x100000001B3) + chars[j : len(chars) - SHINGLE + 1 + j]
    each = sizes - SHINGLE + 1
    own = np.repeat(np.arange(len(texts)), each)
    at = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(each) - each), each) + np.arange(each.sum())
    h = mix(h[at])
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return own[new], h[new]


def alike(n_texts: int, own: np.ndarray, h: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (i, j) of all pairs of texts whose exact Jaccard likeness is at
    least the threshold; ``own`` and ``h`` are their distinct shingles, as ``hashed`` has them.

    Shared shingles are counted by products of 0/1 matrices; shingles of one
    text only can't be shared and aren't in them.
    """
    sizes = np.bincount(own, minlength=n_texts)
    _, column, often = np.unique(h, return_inverse=True, return_counts=True)
    shared = often[column] > 1
    row, col = own[shared], column[shared]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    if len(col):  # numbered without gaps
        col = np.concatenate([[0], np.cumsum(col[1:] != col[:-1])])
    width = int(col[-1]) + 1 if len(col) else 0
    both = np.zeros((n_texts, n_texts), dtype=np.float32)
    for lo in range(0, width, 2048):  # columns at a time, so that memory is bounded
        a, b = np.searchsorted(col, [lo, lo + 2048])
        part = np.zeros((n_texts, min(2048, width - lo)), dtype=np.float32)
        part[row[a:b], col[a:b] - lo] = 1
        both += part @ part.T
    i, j = np.nonzero(np.triu(both > 0, 1))
    n = np.rint(both[i, j]).astype(np.int64)
    sure = n >= threshold * (sizes[i] + sizes[j] - n)
    return i[sure], j[sure]


def verified(members: DataFrame, threshold: float, shingled=hashed) -> DataFrame:
    """Links (a, b) that connect all pairs of a bucket that are alike, of rows
    (bucket, k, lead, line): every pair of a bucket is compared where the bucket
    is, and only a spanning forest leaves the task. Buckets with the same lead
    are in one task; one whose lines are connected already needs no comparison.
    ``shingled`` gives the distinct shingles of lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        now, ks, texts = None, [], []
        up: dict[int, int] = {}

        def top(k: int) -> int:
            while (above := up.get(k, k)) != k:
                up[k] = up.get(above, above)
                k = above
            return k

        def close() -> None:
            nonlocal held
            if len(ks) > 1 and len({top(k) for k in ks}) > 1:
                i, j = alike(len(texts), *shingled(texts), threshold)
                own = np.array(ks, dtype=np.int64)
                links.append(forest(own[i], own[j]))
                held += len(links[-1][0])
                for x, y in zip(links[-1][0].tolist(), links[-1][1].tolist(), strict=True):
                    x, y = top(x), top(y)
                    if x != y:
                        up[x] = y
            if len(up) > 1_000_000:  # what is forgotten is compared again
                up.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for bucket, k, line in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    if bucket != now:
                        close()
                        now, ks, texts = bucket, [], []
                    ks.append(k)
                    texts.append(line)
            if held > 200_000:
                a, b = forest(*(np.concatenate(x) for x in zip(*links, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                links, held = [], 0
        close()
        if links:
            a, b = forest(*(np.concatenate(x) for x in zip(*links, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    dealt = members.repartition(parts(members.sparkSession), "lead").sortWithinPartitions("lead", "bucket")
    return checkpointed(map_arrow(dealt.select("bucket", "k", "line"), run, "a long, b long"))


def divided(buckets: DataFrame) -> DataFrame:
    """(bucket, k, lead) of buckets that a task can compare.

    A bucket of more than ``BUCKET`` lines or ``BUCKET_CHARS`` characters is
    divided by hash, and every two of its divisions are one bucket, so all its
    pairs are still compared. Buckets of a lead that has many are dealt to
    several tasks.
    """
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.first("lead").alias("lead"))
    wanted = F.greatest(F.ceil(F.col("n") / BUCKET), F.least(F.ceil(F.col("chars") / BUCKET_CHARS), F.col("n")))
    large = checkpointed(sizes.where((F.col("n") > BUCKET) | (F.col("chars") > BUCKET_CHARS)).where("n > 2").select("bucket", wanted.alias("c")))
    own, other = F.pmod(F.xxhash64("k"), F.col("c")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)).alias("j")
    cut = buckets.join(large, "bucket").select("bucket", "k", own.alias("i"), other).select(F.xxhash64("bucket", F.least("i", "j"), F.greatest("i", "j")).alias("bucket"), "k").distinct().withColumn("lead", F.col("bucket"))
    whole = buckets.join(large, "bucket", "left_anti").select("bucket", "k", "lead")
    crowded = checkpointed(whole.groupBy("lead").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LEAD_ROWS).select("lead", F.ceil(F.col("n") / LEAD_ROWS).alias("tasks")))
    spread = whole.join(crowded, "lead", "left").select("bucket", "k", F.when(F.col("tasks").isNull(), F.col("lead")).otherwise(F.xxhash64("lead", F.pmod(F.xxhash64("bucket"), F.col("tasks")))).alias("lead"))
    return spread.union(cut)


def exploded(docs: DataFrame, text_col: str, *cols: str) -> DataFrame:
    """A row for each line, with its number; a null text has none."""
    return docs.select(*cols, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line")).withColumn("k", F.xxhash64("line"))


def line_components(docs: DataFrame, text_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """(node, root) of lines that are alike, by ``line_id``."""
    buckets = bucketed(docs, text_col)
    wanted = checkpointed(buckets.select("k").distinct())
    lines = docs.select(F.explode(F.split(text_col, "\n")).alias("line")).withColumn("k", F.xxhash64("line"))
    texts = stored(lines.join(wanted, "k", "left_semi").groupBy("k").agg(F.min("line").alias("line")))
    links = verified(divided(buckets).join(texts, "k"), threshold)
    roots = checkpointed(components(links, "a", "b"))
    for table in (buckets, texts):
        drop_stored(table)
    return roots


def line_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, row_col: str | None = None) -> DataFrame:
    """One row for each line that isn't blank: doc_id, line_no (from 0), line_id,
    component_id (line_id of its component), kept_doc_id, kept_line_no, kept.

    A component's first line, by doc_id (null ids last), reading order and line
    number, is kept. Lines are what line feeds divide, whole and as they are;
    blank ones aren't compared. Null and empty texts have no lines. Equal lines
    are pre-aggregated, so a line that a third of all documents share is one
    line to compare. ``row_col`` names a column that numbers the rows of
    ``docs``; else rows are numbered here.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), (F.monotonically_increasing_id() if row_col is None else F.col(row_col)).alias("_row"))
    found = stored(exploded(rows, "_text", "_id", "_row").where(F.btrim("line", F.lit(BLANK)) != "").select("_id", "_row", "line_no", "k"))
    roots = line_components(rows, "_text", threshold)
    place = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("d"), F.col("_row").alias("r"), F.col("line_no").alias("i"))
    firsts = checkpointed(found.groupBy("k").agg(F.min(place).alias("first")))
    rooted = checkpointed(firsts.join(roots.withColumnRenamed("node", "k"), "k", "left").select("k", "first", F.coalesce("root", "k").alias("root")))
    heads = checkpointed(rooted.groupBy("root").agg(F.min("first").alias("head")))
    labels = checkpointed(rooted.select("k", "root").join(heads, "root"))
    out = found.join(labels, "k")
    kept = (F.col("_row") == F.col("head.r")) & (F.col("line_no") == F.col("head.i"))
    return out.select(F.col("_id").alias("doc_id"), F.col("_row").alias("row"), "line_no", F.col("k").alias("line_id"), F.col("root").alias("component_id"), F.col("head.d").alias("kept_doc_id"), F.col("head.i").alias("kept_line_no"), kept.alias("kept"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the lines that aren't kept; all columns and other rows stay.

    A text all of whose lines were duplicates, that had lines, is left out: its
    lines stay where they came first. Blank lines, null and empty texts stay.
    """
    rows = stored(docs.withColumn("_siftwood_row", F.monotonically_increasing_id()))
    groups = line_groups(rows, id_col, text_col, threshold, "_siftwood_row")
    gone = checkpointed(groups.groupBy(F.col("row").alias("_siftwood_row")).agg(F.collect_list(F.when(~F.col("kept"), F.col("line_no"))).alias("_siftwood_gone"), F.max(F.col("kept").cast("int")).alias("_siftwood_any")).where(F.size("_siftwood_gone") > 0))
    joined = rows.join(gone, "_siftwood_row", "left").where("_siftwood_any is null or _siftwood_any = 1").select(*docs.columns, "_siftwood_gone")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, gone in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if gone:
                    drop = set(gone)
                    texts[i] = "\n".join(x for j, x in enumerate(texts[i].split("\n")) if j not in drop)
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return map_arrow(joined, run, T.StructType(docs.schema.fields))
