"""Embedding near-duplicates by sorted projection passes.

In each pass every vector gets its signs on random hyperplanes, concatenated, as
a key; vectors are put in order of their keys, and each is compared with the
``window`` vectors that follow it. Where more vectors than a window holds share
the leading signs of a key (a crowd: large groups of near copies, dense
regions), all of them are compared, in divisions, so that windows lose no link
in dense places. Pairs at or above the cosine threshold, verified in double
precision, are united over all passes; a pair is counted in the first pass it
meets in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, drop_stored, map_arrow, parts, stored, with_global_order
from .graph import components

THRESHOLD, RECALL, SEED = 0.95, 0.999, 20240229
#: Signs in a key, vectors that each is compared with in its order, and vectors of one block of the order.
SIGNS, WINDOW, BLOCK = 62, 512, 2048
#: Numbers in a division of a crowd; a task holds two divisions.
DIVISION = 1 << 20
#: Vectors that one comparing task should get.
TASK_ROWS = 16_384


def passes_for(bits: int, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Passes after which a pair at the threshold has shared ``bits`` leading signs with probability ``recall``.

    A pair agrees on a sign with probability 1 - angle / pi, whatever the other vectors are.
    """
    met = (1 - math.acos(threshold) / math.pi) ** bits
    return 1 if met >= recall else math.ceil(math.log(1 - recall) / math.log(1 - met))


def bits_for(n: int, window: int = WINDOW) -> int:
    """Leading signs that so many of ``n`` evenly spread vectors share as a window holds."""
    return min(SIGNS, max(0, math.ceil(math.log2(max(1, n) / window))))


def _unite(up: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Joins the sets of ``x`` and ``y`` in ``up``, where each place names the smallest of its set."""
    while True:
        low, high = np.minimum(up[x], up[y]), np.maximum(up[x], up[y])
        open_ = low != high
        if not open_.any():
            return
        np.minimum.at(up, high[open_], low[open_])
        while (up[up] != up).any():
            up[:] = up[up]


def keyed(classes: DataFrame, turns: int) -> DataFrame:
    """(cls, dim, keys): the signs of each vector on the hyperplanes of each pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            keys = np.zeros((len(sizes), turns), dtype=np.int64)
            for d in np.unique(sizes):
                own = np.flatnonzero(sizes == d)
                m = flat[starts[own][:, None] + np.arange(d)]
                # scaled first, so that no sum of products overflows
                m = m / np.abs(m).max(axis=1, keepdims=True)
                for turn in range(turns):
                    planes = np.random.default_rng([SEED, turn, int(d)]).standard_normal((int(d), SIGNS))
                    keys[own, turn] = (m @ planes > 0) @ (1 << np.arange(SIGNS - 1, -1, -1, dtype=np.int64))
            told = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * turns), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int32)), told], ["cls", "dim", "keys"])

    return map_arrow(classes.select("cls", "_v"), run, "cls long, dim int, keys array<long>")


def compare(batches: Iterator[pa.RecordBatch], turn: int, window: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """One row for each vector with a link that no earlier pass met: the rows it is
    linked with, and the smallest class of its set among those compared here.

    Rows come in runs of (dim, crowd, lo, hi), in order of rank: those of a block
    of the order (dim -1), each compared with the window behind it, or two
    divisions of a crowd, of which all pairs farther apart than a window are.
    """

    def verified(m: np.ndarray, ahead: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cosine = m[ahead] @ m[behind].T
        x, y = np.nonzero(cosine >= threshold - 1e-9)
        close = np.flatnonzero(cosine[x, y] < threshold + 1e-9)
        x, y = ahead[x], behind[y]
        sure = np.ones(len(x), dtype=bool)
        for k in range(0, len(close), 8192):
            some = close[k : k + 8192]
            sure[some] = np.einsum("ij,ij->i", m[x[some]], m[y[some]]) >= threshold
        return x[sure], y[sure]

    def linked(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        if table.column("dim")[0].as_py() >= 0:
            yield met(table.combine_chunks())
            return
        sizes = table.column("size").to_numpy()
        for size in np.unique(sizes):  # vectors of unlike dimension never link
            yield met(table.filter(pa.array(sizes == size)).combine_chunks())

    def met(rows: pa.Table) -> pa.RecordBatch:
        wide = lambda c: rows.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
        ids, copies, place = (rows.column(c).to_numpy() for c in ("cls", "n", "part"))
        m, ranks, heads = wide("v"), wide("ranks"), wide("heads")
        rank = ranks[:, turn]
        m = m / np.abs(m).max(axis=1, keepdims=True)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        up, counts = np.arange(len(ids)), np.zeros(len(ids), dtype=np.int64)

        def add(x: np.ndarray, y: np.ndarray) -> None:
            for earlier in range(turn):
                fresh = (heads[x, earlier] != heads[y, earlier]) & (np.abs(ranks[x, earlier] - ranks[y, earlier]) > window)
                x, y = x[fresh], y[fresh]
            np.add.at(counts, x, copies[y])
            np.add.at(counts, y, copies[x])
            _unite(up, x, y)

        lo, hi = rows.column("lo")[0].as_py(), rows.column("hi")[0].as_py()
        if rows.column("dim")[0].as_py() < 0:
            own = np.flatnonzero(place == 0)  # others follow the block, only to be met
            for i in range(0, len(own), 256):
                ahead = own[i : i + 256]
                behind = np.arange(ahead[0], np.searchsorted(rank, rank[ahead[-1]] + window, side="right"))
                x, y = verified(m, ahead, behind)
                apart = rank[y] - rank[x]
                near = (apart > 0) & (apart <= window)
                add(x[near], y[near])
        else:
            left, right = np.flatnonzero(place == lo), np.flatnonzero(place == hi)
            for i in range(0, len(left), 512):
                for j in range(i if lo == hi else 0, len(right), 2048):
                    x, y = verified(m, left[i : i + 512], right[j : j + 2048])
                    far = np.abs(rank[y] - rank[x]) > window
                    if lo == hi:
                        far &= x < y
                    add(x[far], y[far])
        # the smallest class of a set stands for it
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, up, ids)
        some = np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(least[up[some]]), pa.array(counts[some])], ["cls", "low", "m"])

    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(c).to_numpy() for c in ("dim", "crowd", "lo", "hi")])
        cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            mark = tuple(marks[:, start])
            if held and mark != now:
                yield from linked(held)
                held = []
            now = mark
            held.append(batch.slice(start, end - start))
    if held:
        yield from linked(held)


def link(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, window: int = WINDOW, division: int = DIVISION) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept.

    Every pair at the threshold is found with probability ``recall`` or more, in
    groups and regions of any density: it shares the leading signs of its keys
    in some pass, and vectors that share them are a window's or a crowd's. Up to
    a window of vectors every pair is found. Crowds are divided so that every
    two divisions meet; only counts and spanning forests leave a task.
    Equal vectors are one class (pre-aggregated, its copies linked by
    definition), so a vector that a third of all rows repeat costs one row.
    Null, empty and zero vectors and those with null or non-finite components
    link with nothing: each is a component of its own. Vectors of different
    dimension never link. n_links counts the other rows linked directly,
    copies included; component_id is the smallest id reachable; rows that
    share an id share their class; a null id is smallest only among nulls.
    Other columns aren't read.
    """
    spark = vectors.sparkSession
    numbers = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    valid = F.coalesce((F.size(numbers) > 0) & F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(numbers, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("vec_id"), valid.alias("_ok"), F.when(valid, numbers).alias("_v"))
    classes = stored(rows.where("_ok").groupBy("_v").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n")).withColumn("cls", F.monotonically_increasing_id()))
    n = classes.count()
    bits = bits_for(n, window)
    turns = passes_for(bits, threshold, recall)
    signs = keyed(classes, turns).select("cls", "dim", F.posexplode("keys").alias("turn", "key")).withColumn("tie", F.xxhash64("cls", "turn"))
    # the orders of all passes, one behind the other
    ordered = with_global_order(signs, ["turn", "dim", "key", "tie", "cls"], {}, "rank")
    placed = checkpointed(ordered.select("cls", "dim", "turn", "rank", F.shiftright("key", SIGNS - bits).alias("head")))
    crowds = checkpointed(placed.groupBy("turn", "dim", "head").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > window + 1).withColumn("divisions", F.ceil(F.col("c") / F.greatest(F.floor(F.lit(division) / F.col("dim")), F.lit(1))).cast("int")))
    found_at = F.array_sort(F.collect_list(F.struct("turn", "rank", "head")))
    places = placed.groupBy("cls", "dim").agg(found_at.alias("p")).select("cls", F.col("dim").alias("size"), F.col("p.rank").alias("ranks"), F.col("p.head").alias("heads"))
    carried = stored(classes.select("cls", "n", F.col("_v").alias("v")).join(places, "cls"))
    found = None
    for turn in range(turns):
        now = carried.withColumn("rank", F.element_at("ranks", turn + 1))
        block = F.floor(F.col("rank") / BLOCK)
        # a block's first vectors also follow the block before it
        also = F.when(F.pmod(F.col("rank"), F.lit(BLOCK)) < window, F.array(block, block - 1)).otherwise(F.array(block))
        near = now.withColumn("crowd", F.explode(also)).select("cls", "n", "v", "size", "ranks", "heads", "rank", F.lit(-1).alias("dim"), "crowd", (F.col("crowd") != block).cast("int").alias("part"), F.lit(0).alias("lo"), F.lit(0).alias("hi"))
        here = crowds.where(F.col("turn") == turn)
        total = n + int(here.agg(F.sum(F.col("c") * F.col("divisions"))).first()[0] or 0)
        if total > n:
            # which division a vector is in differs from pass to pass
            own = F.pmod(F.xxhash64("cls", F.lit(turn)), F.col("divisions")).cast("int")
            crowded = now.withColumn("crowd", F.element_at("heads", turn + 1)).join(here.select(F.col("dim").alias("size"), F.col("head").alias("crowd"), "divisions"), ["size", "crowd"])
            crowded = crowded.withColumn("part", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("divisions") - 1)))
            near = near.unionByName(crowded.select("cls", "n", "v", "size", "ranks", "heads", "rank", F.col("size").alias("dim"), "crowd", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi")))
        by = ["dim", "crowd", "lo", "hi"]
        runs = near.repartition(max(parts(spark), total // TASK_ROWS), *by).sortWithinPartitions(*by, "rank")
        met = checkpointed(map_arrow(runs, lambda batches, turn=turn: compare(batches, turn, window, threshold), "cls long, low long, m long"))
        found = met if found is None else found.union(met)
    sizes = classes.select("cls", "n", "first")
    counted = found.groupBy("cls").agg(F.sum("m").alias("m"))
    linked = components(found, "cls", "low").withColumnRenamed("node", "cls")
    rooted = checkpointed(sizes.join(counted, "cls", "left").join(linked, "cls", "left").select("cls", "first", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"), F.coalesce("root", "cls").alias("root")))
    drop_stored(carried)
    heads = checkpointed(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    labels = checkpointed(rooted.join(heads, "root").select("cls", "n_links", "component_id"))
    named = checkpointed(classes.select("cls", "_v").join(labels, "cls").select("_v", "n_links", "component_id"))
    good = rows.where("_ok").join(named, "_v").select("vec_id", "n_links", "component_id")
    alone = rows.where("not _ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
