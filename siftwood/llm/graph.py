"""Connected components of a link table, without collecting links or components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one task -> (node, smallest node reachable) of the nodes that
    aren't that smallest node: at most one link a node, the same components."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while True:
        low, high = np.minimum(up[x], up[y]), np.maximum(up[x], up[y])
        open_ = low != high
        if not open_.any():
            break
        np.minimum.at(up, high[open_], low[open_])
        while (up[up] != up).any():
            up = up[up]
    rest = up != np.arange(len(nodes))
    return nodes[rest], nodes[up[rest]]


def _contract(batches):
    """Spanning forest of a task's links, in bounded pieces."""
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    for batch in batches:
        kept.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        held += batch.num_rows
        if held > 2_000_000:
            kept = [forest(*(np.concatenate(x) for x in zip(*kept, strict=True)))]
            held = len(kept[0][0])
            if held > 1_000_000:  # mostly distinct nodes: pass them on
                yield pa.RecordBatch.from_arrays([pa.array(kept[0][0]), pa.array(kept[0][1])], ["v", "u"])
                kept, held = [], 0
    if kept:
        v, u = forest(*(np.concatenate(x) for x in zip(*kept, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(u)], ["v", "u"])


def _joined(batches):
    """Spanning forest of all of a task's links, which the caller bounds."""
    kept = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    if kept:
        v, u = forest(*(np.concatenate(x) for x in zip(*kept, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(u)], ["v", "u"])


def _whole(edges: DataFrame) -> DataFrame:
    """(node, root) of links to roots: roots are nodes as well."""
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).union(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def _size(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str, b: str, rounds: int = 60, few: int = 0) -> DataFrame:
    """(node, root): the smallest node reachable from each node with a link.

    Each task first replaces its links by a spanning forest (a union-find of
    its own rows); alternating small-star and large-star rounds then join the
    forests. All joins read checkpointed tables on both sides, so a node that
    holds most links is split by adaptive execution; minima are pre-aggregated.
    Null ends are ignored, self links and repeats are harmless. Where the forests
    have no more than ``few`` links, one task joins them: rounds are some dozens of
    jobs, whatever the size.
    """
    edges = links.select(F.greatest(a, b).cast("long").alias("v"), F.least(a, b).cast("long").alias("u")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
    edges = checkpointed(edges.mapInArrow(_contract, "v long, u long"))
    if few and edges.count() <= few:
        return _whole(checkpointed(edges.coalesce(1).mapInArrow(_joined, "v long, u long")))
    seen = None
    for _ in range(rounds):
        # small star: every node hands its smaller neighbours to the smallest of them
        low = checkpointed(edges.groupBy("v").agg(F.min("u").alias("m")))
        near = edges.join(low, "v")
        small = near.select(F.col("v"), F.col("m").alias("u")).union(near.where("u != m").select(F.col("u").alias("v"), F.col("m").alias("u"))).distinct()
        small = checkpointed(small)
        # large star: every node hands its larger neighbours to its smallest neighbour
        low = checkpointed(small.groupBy("v").agg(F.min("u").alias("m")))
        up = small.join(low.select(F.col("v").alias("u"), "m"), "u", "left")
        edges = checkpointed(up.select("v", F.coalesce("m", "u").alias("u")).distinct())
        now = _size(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return _whole(edges)
