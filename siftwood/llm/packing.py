"""Best-fit-decreasing packing of whole tables into token sequences.

Best-fit decreasing looks at lengths only, so documents of one length are
interchangeable: the decisions are taken for classes of equal length, of which
there are at most ``capacity``, and the documents take their class's places in
parallel. The result is the packing that best-fit decreasing over all pieces
at once would make; nothing is packed per partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, stored

CAPACITY, END_ID, SALTS = 2048, 0, 256


class RemainingTree:
    """A segment tree over remaining capacities 0..capacity: which of them an
    open bin has. ``tightest`` takes logarithmic time."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << (capacity + 1).bit_length()
        self.open = [False] * (2 * self.leaves)

    def put(self, remaining: int, there: bool) -> None:
        at = remaining + self.leaves
        self.open[at] = there
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of an open bin that holds ``length``."""
        at = length + self.leaves
        if self.open[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """Places for ``counts[length]`` pieces of each length.

    Returns for each length rows (first rank, first sequence, pieces in each
    sequence, offset of the first): rank r of that length goes to sequence
    first + (r - first rank) // pieces, at offset + length * the remainder.
    """
    tree, bins, fresh = RemainingTree(capacity), {}, 0

    def push(remaining: int, first: int, n: int) -> None:
        if n > 0 and remaining > 0:
            bins.setdefault(remaining, []).append((first, n))
            tree.put(remaining, True)

    plan = {}
    for length in sorted(counts, reverse=True):
        left, rank, rows = counts[length], 0, []
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining, first, n = capacity, fresh, -(-left // (capacity // length))
                fresh += n
            else:
                first, n = bins[remaining].pop()
                if not bins[remaining]:
                    tree.put(remaining, False)
            # after a piece, its bin is the tightest that holds another one, so a bin takes all it can at once
            each = remaining // length
            full = min(n, left // each)
            rows.append((rank, first, each, capacity - remaining))
            push(remaining - each * length, first, full)
            rank, left = rank + full * each, left - full * each
            if full < n:
                if left:
                    rows.append((rank, first + full, each, capacity - remaining))
                    push(remaining - left * length, first + full, 1)
                    rank, full, left = rank + left, full + 1, 0
                if remaining < capacity:
                    push(remaining, first + full, n - full)
        plan[length] = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return plan


class Encoder:
    """Ids of a text as the ``tokenizers`` file gives them, without special tokens added.

    The same vocabulary as ranks is several times as fast in ``tiktoken`` and
    gives the same ids; texts that hold a special token's string, or that it
    refuses, take the ``tokenizers`` file itself.
    """

    def __init__(self, path: str, ranks_path: str | None = None, pattern: str | None = None) -> None:
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.special = [x.content for x in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(s in text for s in self.special):
            try:
                return np.array(self.fast.encode_ordinary(text), dtype="<u4")
            except Exception:  # its pattern engine gives up on some very long runs
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


def public_encoder() -> Encoder:
    import public_tokenizers

    return Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, encoder=public_encoder) -> DataFrame:
    """Token pieces of every whole text (null: empty), an end id after each.

    Texts of more than ``capacity`` ids are cut into pieces of ``capacity``
    whose first takes the remainder; others are one piece.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                cols: tuple[list, ...] = ([], [], [], [], [])
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.append(encode(text or ""), np.uint32(END_ID)).astype("<u4")
                    n, start, piece = len(ids), 0, 0
                    while start < n:
                        stop = start + ((n - start - 1) % capacity + 1 if start == 0 else capacity)
                        for col, x in zip(cols, (doc, piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes())), strict=True):
                            col.append(x)
                        start, piece = stop, piece + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), cut, PIECES)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, encoder=public_encoder) -> DataFrame:
    """Packs all texts into sequences of at most ``capacity`` tokens, best fit decreasing.

    Every piece's rank within its length is counted in ``SALTS`` runs, so a
    length that holds a third of all pieces is ranked by many tasks. The driver
    gets one count a length (at most ``capacity`` rows) and the plan's rows,
    whose number depends on the lengths, not on how many documents there are.
    Rows with equal ids are packed separately, a null id included; an empty or
    null text is one piece of the end id alone; no rows: no rows. Returns
    doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, id_col, text_col, capacity, encoder).withColumn("_row", F.monotonically_increasing_id()))
    cut = cut.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)))
    sizes = cut.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    counts = {int(r["length"]): int(r["n"]) for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(best_fit_plan(counts, capacity))
    ranked = cut.withColumn("_r", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_row")) - 1).join(bases, ["length", "_salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_base") + F.col("_r")).cast("long").alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = plan.value
        for batch in batches:
            lengths, ranks = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty_like(ranks), np.empty_like(ranks)
            order = np.argsort(lengths, kind="stable")
            cuts = np.flatnonzero(np.diff(lengths[order])) + 1
            for own in np.split(order, cuts) if len(order) else []:
                length, rank = int(lengths[own[0]]), ranks[own]
                first, seq, each, off = table[length][np.searchsorted(table[length][:, 0], rank, side="right") - 1].T
                sequence[own] = seq + (rank - first) // each
                offset[own] = off + (rank - first) % each * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return map_arrow(ranked, place, PIECES + ", sequence_id long, offset long")
