"""Brown class-based n-gram scoring.

Words are put into classes by exchange clustering, and a text's probability is
the product of class transitions and word emissions, both smoothed.

Tokens never travel as rows. The corpus is cut into blocks of whole documents
whose words are numbered locally; a block asks for its distinct words only, in
packed arrays dealt by word hash, and the reducers, which see every word of
theirs over the whole corpus, answer the blocks that asked. The blocks stay where
they are, dealt by number; only asks and answers are shuffled.

Every word takes part in every sweep: its reducer sums the classes to the left
and right of all its occurrences and moves it to the class that raises the class
model's likelihood most, until a sweep raises it no more. No word list is
broadcast or collected; the driver holds the class bigrams.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, collected, dealt_by, drop_stored, map_arrow, parts, stored

CLASSES, FOLDS = 64, 10
#: Sweeps end when a pair of them (even and odd words) raises the likelihood by less than this
#: share of all it has moved by, or after so many.
SETTLED, SWEEPS = 0.05, 16
END, REST = 0, CLASSES - 1
#: Tokens or distinct words after which a block is closed, and asked words of one reducing task.
BLOCK_TOKENS, BLOCK_WORDS, TASK_WORDS = 1_000_000, 60_000, 300_000
#: Counts up to which gains are looked up, and distinct words that are moved at a time.
SMALL, CHUNK = 48, 1024


def held_out(doc_id) -> bool:
    """Whether a row is held out of training: crc32 of its id as text, mod 10, is 0."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == 0


def part_of(wids: np.ndarray, n: int) -> np.ndarray:
    return (((wids >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int32)


def word_part(wids: np.ndarray, n: int) -> np.ndarray:
    """The part of ``2 n`` that a word is in; words of even and odd parts move in turns."""
    return part_of(wids, n) * 2 + ((wids >> np.uint64(7)) & np.uint64(1)).astype(np.int32)


def dealt(wids: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """(part, numbers of the words in it, in order) for each part that has words."""
    part = word_part(wids, n)
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    return [(int(part[x[0]]), x) for x in np.split(order, cuts)] if len(wids) else []


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each part, of batches in order of part (their second column)."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        marks = batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero(marks[1:] != marks[:-1]) + 1).tolist(), len(marks)] if len(marks) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and marks[a] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = marks[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


BLOCKS = "block long, n_train long, n_words long, doc_ids array<long>, lengths array<int>, held array<boolean>, ids binary, wids binary, words binary, counts binary"


def blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Whole documents in blocks; local word 0 is the end token. ``ids`` has two
    bytes a token, or four where a block has too many words for that. ``words``
    joins the other words by blanks, ``counts`` has their training counts."""
    closing = BLOCK_TOKENS, BLOCK_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 24
        state: dict = {}

        def fresh() -> None:
            state.update(names=defaultdict(count(1).__next__), ids=[], docs=[], lengths=[], held=[], tokens=0)

        def closed() -> pa.RecordBatch:
            nonlocal first
            names, ids = state["names"], np.concatenate(state["ids"])
            lengths, held = np.array(state["lengths"], dtype=np.int32), np.array(state["held"])
            counts = np.bincount(ids[~np.repeat(held, lengths)], minlength=len(names) + 1)[1:].astype("<u4")
            wids = np.fromiter(map(xxhash.xxh64_intdigest, names), dtype=np.uint64, count=len(names))
            small = ids.astype("<u2") if len(names) < 65_535 else ids
            n_train = int(lengths[~held].sum())
            row = [[first], [n_train], [len(names)], [state["docs"]], [lengths], [held], [small.tobytes()], [wids.tobytes()], [b" ".join(names)], [counts.tobytes()]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            first += 1
            fresh()
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], [c.split()[0] for c in BLOCKS.split(", ")])

        fresh()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or "").encode().lower().split()
                ids = np.zeros(len(words) + 1, dtype="<u4")
                ids[:-1] = np.fromiter(map(state["names"].__getitem__, words), dtype="<u4", count=len(words))
                state["ids"].append(ids)
                state["docs"].append(doc)
                state["lengths"].append(len(ids))
                state["held"].append(held_out(doc))
                state["tokens"] += len(ids)
                if state["tokens"] >= closing[0] or len(state["names"]) >= closing[1]:
                    yield closed()
        if state["docs"]:
            yield closed()

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, BLOCKS)


def word_counts(cut: DataFrame, reducers: int) -> DataFrame:
    """Answers (block, part, counts), and from each reducer its vocabulary's
    figures and most frequent words (block null)."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, wids, words, counts = (batch.column(k)[i].as_py() for k in range(4))
                words, counts = words.split(), np.frombuffer(counts, "<u4")
                out = dealt(np.frombuffer(wids, np.uint64), reducers)
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(out), pa.int64()), pa.array([p for p, _ in out], pa.int32()), pa.array([b" ".join([words[j] for j in x]) for _, x in out], pa.binary()), pa.array([counts[x].tobytes() for _, x in out], pa.binary())], ["block", "part", "words", "counts"])

    schema = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("counts", pa.binary()), ("v", pa.int64()), ("n1", pa.int64()), ("n2", pa.int64()), ("lead", pa.list_(pa.struct([("wid", pa.int64()), ("n", pa.int64())])))])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_part(batches):
            names: dict = defaultdict(count().__next__)
            asked = []
            for block, words, counts in zip(held.column("block"), held.column("words"), held.column("counts"), strict=True):
                own = words.as_py().split()
                asked.append((block.as_py(), np.fromiter(map(names.__getitem__, own), dtype=np.int32, count=len(own)), np.frombuffer(counts.as_buffer(), "<u4")))
            total = np.zeros(len(names), dtype=np.int64)
            for _, own, counts in asked:
                total[own] += counts
            part = held.column("part")[0].as_py()
            for block, own, _ in asked:
                yield pa.RecordBatch.from_pylist([{"block": block, "part": part, "counts": total[own].tobytes(), "v": 0, "n1": 0, "n2": 0, "lead": None}], schema)
            at = np.argsort(-total, kind="stable")[: 4 * CLASSES]
            listed = list(names)
            found = sorted((-int(total[i]), int(np.uint64(xxhash.xxh64_intdigest(listed[i])).view(np.int64))) for i in at.tolist() if total[i])
            lead = [{"wid": wid, "n": -n} for n, wid in found[:CLASSES]]
            yield pa.RecordBatch.from_pylist([{"block": None, "part": part, "counts": None, "v": int((total > 0).sum()), "n1": int((total == 1).sum()), "n2": int((total == 2).sum()), "lead": lead}], schema)

    asks = map_arrow(cut.select("block", "wids", "words", "counts"), ask, "block long, part int, words binary, counts binary")
    return map_arrow(asks.repartition(2 * reducers, "part").sortWithinPartitions("part"), answer, "block long, part int, counts binary, v long, n1 long, n2 long, lead array<struct<wid:long,n:long>>")


class Block:
    """A row of the blocks' table: local ids, lengths, which documents are held out, word hashes."""

    def __init__(self, row: Callable[[str], pa.Scalar]) -> None:
        self.number = row("block").as_py()
        self.doc_ids, self.held_list = row("doc_ids"), row("held")
        self.lengths = row("lengths").values.to_numpy().astype(np.int64)
        self.held = row("held").values.to_numpy(zero_copy_only=False)
        blob = row("ids").as_buffer()
        self.ids = np.frombuffer(blob, "<u2" if blob.size == 2 * self.lengths.sum() else "<u4")
        self.wids = np.frombuffer(row("wids").as_buffer(), np.uint64)

    def training(self) -> tuple[np.ndarray, np.ndarray]:
        """Local ids of the training tokens and of those before them; documents end
        with the end token, so before a document's first stands an end token."""
        now = self.ids[~np.repeat(self.held, self.lengths)]
        return now, np.concatenate([np.zeros(1, now.dtype), now[:-1]]) if len(now) else now


HEAVY = ("block", "doc_ids", "lengths", "held", "ids", "wids")


def with_classes(base: DataFrame, answers: list[DataFrame] | None, leads: np.ndarray, reducers: int, f: Callable[[Block, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``f`` of every block and the classes of its local words: the first ones, in
    which each of the ``leads`` has its own and all others one, or those answered,
    to words of even and odd parts."""
    if answers is None:
        order = np.argsort(leads)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    block = Block(lambda c, i=i, batch=batch: batch.column(c)[i])
                    cls = np.full(len(block.wids) + 1, REST, dtype=np.uint8)
                    if len(leads):
                        at = np.minimum(np.searchsorted(leads[order], block.wids), len(leads) - 1)
                        known = leads[order][at] == block.wids
                        cls[1:][known] = order[at[known]] + 1
                    cls[0] = END
                    yield from f(block, cls).combine_chunks().to_batches()

        return map_arrow(base.select(*HEAVY), run, schema)

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(lambda c: left.column(c)[0])
        cls = np.full(len(block.wids) + 1, REST, dtype=np.uint8)
        cls[0] = END
        told = {p.as_py(): c for p, c in zip(right.column("part"), right.column("classes"), strict=True)}
        for p, x in dealt(block.wids, reducers):
            cls[x + 1] = np.frombuffer(told[p].as_buffer(), np.uint8)
        return f(block, cls)

    told = answers[0].union(answers[1]).where("block is not null").select("block", "part", "classes")
    return base.select(*HEAVY).groupBy("block").cogroup(told.groupBy("block")).applyInArrow(met, schema)


def bigrams(base: DataFrame, answers: list[DataFrame] | None, leads: np.ndarray, reducers: int) -> np.ndarray:
    """Class bigrams of all training tokens."""

    def tally(block: Block, cls: np.ndarray) -> pa.Table:
        now, before = block.training()
        m = np.bincount(cls[before].astype(np.int64) * CLASSES + cls[now], minlength=CLASSES * CLASSES)
        return pa.table({"m": pa.array([m.astype(np.int64).tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, dtype=np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_buffer(), np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["i", "n"])

    told = map_arrow(with_classes(base, answers, leads, reducers, tally, "m binary"), add, "i long, n long")
    m = np.zeros(CLASSES * CLASSES, dtype=np.int64)
    for row in collected(told.groupBy("i").agg(F.sum("n").alias("n"))):  # CLASSES squared rows
        m[row["i"]] = row["n"]
    return m.reshape(CLASSES, CLASSES)


def gain(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def likelihood(m: np.ndarray) -> float:
    m = m.astype(float)
    return float(gain(m).sum() - gain(m.sum(axis=0)).sum() - gain(m.sum(axis=1)).sum())


class Exchange:
    """The class of each word that raises the class model's likelihood most, the
    word taken out of its own class first.

    Entries are (word, code, count): code c counts class c to the word's left,
    code CLASSES + c to its right. Only counts above zero change the likelihood,
    so a word costs as much as it has entries; gains of small counts are looked up.
    """

    def __init__(self, m: np.ndarray) -> None:
        m = m.astype(float)
        self.m = np.concatenate([m, m.T])  # code x class of the word
        self.rows, self.cols = m.sum(axis=1), m.sum(axis=0)
        n = np.arange(SMALL + 1, dtype=float)
        self.table = (gain(self.m[:, None, :] + n[None, :, None]) - gain(self.m)[:, None, :]).astype(np.float32)
        self.row_table = gain(self.rows[None] + n[:, None]) - gain(self.rows)[None]
        self.col_table = gain(self.cols[None] + n[:, None]) - gain(self.cols)[None]

    @staticmethod
    def _looked(table: np.ndarray, base: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = table[np.minimum(n, SMALL)]
        large = np.flatnonzero(n > SMALL)
        out[large] = gain(base[None] + n[large, None]) - gain(base)[None]
        return out

    def best(self, starts: np.ndarray, code: np.ndarray, n: np.ndarray, own: np.ndarray) -> np.ndarray:
        """New classes of the words whose entries begin at ``starts``."""
        worth = self.table[code, np.minimum(n, SMALL)]
        large = np.flatnonzero(n > SMALL)
        base = self.m[code[large]]
        worth[large] = gain(base + n[large, None]) - gain(base)
        score = np.add.reduceat(worth, starts, axis=0).astype(float)
        left = np.add.reduceat(np.where(code < CLASSES, n, 0), starts)
        right = np.add.reduceat(np.where(code >= CLASSES, n, 0), starts)
        score -= self._looked(self.row_table, self.rows, right) + self._looked(self.col_table, self.cols, left)
        each = np.diff(np.append(starts, len(code)))
        here = self.m[code, np.repeat(own, each)]
        stay = np.add.reduceat(gain(here) - gain(np.maximum(here - n, 0)), starts)
        stay -= gain(self.rows[own]) - gain(np.maximum(self.rows[own] - right, 0)) + gain(self.cols[own]) - gain(np.maximum(self.cols[own] - left, 0))
        i = np.arange(len(own))
        score[i, own] = stay
        found = np.argmax(score[:, 1:], axis=1) + 1
        return np.where(score[i, found] > stay + 1e-9, found, own).astype(np.uint8)


def sweep(base: DataFrame, answers: list[DataFrame] | None, leads: np.ndarray, reducers: int, m: np.ndarray, turn: int) -> list[DataFrame]:
    """Answers (block, part, classes) to words of even and of odd parts after an
    exchange, and from each reducer the number of its words in each class (block null).

    Words move at once, so the first sweep moves those that share the class of all
    others only, and then those of even and odd parts move in turns; only they are
    asked for.
    """
    moving = None if turn == 0 else turn % 2

    def ask(block: Block, cls: np.ndarray) -> pa.Table:
        now, before = block.training()
        part = word_part(block.wids, reducers)
        which = np.arange(len(part)) if moving is None else np.flatnonzero(part % 2 == moving)
        which = which[np.argsort(part[which], kind="stable")]
        # the words that move are numbered in order of part; the end token isn't moved
        place = np.full(len(part) + 1, -1, dtype=np.int64)
        place[which + 1] = np.arange(len(which))
        a, b = place[now], place[before]
        own, ahead = a >= 0, b >= 0
        codes = np.concatenate([a[own] * (2 * CLASSES) + cls[before[own]], b[ahead] * (2 * CLASSES) + CLASSES + cls[now[ahead]]])
        if len(which) < 65_535:
            every = np.bincount(codes, minlength=len(which) * 2 * CLASSES)
            codes = np.flatnonzero(every)
            n = every[codes].astype("<u4")
            del every
        else:
            codes, n = np.unique(codes, return_counts=True)
            n = n.astype("<u4")
        entry = np.searchsorted(codes, np.arange(len(which) + 1) * 2 * CLASSES)
        each, code = np.diff(entry).astype(np.uint8), (codes % (2 * CLASSES)).astype(np.uint8)
        wids, classes, part = block.wids[which], cls[1:][which], part[which]
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(which) else np.zeros(0, dtype=np.int64)
        spans = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(which)], strict=False))
        return pa.table(
            [
                pa.array([block.number] * len(spans), pa.int64()),
                pa.array([int(part[x]) for x, _ in spans], pa.int32()),
                pa.array([wids[x:y].tobytes() for x, y in spans], pa.binary()),
                pa.array([classes[x:y].tobytes() for x, y in spans], pa.binary()),
                pa.array([each[x:y].tobytes() for x, y in spans], pa.binary()),
                pa.array([code[entry[x] : entry[y]].tobytes() for x, y in spans], pa.binary()),
                pa.array([n[entry[x] : entry[y]].tobytes() for x, y in spans], pa.binary()),
            ],
            names=["block", "part", "wids", "own", "each", "codes", "counts"],
        )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exchange = Exchange(m)
        for held in by_part(batches):
            yield from answered(held, exchange)

    def answered(held: pa.Table, exchange: Exchange) -> Iterator[pa.RecordBatch]:
        flat = lambda c, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in held.column(c)])
        words, place = np.unique(flat("wids", np.uint64), return_inverse=True)
        own = np.zeros(len(words), dtype=np.int64)
        own[place] = flat("own", np.uint8)
        key = np.repeat(place, flat("each", np.uint8)) * (2 * CLASSES) + flat("codes", np.uint8)
        order = np.argsort(key)
        key, n = key[order], flat("counts", "<u4")[order].astype(np.int64)
        del order
        new = own.astype(np.uint8)
        known = np.zeros(len(words), dtype=bool)
        if len(key):
            begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            key, n = key[begins], np.add.reduceat(n, begins)
            word, code = key // (2 * CLASSES), key % (2 * CLASSES)
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            listed = word[starts]
            known[listed] = True
            ends = np.append(starts[1:], len(word))
            for at in range(0, len(starts), CHUNK):
                lo, hi = starts[at], ends[min(at + CHUNK, len(starts)) - 1]
                new[listed[at : at + CHUNK]] = exchange.best(starts[at : at + CHUNK] - lo, code[lo:hi], n[lo:hi], own[listed[at : at + CHUNK]])
        if moving is None:
            new = np.where(own == REST, new, own).astype(np.uint8)
        at, part = 0, held.column("part")[0].as_py()
        for block, blob in zip(held.column("block"), held.column("own"), strict=True):
            size = blob.as_buffer().size
            yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int64()), pa.array([part], pa.int32()), pa.array([new[place[at : at + size]].tobytes()], pa.binary())], ["block", "part", "classes"])
            at += size
        sizes = np.bincount(new[known], minlength=CLASSES).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([part], pa.int32()), pa.array([sizes.tobytes()], pa.binary())], ["block", "part", "classes"])

    asks = with_classes(base, answers, leads, reducers, ask, "block long, part int, wids binary, own binary, each binary, codes binary, counts binary")
    told = checkpointed(map_arrow(asks.repartition(2 * reducers, "part").sortWithinPartitions("part"), answer, "block long, part int, classes binary"))
    if moving is None:
        return [told.where("part % 2 = 0"), told.where("part % 2 = 1")]
    return [told, answers[1]] if moving == 0 else [answers[0], told]


def cluster(base: DataFrame, leads: np.ndarray, reducers: int, sweeps: int) -> tuple[list[DataFrame] | None, np.ndarray, list[float]]:
    """Answers with the classes of the most likely sweep, their bigrams, and the
    likelihood after each sweep."""
    answers, best, history = None, None, []
    for turn in range(sweeps + 1):
        m = bigrams(base, answers, leads, reducers)
        history.append(likelihood(m))
        if best is None or history[-1] > best[0]:
            best = history[-1], answers, m
        span = max(history) - min(history)
        if turn == sweeps or turn > 3 and history[-1] - history[-3] <= SETTLED * span:
            break
        answers = sweep(base, answers, leads, reducers, m, turn)
    return best[1], best[2], history


class Scorer:
    """Log10 probabilities of class transitions and word emissions.

    Transitions are smoothed towards class shares. A discount d is taken from
    every word's count, and a class gives its discounts to the unknown word;
    so probabilities over the known words and the unknown one add up to one
    after every token. After an unknown word the classes are weighed by the
    discounts they gave. Where no class has words, an empty one stands for the
    unknown word.
    """

    def __init__(self, m: np.ndarray, words: np.ndarray, d: float, smooth: float = 5.0) -> None:
        m = m.astype(float)
        size = m.sum(axis=0)  # every training token has a token before it, at first an end token
        words = np.where(np.arange(CLASSES) == END, 0.0, words)
        weight = size + 0.1 * (size > 0)
        unknown = np.where(size > 0, d * words / np.maximum(size, 1), 0.0)
        given = d * words
        if not words.any():
            weight[REST], unknown[REST], given[REST] = 0.1, 1.0, 1.0
        move = (m + smooth * weight / weight.sum()) / (m.sum(axis=1, keepdims=True) + smooth)
        move = np.concatenate([move, ((given / given.sum()) @ move)[None]])
        with np.errstate(divide="ignore"):
            self.move, self.size = np.log10(move), np.log10(np.maximum(size, 1))
            self.unknown = np.log10(move @ unknown)
        self.d = d

    def tokens(self, ids: np.ndarray, cls: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Log10 probability of each token of a block's documents in order."""
        known = n > 0
        state = np.where(known, cls, CLASSES)
        state[END] = END
        emit = np.log10(np.maximum(n - np.where(np.arange(len(n)) == 0, 0.0, self.d), 1e-9)) - self.size[cls]
        now = ids.astype(np.int64)
        before = np.concatenate([[0], now[:-1]])
        s = state[before]
        return np.where(known[now], self.move[s, cls[now]] + emit[now], self.unknown[s])


def discount(n1: int, n2: int) -> float:
    """What is taken from every count: by words seen once and twice, never nothing."""
    return min(0.9, max(0.1, n1 / (n1 + 2 * n2) if n1 else 0.1))


def _class_words(answers: list[DataFrame] | None, leads: np.ndarray, v: int) -> np.ndarray:
    """Distinct training words of each class, the end token aside."""
    out = np.zeros(CLASSES)
    if answers is None:
        out[1 : len(leads) + 1] = 1
        out[REST] += v - len(leads)
        return out

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, dtype=np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(total)], ["i", "n"])

    for row in map_arrow(answers[0].union(answers[1]).where("block is null").select("classes"), add, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        out[row["i"]] = row["n"]
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sweeps: int = SWEEPS, with_words: bool = False) -> DataFrame:
    """Scores every whole text by a class model of the rows that aren't held out.

    Texts are lower-cased A-Z and cut at ASCII white space, an end token after
    each; null texts are empty. Returns one row for each row: doc_id, held_out,
    n_tokens, n_known, train_tokens, base_score (add-0.1 unigrams), score (log10
    probability by the class model), perplexity; ``with_words`` adds the class of
    every token of the text (``classes``, bytes; the end token's is 0, a word
    without training occurrences has any). Without training rows every text is
    surely unknown: both scores are 0. No rows: no rows. Rows that share an id
    are scored each. Classes go by 64-bit hashes of words, counts by the words.
    """
    spark = docs.sparkSession
    cut = stored(blocks(docs, id_col, text_col))
    sums = cut.agg(F.sum("n_train").alias("n"), F.sum("n_words").alias("words"), F.sum(F.size(F.filter("held", lambda x: ~x))).alias("ends")).first()
    total, ends = int(sums["n"] or 0), int(sums["ends"] or 0)
    # words are in twice as many parts, even and odd ones
    reducers = max(1, math.ceil(max(parts(spark), int(sums["words"] or 0) / TASK_WORDS) / 2))
    counts = stored(word_counts(cut, reducers))
    figures = counts.where("block is null")
    vocabulary = figures.agg(F.sum("v").alias("v"), F.sum("n1").alias("n1"), F.sum("n2").alias("n2")).first()
    v, n1, n2 = (int(vocabulary[k] or 0) for k in ("v", "n1", "n2"))
    first = figures.select(F.explode("lead").alias("x")).select("x.wid", "x.n").orderBy(F.desc("n"), "wid").limit(REST - 1).collect()
    leads = np.array([r["wid"] for r in first], dtype=np.int64).view(np.uint64)
    # dealt by block once, so that joining answers doesn't move the blocks
    base = dealt_by(cut.select(*HEAVY), "block")
    drop_stored(cut)
    answers, m, _ = cluster(base, leads, reducers, sweeps if total else 0)
    model = Scorer(m, _class_words(answers, leads, v), discount(n1, n2)) if total else None
    v += ends > 0
    floor = math.log10(total + 0.1 * (v + 1)) if total else 0.0
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double" + ", classes binary" * with_words

    def told(block: Block, cls: np.ndarray, n: np.ndarray) -> pa.Table:
        ids, lengths = block.ids, block.lengths
        n[END] = ends
        starts = np.cumsum(lengths) - lengths
        known = np.add.reduceat((n[ids] > 0).astype(np.int64), starts)
        plain = np.add.reduceat((np.log10(n + 0.1) - floor)[ids], starts) if total else np.zeros(len(lengths))
        own = np.add.reduceat(model.tokens(ids, cls, n), starts) if total else np.zeros(len(lengths))
        out = [pa.array(block.doc_ids.values), pa.array(block.held_list.values), pa.array(lengths), pa.array(known), pa.array(np.full(len(lengths), total)), pa.array(plain), pa.array(own), pa.array(np.power(10.0, np.minimum(300.0, -own / lengths)))]
        if with_words:
            out.append(pa.array([x.tobytes() for x in np.split(cls[ids], starts[1:])], pa.binary()))
        return pa.table(out, names=[c.split()[0] for c in schema.split(", ")])

    first_classes = np.sort(leads), np.argsort(leads)

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(lambda c: left.column(c)[0])
        cls, n = np.full(len(block.wids) + 1, REST, dtype=np.uint8), np.zeros(len(block.wids) + 1, dtype=np.int64)
        if answered:
            pass
        elif len(leads):
            at = np.minimum(np.searchsorted(first_classes[0], block.wids), len(leads) - 1)
            same = first_classes[0][at] == block.wids
            cls[1:][same] = first_classes[1][at[same]] + 1
        cls[0] = END
        said = {(k.as_py(), p.as_py()): b for p, k, b in zip(right.column("part"), right.column("kind"), right.column("blob"), strict=True)}
        for p, x in dealt(block.wids, reducers):
            n[x + 1] = np.frombuffer(said[0, p].as_buffer(), np.int64)
            if answered:
                cls[x + 1] = np.frombuffer(said[1, p].as_buffer(), np.uint8)
        return told(block, cls, n)

    answered = answers is not None
    blobs = counts.where("block is not null").select("block", "part", F.lit(0).alias("kind"), F.col("counts").alias("blob"))
    if answered:
        blobs = blobs.union(answers[0].union(answers[1]).where("block is not null").select("block", "part", F.lit(1), "classes"))
    return base.groupBy("block").cogroup(blobs.groupBy("block")).applyInArrow(met, schema)
