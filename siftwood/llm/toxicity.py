"""Toxicity by compression distance.

Three zstandard dictionaries are trained on windows of labelled texts: a base on
ordinary ones, and over it a toxic and a control one. A toxic document is mostly
ordinary text, so the toxic dictionary is trained on those windows of toxic
documents that it compresses better than the control does, and the control on
those windows of ordinary documents that the toxic one compresses best; either
is judged on documents it wasn't trained on, in turns. A window's evidence is
how much shorter it gets with the toxic dictionary than with the base and with
the control. Logistic thresholds over a text's windows are calibrated on
labelled rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow

WINDOW, LEVEL, BASE_BYTES, OWN_BYTES, THRESHOLD = 128, 9, 112_000, 8192, 0.7
#: Bytes of the segments that training picks, and the share of windows it is given: the
#: pair whose dictionaries tell the labels of the other half apart best is taken.
SETTINGS, ROUNDS = ((12, 0.2), (14, 0.2), (16, 0.1)), 3
#: The training sample: at most so many labelled rows and bytes of either class.
TOXIC_ROWS, ORDINARY_ROWS, CLASS_BYTES = 2_000, 4_000, 8_000_000


def windows(text: str | None, width: int = WINDOW) -> list[bytes]:
    """The whole text, A-Z lower-cased and white space folded, in runs of whole
    words of at most ``width`` bytes (longer words are cut)."""
    words = (text or "").encode().lower().split()
    if not words:
        return []
    joined = b" " + b" ".join(words) + b" "
    out, at, end = [], 0, len(joined)
    while at < end - 1:
        stop = at + width
        if stop < end:
            blank = joined.rfind(b" ", at + width // 2, stop)
            stop = blank + 1 if blank > 0 else stop
        out.append(joined[at:stop])
        at = stop - 1 if stop < end and joined[stop - 1] == 32 else stop
    return out


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """The content of a dictionary that zstandard trains; too few samples are its content."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=8).as_bytes()[-size + 600 :]
    except zstandard.ZstdError:
        return b"".join(samples)[-size + 600 :]


def compressor(content: bytes):
    """A function from a window to its compressed length with ``content`` before it."""
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(level=LEVEL)
    compress = zstandard.ZstdCompressor(dict_data=held, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress
    return lambda runs: np.array([len(compress(w)) for w in runs], dtype=np.int64)


def measures(counts: np.ndarray, base: np.ndarray, control: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """What the windows of texts save, by their lengths with each dictionary: mean,
    shares of windows that save so many bytes, the most, and the sum of large savings
    (log). ``counts`` has the number of windows of each text; of none, all are 0."""
    out = np.zeros((len(counts), 18))
    some = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[some]
    for at, saved in ((0, base - toxic), (9, control - toxic)) if len(some) else ():
        total = lambda x: np.add.reduceat(x, starts)
        out[some, at] = np.clip(total(saved) / counts[some], -5.0, 20.0)
        for n in range(1, 7):
            out[some, at + n] = total((saved >= n).astype(np.int64)) / counts[some]
        out[some, at + 7] = np.log1p(total(np.where(saved >= 3, saved, 0)))
        out[some, at + 8] = np.clip(np.maximum.reduceat(saved, starts), -5, 12)
    return out


@dataclass
class Model:
    """The dictionaries' contents and the calibration; at most some 130 kB."""

    base: bytes = b""
    control: bytes = b""
    toxic: bytes = b""
    weights: list[float] = field(default_factory=list)
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)

    def scorer(self):
        """A function from texts to their scores."""
        if not self.weights:
            return lambda texts: np.zeros(len(texts))
        lengths = [compressor(c) for c in (self.base, self.control + self.base, self.toxic + self.base)]

        def scores(texts: list[str | None]) -> np.ndarray:
            cut = [windows(t) for t in texts]
            runs = [w for x in cut for w in x]
            x = measures(np.array([len(x) for x in cut], dtype=np.int64), *(f(runs) for f in lengths))
            z = ((x - self.mean) / self.scale) @ np.array(self.weights[1:]) + self.weights[0]
            return 1 / (1 + np.exp(-np.clip(z, -700, 700)))

        return scores


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 60) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the intercept first and free."""
    x = np.column_stack([np.ones(len(x)), x])
    w, keep = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + keep, x.T @ (y - p) - keep @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def best(runs: list[bytes], saved: np.ndarray, share: float) -> list[bytes]:
    """The ``share`` of windows that save most, all of them a byte or more; without any, all windows."""
    cut = max(float(np.quantile(saved, 1 - share)), 1.0) if len(runs) else 1.0
    return [w for w, x in zip(runs, saved.tolist(), strict=True) if x >= cut] or runs


def contrasted(base: bytes, toxic: list[list[bytes]], ordinary: list[list[bytes]], segment: int, share: float) -> list[tuple[bytes, bytes]]:
    """(control, toxic) dictionaries from the windows of either half and, last, of
    both. In each round every half's windows are judged by the other half's dictionaries."""
    of_base = compressor(base)
    plain = [of_base(x) for x in ordinary]
    picked = list(toxic)
    for turn in range(ROUNDS):
        bad = [trained(x, OWN_BYTES, segment) for x in picked]
        by_bad = [compressor(x + base) for x in bad]
        like = [best(ordinary[i], plain[i] - by_bad[1 - i](ordinary[i]), share) for i in (0, 1)]
        good = [trained(x, OWN_BYTES, segment) for x in like]
        by_good = [compressor(x + base) for x in good]
        if turn < ROUNDS - 1:
            picked = [best(toxic[i], by_good[1 - i](toxic[i]) - by_bad[1 - i](toxic[i]), share) for i in (0, 1)]
    both = trained(like[0] + like[1], OWN_BYTES, segment), trained(picked[0] + picked[1], OWN_BYTES, segment)
    return [(good[0], bad[0]), (good[1], bad[1]), both]


def fit(rows: list[tuple[str, int]]) -> Model:
    """Trains on (text, label) rows. Equal texts count once and are toxic if one
    of them is; the order of rows doesn't matter. Dictionaries trained on either
    half measure the other for the calibration. Without rows of both labels
    every score is 0."""
    labelled: dict[str, int] = {}
    for text, label in rows:
        labelled[text] = max(label, labelled.get(text, 0))
    known = sorted(labelled.items(), key=lambda r: (zlib.crc32(r[0].encode()), r[0]))
    texts, y = [t for t, _ in known], np.array([label for _, label in known])
    if len(set(y.tolist())) < 2:
        return Model()
    half = np.zeros(len(y), dtype=int)
    for label in (0, 1):
        half[np.flatnonzero(y == label)[1::2]] = 1
    runs = [windows(t) for t in texts]
    gathered = lambda label, own: [w for i in np.flatnonzero((y == label) & (half == own)) for w in runs[i]]
    toxic, ordinary = [gathered(1, 0), gathered(1, 1)], [gathered(0, 0), gathered(0, 1)]
    base = trained([w for i in np.flatnonzero(y == 0) for w in windows(texts[i], 512)], BASE_BYTES, 64)
    # as many ordinary windows as toxic ones
    even = [x[: max(1, len(z))] for x, z in zip(ordinary, toxic, strict=True)]
    of_base = compressor(base)
    plain = [of_base(x) for x in runs]
    found = None
    for segment, share in SETTINGS:
        halves = contrasted(base, toxic, even, segment, share)
        x = np.zeros((len(texts), 18))
        for own in (0, 1):
            control, bad = (compressor(c + base) for c in halves[own])
            others = np.flatnonzero(half != own)
            flat = [w for i in others for w in runs[i]]
            x[others] = measures(np.array([len(runs[i]) for i in others], dtype=np.int64), np.concatenate([plain[i] for i in others]), control(flat), bad(flat))
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = (x - mean) / scale
        weights = logistic(z, y.astype(float))
        p = 1 / (1 + np.exp(-np.clip(z @ weights[1:] + weights[0], -30, 30)))
        loss = -float(np.mean(np.log(np.where(y == 1, p, 1 - p))))
        if found is None or loss < found[0]:
            found = loss, Model(base, *halves[2], weights.tolist(), mean.tolist(), scale.tolist())
    return found[1]


def sample(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> list[tuple[str, int]]:
    """At most ``TOXIC_ROWS`` and ``ORDINARY_ROWS`` labelled rows in hash order of
    their ids, and ``CLASS_BYTES`` bytes of either class, for the driver. An id with
    several labels is toxic if one of them is; texts that would pass the bound
    and empty ones aren't taken."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & F.col("_id").isNotNull())
    known = known.groupBy("_id").agg(F.max("_y").alias("_y"))
    sized = docs.select(F.col(id_col).alias("_id"), F.octet_length(text_col).cast("long").alias("_n"), allowed.alias("_may")).where(F.col("_may") & F.col("_n").between(1, CLASS_BYTES))
    known = known.join(sized.groupBy("_id").agg(F.sum("_n").alias("_n")), "_id")
    few = [known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(most) for y, most in ((1, TOXIC_ROWS), (0, ORDINARY_ROWS))]
    running = F.sum("_n").over(Window.partitionBy("_y").orderBy(F.xxhash64("_id"), "_id").rowsBetween(Window.unboundedPreceding, 0))
    taken = few[0].union(few[1]).withColumn("_sum", running).where(F.col("_sum") <= CLASS_BYTES)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).where(F.octet_length("_t").between(1, CLASS_BYTES))
    picked = texts.join(F.broadcast(taken.select("_id", "_y")), "_id")
    return [(r["_t"], r["_y"]) for r in picked.select("_t", "_y").collect()]


def texts_of(column: pa.Array, most: int = 500_000) -> Iterator[list[str | None]]:
    """A column's texts in lists that end when they hold ``most`` characters."""
    held, chars = [], 0
    for x in column:
        held.append(x.as_py())
        chars += len(held[-1] or "")
        if chars >= most:
            yield held
            held, chars = [], 0
    if held:
        yield held


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False, into: str = "score") -> DataFrame:
    """The score of every whole text, 0 to 1; a null, empty or blank text is scored
    as one without savings. Returns id and score, or all columns and the score
    in ``into``, which must not be one of them."""
    if keep_columns and into in docs.columns:
        raise ValueError(f"column {into} is there already")
    wanted = docs if keep_columns else docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    at = wanted.columns.index(text_col if keep_columns else "_text")
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Model(**shared.value).scorer()
        for batch in batches:
            scores = pa.array(np.concatenate([np.zeros(0), *(of(texts) for texts in texts_of(batch.column(at)))]), pa.float64())
            if keep_columns:
                yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, into])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), scores], ["doc_id", into])

    fields = wanted.schema if keep_columns else wanted.select("doc_id").schema
    return map_arrow(wanted, run, type(fields)([*fields.fields]).add(into, "double"))


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 3; null ids have that of the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3
