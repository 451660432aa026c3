"""Mixing sources to target weights by iterative proportional fitting.

Token totals of the cells source x language x topic are raked until the
source, language and topic marginals meet their targets; a document is kept
with a probability proportional to its cell's factor.

Topics are learned where documents have no column for them: spherical k-means
over hashed word counts of all whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, collected, drop_stored, free_prefix, map_arrow, stored

MISSING = "<none>"
TEMPER, SEED = 0.7, "mix-1"
#: Topics, word buckets of a text's features, and rounds in which topics are learned.
TOPICS, DIMS, TOPIC_ROUNDS = 8, 64, 10
#: Cells up to which the driver rakes; more are raked as a table.
LOCAL_CELLS = 200_000
MARGINS = ("source", "lang", "topic")
ADDED = ("source", "lang", "topic", "tokens", "weight", "probability", "sampled")


def features(text: str | None) -> tuple[int, np.ndarray]:
    """(words, features) of a whole text: roots of its word counts in ``DIMS`` hash
    buckets, of length one; of a text without words, zeros."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0, np.zeros(DIMS, dtype=np.float32)
    x = np.sqrt(np.bincount(np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words)) % DIMS, minlength=DIMS))
    return len(words), (x / np.linalg.norm(x)).astype(np.float32)


def learned_topics(told: DataFrame, topics: int = TOPICS, rounds: int = TOPIC_ROUNDS) -> np.ndarray:
    """Centres of the topics of rows (n, x), a row each: k-means by cosine over all
    rows with words, from the first distinct ones by hash, until the rows' mean
    likeness to their centres rises no more."""
    some = told.where("n > 0")
    first = some.orderBy(F.xxhash64("x"), "x").limit(topics * 16).select("x").collect()
    start = list(dict.fromkeys(bytes(r["x"]) for r in first))[:topics]
    centres = np.frombuffer(b"".join(start), np.float32).reshape(-1, DIMS).astype(float)
    last = -1.0
    for _ in range(rounds if len(centres) > 1 else 0):

        def tally(batches: Iterator[pa.RecordBatch], centres: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
            sums, near, rows = np.zeros_like(centres), 0.0, 0
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.column(0).slice(at, 4096)
                    x = np.frombuffer(b"".join(part.to_pylist()), np.float32).reshape(-1, DIMS).astype(float)
                    like = x @ centres.T
                    own = like.argmax(axis=1)
                    near, rows = near + float(like.max(axis=1).sum()), rows + len(x)
                    np.add.at(sums, own, x)
            values = np.concatenate([sums.ravel(), [near, rows]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["i", "v"])

        got = collected(map_arrow(some.select("x"), tally, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")))  # topics x DIMS rows
        values = np.zeros(centres.size + 2)
        for r in got:
            values[r["i"]] = r["v"]
        sums = values[:-2].reshape(centres.shape)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        # rounded, as sums differ in their last digits with the order of rows
        centres = np.where(size > 0, np.round(sums / np.maximum(size, 1e-12), 6), centres)
        now = values[-2] / max(values[-1], 1.0)
        if now - last < 1e-5:
            break
        last = now
    return centres


def tempered(totals: Mapping[str, float], power: float = TEMPER) -> dict[str, float]:
    """Target shares: shares to the power, scaled to one; large categories shrink."""
    raised = {k: v**power for k, v in totals.items() if v > 0}
    whole = sum(raised.values())
    return {k: v / whole for k, v in raised.items()}


def rake(cells: Mapping[tuple[str, ...], float], targets: tuple[Mapping[str, float], ...], rounds: int = 500, close: float = 1e-10) -> dict[tuple[str, ...], float]:
    """Factors that bring the cells' weights to the target shares of each marginal.

    Each round scales the cells to one marginal after the other. A target of a
    category without weight is dropped and the others' scaled up; a category
    without a target keeps nothing. Targets that the cells can't meet together
    (cells that are empty) end at the last round.
    """
    names = [k for k, v in cells.items() if v > 0 and all(targets[i].get(x, 0) > 0 for i, x in enumerate(k))]
    if not names:
        return {}
    weight = np.array([float(cells[k]) for k in names])
    fitted = weight / weight.sum()
    margins = []
    for i in range(len(targets)):
        values = sorted({k[i] for k in names})
        at = {x: j for j, x in enumerate(values)}
        aim = np.array([targets[i][x] for x in values], dtype=float)
        margins.append((np.array([at[k[i]] for k in names]), aim / aim.sum()))
    for _ in range(rounds):
        off = 0.0
        for at, aim in margins:
            now = np.bincount(at, weights=fitted, minlength=len(aim))
            scale = aim / np.maximum(now, 1e-300)
            off = max(off, float(np.abs(scale - 1).max()))
            fitted = fitted * scale[at]
        if off < close:
            break
    return {k: float(f / (w / weight.sum())) for k, f, w in zip(names, fitted, weight, strict=True)}


def kept_share(cells: Mapping[tuple[str, ...], float], targets: tuple[Mapping[str, float], ...], factors: dict[tuple[str, ...], float], keep: float) -> tuple[dict[tuple[str, ...], float], float]:
    """Factors and the common number that keep the share ``keep`` of the tokens with no probability above one.

    Where the targets can't be met with so many tokens kept, they are drawn
    towards the shares the cells have (share^(1 - x) * target^x) just as far as
    they can be met, so that the expected mix meets them exactly.
    """
    every = sum(cells.values())
    cells = {k: cells[k] for k in factors}
    keep = min(1.0, keep * every / sum(cells.values()))
    own = []
    for i in range(len(targets)):
        totals: dict[str, float] = {}
        for k, v in cells.items():
            totals[k[i]] = totals.get(k[i], 0.0) + v
        own.append({x: (t / sum(totals.values()), targets[i][x]) for x, t in totals.items()})
    fits = lambda found: keep * max(found.values()) <= 1 + 1e-9
    if not fits(factors):
        low, high = 0.0, 1.0
        factors = dict.fromkeys(cells, 1.0)
        for _ in range(24):
            x = (low + high) / 2
            tried = rake(cells, tuple({name: share ** (1 - x) * aim**x for name, (share, aim) in margin.items()} for margin in own))
            if fits(tried):
                low, factors = x, tried
            else:
                high = x
    return factors, keep


def _rake_far(cells: DataFrame, targets: Mapping[str, DataFrame], rounds: int = 100, close: float = 1e-6) -> DataFrame:
    """``rake`` over a table (source, lang, topic, t): a join and a sum a marginal
    and round, so every category keeps its target however many there are."""
    total = cells.where("t > 0")
    for name in MARGINS:
        total = total.join(targets[name].where("aim > 0").select(F.col("k").alias(name)), name, "left_semi")
    total = checkpointed(total.select(*MARGINS, "t"))
    whole = float(total.agg(F.sum("t")).first()[0] or 0)
    fitted = total.withColumn("w", F.col("t") / F.lit(whole or 1.0))
    scales = {}
    for name in MARGINS:
        own = targets[name].join(total.select(F.col(name).alias("k")).distinct(), "k")
        sum_ = float(own.agg(F.sum("aim")).first()[0] or 1.0)
        scales[name] = checkpointed(own.select(F.col("k").alias(name), (F.col("aim") / F.lit(sum_)).alias("aim")))
    for _ in range(rounds):
        off = 0.0
        for name in MARGINS:
            now = fitted.groupBy(name).agg(F.sum("w").alias("now")).join(scales[name], name).select(name, (F.col("aim") / F.col("now")).alias("scale"))
            now = checkpointed(now)
            off = max(off, float(now.agg(F.max(F.abs(F.col("scale") - 1))).first()[0] or 0.0))
            fitted = checkpointed(fitted.join(now, name).select(*MARGINS, "t", (F.col("w") * F.col("scale")).alias("w")))
        if off < close:
            break
    return fitted.select(*MARGINS, "t", (F.col("w") * F.lit(whole) / F.col("t")).alias("factor"))


def _factors_far(cells: DataFrame, targets: Mapping[str, Mapping[str, float]], keep: float | None) -> DataFrame:
    """(source, lang, topic, weight, probability) as ``mix`` wants them, of any number of cells."""
    spark = cells.sparkSession
    aims, own = {}, {}
    for name in MARGINS:
        shares = checkpointed(cells.where("t > 0").groupBy(F.col(name).alias("k")).agg(F.sum("t").cast("double").alias("share")))
        sum_ = float(shares.agg(F.sum("share")).first()[0] or 1.0)
        if name in targets:
            aims[name] = checkpointed(spark.createDataFrame(list(targets[name].items()), "k string, aim double"))
        else:
            aims[name] = checkpointed(shares.select("k", F.pow("share", F.lit(TEMPER)).alias("aim")))
        own[name] = checkpointed(shares.join(aims[name], "k").select("k", (F.col("share") / F.lit(sum_)).alias("share"), "aim"))
    most = lambda x: float(x.agg(F.max("factor")).first()[0] or 0.0)
    raked = _rake_far(cells, aims)
    common = 1 / (most(raked) or 1.0)
    if keep is not None:
        sums = {name: float(own[name].agg(F.sum("aim")).first()[0] or 1.0) for name in MARGINS}
        has, every = (float(x.agg(F.sum("t")).first()[0] or 1.0) for x in (raked, cells))
        common = min(1.0, keep * every / has)
        if common * most(raked) > 1 + 1e-9:
            low, high = 0.0, 1.0
            best = raked.withColumn("factor", F.lit(1.0))
            for _ in range(12):
                x = (low + high) / 2
                drawn = {name: own[name].select("k", (F.pow("share", F.lit(1 - x)) * F.pow(F.col("aim") / F.lit(sums[name]), F.lit(x))).alias("aim")) for name in MARGINS}
                tried = _rake_far(cells, drawn)
                if common * most(tried) <= 1 + 1e-9:
                    low, best = x, tried
                else:
                    high = x
            raked = best
    return raked.select(*MARGINS, F.col("factor").alias("weight"), F.least(F.lit(1.0), F.col("factor") * F.lit(common)).alias("probability"))


def _factors(cells: DataFrame, targets: Mapping[str, Mapping[str, float]], keep: float | None) -> DataFrame:
    """As ``_factors_far``, raked by the driver."""
    held = {tuple(r[n] for n in MARGINS): float(r["t"]) for r in cells.collect()}  # at most LOCAL_CELLS
    wanted = []
    for i, name in enumerate(MARGINS):
        totals: dict[str, float] = {}
        for k, v in held.items():
            totals[k[i]] = totals.get(k[i], 0.0) + v
        wanted.append(targets.get(name) or tempered(totals))
    factors = rake(held, tuple(wanted))
    common = 1 / max(factors.values()) if factors else 0.0
    if keep is not None and factors:
        factors, common = kept_share(held, tuple(wanted), factors, keep)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in MARGINS] + [T.StructField("weight", T.DoubleType()), T.StructField("probability", T.DoubleType())])
    return F.broadcast(cells.sparkSession.createDataFrame([(*k, f, min(1.0, common * f)) for k, f in factors.items()], schema))


def uniform(id_col: Column) -> Column:
    """A number from 0 to 1 that depends on the id and ``SEED`` alone; null ids share one."""
    digest = F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(f"|{SEED}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def added(docs: DataFrame) -> dict[str, str]:
    """The names that ``mix`` gives the columns it adds: those of ``ADDED`` behind a free prefix."""
    prefix = free_prefix(docs.columns, list(ADDED))
    return {n: prefix + n for n in ADDED}


def mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, keep: float | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None) -> DataFrame:
    """``docs`` with the source, lang, topic, tokens, weight, probability and sampled
    columns named by ``added``.

    ``targets`` gives shares for "source", "lang" and "topic"; where one is
    missing, it is the tempered share of every category. Up to ``LOCAL_CELLS``
    cells are raked by the driver, which gets their totals only, more as a table,
    with the same result. ``weight`` is the cell's factor, ``probability`` the
    factor times a common number: without ``keep`` the largest at which none
    passes one, so the expected mix meets the targets exactly; with ``keep`` this
    share of the tokens in expectation (all that have a target, if those are
    fewer), with targets drawn towards the shares that are there where they can't
    be met so (``kept_share``). ``topic`` names a column; without it topics are
    learned from the texts (``learned_topics``). A null label is "<none>", a null
    text has no tokens; a row whose cell has no weight (only texts without tokens)
    has probability 0. Equal ids are kept or dropped together. No rows: no rows.
    """
    targets = dict(targets or {})
    names = added(docs)
    label = lambda c: F.coalesce(c.cast("string"), F.lit(MISSING))
    given = docs.select(label(F.col(source_col)).alias("source"), label(F.col(lang_col)).alias("lang"), (F.lit(None).cast("string") if topic is None else label(topic)).alias("topic"), F.col(text_col).alias("text"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [features(x.as_py()) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([n for n, _ in told], pa.int64()), pa.array([x.tobytes() for _, x in told], pa.binary())], ["source", "lang", "topic", "n", "x"])

    told = stored(map_arrow(given, measured, "source string, lang string, topic string, n long, x binary"))
    centres = learned_topics(told) if topic is None else np.zeros((0, DIMS))

    def named(x: np.ndarray) -> list[str]:
        return [f"topic{i}" for i in (x @ centres.T).argmax(axis=1)] if len(centres) else [MISSING] * len(x)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.float32).reshape(-1, DIMS).astype(float)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(named(x), pa.string()), batch.column(3)], ["source", "lang", "topic", "n"])

    labelled = told.select("source", "lang", "topic", "n") if topic is not None else map_arrow(told, assigned, "source string, lang string, topic string, n long")
    cells = checkpointed(labelled.groupBy(*MARGINS).agg(F.sum("n").alias("t")))  # aggregated before the shuffle
    drop_stored(told)
    table = (_factors if cells.count() <= LOCAL_CELLS else _factors_far)(cells, targets, keep)
    at = docs.columns.index(text_col)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(x.as_py()) for x in batch.column(at)]
            x = np.array([v for _, v in got], dtype=float).reshape(-1, DIMS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([n for n, _ in got], pa.int64()), pa.array(named(x), pa.string())], [*batch.schema.names, names["tokens"], names["topic"]])

    schema = T.StructType([*docs.schema.fields, T.StructField(names["tokens"], T.LongType()), T.StructField(names["topic"], T.StringType())])
    rows = map_arrow(docs, marked, schema).withColumns({names["source"]: label(F.col(source_col)), names["lang"]: label(F.col(lang_col))})
    if topic is not None:
        rows = rows.withColumn(names["topic"], label(topic))
    table = table.select(*[F.col(n).alias(f"{names[n]}_of_cell") for n in MARGINS], F.col("weight").alias(names["weight"]), F.col("probability").alias(names["probability"]))
    same = [F.col(names[n]) == F.col(f"{names[n]}_of_cell") for n in MARGINS]
    rows = rows.join(table, same[0] & same[1] & same[2], "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in (names["weight"], names["probability"])}).withColumn(names["sampled"], uniform(F.col(id_col)) < F.col(names["probability"]))
    return rows.select(*docs.columns, *names.values())
