"""Each operator against brute force, and on awkward and empty tables."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
import zstandard
from fixtures import awkward, empty, prose
from pyspark.sql import functions as F

from siftwood.llm import brown, graph, lines, mixing, neardup_vectors, packing, sharding, simhash, sketch, toxicity, warc
from siftwood.llm.common import bucket_of

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    out = awkward(spark).cache()
    out.count()
    return out


@pytest.fixture(scope="module")
def rows(docs):
    return [r.asDict() for r in docs.collect()]


def parts_of(n: int, links) -> list[int]:
    up = list(range(n))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return [root(i) for i in range(n)]


# --- shared ---------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(120)] + [(2000, 2001 + i) for i in range(300)] + [(5, 5), (None, 7)]
    want = parts_of(3000, [x for x in links if None not in x])
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links, "x long, y long").repartition(7), "x", "y").collect()}
    assert got == {i: want[i] for i in range(3000) if any(i in x and x[0] != x[1] for x in links if None not in x)}


def test_few_links_are_joined_at_once(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)], "a long, b long").repartition(5)
    sc = spark.sparkContext
    sc.setJobGroup("few", "few")
    try:
        few = dict(graph.components(links, "a", "b", few=61).collect())
        assert len(sc.statusTracker().getJobIdsForGroup("few")) < 10
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert few == {i: 0 for i in range(61)} | {100: 100, 101: 100} == dict(graph.components(links, "a", "b", few=5).collect())


def test_rounds_of_joins_keep_estimates_small(spark):
    from siftwood import session
    from siftwood.llm import common

    for checkpointed in (common.checkpointed, session.checkpointed):
        df = checkpointed(spark.range(4).select("id", (F.col("id") % 2).alias("x")))
        for _ in range(5):
            df = checkpointed(df.join(df.select("id", F.col("x").alias("y")), "id").select("id", F.coalesce("x", "y").alias("x")))
        # a checkpoint's estimate and those of a round on it; without a bound there are over a thousand bits
        assert df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2**128
        assert sorted(df.collect()) == [(0, 0), (1, 1), (2, 0), (3, 1)]


def test_components_of_nothing(spark):
    assert graph.components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def test_bucket_of(spark):
    bounds = [-5, 0, 3, 9]
    got = spark.range(-10, 15).select("id", bucket_of(F.col("id"), bounds).alias("b")).collect()
    assert all(r["b"] == sum(x <= r["id"] for x in bounds) for r in got)


# --- 1 --------------------------------------------------------------------------------------


def line_brute(rows):
    """Components of distinct lines by all pairs, and the lines kept."""
    texts = sorted({x for r in rows for x in (r["text"] or "").split("\n") if x.strip(" \t\r\x0b\x0c")})
    sets = [lines.shingles(x) for x in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    return dict(zip(texts, parts_of(len(texts), links), strict=True))


def test_lines(docs, rows):
    want = line_brute(rows)
    got = lines.line_groups(docs).collect()
    assert len(got) == sum(1 for r in rows for x in (r["text"] or "").split("\n") if x in want)
    at = {lines.line_id(x): c for x, c in want.items()}
    pairs = {(at[np.uint64(np.int64(r["line_id"])).item()], r["component_id"]) for r in got}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    kept = collections.Counter(r["component_id"] for r in got if r["kept"])
    assert set(kept) == {r["component_id"] for r in got} and max(kept.values()) == 1
    first = {}
    for r in got:
        key = (r["doc_id"] is None, r["doc_id"] or 0, r["line_no"])
        first[r["component_id"]] = min(first.get(r["component_id"], key), key)
    assert all((r["doc_id"] is None, r["doc_id"] or 0, r["line_no"]) == first[r["component_id"]] for r in got if r["kept"])


def test_line_recall_at_the_threshold(spark):
    rng = random.Random(9)
    base = [prose(rng, 40) for _ in range(60)]
    texts = []
    for b in base:
        changed = b.split(" ")
        changed[20] = "entirelychanged"
        texts += [b, " ".join(changed)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = line_brute([{"text": t} for t in texts])
    got = {r["line_id"]: r["component_id"] for r in lines.line_groups(docs).collect()}
    assert len(set(got.values())) == len(set(want.values()))


def test_dedup_lines(spark, docs, rows):
    out = lines.dedup_lines(docs)
    assert out.columns == docs.columns
    texts = [r["text"] for r in out.collect()]
    left = collections.Counter(x for t in texts for x in (t or "").split("\n") if x.strip())
    assert max(left.values()) == 1
    assert sum(t is None for t in texts) == sum(r["text"] is None for r in rows) and "" in texts
    alone = "one two three"
    assert alone in texts
    assert lines.dedup_lines(empty(spark)).count() == 0 and lines.line_groups(empty(spark)).count() == 0


@pytest.mark.parametrize("more", [{"BUCKET": 4}, {"BUCKET_CHARS": 2_000}, {"LEAD_ROWS": 3}])
def test_divided_buckets_lose_no_line(docs, rows, monkeypatch, more):
    want = line_brute(rows)
    for name, value in more.items():
        monkeypatch.setattr(lines, name, value)
    got = {r["line_id"]: r["component_id"] for r in lines.line_groups(docs).collect()}
    at = {np.uint64(lines.line_id(x)).view(np.int64).item(): c for x, c in want.items()}
    pairs = {(at[k], c) for k, c in got.items()}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


# --- 2 --------------------------------------------------------------------------------------


def toks(text):
    return [w.lower() for w in WORD.findall((text or "").encode())] + [None]


def test_brown_counts(docs, rows):
    train = collections.Counter(w for r in rows if not brown.held_out(r["doc_id"]) for w in toks(r["text"]))
    n, v = sum(train.values()), len(train)
    got = collections.defaultdict(list)
    for r in brown.score(docs, sweeps=2).collect():
        got[r["doc_id"]].append(r)
    for r in rows:
        w = toks(r["text"])
        want = sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        near = [g for g in got[r["doc_id"]] if g["n_tokens"] == len(w) and abs(g["base_score"] - want) < 1e-6]
        assert near and near[0]["n_known"] == sum(train[x] > 0 for x in w) and near[0]["train_tokens"] == n
        assert near[0]["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 10 == 0)
        assert math.isfinite(near[0]["score"]) and near[0]["score"] <= 1e-9


@pytest.mark.parametrize("d", [0.1, 0.6, 0.9])
@pytest.mark.parametrize("some", [True, False])
def test_brown_is_a_distribution(d, some):
    rng = np.random.default_rng(4)
    c = brown.CLASSES
    m = rng.integers(0, 50, (c, c)).astype(float) if some else np.zeros((c, c))
    m[7] = m[:, 7] = 0
    m[brown.END, brown.END] = 3
    size = m.sum(axis=0)
    words = np.where(size > 0, 5.0, 0.0) if some else np.zeros(c)
    words[brown.END] = 1
    model = brown.Scorer(m, words, d)
    for state in (0, 3, 7, c):
        known = 0.0
        for k in range(c):
            if size[k]:
                # words of a class share its size; discounts are taken from each of them
                emitted = (size[k] - (0 if k == brown.END else d * words[k])) / size[k]
                known += 10 ** model.move[state, k] * emitted
        assert known + 10 ** model.unknown[state] == pytest.approx(1, abs=1e-6)


def brown_slowly(rows, classes):
    """Log10 probability of each row's text by plain counts, given each token's class."""
    count, size, pair, members = collections.Counter(), collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for (doc, text), cls in zip(rows, classes, strict=True):
        if not brown.held_out(doc):
            before = 0
            for w, c in zip(toks(text), cls, strict=True):
                count[w] += 1
                size[c] += 1
                pair[before, c] += 1
                before = c
                if w is not None:
                    members[c].add(w)
    seen = collections.Counter(n for w, n in count.items() if w is not None)
    d = brown.discount(seen[1], seen[2])
    weight = {c: n + 0.1 for c, n in size.items()}
    whole = sum(weight.values())
    after = collections.Counter()
    for (b, _), n in pair.items():
        after[b] += n
    move = lambda b, c: (pair[b, c] + 5 * weight[c] / whole) / (after[b] + 5)
    lost = {c: d * len(members[c]) for c in members}
    given = sum(lost.values())
    step = lambda b, c: move(b, c) if b != "?" else sum(lost[x] / given * move(x, c) for x in lost)
    out = []
    for (_, text), cls in zip(rows, classes, strict=True):
        total, before = 0.0, 0
        for w, c in zip(toks(text), cls, strict=True):
            if count[w]:
                total += math.log10(step(before, c) * (count[w] - (0 if w is None else d)) / size[c])
                before = c
            else:
                total += math.log10(sum(step(before, x) * lost[x] / size[x] for x in lost))
                before = "?"
        out.append(total)
    return out


def test_brown_score_is_the_class_models(spark, docs, rows, monkeypatch):
    """Against plain counts, with blocks, reducers and chunks small enough that all are several."""
    for more in ({}, {"BLOCK_TOKENS": 300, "BLOCK_WORDS": 40, "TASK_WORDS": 100, "CHUNK": 8, "SMALL": 3}):
        for name, value in more.items():
            monkeypatch.setattr(brown, name, value)
        got = brown.score(docs, sweeps=3, with_words=True).collect()
        texts = collections.defaultdict(list)
        for r in rows:
            texts[r["doc_id"], len(toks(r["text"]))].append(r["text"])
        told = [(r["doc_id"], texts[r["doc_id"], r["n_tokens"]][0]) for r in got]
        classes = [list(r["classes"]) for r in got]
        assert len({c for x in classes for c in x}) > 20
        one: dict = {}
        for (_, text), cls in zip(told, classes, strict=True):
            for w, c in zip(toks(text), cls, strict=True):
                assert one.setdefault(w, c) == c
        assert [r["score"] for r in got] == pytest.approx(brown_slowly(told, classes), rel=1e-9, abs=1e-9)
    assert brown.score(docs, sweeps=0).count() == len(rows)


def test_exchange_raises_the_likelihood():
    """Each word's move, alone, doesn't lower the likelihood, and gains found are the real ones."""
    rng = np.random.default_rng(2)
    words = rng.integers(1, 200, 20_000)
    words = words[np.concatenate([[True], words[1:] != words[:-1]])]
    c = brown.CLASSES
    cls = rng.integers(1, c, 200)
    cls[0] = 0
    pairs = np.bincount(cls[words[:-1]] * c + cls[words[1:]], minlength=c * c).reshape(c, c)
    exchange, before = brown.Exchange(pairs), brown.likelihood(pairs)
    for w in range(1, 60):
        left, right = np.bincount(cls[words[:-1][words[1:] == w]], minlength=c), np.bincount(cls[words[1:][words[:-1] == w]], minlength=c)
        code = np.concatenate([np.flatnonzero(left), c + np.flatnonzero(right)])
        n = np.concatenate([left, right])[code]
        new = exchange.best(np.array([0]), code, n, cls[[w]])[0]
        moved = cls.copy()
        moved[w] = new
        after = brown.likelihood(np.bincount(moved[words[:-1]] * c + moved[words[1:]], minlength=c * c).reshape(c, c))
        assert after >= before - 2


def test_brown_sweeps_until_it_settles(spark):
    rng = random.Random(5)
    sets = [[f"{a}{i}" for i in range(150)] for a in "abcd"]
    texts = [" ".join(rng.choice(sets[(i + j) % 4]) for j in range(80)) for i in range(300)]
    cut = brown.checkpointed(brown.blocks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text"))
    leads = np.array(sorted(xxhash.xxh64_intdigest(w.encode()) for w in (sets[0][0], sets[1][0], sets[2][0], sets[3][0])), dtype=np.uint64)
    _, m, history = brown.cluster(cut, leads, 4, brown.SWEEPS)
    assert history[0] < max(history) == pytest.approx(brown.likelihood(m)) and len(history) < brown.SWEEPS


def test_brown_beats_unigrams_on_held_out_text(spark):
    rng = random.Random(8)
    sets = [[f"{a}{i}" for i in range(60)] for a in "abc"]
    rows = []
    for i in range(400):
        k = rng.randrange(3)
        rows.append((i, " ".join(rng.choice(sets[(k + j) % 3]) for j in range(60))))
    got = [r for r in brown.score(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["held_out"]]
    assert got and all(r["score"] > r["base_score"] for r in got)


def test_brown_without_rows(spark):
    assert brown.score(empty(spark)).count() == 0
    held = next(i for i in range(100) if brown.held_out(i))
    got = brown.score(spark.createDataFrame([(held, "never seen")], "doc_id long, text string")).first()
    assert (got["n_known"], got["train_tokens"], got["score"], got["base_score"]) == (0, 0, 0.0, 0.0)


# --- 3 --------------------------------------------------------------------------------------


def best_fit(sizes, capacity):
    bins: list[int] = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(bins) if r >= s]
        if fits:
            bins[min(fits, key=bins.__getitem__)] -= s
        else:
            bins.append(capacity - s)
    return sorted(bins)


@pytest.mark.parametrize("capacity", [1, 7, 64])
def test_plan_is_best_fit_decreasing(capacity):
    rng = random.Random(capacity)
    for _ in range(60):
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
        plan, used = packing.best_fit_plan(collections.Counter(sizes), capacity), collections.defaultdict(list)
        for length, n in collections.Counter(sizes).items():
            for rank in range(n):
                first, seq, each, off = plan[length][np.searchsorted(plan[length][:, 0], rank, side="right") - 1]
                used[seq + (rank - first) // each].append((off + (rank - first) % each * length, length))
        for own in used.values():
            at = 0
            for off, length in sorted(own):
                assert off == at
                at += length
            assert at <= capacity
        assert sorted(capacity - sum(x for _, x in own) for own in used.values()) == best_fit(sizes, capacity)


def test_pack(spark, docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(docs).collect()
    want = collections.Counter()
    for r in rows:
        ids = np.array([*slow.encode(r["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for i, (a, b) in enumerate(itertools.pairwise(cuts)):
            want[r["doc_id"], i, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    used = collections.defaultdict(list)
    for r in got:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in used.values():
        assert [a for a, _ in sorted(own)] == [0, *itertools.accumulate(b for _, b in sorted(own))][:-1] and sum(b for _, b in own) <= 2048
    assert len(used) == len(best_fit([r["length"] for r in got], 2048))
    assert packing.pack(empty(spark)).count() == 0


def test_encoder_is_the_tokenizer():
    encode = packing.public_encoder()
    for text in ("", "plain words", "<|endoftext|> in a text", " \n\n\t  x", "é漢字🙂", "a" * 3000, " " * 3000 + "b"):
        assert encode(text).tolist() == encode.slow.encode(text, add_special_tokens=False).ids


# --- 4 --------------------------------------------------------------------------------------


def vectors(spark, rng):
    base = rng.standard_normal((40, 16))
    near = base[:10].repeat(6, axis=0) + rng.standard_normal((60, 16)) * 0.12
    every = [*base.tolist(), *near.tolist(), *[base[0].tolist()] * 50, (3 * base[1]).tolist(), None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [1.0] * 8, [1.0] * 8, [float("inf")] * 16]
    return spark.createDataFrame([(1000 - i, v, 1, "x") for i, v in enumerate(every)], "vec_id long, embedding array<float>, label int, cls string")


def test_vectors(spark):
    df = vectors(spark, np.random.default_rng(3))
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    links = []
    for i, j in itertools.combinations(range(len(rows)), 2):
        if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95:
                links.append((i, j))
    root, n = parts_of(len(rows), links), collections.Counter(itertools.chain(*links))
    least = {r: min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in root}
    got = {r["vec_id"]: r for r in neardup_vectors.link(df).collect()}
    assert len(got) == len(rows)
    for i, (v, _) in enumerate(rows):
        assert (got[v]["n_links"], got[v]["component_id"], got[v]["kept"]) == (n[i], least[root[i]], v == least[root[i]])


def test_dense_vectors(spark):
    """Near copies and a dense cone below the threshold: every link in one window, and
    where orders, blocks, crowds and divisions are several."""
    rng = np.random.default_rng(11)
    middle, axis = rng.standard_normal(16), rng.standard_normal(16)
    copies = middle + 1e-6 * rng.standard_normal((700, 16))
    scaled = copies[:100] * rng.uniform(0.1, 9, (100, 1))
    cone = axis / np.linalg.norm(axis) + 0.11 * rng.standard_normal((900, 16))
    m = np.concatenate([copies, scaled, cone, rng.standard_normal((200, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>").repartition(5)
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = np.triu(m @ m.T >= 0.95, 1)
    root = parts_of(len(m), list(zip(*(x.tolist() for x in np.nonzero(near)), strict=True)))
    n = near.sum(axis=0) + near.sum(axis=1)
    got = {r["vec_id"]: r for r in neardup_vectors.link(df, window=2000).collect()}
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in range(len(m))] == [(n[i], root[i]) for i in range(len(m))]
    for more in ({"window": 256}, {"window": 64, "division": 16 * 150}):
        got = {r["vec_id"]: r for r in neardup_vectors.link(df, **more).collect()}
        assert all(got[i]["n_links"] <= n[i] for i in got) and sum(r["n_links"] for r in got.values()) >= 0.998 * n.sum()
        assert all(got[i]["n_links"] == n[i] and got[i]["component_id"] == root[i] for i in range(800))


def test_windows_cross_blocks(spark, monkeypatch):
    """Neighbours in the order that different blocks hold are met, and once."""
    monkeypatch.setattr(neardup_vectors, "BLOCK", 64)
    monkeypatch.setattr(neardup_vectors, "TASK_ROWS", 100)
    rng = np.random.default_rng(5)
    m = np.concatenate([v + 0.02 * rng.standard_normal((9, 12)) for v in rng.standard_normal((60, 12))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(1000 + i, [1.0, float(i)]) for i in range(90)], "vec_id long, embedding array<double>")
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    n = (m @ m.T >= 0.95).sum(axis=0) - 1
    got = {r["vec_id"]: r["n_links"] for r in neardup_vectors.link(df, window=64).collect()}
    assert sum(got[i] for i in range(len(m))) >= 0.998 * n.sum() and all(got[i] <= n[i] for i in range(len(m)))
    flat = np.array([[1.0, i] for i in range(90)])
    flat /= np.linalg.norm(flat, axis=1, keepdims=True)
    assert sum(got[1000 + i] for i in range(90)) >= 0.998 * ((flat @ flat.T >= 0.95).sum() - 90)


def test_vectors_with_odd_ids(spark):
    rows = [(None, [1.0, 2.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0]), (5, [2.0, 4.0]), (None, None)]
    got = sorted(repr((r["vec_id"], r["n_links"], r["component_id"])) for r in neardup_vectors.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == sorted(map(repr, [(None, 3, 5), (5, 3, 5), (5, 3, 5), (5, 3, 5), (None, 0, None)]))


def test_no_vectors(spark):
    assert neardup_vectors.link(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# --- 5 --------------------------------------------------------------------------------------


def test_shards(spark, docs, rows):
    got = sharding.shard_by_bytes(docs, 24).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == collections.Counter((r["doc_id"], size(r["text"]), zlib.crc32((r["text"] or "").encode())) for r in rows)
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    last = None
    for s in sorted(by):
        own = sorted(by[s], key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == [*range(len(own))]
        ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in own]
        assert ids == sorted(ids) and (last is None or ids[0] >= last)
        last = ids[-1]
        assert abs(sum(r["size"] for r in own) - total / 24) <= largest
    assert sharding.shard_by_bytes(empty(spark), 24).count() == 0


# --- 6 --------------------------------------------------------------------------------------


def test_audit(spark):
    rng = random.Random(6)
    rows = [(i, rng.randbytes(20).hex()) for i in range(500)] + [(7, "again"), (7, "again"), (None, "no id"), (600, "")]
    damaged = [(i, "damaged" if i in (3, 64, 499) else t) for i, t in rows if i not in (10, 11, 600)] + [(9999, "extra")]
    make = lambda x: warc.manifest(spark.createDataFrame(x, "id long, record string").repartition(3), "id", "record")
    primary = make(rows)
    found = primary.collect()
    at = 0
    for i, r in enumerate(sorted(found, key=lambda r: r["place"])):
        assert (r["place"], r["offset"]) == (i, at)
        at += r["length"]
    got = {(r["id"], r["state"]) for r in warc.audit(primary, make(damaged), fanout=16).collect()}
    assert got == {(3, "altered"), (64, "altered"), (499, "altered"), (10, "lost"), (11, "lost"), (600, "lost"), (9999, "extra")}
    assert warc.audit(primary, make(rows)).count() == 0
    whole = warc.report(primary, make(damaged), fanout=16)
    assert whole.count() == len(rows) + 1 and whole.where("state = 'intact'").count() == len(rows) - 6
    nothing = make(rows).limit(0)
    assert warc.audit(nothing, nothing).count() == 0
    assert {r["state"] for r in warc.audit(nothing, primary).collect()} == {"extra"}
    assert {r["state"] for r in warc.audit(primary, nothing).collect()} == {"lost"}


def test_audit_pairs_copies_by_digest(spark):
    make = lambda x: warc.manifest(spark.createDataFrame(x, "id long, record string").repartition(3), "id", "record")
    primary = make([(1, "a"), (1, "b"), (1, "b"), (1, "c"), (-5, "x"), (2**20, "far")])
    found = warc.audit(primary, make([(1, "b"), (1, "b"), (1, "c"), (-5, "y"), (2**20, "far"), (1, "b")]))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted((r["id"], r["digest"], r["replica_digest"], r["state"]) for r in found.collect()) == sorted([(1, digest("a"), digest("b"), "altered"), (-5, digest("x"), digest("y"), "altered")])


def test_audit_reads_differing_ranges_only(spark):
    make = lambda x: warc.manifest(spark.createDataFrame(x, "id long, record string"), "id", "record")
    rows = [(i, f"r{i}") for i in range(300)]
    a, b = make(rows), make([(i, t + "!" if i == 77 else t) for i, t in rows if i != 140])
    height = warc._height([a, b], 2)
    left, right = warc.tree(a, height, 4), warc.tree(b, height, 4)
    assert [x.count() for x in left] == [75, 19, 5, 2, 1] and left[-1].first()["bytes"] == sum(len(t) for _, t in rows)
    assert sorted(r["node"] for r in warc.differing(left, right, 4).collect()) == [19, 35]
    assert warc.differing(left, warc.tree(make(rows), height, 4), 4).count() == 0


# --- 7 --------------------------------------------------------------------------------------


def slow_simhash(text, width=4):
    words = [w.lower().decode() for w in WORD.findall((text or "").encode())]
    if not words:
        return 0
    runs = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(spark, docs, rows):
    got = simhash.groups(docs).collect()
    prints = [slow_simhash(r["text"]) for r in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= 4]
    root = parts_of(len(rows), links)
    least = {r: min((rows[i]["doc_id"] for i in range(len(rows)) if root[i] == r and rows[i]["doc_id"] is not None), default=None) for r in root}
    want = collections.Counter((r["doc_id"], prints[i], least[root[i]]) for i, r in enumerate(rows))
    assert collections.Counter((r["doc_id"], r["fingerprint"] % 2**64, r["component_id"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(set(root))
    assert simhash.groups(empty(spark)).count() == 0


def similar_slowly(rows):
    """Component of each row by all pairs of five-word shingle sets, 0.8 alike or more."""
    sets = []
    for r in rows:
        w = [x.lower() for x in WORD.findall((r["text"] or "").encode())]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    return parts_of(len(rows), [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if alike(sets[i], sets[j])])


def check_similar(rows, got, component="_component", kept="_kept"):
    root = similar_slowly(rows)
    least = {r: min((rows[i]["doc_id"] for i in range(len(rows)) if root[i] == r and rows[i]["doc_id"] is not None), default=None) for r in root}
    assert collections.Counter((r["doc_id"], r["text"], r[component]) for r in got) == collections.Counter((r["doc_id"], r["text"], least[root[i]]) for i, r in enumerate(rows))
    assert sum(r[kept] for r in got) == len(set(root))


def test_similar(spark, docs, rows):
    out = simhash.similar(docs)
    assert out.columns == [*docs.columns, "_component", "_kept"]
    check_similar(rows, out.collect())
    assert simhash.similar(empty(spark)).count() == 0


@pytest.mark.parametrize("more", [{}, {"BUCKET": 3, "LEAD_ROWS": 2}])
def test_similar_near_the_threshold(spark, monkeypatch, more):
    """Edited copies that are alike to their source and not to each other, in small and large groups;
    also where buckets are divided and leads spread."""
    for name, value in more.items():
        monkeypatch.setattr(lines, name, value)
    rng = random.Random(21)
    texts = []
    for _ in range(25):
        source = prose(rng, 200).split()
        texts.append(" ".join(source))
        for _ in range(rng.choice([1, 2, 9])):
            changed = list(source)
            for at in rng.sample(range(200), rng.choice([1, 2, 4])):
                changed[at] = f"other{rng.random()}"
            texts.append(" ".join(changed))
    rng.shuffle(texts)
    rows = [{"doc_id": i, "text": t, "_kept": 5, "_row": 1, "_KEPT": 2} for i, t in enumerate(texts)]
    df = spark.createDataFrame([(r["doc_id"], r["text"], 5, 1) for r in rows], "doc_id long, text string, _KEPT long, _row long").repartition(4)
    out = simhash.similar(df)
    assert out.columns == [*df.columns, "__component", "__kept"] and out.agg(F.sum("_KEPT"), F.sum("_row")).first()[:] == (5 * len(rows), len(rows))
    check_similar(rows, out.collect(), "__component", "__kept")


def test_ball_finds_every_pair_within_four_bits(spark):
    rng = random.Random(12)
    own = [rng.getrandbits(64) for _ in range(60)]
    for f in own[:40]:
        for d in (1, 3, 4, 5):
            own.append(f ^ sum(1 << b for b in rng.sample(range(64), d)))
    links = [(i, j) for i, j in itertools.combinations(range(len(own)), 2) if (own[i] ^ own[j]).bit_count() <= 4]
    want = parts_of(len(own), links)
    signed = np.array(own, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "f long")
    got = {r["node"]: r["root"] for r in graph.components(simhash.ball_links(df, "f"), "a", "b").collect()}
    found = [got.get(x, x) for x in signed]
    assert len(set(zip(want, found, strict=True))) == len(set(want)) == len(set(found))


# --- 8 --------------------------------------------------------------------------------------


def labelled(rng, n):
    insults = ["grobnik", "snarvol", "zwittle", "quarmox"]
    rows = []
    for i in range(n):
        words, toxic = prose(rng, rng.randint(30, 200)).split(), int(rng.random() < 0.25)
        for _ in range(rng.randint(3, 8) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(insults)
        rows.append((i, " ".join(words), toxic))
    return rows


def slow_score(model, text):
    """Every window compressed alone by each dictionary, and the logistic sum written out."""
    runs = toxicity.windows(text)
    size = lambda content, run: len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), level=toxicity.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress(run))
    x = []
    for other in (model.base, model.control + model.base):
        saved = [size(other, r) - size(model.toxic + model.base, r) for r in runs]
        if saved:
            x += [max(-5, min(20, sum(saved) / len(saved))), *(sum(s >= n for s in saved) / len(saved) for n in range(1, 7)), math.log1p(sum(s for s in saved if s >= 3)), max(-5, min(12, max(saved)))]
        else:
            x += [0.0] * 9
    z = model.weights[0] + sum(w * (v - m) / s for w, v, m, s in zip(model.weights[1:], x, model.mean, model.scale, strict=True))
    return 1 / (1 + math.exp(-z))


def test_labels_of_equal_texts_and_the_order_of_rows_are_settled():
    rows = [(t, y) for _, t, y in labelled(random.Random(6), 120)]
    more = [*rows, (rows[0][0], 1 - rows[0][1]), (rows[5][0], 0), (rows[5][0], 1)]
    a, b = toxicity.fit(more), toxicity.fit(list(reversed(more)))
    assert vars(a) == vars(b) and a.weights


def test_toxicity(spark):
    rows = labelled(random.Random(4), 900)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(5000, None), (5001, ""), (5002, " \n"), (5003, "w" * 9000), (None, "no id"), (3, rows[3][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows] + [(None, 1, 0), (1, None, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(toxicity.sample(docs, labels, toxicity.fold() != 1))
    slow = lambda text: slow_score(model, text)
    for r in toxicity.score(docs, model, keep_columns=True, into="likely").collect():
        assert r["likely"] == pytest.approx(slow(r["text"]), abs=1e-9)
    with pytest.raises(ValueError, match="text"):
        toxicity.score(docs, model, keep_columns=True, into="text")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert len(got) == 905 and all(0 <= s <= 1 for s in got.values())
    held = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((s >= 0.7) == bool(y) for s, y in held) >= 0.95 * len(held)
    assert got[5000] == got[5001] == got[5002] and got[5001] < 0.7
    assert toxicity.score(docs.limit(0), model).count() == 0
    nothing = toxicity.fit(toxicity.sample(docs, labels.limit(0), F.lit(True)))
    assert {r["score"] for r in toxicity.score(docs, nothing).collect()} == {0.0}


def test_windows_hold_the_whole_text():
    rng = random.Random(7)
    for n in (0, 1, 30, 500):
        text = prose(rng, n) + " " + "x" * (n * 3)
        runs = toxicity.windows(text)
        assert "".join(x.decode().replace(" ", "") for x in runs) == text.replace(" ", "") and all(len(x) <= toxicity.WINDOW for x in runs)


# --- 9 --------------------------------------------------------------------------------------


def test_rake_meets_the_marginals():
    rng = random.Random(1)
    cells = {k: rng.random() * 100 for k in itertools.product("abc", "xy", "pqr")}
    targets = ({"a": 0.5, "b": 0.3, "c": 0.2}, {"x": 0.6, "y": 0.4}, {"p": 0.2, "q": 0.2, "r": 0.6})
    factors = mixing.rake(cells, targets)
    total = sum(cells.values())
    for i, aim in enumerate(targets):
        for name, share in aim.items():
            assert sum(f * cells[k] for k, f in factors.items() if k[i] == name) / total == pytest.approx(share, abs=1e-8)
    assert mixing.rake({}, targets) == {} and mixing.rake({("a", "x", "p"): 0.0}, targets) == {}


def test_many_cells_are_raked_as_a_table(spark, monkeypatch):
    rng = random.Random(3)
    texts = [(i, "w " * rng.randint(1, 30), f"s{i % 3}", rng.choice(["en", "fr"])) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string, lang string")
    wanted = {"lang": {"en": 0.5, "fr": 0.4, "none": 0.1}}
    told = lambda: {r["doc_id"]: (r["_weight"], r["_probability"]) for r in mixing.mix(docs, wanted, topic=F.lit("t")).collect()}
    near = told()
    monkeypatch.setattr(mixing, "LOCAL_CELLS", 0)
    far = told()
    for i, x in near.items():
        assert far[i] == pytest.approx(x, rel=1e-4)


def test_topics_follow_the_words(spark):
    rng = random.Random(2)
    sets = [[f"{a}{i}" for i in range(30)] for a in ("sea", "law", "ore")]
    rows = [(i, " ".join(rng.choice(sets[i % 3]) for _ in range(80)), "s", "en") for i in range(150)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()
    by = collections.defaultdict(set)
    for r in got:
        by[r["_topic"]].add(r["doc_id"] % 3)
    assert len(by) >= 3 and all(len(x) == 1 for x in by.values())


def test_mix_leaves_other_columns_alone(spark):
    docs = spark.createDataFrame([(i, "some words here", "s", "en", "x", 7) for i in range(5)], "doc_id long, text string, source string, lang string, _Source string, _tokens long")
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, *("__" + n for n in mixing.ADDED)]
    assert {(r["_Source"], r["_tokens"], r["__source"], r["__tokens"]) for r in out.collect()} == {("x", 7, "s", 3)}


def test_mix(spark, docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(0 <= r["_probability"] <= 1 for r in got)
    weight = collections.Counter()
    for r in got:
        weight["source", r["_source"]] += r["_tokens"] * r["_weight"]
        assert r["_tokens"] == len(WORD.findall((r["text"] or "").encode()))
        u = int(hashlib.md5(f"{'' if r['doc_id'] is None else r['doc_id']}|{mixing.SEED}".encode()).hexdigest()[:13], 16) / 2**52
        assert r["_sampled"] == (u < r["_probability"])
    tokens = collections.Counter()
    for r in got:
        tokens[r["_source"]] += r["_tokens"]
    total = sum(tokens.values())
    for name in mixing.MARGINS:
        own, weighed = collections.Counter(), collections.Counter()
        for r in got:
            own[r[f"_{name}"]] += r["_tokens"]
            weighed[r[f"_{name}"]] += r["_tokens"] * r["_weight"]
        for label, share in mixing.tempered(own).items():
            assert weighed[label] / total == pytest.approx(share, rel=1e-3)
    kept = mixing.mix(docs, keep=0.5).agg(F.sum(F.col("_tokens") * F.col("_probability")) / F.sum("_tokens")).first()[0]
    assert kept == pytest.approx(0.5, abs=1e-6)
    assert mixing.mix(empty(spark)).count() == 0
    own = mixing.mix(docs, targets={"source": {"s1": 1.0}}).collect()
    assert all(not r["_sampled"] for r in own if r["_source"] != "s1")


def test_keep_leaves_the_marginals_met(spark):
    texts = [("big", "en", 900), ("big", "fr", 60), ("small", "en", 30), ("small", "fr", 10)]
    docs = spark.createDataFrame([(i, "w " * n, s, g) for i, (s, g, n) in enumerate(texts)], "doc_id long, text string, source string, lang string")
    got = mixing.mix(docs, keep=0.75, topic=F.lit("t")).collect()
    total = sum(r["_tokens"] for r in got)
    assert max(r["_probability"] for r in got) <= 1 + 1e-9
    assert sum(r["_tokens"] * r["_probability"] for r in got) / total == pytest.approx(0.75, abs=1e-6)
    for r in got:  # one number for all: the mix kept is the mix weighted
        assert r["_probability"] == pytest.approx(0.75 * r["_weight"], rel=1e-6)
    small = sum(r["_tokens"] * r["_probability"] for r in got if r["_source"] == "small") / (0.75 * total)
    assert 0.04 < small < mixing.tempered({"big": 960, "small": 40})["small"]


# --- 10 -------------------------------------------------------------------------------------


def test_fingerprints(spark, docs, rows):
    got = sketch.fingerprints(docs).collect()
    assert len(got) == len(rows)
    known = sorted((r for r in rows if r["doc_id"] is not None), key=lambda r: -r["doc_id"]) + [r for r in rows if r["doc_id"] is None]
    follows = {}
    for i, r in enumerate(known):
        follows.setdefault(r["doc_id"], set()).add(known[(i + 1) % len(known)]["text"] or "")
    texts = {r["doc_id"]: r["text"] or "" for r in rows}
    prints = {}
    for r in got:
        t = texts[r["doc_id"]]
        cut = len(t) // 3
        assert r["n_chars"] == len(t) and r["edited"] in {t[: len(t) - cut] + n[:cut] for n in follows[r["doc_id"]]}
        prints.setdefault(t, set()).add(tuple(r["sketch"]))
        words = [w.decode() for w in WORD.findall(t.encode())]
        runs = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        assert len(r["sketch"]) == min(len(runs), sketch.K) and list(r["sketch"]) == sorted(r["sketch"])
    assert all(len(x) == 1 for x in prints.values())
    assert sketch.fingerprints(empty(spark)).count() == 0


def test_sketch_estimates_and_merges(spark):
    rng = random.Random(3)
    a = [rng.getrandbits(40) for _ in range(6000)]
    rows = [(1, " ".join(f"{x:x}" for x in a[:4000])), (2, " ".join(f"{x:x}" for x in a[2000:]))]
    df = sketch.with_sketch(spark.createDataFrame(rows, "i int, t string"), "t", "s", width=1)
    pair = df.where("i = 1").select(F.col("s").alias("x")).join(df.where("i = 2").select(F.col("s").alias("y")))
    got = pair.select(sketch.resemblance(F.col("x"), F.col("y")), sketch.containment(F.col("x"), F.col("y")), sketch.distinct_shingles(F.col("x")), sketch.merge(F.col("x"), F.col("y"))).first()
    assert got[0] == pytest.approx(1 / 3, abs=0.13) and got[1] == pytest.approx(0.5, abs=0.17) and got[2] == pytest.approx(4000, rel=0.3)
    whole = sketch.with_sketch(spark.createDataFrame([(" ".join(f"{x:x}" for x in a),)], "t string"), "t", "s", width=1).first()["s"]
    assert got[3] == whole
    assert sketch.merged(df.withColumn("g", F.lit(1)), ["g"], "s").first()["s"] == whole


def test_ball_links_of_a_dense_group_are_few(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LINKS", 100, raising=False)
    rng = random.Random(12)
    base = rng.getrandbits(63)
    dense = {base} | {base ^ 1 << rng.randrange(62) ^ 1 << rng.randrange(62) for _ in range(300)}
    pairs = [rng.getrandbits(63) for _ in range(20)]
    fps = sorted(dense | set(pairs) | {x ^ 0b1111 for x in pairs})
    links = simhash.ball_links(spark.createDataFrame([(x,) for x in fps], "f long"), "f")
    found = links.collect()
    assert len(found) < 5 * len(fps)
    up = {x: x for x in fps}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for r in found:
        a, b = sorted((top(r["a"]), top(r["b"])))
        up[b] = a
    assert len({top(x) for x in dense}) == 1 and all(top(x) == top(x ^ 0b1111) != top(base) for x in pairs)
    assert len({top(x) for x in fps}) == 21


def test_near_keys_meet_where_their_anchors_are(monkeypatch):
    rng = np.random.default_rng(5)
    anchors = rng.integers(1, 2**40, 5, dtype=np.uint64)
    keys = (np.repeat(anchors, [300, 2, 1, 40, 2]) << np.uint64(16)) | rng.integers(0, 2**16, 345, dtype=np.uint64)
    ids, sizes, component = np.arange(345, dtype=np.uint64), np.full(345, 9, np.uint32), np.arange(345) // 2
    masks = simhash.ball(2, 16)
    sent = simhash._sent(keys, keys >> np.uint64(16), ids.view(np.int64), sizes, component, 3)
    assert sent.num_rows <= 3

    def met(most):
        monkeypatch.setattr(simhash, "NEAR_KEYS", most)
        rows = [r for b in simhash.meet_near(iter([sent]), masks) for r in b.to_pylist()]
        buckets = {}
        for r in rows:
            buckets.setdefault(r["bucket"], set()).add(r["k"])
        return {(a, b) for x in buckets.values() for a in x for b in x if a < b}

    near = (keys[:, None] >> np.uint64(16) == keys[None, :] >> np.uint64(16)) & (np.bitwise_count(keys[:, None] ^ keys[None, :]) <= 4)
    want = {(a, b) for a, b in zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1))), strict=True)}
    # a bucket whose members are of one component already is none
    apart = {(a, b) for a, b in want if component[a] != component[b]}
    for most in (16_384, 100, 4):
        got = met(most)
        assert apart <= got <= want and len(apart) > 1000
