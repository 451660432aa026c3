"""Small documents with every awkward case, and helpers."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, k long, row long, line string, score double, bucket long"


def prose(rng: random.Random, n: int, words: int = 400) -> str:
    vocabulary = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "nu", "ro") for b in ("sta", "ver", "lin", "dor") for c in ("", "n", "s", "th", "ing")]
    return " ".join(vocabulary[min(len(vocabulary) - 1, int(rng.expovariate(1 / 25)))] for _ in range(n))


def awkward(spark, seed: int = 3):
    """Nulls in every column, empty, blank, very long and repeated texts, ties,
    repeated rows, and columns named as operators name their own."""
    rng = random.Random(seed)
    texts = [None, "", "   \n\t ", "one", "one two three", "é" * 10, "\n\n", "漢字 漢字 漢字", "a" * 5000, prose(rng, 20_000)]
    texts += ["\n".join(prose(rng, rng.randint(5, 40)) for _ in range(rng.randint(1, 8))) for _ in range(40)]
    copy = texts[15]
    texts += [copy] * 30 + [copy + " more", copy.replace("ka", "ka", 1)]
    near = texts[20].split(" ")
    for i in range(12):
        changed = list(near)
        changed[(7 * i) % len(changed)] = "changed"
        texts.append(" ".join(changed))
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s1", "s1", "s2", None]), None if t is None else len(t), 1, 2, 3, 4, "x", 0.5, 6) for i, t in enumerate(texts)]
    rows += [rows[12], rows[12], rows[12]]  # repeated rows
    rows.append((None, "a text without an id, of five words and more", "en", "s1", 3, 1, 2, 3, 4, "x", 0.5, 6))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
