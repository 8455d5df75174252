"""Small tables that hold the odd cases, and brute-force counterparts."""

from __future__ import annotations

import random

DOCS = "doc_id bigint, text string, n_tokens int, key string, label string, score string, rules string, n int"


def docs(spark, rows):
    """A documents table with extra columns named like inner ones."""
    return spark.createDataFrame([(i, t, 1, "k", "l", "s", "r", 2) for i, t in rows], DOCS)


def prose(seed, n, words=300):
    rnd = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("the", "an", "ord", "mi", "sal") for b in range(words // 5)]
    out = [rnd.choice(vocab) for _ in range(n)]
    for i in range(9, n, 10):
        out[i] += rnd.choice([".", ".\n", ","])
    return " ".join(out)


ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one two three"), (5, "one two three"), (None, "lost id of a row")]


def unions(ids, pairs):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}
