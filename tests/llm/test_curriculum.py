import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rosterlake.llm import curriculum

SCHEMA = "doc_id bigint, text string, source string, size int, target string, place int, row string, turn string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "t", 2, "r", "u") for r in rows], SCHEMA)


def n_words(text):
    return len((text or "").encode().replace(b"\x1c", b"x").replace(b"\x1d", b"x").split())


def fair_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    while open_:
        left = sum(sizes.values()) - sum(target.values())
        whole = sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * left / whole > 3 * sizes[s]}
        if not above:
            return weight, target | {s: weight[s] * left / whole for s in open_}
        target |= {s: 3 * sizes[s] for s in above}
        open_ -= above
    return weight, target


def brute(rows):
    """(doc_id, size, source_size, target, taken) and, per copy, (position, words, doc_id)."""
    by = defaultdict(list)
    for doc, text, source in rows:
        by[source].append((hashlib.md5(("-" if doc is None else str(doc)).encode()).hexdigest(), doc is not None, doc or 0, n_words(text), doc))
    sizes = {s: sum(d[3] for d in v) for s, v in by.items()}
    weight, target = fair_targets(sizes)
    out, copies = Counter(), []
    for s, docs in by.items():
        goal, ahead = math.floor(target[s] + 0.5), 0
        slope = {1: -0.5, 2: 0.0, 3: 0.5}[weight[s]]
        for *_, size, doc in sorted(docs):
            taken = 0
            for p in range(3):
                start = p * sizes[s] + ahead
                words = max(0, min(size, goal - start))
                if words:
                    lo, hi, share = 0.0, 1.0, start / goal
                    for _ in range(60):  # the integral (1 - k) t + k t^2, inverted by halving
                        mid = (lo + hi) / 2
                        lo, hi = (mid, hi) if (1 - slope) * mid + slope * mid * mid < share else (lo, mid)
                    copies.append((lo, words, doc))
                taken += words
            ahead += size
            out[(doc, size, sizes[s], round(target[s], 6), taken)] += 1
    return out, copies


def table(seed, sources):
    rnd = random.Random(seed)
    rows = [(i, " ".join("w" * rnd.randrange(1, 5) for _ in range(int(rnd.paretovariate(0.8)) % 900)), s) for i, s in enumerate(rnd.choices(sources, [9, *[1] * (len(sources) - 1)], k=400))]
    return [*rows, (None, "a b", sources[0]), (None, "a b c", None), (None, None, None), (3, "x\x1cy \x0b z z", "b"), (3, "same", "b"), (3, "same", "b"), (7, "", "empty only"), (8, None, "empty only")]


@pytest.mark.parametrize("sources", [["hot", "a", "b", "c", "é", "z", "😀", "ﬀ", None], ["b", "a"]])
def test_words_taken_equal_brute_force(spark, sources):
    rows = table(len(sources), sources)
    want, copies = brute(rows)
    mixed = curriculum.curriculum(frame(spark, rows)).cache()
    got = Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in curriculum.taken_words(mixed).collect())
    assert got == want
    order = curriculum.training_order(mixed).collect()
    assert sorted((r.words, r.doc_id if r.doc_id is not None else -1) for r in order) == sorted((w, d if d is not None else -1) for _, w, d in copies)
    assert np.allclose([r.position for r in order], sorted(c[0] for c in copies), atol=1e-9)
    ends = np.cumsum([0, *(r.words for r in order)])
    assert [r.first_word for r in order] == ends[:-1].tolist()
    for source in {r.source for r in order}:
        mine = [r for r in order if r.source == source]
        assert sum(r.words for r in mine) == math.floor(mine[0].target + 0.5)
    mixed.unpersist()


def test_heavy_sources_come_late(spark):
    rows = [(i, "a b c d e", s) for i, s in enumerate("abc" * 600)]
    mixed = curriculum.curriculum(frame(spark, rows))
    mean = {r.source: r.m for r in mixed.groupBy("source").agg((F.sum(F.col("position") * F.col("words")) / F.sum("words")).alias("m")).collect()}
    # Centres of the schedules 1.5 to 0.5, 1 and 0.5 to 1.5.
    assert mean["a"] == pytest.approx(5 / 12, abs=0.01) and mean["b"] == pytest.approx(0.5, abs=0.01) and mean["c"] == pytest.approx(7 / 12, abs=0.01)


def test_reruns_agree(spark):
    rows = table(5, ["hot", "a", "b"])
    once = curriculum.taken_words(curriculum.curriculum(frame(spark, rows)))
    shuffled = curriculum.taken_words(curriculum.curriculum(frame(spark, rows[::-1]).repartition(5)))
    assert Counter(once.collect()) == Counter(shuffled.collect())


def test_moments_of_a_schedule_with_gaps(spark):
    knots = [(0, 0), (0.25, 4), (0.25, 0), (0.5, 0), (1, 2)]
    share = [0.0, 0.1, 0.4, 0.5, 0.75, 1.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in share], "x double").select(curriculum.moment(F.col("x"), knots)).collect()]
    for x, t in zip(share, got, strict=True):
        done = 8 * t * t if t <= 0.25 else 0.5 + max(0.0, t - 0.5) ** 2 * 2
        assert done == pytest.approx(x, abs=1e-9)
    for bad in ([], [(0, 1)], [(0, 1), (1, -1)], [(0, 0), (1, 0)]):
        with pytest.raises(ValueError):
            curriculum.moment(F.col("x"), bad)


@pytest.mark.parametrize("step", [1, 3, 1 << 22])
def test_word_counts_over_borders_of_steps(monkeypatch, step):
    monkeypatch.setattr(curriculum, "_STEP", step)
    texts = ["one two", "three", None, "", " \t\n", "é ü\x0bö", "a" * 40, " x", "y ", "z", "日本 語"]
    for part in (pa.array(texts), pa.array(texts).slice(2, 7), pa.array([None, None], pa.string()), pa.array([], pa.string())):
        assert curriculum.word_counts(part).tolist() == [n_words(t) for t in part.to_pylist()]


def test_a_very_long_text_and_no_rows(spark):
    rows = [(1, "word " * 900_000, "a"), (2, "one", "b")]
    got = sorted(tuple(r)[:5] for r in curriculum.taken_words(curriculum.curriculum(frame(spark, rows))).collect())
    assert got == [(1, 900_000, 900_000, 899_998.0, 899_998), (2, 1, 1, 3.0, 3)]
    assert curriculum.taken_words(curriculum.curriculum(frame(spark, []))).count() == 0
