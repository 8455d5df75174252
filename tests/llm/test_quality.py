import math
import zlib

import numpy as np

from rosterlake.llm import quality
from tests.llm.common import ODD, docs, prose


def corpus(n=240):
    rows, labels = [], []
    for i in range(1000, 1000 + n):
        good = i % 2
        text = prose(i, 80 + i % 90)
        if not good:
            text = [text.upper() + "!!", " ".join(w + "%%%" for w in text.split()), (text.split()[0] + " ") * 60][i % 3]
        rows.append((i, text + (" " + prose(7, 70) if i % 5 == 0 else "")))
        labels.append((i, good))
    return rows, labels


def plain_score(model, text):
    """One document's score in plain loops over its passages."""
    words = text.encode().split()
    passages = [quality.passage_features([b" ".join([*words[i : i + 64]])])[1] for i in range(0, len(words), 64)]
    doc, x = quality.passage_features([text.encode()])
    assert len(passages) == len(x)
    if not len(x):
        return 0.0
    dot = lambda m, v: [sum(a * b for a, b in zip(row, v, strict=True)) for row in m]
    w, hidden, energy = model.w, [], []
    for row in x:
        scaled = [(float(v) - m) / s for v, m, s in zip(row, model.mean, model.scale, strict=True)]
        h = [math.tanh(v + b) for v, b in zip(dot(w["W"], scaled), w["b"], strict=True)]
        gates = [math.tanh(t) / (1 + math.exp(-u)) for t, u in zip(dot(w["V"], h), dot(w["U"], h), strict=True)]
        hidden.append(h)
        energy.append(sum(a * b for a, b in zip(w["w"], gates, strict=True)))
    share = [math.exp(e - max(energy)) for e in energy]
    pooled = [sum(a * h[k] for a, h in zip(share, hidden, strict=True)) / sum(share) for k in range(len(hidden[0]))]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(w["c"], pooled, strict=True)) - w["d"][0]))


def test_scores_equal_plain_loops(spark):
    rows, labels = corpus(90)
    table = spark.createDataFrame(labels, "doc_id bigint, quality int")
    rows = rows + ODD + [(7, prose(9, 3000))]
    model = quality.train(docs(spark, rows), table)
    got = sorted((r.doc_id or 0, round(r.score, 6)) for r in quality.quality_scores(docs(spark, rows), table).collect())
    assert got == sorted((i or 0, round(plain_score(model, t or ""), 6)) for i, t in rows)


def test_held_out_documents_are_told_apart(spark):
    rows, labels = corpus()
    table = spark.createDataFrame(labels + [(None, 1), (1, None), (1000, 0)], "doc_id bigint, quality int")
    got = quality.quality_scores(docs(spark, rows + ODD), table).collect()
    assert len(got) == len(rows + ODD)
    truth, right, n = dict(labels), 0, 0
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.held_out and r.doc_id in truth:
            right, n = right + (r.predicted == truth[r.doc_id]), n + 1
    assert n > 50 and right / n >= 0.97
    assert {r.score for r in got if r.doc_id in (1, 2, 3)} == {0.0}


def test_held_out_labels_teach_nothing(spark):
    rows, labels = corpus(120)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    a, b = (
        {r.doc_id: r.score for r in quality.quality_scores(docs(spark, rows), spark.createDataFrame(x, "doc_id bigint, quality int")).collect()}
        for x in (labels, flipped)
    )
    assert a == b


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    got = {r.doc_id: r.score for r in quality.quality_scores(docs(spark, [(1, "some words"), (2, "")]), none).collect()}
    assert got == {1: 0.5, 2: 0.0}
    assert quality.quality_scores(docs(spark, []), none).count() == 0


def test_features_do_not_hang_on_the_batch():
    texts = [prose(i, 30 + 50 * i).encode() for i in range(6)] + [b"", b" \n ", "é ü".encode()]
    doc, x = quality.passage_features(texts)
    alone = [quality.passage_features([t])[1] for t in texts]
    assert np.allclose(x, np.concatenate(alone))
    assert np.bincount(doc, minlength=len(texts)).tolist() == [-(-len(t.split()) // quality.PASSAGE_WORDS) for t in texts]


def test_gradient_and_attention():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, quality.N_FEATURES)).astype(np.float32)
    doc, y = np.repeat(np.arange(10), 4), np.arange(10) % 2
    model = quality.AttentionModel().fit(doc, x, y, steps=150)
    p = model.scores(doc, x, 10)
    assert ((p >= 0.5) == y).all()
    assert np.isclose(model.attention(x[:4]).sum(), 1)
