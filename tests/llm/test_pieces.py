import math
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece

from rosterlake.llm import pieces
from tests.llm.common import ODD, docs, prose

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  a  b\n\n▁x\tñ é́ ﬁ ", "▁▁ ▁a", "日本語 🎉🎉 \x00\x7f", "a" * 3000, prose(1, 900)]


def test_decoding_gives_every_text_back(spark):
    rows = ODD + [(100 + i, t) for i, t in enumerate(TEXTS)]
    encoded = pieces.encode_pieces(docs(spark, rows), PATH, keep_ids=True)
    got = encoded.collect()
    assert all(r.lossless and r.n_pieces == len(r.ids) for r in got) and len(got) == len(rows)
    texts = Counter((r.doc_id, r.text) for r in pieces.decode_pieces(encoded, PATH).collect())
    assert texts == Counter((i, t or "") for i, t in rows)
    assert pieces.encode_pieces(docs(spark, []), PATH).count() == 0


def test_draws_hang_on_the_key_alone(monkeypatch):
    one = [x.tolist() for x in pieces.sampled_ids(TEXTS, [7] * len(TEXTS), PATH)]
    monkeypatch.setattr(pieces, "BLOCK_CHARS", 50)
    assert [x.tolist() for x in pieces.sampled_ids(TEXTS, [7] * len(TEXTS), PATH)] == one
    assert [x.tolist() for x in pieces.sampled_ids(TEXTS[::-1], [7] * len(TEXTS), PATH)][::-1] == one
    assert [x.tolist() for x in pieces.sampled_ids(TEXTS, [8] * len(TEXTS), PATH)] != one


def test_samples_follow_the_weights_of_all_segmentations():
    loaded = sentencepiece.SentencePieceProcessor(model_file=PATH)
    model, text, n = pieces.piece_model(PATH), "▁hello", 20000
    weight = {loaded.id_to_piece(i): loaded.get_score(i) * pieces.SHARPNESS for i in range(259, loaded.get_piece_size())}

    def ways(rest):
        if not rest:
            yield ()
        for k in range(1, len(rest) + 1):
            if rest[:k] in weight:
                for tail in ways(rest[k:]):
                    yield (rest[:k], *tail)

    mass = {tuple(map(loaded.piece_to_id, w)): math.exp(sum(weight[x] for x in w)) for w in ways(text)}
    ids, counts = model.sample([text] * n, pieces._mix(np.arange(n).astype(np.uint64) * pieces._M + np.uint64(5)))
    drawn = Counter(tuple(x.tolist()) for x in np.split(ids, np.cumsum(counts)[:-1]))
    for way, m in mass.items():
        assert abs(drawn[way] / n - m / sum(mass.values())) < 0.015


def test_runs_by_blocks_draw_the_same(monkeypatch):
    texts = ["a" * 3000 + "bcd", "日本語🎉▁" * 300, "x" + "Überlänge" * 200 + " and " + "ab" * 700, "\ue000" * 900, prose(3, 50) + " " + "q" * 400]
    whole = [x.tolist() for x in pieces.sampled_ids(texts, range(5), PATH)]
    for block in (37, 400, 1 << 16):
        monkeypatch.setattr(pieces, "LONG_RUN", 100)
        monkeypatch.setattr(pieces, "LONG_BLOCK", block)
        assert [x.tolist() for x in pieces.sampled_ids(texts, range(5), PATH)] == whole


def test_memory_of_a_very_long_run(monkeypatch):
    """A run beyond the bound: what is held beside the text and its ids is a block."""
    text = "Straßenbahn" * 24_000
    assert len(text) > pieces.LONG_RUN
    model = pieces.piece_model(PATH)
    tracemalloc.start()
    (ids,) = pieces.sampled_ids([text], [1], PATH)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.spells(ids, text) and not model.spells(ids, text + "x") and not model.spells(ids[:-1], text)
    assert peak < 60 * len(text) + 500 * pieces.LONG_BLOCK
