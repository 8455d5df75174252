import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from rosterlake.llm import packing, tokens
from tests.llm.common import ODD, docs, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


def encode(text):
    return tokens.tokenizer(PATH).encode(text or "", add_special_tokens=False).ids


LONG = [
    (10, prose(1, 4000)),
    (11, "x" * 9000),  # one word: no seam before the overlaps span it
    (12, "a " * 300 + "y" * 3000 + " b" * 900),
    (13, "<|endoftext|>" * 400 + prose(2, 300) + "<|endoftext|> "),
    (14, " \n" * 2500 + "é ü 日本 🎉" * 300),
    (14, prose(3, 900)),
    (15, "it's we're 12345 !!! \t\t x" * 300),
]


@pytest.mark.parametrize("chunk, overlap", [(500, 60), (1024, 16)])
def test_counts_equal_the_library(spark, chunk, overlap):
    rows = ODD + LONG
    got = tokens.token_counts(docs(spark, rows), PATH, chunk_chars=chunk, overlap_chars=overlap)
    want = sorted((i or -1, len((t or "").encode()), len(encode(t)), len(encode(t)) > 1024) for i, t in rows)
    assert sorted((r[0] or -1, *r[1:]) for r in got.collect()) == want
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_counts_of_no_rows(spark):
    assert tokens.token_counts(docs(spark, []), PATH).count() == 0


def test_both_libraries_give_the_same_ids_over_unicode():
    for lo in range(0, 0x110000, 4096):
        text = "".join(f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}" for c in range(lo, lo + 4096) if not 0xD800 <= c < 0xE000)
        assert packing.token_ids(text, PATH).tolist() == encode(text)


def test_long_texts_are_cut_where_words_begin():
    for _, text in LONG:
        parts = list(packing._segments(text, 100))
        assert "".join(parts) == text
        assert [i for p in parts for i in encode(p)] == encode(text)


def test_pieces_and_sequences(spark):
    rows = ODD + LONG + [(100 + i, prose(i, 20 + i)) for i in range(60)]
    pieces = packing.token_pieces(docs(spark, rows), PATH, length=256, keep_ids=True)
    packed = packing.pack(pieces, 256, shard_pieces=70)
    out = packed.collect()
    want = sorted((i or -1, tuple(encode(t) + [0])) for i, t in rows)
    by_doc = defaultdict(list)
    for r in out:
        assert r.length == len(r.ids) <= 256
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_doc[r.doc_id or -1].append(r)
    for i, ids in want:
        mine = sorted(by_doc[i], key=lambda r: r.piece)
        if sum(w[0] == i for w in want) == 1:
            assert tuple(x for r in mine for x in r.ids) == ids
            assert [r.start for r in mine] == [sum(s.length for s in mine[:k]) for k in range(len(mine))]
            assert all(r.length == 256 for r in mine[1:])
    seqs = defaultdict(list)
    for r in out:
        seqs[r.sequence_id].append((r.offset, r.length))
    for places in seqs.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    least = -(-sum(r.length for r in out) // 256)
    assert least <= len(seqs) <= least * 1.05 + 3
    whole = {r.sequence_id: len(r.ids) for r in packing.sequences(packed).collect()}
    assert whole == {s: sum(n for _, n in p) for s, p in seqs.items()}
    assert packing.pack(packing.token_pieces(docs(spark, []), PATH)).count() == 0


def test_each_place_makes_the_sum_of_squares_smallest():
    rng = np.random.default_rng(3)
    sizes, capacity = rng.integers(1, 21, 400), 20
    bins, offsets = packing.sum_of_squares(sizes, capacity)
    fill = defaultdict(int)
    for s, b, o in zip(sizes.tolist(), bins.tolist(), offsets.tolist()):
        def cost(target):
            after = dict(fill)
            after[target] = after.get(target, 0) + s
            gaps = [capacity - f for f in after.values()]
            return sum(gaps.count(g) ** 2 for g in set(gaps) if 0 < g < capacity)
        fits = [k for k, f in fill.items() if f + s <= capacity] + [len(fill)]
        assert cost(b) == min(map(cost, fits))
        assert o == fill[b]
        fill[b] += s


@pytest.mark.parametrize("text", [" " * 3_000_000, "\n" * 3_000_000, "word " + " \t\n\r" * 700_000 + "end", "x" + "\u3000" * 1_200_000 + " y"])
def test_ids_of_millions_of_blanks(text):
    assert packing.token_ids(text, PATH).tolist() == encode(text)
