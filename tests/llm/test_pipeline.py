import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers

import corpus_pipeline
from rosterlake.llm import quality, rules
from rosterlake.llm.tokens import tokenizer
from tests.llm.test_jaccard import brute
from tests.llm.test_quality import plain_score

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = r"[^\x20\x09-\x0D]+"


def test_stages_and_run(spark):
    docs, results = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        results.append({r.doc_id for r in out.select("doc_id").collect()})
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert results[0] > results[1] >= results[2]
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == results[2]
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_null_and_repeated_ids_keep_their_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = lambda df: sorted(r.text for r in df.select("text").collect())
    good = corpus_pipeline.keep_quality(spark, docs, SF).cache()
    rejected = docs.join(good.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    kept, dropped = good.orderBy("doc_id").limit(1), rejected.orderBy("doc_id").limit(1)
    first = kept.first().doc_id
    both = docs.unionByName(dropped.selectExpr(*[f"CAST({first} AS BIGINT) AS doc_id" if c == "doc_id" else c for c in docs.columns]))
    assert dropped.count() == 1
    assert texts(corpus_pipeline.keep_quality(spark, both, SF).where(f"doc_id = {first}")) == texts(kept)
    lost = kept.selectExpr(*["CAST(NULL AS BIGINT) AS doc_id" if c == "doc_id" else c for c in docs.columns])
    assert texts(corpus_pipeline.keep_quality(spark, docs.unionByName(lost), SF).where("doc_id is null")) == texts(kept)
    for stage in (corpus_pipeline.clean_lines, corpus_pipeline.drop_near_copies):
        kept, lost = stage(spark, kept, SF), stage(spark, lost, SF)
        assert texts(lost) == texts(kept) != []
    packed = corpus_pipeline.pack_sequences(spark, lost, SF)
    assert packed.count() == corpus_pipeline.pack_sequences(spark, kept, SF).count() > 0


def test_packing_beside_null_ids_keeps_long_ids(spark):
    rows = [(2**60 + 1, "a b c"), (2**60 + 1, "d e"), (None, "f g h"), (None, "f g h")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [r.doc_id for r in corpus_pipeline.pack_sequences(spark, docs, SF).select("doc_id").collect()]
    assert sorted(got, key=str) == [2**60 + 1, 2**60 + 1, None, None]


def good_lines(text):
    """A document's lines that pass, or None if it is rejected."""
    words = re.findall(WORD, text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    if len(words) < 10 or 100 * len(covered) > 20 * len(words):
        return None
    lines = [x for x in text.split("\n") if re.search(WORD, x)]

    def fails(line):
        n = len(re.findall(WORD, line))
        noisy, entries = (100 * len(re.findall(p, line)) > rules.NOISY_PERCENT * n for p in (rules.NOISY_WORD, rules.NAVIGATION))
        return not re.search(rules.SENTENCE_END, line) or noisy or entries or bool(re.search(rules.BOILERPLATE, line))

    good = [x for x in lines if not fails(x)]
    lost = sum(map(len, lines)) - sum(map(len, good))
    return None if 100 * lost > rules.LOST_PERCENT * sum(map(len, lines)) else "\n".join(good)


def test_run_equals_brute_force(spark):
    """All four stages: the attention in plain loops, the rules by regular expressions, all pairs, whole ids by the library."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    kept = {}
    for r in docs.select("doc_id", "text").collect():
        if plain_score(model, r.text or "") >= 0.5:
            cleaned = good_lines(r.text)
            if cleaned is not None:
                kept[r.doc_id] = cleaned
    component = {i: root for i, _, root in brute(list(kept.items()))}
    coder = tokenizer(PATH)
    want = {}
    for i, root in component.items():
        if i == root:
            ids = [*coder.encode(kept[i], add_special_tokens=False).ids, 0]
            cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
            for piece, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                want[i, piece] = (lo, hi - lo, zlib.crc32(np.array(ids[lo:hi], "<u4").tobytes()))
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want) > 100
    sequences = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values()) <= 2048 and len(sequences) <= 1.02 * sum(sequences.values()) / 2048 + 1
