import hashlib
import random
import zlib
from collections import Counter

import pytest

from rosterlake.llm import manifest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, h string, path string, block int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def beside(tree, at):
    found = []
    for nodes in tree[:-1]:
        run = nodes[at // 16 * 16 : at // 16 * 16 + 16]
        found.append((run[: at % 16], run[at % 16 + 1 :]))
        at //= 16
    return found


def brute(rows):
    by = {}
    for doc, text, lang, source, n in rows:
        leaf = sha(*map(field, (doc, source, lang, n, text)))
        bad = text
        if doc is not None and text is not None and zlib.crc32(str(doc).encode()) % 5 == 0:
            bad = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        by.setdefault(source, []).append((doc is not None, doc or 0, leaf, doc, sha(*map(field, (doc, source, lang, n, bad)))))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(by[s])]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, leaf, doc, now) in enumerate(sorted(by[s])):
            path = beside(trees[s], i) + beside(top, k)
            h = now
            for left, right in path:
                h = sha(*left, h, *right)
            proof = sha(*(x for left, right in path for x in (*left, *right)))
            out.append((doc, leaf, trees[s][-1][0], top[-1][0], proof, h, h == top[-1][0]))
    return Counter(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", "h", "p", 1) for r in rows], SCHEMA)


def got(spark, rows):
    docs = frame(spark, rows)
    found = manifest.verified_manifest(docs, manifest.tampered_texts(docs))
    return Counter(tuple(r) for r in found.collect())


def table(seed, sizes):
    rnd = random.Random(seed)
    rows = []
    for source, n in sizes.items():
        for _ in range(n):
            doc = rnd.randrange(10**rnd.randrange(1, 18))
            rows.append((doc, rnd.choice([None, "", "Ab C", "ÄÖ Z", "line\nTwo " * 9]), rnd.choice([None, "en"]), source, rnd.choice([None, 3])))
    return rows


def test_sources_of_every_height(spark):
    rows = table(1, {None: 3, "": 1, "a": 16, "b": 17, "B": 256, "é": 257, "z": 290, "ﬀ": 2, "😀": 33})
    assert got(spark, rows) == brute(rows)


def test_blocks_above_blocks(spark, monkeypatch):
    """With blocks of one and two digits a few hundred leaves need several tiers, sources too."""
    rows = table(2, {"a": 300, **{f"s{i}": 1 + i % 3 for i in range(40)}})
    want = brute(rows)
    for digits in (1, 2):
        monkeypatch.setattr(manifest, "DIGITS", digits)
        monkeypatch.setattr(manifest, "BLOCK", 16**digits)
        assert got(spark, rows) == want


def test_more_leaves_than_a_block(spark):
    rows = [(i, f"Text {i}", "en", "hot" if i % 3 else "cold", i) for i in range(7000)]
    assert got(spark, rows) == brute(rows)


def test_null_and_repeated_rows(spark):
    rows = [(None, "A", "en", "a", 1), (None, None, None, None, None), (5, "A", "en", "a", 1), (5, "A", "en", "a", 1), (5, "B", "en", "a", 1)] * 9
    rows += [(7, "Ab" * 300_000, "en", "long", 600_000)]
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(10, "Only", "en", "a", 4)]])
def test_no_row_and_one(spark, rows):
    assert got(spark, rows) == brute(rows)


def test_changed_rows_do_not_verify(spark):
    rows = [(i, "Plain Text", "en", "a", 10) for i in range(40)] + [(i, "plain text", "en", "b", 10) for i in range(40)]
    docs = frame(spark, rows)
    found = manifest.verified_manifest(docs, manifest.tampered_texts(docs)).join(docs.select("doc_id", "source", "text").distinct(), "doc_id").count()
    assert found == 160  # both sources share their ids
    hit = {i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 0}
    wrong = manifest.verified_manifest(docs, manifest.tampered_texts(docs)).where("not verified").collect()
    assert hit and sorted(r.doc_id for r in wrong) == sorted(hit)
