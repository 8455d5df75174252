import random
from collections import Counter, defaultdict

import pytest

from rosterlake.llm import jaccard
from tests.llm.common import ODD, docs, unions


def brute(rows):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    found = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            found[x].append(k)
    pairs = []
    for k, (i, s) in enumerate(sets):
        for j, both in Counter(j for x in s for j in found[x] if j < k).items():
            if i is not None and sets[j][0] is not None and 100 * both >= 80 * (len(s) + len(sets[j][1]) - both):
                pairs.append((i, sets[j][0]))
    root = unions({i for i, _ in rows if i is not None}, pairs)
    return Counter((i, len(s), root.get(i)) for i, s in sets)


def families(seed, passage_share):
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    passage, rows = [rnd.choice(vocab) for _ in range(40)], []
    for _ in range(30):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([1, 3, 5, 6, 8, 12, 20, 31, 33, 60, 120, 300]))]
        if rnd.random() < passage_share:
            base[len(base) // 2 : len(base) // 2] = passage
        for _ in range(rnd.choice([1, 2, 3, 10, 30])):
            words = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
                at = rnd.randrange(len(words) + 1)
                if rnd.random() < 0.5:
                    words[at:at] = [rnd.choice(vocab)]
                elif len(words) > 1:
                    del words[min(at, len(words) - 1)]
            rows.append((1000 + len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("cold, share", [(24, 0.4), (2, 0.7)])
def test_components_equal_brute_force(spark, monkeypatch, cold, share):
    monkeypatch.setattr(jaccard, "COLD", cold)
    rows = families(cold, share) + ODD + [(6, "ONE\x0btwo  Three"), (7, "Über ÜBER a b c d e f g h"), (8, "über ÜBER a b c d e f g h")]
    got = jaccard.jaccard_components(docs(spark, rows))
    assert Counter(tuple(r) for r in got.collect()) == brute(rows)


def test_ids_that_stand_on_several_texts(spark):
    rows = [(1, "a b c d e f g h i j"), (1, "k l m n o p q r s t"), (2, "a b c d e f g h i j"), (3, "k l m n o p q r s t u")]
    assert Counter(tuple(r) for r in jaccard.jaccard_components(docs(spark, rows)).collect()) == brute(rows)


def test_every_alike_pair_shares_enough_signatures():
    """The guarantee itself, on pairs at the edge of the similarity."""
    rnd = random.Random(9)
    for size in (9, 18, 27, 45, 90, 180, 450):
        for _ in range(10):
            common = [f"c{rnd.random()}" for _ in range(size * 8 // 9)]
            mine = [f"m{rnd.random()}" for _ in range(size - len(common))]
            yours = [f"y{rnd.random()}" for _ in range(size - len(common))]
            a, b = (jaccard.np.unique(jaccard.np.array([jaccard.xxhash.xxh3_64_intdigest(x) for x in part], "u8")) for part in (common + mine, common + yours))
            (sa, short_a), (sb, short_b) = jaccard.signatures(a), jaccard.signatures(b)
            least = size // 4 + size // 20 + 1 - 2 * size // 9
            assert short_a or short_b or len(set(sa.tolist()) & set(sb.tolist())) >= least


def test_one_row_stays_of_each_set_of_texts(spark):
    a, b = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(1, a), (1, b), (2, b + " u"), (None, a), (None, "only here and without an id"), (None, "only here and without an id"), (3, "only there")]
    kept = sorted(((r.doc_id or 0, r.text) for r in jaccard.one_of_each(docs(spark, rows)).collect()))
    assert kept == [(0, "only here and without an id"), (1, a), (1, b), (3, "only there")]


def test_one_row_of_each_group_stays(spark):
    rows = [(3, "a b c d e f g"), (1, "a b c d e f g"), (2, "z y x w v u"), (2, "z y x w v u"), (4, None), (5, None)]
    kept = jaccard.one_of_each(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 5]


def test_no_rows(spark):
    assert jaccard.jaccard_components(docs(spark, [])).count() == 0


def test_one_of_each_beside_columns_named_like_inner_ones(spark):
    rows = [(1, "a b c d e f", 5, "x", 1), (2, "a b c d e f", 6, "y", 2), (None, None, 7, "z", 3), (None, None, 8, "z", 3)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, _row int, row string, component_id int")
    kept = jaccard.one_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id or 0, r._row in (5, 7, 8)) for r in kept.collect()) == [(0, True), (1, True)]
