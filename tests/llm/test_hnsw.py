from collections import Counter

import numpy as np

from rosterlake.llm import hnsw
from tests.llm.common import unions

SCHEMA = "vec_id bigint, embedding array<float>, label int, rep int, key string, n_links string"


def vectors(n=700, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dim))
    out = [(i, (centres[rng.integers(40)] + rng.normal(size=dim) * rng.choice([0.05, 0.25, 0.6])).tolist(), i % 3) for i in range(n)]
    out += [(n + i, out[i % 5][1], out[i % 5][2]) for i in range(60)]  # copies
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * dim, [nan] * dim, [inf] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1.0, 2.0]]
    out += [(2000 + i, v, 1) for i, v in enumerate(odd)] + [(2100, out[0][1], None), (3, out[3][1], 0), (None, out[3][1], 0)]
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in out]


def brute(rows, threshold=0.93):
    good = {}
    for k, (i, v, label) in enumerate(rows):
        if i is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        good.setdefault((label, len(v)), []).append(k)
    n, pairs = Counter(), []
    for ks in good.values():
        m = np.array([rows[k][1] for k in ks], float)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(m @ m.T >= threshold)):
            if a != b:
                n[ks[a]] += 1
                pairs.append((rows[ks[a]][0], rows[ks[b]][0]))
    root = unions({i for i, _, _ in rows if i is not None}, pairs)
    return Counter((i, n[k], root.get(i), None if i is None else root[i] == i) for k, (i, _, _) in enumerate(rows))


def test_links_equal_brute_force(spark):
    rows = vectors()
    table = spark.createDataFrame([(*r, 1, "k", "n") for r in rows], SCHEMA)
    for size in (10_000, 80):
        got = Counter(tuple(r) for r in hnsw.near_vectors(table, shard_vectors=size).collect())
        want = brute(rows)
        found, links = (sum(r[1] * c for r, c in x.items()) for x in (got, want))
        assert 0.98 * links <= found <= links
        if found == links:
            assert got == want
    assert hnsw.near_vectors(table.limit(0)).count() == 0


def test_recall_of_single_graphs():
    rng = np.random.default_rng(2)
    unit = rng.normal(size=(1500, 24))
    unit[600:] = unit[rng.integers(0, 600, 900)] + rng.normal(size=(900, 24)) * 0.2
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    world = hnsw.SmallWorld.load(hnsw.SmallWorld.build(unit).dump())
    truth = unit @ unit.T >= 0.9
    found = sum(truth[i, x] for i in range(0, 1500, 5) for x in world.near(unit[i], 0.9, 64))
    assert found >= 0.95 * truth[::5].sum()
    assert all(truth[i, x] for i in range(0, 1500, 50) for x in world.near(unit[i], 0.9, 64))


def test_copies_of_unlike_length_all_link(spark):
    """One direction, so all cosines tie and full neighbour lists drop later nodes."""
    rows = [(i, [float(i + 1)] * 8, 0) for i in range(400)]
    table = spark.createDataFrame([(*r, 1, "k", "n") for r in rows], SCHEMA)
    assert Counter(tuple(r) for r in hnsw.near_vectors(table).collect()) == brute(rows)


def test_audit_minds_the_few_links_beside_a_crowd(monkeypatch):
    """A search that misses every link between pairs, but none in a crowd, has to widen."""
    rng = np.random.default_rng(4)
    crowd = rng.normal(size=24) + rng.normal(size=(400, 24)) * 0.02
    pairs = np.repeat(rng.normal(size=(100, 24)), 2, axis=0) + rng.normal(size=(200, 24)) * 0.02
    vectors = np.concatenate([crowd, pairs])
    whole = hnsw.SmallWorld.near

    def short(self, q, least, beam):
        hits = whole(self, q, least, beam)
        return hits if len(hits) > 50 or beam > hnsw.FIRST_BEAM else [x for x in hits if self.unit[x] @ q > 1 - 1e-9]

    monkeypatch.setattr(hnsw.SmallWorld, "near", short)
    left = hnsw.pd.DataFrame({"rep": range(600), "vector": vectors.tolist()})
    right = hnsw.pd.DataFrame({"reps": [list(range(600))], "world": [hnsw.SmallWorld.build(hnsw._unit(vectors)).dump()]})
    found = hnsw._search((), left, right, 0.93)
    assert (found["a"] >= 400).sum() >= 200
