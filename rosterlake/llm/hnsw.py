"""Near copies among embeddings through navigable small-world graphs, one per shard."""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from rosterlake.llm.common import Scratch, doc_hash, ship
from rosterlake.llm.graph import components

#: Vectors of one shard, on average, and queries of one block.
SHARD_VECTORS, QUERY_BLOCK = 16_384, 4096
#: Neighbours of a node on the upper layers and on the lowest one; beam while building.
LINKS, BASE_LINKS, BUILD_BEAM = 12, 24, 48
#: First beam of a search, and what share of an audit's links a beam must find.
FIRST_BEAM, MIN_RECALL = 32, 0.99


class SmallWorld:
    """A hierarchical navigable small-world graph over unit vectors."""

    def __init__(self, unit: np.ndarray, layers: list[list[np.ndarray]], entry: int, levels: np.ndarray):
        self.unit, self.layers, self.entry, self.levels = unit, layers, entry, levels

    @classmethod
    def build(cls, unit: np.ndarray, seed: int = 5) -> SmallWorld:
        n = len(unit)
        levels = np.floor(-np.log(np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int)
        made = cls(unit, [[np.empty(0, np.int64)] * n for _ in range(levels.max() + 1)], 0, levels)
        for i in range(1, n):
            made._insert(i)
        return made

    def _insert(self, i: int) -> None:
        at, top = self.entry, self.levels[self.entry]
        for layer in range(top, self.levels[i], -1):
            at = self._beam(self.unit[i], [at], 1, layer)[0][1]
        starts = [at]
        for layer in range(min(top, self.levels[i]), -1, -1):
            found = self._beam(self.unit[i], starts, BUILD_BEAM, layer)
            starts = [x for _, x in found]
            graph, most = self.layers[layer], BASE_LINKS if layer == 0 else LINKS
            graph[i] = self._spread(i, np.array(starts, np.int64), LINKS)
            for other in graph[i].tolist():
                near = np.append(graph[other], i)
                graph[other] = near if len(near) <= most else self._spread(other, near, most)
        if self.levels[i] > top:
            self.entry = i

    def _spread(self, i: int, near: np.ndarray, most: int) -> np.ndarray:
        """Of the nearest, those closer to i than to any taken before; filled up with the rest."""
        near = near[np.argsort(-(self.unit[near] @ self.unit[i]), kind="stable")]
        if len(near) <= most:
            return near
        to_i, among = self.unit[near] @ self.unit[i], self.unit[near] @ self.unit[near].T
        taken, rest = [], []
        for k in range(len(near)):
            if len(taken) < most and (not taken or among[k, taken].max() < to_i[k]):
                taken.append(k)
            else:
                rest.append(k)
        return near[(taken + rest)[:most]]

    def _beam(self, q: np.ndarray, starts: list[int], beam: int, layer: int, least: float = 2.0) -> list[tuple[float, int]]:
        """(cosine, node) found, best first: the ``beam`` best, and all of ``least`` or more met on the way.

        A node of ``least`` or more is always followed, so that a crowd larger than
        the beam is walked through whole.
        """
        graph, seen = self.layers[layer], set(starts)
        near = self.unit[starts] @ q
        heap = [(-s, x) for s, x in zip(near.tolist(), starts, strict=True)]
        heapq.heapify(heap)
        best = [(-s, x) for s, x in heap]
        heapq.heapify(best)
        crowd = [(-s, x) for s, x in heap if -s >= least]
        while len(best) > beam:
            heapq.heappop(best)
        while heap:
            s, x = heapq.heappop(heap)
            if -s < best[0][0] and len(best) >= beam and -s < least:
                break
            new = [y for y in graph[x].tolist() if y not in seen]
            if not new:
                continue
            seen.update(new)
            for t, y in zip((self.unit[new] @ q).tolist(), new, strict=True):
                if t >= least:
                    crowd.append((t, y))
                if len(best) < beam or t > best[0][0]:
                    heapq.heappush(heap, (-t, y))
                    heapq.heappush(best, (t, y))
                    if len(best) > beam:
                        heapq.heappop(best)
                elif t >= least:
                    heapq.heappush(heap, (-t, y))
        return sorted({*best, *crowd}, reverse=True)

    def near(self, q: np.ndarray, least: float, beam: int) -> list[int]:
        """Nodes with a cosine of ``least`` or more, as far as the beam leads to them."""
        at = self.entry
        for layer in range(self.levels[at], 0, -1):
            at = self._beam(q, [at], 1, layer)[0][1]
        return [x for s, x in self._beam(q, [at], beam, 0, least) if s >= least]

    def dump(self) -> bytes:
        out = io.BytesIO()
        arrays = {"unit": self.unit, "levels": self.levels, "entry": np.array([self.entry]), "n": np.array([len(self.layers)])}
        for k, graph in enumerate(self.layers):
            arrays[f"size{k}"] = np.array([len(x) for x in graph])
            arrays[f"flat{k}"] = np.concatenate(graph)
        np.savez(out, **arrays)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> SmallWorld:
        got = np.load(io.BytesIO(raw))
        layers = [np.split(got[f"flat{k}"], np.cumsum(got[f"size{k}"])[:-1]) for k in range(int(got["n"][0]))]
        return cls(got["unit"], layers, int(got["entry"][0]), got["levels"])


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors])


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # no overflow or underflow of the squares
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _usable(vector: Column, label: Column) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def _compared(unit: np.ndarray, queries: np.ndarray, threshold: float) -> list[list[int]]:
    """For each query every node with a cosine of ``threshold`` or more, by products of 256 queries each."""
    hits = []
    for lo in range(0, len(queries), 256):
        hits += [np.flatnonzero(row >= threshold).tolist() for row in queries[lo : lo + 256] @ unit.T]
    return hits


def _search(key: tuple, left: pd.DataFrame, right: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of one block of queries into one shard.

    Audit: every 20th query, 32 at least, is compared with the whole shard. While
    the beam finds less than ``MIN_RECALL`` of the links of any of them, its own
    vector apart, it is doubled for the whole block; so neither finds of the own
    vector nor the many links of a crowd weigh up the few links of others. A beam only walks edges, and a node that all full lists have dropped
    has none that lead to it; so where the beam would be as wide as the shard, the
    block is compared with all of it instead.
    """
    none = pd.DataFrame({"a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="int64")})
    if not len(left) or not len(right):
        return none
    world, ids = SmallWorld.load(right["world"].iloc[0]), np.asarray(right["reps"].iloc[0])
    queries, own = _unit(_matrix(left["vector"])), left["rep"].to_numpy()
    audit = np.unique(np.linspace(0, len(own) - 1, min(len(own), max(32, len(own) // 20))).astype(int))
    truth = [set(np.flatnonzero((world.unit @ queries[i] >= threshold) & (ids != own[i])).tolist()) for i in audit]
    audit, truth = zip(*[(i, t) for i, t in zip(audit, truth, strict=True) if t], strict=True) if any(truth) else ((), ())
    beam = FIRST_BEAM
    while beam < len(ids):
        if all(len(t.intersection(world.near(queries[i], threshold, beam))) >= MIN_RECALL * len(t) for i, t in zip(audit, truth, strict=True)):
            break
        beam *= 2
    hits = [world.near(q, threshold, beam) for q in queries] if beam < len(ids) else _compared(world.unit, queries, threshold)
    a, b = np.repeat(own, [len(h) for h in hits]), ids[np.array([x for h in hits for x in h], np.int64)]
    return pd.DataFrame({"a": a[a != b], "b": b[a != b]})


def near_vectors(
    embeddings: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding",
    label_col: str = "label", shard_vectors: int = SHARD_VECTORS,
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``embeddings``.

    Rows of one label (and one length) are compared by cosine in double precision;
    those at ``threshold`` or more are linked. Equal vectors of a label form a class
    that is looked up once. The classes of a label are dealt into shards of about
    ``shard_vectors``; every shard gets a graph, and every class is looked up in each
    shard of its label, in blocks. Cosines are checked on the way, so no link is
    false; how many are found is audited against brute force and beams widen until
    99 of 100 are for every audited vector, or the block is compared with its whole shard. n_links counts rows, so a class of m rows counts m.

    Rows with a null label, or a vector that is null, empty, zero or holds null or
    non-finite numbers, link with nothing: n_links 0, their own component, kept.
    Null ids link with nothing either; their component and kept are null. Repeated
    rows are vectors of their own with one id. An empty table gives no rows.
    """
    spark = embeddings.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    rows = embeddings.select(
        embeddings[id_col].cast("bigint").alias("vec_id"), embeddings[label_col].alias("label"),
        embeddings[vector_col].cast("array<double>").alias("vector"),
    )
    rows = rows.withColumn("usable", _usable(F.col("vector"), F.col("label")) & F.col("vec_id").isNotNull())
    # Zero is added so that 0.0 and -0.0 are one number; both hashes together name a class.
    plain = F.transform("vector", lambda x: x + F.lit(0.0))
    rows = rows.withColumn("key", F.when(F.col("usable"), F.sha2(F.to_json(F.struct("label", plain.alias("v"))), 256)))
    members = scratch.write(rows.select("vec_id", "key"), "members")
    classes = scratch.write(
        rows.where("usable").groupBy("key").agg(
            F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.first("label").alias("label"), F.first("vector").alias("vector")
        ).withColumn("kind", F.concat_ws(":", F.col("label").cast("string"), F.size("vector").cast("string"))),
        "classes",
    )
    shards = classes.groupBy("kind").agg(F.ceil(F.count("*") / shard_vectors).alias("shards"), F.ceil(F.count("*") / QUERY_BLOCK).alias("blocks"))
    dealt = classes.join(shards, "kind").withColumn("shard", doc_hash("rep") % F.col("shards")).withColumn(
        "block", doc_hash("rep", F.lit(1)) % F.col("blocks")
    )

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rep")
        world = SmallWorld.build(_unit(_matrix(frame["vector"])))
        return pd.DataFrame({
            "kind": [frame["kind"].iloc[0]], "shard": [frame["shard"].iloc[0]], "blocks": [frame["blocks"].iloc[0]],
            "reps": [frame["rep"].tolist()], "world": [world.dump()],
        })

    worlds = scratch.write(
        dealt.select("kind", "shard", "blocks", "rep", "vector").groupBy("kind", "shard").applyInPandas(
            build, "kind string, shard bigint, blocks bigint, reps array<bigint>, world binary"
        ),
        "worlds",
    )
    per_block = worlds.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    queries = dealt.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1)))
    by = ["kind", "shard", "block"]
    found = (
        queries.select(*by, "rep", "vector").groupBy(*by)
        .cogroup(per_block.select(*by, "reps", "world").groupBy(*by))
        .applyInPandas(lambda k, x, y: _search(k, x, y, threshold), "a bigint, b bigint")
    )
    # Each search is asked once; its finds count for both ends.
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    links = scratch.write(found.select(both.alias("l")).select("l.a", "l.b").distinct(), "links")
    scratch.drop("worlds")
    sizes = classes.select(F.col("rep").alias("b"), "size")
    n_links = links.join(sizes, "b").groupBy("a").agg(F.sum("size").alias("others"))
    named = (
        classes.select("key", "rep", "size")
        .join(n_links.withColumnRenamed("a", "rep"), "rep", "left")
        .join(components(links).withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "key", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
            F.coalesce("root", "rep").alias("component_id"),
        )
    )
    return members.join(named, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"),
    )
