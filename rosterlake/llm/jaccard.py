"""Exact Jaccard join of word shingle sets by the parts of PartEnum, without its subsets.

PartEnum enumerates subsets of parts and asks for one signature in common. Here a
signature is one single part, a set sends a prefix of them, and a pair must share
several: that number prunes pairs, which one subset in common does not. The number
of signatures is about the same: 983 documents of sf0.01 (mean 379 shingles) send 156
each in all their bands; 3 of 4 second-level parts for each of (k + 2) / 2 first-level
ones would be 171 by count, for one band.

Sets of sizes a <= b with a Jaccard similarity of 0.8 or more differ in at most
k = (a + b) / 9 elements. For a band of sizes the feature domain (all hashes) is
split into N parts; a difference spoils at most one part, so of the parts of either
set all but k hold the same elements in both. A signature is the hash of a part's
elements; empty parts give none. The signatures of a set are put into one order for
all sets (parts with more elements first, then by hash) and only the first
e = a/4 + a/20 + 1 are kept: non-common ones being at most k <= a/4, the first
e - k common ones stand among the first e of both. So many must a pair share.

Frequent signatures (shared passages) would bring unlike documents together, so
groups of more than ``COLD`` sets are left aside. A set is *covered* while at most
b/25 of its signatures are left aside: then each partner shares a small group with
it. Pairs of two uncovered sets are looked for once more with the finest split, an
element a part, of which every set sends all. An alike pair then either shares a
small group, or differs in all elements of either set that aren't in large groups,
and so in (rare_a + rare_b + difference of the numbers of others) at least. The
frequent elements of the few sets that this leaves, members of large groups of near
copies, are put in order of frequency; the first that a pair shares is one of the
first (frequent - common + 1) of each, and common is 4/9 of both sizes at least. Those groups are compared with a few members at a
time, the ones with fewest rare elements first, and members that are already
connected are not compared.
"""

from __future__ import annotations

import contextlib
import functools
import math
from collections import OrderedDict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rosterlake.llm.common import Scratch, arrow_map, free_prefix, keyed
from rosterlake.llm.graph import components, merged_roots, some
from rosterlake.operators.ranges import rank_rows

SHINGLE = 5
#: Largest signature group whose pairs are all written out; groups beyond it are compared stepwise.
COLD = 24
#: Members of a large group that are compared with all later ones in its first round, and by what that grows.
FIRST_WIDTH, WIDENING = 32, 64
#: Values of the bits of a signature that hold its band.
_BANDS = 32
#: Sets below this size have one part per element.
_SMALL = 32
#: Exact copies remembered within one task, to send their signatures once.
_REMEMBER = 200_000
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, seed: int = 0) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's five-word shingles.

    A-Z are lower-cased; words are separated by blanks and the controls 9 to 13.
    Fewer words make one shingle of the whole sequence; no word makes none.
    """
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    w = np.array([digest(x, seed) for x in words], np.uint64)
    size = min(SHINGLE, len(w))
    out = np.full(len(w) - size + 1, size, np.uint64)
    for j in range(size):
        out = out * _M1 + w[j : len(w) - size + 1 + j]
    return np.unique(_mixed(out))


def band(size: int) -> int:
    return 0 if size < _SMALL else 1 + int(math.log2(size / _SMALL))


def bands_of(size: int) -> list[int]:
    """The set's own band and, if the largest partner (5/4 of it) is in the next, that too."""
    return sorted({band(size), band(size * 5 // 4)})


def n_parts(b: int) -> int:
    """Parts of a band; a set has 0.36 to 0.72 parts per element, small ones a part for each."""
    return 1 << 40 if b == 0 else int(0.72 * _SMALL * 2**b)


def quota(size: int) -> int:
    """Signatures that a set sends in a band."""
    return min(size, size // 4 + size // 20 + 1)


def _split(hashes: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, elements) of the non-empty parts of one band."""
    mixed = _mixed(hashes + np.uint64((b + 1) * int(_M1) % 2**64))
    part = mixed % np.uint64(n_parts(b))
    order = np.argsort(part, kind="stable")
    part = part[order]
    heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    sums = np.add.reduceat(_mixed(mixed[order] ^ _M2), heads)
    sig = (_mixed(sums ^ (part[heads] * _M1)) & ~np.uint64(_BANDS - 1)) | np.uint64(b)
    return sig, np.diff(np.append(heads, len(hashes)))


def signatures(hashes: np.ndarray) -> tuple[np.ndarray, bool]:
    """The signatures that a set sends, and whether one band has fewer than the quota."""
    out, short, most = [], False, quota(len(hashes))
    for b in bands_of(len(hashes)):
        sig, elements = _split(hashes, b)
        short |= len(sig) < most
        out.append(sig[np.lexsort((sig, -elements))[:most]])
    return np.concatenate(out).view(np.int64), short


def profiles(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, n, key, check, short, sigs of each row; key: 64 bits of the set's digest, null for no set."""

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()))
    names = ["doc_id", "n", "key", "check", "short", "sigs"]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: OrderedDict[tuple, None] = OrderedDict()
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                hashes = shingle_set(text.as_py(), seed)
                key, sigs, short = (None, None), None, False
                if len(hashes) and doc is not None:
                    key = _key(hashes, seed)
                    if key not in sent:
                        sigs, short = signatures(hashes)
                        held += len(sigs)
                    sent[key] = None
                    sent.move_to_end(key)
                    if len(sent) > _REMEMBER:
                        sent.popitem(last=False)
                rows.append((doc, len(hashes), *key, short, sigs))
                if held > 1_000_000:
                    yield made(rows)
                    rows, held = [], 0
            yield made(rows)

    return docs.mapInArrow(run, "doc_id bigint, n bigint, key bigint, check bigint, short boolean, sigs array<bigint>")


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (sig, key): those of signatures with two keys or more, and whether the group is cold.

    A group is held until it is complete or known to be hot; then it streams on.
    """
    kept = (np.empty(0, np.int64), np.empty(0, np.int64))
    hot_sent = False  # the kept row belongs to a hot group and is out already

    def out(sig: np.ndarray, key: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(key), pa.array(hot)], ["sig", "key", "hot"])

    def take(sig: np.ndarray, key: np.ndarray, end: bool):
        nonlocal kept, hot_sent
        sig, key = np.concatenate([kept[0], sig]), np.concatenate([kept[1], key])
        if not len(sig):
            return None
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])])
        sig, key = sig[new], key[new]
        heads = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        sizes = np.diff(np.append(heads, len(sig)))
        hot = sizes > COLD
        hot[0] |= hot_sent
        send = np.repeat((sizes > 1) | hot, sizes)
        if hot_sent:
            send[0] = False
        last = len(sig) if end else heads[-1]
        if not end and hot[-1]:
            last = len(sig)
        rows = slice(0, last)
        done = out(sig[rows][send[rows]], key[rows][send[rows]], np.repeat(hot, sizes)[rows][send[rows]])
        if not end:
            hot_sent = bool(hot[-1])
            kept = (sig[-1:], key[-1:]) if hot_sent else (sig[last:], key[last:])
        return done

    for batch in batches:
        done = take(batch.column("sig").to_numpy(), batch.column("key").to_numpy(), False)
        if done is not None and done.num_rows:
            yield done
    done = take(np.empty(0, np.int64), np.empty(0, np.int64), True)
    if done is not None and done.num_rows:
        yield done


def _key(hashes: np.ndarray, seed: int) -> tuple[int, int]:
    """Two 64-bit halves of a set's digest: its key and a check of it."""
    digest = xxhash.xxh3_128_digest(hashes.tobytes(), seed)
    return tuple(int.from_bytes(x, "little", signed=True) for x in (digest[:8], digest[8:]))


def _alike(batches: Iterable[pa.RecordBatch], percent: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) and whether their whole sets have a similarity of ``percent`` or more."""

    @functools.lru_cache(maxsize=64)
    def known(text: str) -> tuple[int, np.ndarray]:
        hashes = shingle_set(text, seed)
        return _key(hashes, seed)[0], hashes

    for batch in batches:
        a, b, good = [], [], []
        for key_a, key_b, ta, tb in zip(*(batch.column(c) for c in ("a", "b", "ta", "tb")), strict=True):
            (ka, x), (kb, y) = known(ta.as_py()), known(tb.as_py())
            if (ka, kb) != (key_a.as_py(), key_b.as_py()):
                continue
            both = len(np.intersect1d(x, y, assume_unique=True))
            a.append(ka)
            b.append(kb)
            good.append(100 * both >= percent * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(good, pa.bool_())], ["a", "b", "alike"])


def _aside(shared: DataFrame, kind: Column) -> DataFrame:
    """key, aside: signatures that a set has in large groups, the most of any kind."""
    counted = shared.where("hot").groupBy("key", kind.alias("kind")).agg(F.count("*").alias("aside"))
    return counted.groupBy("key").agg(F.max("aside").alias("aside"))


def _element_step(batches: Iterable[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """key, n, sigs: all elements of the texts that are of their key."""
    for batch in batches:
        keys, sets = [], []
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
            hashes = shingle_set(text.as_py(), seed)
            if _key(hashes, seed)[0] == key:
                keys.append(key)
                sets.append(hashes.view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))],
            ["key", "n", "sigs"],
        )


@contextlib.contextmanager
def _runtime_filter(spark: SparkSession) -> Iterator[None]:
    """Let Spark build its Bloom filter for a join whatever the sizes; its own size stays bounded."""
    prefix = "spark.sql.optimizer.runtime.bloomFilter."
    wanted = {"enabled": "true", "applicationSideScanSizeThreshold": "0", "creationSideThreshold": "1t"}
    before = {k: spark.conf.get(prefix + k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(prefix + k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(prefix + k, v)


class _Groups:
    """Links among sets that stayed uncovered, from the large groups of a frequent element.

    First every set is compared with the first member of a group that it shares
    most of its groups with. Then, in rounds, every group that still spans
    several components compares its next members, ``FIRST_WIDTH`` and then ever more,
    with its later members of other components. A group ends when it is connected
    or its members are used up.
    """

    def __init__(self, scratch: Scratch, dense: DataFrame, percent: int):
        lean = dense.withColumn("rare", F.col("n") - F.col("aside")).withColumn("excess", F.col("rare") * 9 - F.col("n"))
        self.scratch, self.ranked = scratch, scratch.write(rank_rows(lean, "place", ["excess", "key"], ["sig"]), "ranked")
        differ = F.col("rare_a") + F.col("rare_b") + F.abs(F.col("aside_a") - F.col("aside_b"))
        # The first common element of a pair with so many stands early in both orders.
        common = F.ceil((F.col("n_a") + F.col("n_b")) * 4 / 9)
        self.possible = (
            (differ * 9 <= F.col("n_a") + F.col("n_b"))
            & (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
            & (F.col("turn_a") <= F.col("aside_a") - common + 1)
            & (F.col("turn_b") <= F.col("aside_b") - common + 1)
        )

    @staticmethod
    def _end(df: DataFrame, x: str) -> DataFrame:
        return df.select("sig", *[F.col(c).alias(f"{c}_{x}") for c in df.columns if c != "sig"])

    @staticmethod
    def _pair(df: DataFrame) -> DataFrame:
        return df.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b"))

    def stars(self) -> DataFrame:
        """(a, b): each set with the first member of most of its groups."""
        first, others = self.ranked.where("place = 1"), self.ranked.where("place > 1")
        votes = self._end(others, "a").join(self._end(first, "b"), "sig").where(self.possible)
        best = votes.groupBy("key_a", "key_b").agg(F.count("*").alias("c")).groupBy("key_a").agg(
            F.max_by("key_b", F.struct("c", "key_b")).alias("key_b")
        )
        return self._pair(best)

    def pairs(self, root: DataFrame, done: int, width: int) -> DataFrame | None:
        """(a, b) of the next ``width`` members after ``done`` with later ones of other components, or None at the end."""
        known = root.withColumnRenamed("node", "key")
        state = self.ranked.where(F.col("place") > done).join(known, "key", "left").withColumn("root", F.coalesce("root", "key"))
        spans = state.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("sig")
        state = self.scratch.write(state.join(spans, "sig"), f"state-{done}")
        if not some(state):
            return None
        met = self._end(state, "a").join(self._end(state.where(F.col("place") <= done + width), "b"), "sig")
        apart = (F.col("root_a") != F.col("root_b")) & (F.col("place_a") > F.col("place_b"))
        return self._pair(met.where(apart & self.possible)).distinct()


class JaccardJoin:
    """One run of the join: classes of equal sets, links between classes, components.

    ``classes``: key, rep (smallest doc_id), n. ``root``: (node, root), the component
    of each class that is linked; every link was verified on whole sets.
    """

    PERCENT = 80

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.scratch = Scratch(docs.sparkSession)
        self.docs = keyed(docs, id_col, text_col)
        self.seed = 0
        while True:
            self.sent = self.scratch.write(profiles(self.docs, self.seed), f"profiles-{self.seed}")
            self.classes = self.scratch.write(
                self.sent.where("key is not null").groupBy("key").agg(
                    F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("short").alias("short"),
                    (F.min("check") != F.max("check")).alias("clash"),
                ),
                f"classes-{self.seed}",
            )
            if not some(self.classes.where("clash")):
                break
            self.seed += 1  # two different sets with one 64-bit key: hash everything anew
        self.root = self._root()
        for name in ("shared", "sets", "pairs", "reps", "texts", "elements", "fine-shared", "fine-sets", "fine-pairs", "dense", "ranked", "first"):
            self.scratch.drop(name)

    def _shared(self, sent: DataFrame, name: str) -> DataFrame:
        """(sig, key, hot) of the signatures that two sets or more have."""
        rows = sent.where("sigs is not null").select(F.explode("sigs").alias("sig"), "key")
        grouped = rows.repartition("sig").sortWithinPartitions("sig", "key")
        return self.scratch.write(grouped.mapInArrow(_shared, "sig bigint, key bigint, hot boolean"), name)

    def _pairs(self, shared: DataFrame, sets: DataFrame, least: Column, name: str) -> DataFrame:
        """(a, b, common): pairs of the small groups that can be alike.

        ``sets``: key, n, aside (signatures in large groups) and what ``least``, the
        signatures a pair has to share at least, is made of, for both ends with
        the suffixes _a and _b.
        """
        cold = shared.where("not hot").select("sig", "key")
        met = cold.select("sig", F.col("key").alias("a")).join(cold.select("sig", F.col("key").alias("b")), "sig").where("a < b")
        ends = [sets.select(F.col("key").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in sets.columns if c != "key"]) for x in "ab"]
        found = met.groupBy("a", "b").agg(F.count("*").alias("common")).join(ends[0], "a").join(ends[1], "b")
        fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * self.PERCENT
        enough = F.col("common") + F.least("aside_a", "aside_b") >= least
        return self.scratch.write(found.where(fits & enough).select("a", "b", "common"), name)

    def _verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """pairs (a, b) with ``alike``; the texts of their representatives are joined on."""
        texts = self.texts.select("key", "text")
        joined = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a").join(
            texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b"
        )
        percent, seed = self.PERCENT, self.seed
        return self.scratch.write(
            joined.mapInArrow(lambda x: _alike(x, percent, seed), "a bigint, b bigint, alike boolean"), name
        )

    def _across(self, pairs: DataFrame, root: DataFrame) -> DataFrame:
        """Pairs whose ends aren't connected in ``root`` yet."""
        ends = pairs.join(root.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(
            root.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left"
        )
        return ends.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select(*pairs.columns)

    def _root(self) -> DataFrame:
        shared = self._shared(self.sent, "shared")
        self.members = self.scratch.write(self.sent.select("doc_id", "n", "key"), "members")
        self.scratch.drop(f"profiles-{self.seed}")
        sets = self.scratch.write(
            self.classes.join(_aside(shared, F.col("sig").bitwiseAND(F.lit(_BANDS - 1))), "key", "left").select(
                "key", "rep", "n", "short", F.coalesce("aside", F.lit(0)).alias("aside")
            ),
            "sets",
        )
        small, both = F.least("n_a", "n_b"), F.col("n_a") + F.col("n_b")
        least = F.floor(small / 4) + F.floor(small / 20) + 1 - F.floor(both / 9)
        least = F.when(F.col("short_a") | F.col("short_b"), F.lit(1)).otherwise(least)
        pairs = self._pairs(shared, sets.drop("rep"), least, "pairs")
        uncovered = sets.where("short or aside > floor(n / 25)")
        self.texts = self._texts(pairs, uncovered, sets)
        dense, fine_pairs = self._fine(uncovered)
        pairs = pairs.union(fine_pairs)
        groups = _Groups(self.scratch, dense, self.PERCENT) if some(dense) else None
        # First each class with the partner it shares most with, then what that leaves apart.
        ends = pairs.select("a", "b", F.col("a").alias("node"), "common").union(pairs.select("a", "b", F.col("b"), "common"))
        best = ends.groupBy("node").agg(F.max_by(F.struct("a", "b"), F.struct("common", "a", "b")).alias("p")).select("p.a", "p.b")
        taken = self._verified((best.union(groups.stars()) if groups else best).distinct(), "first")
        root = self.scratch.write(components(taken.where("alike")), "root-0")
        new, done, width, step = self._across(pairs.select("a", "b"), root), 0, FIRST_WIDTH, 0
        while True:
            met = groups.pairs(root, done, width) if groups else None
            if met is not None:
                new = met if new is None else new.union(met)
            elif new is None:
                return root
            got = self._verified(new.distinct().join(taken, ["a", "b"], "left_anti"), f"rest-{step}")
            if some(got.where("alike")):
                root = self.scratch.write(merged_roots(root, got.where("alike").select("a", "b")), f"root-{step + 1}")
            if met is None:
                return root
            taken, new = taken.union(got), None
            done, width, step = done + width, width * WIDENING, step + 1

    def _texts(self, pairs: DataFrame, uncovered: DataFrame, sets: DataFrame) -> DataFrame:
        """key, text of the representatives that any comparison needs.

        A doc_id that stands on several rows brings all its texts; those that
        aren't of the key are left out where they are used. Spark's runtime filter
        (a Bloom filter of bounded size) keeps most other texts out of the exchange.
        """
        needed = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).union(uncovered.select("key")).distinct()
        reps = self.scratch.write(needed.join(sets, "key").select("key", "rep", "n"), "reps").where("n > 0")
        found = self.docs.join(reps, self.docs["doc_id"] == reps["rep"]).select("key", F.xxhash64("text").alias("h"), "text")
        with _runtime_filter(self.docs.sparkSession):
            return self.scratch.write(found.groupBy("key", "h").agg(F.first("text").alias("text")), "texts")

    def _fine(self, uncovered: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Large element groups of the sets that stay uncovered, and the pairs of small groups."""
        seed = self.seed
        texts = uncovered.select("key").join(self.texts, "key")
        sent = self.scratch.write(
            texts.mapInArrow(lambda x: _element_step(x, seed), "key bigint, n bigint, sigs array<bigint>"), "elements"
        )
        shared = self._shared(sent, "fine-shared")
        sets = self.scratch.write(
            sent.groupBy("key").agg(F.max("n").alias("n")).join(_aside(shared, F.lit(0)), "key", "left")
            .select("key", "n", F.coalesce("aside", F.lit(0)).alias("aside")),
            "fine-sets",
        )
        # Common elements of an alike pair: 4/9 of both sizes at least.
        pairs = self._pairs(shared, sets, F.ceil((F.col("n_a") + F.col("n_b")) * 4 / 9), "fine-pairs")
        left = sets.where("aside * 5 >= n * 4")
        frequent = shared.where("hot").join(left, "key")
        often = frequent.groupBy("sig").agg(F.count("*").alias("often"))
        first = Window.partitionBy("key").orderBy("often", "sig")
        prefix = (
            frequent.join(often, "sig")
            .withColumn("turn", F.row_number().over(first))
            .where("turn <= aside - ceil(n * 4 / 5) + 1")
            .select("sig", "key", "n", "aside", "turn")
        )
        return self.scratch.write(prefix, "dense"), pairs

    def documents(self) -> DataFrame:
        """doc_id, n_shingles, component_id of every row."""
        root = self.root.withColumnRenamed("node", "key")
        classes = self.classes.select("key", "rep").join(root, "key", "left").withColumn("root", F.coalesce("root", "key"))
        least = classes.groupBy("root").agg(F.min("rep").alias("component_id"))
        named = classes.join(least, "root").select("key", "component_id")
        return self.members.select("doc_id", F.col("n").alias("n_shingles"), "key").join(named, "key", "left").select(
            "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
        )


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: near copies at a Jaccard similarity of 0.8 over five-word shingles.

    Equal sets form one class before anything is compared. Texts without a word
    (null, empty, blanks) have no set: n_shingles 0, linked with nothing, their own
    component. Rows with null ids are linked with nothing and have no component. Repeated rows repeat.
    An empty table gives no rows. Other columns are not looked at.
    """
    return JaccardJoin(docs, id_col, text_col).documents()


def _row_name(docs: DataFrame, id_col: str, text_col: str, seed: int) -> Column:
    """64 bits that stand for a row's id and text; null is an id like any other, and a null text is empty."""
    text = F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit(""))
    return F.xxhash64(F.lit(seed), docs[f"`{id_col}`"].isNull(), docs[f"`{id_col}`"].cast("bigint"), text)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each set of equal or linked texts, whatever their ids; same columns.

    The row of smallest id stays, one without an id only where no row of the set has
    one. Rows are named by id and text, so an id may stand on several texts and a null
    id loses no text. Texts without a word are linked with nothing: of them, rows of
    one id (or none) and one text stay once.
    """
    scratch, seed = Scratch(docs.sparkSession), 0
    while True:
        a, b = (_row_name(docs, id_col, text_col, 2 * seed + i) for i in (0, 1))
        # The texts are hashed once; what follows reads three numbers a row.
        names = scratch.write(docs.select(a.alias("row"), b.alias("check"), docs[f"`{id_col}`"].cast("bigint").alias("id")), f"names-{seed}")
        if not some(names.groupBy("row").agg((F.min("check") != F.max("check")).alias("clash")).where("clash")):
            break
        seed += 1  # two different rows with one name: name everything anew
    found = jaccard_components(docs.select(a.alias("row"), docs[f"`{text_col}`"].alias("text")), "row", "text").select(
        F.col("doc_id").alias("row"), "component_id"
    )
    place = F.struct(F.col("id").isNull().alias("lost"), "id", "row")
    kept = found.distinct().join(names.select("row", "id").distinct(), "row").groupBy("component_id").agg(F.min(place).alias("p"))
    mine = free_prefix(docs, "row")
    named = docs.withColumn(mine, a).join(kept.select(F.col("p.row").alias(mine)), mine, "left_semi").dropDuplicates([mine])
    return named.select(*[F.col(f"`{c}`") for c in docs.columns])
