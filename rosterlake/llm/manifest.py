"""A Merkle manifest of a dataset: leaf, subroot, root and proof of every document.

The tree has runs of 16. The place of a leaf within its source is written in digits
to the base 16, and the digit columns are grouped away one after the other, the last
first: each grouping nests the nodes of a run in the struct of their parent. Three
digits make a block, one row of at most 4,096 leaves; the hashes of the blocks of a
source are rolled up in the same way, block by block, and so are the subroots of all
sources. Proofs go the other way: every level of nested structs is exploded, and the
neighbours a node leaves behind are cut from its run's joined hashes by position, so
no node is joined with its siblings. A block takes over the path from its own hash to
the root by being grouped with it, which needs no join either.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rosterlake.llm.common import Scratch
from rosterlake.operators.ranges import rank_rows

#: Nodes of a run, digits of a block, and leaves of a block.
RUN, DIGITS = 16, 3
BLOCK = RUN**DIGITS
#: Characters of a digest.
_HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:string,right:string>>"


def _field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    """Lowercase hex sha256 of the fields, each with its length so that no two rows read alike."""
    return F.sha2(F.concat(*[_field(v) for v in values]), 256)


def lower_ascii(text: Column) -> Column:
    """Only A-Z become lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _roll(items: DataFrame) -> DataFrame:
    """(key, block, h, kids) of items (key, place, h, item): one row for each block.

    A run whose only node is the first and last of its whole level is not hashed again:
    then no more than one node remains.
    """
    place = F.col("place")
    cut = items.select(
        "key", F.floor(place / BLOCK).alias("block"), "h", "item",
        *[(F.floor(place / RUN**k) % RUN).cast("int").alias(f"d{k}") for k in range(DIGITS)],
    ).repartition("key", "block")
    kids = F.struct(F.col("d0").alias("d"), "h", "item")
    for k in range(1, DIGITS + 1):
        upper = [f"d{j}" for j in range(DIGITS - 1, k - 1, -1)]
        cut = cut.groupBy("key", "block", *upper).agg(F.sort_array(F.collect_list(kids)).alias("kids"))
        first = F.col("block") == 0
        for d in upper:
            first &= F.col(d) == 0
        h = F.when(first & (F.size("kids") == 1), F.col("kids")[0]["h"]).otherwise(F.sha2(F.array_join("kids.h", ""), 256))
        cut = cut.withColumn("h", h)
        if upper:
            kids = F.struct(F.col(upper[-1]).alias("d"), "h", "kids")
    return cut.select("key", "block", "h", "kids")


def _tiers(scratch: Scratch, items: DataFrame, name: str) -> list[DataFrame]:
    """Blocks of the items, blocks of their hashes, and so on until each key has one block."""
    found: list[DataFrame] = []
    while True:
        found.append(scratch.write(_roll(items), f"{name}-{len(found)}"))
        if found[-1].where("block > 0").isEmpty():
            return found
        items = found[-1].select("key", F.col("block").alias("place"), "h", F.struct(F.lit(None).cast("bigint").alias("none")).alias("item"))


def _opened(blocks: DataFrame) -> DataFrame:
    """The items of blocks (key, block, kids, path, ...), each with its own path to the root.

    ``path`` lists, from the item upwards, what stands left and right of it in its run.
    """
    carried = [c for c in blocks.columns if c not in ("key", "block", "kids", "path")]
    rows = blocks.withColumn("place", F.lit(0).cast("bigint"))
    for k in range(DIGITS - 1, -1, -1):
        # `place` counts the nodes of the level above within the block; 0 may be the only one.
        alone = (F.col("block") == 0) & (F.col("place") == 0) & (F.size("kids") == 1)
        runs = rows.withColumn("alone", alone).withColumn("joined", F.array_join("kids.h", ""))
        each = runs.select(*["key", "block", "path", "place", "alone", "joined", *carried], F.posexplode("kids").alias("i", "kid"))
        beside = F.struct(
            F.substring("joined", F.lit(1), F.col("i") * _HEX).alias("left"),
            F.substring("joined", F.col("i") * _HEX + _HEX + 1, F.lit(RUN * _HEX)).alias("right"),
        )
        path = F.when(F.col("alone"), F.col("path")).otherwise(F.concat(F.array(beside), F.col("path")))
        inner = [F.col("kid.kids").alias("kids")] if k else [F.col("kid.h").alias("h"), F.col("kid.item").alias("item")]
        rows = each.select("key", "block", path.alias("path"), (F.col("place") * RUN + F.col("i")).alias("place"), *carried, *inner)
    return rows.withColumn("place", F.col("block") * BLOCK + F.col("place"))


def _with_paths(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """Blocks (key, block, kids) and the paths of their hashes (key, block, path, ...), by one grouping."""
    more = [c for c in paths.columns if c not in ("key", "block")]
    both = blocks.select("key", "block", "kids").unionByName(paths, allowMissingColumns=True)
    return both.groupBy("key", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ["kids", *more]])


def _down(tiers: Sequence[DataFrame], paths: DataFrame) -> DataFrame:
    """From paths (key, path, ...) of the only block of each key to those of its items."""
    paths = paths.withColumn("block", F.lit(0).cast("bigint"))
    for i, blocks in enumerate(reversed(tiers)):
        rows = _opened(_with_paths(blocks, paths))
        if i == len(tiers) - 1:
            return rows
        paths = rows.drop("block", "h", "item").withColumnRenamed("place", "block")
    raise ValueError("no tier")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf hash leads to along a path."""
    return F.aggregate(path, start, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))


def merkle_manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "source",
    claimed: dict[str, Column] | None = None,
) -> DataFrame:
    """doc_id, leaf, subroot, root, path, claimed_leaf of every row of ``docs``.

    ``claimed`` replaces the values of some fields for claimed_leaf, the leaf that a
    row would have with them: what a receiver of the data computes. ``path`` lists the
    neighbours level by level, from the leaf through the subroot to the root;
    ``folded(claimed_leaf, path)`` equals ``root`` only for an unchanged row.

    A null is a value of its own in a field. Null ids come first in their source and
    ids that are equal follow their leaves; rows that are equal throughout are leaves of
    their own beside each other. A null source is a source, the first one; sources are
    ordered by their UTF-8 bytes. An empty table gives no rows. Columns other than the
    fields are not looked at. The texts are read once, to hash them; ranks, blocks
    and paths work on digests.
    """
    scratch = Scratch(docs.sparkSession)
    now = {c: docs[f"`{c}`"] for c in fields}
    then = now | (claimed or {})
    leaves = scratch.write(
        docs.select(
            docs[f"`{group_col}`"].cast("string").alias("key"), docs[f"`{id_col}`"].cast("bigint").alias("doc_id"),
            leaf_hash(*now.values()).alias("h"), leaf_hash(*then.values()).alias("claimed"),
        ),
        "leaves",
    )
    # The last column parts rows that are equal throughout, so that even a mass of them spreads over the ranges.
    ranked = rank_rows(leaves.withColumn("row", F.monotonically_increasing_id()), "place", ["doc_id", "h", "claimed", "row"], ["key"])
    items = ranked.select("key", (F.col("place") - 1).alias("place"), "h", F.struct("doc_id", "claimed").alias("item"))
    tiers = _tiers(scratch, items, "source")
    tops = tiers[-1].select("key", "h")
    sources = rank_rows(tops, "place", ["key"]).select(
        F.lit(0).alias("key"), (F.col("place") - 1).alias("place"), "h", F.struct(F.col("key").alias("source")).alias("item")
    )
    above = _tiers(scratch, sources, "root")
    empty = F.array().cast(_PATH)
    paths = _down(above, above[-1].select("key", F.col("h").alias("root"), empty.alias("path")))
    by_source = paths.select(F.col("item.source").alias("key"), "path", "root", F.col("h").alias("subroot"))
    rows = _down(tiers, scratch.write(by_source, "subroots"))
    return rows.select(
        F.col("item.doc_id").alias("doc_id"), F.col("h").alias("leaf"), "subroot", "root", "path", F.col("item.claimed").alias("claimed_leaf")
    )


def verified_manifest(docs: DataFrame, claimed: dict[str, Column] | None = None) -> DataFrame:
    """The manifest with the proofs as one digest, and whether each claimed row leads to the root."""
    rows = merkle_manifest(docs, claimed=claimed)
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    checked = rows.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
        folded(F.col("claimed_leaf"), F.col("path")).alias("folded_root"),
    )
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_texts(docs: DataFrame, every: int = 5) -> dict[str, Column]:
    """Texts in lower case where ``every`` divides the crc32 of the decimal id; for tests of a manifest."""
    hit = F.crc32(docs["doc_id"].cast("string").cast("binary")) % every == 0
    return {"text": F.when(F.coalesce(hit, F.lit(False)), lower_ascii(docs["text"])).otherwise(docs["text"])}
