"""Sum-of-squares packing of token pieces into sequences of a fixed length."""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rosterlake.llm.common import arrow_map, doc_hash, keyed
from rosterlake.llm.tokens import guard_chars, tokenizer
from rosterlake.session import cut_lineage

#: Characters encoded at once.
SEGMENT_CHARS = 1 << 16
#: Pieces packed together, on average. Measured from 4,000 to 40,000, sequences stay
#: within 0.3 percent of the least possible, so shards can be small and many.
SHARD_PIECES = 4096


@functools.lru_cache(maxsize=1)
def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Visible Latin-1 characters stand for themselves, the other bytes, in order, for
    the characters from 256 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.lru_cache(maxsize=2)
def _fast(path: str):
    """The same vocabulary in the faster of the two libraries, or None.

    Fits a byte-level BPE whose merges are numbered in their order; the ids are
    then equal, which a test compares over all of Unicode.
    """
    import tiktoken

    if guard_chars(path) is None:
        return None
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    added = {t["content"]: t["id"] for t in made.get("added_tokens", [])}
    merges = [m if isinstance(m, list) else m.split(" ") for m in made["model"]["merges"]]
    vocab = made["model"]["vocab"]
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    ranks = {bytes(_byte_of()[c] for c in token): i for token, i in vocab.items() if token not in added}
    # The splitting rule of byte-level BPE files with use_regex.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added), added


def _segments(text: str, most: int) -> Iterator[str]:
    """Cut before a blank that follows a non-blank: a word starts there in any context."""
    start = 0
    while len(text) - start > most:
        at = text.rfind(" ", start + 1, start + most)
        while at > start and text[at - 1].isspace():
            at = text.rfind(" ", start + 1, at)
        if at <= start:
            at = text.find(" ", start + most)
            while at >= 0 and text[at - 1].isspace():
                at = text.find(" ", at + 1)
            if at < 0:
                break
        yield text[start:at]
        start = at
    yield text[start:]


def token_ids(text: str, path: str) -> np.ndarray:
    """The ids of a whole text as unsigned 32-bit integers, no special tokens added.

    A part that can't be cut for twice ``SEGMENT_CHARS`` goes to the first library: its splitting rule
    takes any run of blanks or of line breaks, where the rule of the faster one would
    exceed its stack beyond a million of them.
    """
    fast = _fast(path)
    if fast is None:
        return np.asarray(tokenizer(path).encode(text, add_special_tokens=False).ids, np.uint32)
    coder, added = fast
    out = []
    for part in _segments(text, SEGMENT_CHARS):
        if len(part) > 2 * SEGMENT_CHARS:
            out.append(np.asarray(tokenizer(path).encode(part, add_special_tokens=False).ids, np.uint32))
        elif any(s in part for s in added):
            out.append(np.asarray(coder.encode(part, allowed_special="all"), np.uint32))
        else:
            out.append(np.asarray(coder.encode_ordinary(part), np.uint32))
    return out[0] if len(out) == 1 else np.concatenate(out)


def token_pieces(
    docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 0, id_col: str = "doc_id",
    text_col: str = "text", keep_ids: bool = False,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of the pieces of every document.

    A document is the ids of its text and ``end_id``. Longer ones are cut from the
    end into pieces of ``length`` ids, so that the first piece takes the rest.
    A null text is empty: one piece with ``end_id`` alone. Repeated rows repeat.
    """

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        rows: list[tuple] = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            ids = np.append(token_ids(text.as_py(), tokenizer_path), np.uint32(end_id)).astype("<u4")
            cuts = [0, *range(len(ids) % length or length, len(ids) + 1, length)]
            for piece, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                part = ids[lo:hi]
                rows.append((doc, piece, lo, hi - lo, zlib.crc32(part.tobytes()), part))
            if len(rows) >= 2000:
                yield made(rows)
                rows = []
        if rows:
            yield made(rows)

    def made(rows: list[tuple]) -> dict:
        names = ("doc_id", "piece", "start", "length", "ids_crc32")
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        out = {n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))}
        return out | ({"ids": pa.array([r[5] for r in rows], pa.list_(pa.int64()))} if keep_ids else {})

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * keep_ids
    return arrow_map(keyed(docs, id_col, text_col), step, schema)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size, in the given order.

    ``open_bins[g]`` bins have a gap of g. A size goes where the sum of squares of
    these counts becomes smallest: into a bin with some gap that holds it, or into a
    new one. Ties take the smallest gap; of bins with one gap the latest is taken.
    """
    open_bins = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    for i, s in enumerate(sizes.tolist()):
        # Change of the sum of squares by the gap taken, from s to a new bin's.
        change = 2 * (open_bins[: capacity + 1 - s] - open_bins[s:]) + 2
        change[0] = 1 - 2 * open_bins[s]
        change[:-1][open_bins[s:capacity] == 0] = np.iinfo(np.int64).max
        change[-1] = 2 * open_bins[capacity - s] + 1 if s < capacity else 0
        gap = int(np.argmin(change)) + s
        if gap == capacity:
            at, made = made, made + 1
        else:
            at = stacks[gap].pop()
            open_bins[gap] -= 1
        bins[i], offsets[i] = at, capacity - gap
        if gap > s:
            stacks[gap - s].append(at)
            open_bins[gap - s] += 1
    return bins, offsets


def pack(pieces: DataFrame, length: int = 2048, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Add sequence_id and offset to every piece.

    Pieces are dealt into shards by a hash of their place, about ``shard_pieces``
    each, and every shard is packed on its own, so a task holds a few numbers for
    each of its pieces, whatever the input. Within a shard the order is by length
    descending, then document and piece: a rerun packs alike. Ids and texts don't
    take part; join them on doc_id, piece and start. Pieces without an id are dealt by
    their checksum, and stand in for no other id.
    """
    placed = cut_lineage(pieces)
    shards = max(1, -(-placed.count() // shard_pieces))
    names = [f.name for f in placed.schema.fields]
    order = ["length", "doc_id", "piece", "start"]

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, ascending=[False, True, True, True], kind="stable")
        bins, offsets = sum_of_squares(frame["length"].to_numpy(), length)
        shard = int(frame["shard"].iloc[0])
        frame["doc_id"] = frame["doc_id"].astype("Int64").mask(frame["lost"])
        return frame[names].assign(sequence_id=(shard << 36) + bins, offset=offsets)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema.fields)
    # A null would turn a whole column of ids into floats on its way to pandas.
    whole = placed.withColumn("lost", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0).cast("bigint")))
    dealt = whole.withColumn("shard", doc_hash(F.when(F.col("lost"), F.col("ids_crc32")).otherwise(F.col("doc_id")), "piece", "start") % shards)
    return dealt.groupBy("shard").applyInPandas(one, schema + ", sequence_id bigint, offset bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence with its ids in order; needs pieces with ids.

    A group is one sequence, so it holds ``length`` ids at most.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
