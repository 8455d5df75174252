"""Token counts of whole texts, huge ones cut into overlapping chunks."""

from __future__ import annotations

import bisect
import functools
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rosterlake.llm.common import Scratch, arrow_map, keyed, slices

#: Characters handed to the tokenizer at once; bounds what its encodings take.
BATCH_CHARS = 1 << 18


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer of a file, loaded once per worker process.

    Spark gives every task its core, so the library's own threads stay off.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


@functools.lru_cache(maxsize=2)
def guard_chars(path: str) -> int | None:
    """Characters beyond a word's end that can still change it; None: texts can't be cut.

    A byte-level tokenizer without normalizer or added blanks splits left to right.
    Where a word ends before the end of a chunk, that end depends on the next
    character only, or on an added token that begins before it.
    """
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    split = made.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    odd = any(t.get(k) for t in made.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if not plain or odd or made.get("normalizer"):
        return None
    return max([1, *(len(t["content"]) for t in made.get("added_tokens", []))])


def _count_step(path: str):
    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        tok, texts = tokenizer(path), batch.column("text").to_pylist()
        counts: list[int] = []
        for lo, hi in slices(texts, BATCH_CHARS):
            counts += [len(e.ids) for e in tok.encode_batch_fast(texts[lo:hi], add_special_tokens=False)]
        yield {
            "doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), "n_tokens": pa.array(counts, pa.int64()),
        }

    return step


def _chunk_step(chunk: int, overlap: int):
    """Cut texts into chunks of ``chunk + overlap`` characters, ``chunk`` apart.

    No chunk starts within ``overlap`` of the end, so every chunk but the last is
    followed by text that it doesn't hold, and a seam has a whole overlap.
    """

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        for key, text in zip(batch.column("key"), batch.column("text"), strict=True):
            key, text = key.as_py(), text.as_py()
            n = max(1, -(-(len(text) - overlap) // chunk))
            for i in range(n):
                part = text[i * chunk : i * chunk + chunk + overlap]
                yield {
                    "key": [key], "chunk": pa.array([i], pa.int64()), "start": pa.array([i * chunk], pa.int64()),
                    "last": [i == n - 1], "part": [part],
                }

    return step


def _seam_step(path: str, chunk: int, overlap: int):
    """Per chunk: its tokens, and word starts in its two overlaps with the tokens before them."""

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        tok, guard = tokenizer(path), guard_chars(path)
        for row in batch.to_pylist():
            made = tok.encode(row["part"], add_special_tokens=False)
            words, spans, base = made.word_ids, made.offsets, row["start"]
            settled = len(row["part"]) - guard
            # Only tokens of the two overlaps are looked at; places never go back.
            head = bisect.bisect_left(spans, (overlap,)) if row["chunk"] else 0
            tail = len(spans) if row["last"] else bisect.bisect_left(spans, (chunk,))
            until = bisect.bisect_left(spans, (settled + 1,))
            zones: dict[str, tuple[list[int], list[int]]] = {}
            for zone, some in (("head", range(head)), ("tail", range(tail, until))):
                starts = [
                    t for t in some
                    if not t or words[t] != words[t - 1] and spans[t - 1][1] == spans[t][0]
                ]
                zones[zone] = ([base + spans[t][0] for t in starts], starts)
            yield {
                "key": [row["key"]], "chunk": pa.array([row["chunk"]], pa.int64()), "n": pa.array([len(words)], pa.int64()),
                **{f"{z}_{c}": pa.array([v], pa.list_(pa.int64())) for z, got in zones.items() for c, v in zip(("at", "before"), got, strict=True)},
            }

    return step


def _spliced(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, n_tokens) of the chunks joined at common word starts; keys with a seam that has none."""
    left = parts.select("key", (F.col("chunk") + 1).alias("chunk"), F.col("n").alias("left_n"), "tail_at", "tail_before")
    seams = (
        parts.where("chunk > 0")
        .select("key", "chunk", "head_at", "head_before")
        .join(left, ["key", "chunk"])
        .withColumn("at", F.array_min(F.array_intersect("tail_at", "head_at")))
    )
    kept = lambda at, before: F.element_at(before, F.array_position(at, F.col("at")).cast("int"))
    # Tokens of the left chunk from the seam on, and of the right one up to it, count twice or not at all.
    surplus = seams.where("at is not null").select(
        "key", (F.col("left_n") - kept("tail_at", "tail_before") + kept("head_at", "head_before")).alias("n")
    )
    counts = (
        parts.select("key", "n").unionByName(surplus.select("key", (-F.col("n")).alias("n")))
        .groupBy("key")
        .agg(F.sum("n").alias("n_tokens"))
    )
    return counts, seams.where("at is null").select("key").distinct()


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 1024,
    chunk_chars: int = 65536,
    overlap_chars: int = 512,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``.

    Texts up to ``chunk_chars`` are encoded whole. Longer ones are cut into chunks
    that overlap; each chunk is a row and can run in another task. Two chunks are
    joined at the first place in their overlap where both start a word and the left
    one has seen enough beyond it: splitting runs left to right, so from such a
    place on the right chunk splits as the whole text does. A text with a seam that
    has no such place is cut again with overlaps eight times as wide, in the end
    into one chunk. Special strings in texts are what the library makes of them.

    Null texts are empty (0 bytes, 0 tokens); null ids stay null; repeated rows give
    repeated results; an empty table gives no rows; other columns are not looked at.
    A tokenizer that can't be cut (normalizer, other splitting) encodes texts whole.
    """
    rows = keyed(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    small = rows if guard_chars(tokenizer_path) is None else rows.where(F.length("text") <= chunk_chars)
    counted = arrow_map(
        small.select("doc_id", "text", "n_bytes"), _count_step(tokenizer_path), "doc_id bigint, n_bytes bigint, n_tokens bigint"
    )
    if guard_chars(tokenizer_path) is not None:
        long_rows = rows.where(F.length("text") > chunk_chars).withColumn(
            "key", F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"), 256)
        )
        counted = counted.unionByName(
            long_rows.select("key", "doc_id", "n_bytes")
            .join(_long_counts(long_rows.select("key", "text"), tokenizer_path, chunk_chars, overlap_chars), "key")
            .select("doc_id", "n_bytes", "n_tokens")
        )
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _long_counts(texts: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(key, n_tokens) for each distinct key of ``texts``."""
    scratch, done, pending = Scratch(texts.sparkSession), None, texts
    while True:
        chunks = arrow_map(pending, _chunk_step(chunk, overlap), "key string, chunk bigint, start bigint, last boolean, part string")
        parts = scratch.write(
            arrow_map(
                chunks.repartition("key", "chunk"), _seam_step(path, chunk, overlap),
                "key string, chunk bigint, n bigint, head_at array<bigint>, head_before array<bigint>,"
                " tail_at array<bigint>, tail_before array<bigint>",
            ).dropDuplicates(["key", "chunk"]),
            f"parts-{overlap}",
        )
        counts, unsure = _spliced(parts)
        unsure = scratch.write(unsure, f"unsure-{overlap}")
        settled = counts.join(unsure, "key", "left_anti")
        done = settled if done is None else done.unionByName(settled)
        if unsure.isEmpty():
            return done
        pending = texts.join(unsure, "key", "left_semi")
        overlap *= 8
        chunk = max(chunk, overlap)
