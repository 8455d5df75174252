"""Sampled SentencePiece segmentations and their lossless decoding."""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rosterlake.llm.common import arrow_map, keyed

SPACE = "▁"
#: Characters segmented at once. A run of more than ``LONG_RUN`` characters without a blank goes by blocks of ``LONG_BLOCK``.
BLOCK_CHARS, LONG_RUN, LONG_BLOCK = 1 << 19, 1 << 18, 1 << 16
#: Ids decoded at once.
_DECODED = 1 << 16
#: Piece scores are multiplied by this; smaller values sample more freely.
SHARPNESS = 2e-4
#: Log weight of a byte where no piece fits, and what counts as excluded from sampling.
_BYTE_WEIGHT, _EXCLUDED = -40.0, -1e8
#: Stands for a U+2581 of the text: no character of any text, and in no piece.
_OWN_MARK = "\ud800"
_M = np.uint64(0x9E3779B97F4A7C15)
_START = np.array([0x2545F4914F6CDD1D], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PieceModel:
    """The pieces of a model as arrays, for lattices over many texts at once.

    Spaces are written as U+2581 and nothing else is normalized, so that decoding
    gives the text back; a U+2581 of the text itself is spelled in bytes. Pieces
    that hold the mark behind their first character, and excluded ones, aren't used.
    """

    def __init__(self, path: str, sharpness: float = SHARPNESS):
        import sentencepiece

        loaded = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [loaded.id_to_piece(i) for i in range(loaded.get_piece_size())]
        self.byte_ids = np.full(256, -1, np.int64)
        usable: dict[str, tuple[int, float]] = {}
        self.raw: list[bytes] = [b""] * len(pieces)
        for i, piece in enumerate(pieces):
            if loaded.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not (loaded.is_control(i) or loaded.is_unknown(i) or loaded.is_unused(i)):
                self.raw[i] = piece.replace(SPACE, " ").encode()
                if loaded.get_score(i) > _EXCLUDED and SPACE not in piece[1:]:
                    usable[piece] = (i, loaded.get_score(i) * sharpness)
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte pieces, so it can't keep every text")
        if SPACE in pieces:  # alone it stands for a blank before a blank, whatever its score
            usable.setdefault(SPACE, (pieces.index(SPACE), min(w for _, w in usable.values())))
        self.longest = max(map(len, usable))
        # All beginnings of pieces, as a sorted table of hashes: which piece it is, if any.
        table = {}
        for piece in usable:
            h = _START
            for end, c in enumerate(piece, 1):
                known = table.get(piece[:end])
                h = _mix(h + np.array([ord(c) * int(_M) % 2**64], np.uint64)) if known is None else known
                table[piece[:end]] = h
        parts = list(table)
        keys = np.concatenate([table[p] for p in parts])
        order = np.argsort(keys)
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces have one hash")
        self.keys = np.append(keys[order], np.uint64(2**64 - 1))
        top = (self.keys[:-1] >> np.uint64(44)).astype(np.int64)
        self.near = np.searchsorted(top, np.arange(1 << 20)).astype(np.int32)
        self.crowd = int(np.bincount(top).max()) + 1
        self.ids = np.array([usable.get(parts[i], (-1, 0))[0] for i in order], np.int32)
        self.weights = np.array([usable.get(parts[i], (0, -np.inf))[1] for i in order])

    def _find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash in the table and whether it is there; its upper bits lead near it."""
        found = self.near[key >> np.uint64(44)]
        for _ in range(self.crowd - 1):
            found = found + (self.keys[found] < key)
        return found, self.keys[found] == key

    def _edges(self, codes: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[length - 1, end] -> log weight and piece of the piece that ends there; -inf: none.

        ``stop``: end of each character's segment, which no piece crosses. Places
        where no piece begins with the characters so far are dropped at each length.
        """
        n = len(codes)
        weight, piece = np.full((self.longest, n), -np.inf), np.full((self.longest, n), -1, np.int32)
        start, key = np.arange(n), np.repeat(_START, n)
        for length in range(1, self.longest + 1):
            inside = start + length <= stop[start]
            start, key = start[inside], key[inside]
            if not len(start):
                break
            key = _mix(key + codes[start + length - 1] * _M)
            found, alive = self._find(key)
            start, key, found = start[alive], key[alive], found[alive]
            weight[length - 1, start + length - 1] = self.weights[found]
            piece[length - 1, start + length - 1] = self.ids[found]
        bare = np.isneginf(weight[0])
        weight[0, bare] = _BYTE_WEIGHT
        return weight, piece

    def sample(self, segments: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of one sampled segmentation of each segment, in a row, and how many each has.

        Forward filtering sums the weights of all segmentations up to each character;
        backward sampling draws the last piece, then the one before it, and so on.
        Equal segments share a lattice.
        """
        distinct: dict[str, int] = {}
        which = np.array([distinct.setdefault(s, len(distinct)) for s in segments], np.int64)
        sizes = np.array([len(s) for s in distinct], np.int64)
        codes = np.frombuffer("".join(distinct).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        first = np.cumsum(sizes) - sizes
        weight, piece = self._edges(codes, np.repeat(first + sizes, sizes))
        place = np.arange(len(codes)) - np.repeat(first, sizes)
        by_place = np.argsort(place, kind="stable")
        bounds = np.searchsorted(place[by_place], np.arange(place.max() + 2))
        log_sum = np.full(len(codes), -np.inf)
        # share: first the log weights of all ways by their last piece, then their running shares.
        share = weight
        for p in range(len(bounds) - 1):
            ends = by_place[bounds[p] : bounds[p + 1]]
            top = min(self.longest, p + 1)
            here = weight[:top, ends]
            for length in range(1, min(top, p) + 1):
                here[length - 1] += log_sum[ends - length]
            most = here.max(0)
            ways = np.exp(here - most)
            total = ways.sum(0)
            log_sum[ends] = most + np.log(total)
            share[:top, ends] = np.cumsum(ways / total, axis=0)
            share[top:, ends] = 1.0
        rows, ids, chars = [], [], []
        end, row, step = first[which] + sizes[which] - 1, np.arange(len(which)), 0
        while len(row):
            draw = (_mix(seeds[row] + np.uint64((step + 1) * int(_M) % 2**64)) >> np.uint64(11)) * (1.0 / (1 << 53))
            length = np.zeros(len(end), np.int64)
            left = np.arange(len(end))
            for k in range(self.longest - 1):
                left = left[share[k, end[left]] <= draw[left] * share[-1, end[left]]]
                if not len(left):
                    break
                length[left] += 1
            rows.append(row)
            ids.append(piece[length, end])
            chars.append(codes[end])
            end = end - length - 1
            more = end >= first[which[row]]
            row, end, step = row[more], end[more], step + 1
        rows = np.concatenate(rows)
        order = np.argsort(-rows, kind="stable")[::-1]
        rows, ids, chars = rows[order], np.concatenate(ids)[order], np.concatenate(chars)[order]
        bare = np.flatnonzero(ids < 0)
        spelling = [_spelling(c) for c in chars[bare].tolist()]
        width = np.ones(len(ids), np.int64)
        width[bare] = [len(b) for b in spelling]
        out = np.repeat(ids, width)
        at = np.cumsum(width) - width
        for i, b in zip(at[bare].tolist(), spelling, strict=True):
            out[i : i + len(b)] = self.byte_ids[list(b)]
        return out, np.bincount(rows, weights=width, minlength=len(segments)).astype(np.int64)

    def sample_long(self, segment: str, seed: int) -> np.ndarray:
        """Ids of one sampled segmentation of a segment of any length.

        The forward sums of a block hang on the last ``longest`` ones before it. These
        are kept for each block, so that backward sampling, from the last block to the first, works out
        the shares of one block at a time once more. What is held is one block, those sums and
        the ids.
        """
        raw = segment.encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(raw, "<u4")
        kept, before = [], np.full(self.longest, -np.inf)
        for lo in range(0, len(codes), LONG_BLOCK):
            kept.append(before)
            sums, _, _ = self._block(codes, lo, before)
            before = np.concatenate([before, sums])[-self.longest :]
        step, end, parts = 0, len(codes) - 1, []
        for lo in reversed(range(0, len(codes), LONG_BLOCK)):
            _, share, piece = self._block(codes, lo, kept.pop())
            drawn = []
            while end >= lo:
                draw = int(_mix(np.array([(int(seed) + (step + 1) * int(_M)) % 2**64], np.uint64))[0]) >> 11
                # As many ways as have a running share of no more than the draw come before the drawn one.
                length = int(np.searchsorted(share[end - lo], draw / (1 << 53) * share[end - lo, -1], "right"))
                length = min(length, self.longest - 1)
                found = int(piece[length, end - lo])
                drawn.append([found] if found >= 0 else self.byte_ids[list(_spelling(int(codes[end])))][::-1].tolist())
                end, step = end - length - 1, step + 1
            parts.append(np.array([x for ids in drawn for x in ids], np.int32))
        return np.concatenate(parts)[::-1]

    def _block(self, codes: np.ndarray, lo: int, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log sums, running shares [end, length - 1] and pieces [length - 1, end] of the block at ``lo``.

        ``before``: the log sums of the ``longest`` places before it, -inf where there are none.
        """
        hi, begin = min(lo + LONG_BLOCK, len(codes)), max(0, lo - self.longest + 1)
        part = codes[begin:hi].astype(np.uint64)
        weight, piece = self._edges(part, np.full(len(part), len(part)))
        weight, piece = weight[:, lo - begin :].T.copy(), piece[:, lo - begin :]
        sums = np.concatenate([before, np.empty(hi - lo)])
        for p in range(hi - lo):
            here = weight[p]
            # Ways of all lengths from the sums behind them, the nearest first; a way from the very beginning adds nothing.
            behind = sums[p + self.longest - 1 : (p - 1 if p else None) : -1]
            if lo + p < self.longest:
                behind = behind.copy()
                behind[lo + p] = 0.0
            here += behind
            most = here.max()
            ways = np.exp(here - most)
            total = ways.sum()
            sums[p + self.longest] = most + math.log(total)
            np.cumsum(ways / total, out=weight[p])
        return sums[self.longest :], weight, piece

    def spells(self, ids: np.ndarray, text: str) -> bool:
        """Whether a segmentation gives a whole text, compared a stretch at a time."""
        raw, at = memoryview(text.encode()), 0
        for lo in range(0, len(ids), _DECODED):
            part = b"".join([self.raw[i] for i in ids[lo : lo + _DECODED].tolist()])
            if raw[at : at + len(part)] != part:
                return False
            at += len(part)
        return at == len(raw)

    def decode(self, ids: list[int]) -> str:
        """The text of any segmentation of it."""
        return b"".join([self.raw[i] for i in ids]).decode()


def _spelling(code: int) -> bytes:
    """The bytes that a character without a piece stands for."""
    return b" " if code == ord(SPACE) else SPACE.encode() if code == ord(_OWN_MARK) else chr(code).encode("utf-8", "surrogatepass")


@functools.lru_cache(maxsize=2)
def piece_model(path: str, sharpness: float = SHARPNESS) -> PieceModel:
    return PieceModel(path, sharpness)


def _segments(text: str) -> list[str]:
    """Parts that begin at each blank, written with the mark; a mark of the text becomes ``_OWN_MARK``."""
    parts = text.replace(SPACE, _OWN_MARK).split(" ")
    return ([parts[0]] if parts[0] else []) + [SPACE + p for p in parts[1:]]


def sampled_ids(texts: list[str], keys: list[int], path: str, sharpness: float = SHARPNESS, seed: int = 0) -> Iterator[np.ndarray]:
    """Ids of each text; equal (text, key, seed) give equal ids, in any batch.

    Texts are segmented in blocks of segments; a long text may span several.
    """
    model = piece_model(path, sharpness)
    block: list[str] = []
    seeds: list[np.ndarray] = []
    owners: list[tuple[int, int]] = []
    done: list[list[np.ndarray]] = [[] for _ in texts]
    size = 0

    def flush() -> None:
        nonlocal size
        if block:
            ids, counts = model.sample(block, np.concatenate(seeds))
            ends = np.concatenate([[0], np.cumsum(counts)])
            at = 0
            for owner, count in owners:
                done[owner].append(ids[ends[at] : ends[at + count]])
                at += count
        block.clear(), seeds.clear(), owners.clear()
        size = 0

    def whole(t: int) -> np.ndarray:
        parts, done[t] = done[t], []
        return np.concatenate(parts) if parts else np.empty(0, np.int32)

    given = 0
    for t, (text, key) in enumerate(zip(texts, keys, strict=True)):
        parts = _segments(text)
        base = _mix(np.array([(key * 2 + 1) % 2**64, seed % 2**64], np.uint64))
        base = _mix(base[:1] + base[1:] * _M)
        lo = 0
        long = [i for i, part in enumerate(parts) if len(part) > LONG_RUN]
        while lo < len(parts):
            if long and lo == long[0]:
                flush()
                done[t].append(model.sample_long(parts[lo], int(_mix(base + np.array([lo], np.uint64) * _M)[0])))
                parts[lo] = ""
                long.pop(0)
                lo += 1
                continue
            hi, border = lo, long[0] if long else len(parts)
            while hi < border and (hi == lo or size < BLOCK_CHARS):
                more = parts[hi : min(hi + 256, border)]
                size += sum(map(len, more))
                hi += len(more)
            block += parts[lo:hi]
            seeds.append(_mix(base + np.arange(lo, hi).astype(np.uint64) * _M))
            owners.append((t, hi - lo))
            lo = hi
            if size >= BLOCK_CHARS:
                flush()
                while given < t:
                    yield whole(given)
                    given += 1
    flush()
    while given < len(texts):
        yield whole(given)
        given += 1


def encode_pieces(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", sharpness: float = SHARPNESS,
    seed: int = 0, keep_ids: bool = False,
) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, lossless (and ids) of a sampled segmentation of every text.

    The draw hangs on doc_id, the place in the text and ``seed`` alone, so a rerun or
    another partitioning gives the same ids. ``lossless``: decoding gave the whole
    text again. Null texts are empty (no pieces); null ids draw as -1; repeated rows
    repeat. Beside a batch of texts and its ids a task holds the lattice of one block, however
    long a run without a blank is.
    """

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        model = piece_model(model_path, sharpness)
        rows: list[tuple] = []
        texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
        keys = [-1 if i is None else i for i in ids]
        held = 0
        for doc, text, got in zip(ids, texts, sampled_ids(texts, keys, model_path, sharpness, seed), strict=True):
            crc = zlib.crc32(got.astype("<u4").tobytes())
            rows.append((doc, len(got), crc, model.spells(got, text), *([got] if keep_ids else [])))
            held += len(got) * keep_ids
            if held > 1_000_000:
                yield made(rows)
                rows, held = [], 0
        yield made(rows)

    kinds = [("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("lossless", pa.bool_())]
    if keep_ids:
        kinds.append(("ids", pa.list_(pa.int32())))

    def made(rows: list[tuple]) -> dict:
        return {n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(kinds)}

    schema = "doc_id bigint, n_pieces bigint, ids_crc32 bigint, lossless boolean" + ", ids array<int>" * keep_ids
    return arrow_map(keyed(docs, id_col, text_col), step, schema)


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids give a null text."""

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        model = piece_model(model_path)
        texts = [None if x is None else model.decode(x) for x in batch.column("ids").to_pylist()]
        yield {"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())}

    return arrow_map(encoded.select("doc_id", "ids"), step, "doc_id bigint, text string")
