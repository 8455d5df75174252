"""Document quality by attention over passages (multiple-instance learning)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rosterlake.llm.common import arrow_map, keyed, slices

#: Words of a passage; the whole text is cut, the last passage may be shorter.
PASSAGE_WORDS = 64
#: Buckets of hashed byte pairs beside the counted features.
PAIR_BUCKETS = 64
#: Labelled documents learnt from, at most, per class; texts longer than this many
#: characters are not learnt from (they are scored like any other).
SAMPLE_PER_CLASS, SAMPLE_CHARS = 2000, 20_000
#: Bytes encoded at once; a longer text is encoded in parts cut at blanks.
BATCH_BYTES = 1 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


#: Shares of a passage's bytes.
_SHARES = np.stack([
    _class(bytes(range(65, 91))), _class(bytes(range(97, 123))), _class(b"0123456789"), _class(b".!?"), _class(b","),
    _class(b"!"), _class(b"#*$%&"), _class(b"|<>"), _class(b"\n"), _class(b"'\"()[]{}"), _class(b":;/\\@_=+~^`-"),
    _class(bytes(range(128, 256))),
])
#: Random 64-bit factors of the word hash; a fixed seed, so that every task hashes alike.
_MIX = np.random.default_rng(20240229)
_BYTE_KEY = _MIX.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE_KEY = _MIX.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
N_FEATURES = len(_SHARES) + 6 + PAIR_BUCKETS


def passage_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document number, features) of every passage; a text without words has none."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    blank = _BLANK[raw]
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    if not len(starts):
        return np.empty(0, np.int64), np.empty((0, N_FEATURES), np.float32)
    stops = np.flatnonzero(blank & ~np.concatenate([[True], blank[:-1]]))
    doc = np.searchsorted(ends, starts, side="right")
    first = np.searchsorted(doc, doc)  # of the document's words
    opens = (np.arange(len(starts)) - first) % PASSAGE_WORDS == 0
    passage_of = np.cumsum(opens) - 1
    heads = np.flatnonzero(opens)
    n_words = np.diff(np.append(heads, len(starts)))
    lengths = stops - starts
    # Bytes from the passage's first word up to the next passage of the same text.
    from_byte = starts[heads]
    to_byte = np.minimum(np.append(from_byte[1:], len(raw)), ends[doc[heads]] - 1)
    owner = np.zeros(len(raw), np.int64)
    owner[from_byte] = 1
    owner = np.cumsum(owner) - 1
    inside = (owner >= 0) & (np.arange(len(raw)) < to_byte[np.maximum(owner, 0)])
    size = np.maximum(to_byte - from_byte, 1).astype(np.float64)
    count = len(heads)
    by_byte = np.bincount(owner[inside] * 256 + raw[inside], minlength=count * 256).reshape(count, 256)
    shares = by_byte @ _SHARES.T / size[:, None]
    pair = ((raw[:-1].astype(np.uint32) * 2654435761 + raw[1:].astype(np.uint32) * 40503) >> np.uint32(7)) % PAIR_BUCKETS
    both = inside[:-1] & inside[1:] & (owner[:-1] == owner[1:])
    pairs = np.bincount(owner[:-1][both] * PAIR_BUCKETS + pair[both], minlength=count * PAIR_BUCKETS)
    pairs = np.sqrt(pairs.reshape(count, PAIR_BUCKETS) / size[:, None])
    at_start = np.zeros(len(raw), np.int64)
    at_start[starts] = starts
    place = np.arange(len(raw)) - np.maximum.accumulate(at_start)
    spelled = np.where(blank, np.uint64(0), _BYTE_KEY[raw] * _PLACE_KEY[place & 63] + (_BYTE_KEY[raw] >> np.uint64(17)))
    hashes = np.add.reduceat(spelled, starts)
    same = np.zeros(len(starts), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & ~opens[1:]
    order = np.lexsort((hashes, passage_of))
    again = np.zeros(len(starts), bool)
    again[1:] = (hashes[order][1:] == hashes[order][:-1]) & (passage_of[order][1:] == passage_of[order][:-1])
    add = lambda x: np.add.reduceat(x.astype(np.float64), heads)
    noisy = _SHARES[6][raw[stops - 1]] | _SHARES[5][raw[stops - 1]]
    upper = _SHARES[0][raw[starts]] & _SHARES[0][raw[np.minimum(starts + 1, stops - 1)]] & (lengths > 1)
    others = np.stack([
        add(lengths) / n_words / 10, add(same) / n_words, np.add.reduceat(again.astype(np.float64), heads) / n_words,
        add(noisy) / n_words, add(upper) / n_words, np.log1p(n_words) / 5,
    ], axis=1)
    return doc[heads], np.concatenate([shares * 4, others * 2, pairs], axis=1).astype(np.float32)


def _parts(text: bytes) -> Iterator[bytes]:
    """The text in parts of about BATCH_BYTES, cut where a word begins after a blank."""
    start = 0
    while len(text) - start > BATCH_BYTES:
        at = text.find(b" ", start + BATCH_BYTES)
        if at < 0:
            break
        yield text[start:at]
        start = at
    yield text[start:]


def document_features(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, texts, document numbers from 0, features) in bounded steps of whole texts."""
    raw = [list(_parts(t.encode())) for t in texts]
    for lo, hi in slices(texts, BATCH_BYTES):
        parts = [p for t in raw[lo:hi] for p in t]
        owner = np.repeat(np.arange(hi - lo), [len(t) for t in raw[lo:hi]])
        got = [(owner[a + d], x) for a, b in slices(parts, BATCH_BYTES) for d, x in [passage_features(parts[a:b])]]
        yield lo, hi - lo, np.concatenate([d for d, _ in got]), np.concatenate([x for _, x in got])


class AttentionModel:
    """Gated attention pooling of encoded passages and a logistic score.

    h = tanh(W x + b); a ~ exp(w . (tanh(V h) * sigm(U h))) within a document;
    score = sigm(c . sum(a h) + d). Trained in full batches by Adam on the
    documents' labels alone; weights take a few kilobytes.
    """

    def __init__(self, width: int = 24, gate: int = 12, seed: int = 11):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-1]), shape)
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        self.w = {
            "W": draw(width, N_FEATURES), "b": np.zeros(width), "V": draw(gate, width), "U": draw(gate, width),
            "w": draw(gate), "c": draw(width), "d": np.zeros(1),
        }

    def _forward(self, x: np.ndarray, first: np.ndarray, size: np.ndarray) -> dict:
        w = self.w
        h = np.tanh(((x - self.mean) / self.scale) @ w["W"].T + w["b"])
        t, g = np.tanh(h @ w["V"].T), 1 / (1 + np.exp(-(h @ w["U"].T)))
        e = (t * g) @ w["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), size))
        a = e / np.repeat(np.add.reduceat(e, first), size)
        z = np.add.reduceat(a[:, None] * h, first)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -30, 30)))}

    def scores(self, doc: np.ndarray, x: np.ndarray, n_docs: int) -> np.ndarray:
        """Score of each document; one without passages gets 0, the junk end."""
        out = np.zeros(n_docs)
        if len(doc):
            here, first, size = np.unique(doc, return_index=True, return_counts=True)
            out[here] = self._forward(x, first, size)["p"]
        return out

    def attention(self, x: np.ndarray) -> np.ndarray:
        """Weights of the passages of one document."""
        return self._forward(x, np.array([0]), np.array([len(x)]))["a"]

    def fit(self, doc: np.ndarray, x: np.ndarray, y: np.ndarray, steps: int = 200, rate: float = 0.02, decay: float = 1e-4):
        """doc: 0..n-1 in order, each with a passage; y: their labels. Classes weigh alike."""
        self.mean, self.scale = x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64) + 1e-3
        _, first, size = np.unique(doc, return_index=True, return_counts=True)
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
        standard = (x - self.mean) / self.scale
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        for step in range(1, steps + 1):
            w, f = self.w, self._forward(x, first, size)
            wrong = (f["p"] - y) * weight
            dz = wrong[:, None] * w["c"]
            each = np.repeat(dz, size, axis=0)
            da = (each * f["h"]).sum(1)
            de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, first), size))
            dt, dg = de[:, None] * w["w"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * w["w"] * f["t"] * f["g"] * (1 - f["g"])
            dh = (f["a"][:, None] * each + dt @ w["V"] + dg @ w["U"]) * (1 - f["h"] ** 2)
            slope = {
                "W": dh.T @ standard, "b": dh.sum(0), "V": dt.T @ f["h"], "U": dg.T @ f["h"],
                "w": (de[:, None] * f["t"] * f["g"]).sum(0), "c": f["z"].T @ wrong, "d": np.array([wrong.sum()]),
            }
            for k, v in slope.items():
                m, s = moments[k]
                m += 0.1 * (v + decay * w[k] - m)
                s += 0.01 * ((v + decay * w[k]) ** 2 - s)
                w[k] = w[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
        return self


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> AttentionModel | None:
    """Learn from labelled documents whose crc32(doc_id) mod 3 is not 1.

    A bounded sample: per class, the ``SAMPLE_PER_CLASS`` documents of smallest id
    hash among those of at most ``SAMPLE_CHARS`` characters. Labels repeated for an
    id are averaged (half and more is 1); null labels and ids don't count. None
    where a class has no document with words.
    """
    known = (
        labels.select(labels["doc_id"].cast("bigint").alias("doc_id"), labels[label_col].alias("y"))
        .dropna()
        .groupBy("doc_id")
        .agg((F.avg("y") >= 0.5).cast("int").alias("y"))
        .where(~_held_out(F.col("doc_id")))
    )
    rows = keyed(docs, "doc_id", "text").where((F.length("text") <= SAMPLE_CHARS) & F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select("doc_id").join(known, "doc_id")
    # Bounded: the limit stands at both classes, and only ids and labels are brought together.
    picked = None
    for y in (0, 1):
        some = rows.where(F.col("y") == y).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_PER_CLASS)
        picked = some if picked is None else picked.unionByName(some)
    texts = keyed(docs, "doc_id", "text").where(F.length("text") <= SAMPLE_CHARS)
    texts = texts.join(F.broadcast(picked), "doc_id")

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        for lo, _, doc, x in document_features(batch.column("text").to_pylist()):
            for i in np.unique(doc).tolist():
                yield {
                    "doc_id": batch.column("doc_id").slice(lo + i, 1), "y": batch.column("y").slice(lo + i, 1),
                    "x": pa.array([x[doc == i].tobytes()], pa.binary()),
                }

    got = arrow_map(texts, step, "doc_id bigint, y int, x binary").collect()
    got = sorted({r["doc_id"]: r for r in got}.values(), key=lambda r: r["doc_id"])
    y = np.array([r["y"] for r in got])
    if len(set(y.tolist())) < 2:
        return None
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES) for r in got]
    return AttentionModel().fit(np.repeat(np.arange(len(bags)), [len(b) for b in bags]), np.concatenate(bags), y)


def _scores(model: AttentionModel | None, texts: list[str]) -> np.ndarray:
    scores = [np.empty(0)]
    for _, n, doc, x in document_features(texts):
        if model is None:
            here = np.zeros(n)
            here[np.unique(doc)] = 0.5
            scores.append(here)
        else:
            scores.append(model.scores(doc, x, n))
    return np.concatenate(scores)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Every text is cut into passages of 64 words, all of them encoded and weighed.
    The model sees texts alone. A text without words (null, empty, blanks) scores 0.
    Without labels of both classes every text with words scores 0.5. Null ids are
    not held out. Repeated rows repeat; an empty table gives no rows.
    """
    model = train(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), labels)

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {"doc_id": batch.column("doc_id"), "score": pa.array(_scores(model, batch.column("text").to_pylist()), pa.float64())}

    scored = arrow_map(keyed(docs, id_col, text_col), step, "doc_id bigint, score double")
    return scored.select(
        "doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def kept_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose own text scores 0.5 or more, whatever their ids; same columns."""
    model = train(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), labels)
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).cast(pa.string()).to_pylist()]
            yield batch.filter(pa.array(_scores(model, texts) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
