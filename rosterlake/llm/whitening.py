"""Whitening of embeddings through polarised covariances.

Entries become integers, so every centred value can be held exactly: n * x - S for an
entry x, the number n of vectors and the sum S of its dimension. One pass adds up, for every
dimension and for the sum of every two dimensions, the squares of these values,
exactly. The square of a sum holds the mixed product, so

    2 * cov(i, j) = var(i + j) - var(i) - var(j)

recovers every cross-covariance from variances alone; they are assembled on the
driver as a matrix of dimension squared numbers, whatever the table, for the eigenvectors.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable, Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rosterlake.llm.common import ship

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Bits of a limb, and rows squared at once: products of two limbs stay within 64 bits when summed.
_LIMB, _ROWS = 20, 4096
#: Eigenvalues below this share of the largest are taken for zero.
_FLAT = 1e-12
_WHOLE = "decimal(38,0)"


def entries(batch: pa.RecordBatch, length: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row places, integer entries) of the usable vectors of a batch, one block for each length.

    Usable: not null, not empty, every entry a finite number.
    """
    vectors = batch.column("vector")
    flat = vectors.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    # A null vector may hide entries from `flatten`, so places come from lengths.
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    begins = np.cumsum(sizes) - sizes
    for d in np.unique(sizes[sizes > 0]) if length is None else [length]:
        rows = np.flatnonzero(sizes == d)
        block = values[begins[rows][:, None] + np.arange(d)]
        good = np.isfinite(block).all(axis=1)
        if good.any():
            yield rows[good], np.floor(SCALE * block[good]).astype(np.int64) + SHIFT


def square_sums(y: np.ndarray) -> list[int]:
    """Exact sums over the rows of y of y_i squared, then (y_i + y_j) squared for i < j, row by row of the upper triangle."""
    d = y.shape[1]
    top = max(1, 2 * int(np.abs(y).max(initial=0)))
    if top > 2**62:
        raise OverflowError("centred values exceed 62 bits")
    limbs = -(-(top.bit_length() + 1) // _LIMB)
    totals = np.zeros(d + d * (d - 1) // 2, object)
    for lo in range(0, len(y), _ROWS):
        part = np.ascontiguousarray(y[lo : lo + _ROWS].T)
        at = d
        totals[:d] += _squares(part, limbs)
        for i in range(d - 1):
            totals[at : at + d - 1 - i] += _squares(part[i + 1 :] + part[i], limbs)
            at += d - 1 - i
    return totals.tolist()


def _squares(z: np.ndarray, limbs: int) -> np.ndarray:
    """Exact sums of squares along the last axis as Python integers."""
    parts = []
    for _ in range(limbs - 1):
        parts.append(z & ((1 << _LIMB) - 1))
        z = z >> _LIMB
    parts.append(z)
    total = np.zeros(len(z), object)
    for a in range(limbs):
        for b in range(a, limbs):
            both = np.einsum("ij,ij->i", parts[a], parts[b]).astype(object)
            total += both * ((1 if a == b else 2) << (_LIMB * (a + b)))
    return total


@dataclasses.dataclass(frozen=True)
class Whitening:
    """A fit: what a row needs to be whitened, all of it bounded by the dimension squared."""

    n: int
    sums: tuple[int, ...]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray  # one column per component

    @property
    def length(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact in 64 bits or refused."""
        far = max([abs(self.n * int(x.max(initial=0))), abs(self.n * int(x.min(initial=0))), *map(abs, self.sums)])
        if far >= 2**62:
            raise OverflowError("n times an entry exceeds 62 bits")
        return self.n * x - np.array(self.sums, np.int64)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows by components; NaN along a component without variance."""
        flat = self.values <= _FLAT * max(self.values[0], 0.0)
        scale = np.where(flat, np.nan, 1 / np.sqrt(np.where(flat, 1.0, self.values)))
        return (self.centred(x) / self.n) @ self.vectors * scale

    @property
    def explained(self) -> list[float | None]:
        trace = float(np.trace(self.covariance))
        return [max(float(v), 0.0) / trace if trace > 0 else None for v in self.values]


def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for rows, x in entries(batch):
            n, s = found.get(x.shape[1], (0, np.zeros(x.shape[1], object)))
            found[x.shape[1]] = (n + len(rows), s + x.astype(object).sum(axis=0) if np.abs(x).max() > 2**40 else s + x.sum(axis=0))
    for d, (n, s) in found.items():
        yield pa.RecordBatch.from_pydict({
            "length": pa.array([d] * d, pa.int32()), "i": pa.array(range(d), pa.int32()), "n": pa.array([n] * d, pa.int64()),
            "s": pa.array([Decimal(int(v)) for v in s], pa.decimal128(38, 0)),
        })


def _partials(values: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"i": pa.array(range(len(values)), pa.int32()), "q": pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))})


def _named(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    ship(embeddings.sparkSession)
    return embeddings.select(
        embeddings[f"`{id_col}`"].cast("bigint").alias("vec_id"), embeddings[f"`{vector_col}`"].cast("array<double>").alias("vector")
    )


def fit(embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> Whitening | None:
    """The whitening of all usable vectors, or None if there is none.

    Two passes: counts and sums, then squares. What is shuffled are the partial sums of each
    input partition, dimension squared / 2 numbers, and the totals come to the driver.
    Vectors of another length than the most frequent one (the longer of two) are left out.
    """
    rows = _named(embeddings, id_col, vector_col).select("vector")
    found = rows.mapInArrow(_sums, f"length int, i int, n bigint, s {_WHOLE}").groupBy("length", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    first = found.where("i = 0").orderBy(F.desc("n"), F.desc("length")).limit(1).select("length")
    got = found.join(F.broadcast(first), "length").orderBy("i").collect()
    if not got:
        return None
    n, sums = got[0]["n"], tuple(int(r["s"]) for r in got)
    d = len(sums)
    plain = Whitening(n, sums, np.empty((0, 0)), np.empty(0), np.empty((0, 0)))

    def squares(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d * (d + 1) // 2, object)
        for batch in batches:
            for _, x in entries(batch, d):
                total += np.array(square_sums(plain.centred(x)), object)
        yield _partials(total.tolist())

    sums_of = rows.mapInArrow(squares, f"i int, q {_WHOLE}").groupBy("i").agg(F.sum("q").alias("q"))
    q = [int(r["q"]) for r in sums_of.orderBy("i").collect()]
    return dataclasses.replace(plain, **_solved(q, n, d, components))


def _solved(q: list[int], n: int, d: int, components: int) -> dict:
    """Covariances from the exact square sums, rounded once, and their leading eigenvectors."""
    whole = n**3
    cov = np.empty((d, d))
    at = d
    for i in range(d):
        cov[i, i] = float(Fraction(q[i], whole))
        for j in range(i + 1, d):
            cov[i, j] = cov[j, i] = float(Fraction(q[at] - q[i] - q[j], 2 * whole))
            at += 1
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    # Either sign will do, but reruns should agree: the largest entry is positive.
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return {"covariance": cov, "values": values, "vectors": vectors * signs}


def identity_error(embeddings: DataFrame, fitted: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity.

    Measured on the rows, in one more pass of partial sums, over the components with variance.
    """
    k = len(fitted.values)

    def products(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            for _, x in entries(batch, fitted.length):
                w = np.column_stack([fitted.whitened(x), np.ones(len(x))])
                total += w.T @ w
        yield pa.RecordBatch.from_pydict({"i": pa.array(range((k + 1) ** 2), pa.int32()), "q": pa.array(total.ravel())})

    rows = _named(embeddings, id_col, vector_col).select("vector")
    added = rows.mapInArrow(products, "i int, q double").groupBy("i").agg(F.sum("q").alias("q")).orderBy("i")
    total = np.array([r["q"] for r in added.collect()]).reshape(k + 1, k + 1)
    mean = total[:k, k] / fitted.n
    error = np.abs(total[:k, :k] / fitted.n - np.outer(mean, mean) - np.eye(k))
    return float(np.nanmax(error)) if np.isfinite(error).any() else None


def whiten(
    embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", fitted: Whitening | None = None
) -> DataFrame:
    """vec_id, n, deviation, whitened (array of ``components`` numbers) of every usable vector, and the fit's explained, identity_error.

    Entries c become x = floor(1024 * c) + 100000; components are the eigenvectors of
    x's covariance by falling eigenvalue. ``deviation`` is the sum over dimensions of (n * x - S)
    squared, exact, as a decimal.

    Vectors that are null or empty, hold null or non-finite entries, or have another
    length than the most frequent one give no row. Null and repeated ids stand like any
    other. Along a component without variance (one vector, equal vectors, more
    dimensions than vectors) ``whitened`` is null and no error is counted; where nothing varies
    ``explained`` is null. An empty table gives no rows. Entries so large that n * x leaves 62
    bits are refused, as no exact square could be held. Other columns are not looked at.
    """
    fitted = fitted or fit(embeddings, components, id_col, vector_col)
    rows = _named(embeddings, id_col, vector_col)
    constants = {"n": fitted.n if fitted else 0, "explained": fitted.explained if fitted else []}
    error = identity_error(embeddings, fitted, id_col, vector_col) if fitted else None

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in entries(batch, fitted.length):
                y = fitted.centred(x)
                w = fitted.whitened(x)
                exact = _squares(y, -(-(max(1, int(np.abs(y).max())).bit_length() + 1) // _LIMB))
                yield pa.RecordBatch.from_pydict({
                    "vec_id": batch.column("vec_id").take(pa.array(at)),
                    "deviation": pa.array([Decimal(v) for v in exact.tolist()], pa.decimal128(38, 0)),
                    "whitened": pa.array([[None if np.isnan(v) else v for v in r] for r in w.tolist()], pa.list_(pa.float64())),
                })

    schema = f"vec_id bigint, deviation {_WHOLE}, whitened array<double>"
    made = rows.mapInArrow(project, schema) if fitted else rows.where("false").select("vec_id", F.lit(None).cast(_WHOLE).alias("deviation"), F.col("vector").alias("whitened"))
    return made.select(
        "vec_id", F.lit(constants["n"]).cast("bigint").alias("n"), "deviation", "whitened",
        _doubles(constants["explained"]).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def _doubles(values: list[float | None]) -> Column:
    return F.array(*[F.lit(v).cast("double") for v in values]).cast("array<double>")


def by_component(whitened: DataFrame) -> DataFrame:
    """One row per vector and component, numbered from 1; a deviation beyond a long is null."""
    each = whitened.select("*", F.posexplode("whitened").alias("place", "value"))
    return each.select(
        "vec_id", (F.col("place") + 1).alias("component"), "n", F.expr("try_cast(deviation as bigint)").alias("deviation"),
        F.col("value").alias("whitened"), F.get("explained", F.col("place")).alias("explained"), "identity_error",
    )
