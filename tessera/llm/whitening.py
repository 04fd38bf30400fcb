"""Whitening components of embeddings by shifted CholeskyQR.

One pass counts the vectors and sums the whole numbers x = floor(64 c) + 1000000 of each dimension exactly. Every further
pass sums one d x d Gram matrix of the centred rows, after as many triangular solves as there are factors so far: the
first factor is the Cholesky factor of the Gram matrix plus a small shift, the others need none, and passes go on until
the rows are orthonormal. The product R of the factors has the singular values and right vectors of the centred rows, so
the SVD of R gives the components without forming a product whose condition is squared. A last pass measures the
covariance of the whitened rows.

Tasks send one matrix each; they are added in two levels, 64 tasks and then one, so the driver holds a few d x d
matrices at any number of rows. Vectors are never shuffled.

Defined results: a vector is left out if it is null, empty, holds a null or non-finite entry or one whose x is beyond
2**62 in size, or has another length than most vectors (of equally many, the longest). Equal rows count once each; ids
are not used and may be null. Directions without variance (to rounding) are no components, so vectors of rank r have at
most r; a table without usable vectors has none, and no rows. ``deviation`` is null where it does not fit a long. Other
columns stay; ``into`` gets a free name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_name, table

COMPONENTS = 32
SCALE, OFFSET = 64.0, 1_000_000
_LARGEST = float(1 << 62)
_UNIT = np.finfo(float).eps / 2
_ADDERS = 64             # tasks of the first level of addition
_PASSES = 12
_ORTHONORMAL = 1e-12


@dataclass(frozen=True)
class Whitening:
    """Components are columns, numbered by falling eigenvalue; ``total`` is the trace of the covariance."""

    n: int = 0
    sums: tuple[int, ...] = ()
    components: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    eigenvalues: np.ndarray = field(default_factory=lambda: np.zeros(0))
    total: float = 0.0
    passes: int = 0
    identity_error: float = 0.0


def _rows(vectors: pa.Array, length: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, x) of the usable vectors, by length."""
    if not len(vectors):
        return
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = vectors.flatten().cast(pa.float64())
    empty = values.is_null().to_numpy(zero_copy_only=False)
    scaled = np.floor(values.fill_null(0.0).to_numpy(zero_copy_only=False) * SCALE)
    bad = empty | ~(np.abs(scaled) < _LARGEST)
    first = np.cumsum(sizes) - sizes
    wrong = np.concatenate([[0], np.cumsum(bad)])
    good = (sizes > 0) & (wrong[first + sizes] == wrong[first])
    for size in np.unique(sizes[good]) if length is None else [length]:
        at = np.flatnonzero(good & (sizes == size))
        if len(at):
            yield at, scaled[first[at][:, None] + np.arange(size)].astype(np.int64) + OFFSET


def _sums(vectors: DataFrame) -> tuple[int, tuple[int, ...]]:
    """(number, exact sums per dimension) of the vectors of the most frequent length."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for _, x in _rows(b.column(0)):                       # halves of x, whose sums stay small
                part = np.stack([np.full(x.shape[1], len(x)), (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)])
                found[x.shape[1]] = found.get(x.shape[1], 0) + part
        for size, (n, high, low) in found.items():
            yield pa.record_batch([pa.array(np.full(size, size)), pa.array(np.arange(size)), pa.array(n), pa.array(high), pa.array(low)],
                                  names=["size", "dimension", "n", "high", "low"])

    wide = "decimal(20,0)"
    added = vectors.mapInArrow(add, "size bigint, dimension bigint, n bigint, high bigint, low bigint").groupBy("size", "dimension").agg(
        F.sum("n").alias("n"), F.sum(F.col("high").cast(wide)).alias("high"), F.sum(F.col("low").cast(wide)).alias("low"))
    most = added.orderBy(F.desc("n"), F.desc("size")).select("size", "n").head()
    if most is None:
        return 0, ()
    rows = added.where(F.col("size") == most["size"]).orderBy("dimension").collect()   # one row for each dimension
    return most["n"], tuple((int(r["high"]) << 32) + int(r["low"]) for r in rows)


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x - S/n: the whole part of the mean is taken off exactly."""
    whole = np.array([s // n for s in sums], np.int64)
    return (x - whole).astype(float) - np.array([(s % n) / n for s in sums])


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum over the dimensions of (n x - S)**2, exact."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], object)
    away = x - whole
    largest = (int(np.abs(away).max(initial=0)) + 1) * n
    if largest * largest * max(x.shape[1], 1) < 1 << 63:
        return ((away * n - rest.astype(np.int64)) ** 2).sum(1).tolist()
    exact = ((away.astype(object) * n - rest) ** 2).sum(1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def solve(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Q of rows = Q factor for an upper triangular factor; a column with a zero pivot becomes zero."""
    made = np.zeros_like(rows)
    for j in range(rows.shape[1]):
        if factor[j, j]:
            made[:, j] = (rows[:, j] - made[:, :j] @ factor[:j, j]) / factor[j, j]
    return made


def cholesky(gram: np.ndarray, least: float) -> np.ndarray:
    """Upper factor of a symmetric matrix; a pivot of at most ``least`` (a dependent column) leaves its row zero."""
    d = len(gram)
    factor = np.zeros((d, d))
    for j in range(d):
        pivot = gram[j, j] - factor[:j, j] @ factor[:j, j]
        if pivot > least:
            factor[j, j] = np.sqrt(pivot)
            factor[j, j + 1:] = (gram[j, j + 1:] - factor[:j, j] @ factor[:j, j + 1:]) / factor[j, j]
    return factor


def _gram(vectors: DataFrame, length: int, transform, width: int) -> np.ndarray:
    """The Gram matrix (and, in the last column, the sums) of ``transform(x)`` over all usable rows, ``width`` wide."""
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = np.zeros((width, width + 1))
        for b in batches:
            for _, x in _rows(b.column(0), length):
                rows = transform(x)
                made[:, :width] += rows.T @ rows
                made[:, width] += rows.sum(0)
        yield pa.record_batch([pa.array([TaskContext.get().partitionId() % _ADDERS], pa.int32()), pa.array([made.tobytes()])],
                              names=["adder", "matrix"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, any_ = np.zeros((width, width + 1)), False
        for b in batches:
            for one in b.column(1).to_pylist():
                made, any_ = made + np.frombuffer(one).reshape(width, width + 1), True
        if any_:
            yield pa.record_batch([pa.array([0], pa.int32()), pa.array([made.tobytes()])], names=["adder", "matrix"])

    kind = "adder int, matrix binary"
    parts = vectors.mapInArrow(multiply, kind).repartition(_ADDERS, "adder").mapInArrow(add, kind)
    total = parts.repartition(1).mapInArrow(add, kind).head()    # one matrix
    return np.frombuffer(total["matrix"]).reshape(width, width + 1) if total else np.zeros((width, width + 1))


def fit(rows: DataFrame, vector: str = "embedding", most: int = COMPONENTS) -> Whitening:
    """Components of all usable vectors."""
    vectors = rows.select(F.col(vector).cast("array<double>").alias("vector"))
    n, sums = _sums(vectors)
    if not n:
        return Whitening()
    d = len(sums)
    factors: list[np.ndarray] = []

    def orthogonal(x: np.ndarray) -> np.ndarray:
        made = _centred(x, n, sums)
        for factor in factors:
            made = solve(made, factor)
        return made

    for passes in range(1, _PASSES + 1):
        gram = _gram(vectors, d, orthogonal, d)[:, :d]
        if not factors:
            # rounding of sums over batches of rows, which are added pairwise, and of the Gram product itself
            shift = 11 * (min(n, 1 << 16) * d + d * (d + 1)) * _UNIT * np.trace(gram)
            factors.append(cholesky(gram + shift * np.eye(d), 0.0))
            continue
        live = np.diag(gram) > 0.5
        if np.abs(gram - np.diag(live.astype(float))).max() <= _ORTHONORMAL:
            break
        factors.append(cholesky(gram, 1e-10))
    product = np.eye(d)
    for factor in factors:
        product = factor @ product
    _, singular, right = np.linalg.svd(product)
    kept = int((singular[:most] > 10 * d * _UNIT * singular[0]).sum()) if singular[0] > 0 else 0
    components = right[:kept].T
    components = components * np.where(components[np.abs(components).argmax(0), np.arange(kept)] < 0, -1.0, 1.0)
    values = singular ** 2 / n
    scaled = components / np.sqrt(values[:kept])
    error = 0.0
    if kept:
        got = _gram(vectors, d, lambda x: _centred(x, n, sums) @ scaled, kept)
        mean = got[:, kept] / n
        error = float(np.abs(got[:, :kept] / n - np.outer(mean, mean) - np.eye(kept)).max())
    return Whitening(n, sums, components, values[:kept], float(values.sum()), passes, error)


def whiten(rows: DataFrame, model: Whitening, vector: str = "embedding", into: str = "whitening") -> DataFrame:
    """The rows with usable vectors, with a struct ``into`` (see ``free_name``): ``deviation`` and the ``whitened`` vector."""
    into = free_name(rows, into)
    if not model.n:
        return rows.withColumn(into, F.lit(None).cast("struct<deviation:bigint,whitened:array<double>>")).where(F.lit(False))
    scaled = model.components / np.sqrt(model.eigenvalues)

    @F.arrow_udf("struct<deviation:bigint,whitened:array<double>>")
    def project(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            made = np.zeros((len(vectors), scaled.shape[1]))
            deviation = pa.nulls(len(vectors), pa.int64()).to_pylist()
            missing = np.ones(len(vectors), bool)
            for at, x in _rows(vectors, len(model.sums)):
                made[at] = _centred(x, model.n, model.sums) @ scaled
                missing[at] = False
                for i, v in zip(at.tolist(), _deviations(x, model.n, model.sums)):
                    deviation[i] = v
            offsets = np.arange(len(made) + 1, dtype=np.int32) * scaled.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(made.reshape(-1)))
            yield pa.StructArray.from_arrays([pa.array(deviation, pa.int64()), lists], names=["deviation", "whitened"],
                                             mask=pa.array(missing))

    made = rows.withColumn(into, project.asNondeterministic()(F.col(vector).cast("array<double>")))
    return made.where(F.col(into).isNotNull())


def op12(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fit(rows)
    shares = F.array(*[F.lit(float(v / model.total)) for v in model.eigenvalues]).cast("array<double>")
    made = whiten(rows, model).select("vec_id", "whitening.deviation", F.posexplode("whitening.whitened").alias("at", "whitened"))
    return made.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation",
                       "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
