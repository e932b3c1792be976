"""Embedding whitening from a polarised covariance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.common import FILE, LOCATOR, ROW, anchored, arrow_batches, source_rows, write_table

SCALE, SHIFT = 64, 1_000_000
LARGEST = 2.0 ** 52  # |64 c| beyond this has no exact place among the doubles next to it: the component is held there
LIMB = 30  # bits of a limb: exact sums of any size travel as a few longs
LIMBS = 6
SMALL = 1 << 20  # whole numbers up to this are squared and summed in 64 bits, others in Python's integers
EPS = 1e-12  # components below this share of the trace are no directions of the data


def integer_vectors(rows: DataFrame) -> DataFrame:
    """`vector` (x, floor(64 c) + 1000000) of the rows of `rows` (locator, id, vector) whose components are all finite.

    Vectors of another length than the most frequent one take no part, nor do empty ones.
    """
    entry = F.col("vector")
    finite = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    usable = rows.filter(entry.isNotNull() & finite & (F.size(entry) > 0))
    lengths = usable.groupBy(F.size(entry).alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "length").limit(1).collect()
    length = lengths[0]["length"] if lengths else 0
    bound = F.lit(LARGEST)
    whole = F.transform(entry, lambda c: F.floor(F.least(F.greatest(F.lit(float(SCALE)) * c.cast("double"), -bound), bound)).cast("bigint") + F.lit(SHIFT))
    return usable.filter(F.size(entry) == length).select(*LOCATOR, "id", whole.alias("vector"))


def _matrix(column: pa.Array) -> np.ndarray:
    """A batch of lists of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _limbs(value: int) -> list[int]:
    """A whole number as LIMBS longs that add up limb by limb; the last one carries the sign."""
    out = []
    for _ in range(LIMBS - 1):
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def _value(limbs) -> int:
    return sum(int(x) << (LIMB * k) for k, x in enumerate(limbs))


LIMB_COLUMNS = [f"l{k}" for k in range(LIMBS)]
SUMS = "i int, j int, " + ", ".join(f"{c} bigint" for c in LIMB_COLUMNS)


def _summed(partials: DataFrame) -> dict[tuple[int, int], int]:
    """Exact totals by (i, j) over all partitions: one row for each pair of dimensions, whatever the number of vectors."""
    rows = partials.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in LIMB_COLUMNS]).collect()
    return {(r["i"], r["j"]): _value([r[c] for c in LIMB_COLUMNS]) for r in rows}


def _emit(totals: dict[tuple[int, int], int]) -> pa.RecordBatch:
    rows = [(i, j, *_limbs(v)) for (i, j), v in totals.items()]
    columns = list(zip(*rows)) if rows else [()] * (2 + LIMBS)
    kinds = [pa.int32(), pa.int32(), *[pa.int64()] * LIMBS]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["i", "j", *LIMB_COLUMNS])


def dimension_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = None, 0
        for batch in batches:
            if batch.num_rows:
                part = [int(v) for v in (_matrix(batch.column(0)) >> LIMB).sum(axis=0)], [int(v) for v in (_matrix(batch.column(0)) & ((1 << LIMB) - 1)).sum(axis=0)]
                part = [(h << LIMB) + low for h, low in zip(*part)]
                total = part if total is None else [a + b for a, b in zip(total, part)]
                count += batch.num_rows
        if total is not None:
            yield _emit({(-1, -1): count} | {(i, i): v for i, v in enumerate(total)})

    found = _summed(fit.select("vector").mapInArrow(run, SUMS))
    return found.get((-1, -1), 0), [found[i, i] for i in range(len(found) - 1)]


def squared_sums(fit: DataFrame, centre: list[int]) -> dict[tuple[int, int], int]:
    """Exact sums over all vectors of z_i^2 (key (i, i)) and of (z_i + z_j)^2 (key (i, j), i < j), z = x - centre."""
    middle = np.array(centre, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(middle)
        totals = [[0] * (d - i) for i in range(d)]
        for batch in batches:
            if not batch.num_rows:
                continue
            z = _matrix(batch.column(0)) - middle
            if np.abs(z).max() > SMALL:
                z = z.astype(object)
            columns = np.ascontiguousarray(z.T)
            for i in range(d):
                with_others = columns[i:] + columns[i]
                with_others[0] = columns[i]
                totals[i] = [a + int(b) for a, b in zip(totals[i], (with_others * with_others).sum(axis=1))]
        yield _emit({(i, i + k): v for i in range(d) for k, v in enumerate(totals[i])})

    return _summed(fit.select("vector").mapInArrow(run, SUMS))


@dataclass
class Whitening:
    """What `fit_whitening` finds: exact sums, then unit eigenvectors (columns) by falling eigenvalue."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def centre(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], dtype=np.int64)

    @property
    def rest(self) -> np.ndarray:
        """n times the distance of the mean from `centre`: 0 to n - 1."""
        return np.array([s % self.n for s in self.sums], dtype=np.int64)

    def project(self, z: np.ndarray) -> np.ndarray:
        """Whitened values of rows z = x - centre."""
        return (z.astype(np.float64) - self.rest / self.n) @ (self.vectors / np.sqrt(self.values))


def covariance(n: int, sums: list[int], squares: dict[tuple[int, int], int]) -> np.ndarray:
    """The covariance (divisor n) from the sums of `squared_sums`, by polarisation.

    With r = sum of z, n^2 times the variance of z is n * (sum of z^2) - r^2, in whole numbers; of the variances of
    z_i, z_j and z_i + z_j, half the difference is the covariance. Nothing is rounded before the last division.
    """
    d, rest = len(sums), [s % n for s in sums]
    own = [n * squares[i, i] - rest[i] ** 2 for i in range(d)]
    out = np.empty((d, d))
    for i in range(d):
        out[i, i] = float(Fraction(own[i], n * n))
        for j in range(i + 1, d):
            both = n * squares[i, j] - (rest[i] + rest[j]) ** 2
            out[i, j] = out[j, i] = float(Fraction(both - own[i] - own[j], 2 * n * n))
    return out


def _identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest entry of |covariance of the whitened fit list - identity|, measured in two passes over it."""
    k = model.vectors.shape[1]
    if not k:
        return 0.0

    def gram(mean: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k if mean is None else k * k)
            for batch in batches:
                if batch.num_rows:
                    y = model.project(_matrix(batch.column(0)) - model.centre)
                    total += y.sum(axis=0) if mean is None else ((y - mean).T @ (y - mean)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "s"])

        rows = fit.select("vector").mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
        out = np.zeros(k if mean is None else k * k)
        for r in rows:
            out[r["i"]] = r["s"] / model.n
        return out

    mean = gram(None)
    return float(np.abs(gram(mean).reshape(k, k) - np.eye(k)).max())


def fit_whitening(vectors: DataFrame, components: int = 16) -> Whitening | None:
    """The whitening of the distinct vectors of `integer_vectors`; None without any.

    Pass one sums each dimension, pass two sums the squares of every centred dimension and of every sum of two
    dimensions, each exactly. A task holds one such table (dimensions squared over two numbers) and hands it on once;
    the driver gets their totals, whose number follows the dimensions and not the vectors.
    """
    fit = write_table(vectors.select("vector").distinct(), "fit")
    with arrow_batches(fit.sparkSession, 4096):
        n, sums = dimension_sums(fit)
        if not n:
            return None
        matrix = covariance(n, sums, squared_sums(fit, [s // n for s in sums]))
        values, directions = np.linalg.eigh(matrix)
        trace = float(np.trace(matrix))
        order = np.argsort(-values)[:components]
        order = [i for i in order if trace > 0 and values[i] > EPS * trace]
        model = Whitening(n, sums, values[order], directions[:, order], values[order] / trace if trace else values[order], 0.0)
        model.identity_error = _identity_error(fit, model)
    return model


WHITENED = f"{FILE} string, {ROW} bigint, id {{id}}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """One row per row of `integer_vectors` and component: see `whitened_embeddings`."""
    k, kind = model.vectors.shape[1], vectors.schema["id"].dataType.simpleString()
    squares_of_rest = sum(int(r) ** 2 for r in model.rest)

    def deviations(z: np.ndarray) -> list[int]:
        wide = np.abs(z).max(initial=0) > SMALL or model.n > 1 << 32
        z = z.astype(object) if wide else z
        rest = model.rest.astype(object) if wide else model.rest
        n = model.n
        return [n * n * int(a) - 2 * n * int(b) + squares_of_rest for a, b in zip((z * z).sum(axis=1), (z * rest).sum(axis=1))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = _matrix(batch.column(3)) - model.centre if batch.num_rows else np.zeros((0, len(model.sums)), dtype=np.int64)
            m = len(z)
            each = pa.array(np.repeat(np.arange(m), k))
            deviation = pa.array([v if v < 10**38 else None for v in deviations(z)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c).take(each) for c in range(3)], pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                deviation.take(each), pa.array(model.project(z).ravel()), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, model.identity_error)),
            ], names=[*LOCATOR, "id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select(*LOCATOR, "id", "vector").mapInArrow(run, WHITENED.format(id=kind))


def whitened_embeddings(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16) -> DataFrame:
    """One row per usable row of `df` and component: locator, id, `component`, `n`, `deviation`, `whitened`, `explained`, `identity_error`.

    Vectors that are null, empty, hold null or non-finite components, or are not as long as most, take no part.
    Each other component c counts as x = floor(64 c) + 1000000 (64 c held within 2^52), and whitening is fitted to
    the distinct x vectors, each once. `deviation` is the exact sum over the dimensions of (n x - S)^2 (null beyond 38 digits), `whitened`
    the centred vector on the unit eigenvector over the root of its eigenvalue, `explained` the eigenvalue's share,
    `identity_error` the largest entry of the whitened fit list's covariance less the identity.

    Components without variance are left out, so equal vectors, a single one or an empty table give an empty
    result; repeated rows and null ids each give their rows; other columns are not read.
    """
    kind = df.schema[vector_col].dataType if vector_col in df.columns else None
    if not isinstance(kind, T.ArrayType):
        raise ValueError(f"{vector_col} must be an array of numbers")
    vectors = integer_vectors(source_rows(anchored(df), id=id_col, vector=vector_col))
    model = fit_whitening(vectors, components)
    if model is None:
        spark = df.sparkSession
        return spark.createDataFrame([], WHITENED.format(id=vectors.schema["id"].dataType.simpleString()))
    return whiten(vectors, model)
