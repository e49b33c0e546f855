"""Embedding whitening over an exact integer scatter made of bit planes.

Entries become integers. Per dimension the fit list's least value is taken off, so that what is
left fits in few bits; each task packs every bit of every dimension, across 4,096 rows at a time,
into 64-bit words. The cross-product of two dimensions is the sum over pairs of their planes of
2^(a+b) times the number of ones in the AND of both planes: popcounts, no rounding. The partial
products of the tasks are added as decimals in Spark, and n * scatter - sums * sums is still an
integer; only then come the division and ``eigh`` of the small matrix. The fit has a row per
task and pair of dimensions; the driver holds the d x d matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billwright.session import delete_folder, shared_folder, stored

SCALE = 1024
OFFSET = 100_000
COMPONENTS = 8
#: Rows packed at once: 64 words a plane.
BLOCK = 4096
#: Entries of integers beyond this are treated like infinite ones: squares, summed, must stay
#: below 10^38.
LARGEST = 1 << 45
#: Components of less than this share of the largest variance count as constant.
LEAST_SHARE = 1e-12


@dataclass(frozen=True)
class Whitening:
    """The fit: rows, sums, covariance parts and components, with Python's exact integers."""

    n: int
    low: list[int]
    sums: list[int]
    vectors: np.ndarray  # a column per component
    variances: np.ndarray
    trace: float


def integers(vector: Column) -> Column:
    """floor(1024 * c) + 100000 of every entry, as longs."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(OFFSET).cast("long"))


def usable(vector: Column) -> Column:
    """True for vectors without null, infinite, NaN or huge entries; empty vectors have none."""
    sound = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) * SCALE < LARGEST, F.lit(False)))
    return F.coalesce(sound, F.lit(False)) & (F.size(vector) > 0)


def integer_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, x) of the usable rows of the commonest length (ties: the longer)."""
    kept = rows.filter(usable(F.col(vector)))
    length = (
        kept.groupBy(F.size(vector).alias("d"))
        .count()
        .agg(F.max(F.struct("count", "d")).alias("most"))
        .first()["most"]
    )
    kept = kept.filter(F.size(vector) == (length["d"] if length else 0))
    return kept.select(F.col(key).alias("vec_id"), integers(F.col(vector)).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def plane_levels(shifted: np.ndarray, bits: int) -> np.ndarray:
    """Ones common to two planes, by the planes' joint weight: (2 * bits - 1, d, d), upper half.

    ``shifted`` holds non-negative integers of at most ``bits`` bits, a row per vector.
    """
    n, d = shifted.shape
    padded = np.zeros((-(-n // 64) * 64, d), np.int64)
    padded[:n] = shifted
    planes = np.empty((d * bits, len(padded) // 64), np.uint64)
    for a in range(bits):
        ones = np.ascontiguousarray(((padded >> a) & 1).astype(np.uint8).T)
        planes[a::bits] = np.packbits(ones, axis=1).view(np.uint64)
    levels = np.zeros((2 * bits - 1, d, d), np.int64)
    for at in np.nonzero(planes.any(axis=1))[0].tolist():
        i, a = divmod(at, bits)
        both = planes[i * bits :] & planes[at]
        counts = np.bitwise_count(both).sum(axis=1, dtype=np.int64)
        levels[a : a + bits, i, i:] += counts.reshape(-1, bits).T
    return levels


def weighted(levels: np.ndarray) -> list[list[int]]:
    """Exact cross-products of the dimensions from the levels' counts (upper half)."""
    d, lists = levels.shape[1], levels.tolist()
    return [
        [sum(level[i][j] << s for s, level in enumerate(lists)) if j >= i else 0 for j in range(d)]
        for i in range(d)
    ]


def _scatter(vectors: DataFrame, low: list[int], bits: int) -> DataFrame:
    """(i, j, cross): one row per pair of dimensions of the shifted vectors' cross-products."""
    d, shift = len(low), np.array(low, np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2 * bits - 1, d, d), np.int64)
        for batch in batches:
            x = _matrix(batch.column("x"), d) - shift
            for start in range(0, len(x), BLOCK):
                total += plane_levels(x[start : start + BLOCK], bits)
        cross = weighted(total)
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        values = [Decimal(cross[i][j]) for i, j in pairs]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([i for i, _ in pairs], pa.int32()),
                pa.array([j for _, j in pairs], pa.int32()),
                pa.array(values, pa.decimal128(38, 0)),
            ],
            names=["i", "j", "cross"],
        )

    parts = vectors.select("x").mapInArrow(count, "i int, j int, cross decimal(38,0)")
    return parts.groupBy("i", "j").agg(F.sum("cross").alias("cross"))


def fitted(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a table of integer vectors (column ``x``); None for an empty one."""
    x = F.col("value")
    sides = (
        vectors.select(F.posexplode("x").alias("i", "value"))
        .groupBy("i")
        .agg(
            F.count("*").alias("n"),
            F.min(x).alias("low"),
            F.max(x).alias("high"),
            F.sum(x.cast("decimal(20,0)")).alias("sum"),
        )
        .orderBy("i")
        .collect()
    )
    if not sides:
        return None
    n, low = sides[0]["n"], [r["low"] for r in sides]
    sums = [int(r["sum"]) for r in sides]
    bits = max(1, max((r["high"] - r["low"]).bit_length() for r in sides))
    d = len(low)
    cross = {(r["i"], r["j"]): int(r["cross"]) for r in _scatter(vectors, low, bits).collect()}
    shifted = [s - n * least for s, least in zip(sums, low, strict=True)]
    covariance = np.empty((d, d))
    for (i, j), value in cross.items():  # whole numbers up to the one division
        covariance[i, j] = covariance[j, i] = (n * value - shifted[i] * shifted[j]) / (n * n)
    values, columns = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    trace = sum(n * cross[i, i] - shifted[i] ** 2 for i in range(d)) / (n * n)
    return Whitening(n, low, sums, columns[:, order], values[order], trace)


def _projected(vectors: DataFrame, fit: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened): the coordinates of all components as one array."""
    d, n = len(fit.low), fit.n
    shift = np.array(fit.low, np.int64)
    offsets = [s - n * least for s, least in zip(fit.sums, fit.low, strict=True)]
    means = np.array([o / n for o in offsets])
    exact_offsets = np.array(offsets, object)
    sound = fit.variances > LEAST_SHARE * max(float(fit.variances[0]), 0.0)
    scale = np.where(sound, 1 / np.sqrt(np.where(sound, fit.variances, 1.0)), np.nan)
    columns = fit.vectors * scale
    k = columns.shape[1]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), d) - shift
            apart = ((x.astype(object) * n - exact_offsets) ** 2).sum(axis=1)
            whitened = (x - means) @ columns
            flat = pa.array(whitened.ravel(), from_pandas=True)  # NaN: null
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    pa.array([str(a) for a in apart], pa.string()),
                    pa.FixedSizeListArray.from_arrays(flat, k).cast(pa.list_(pa.float64())),
                ],
                names=["vec_id", "deviation", "whitened"],
            )

    key = vectors.schema["vec_id"].dataType.simpleString()
    made = vectors.mapInArrow(
        project, f"vec_id {key}, deviation string, whitened array<double>"
    )
    return made


def identity_error(whitened: DataFrame, components: int) -> float | None:
    """Largest absolute entry of the whitened coordinates' covariance minus the identity.

    Two passes: means first, then products of what is centred. Constant components, which
    cannot be whitened, are left out; None without any other.
    """
    column = [F.get("whitened", F.lit(k)) for k in range(components)]
    means = whitened.agg(*(F.avg(c).alias(f"m{k}") for k, c in enumerate(column))).first()
    held = [k for k in range(components) if means[k] is not None]
    if not held:
        return None
    centred = {k: column[k] - F.lit(means[k]) for k in held}
    pairs = [(a, b) for a in held for b in held if a <= b]
    entries = whitened.agg(*(F.avg(centred[a] * centred[b]).alias(f"c{a}_{b}") for a, b in pairs)).first()
    return max(abs(value - (a == b)) for (a, b), value in zip(pairs, entries, strict=True))


def whitened(
    rows: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    components: int = COMPONENTS,
) -> DataFrame:
    """One row per usable row of ``rows`` and component, numbered from 1 by falling variance.

    Columns: vec_id, component, n (rows of the fit), deviation (exact sum over dimensions of
    (n * x - sums)^2, a string of digits, since it outgrows 64 bits), whitened, explained
    (share of the total variance), identity_error (of the whole result).

    Rows whose vector is null, empty, of another than the commonest length, or holds null,
    NaN, infinite or huge entries are left out. Repeated rows count as often as they stand.
    Components without variance get a null ``whitened`` and explain 0 (all of them, if all
    rows are equal); an empty table gives an empty one. Other columns don't matter.
    """
    spark = rows.sparkSession
    folder = shared_folder(spark, "integer-vectors")
    vectors = stored(integer_vectors(rows, key, vector), "integer-vectors", folder)
    fit = fitted(vectors, components)
    schema = (
        f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, component int, n long, "
        "deviation string, whitened double, explained double, identity_error double"
    )
    if fit is None:
        return spark.createDataFrame([], schema)
    made = stored(_projected(vectors, fit), "whitened")
    delete_folder(spark, folder)
    k = len(fit.variances)
    error = identity_error(made, k)
    sound = fit.trace > 0
    shares = [max(float(v), 0.0) / fit.trace if sound else 0.0 for v in fit.variances]
    explained = F.array(*(F.lit(s) for s in shares))
    return made.select(
        "vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")
    ).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(fit.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
