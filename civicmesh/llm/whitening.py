"""Embedding whitening (13): components from the exact characteristic polynomial of the integer scatter.

Each entry c becomes the integer x = floor(scale * c) + offset. With n vectors and sums S, the scatter n sum(x x') - S S'
is an integer matrix, n * n times the covariance. Its polynomial comes from Hessenberg reduction modulo many primes, a
Spark row for each, and Chinese remaindering; Descartes' sign changes, exact where all roots are real, isolate the
largest roots; inverse iteration on the null space, a Spark row for each root, gives the components
(``exact_spectrum``). The cost of these grows with the dimension alone. Rows are only ever added up or projected.

Shifting by the offset changes no scatter, so sums are of y = floor(scale * c), and exact whatever their size.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exact_spectrum as spectrum

#: Rows of a block, and bits of the lower part in which exact sums travel.
BLOCK, LOW_BITS = 2048, 40
#: Entries of this size and more have no integer in a long.
LARGEST = float(1 << 56)


def usable(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id and v (array of doubles) of the rows whose vector is there and has only finite entries below LARGEST."""
    v = F.col("v")
    rows = df.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("v"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    return rows.where(v.isNotNull() & (F.size(v) > 0)).where(fine)


def _blocks(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """ids and y of at most BLOCK rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            c = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            yield part.column(0), np.floor(scale * c).astype(np.int64)


def _products(y: np.ndarray) -> np.ndarray:
    """The exact sum of y y' over rows, as Python integers."""
    if float(np.abs(y).max()) ** 2 * len(y) < 2.0**53:
        z = y.astype(float)  # all sums are whole numbers below 2 ** 53
        return (z.T @ z).astype(np.int64).astype(object)
    z = y.astype(object)
    return z.T @ z


def moments(rows: DataFrame, d: int, scale: int) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums of y and of y y', exact; d * (d + 3) / 2 + 1 numbers leave each task and reach the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a leading one gives the number of rows and the sums together with the products
        total = np.zeros((d + 1, d + 1), dtype=object)
        for _, y in _blocks(batches, scale):
            total = total + _products(np.concatenate([np.ones((len(y), 1), dtype=np.int64), y], axis=1))
        a, b = np.triu_indices(d + 1)
        values = [int(v) for v in total[a, b]]
        high = pa.array([Decimal(v >> LOW_BITS) for v in values], pa.decimal128(38, 0))
        low = pa.array([v & ((1 << LOW_BITS) - 1) for v in values], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), high, low], names=["a", "b", "high", "low"])

    parts = rows.mapInArrow(partial, "a int, b int, high decimal(38,0), low long")
    out = [[0] * (d + 1) for _ in range(d + 1)]
    for r in parts.groupBy("a", "b").agg(F.sum("high").alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).collect():
        out[r["a"]][r["b"]] = out[r["b"]][r["a"]] = (int(r["high"]) << LOW_BITS) + int(r["low"])
    return out[0][0], out[0][1:], [row[1:] for row in out[1:]]


def polynomial(spark, matrix: list[list[int]]) -> list[int]:
    """The characteristic polynomial of an integer matrix without negative roots, a Spark row for each prime."""
    primes = spectrum.primes_over(2 * spectrum.coefficient_bound(matrix))

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([spectrum.polynomial_mod(matrix, primes[i]) for i in at])], names=["i", "c"])

    tasks = min(len(primes), 2 * spark.sparkContext.defaultParallelism)
    found = {r["i"]: r["c"] for r in spark.range(0, len(primes), 1, tasks).mapInArrow(residues, "i long, c array<long>").collect()}
    return spectrum.remaindered([found[i] for i in range(len(primes))], primes)


def components(spark, matrix: list[list[int]], most: int) -> list[tuple[int, float, float, list[float]]]:
    """number, root, its share of the trace and unit vector of the largest components with a root over zero, a Spark
    row for each different root."""
    roots, q = spectrum.isolated(polynomial(spark, matrix), most)
    trace = sum(matrix[i][i] for i in range(len(matrix)))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(spectrum.components(matrix, q, roots, iter(batch.column(0).to_pylist()), most))
            columns = [[c for c, _, _ in got], [float(e) for _, e, _ in got], [float(e / trace) for _, e, _ in got], [v for _, _, v in got]]
            types = [pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["c", "e", "share", "v"])

    out = spark.range(0, len(roots), 1, max(1, len(roots))).mapInArrow(vectors, "c int, e double, share double, v array<double>").collect()
    return sorted((r["c"], r["e"], r["share"], r["v"]) for r in out)


def _centred(y: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * y - S, exact."""
    if float(np.abs(y).max(initial=0)) * n + max((abs(int(s)) for s in sums), default=0) < 2.0**62:
        return n * y - sums.astype(np.int64)
    return n * y.astype(object) - sums


def _deviations(z: np.ndarray) -> pa.Array:
    """Sums of squares over dimensions; null beyond 38 digits."""
    if z.dtype != object and float(np.abs(z).max(initial=0)) ** 2 * z.shape[1] < 2.0**62:
        return pa.array((z * z).sum(1)).cast(pa.decimal128(38, 0))
    sums = [int(s) for s in (z.astype(object) ** 2).sum(1)]
    return pa.array([Decimal(s) if s < 10**38 else None for s in sums], pa.decimal128(38, 0))


def whitened(df: DataFrame, most: int = 32, scale: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, component (from 1, by falling variance), n, deviation (decimal: sum over dimensions of (n x - S)^2),
    whitened, explained and identity_error for each vector and each of the ``most`` largest components.

    Rows without a vector, with an empty one or with null, non-finite or too large entries (LARGEST) take no part.
    Neither do vectors of another length than most have (ties: the longer). Directions without variance are no
    components, so a table without two different vectors gives no rows. Repeated ids and null ids count row by row.
    Equal variances: any orthonormal vectors of their space, the same for all rows."""
    spark = df.sparkSession
    fine = usable(df, vec_id, embedding)
    lengths = fine.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = lengths[0]["d"] if lengths else 0
    id_type = fine.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not d:
        return spark.createDataFrame([], schema)
    rows = fine.where(F.size("v") == d)
    n, sums, products = moments(rows, d, scale)
    scatter = [[n * products[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    found = components(spark, scatter, most) if any(scatter[i][i] for i in range(d)) else []
    if not found:
        return spark.createDataFrame([], schema)
    k = len(found)
    s = np.array(sums, dtype=object)
    shares = np.array([share for _, _, share, _ in found])
    # of z = n (x - S / n), over the root of e = root / n^2: the factors n cancel
    axes = np.array([np.array(v) / e**0.5 for _, e, _, v in found]).T

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for _, y in _blocks(batches, scale):
            w = np.concatenate([np.ones((len(y), 1)), _centred(y, n, s).astype(float) @ axes], axis=1)
            total += w.T @ w
        a, b = np.triu_indices(k + 1)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(total[a, b])], names=["a", "b", "s"])

    measured = {(r["a"], r["b"]): r["s"] / n for r in rows.mapInArrow(partial, "a int, b int, s double").groupBy("a", "b").agg(F.sum("s").alias("s")).collect()}
    error = max(abs(measured[a, b] - measured[0, a] * measured[0, b] - (a == b)) for a, b in measured if a)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, y in _blocks(batches, scale):
            z = _centred(y, n, s)
            at = pa.array(np.repeat(np.arange(len(y)), k))
            count = len(y) * k
            columns = [
                ids.take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))), pa.array(np.full(count, n, dtype=np.int64)),
                _deviations(z).take(at), pa.array((z.astype(float) @ axes).ravel()), pa.array(np.tile(shares, len(y))), pa.array(np.full(count, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(projected, schema)
