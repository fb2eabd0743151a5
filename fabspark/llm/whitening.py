"""Whitening of embeddings by an exact eigendecomposition of their integer scatter.

An entry c becomes the long x = floor(64 c) + 1000000. Sums and products of all x are added up exactly (as
integers, whatever the order), so n * sum(x x') - S S' is the exact scatter, n^2 times the covariance V. Its
eigenvalues and vectors come from ``exact_eigen``: the polynomial modulo each prime, and the vector of
each eigenvalue, are tasks of their own. Only numbers whose count depends on the dimension alone (at most
``MAX_DIM``) reach the driver. Rows are read three times and never shuffled.

Defined cases: rows whose vector is null or holds a null or a non-finite entry are dropped; every
other row counts, repeated ones too; entries whose 64 c passes 2^62 count as 2^62 (with their sign); equal eigenvalues get
orthonormal vectors of their space; components of eigenvalue zero (constant dimensions, fewer rows than
dimensions) do not exist, so identical rows, one row or an empty table give no rows; a null vec_id is kept; vectors of
different lengths are an error; ``deviation`` is null beyond 38 digits; extra columns are ignored.
"""
from __future__ import annotations

import itertools
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import exact_eigen
from .textkit import small_batches

MAX_DIM = 512
OFFSET = 1_000_000
_LIMB = 20                                    # products of limbs, and 4096 of them added up, are exact in a double
_ROWS = 4096
_PRIMES = 16                                  # of one task


def finite_rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    whole = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.select(F.col(id_col).alias("vec_id"), v.alias("v")).where(v.isNotNull() & whole)


def _entries(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """x - OFFSET of the batch's rows, as longs."""
    column = batch.column("v")
    sizes = np.unique(np.diff(np.asarray(column.offsets)))
    if len(sizes) > 1:
        raise ValueError(f"vectors of {sizes[0]} and of {sizes[-1]} entries")
    if sizes[0] > MAX_DIM:
        raise ValueError(f"vectors of {sizes[0]} entries; at most {MAX_DIM}")
    flat = np.clip(np.floor(64.0 * np.asarray(column.flatten())), -2.0 ** 62, 2.0 ** 62).astype(np.int64)
    rows = flat.reshape(batch.num_rows, -1)
    for at in range(0, len(rows), _ROWS):
        yield rows[at:at + _ROWS]


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """x in parts of 20 bits, lowest first; the last one has the sign. A column of ones is the last dimension."""
    x, out = np.hstack([x, np.ones((len(x), 1), np.int64)]), []
    while np.abs(x).max(initial=0) >= 1 << _LIMB:
        out.append((x & ((1 << _LIMB) - 1)).astype(np.float64))
        x = x >> _LIMB
    return [*out, x.astype(np.float64)]


def _scatter_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows to the task's sums of products, upper triangle, by power of 2^20."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for x in _entries(batch) if batch.num_rows else ():
            for (p, a), (q, b) in itertools.product(enumerate(_limbs(x)), repeat=2):
                part = (a.T @ b).astype(np.int64).astype(object)
                if p + q in sums and sums[p + q].shape != part.shape:
                    raise ValueError(f"vectors of {len(sums[p + q]) - 1} and of {len(part) - 1} entries")
                sums[p + q] = sums.get(p + q, 0) + part
    for power, part in sums.items():
        i, j = np.triu_indices(len(part))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(i), len(part) - 1)), pa.array(np.full(len(i), power)), pa.array(i), pa.array(j),
             pa.array([Decimal(int(x)) for x in part[i, j]], pa.decimal128(38, 0))], names=["d", "power", "i", "j", "total"])


class Scatter:
    """n, sums and the exact scatter of the rows, all of x - OFFSET (which the scatter does not see)."""

    def __init__(self, rows: DataFrame):
        parts = rows.mapInArrow(_scatter_parts, "d bigint, power bigint, i bigint, j bigint, total decimal(38,0)")
        totals = parts.groupBy("power", "i", "j").agg(F.sum("total").alias("total"), F.min("d").alias("least"), F.max("d").alias("most")).collect()
        self.n, self.sums, self.matrix = 0, [], []
        if not totals:
            return
        least, d = min(r["least"] for r in totals), max(r["most"] for r in totals)
        if least < d:
            raise ValueError(f"vectors of {least} and of {d} entries")
        q = [[0] * (d + 1) for _ in range(d + 1)]
        for r in totals:
            q[r["i"]][r["j"]] += int(r["total"]) << _LIMB * r["power"]
        self.n, self.sums = q[d][d], [q[i][d] for i in range(d)]
        self.matrix = [[self.n * q[min(i, j)][max(i, j)] - self.sums[i] * self.sums[j] for j in range(d)] for i in range(d)]


def principal(spark: SparkSession, matrix: list[list[int]], most: int) -> tuple[list[Fraction], np.ndarray]:
    """The largest positive eigenvalues, falling, and their unit vectors (rows)."""
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    if not trace:
        return [], np.empty((0, len(matrix)))
    moduli = exact_eigen.primes_for(matrix)
    chunks = [moduli[i:i + _PRIMES] for i in range(0, len(moduli), _PRIMES)]

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in (c.as_py() for b in batches for c in b.column("id")):
            rows = exact_eigen.polynomials(matrix, chunks[c])
            yield pa.RecordBatch.from_arrays([pa.array(chunks[c], pa.int64()), pa.array(rows.tolist(), pa.list_(pa.int64()))], names=["p", "poly"])
    found = {r["p"]: r["poly"] for r in spark.range(0, len(chunks), 1, len(chunks)).mapInArrow(residues, "p bigint, poly array<bigint>").collect()}
    poly, bits = exact_eigen.remainder([found[p] for p in moduli], moduli), exact_eigen.fraction_bits(trace)
    places = exact_eigen.isolate(poly, trace, most)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in (c.as_py() for b in batches for c in b.column("id")):
            m, e, inside = places[c]
            root = exact_eigen.refine(poly, m, e, inside, bits)
            rows = exact_eigen.null_vectors(matrix, root, bits, inside)
            yield pa.RecordBatch.from_arrays([pa.array([c] * inside), pa.array(range(inside)), pa.array([str(root)] * inside), pa.array(rows.tolist())],
                                             names=["place", "nth", "root", "vector"])
    rows = spark.range(0, len(places), 1, len(places)).mapInArrow(vectors, "place bigint, nth bigint, root string, vector array<double>").collect()
    rows = sorted(rows, key=lambda r: (r["place"], r["nth"]))[:most]
    return [Fraction(int(r["root"]), 1 << bits) for r in rows], np.array([r["vector"] for r in rows])


def _whitened(fit: Scatter, axes: np.ndarray, scale: np.ndarray):
    """Batches to (ids, exact n x - S, whitened rows)."""
    n, sums = fit.n, fit.sums
    largest = max(map(abs, sums), default=0)

    def of(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        at = 0
        for x in _entries(batch):
            fits = n * int(np.abs(x).max(initial=0)) + largest < 1 << 62
            off = x * n - np.array(sums, dtype=np.int64) if fits else x.astype(object) * n - np.array(sums, dtype=object)
            centred = off / n if fits else (off / n).astype(np.float64)
            yield batch.column("vec_id").slice(at, len(x)), off, centred @ axes.T * scale
            at += len(x)
    return of


def _squares(off: np.ndarray) -> list[Decimal | None]:
    largest = int(np.abs(off).max(initial=0))
    if off.shape[1] * largest * largest < 1 << 63:
        return [Decimal(int(s)) for s in (off * off).sum(axis=1)]
    exact = (off.astype(object) ** 2).sum(axis=1)
    return [Decimal(int(s)) if s < 10 ** 38 else None for s in exact]


def whiten(vectors: DataFrame, most: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row and component: vec_id, component (from 1), n, deviation (decimal), whitened, explained, identity_error."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = finite_rows(vectors, id_col, vector_col)
    fit = Scatter(rows)
    values, axes = principal(spark, fit.matrix, most)
    k, trace = len(values), sum(fit.matrix[i][i] for i in range(len(fit.matrix)))
    scale = np.array([1 / sqrt(v / fit.n ** 2) for v in values])
    of = _whitened(fit, axes, scale)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))                          # rows are centred already; the last line is their sum
        for batch in batches:
            for _, _, w in of(batch) if batch.num_rows else ():
                total += np.vstack([w.T @ w, w.sum(axis=0)])
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "total"])

    error = 0.0
    if k:
        cov = np.zeros((k + 1, k))
        for r in rows.mapInArrow(products, "i bigint, j bigint, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
            cov[r["i"], r["j"]] = r["total"] / fit.n
        error = float(np.abs(cov[:k] - np.outer(cov[k], cov[k]) - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, off, w in of(batch) if batch.num_rows else ():
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(_squares(off), pa.decimal128(38, 0)), pa.array(list(w), pa.list_(pa.float64()))],
                    names=["vec_id", "deviation", "w"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    out = (rows if k else rows.limit(0)).mapInArrow(project, f"vec_id {kind}, deviation decimal(38,0), w array<double>")
    share = F.array(*[F.lit(float(v / trace)) for v in values]) if k else F.array().cast("array<double>")
    return out.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
