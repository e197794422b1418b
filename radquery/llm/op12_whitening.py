"""Embedding whitening by matrix-free block subspace iteration.

Entries become whole numbers, floor(256 c). The fit list has each distinct vector once. Its covariance V is never formed: a
pass over the stored fit list gives Xᵀ(XQ) of centred rows for a block Q of a few columns. The driver makes the new block
orthonormal (QR) and solves the small problem in the space of the blocks so far (Rayleigh-Ritz). That ends when the residuals
Vu - eu of all wanted components are at rounding level. Beyond ``MOST_COLUMNS`` it goes on from the best directions.
What the driver holds follows the dimensions, never the rows.

Vectors that are null, or hold nulls or numbers that aren't finite, are dropped; so are those of another length than most (of
lengths equally frequent, the greater counts). Rows with equal ids, or none, all stay. Components without variance don't exist:
of a table of one distinct vector, or of none, nothing is returned. Numbers too large for exact sums are an error. Of further columns nothing is read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radquery.llm.shared import share, write_table
from radquery.llm.words import give_back

SCALE = 256
#: Columns of a block, and of the space of all blocks.
BLOCK, MOST_COLUMNS = 16, 256
#: Residuals relative to the greatest eigenvalue, and passes after which a residual above that is an error.
TOLERANCE, MOST_PASSES = 1e-13, 1000
SEED = 42
#: Entries that are turned into doubles at once.
AT_ONCE = 1 << 20
WHITENED = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


class Fit(NamedTuple):
    n: int
    sums: list[int]  # of each dimension
    largest: int  # entry, without its sign
    variances: np.ndarray  # of the components, falling
    vectors: np.ndarray  # dimensions x components, unit length
    trace: float  # of the covariance
    identity_error: float
    passes: int


def quantized(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and x, the whole numbers, of the rows that remain."""
    sound = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))  # NaN is greater than infinity
    x = F.transform(vector, lambda c: F.floor(SCALE * c.cast("double")).cast("long"))
    kept = rows.where(F.col(vector).isNotNull() & sound).select(F.col("vec_id").cast("long"), x.alias("x"))
    lengths = kept.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return kept.where(F.size("x") == (lengths["d"] if lengths else 0))


def _blocks(column: pa.ListArray, d: int):
    """Parts of a column of lists as rows x d whole numbers."""
    rows = max(1, AT_ONCE // max(d, 1))
    for at in range(0, len(column), rows):
        part = column.slice(at, rows)
        yield part.flatten().to_numpy().reshape(len(part), d)


def _summed(fit: DataFrame, partial, kind: str) -> np.ndarray:
    """Numbers that ``partial`` gives for each task, added place by place by Spark."""

    def run(batches):
        total = None
        for batch in batches:
            total = partial(batch.column(0), total)
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total)], names=["place", "value"])
        give_back()

    rows = fit.select("x").mapInArrow(run, f"place long, value {kind}").groupBy("place").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(rows), dtype=np.int64 if kind == "long" else np.float64)
    for r in rows:
        out[r["place"]] = r["value"]
    return out


def column_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows, and the sum of each dimension. Sums that don't fit 64 bits are an error."""

    def partial(column, total):
        for x in _blocks(column, d):
            if x.size and np.abs(x).max().astype(float) * (len(x) + 1) > 2.0**62:
                raise ValueError("entries too large for exact sums")
            here = np.concatenate(([len(x)], x.sum(0)))
            total = here if total is None else total + here
        return total

    found = _summed(fit, partial, "long").tolist()
    return (found[0], found[1:]) if found else (0, [])


def multiply(fit: DataFrame, n: int, mean: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, float]:
    """VQ and the trace of V, by one pass over the rows."""
    d, m = q.shape
    given = share(fit.sparkSession, (mean, q))

    def partial(column, total):
        mean, q = given.value
        total = np.zeros(d * m + 1) if total is None else total
        for x in _blocks(column, d):
            y = x - mean
            total[:-1] += (y.T @ (y @ q)).ravel()
            total[-1] += np.einsum("ij,ij->", y, y)
        return total

    found = _summed(fit, partial, "double") / n
    return found[:-1].reshape(d, m), float(found[-1])


def _fresh(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal base of what ``block`` adds to ``basis``; columns that add rounding errors alone are left out."""
    norm = np.linalg.norm(block, axis=0)
    block = block[:, norm > 0] / norm[norm > 0]
    for _ in range(2):  # twice is enough
        block = block - basis @ (basis.T @ block)
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    q = u[:, s > 1e-10]
    q, _ = np.linalg.qr(q - basis @ (basis.T @ q))
    return q


def learn(fit: DataFrame, d: int, k: int = 4, block: int = BLOCK, most: int = MOST_COLUMNS, seed: int = SEED) -> Fit | None:
    """The ``k`` components of greatest variance of the vectors ``x`` in a stored table; None without any variance."""
    n, sums = column_sums(fit, d)
    if not n or not d:
        return None
    largest = fit.select(F.max(F.greatest(F.abs(F.array_min("x")), F.abs(F.array_max("x")))).alias("m")).first()["m"] if d else 0
    mean = np.array([s / n for s in sums])  # division of whole numbers, rounded once
    new = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, min(d, max(block, k)))))[0]
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    for passes in range(1, MOST_PASSES + 1):  # noqa: B007
        product, trace = multiply(fit, n, mean, new)
        if not trace > 0:
            return None
        basis, image = np.hstack([basis, new]), np.hstack([image, product])
        small = basis.T @ image
        values, y = np.linalg.eigh((small + small.T) / 2)
        values, y = values[::-1], y[:, ::-1]
        ritz, ritz_image = basis @ y, image @ y
        residual = ritz_image - ritz * values
        if np.linalg.norm(residual[:, :k], axis=0).max() <= TOLERANCE * values[0]:
            break
        if basis.shape[1] + block > max(most, 2 * k + block):
            keep = max(2 * k, block)
            basis, image = ritz[:, :keep], ritz_image[:, :keep]
            residual = residual[:, :keep]
            new = _fresh(residual, basis)[:, :block]
        else:
            new = _fresh(product, basis)
        if not new.shape[1]:  # the space is closed under V
            break
    else:
        raise ValueError(f"residuals above {TOLERANCE} after {MOST_PASSES} passes")
    kept = values[:k] > 1e-12 * trace
    values, vectors = values[:k][kept], ritz[:, :k][:, kept]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(values))] < 0, -1, 1)
    whiten = vectors / np.sqrt(values)
    covariance = whiten.T @ multiply(fit, n, mean, whiten)[0]
    return Fit(n, sums, int(largest), values, vectors, trace, float(np.abs(covariance - np.eye(len(values))).max()), passes)


def whitened(rows: DataFrame, fit: Fit) -> DataFrame:
    """For each row of ``quantized`` and component: the centred vector's part along it over its deviation, and the figures of the fit."""
    n, d, k = fit.n, len(fit.sums), len(fit.variances)
    if n * fit.largest + max(map(abs, fit.sums)) >= 1 << 62:
        raise ValueError("entries too large for exact deviations")
    exact = d * (n * fit.largest + max(map(abs, fit.sums))) ** 2 < 1 << 63  # in 64 bits
    given = share(rows.sparkSession, fit)

    def run(batches):
        f = given.value
        sums, mean = np.array(f.sums, dtype=np.int64), np.array([s / n for s in f.sums])
        whiten, explained = f.vectors / np.sqrt(f.variances), f.variances / f.trace
        for batch in batches:
            at = 0
            for x in _blocks(batch.column(1), d):
                away = n * x - sums
                if exact:
                    deviation = pa.array(np.repeat((away * away).sum(1), k)).cast(pa.decimal128(38, 0))
                else:
                    deviation = pa.array(np.repeat((away.astype(object) ** 2).sum(1), k).tolist(), pa.decimal128(38, 0))
                ids = batch.column(0).slice(at, len(x)).take(pa.array(np.repeat(np.arange(len(x)), k)))
                at += len(x)
                each = [np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), np.full(len(x) * k, n), deviation, ((x - mean) @ whiten).ravel(), np.tile(explained, len(x)), np.full(len(x) * k, f.identity_error)]
                yield pa.record_batch([ids, *map(pa.array, each[:2]), deviation, *map(pa.array, each[3:])], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(run, WHITENED)


def whiten(rows: DataFrame, k: int = 4) -> DataFrame:
    x = quantized(rows)
    first = x.select(F.size("x").alias("d")).first()
    fit = learn(write_table(x.select("x").distinct(), "fit-list"), first["d"], k) if first else None
    return whitened(x, fit) if fit else rows.sparkSession.createDataFrame([], WHITENED)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn("deviation", F.col("deviation").cast("long"))
