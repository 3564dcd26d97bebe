"""Whitening of embeddings with MLlib's block matrices.

Centred rows are indexed and become blocks; a block matrix times its own transpose gives the scatter matrix, whose eigenvectors are
found on the driver (it is as large as the dimensions squared); the blocks times the whitening matrix give the projected rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import discard, shared_dir, staged


@dataclass(frozen=True)
class Config:
    """``components`` at most; components are computed on ``scale`` times each entry, rounded down; ``rows`` of a block.

    ``zero``: an eigenvalue below this part of the trace is zero in double precision, and has no component.
    """

    components: int = 4
    scale: int = 256
    rows: int = 1024
    zero: float = 1e-12


def usable(vector: str | Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return v.isNotNull() & F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def whole(vector: str | Column, scale: int) -> Column:
    """Each entry, as double, times the scale and rounded down, as long; beyond a long's range its last value."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long"))


def indexed(rows: DataFrame, name: str) -> DataFrame:
    """The rows, staged, with ``at`` from 0 on without gaps, by the counts of the partitions they were written from."""
    rows = staged(rows.withColumn("_id", F.monotonically_increasing_id()), name)
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    begins, at = [], 0
    for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():  # one row a partition
        begins.append((r["part"], at))
        at += r["n"]
    table = rows.sparkSession.createDataFrame(begins or [(0, 0)], "part long, begin long")
    out = rows.withColumn("part", part).join(F.broadcast(table), "part").withColumn("at", F.col("begin") + place).drop("_id", "part", "begin")
    out.staged_at = rows.staged_at
    return out


def blocks(rows: DataFrame, mean: np.ndarray, n: int, config: Config) -> BlockMatrix:
    """The centred vectors x of indexed rows as a block matrix, one block wide.

    Neighbours in a partition fill a block; at its edges blocks are filled up with zeros, and the two halves of one add up to the
    block in whatever the matrix is multiplied with. So rows are never shuffled to become blocks.
    """
    size, dims = config.rows, len(mean)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, None
        for batch in batches:
            at = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy().reshape(len(batch), dims) - mean
            cuts = np.flatnonzero(np.diff(at // size)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                if low == high:
                    continue
                if at[low] // size != block:
                    if held is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([held.ravel(order="F").tobytes()])], names=["block", "values"])
                    block, held = int(at[low] // size), np.zeros((size, dims))
                held[at[low:high] % size] = x[low:high]
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([held.ravel(order="F").tobytes()])], names=["block", "values"])

    table = rows.select("at", "x").mapInArrow(build, "block long, values binary")
    parts = table.rdd.map(lambda r: ((r["block"], 0), DenseMatrix(size, dims, np.frombuffer(r["values"]))))
    return BlockMatrix(parts, size, dims, -(-n // size) * size, dims)


def scatter(matrix: BlockMatrix, dims: int) -> np.ndarray:
    """The matrix's transpose times itself.

    MLlib would gather all blocks of one result block in a task; the middle dimension is split (an argument of the method that
    Python's form of it hides), so that a task multiplies about 16 blocks and adds them up before the shuffle. Blocks are kept
    on executors' disks for the four times that they are read, and computed again where an executor is lost.
    """
    matrix.persist(StorageLevel.DISK_ONLY)
    own = matrix._java_matrix_wrapper._java_model
    product = own.transpose().multiply(own, max(1, -(-matrix.numRowBlocks // 16)))
    try:
        return BlockMatrix(product, dims, dims).toLocalMatrix().toArray()
    finally:
        own.blocks().unpersist(False)


def whitened(embeddings: DataFrame, config: Config = Config()) -> DataFrame:
    """Per row and component: vec_id, component, n, deviation, whitened, explained and identity_error.

    Rows with a null vector, or one that holds null or non-finite entries, are dropped; the fit list is each distinct vector of
    the others once. Vectors shorter than the longest count as padded with zeros. Rows that repeat are rows of their own, a null
    vec_id passes through, and other columns play no part. Components with an eigenvalue of zero don't exist, so that a
    table with one distinct vector, or none, gives an empty result. A deviation beyond a long is null.
    """
    spark = embeddings.sparkSession
    shared_dir(spark)
    rows = embeddings.where(usable("embedding")).select(F.col("vec_id").cast("long"), whole("embedding", config.scale).alias("x"))
    dims = rows.agg(F.max(F.size("x"))).first()[0] or 0
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x")))
    rows = indexed(rows.select("vec_id", padded.alias("x")), "vectors")
    fit = indexed(rows.groupBy("x").agg(F.min("at").alias("first")), "fit-list")
    n, many = fit.count(), rows.count()
    sums = [r["s"] for r in fit.select(F.posexplode("x").alias("d", "x")).groupBy("d").agg(F.sum("x").alias("s")).orderBy("d").collect()]  # one row a dimension
    mean = np.array(sums, float) / max(n, 1)

    covariance = scatter(blocks(fit, mean, n, config), dims) / n if n and dims else np.zeros((0, 0))
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(values)[::-1][: config.components]
    trace = float(np.trace(covariance))
    order = [k for k in order if values[k] > config.zero * trace]
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not order:
        discard(rows, fit)
        return spark.createDataFrame([], schema)

    matrix = vectors[:, order] / np.sqrt(values[order])
    local = DenseMatrix(dims, len(order), matrix.ravel(order="F").tolist())
    whitening = BlockMatrix(spark.sparkContext.parallelize([((0, 0), local)], 1), dims, len(order))
    projected = blocks(rows, mean, many, config).multiply(whitening).toIndexedRowMatrix().rows
    projected = projected.map(lambda r: (int(r.index), r.vector.toArray().tolist())).toDF("at long, w array<double>")
    projected = staged(projected, "projected")

    chosen = projected.join(fit.select(F.col("first").alias("at")).hint("merge"), "at", "left_semi")
    ij = [(i, j) for i in range(len(order)) for j in range(i, len(order))]
    w = lambda k: F.get("w", F.lit(k))
    moments = chosen.agg(*(F.covar_pop(w(i), w(j)).alias(f"c{i}_{j}") for i, j in ij)).first()
    error = max(abs(moments[k] - (i == j)) for k, (i, j) in enumerate(ij))

    less = lambda a, s: F.try_subtract(F.try_multiply(F.lit(n).cast("long"), a), s)
    apart = F.zip_with("x", F.array(*(F.lit(s).cast("long") for s in sums)), less)
    deviation = F.aggregate(apart, F.lit(0).cast("long"), lambda total, d: F.try_add(total, F.try_multiply(d, d)))
    each = F.array(*(F.struct(F.lit(k + 1).alias("component"), w(k).alias("whitened"), F.lit(float(values[order[k]] / trace)).alias("explained")) for k in range(len(order))))
    met = rows.select("at", "vec_id", deviation.alias("deviation")).join(projected.hint("merge"), "at")
    out = met.select("vec_id", "deviation", F.inline(each)).select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(float(error)).alias("identity_error"))
    out = staged(out, "whitened")
    discard(rows, fit, projected)
    return out
