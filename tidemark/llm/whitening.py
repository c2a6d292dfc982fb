"""Embedding whitening with MLlib's block matrices.

Vectors become integers, x = floor(256 c). The distinct x are indexed, centred and dealt into a
``BlockMatrix``; its transpose times itself is the scatter matrix, which is decomposed on the driver (a
square of the dimension, whatever the number of rows). The whitening matrix, a few eigenvectors over
the roots of their eigenvalues, is a block matrix too, and its product with all centred rows is the result.
The first product is split along the rows, so that no task sums more than ``_BLOCKS`` row blocks.

Defined cases: rows whose vector is null or holds a null, a NaN or an infinity are left out; vectors
shorter than the longest are filled up with zeros; repeated rows give equal rows, and count once for
the covariance; a component without variance has whitened 0 and explained 0, and doesn't count for the
identity error; a deviation beyond 64 bits is null; components beyond 64 bits raise; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stash

SCALE = 256
_ROWS, _COLUMNS = 2048, 1024  # of a block
_BLOCKS = 16  # row blocks that one task multiplies and sums


def usable(vector: str) -> Column:
    """True where a vector is there and all its entries are finite numbers."""
    return F.coalesce(F.forall(F.col(vector).cast("array<double>"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False))


def as_integers(vector: str) -> Column:
    return F.transform(F.col(vector).cast("array<double>"), lambda v: F.floor(v * SCALE).cast("long"))


def indexed(rows: DataFrame, name: str) -> DataFrame:
    """rows, written, with a dense index from 0: the rows of the partitions before, and the place in the partition."""
    at = F.monotonically_increasing_id()
    rows = stash(rows.withColumns({"_part": F.shiftright(at, 33), "_at": at.bitwiseAND((1 << 33) - 1)}), name)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(starts, "_part").withColumn("index", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def block_matrix(rows: DataFrame, centred: Column, n: int, d: int) -> BlockMatrix:
    """The centred rows at their index."""
    vectors = rows.select("index", array_to_vector(centred).alias("vector"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), n, d).toBlockMatrix(_ROWS, min(d, _COLUMNS))


def squared(m: BlockMatrix) -> np.ndarray:
    """The matrix's transpose times the matrix. Scala's product can split the middle dimension, Python's has no such argument."""
    splits = -(-m.numRowBlocks // _BLOCKS)
    product = m.transpose()._java_matrix_wrapper.call("multiply", m._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, m.colsPerBlock, m.colsPerBlock).toLocalMatrix().toArray()


def local_blocks(spark: SparkSession, w: np.ndarray) -> BlockMatrix:
    d, k = w.shape
    step = min(d, _COLUMNS)
    parts = [((i // step, 0), Matrices.dense(len(w[i : i + step]), k, w[i : i + step].ravel(order="F").tolist())) for i in range(0, d, step)]
    return BlockMatrix(spark.sparkContext.parallelize(parts, 1), step, k, d, k)


def components(scatter: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Whitening matrix and explained shares, largest eigenvalue first; the largest entry of each eigenvector is positive."""
    covariance = (scatter + scatter.T) / (2 * n)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:most]
    values, vectors, trace = values[order], vectors[:, order], float(np.trace(covariance))
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(order))] < 0, -1, 1)
    there = values > max(trace, 0) * len(covariance) * np.finfo(float).eps
    return np.where(there, vectors / np.sqrt(np.where(there, values, 1)), 0), np.where(there, values / (trace or 1), 0)


def whiten(vectors: DataFrame, most: int = 4, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    rows = vectors.filter(usable(vector)).select(F.col(key).alias("vec_id"), as_integers(vector).alias("x"))
    rows = indexed(rows, "whitening-rows")
    d = rows.agg(F.max(F.size("x"))).first()[0] or 0
    rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("x"))))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not d:
        return spark.createDataFrame([], schema)
    fit = indexed(rows.select("x").distinct(), "whitening-fit")
    n, total, least, largest = fit.agg(F.count("*"), F.array(*[F.sum(F.get("x", i)) for i in range(d)]), F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    mean = F.array(*[F.lit(s / n) for s in total])
    centred = F.zip_with("x", mean, lambda x, m: x.cast("double") - m)
    m = block_matrix(fit, centred, n, d)
    w, explained = components(squared(m), n, most)
    projector = local_blocks(spark, w)
    of_fit = squared(m.multiply(projector)) / n
    error = float(np.abs(of_fit - np.diag((explained > 0).astype(float))).max())
    whitened = block_matrix(rows, centred, rows.count(), d).multiply(projector).toIndexedRowMatrix().rows
    whitened = spark.createDataFrame(whitened.map(lambda r: (r.index, r.vector.toArray().tolist())), "index long, w array<double>")
    # n * x - S and its square summed, in longs where no sum can overflow, else in decimals.
    small = d * (2 * n * max(-least, largest, 1)) ** 2 < 1 << 63
    kind = "long" if small else "decimal(38,0)"
    apart = F.zip_with("x", F.array(*[F.lit(str(s)).cast(kind) for s in total]), lambda x, s: x.cast(kind) * F.lit(n).cast("long" if small else "decimal(19,0)") - s)
    squares = F.aggregate(apart, F.lit(0).cast(kind), lambda a, v: (a + v * v).cast(kind))
    out = rows.select("index", "vec_id", squares.try_cast("long").alias("deviation")).join(whitened, "index")
    out = out.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", F.posexplode("w").alias("at", "whitened"))
    shares = F.array(*[F.lit(float(e)) for e in explained])
    return out.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


def op12_blockmatrix_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op12_blockmatrix_whitening": op12_blockmatrix_whitening}
SQL: dict[str, str] = {}
