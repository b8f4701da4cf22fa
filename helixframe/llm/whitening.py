"""Whitening of embeddings by principal components, over MLlib's distributed block matrices.

Vectors are put on a grid of 1/256 (x = floor(256 c), whole numbers), so that sums are exact whatever the order of the
rows. Each distinct x counts once in the fit. Its centred rows are indexed and cut into distributed blocks; the product
of the transposed and the plain block matrix is the scatter, of dimension by dimension; its eigenvectors are taken on
the driver; a block product with the whitening matrix projects all rows. The scatter's product is split over the rows'
blocks and then summed, so that no task sees all of them.

Defined results: a row is dropped if its vector is null or holds a null, NaN or infinite entry. A vector shorter than
the longest counts as padded with zeros. Rows with equal vectors, also under one id, are each projected; the id may be
null. A component without variance (under 1e-12 of the first one's) is left out, so that one distinct vector, or an
empty table, gives no rows. A component's sign makes its largest entry, the first of such, positive. `deviation` is
null where it does not fit in a long. Other columns of the input play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.linalg import DenseMatrix, VectorUDT
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import LongType, StructField, StructType

from .common import materialize, table

GRID, COMPONENTS = 256, 4
#: Rows of one block, fewer where vectors are long: a block holds up to 4 MB.
BLOCK_ROWS, BLOCK_ENTRIES = 4096, 1 << 19
NO_VARIANCE = 1e-12


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors and their sums; eigenvalues and components (a row each) of the grid's covariance; its trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def matrix(self) -> np.ndarray:
        return (self.components / np.sqrt(self.values)[:, None]).T


def on_grid(vectors: DataFrame, vector_col: str, keep: list[Column]) -> DataFrame:
    """(keep, x): rows with usable vectors, x an array of longs."""
    v = F.col(vector_col)
    usable = v.isNotNull() & F.coalesce(~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(False))
    return vectors.where(usable).select(*keep, F.transform(v, lambda c: F.floor(c.cast("double") * GRID)).alias("x"))


def indexed(rows: DataFrame) -> DataFrame:
    """rows, written, with a dense number `index` from 0."""
    rows = materialize(rows.withColumn("mid", F.monotonically_increasing_id()))
    part = F.shiftright("mid", 33)
    # A row for each task that wrote rows.
    base = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("mid").alias("first"))
    base = materialize(base.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n") - F.col("first")).alias("base")))
    return rows.withColumn("part", part).join(base, "part").withColumn("index", F.col("base") + F.col("mid")).drop("part", "base", "mid")


def blocks_of(rows: DataFrame, mean: list[float], n: int) -> BlockMatrix:
    """The block matrix of rows (index, x), less the mean."""
    d = len(mean)
    centred = F.zip_with("x", F.array(*map(F.lit, mean)), lambda a, m: a - m)
    frame = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector(centred).alias("vector")), "vector")
    return IndexedRowMatrix(frame, n, d).toBlockMatrix(max(1, min(BLOCK_ROWS, BLOCK_ENTRIES // d)), d)


def local_blocks(spark: SparkSession, m: np.ndarray) -> BlockMatrix:
    """A small matrix as one block."""
    block = ((0, 0), DenseMatrix(*m.shape, m.flatten(order="F").tolist()))
    return BlockMatrix(spark.sparkContext.parallelize([block], 1), *m.shape)


def scatter(m: BlockMatrix) -> np.ndarray:
    """The product of m transposed and m. The rows' blocks are dealt to several tasks, which each sum their own first."""
    splits = max(1, min(m.numRowBlocks, m.blocks.getNumPartitions()))
    flat = m.transpose()._java_matrix_wrapper.call("multiply", m._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(flat, m.colsPerBlock, m.colsPerBlock).toLocalMatrix().toArray()


def fit(x: DataFrame, top: int = COMPONENTS) -> tuple[Whitening | None, DataFrame | None]:
    """x: a column x, padded to one length. (the whitening, its distinct rows with an index); None without a component."""
    once = indexed(x.select("x").distinct())
    sums = once.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum(F.col("c").cast("decimal(20,0)")).alias("s"), F.count("*").alias("n"))
    sums = sorted(sums.collect())  # as many as dimensions
    if not sums:
        return None, None
    n, s = sums[0].n, [int(r.s) for r in sums]
    cov = scatter(blocks_of(once, [v / n for v in s], n)) / n
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1].T
    k = int(np.sum(values[:top] > NO_VARIANCE * values[0])) if values[0] > 0 else 0
    if not k:
        return None, None
    largest = np.abs(vectors).argmax(axis=1)
    vectors = vectors * np.sign(vectors[np.arange(len(vectors)), largest])[:, None]
    return Whitening(n, s, values[:k], vectors[:k], float(np.trace(cov))), once


def project(model: Whitening, rows: DataFrame, n: int) -> BlockMatrix:
    """Rows (index from 0 to n - 1, x) times the whitening matrix."""
    return blocks_of(rows, [v / model.n for v in model.sums], n).multiply(local_blocks(rows.sparkSession, model.matrix))


def as_frame(spark: SparkSession, m: BlockMatrix) -> DataFrame:
    """(index, y) of a block matrix."""
    schema = StructType([StructField("index", LongType()), StructField("y", VectorUDT())])
    rows = m.toIndexedRowMatrix().rows.map(lambda r: (int(r.index), r.vector))
    return spark.createDataFrame(rows, schema).withColumn("y", vector_to_array("y"))


def whiten(vectors: DataFrame, top: int = COMPONENTS, vector_col: str = "embedding", id_col: str = "vec_id") -> tuple[Whitening | None, DataFrame]:
    """(the whitening, (id, x, y, identity_error) of every usable row): y has one whitened number for each component."""
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    rows = materialize(on_grid(vectors, vector_col, [F.col(id_col).alias("id")]))
    d, n = rows.agg(F.max(F.size("x")), F.count("*")).first()
    none = spark.createDataFrame([], f"id {kind}, x array<bigint>, y array<double>, identity_error double")
    if not d:
        return None, none
    rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("x"))))
    model, once = fit(rows, top)
    if model is None:
        return None, none
    error = float(np.abs(scatter(project(model, once, model.n)) / model.n - np.eye(len(model.values))).max())
    rows = materialize(indexed(rows))
    return model, rows.join(as_frame(spark, project(model, rows, n)), "index").select("id", "x", "y", F.lit(error).alias("identity_error"))


def deviation(model: Whitening) -> Column:
    """Sum over dimensions of (n x - S)^2 in whole numbers; null if it does not fit in a long."""
    sums = F.array(*(F.lit(s).cast("decimal(38,0)") for s in model.sums))
    off = F.zip_with("x", F.transform(sums, lambda s: s.try_cast("long")), lambda c, s: F.try_subtract(F.try_multiply(F.lit(model.n).cast("long"), c), s))
    return F.aggregate(off, F.lit(0).cast("long"), lambda a, v: F.try_add(a, F.try_multiply(v, v)))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    model, rows = whiten(vectors)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if model is None:
        return spark.createDataFrame([], f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    share = F.array(*(F.lit(float(e / model.trace)) for e in model.values))
    out = rows.withColumn("deviation", deviation(model)).select("id", "deviation", "identity_error", F.posexplode("y").alias("i", "whitened"))
    return out.select(F.col("id").alias("vec_id"), (F.col("i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(share, F.col("i") + 1).alias("explained"), "identity_error")
