"""Whitening of embeddings with MLlib's block matrices.

Rows get dense indices and become an indexed row matrix of centred values, cut into distributed blocks. The transposed
blocks times the blocks are the scatter matrix, whose size is that of the dimensions alone; its eigenvectors are found on
the driver. Their multiple that gives unit variances is a block matrix again, and the rows' blocks times it are the
whitened rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convlog.llm.common import small, stored, table

ROWS = COLUMNS = 1024  # of a block
TOGETHER = 16  # blocks of rows that one task multiplies


def fixed_point(vector: Column, scale: int, shift: int) -> Column:
    """floor(scale * c) + shift of each entry c, as longs; null if the vector or an entry is null or not finite."""
    vector = vector.cast("array<double>")
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda c: F.floor(c * scale).cast("long") + F.lit(shift).cast("long")))


def indexed(rows: DataFrame) -> DataFrame:
    """rows, stored, with a dense `index` from 0. Only the number of rows of each of the table's partitions is summed up."""
    rows = stored(rows.withColumn("at", F.monotonically_increasing_id()), "whitening-rows")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = stored(counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "whitening-parts")
    return rows.withColumn("part", part).join(small(first), "part").withColumn("index", F.col("first") + place).drop("at", "part", "first")


def blocks(rows: DataFrame, values: Column, n: int, width: int) -> BlockMatrix:
    """The block matrix of n rows (index, values), values an array of so many doubles."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector(values).alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, width).toBlockMatrix(ROWS, COLUMNS)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """Transposed matrix times matrix. The rows' blocks are dealt out over tasks, which Python's multiply has no argument
    for: all of them would meet in the task of the result's one block."""
    splits = -(-matrix.numRowBlocks // TOGETHER) if matrix.numRowBlocks > 64 * TOGETHER else matrix.numRowBlocks
    turned = matrix.transpose()
    product = turned._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, COLUMNS, COLUMNS).toLocalMatrix().toArray()


def projected(matrix: BlockMatrix, weights: np.ndarray) -> DataFrame:
    """index, values: matrix times weights, a local matrix that becomes a block matrix."""
    cut = [((k, 0), DenseMatrix(len(w), w.shape[1], w.ravel(order="F"))) for k, w in enumerate(np.split(weights, range(COLUMNS, len(weights), COLUMNS)))]
    right = BlockMatrix(SparkSession.active().sparkContext.parallelize(cut, 1), COLUMNS, COLUMNS, len(weights), weights.shape[1])
    rows = matrix.multiply(right).toIndexedRowMatrix()
    return callMLlibFunc("getIndexedRows", rows._java_matrix_wrapper._java_model).select("index", vector_to_array("vector").alias("values"))


def sums(rows: DataFrame, values: str) -> DataFrame:
    return rows.select(F.posexplode(values).alias("dim", "v")).groupBy("dim").agg(F.sum("v").alias("s")).orderBy("dim")


def whitening(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error for each row and component.

    Entries become whole numbers x = floor(scale * c) + shift, so that their sums S and `deviation`, the sum of
    (n * x - S)^2 over dimensions (decimal), are exact. `whitened` is the centred row along a unit eigenvector of the
    covariance (divisor n), over the root of its eigenvalue; components are numbered from 1 by falling eigenvalue, those
    of equal ones in any order. `explained` is the eigenvalue's part of the trace. `identity_error` is the largest entry of
    the whitened rows' covariance minus the identity.

    Rows whose vector is null, or holds a null or an entry that isn't finite, are left out, and so are rows whose number
    of entries isn't the most frequent one (of equally frequent ones the larger). Fewer dimensions than components: as
    many as there are; eigenvalues that are rounding errors of 0 have no component, so equal rows, one row or none give an
    empty result. Repeated rows and null ids count and stay row by row. Other columns are ignored. Only sums, the
    covariance and its eigenvectors, of a size set by the dimensions, and counts by block pass the driver. Block matrices
    address up to 2^31 rows.
    """
    spark = vectors.sparkSession
    x = fixed_point(F.col(vector_col), scale, shift)
    rows = vectors.select(F.col(id_col).alias("id"), x.alias("x")).filter("x is not null")
    widths = rows.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    width, n = (widths["width"], widths["n"]) if widths else (0, 0)
    none = rows.filter(F.lit(False)).select("id", *(F.lit(0).cast(t).alias(c) for c, t in (("component", "int"), ("n", "long"), ("deviation", "decimal(38,0)"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))))
    if not n or not width:
        return none.withColumnRenamed("id", id_col)
    rows = stored(indexed(rows.filter(F.size("x") == width)), "whitening-indexed")
    total = F.array(*(F.lit(int(r["s"])) for r in sums(rows, "x").collect()))  # a number a dimension
    away = F.zip_with("x", total, lambda a, s: a * F.lit(n) - s)
    matrix = blocks(rows, F.transform(away, lambda d: d / F.lit(float(n))), n, width)
    covariance = scatter(matrix) / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[: min(components, width)]
    order = order[values[order] > max(values.max(), 0) * width * np.finfo(float).eps]
    if not len(order):
        return none.withColumnRenamed("id", id_col)
    white = stored(projected(matrix, axes[:, order] / np.sqrt(values[order])), "whitening-projected")
    means = [r["s"] / n for r in sums(white, "values").collect()]
    centred = F.zip_with("values", F.array(*map(F.lit, means)), lambda a, m: a - m)
    error = float(np.abs(scatter(blocks(white, centred, n, len(order))) / n - np.eye(len(order))).max())
    square = lambda d: (d.cast("decimal(19,0)") * d.cast("decimal(19,0)")).cast("decimal(38,0)")
    deviation = F.aggregate(away, F.lit(0).cast("decimal(38,0)"), lambda acc, d: (acc + square(d)).cast("decimal(38,0)"))
    explained = F.array(*(F.lit(float(v)) for v in values[order] / np.trace(covariance)))
    out = rows.select("index", "id", deviation.alias("deviation")).join(white, "index")
    out = out.select("id", F.lit(n).cast("long").alias("n"), "deviation", F.posexplode("values").alias("k", "whitened"))
    return out.select(
        F.col("id").alias(id_col), (F.col("k") + 1).alias("component"), "n", "deviation", "whitened", F.get(explained, F.col("k")).alias("explained"), F.lit(error).alias("identity_error")
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of embeddings, 32 components; deviation as a long (null where it has no room in one)."""
    out = whitening(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))
