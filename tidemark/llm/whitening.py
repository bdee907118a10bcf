"""Embedding whitening with MLlib's distributed block matrices.

Centred rows become blocks; the transposed blocks times the blocks are the scatter matrix, which is as small as the
vectors are long and is decomposed locally; the blocks times the whitening matrix are the projected rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
BLOCK_ROWS = 1024
BLOCKS_A_SUM = 64  # blocks whose products one task adds up
FLAT = 1e-12  # a component with less of the trace has no variance that double precision can tell from none


def _usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(_key, _x): vectors without null or non-finite entries, of the most frequent length, as whole numbers."""
    entries = F.transform(F.col(vector), lambda c: c.cast("double"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    sound = vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(key).alias("_key"), entries.alias("_c"))
    sound = sound.where(~F.exists("_c", bad))
    lengths = sound.groupBy(F.size("_c").alias("_length")).agg(F.count(F.lit(1)).alias("_rows"))
    usual = lengths.agg(F.max_by("_length", F.struct("_rows", "_length")))
    x = F.transform("_c", lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    return sound.where(F.size("_c") == usual.scalar()).select("_key", x.alias("_x"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Add ``_row``, from 0 without gaps. Rows are written with the number of their task first; the numbers of rows
    in the tasks before, a row per task, give each task's first number."""
    rows = written(rows.withColumn("_at", F.monotonically_increasing_id()), "whitening-rows")
    task = F.shiftright("_at", 33).alias("_task")
    counts = written(rows.groupBy(task).agg(F.count(F.lit(1)).alias("_rows")), "whitening-tasks")
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_task", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    numbered = rows.withColumn("_task", F.shiftright("_at", 33)).join(F.broadcast(starts), "_task")
    return numbered.withColumn("_row", F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_task", "_start", "_at")


def _sums(rows: DataFrame, length: int) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of each dimension."""
    sums = [F.sum(F.col("_x")[i].cast("decimal(38,0)")) for i in range(length)]
    n, *found = rows.agg(F.count(F.lit(1)), *sums).first()
    return n, [int(s) for s in found]


def _blocks(rows: DataFrame, columns: Column, width: int) -> BlockMatrix:
    """Rows (_row, an array of doubles) as blocks of BLOCK_ROWS rows and all columns."""
    vectors = rows.select(F.col("_row").alias("index"), array_to_vector(columns).alias("vector"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector")).toBlockMatrix(BLOCK_ROWS, width)


def _java(matrix: BlockMatrix):
    return matrix._java_matrix_wrapper._java_model


def _scatter(matrix: BlockMatrix) -> np.ndarray:
    """The transposed matrix times itself. Its inner side, the rows, is cut so that no task adds up all blocks."""
    parts = -(-matrix.numRowBlocks // BLOCKS_A_SUM)
    product = _java(matrix.transpose()).multiply(_java(matrix), parts)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def _local_blocks(spark, values: np.ndarray) -> BlockMatrix:
    """A matrix as small as the vectors are long, as one block."""
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(values)]
    frame = spark.createDataFrame(rows, "_row long, _v array<double>")
    vectors = frame.select(F.col("_row").alias("index"), array_to_vector("_v").alias("vector"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector")).toBlockMatrix(*values.shape)


def whiten(vectors: DataFrame, key: str, vector: str, components: int = COMPONENTS) -> DataFrame:
    """Vectors projected on the first principal components, each scaled to variance 1.

    Each entry c, as double, counts as the whole number x = floor(1024 c) + 100000. With n vectors and the sums S of
    their dimensions, rows x - S/n are centred before they are multiplied; the covariance divides by n. Returns per
    vector and component (from 1, by falling eigenvalue, at most ``components`` and the vectors' length): the key,
    component, n, deviation (sum over dimensions of (n x - S)^2, exact; null where it exceeds a long), whitened,
    explained (share of the trace) and identity_error (largest entry of the whitened vectors' covariance minus the
    identity, without sign; one value).

    Null and empty vectors, and those with null or non-finite entries, are left out, and so are vectors whose length is
    not the most frequent one (of two, the greater). A component without variance (less than 1e-12 of the trace) has a
    null whitened and takes no part in identity_error; if no component has any, explained and identity_error are null.
    Repeated rows and keys, and null keys, count one by one; other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = _numbered(_usable(vectors, key, vector))
    length = rows.select(F.size("_x")).limit(1).collect()
    if not length:
        kinds = [("component", "int"), ("n", "long"), ("deviation", "long")]
        kinds += [(name, "double") for name in ("whitened", "explained", "identity_error")]
        return vectors.select(key, *[F.lit(None).cast(kind).alias(name) for name, kind in kinds]).where("false")
    length = length[0][0]
    n, sums = _sums(rows, length)
    total = F.array(*[F.lit(s).cast("decimal(38,0)") for s in sums])
    apart = F.zip_with("_x", total, lambda x, s: (F.lit(n) * x.cast("decimal(38,0)") - s).cast("decimal(38,0)"))
    rows = rows.withColumn("_apart", apart)
    square = lambda d: (d.cast("decimal(19,0)") * d.cast("decimal(19,0)")).cast("decimal(38,0)")
    deviation = F.aggregate("_apart", F.lit(0).cast("decimal(38,0)"), lambda a, d: (a + square(d)).cast("decimal(38,0)"))
    rows = rows.withColumn("deviation", deviation.try_cast("long"))
    rows = written(rows.withColumn("_centred", F.transform("_apart", lambda d: d.cast("double") / n)).drop("_apart", "_x"), "whitening-centred")

    centred = _blocks(rows, F.col("_centred"), length)
    values, axes = np.linalg.eigh(_scatter(centred) / n)
    trace = values.sum()
    found = min(components, length)
    order = np.argsort(-values, kind="stable")[:found]
    values = np.maximum(values[order], 0)
    varied = values > FLAT * trace
    matrix = np.where(varied, axes[:, order] / np.sqrt(np.where(varied, values, 1)), 0)
    whitened = centred.multiply(_local_blocks(spark, matrix))
    kept = int(varied.sum())  # the first ones, as they fall
    error = float(np.abs((_scatter(whitened) / n)[:kept, :kept] - np.eye(kept)).max()) if kept else None

    projected = callMLlibFunc("getIndexedRows", _java(whitened.toIndexedRowMatrix()))
    projected = MLUtils.convertVectorColumnsToML(projected, "vector").select(
        F.col("index").alias("_row"), vector_to_array("vector").alias("_w")
    )
    shares = [F.lit(float(v / trace)) if trace > 0 else F.lit(None).cast("double") for v in values]
    entry = lambda i: F.col("_w")[i] if varied[i] else F.lit(None).cast("double")
    each = [F.struct(F.lit(i + 1).alias("component"), entry(i).alias("whitened"), shares[i].alias("explained")) for i in range(found)]
    out = rows.select("_key", "_row", "deviation").join(projected, "_row")
    out = out.select("_key", "deviation", F.inline(F.array(*each)))
    return out.select(
        F.col("_key").alias(key),
        "component",
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        "explained",
        F.lit(error).cast("double").alias("identity_error"),
    )
