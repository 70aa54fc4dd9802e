"""Approximate nearest passages: vectors stored by cell, and only the cells nearest to a question are read.

Cells are the Voronoi cells of centroids, fitted by k-means on a bounded sample; every vector is stored, in
the cell of its nearest centroid, which is a partition of the table. A question asks the ``probes`` cells
whose centroids are nearest to it, so a search reads about probes / cells of the table. What it misses lies
in other cells: recall grows with ``probes``, and is 1 when all are asked.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.operators.retrieval import semantic_top_k
from docquarry.session import shared_path

#: Rows that centroids are fitted on at most, taken by a hash of their keys.
SAMPLE = 100_000
ROUNDS = 20
SEED = 17
#: The cell of rows without a vector: stored like all rows, asked by no question.
NO_CELL = -1
TILE_CELLS = 4_000_000


@dataclass
class CellIndex:
    """A stored table of vectors with ``cell``, its partition, and the centroids in the order of their cells."""

    vectors: DataFrame
    centroids: list[list[float]]


def _sampled(vectors: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """At most ``rows`` rows with a vector that has a length, the same ones however the table is split."""
    whole = vectors.where(F.exists("vector", lambda x: x != 0)).select(F.col("vector").cast("array<double>").alias("vector"),
                                                                        F.xxhash64(*keys).alias("at"))
    count = whole.count()
    share = min(1.0, 1.25 * rows / max(count, 1))
    return whole.where(F.pmod("at", F.lit(1_000_000)) < F.lit(int(share * 1_000_000) + 1)).orderBy("at").limit(rows)


def fit_centroids(vectors: DataFrame, cells: int, keys: Sequence[str], sample: int = SAMPLE) -> list[list[float]]:
    """Unit centroids of about ``cells`` cells, by k-means on the angle; fewer if the sample has fewer different vectors."""
    spark, path = vectors.sparkSession, shared_path(vectors.sparkSession, "sample")
    _sampled(vectors, keys, sample).write.parquet(path)
    given = spark.read.parquet(path)
    if given.isEmpty():
        return []
    rows = given.select(array_to_vector("vector").alias("features"))
    model = KMeans(k=max(cells, 2), seed=SEED, maxIter=ROUNDS, distanceMeasure="cosine").fit(rows)
    return [[float(x) for x in c] for c in model.clusterCenters()]


def _nearest(column: pa.Array, centroids: np.ndarray, probes: int) -> Iterator[np.ndarray]:
    """For each vector the ``probes`` cells of the nearest centroids, the nearest first; ties go to the smaller cell."""
    vectors = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), centroids.shape[1])
    height = max(1, TILE_CELLS // len(centroids))
    for at in range(0, len(vectors), height):
        # lengths do not matter for which centroid is nearest in angle; rounding makes equal ones tie
        tile = vectors[at: at + height]
        norms = np.sqrt((tile * tile).sum(axis=1, keepdims=True))
        angles = np.round(tile @ centroids.T / np.where(norms > 0, norms, 1.0), 9)
        yield np.argsort(-angles, axis=1, kind="stable")[:, :probes]


def with_cells(rows: DataFrame, centroids: Sequence[Sequence[float]], probes: int) -> DataFrame:
    """The rows with ``cells``, the numbers of their nearest cells; null where ``vector`` is null."""
    matrix = rows.sparkSession.sparkContext.broadcast(np.asarray(centroids, np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("vector"))
            known = pc.is_valid(column)
            found = list(_nearest(column.filter(known), matrix.value, probes))
            flat = np.concatenate(found).astype(np.int32) if found else np.zeros((0, probes), np.int32)
            has = known.to_numpy(zero_copy_only=False)
            ends = np.concatenate(([0], np.cumsum(has * flat.shape[1])))
            cells = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.ravel()), mask=pa.array(~has))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], [*batch.schema.names, "cells"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))]))


def build_cells(vectors: DataFrame, path: str, cells: int, keys: Sequence[str], sample: int = SAMPLE) -> CellIndex:
    """Stores every row in its cell's partition, and the centroids; returns both as stored.

    A cell with many rows is written by several tasks. Columns named ``cell`` or ``cells`` must not be there.
    """
    spark = vectors.sparkSession
    centroids = fit_centroids(vectors, cells, keys, sample)
    numbered = [(i, c) for i, c in enumerate(centroids)]
    spark.createDataFrame(numbered, "cell int, centroid array<double>").write.parquet(f"{path}/centroids")
    placed = with_cells(vectors, centroids, 1) if centroids else vectors.withColumn("cells", F.lit(None).cast("array<int>"))
    placed = placed.withColumn("cell", F.coalesce(F.get("cells", F.lit(0)), F.lit(NO_CELL))).drop("cells")
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/vectors")
    return read_cells(spark, path, placed.schema)


def read_cells(spark: SparkSession, path: str, schema: T.StructType | None = None) -> CellIndex:
    """A stored index. An index of no rows has no files, so its schema is needed."""
    centroids = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    try:
        vectors = spark.read.parquet(f"{path}/vectors")
    except AnalysisException as error:
        if schema is None or error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        vectors = spark.createDataFrame([], schema)
    return CellIndex(vectors, [r["centroid"] for r in centroids])


def search_cells(
    questions: DataFrame, index: CellIndex, k: int, probes: int, question_key: str = "question_id",
    keys: Sequence[str] = ("doc_id", "chunk_no"), block_questions: int | None = None,
) -> DataFrame:
    """Like ``semantic_top_k``, over the ``probes`` cells nearest to each question.

    A question carries the numbers of its cells, and meets the rows of each. Where there are more than a
    block holds, they meet in the tasks, and none goes through the driver. Questions without a vector
    have no rows. With all cells asked the result is exact.
    """
    if not index.centroids:
        return semantic_top_k(questions, index.vectors, k, question_key, keys)
    asked = with_cells(questions.select(question_key, "vector"), index.centroids, min(probes, len(index.centroids)))
    asked = asked.where(F.col("vector").isNotNull()).select(question_key, "vector", F.col("cells").alias("cell"))
    return semantic_top_k(asked, index.vectors, k, question_key, keys, scope="cell", block_questions=block_questions)


def recall(found: DataFrame, exact: DataFrame, question_key: str, keys: Sequence[str]) -> DataFrame:
    """One row: ``wanted``, the exact hits; ``met``, those of them that were found; ``recall``."""
    both = exact.select(question_key, *keys).join(found.select(question_key, *keys, F.lit(1).alias("_met")), [question_key, *keys], "left")
    return both.agg(F.count(F.lit(1)).alias("wanted"), F.count("_met").alias("met")).withColumn(
        "recall", F.when(F.col("wanted") > 0, F.col("met") / F.col("wanted")).otherwise(F.lit(1.0)))
