"""Starting streams and reading what their micro-batches wrote.

Every sink here is repeatable: micro-batch n writes folder ``batch_id=n`` and nothing else, so a batch
that runs again after a lost executor or driver replaces its own rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def batch_path(path: str, batch_id: int) -> str:
    return f"{path}/batch_id={batch_id}"


def write_batch(rows: DataFrame, path: str, batch_id: int, partition_by: str | None = None) -> None:
    writer = rows.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(batch_path(path, batch_id))


def drain(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Runs ``handle`` over all data present, in as many micro-batches as the source makes of it."""
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def written_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows the batches wrote, with their ``batch_id``; none if no batch has run, as the source was empty."""
    numbered = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    try:
        return spark.read.schema(numbered).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], numbered)


def fold_batches(
    stream: DataFrame, path: str, checkpoint: str, schema: T.StructType,
    make: Callable[[DataFrame], DataFrame], fold: Callable[[DataFrame], DataFrame], compact_every: int = 10,
    see: Callable[[DataFrame, DataFrame | None, int], None] | None = None,
) -> DataFrame:
    """What a stream has come to, kept in files instead of the state of a streaming operator.

    Each micro-batch writes ``make(batch)``, and every ``compact_every``-th batch that folded with all
    before it. So nothing has to be held in memory or to expire, and at most ``compact_every`` folders
    are read, by a batch and in the end. ``see`` is called first, with the batch, what came before (None
    for the first) and the batch's number.
    """
    spark = stream.sparkSession

    def before(batch_id: int) -> DataFrame | None:
        if not batch_id:
            return None
        first = (batch_id - 1) // compact_every * compact_every
        return fold(spark.read.schema(schema).parquet(*[batch_path(path, n) for n in range(first, batch_id)]))

    def handle(batch: DataFrame, batch_id: int) -> None:
        earlier = before(batch_id)
        if see:
            see(batch, earlier, batch_id)
        own = make(batch)
        if earlier is not None and batch_id % compact_every == 0:
            own = fold(earlier.unionByName(own))
        write_batch(own, path, batch_id)

    drain(stream, handle, checkpoint)
    last = written_batches(spark, path, schema).agg(F.max("batch_id")).first()[0]
    rows = written_batches(spark, path, schema).where(F.col("batch_id") >= (last or 0) // compact_every * compact_every)
    return fold(rows.drop("batch_id"))
