"""Deduplication with bounded state: keys are forgotten once the watermark is past them, and late rows are set apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.streaming.run import batch_path, drain, write_batch, written_batches

ON_TIME, LATE, UNTIMED = "on_time", "late", "untimed"
MARK = T.StructType([T.StructField("newest", T.TimestampType())])


def split_late(rows: DataFrame, path: str, checkpoint: str, delay: str, moment: str) -> DataFrame:
    """Writes a stream's rows by ``arrival``, and returns all written so far, with it.

    ``late``: as old as the watermark, which is ``delay`` behind the newest row of the micro-batches
    before, or older; ``untimed``: without a time; else ``on_time``. Nothing is dropped. The newest time
    is kept in a file for each micro-batch.
    """
    spark, marks = rows.sparkSession, f"{path}/marks"

    def handle(batch: DataFrame, batch_id: int) -> None:
        before = spark.read.schema(MARK).parquet(batch_path(marks, batch_id - 1)).first()["newest"] if batch_id else None
        at = F.col(moment).cast("timestamp")
        # Spark's watermarks count milliseconds
        mark = F.date_trunc("millisecond", F.lit(before).cast("timestamp")) - F.expr(f"INTERVAL {delay}")
        late = F.coalesce(F.date_trunc("millisecond", at) <= mark, F.lit(False))
        arrival = F.when(at.isNull(), UNTIMED).when(late, LATE).otherwise(ON_TIME)
        write_batch(batch.withColumn("arrival", arrival), f"{path}/rows", batch_id, partition_by="arrival")
        written = spark.read.schema(rows.schema).parquet(batch_path(f"{path}/rows", batch_id))
        newest = written.agg(F.max(F.col(moment).cast("timestamp")).alias("newest"))
        write_batch(newest.select(F.greatest("newest", F.lit(before).cast("timestamp")).alias("newest")), marks, batch_id)

    drain(rows, handle, checkpoint)
    schema = T.StructType([*rows.schema.fields, T.StructField("arrival", T.StringType())])
    return written_batches(spark, f"{path}/rows", schema).drop("batch_id")


def stream_dedup_within(
    uploads: DataFrame, path: str, checkpoint: str, delay: str, key: str = "r2Key", moment: str = "createdAt",
) -> DataFrame:
    """All rows of a stream with ``outcome``: ``kept``, ``repeated``, ``late`` or ``untimed``.

    Rows that are late or have no time are set apart and written first. The rest run through Spark's
    ``dropDuplicatesWithinWatermark``: one row of a key is kept, and others no more than ``delay`` apart
    from it are repeated; a key that comes again later may be kept again, since it is forgotten when
    the watermark is past it by ``delay``. So state is bounded by the keys of that time, and nothing is
    read again but a batch's own rows. Which of a key's rows of one batch is kept is left open; rows
    without a key are all kept. kept + repeated + late + untimed is the input.
    """
    spark = uploads.sparkSession
    arrived = split_late(uploads, f"{path}/arrived", f"{checkpoint}/arrived", delay, moment)
    first = T.StructType([*uploads.schema.fields, T.StructField("_at", T.TimestampType())])
    on_time = arrived.where(F.col("arrival") == ON_TIME).drop("arrival")
    if arrived.inputFiles():
        # Whole micro-batches of the stage before: what is on time there is never late here.
        schema = T.StructType([*uploads.schema.fields, T.StructField("batch_id", T.LongType()), T.StructField("arrival", T.StringType())])
        source = spark.readStream.schema(schema).option("basePath", f"{path}/arrived/rows").parquet(f"{path}/arrived/rows")
        keyed = source.where((F.col("arrival") == ON_TIME) & F.col(key).isNotNull()).drop("arrival", "batch_id")
        once = keyed.withColumn("_at", F.col(moment).cast("timestamp")).withWatermark("_at", delay).dropDuplicatesWithinWatermark([key])
        drain(once, lambda batch, n: write_batch(batch, f"{path}/kept", n), f"{checkpoint}/kept")
    kept = written_batches(spark, f"{path}/kept", first).drop("batch_id", "_at")
    named = on_time.where(F.col(key).isNotNull())
    outcomes = {
        "kept": kept.unionByName(on_time.where(F.col(key).isNull())),
        "repeated": named.exceptAll(kept),
        "late": arrived.where(F.col("arrival") == LATE).drop("arrival"),
        "untimed": arrived.where(F.col("arrival") == UNTIMED).drop("arrival"),
    }
    parts = [rows.withColumn("outcome", F.lit(name)) for name, rows in outcomes.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
