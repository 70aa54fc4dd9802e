"""Monthly quotas over a stream: the count per account and month, and the events past the limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.functions.uploads import month_start
from docquarry.operators.usage import monthly_quota
from docquarry.streaming.run import fold_batches, write_batch, written_batches


def _months(events: DataFrame, account: str, moment: str) -> DataFrame:
    return events.select(account, month_start(F.col(moment)).alias("month")).groupBy(account, "month").agg(F.count("*").alias("used"))


def _counts_schema(events: DataFrame, account: str) -> T.StructType:
    return T.StructType([events.schema[account], T.StructField("month", T.TimestampNTZType()), T.StructField("used", T.LongType())])


def _total(counts: DataFrame, account: str) -> DataFrame:
    return counts.groupBy(account, "month").agg(F.sum("used").alias("used"))


def stream_quota(
    events: DataFrame, limit: int, path: str, checkpoint: str, account: str = "userId", moment: str = "createdAt",
    compact_every: int = 10,
) -> DataFrame:
    """Use per account and month, with ``overLimit``. Counts combine per task before the shuffle.

    The counts lie in files: no month is held in memory, so none has to expire and no late event is lost.
    """
    totals = fold_batches(
        events, path, checkpoint, _counts_schema(events, account),
        lambda batch: _months(batch, account, moment), lambda rows: _total(rows, account), compact_every,
    )
    return totals.withColumn("overLimit", F.col("used") > limit)


def stream_quota_events(
    events: DataFrame, limit: int, path: str, checkpoint: str,
    account: str = "userId", moment: str = "createdAt", key: str = "id", compact_every: int = 10,
) -> DataFrame:
    """Each event with the use of its month so far: the batch operator, carried over micro-batches.

    No event waits in state, and a busy account is split over tasks as in the batch operator. Events
    count in order of arrival: those of a micro-batch by time, after all of the batches before.
    """
    spark, events_path = events.sparkSession, f"{path}/events"
    numbered_schema = T.StructType([
        *events.schema.fields,
        T.StructField("month", T.TimestampNTZType()),
        T.StructField("used", T.LongType()),
        T.StructField("overLimit", T.BooleanType()),
    ])

    def see(batch: DataFrame, before: DataFrame | None, batch_id: int) -> None:
        write_batch(monthly_quota(batch, limit, account, moment, key, used_before=before), events_path, batch_id)

    fold_batches(
        events, f"{path}/counts", checkpoint, _counts_schema(events, account),
        lambda batch: _months(batch, account, moment), lambda rows: _total(rows, account), compact_every, see,
    )
    return written_batches(spark, events_path, numbered_schema).drop("batch_id")
