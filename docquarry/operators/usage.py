"""Usage: running monthly quotas and totals over the whole product."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.uploads import month_start
from docquarry.schemas import FREE_UPLOADS_PER_MONTH
from docquarry.session import running_number


def monthly_quota(
    events: DataFrame, limit: int = FREE_UPLOADS_PER_MONTH, account: str = "userId", moment: str = "createdAt", key: str = "id",
    used_before: DataFrame | None = None,
) -> DataFrame:
    """Each event with the account's use in its month so far (``used``) and ``overLimit``.

    The default limit is that of free uploads; questions have FREE_QUESTIONS_PER_MONTH. A running count in one window would put all events of a busy account into one task; here the
    events are numbered by range (see running_number), so even a second of one account may hold most
    of them. Events without an account, or without a moment, count among themselves. ``used_before``
    (account, month, ``used``) carries over counts from earlier batches of a stream.
    """
    rows = events.withColumn("month", month_start(F.col(moment)))
    numbered = running_number(rows, [account, "month"], [moment, key], "used")
    if used_before is not None:
        carried = used_before.select(F.col(account).alias("_account"), F.col("month").alias("_month"), F.col("used").alias("_carried"))
        same = F.col(account).eqNullSafe(F.col("_account")) & F.col("month").eqNullSafe(F.col("_month"))
        numbered = numbered.join(carried, same, "left").withColumn("used", F.col("used") + F.coalesce("_carried", F.lit(0)))
    return numbered.select(*rows.columns, "used", (F.col("used") > limit).alias("overLimit"))


#: 2 ** LG_K counters of 6 to 8 bits in a sketch: some 32 KB, a standard error of 0.46 %.
LG_K = 15


def store_day_sketches(events: DataFrame, path: str, account: str = "userId", moment: str = "createdAt") -> None:
    """Writes each day of ``events``: the number of its events and a sketch of its accounts.

    Only days that ``events`` have are written, in place of what was there for them: give whole days.
    Counts and sketches combine in each task before the shuffle, so a busy day or account is a row a
    task. Events without a moment are a day of their own, those without an account are in no sketch.
    """
    day = F.col(moment).cast("date").alias("day")
    sketched = events.select(day, account).groupBy("day").agg(
        F.count(F.lit(1)).alias("events"), F.hll_sketch_agg(account, F.lit(LG_K)).alias("accounts")
    )
    # a row a day: one file for each
    sketched.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_day_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("events bigint, accounts binary, day date").parquet(path)


def sketched_totals(sketches: DataFrame) -> DataFrame:
    """``day``, ``events``, ``accounts`` for each day, and for all of them together, as ``whole``.

    Active accounts can't be added up over days; their sketches are merged instead, and no event is
    read. ``accounts`` is an estimate: exact but for rounding while there are few, then within some 1 %.
    """
    estimate = lambda c: F.hll_sketch_estimate(c)
    days = sketches.select("day", F.lit(False).alias("whole"), "events", estimate("accounts").alias("accounts"))
    merged = sketches.agg(F.sum("events").alias("events"), F.hll_union_agg("accounts").alias("accounts"))
    whole = merged.select(
        F.lit(None).cast("date").alias("day"), F.lit(True).alias("whole"), F.coalesce("events", F.lit(0)).alias("events"),
        F.coalesce(estimate("accounts"), F.lit(0)).alias("accounts"),
    )
    return days.unionByName(whole)


def product_totals(
    active: DataFrame, processed: DataFrame, questions: DataFrame, account: str = "userId", exact: bool = True
) -> DataFrame:
    """Active accounts, documents processed and questions answered, as ``metric`` and ``value``."""
    accounts = F.count_distinct(account) if exact else F.approx_count_distinct(account)
    totals = [
        active.agg(accounts.alias("value")).withColumn("metric", F.lit("active_accounts")),
        processed.agg(F.count("*").alias("value")).withColumn("metric", F.lit("documents_processed")),
        questions.agg(F.count("*").alias("value")).withColumn("metric", F.lit("questions_answered")),
    ]
    return totals[0].unionByName(totals[1]).unionByName(totals[2]).select("metric", "value")
