"""What the plans must and must not contain, whatever the size of the data."""

import glob
import os
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from docquarry.operators import catalog, sessions, threads
from docquarry.plans import standins
from docquarry.plans.registry import QUERIES
from docquarry.session import running_number, settings_for, shared_path
from docquarry.sources.tables import append_documents


def plan(df, final=False):
    if final:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def conf(spark):
    """Sets session values and puts the old ones back."""
    before = {}

    def change(**values):
        for key, value in values.items():
            key = key.replace("__", ".")
            before.setdefault(key, spark.conf.get(key))
            spark.conf.set(key, value)

    yield change
    for key, value in before.items():
        spark.conf.set(key, value)


def test_answers_read_no_text_and_move_no_passages(spark, sf):
    text = plan(QUERIES["answer_questions"](spark, sf))
    assert text.count("ArrowEvalPython") == 0 and text.count("MapInArrow") == 1
    scans = [line for line in text.split("\n") if "FileScan parquet" in line]
    assert scans and not any("ReadSchema" in line and "text:string" in line for line in scans)
    searched = text[text.index("MapInArrow"):]
    assert "Exchange" not in searched[: searched.index("FileScan")]


def test_newest_threads_are_cut_before_the_shuffle(spark, sf):
    text = plan(QUERIES["recent_conversations"](spark, sf))
    assert text.count("WindowGroupLimit") == 2


def test_scans_read_only_what_they_need(spark, sf):
    path = shared_path(spark, "sessions")
    standins.sessions(spark, sf).write.parquet(path)
    expired = sessions.expired_sessions(spark.read.parquet(path), "2024-01-20").select("id")
    text = plan(expired)
    assert "LessThan(expiresAt,2024-01-20T00:00)" in text
    assert re.search(r"ReadSchema: struct<id:string,expiresAt:timestamp_ntz>", text)


def test_a_hot_account_is_split_in_joins(spark, conf):
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="100KB",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="50KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
    )
    rows = spark.range(200_000, numPartitions=4).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("userId")
    )
    accounts = rows.select(F.col("userId").alias("id"), F.col("userId").alias("name"), F.col("userId").alias("email")).distinct()
    joined = catalog.account_documents(accounts, rows)
    counted = joined.groupBy().count()
    assert counted.head()[0] == 200_000
    final = joined
    assert "skew=true" in plan(final, final=True)


def test_a_hot_key_on_the_key_side_is_one_row_a_task(spark):
    activity = spark.range(100_000, numPartitions=4).select(F.lit("hot").alias("user"))
    accounts = spark.createDataFrame([("hot",), ("cold",)], "id string")
    found = catalog.orphan_rows(accounts, activity, "id", "user")
    assert [r.id for r in found.collect()] == ["cold"]
    text = plan(found)
    side = text[text.index("LeftAnti") :]
    assert side.count("HashAggregate") >= 2


def test_pages_of_a_thread_are_bounded(spark):
    turns = spark.range(10_000, numPartitions=4).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("x").alias("text")
    )
    pages = threads.conversation_threads(turns, 100)
    assert pages.agg(F.max("n_turns"), F.count("*")).head()[:] == (100, 100)


def test_partition_settings_follow_the_input():
    assert settings_for(1)["spark.sql.shuffle.partitions"] == "200"
    assert settings_for(100 * 2**40)["spark.sql.shuffle.partitions"] == str(4 * 100 * 2**10)
    assert settings_for(2**40)["spark.sql.shuffle.partitions"] == "4096"


def test_shared_folder_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert shared_path(spark, "x").startswith(f"{root}/docquarry/x-")
    assert shared_path(spark, "x") != shared_path(spark, "x")


def test_a_third_of_all_rows_in_one_second_is_spread(spark, conf):
    conf(spark__sql__adaptive__coalescePartitions__enabled="false")
    rows = spark.range(30_000, numPartitions=4).select(
        "id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("a"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("t"),
    )
    numbered = running_number(rows, ["a"], ["t"], "n").collect()
    hot = sorted(r.n for r in numbered if r.a == 7)
    assert len(numbered) == 30_000 and hot == list(range(1, len(hot) + 1)) and len(hot) >= 10_000
    assert all(r.n == 1 for r in numbered if r.a != 7)
    # the written ranges
    root = spark.conf.get("spark.checkpoint.dir")
    newest = max(glob.glob(f"{root}/docquarry/ranges-*"), key=os.path.getmtime)
    sizes = Counter(r["_part"] for r in spark.read.parquet(newest).where("a = 7").select("_part").collect())
    assert len(sizes) > 1


def test_upsert_reads_each_side_once(spark, sf):
    text = plan(QUERIES["upsert_accounts"](spark, sf))
    assert text.count("FullOuter") == 1 and "LeftAnti" not in text


def test_an_account_skips_row_groups(spark, sf):
    path = shared_path(spark, "sorted")
    append_documents(standins.documents(spark, sf), path)
    stored = spark.read.parquet(path)
    text = plan(catalog.documents_of_account(stored, "7"))
    assert "PushedFilters: [IsNotNull(userId), EqualTo(userId,7)]" in text
    for file in glob.glob(f"{path}/status=*/*.parquet"):
        found = pq.read_table(file, columns=["userId"])["userId"].to_pylist()
        assert found == sorted(found)
