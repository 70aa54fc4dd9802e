import datetime as dt

from pyspark.sql import functions as F

from docquarry.operators.threads import (
    conversation_threads,
    recent_conversations,
    search_conversations,
    sources_per_conversation,
)
from docquarry.operators.usage import monthly_quota, product_totals

T0 = dt.datetime(2024, 1, 1)


def test_quota_of_a_busy_account(spark):
    """Half of all events are one account's, many in the same instant, over two months."""
    events = spark.range(6_000, numPartitions=4).select(
        F.col("id"),
        F.when(F.col("id") % 2 == 0, "busy").otherwise(F.concat(F.lit("u"), (F.col("id") % 50).cast("string"))).alias("userId"),
        F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00' + make_dt_interval(0, 0, cast(id / 7 AS INT) * 20)").alias("createdAt"),
    )
    rows = monthly_quota(events, 50).toPandas()
    rows = rows.sort_values(["createdAt", "id"])
    expected = rows.groupby(["userId", rows["createdAt"].dt.to_period("M")]).cumcount() + 1
    assert len(rows) == 6_000 and (rows["used"] == expected).all() and (rows["overLimit"] == (expected > 50)).all()


def test_a_quota_carries_over(spark):
    events = spark.createDataFrame([(1, "u", T0), (2, "v", T0)], "id int, userId string, createdAt timestamp_ntz")
    before = spark.createDataFrame([("u", T0, 50)], "userId string, month timestamp_ntz, used bigint")
    rows = {r.userId: (r.used, r.overLimit) for r in monthly_quota(events, 50, used_before=before).collect()}
    assert rows == {"u": (51, True), "v": (1, False)}


def test_events_without_account_or_time_are_counted(spark):
    events = spark.createDataFrame(
        [(1, None, T0), (2, "u", None), (3, None, T0), (4, "u", None), (5, None, None), (6, "u", T0)],
        "id int, userId string, createdAt timestamp_ntz",
    )
    rows = {r.id: (r.used, r.overLimit) for r in monthly_quota(events, 1).collect()}
    assert rows == {1: (1, False), 3: (2, True), 2: (1, False), 4: (2, True), 5: (1, False), 6: (1, False)}
    before = monthly_quota(events, 1).groupBy("userId", "month").agg(F.max("used").alias("used"))
    again = {r.id: r.used for r in monthly_quota(events, 1, used_before=before).collect()}
    assert again == {1: 3, 3: 4, 2: 3, 4: 4, 5: 2, 6: 2}


def test_threads(spark):
    turns = spark.range(1_000).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("T"), F.col("id").cast("string")).alias("text")
    )
    pages = conversation_threads(turns, 64).orderBy("page").collect()
    assert [t.turn for p in pages for t in p.turns] == list(range(1_000)) and max(p.n_turns for p in pages) == 64
    assert [tuple(r) for r in search_conversations(turns, "t99").collect()] == [(1, 11, 99)]


def test_recency_and_sources(spark):
    threads = spark.createDataFrame([(i, "u" if i % 3 else "v", T0 + dt.timedelta(days=i // 2)) for i in range(12)], "id int, userId string, updatedAt timestamp_ntz")
    newest = recent_conversations(threads, 2).orderBy("userId", "position").collect()
    assert [(r.userId, r.id) for r in newest] == [("u", 11), ("u", 10), ("v", 9), ("v", 6)]
    cited = spark.createDataFrame([(1, 5), (1, 5), (1, 6), (2, 5)], "conv_id int, doc_id int")
    assert sorted(map(tuple, sources_per_conversation(cited).collect())) == [(1, 2), (2, 1)]


def test_totals(spark):
    active = spark.createDataFrame([("u",), ("u",), ("v",)], "userId string")
    for exact in (True, False):
        rows = product_totals(active, active, active.limit(1), exact=exact).collect()
        assert {r.metric: r.value for r in rows} == {"active_accounts": 2, "documents_processed": 3, "questions_answered": 1}
