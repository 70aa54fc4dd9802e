"""Quotas as keyed state: the event that crosses the limit, months that close, state that goes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from docquarry.session import shared_path
from docquarry.streaming.months import stream_quota_crossings

SCHEMA = "userId string, id bigint, createdAt timestamp_ntz"


def places(spark):
    return shared_path(spark, "out"), shared_path(spark, "checkpoint")


def put(spark, source, rows):
    spark.createDataFrame(rows, "userId string, id bigint, t string").selectExpr(
        "userId", "id", "CAST(t AS timestamp_ntz) AS createdAt").coalesce(1).write.mode("append").parquet(str(source))


def run(spark, source, path, checkpoint, limit=2):
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    found = stream_quota_crossings(events, limit, path, checkpoint).collect()
    return sorted((r.kind, r.userId or "-", str(r.month)[:7], r.used, r.id) for r in found)


def state_rows(spark, checkpoint):
    """Keys whose state is defined; a removed one may leave no row."""
    return spark.read.format("statestore").load(checkpoint).count()


def test_crossings_and_closings_over_runs(spark, tmp_path):
    source, (path, checkpoint) = tmp_path / "in", places(spark)
    source.mkdir()
    assert run(spark, source, path, checkpoint) == []
    put(spark, source, [("a", 3, "2024-01-05 00:00:00"), ("a", 1, "2024-01-03 00:00:00"), ("b", 9, "2024-01-31 23:59:59"), (None, 8, "2024-01-07 00:00:00")])
    assert run(spark, source, path, checkpoint) == []
    # the third of a, by time within its micro-batch; b's February is a month of its own
    put(spark, source, [("a", 7, "2024-01-31 12:00:00"), ("a", 5, "2024-01-31 11:00:00"), ("a", 6, "2024-01-31 13:00:00"), ("b", 10, "2024-02-01 00:00:00")])
    crossed = [("crossed", "a", "2024-01", 3, 5)]
    assert run(spark, source, path, checkpoint) == crossed
    assert state_rows(spark, checkpoint) == 4
    # the watermark passes the end of January: closed with its use, once; a late event is dropped
    put(spark, source, [("b", 11, "2024-02-03 00:00:00"), ("b", 12, "2024-02-03 00:00:01")])
    put(spark, source, [("a", 13, "2024-01-01 00:00:00")])
    closed = [("closed", "-", "2024-01", 1, None), ("closed", "a", "2024-01", 5, None), ("closed", "b", "2024-01", 1, None)]
    crossed += [("crossed", "b", "2024-02", 3, 12)]
    assert run(spark, source, path, checkpoint) == sorted(closed + crossed)
    assert state_rows(spark, checkpoint) == 1
    assert run(spark, source, path, checkpoint) == sorted(closed + crossed)
    # after all months are over only the newest event's own month is left
    put(spark, source, [("z", 20, "2024-06-15 00:00:00")])
    assert run(spark, source, path, checkpoint) == sorted(closed + crossed + [("closed", "b", "2024-02", 3, None)])
    assert state_rows(spark, checkpoint) == 1


@pytest.mark.parametrize("limit", [0, 1, 40])
def test_against_a_plain_count(spark, tmp_path, limit):
    rng = random.Random(limit)
    source, start = tmp_path / "in", dt.datetime(2024, 1, 1)
    rows = [(f"u{rng.randrange(4)}" if rng.random() < 0.7 else "hot", i, start + dt.timedelta(hours=rng.randrange(24 * 80))) for i in range(600)]
    rows.sort(key=lambda r: (r[2], r[1]))
    for i in range(0, 600, 150):
        put(spark, source, [(u, n, str(t)) for u, n, t in rng.sample(rows[i: i + 150], 150)])
    used, want = {}, []
    for u, n, t in rows:
        key = (u, str(t)[:7])
        used[key] = used.get(key, 0) + 1
        if used[key] == limit + 1:
            want.append(("crossed", u, key[1], limit + 1, n))
    last = rows[-1][2] - dt.timedelta(days=1)
    over = lambda m: dt.datetime(2024, int(m[5:]) % 12 + 1, 1) < last
    want += [("closed", u, m, n, None) for (u, m), n in used.items() if over(m)]
    path, checkpoint = places(spark)
    found = run(spark, source, path, checkpoint, limit)
    assert found == sorted(want, key=lambda r: (r[0], r[1], r[2], r[3]))
    assert spark.read.parquet(path).select("batch_id").distinct().count() >= 3


def test_events_without_a_time_are_left_out(spark, tmp_path):
    source, (path, checkpoint) = tmp_path / "in", places(spark)
    put(spark, source, [("a", 1, None), ("a", 2, None), ("a", 3, "2024-01-01 00:00:00")])
    assert run(spark, source, path, checkpoint, limit=0) == [("crossed", "a", "2024-01", 1, 3)]
    assert spark.read.parquet(path).where(F.col("createdAt").isNull()).count() == 0


def test_state_and_calls_grow_with_slots_not_with_accounts(spark, tmp_path):
    source, (path, checkpoint) = tmp_path / "in", places(spark)
    accounts = [f"u{i}" for i in range(6000)]
    put(spark, source, [(u, i, "2024-01-05 00:00:00") for i, u in enumerate(accounts)])
    assert run(spark, source, path, checkpoint, limit=1) == []
    assert 3000 < state_rows(spark, checkpoint) <= 4096
    put(spark, source, [(u, 6000 + i, "2024-01-06 00:00:00") for i, u in enumerate(accounts[::3])] + [("z", -1, "2024-06-15 00:00:00")])
    want = [("crossed", u, "2024-01", 2, 6000 + i) for i, u in enumerate(accounts[::3])]
    want += [("closed", u, "2024-01", 1 + (i % 3 == 0), None) for i, u in enumerate(accounts)]
    assert run(spark, source, path, checkpoint, limit=1) == sorted(want, key=lambda r: r[:4])
    assert state_rows(spark, checkpoint) == 1


def test_accounts_of_one_slot(spark, tmp_path):
    """Each has its own count; large ids stay whole beside an event without one, which is the last of its moment."""
    source, (path, checkpoint), large = tmp_path / "in", places(spark), 2**60 + 1

    def go():
        events = spark.readStream.schema("userId bigint, id bigint, createdAt timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(str(source))
        found = stream_quota_crossings(events, 1, path, checkpoint, slots=1)
        assert found.schema["userId"].dataType.simpleString() == "bigint"
        return sorted(((r.kind, r.userId or 0, str(r.month)[:7], r.used, r.id or 0) for r in found.collect()))

    def add(rows):
        spark.createDataFrame(rows, "userId bigint, id bigint, t string").selectExpr(
            "userId", "id", "CAST(t AS timestamp_ntz) AS createdAt").coalesce(1).write.mode("append").parquet(str(source))

    add([(large, large, "2024-01-05 00:00:00"), (large, large + 1, "2024-01-05 00:00:00"), (7, None, "2024-01-06 00:00:00"),
         (7, large + 2, "2024-01-06 00:00:00"), (8, large + 3, "2024-01-07 00:00:00"), (None, large + 4, "2024-01-08 00:00:00")])
    first = [("crossed", 7, "2024-01", 2, 0), ("crossed", large, "2024-01", 2, large + 1)]
    assert go() == first
    assert state_rows(spark, checkpoint) == 2
    add([(8, large + 5, "2024-01-09 00:00:00"), (large, large + 6, "2024-01-09 00:00:00"), (9, 1, "2024-02-05 00:00:00")])
    closed = [("closed", 0, "2024-01", 1, 0), ("closed", 7, "2024-01", 2, 0), ("closed", 8, "2024-01", 2, 0), ("closed", large, "2024-01", 3, 0)]
    assert go() == sorted(closed + first + [("crossed", 8, "2024-01", 2, large + 5)])
