"""Streams over several micro-batches give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from docquarry.operators.catalog import latest_document_state
from docquarry.operators.usage import monthly_quota
from docquarry.plans import standins
from docquarry.session import shared_path
from docquarry.streaming.late import split_late, stream_dedup_within
from docquarry.streaming.quota import stream_quota, stream_quota_events
from docquarry.streaming.seen import covering, keep_keys, seen_keys, span
from docquarry.streaming.state import stream_latest_state
from docquarry.streaming.uploads import stream_dedup_uploads, stream_upload_manifests, stream_validate_uploads


@pytest.fixture(scope="module")
def staged(spark, sf):
    """The events in time order in three files, one micro-batch each."""
    path = shared_path(spark, "events")
    events = standins.events(spark, sf)
    for third in range(3):
        low, high = f"2024-01-{1 + 10 * third:02d}", f"2024-01-{11 + 10 * third:02d}"
        events.where((F.col("ts") >= low) & (F.col("ts") < high)).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, staged):
    schema = spark.read.parquet(staged).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(staged)


def places(spark):
    return shared_path(spark, "out"), shared_path(spark, "checkpoint")


def bag(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_latest_state(spark, sf, staged):
    path, checkpoint = places(spark)
    found = stream_latest_state(standins.log_columns(stream(spark, staged)), path, checkpoint, "id", "updatedAt", "seq")
    assert bag(found) == bag(latest_document_state(standins.log_columns(standins.events(spark, sf))))
    assert spark.read.parquet(path).select("batch_id").distinct().count() >= 3


def test_quota_counts(spark, sf, staged):
    found = stream_quota(stream(spark, staged), 50, *places(spark), account="user_id", moment="ts")
    batch = standins.events(spark, sf).groupBy("user_id", F.date_trunc("MONTH", "ts").cast("timestamp_ntz").alias("month")).agg(F.count("*").alias("used"))
    assert bag(found) == bag(batch.withColumn("overLimit", F.col("used") > 50))


@pytest.mark.parametrize("compact_every", [1, 2, 10])
def test_quota_events(spark, sf, staged, compact_every):
    events = stream(spark, staged).select("event_id", "user_id", "ts")
    found = stream_quota_events(
        events, 5, *places(spark), account="user_id", moment="ts", key="event_id", compact_every=compact_every
    )
    batch = monthly_quota(standins.events(spark, sf).select("event_id", "user_id", "ts"), 5, "user_id", "ts", "event_id")
    assert bag(found) == bag(batch)


def test_dedup(spark, sf, staged):
    uploads = stream(spark, staged).select(F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("r2Key"), F.col("ts").alias("createdAt"))
    keys = [r.r2Key for r in stream_dedup_uploads(uploads, *places(spark)).collect()]
    assert len(keys) == len(set(keys)) == standins.events(spark, sf).select("user_id").distinct().count()


def test_validation_stream_resumes_without_repeats(spark, tmp_path):
    source = tmp_path / "incoming"
    source.mkdir()
    path, checkpoint = places(spark)
    total = 0
    for batch in range(2):
        for part in range(2):
            good = '{"fileName":"a","fileSize":1,"mimeType":"text/plain"}'
            bad = '{"fileName":"","fileSize":0,"mimeType":"x"}'
            (source / f"m{batch}{part}.json").write_text(f"{good}\n{bad}\n")
            total += 1
        requests = stream_upload_manifests(spark, str(source), files_per_batch=1)
        rows = stream_validate_uploads(requests, path, checkpoint).collect()
        assert sum(r.outcome == "accepted" for r in rows) == sum(r.outcome == "rejected" for r in rows) == total
        assert all(len(r.errors) == 3 for r in rows if r.outcome == "rejected")


def test_validation_stream_finds_repeats(spark, tmp_path):
    source = tmp_path / "incoming"
    source.mkdir()
    row = '{"fileName":"%s","fileSize":1,"mimeType":"text/plain"}'
    for i, names in enumerate((["a", "a", "known", "b"], ["a", "c"], ["b", "d", "d"])):
        (source / f"m{i}.json").write_text("\n".join(row % n for n in names) + "\n")
    known = spark.createDataFrame([("known",)], "fileName string")
    requests = stream_upload_manifests(spark, str(source), files_per_batch=1)
    rows = stream_validate_uploads(requests, *places(spark), key="fileName", existing=known).collect()
    found = sorted((r.fileName, r.outcome) for r in rows)
    assert found == [("a", "accepted"), ("a", "repeated"), ("a", "repeated"), ("b", "accepted"), ("b", "repeated"),
                     ("c", "accepted"), ("d", "accepted"), ("d", "repeated"), ("known", "repeated")]


def test_state_resumes_and_late_rows_stay(spark, tmp_path):
    source = tmp_path / "log"
    path, checkpoint = places(spark)
    rows = [("a", 1, "x"), ("b", 1, "x"), ("a", 9, "y")], [("a", 5, "late"), ("c", 1, "x")], [("b", 2, "z"), (None, 1, "n")]
    schema = "id string, seq int, status string"
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        found = stream_latest_state(log, path, checkpoint, "id", "seq", compact_every=2)
        seen = stream_dedup_uploads(log, f"{path}-once", f"{checkpoint}-once", key="id", moment="seq")
        every = [r for p in rows[: i + 1] for r in p]
        want = {}
        for r in sorted(every, key=lambda r: r[1]):
            want[r[0]] = r
        assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, want.values()))
        assert sorted(str(r.id) for r in seen.collect()) == sorted(str(k) for k in want)


STREAMS = {
    "validate": lambda s, p, c: stream_validate_uploads(s.selectExpr("id AS fileName", "seq AS fileSize", "status AS mimeType"), p, c, key="fileName"),
    "validate_without_key": lambda s, p, c: stream_validate_uploads(s.selectExpr("id AS fileName", "seq AS fileSize", "status AS mimeType"), p, c),
    "state": lambda s, p, c: stream_latest_state(s, p, c, "id", "seq"),
    "dedup": lambda s, p, c: stream_dedup_uploads(s, p, c, key="id", moment="seq"),
    "dedup_within": lambda s, p, c: stream_dedup_within(s, p, c, "3 days", key="id", moment="ts"),
    "quota": lambda s, p, c: stream_quota(s, 1, p, c, account="id", moment="ts"),
    "quota_events": lambda s, p, c: stream_quota_events(s, 1, p, c, account="id", moment="ts", key="seq"),
}


@pytest.mark.parametrize("name", list(STREAMS))
def test_a_stream_may_start_before_its_first_file(spark, tmp_path, name):
    """No rows while the folder is empty, then those of the files that have come."""
    source = tmp_path / "in"
    source.mkdir()
    schema = "id string, seq bigint, status string, ts timestamp_ntz"
    path, checkpoint = places(spark)

    def run():
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        return STREAMS[name](rows, path, checkpoint)

    nothing = run()
    assert nothing.count() == 0
    given = [("a", 1, "text/plain", "2024-01-01 00:00:00"), ("b", 2, "text/plain", "2024-01-02 00:00:00")]
    for row in given:
        spark.createDataFrame([row], "id string, seq bigint, status string, t string").selectExpr(
            "id", "seq", "status", "CAST(t AS timestamp_ntz) AS ts").coalesce(1).write.mode("append").parquet(str(source))
    found = run()
    assert found.columns == nothing.columns and found.count() == 2
    assert run().count() == 2


def test_folders_hold_each_batch_once():
    for last in range(0, 1300):
        held = [b for n in covering(last) for b in range(n - span(n) + 1, n + 1)]
        assert sorted(held) == list(range(last + 1))
        assert len(covering(last)) <= 9 * len(str(last)) + 1


def test_a_batch_reads_the_buckets_it_meets(spark):
    path = shared_path(spark, "keys")
    many = [spark.range(100 * n, 100 * n + 100).select(F.col("id").cast("string").alias("k")) for n in range(12)]
    for n, keys in enumerate(many):
        keep_keys(keys, path, n, "k")
    batch = spark.createDataFrame([("5",), ("1105",), ("new",), (None,)], "k string")
    found = seen_keys(batch, path, 12, "k")
    assert {"5", "1105"} <= {r.k for r in found.collect()} and found.count() < 60
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan
    every = spark.range(1200).select(F.col("id").cast("string").alias("k"))
    assert sorted(r.k for r in seen_keys(every, path, 12, "k").collect()) == sorted(r.k for r in every.collect())


def test_keys_are_forgotten_and_late_rows_set_apart(spark, tmp_path):
    source, (path, checkpoint) = tmp_path / "in", places(spark)
    batches = [
        [("a", "01-10"), ("a", "01-10"), ("b", "01-11"), (None, "01-11"), (None, "01-11"), ("n", None)],
        [("a", "01-11"), ("c", "01-12"), ("old", "01-08"), ("old", "01-01")],  # the watermark is 01-09 here
        [("x", "01-30")],
        [("a", "01-29"), ("b", "01-20"), ("x", "01-29")],  # 01-28: a has been forgotten, b comes too late
    ]
    want = []
    outcomes = [
        ["kept", "repeated", "kept", "kept", "kept", "untimed"], ["repeated", "kept", "late", "late"], ["kept"], ["kept", "late", "repeated"],
    ]
    for rows, names in zip(batches, outcomes):
        spark.createDataFrame([(k, t and f"2024-{t} 00:00:00") for k, t in rows], "r2Key string, t string").selectExpr(
            "r2Key", "CAST(t AS timestamp_ntz) AS createdAt").coalesce(1).write.mode("append").parquet(str(source))
        uploads = spark.readStream.schema("r2Key string, createdAt timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(str(source))
        found = stream_dedup_within(uploads, path, checkpoint, "2 days")
        want += [(k or "-", t or "-", name) for (k, t), name in zip(rows, names)]
        assert sorted((r.r2Key or "-", str(r.createdAt)[5:10] if r.createdAt else "-", r.outcome) for r in found.collect()) == sorted(want)
    keys = spark.read.format("statestore").load(f"{checkpoint}/kept").select("key.r2Key")
    assert {r.r2Key for r in keys.collect()} <= {"a", "x"}


def test_nothing_on_time_is_late_after_the_split(spark, staged):
    path, checkpoint = places(spark)
    rows = split_late(stream(spark, staged), path, checkpoint, "1 hour", "ts")
    assert rows.count() == spark.read.parquet(staged).count()
    found = stream_dedup_within(stream(spark, staged), *places(spark), "1 hour", key="event_id", moment="ts")
    counts = {r.outcome: r["count"] for r in found.groupBy("outcome").count().collect()}
    assert counts["kept"] == rows.where("arrival = 'on_time'").count() and "repeated" not in counts
