import datetime as dt
from pathlib import Path
from urllib.parse import unquote, urlparse

import pytest
from pyspark.sql import functions as F

from docquarry.functions.uploads import (
    access_expires_at,
    checked_part_size,
    current_status,
    error_text,
    object_key,
    relative_age,
    row_id,
    session_expires_at,
    status_label,
)
from docquarry.plans.refresh import refresh_sessions
from docquarry.operators import catalog, parts, sessions
from docquarry.plans.intake import initialize_uploads
from docquarry.plans.registry import QUERIES
from docquarry.schemas import DOCUMENTS, UPLOAD_STATUSES
from docquarry.session import shared_path
from docquarry.sources.files import scan_document_files, write_text_files
from docquarry.sources.tables import append_documents

T0 = dt.datetime(2024, 1, 1)


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("_"))
    return df.select(column).head()[0]


def test_name_search_is_literal_and_keeps_all_for_the_empty_text(spark):
    df = spark.createDataFrame([(1, "100% Sure_Thing.pdf"), (2, "1000 sure things"), (3, None)], "id int, fileName string")
    assert ids(catalog.search_documents_by_name(df, "0% sURE_")) == [1]
    assert ids(catalog.search_documents_by_name(df, "")) == [1, 2, 3]
    assert ids(catalog.search_documents_by_name(df, "_")) == [1]


def test_session_that_ends_now_is_live(spark):
    df = spark.createDataFrame(
        [("a", "u", T0), ("b", "u", T0 - dt.timedelta(milliseconds=1)), ("c", "v", T0 - dt.timedelta(days=1))],
        "id string, userId string, expiresAt timestamp_ntz",
    )
    assert ids(sessions.live_sessions(df, T0)) == ["a"]
    assert ids(sessions.expired_sessions(df, T0)) == ["b", "c"]
    assert ids(sessions.expired_sessions(df, T0, "u")) == ["b"]


def test_orphans(spark):
    child = spark.createDataFrame([(1, "a"), (2, "x"), (3, None), (4, "x")], "n int, userId string")
    parent = spark.createDataFrame([("a",), ("a",), ("b",)], "id string")
    assert ids(catalog.orphan_rows(child, parent, "userId"), "n") == [2, 4]


def test_cascade_and_delete(spark):
    child = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "n int, userId string")
    gone = spark.createDataFrame([("a",), ("a",), ("nobody",), (None,)], "id string")
    assert ids(catalog.cascade_delete(gone, child), "n") == [2, 3]
    assert ids(catalog.delete_where(child, F.col("userId") == "a"), "n") == [2, 3]


def test_upsert_keeps_keys_unique_and_last_change_wins(spark):
    schema = "id string, v int, at int"
    base = spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], schema)
    changes = spark.createDataFrame([("a", 9, 2), ("a", 8, 1), ("c", 7, 1), ("c", 6, 3)], schema)
    after = catalog.upsert_rows(base, changes, "id", "at", "v")
    assert sorted(map(tuple, after.collect())) == [("a", 9, 2), ("b", 2, 0), ("c", 6, 3)]
    assert sorted(map(tuple, catalog.upsert_rows(base, changes.limit(0), "id", "at").collect())) == [("a", 1, 0), ("b", 2, 0)]


def test_new_accounts_compare_emails_as_written(spark):
    schema = "id int, email string"
    known = spark.createDataFrame([(0, "a@b.co")], schema)
    incoming = spark.createDataFrame([(3, "a@b.co"), (2, "A@b.co"), (1, "x@y.co"), (4, "x@y.co"), (5, None)], schema)
    assert ids(catalog.new_accounts(incoming, known, "id")) == [1, 2]


def test_a_hot_key_is_reduced_before_the_shuffle(spark):
    """A third of the changes hit one key; each task sends one row of it on."""
    log = spark.range(90_000, numPartitions=4).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("id"),
        F.col("id").alias("seq"),
        F.lit(T0).alias("updatedAt"),
    )
    newest = catalog.latest_document_state(log)
    assert newest.where("id = 'hot'").head().seq == 89_997
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_max_by") > plan.index("Exchange hashpartitioning")


def test_refresh_outcomes(spark):
    store = spark.createDataFrame(
        [("s1", "t1", "u", T0), ("s2", "t2", "v", T0 - dt.timedelta(seconds=1)), ("s3", "\x0042", "w", T0)],
        "id string, token string, userId string, expiresAt timestamp_ntz",
    )
    asked = spark.createDataFrame(
        [("1", "t1", T0), ("2", "t2", T0), ("3", "t9", T0), ("42", None, T0), ("5", "", T0), ("6", "t1", T0), ("7", "t2", T0 + dt.timedelta(1)),
         ("8", "t9", T0)],
        "requestId string, token string, requestedAt timestamp_ntz",
    )
    rows = sessions.refresh_outcomes(asked, store, T0).collect()
    assert {r.requestId: (r.outcome, r.sessionId, r.userId) for r in rows} == {
        "1": ("valid", "s1", "u"),
        "2": ("expired", "s2", "v"),
        "3": ("unknown", None, None),
        "42": ("missing", None, None),
        "5": ("missing", None, None),
        "6": ("unknown", None, None),
        "7": ("unknown", None, None),
        "8": ("unknown", None, None),
    }


def test_sessions_and_outcomes_of_a_batch_agree(spark):
    """Of requests at one moment the smaller key is first, whatever the new tokens are."""
    store = spark.createDataFrame(
        [("s1", "t1", "u", T0, T0)], "id string, token string, userId string, expiresAt timestamp_ntz, createdAt timestamp_ntz"
    )
    asked = spark.createDataFrame(
        [("1", "t1", "z", T0), ("2", "t1", "a", T0), ("0", "t1", "b", T0 + dt.timedelta(1))],
        "requestId string, token string, newToken string, requestedAt timestamp_ntz",
    )
    after, outcomes = refresh_sessions(asked, store, T0)
    assert {r.requestId: r.outcome for r in outcomes.collect()} == {"1": "valid", "2": "unknown", "0": "unknown"}
    assert [r.token for r in after.collect()] == ["z"]


def test_upsert_keeps_rows_without_a_key(spark):
    base = spark.createDataFrame([("a", 1), ("b", 1), (None, 1)], "id string, n int")
    changes = spark.createDataFrame([("a", 2, 1), ("a", 3, 2), ("c", 9, 1), (None, 7, 1), ("b", None, 1)], "id string, n int, seq int")
    got = catalog.upsert_rows(base, changes, "id", "seq").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [("a", 3), ("b", None), ("c", 9), (None, 1), (None, 7)]))


def test_failed_for(spark):
    rows = spark.createDataFrame([("a", "FAILED", "EMPTY_DOCUMENT"), ("b", "FAILED", None), ("c", "QUEUED", "EMPTY_DOCUMENT")], "id string, status string, failureReason string")
    assert ids(catalog.documents_failed_for(rows, ["EMPTY_DOCUMENT"])) == ["a"]
    with pytest.raises(ValueError):
        catalog.documents_failed_for(rows, ["NONE"])


def test_rows_without_a_key_are_reported(spark):
    rows = spark.createDataFrame([("a", 1), (None, 2), ("a", 0), (None, 2)], "id string, n int")
    assert catalog.new_rows(rows, rows.limit(0), "id", "n").count() + catalog.keyless_rows(rows, "id").count() == 3


def test_rotation_replaces_token_and_end_only(spark):
    store = spark.createDataFrame(
        [("s1", "t1", "u", T0, T0), ("s2", "t2", "v", T0, T0)],
        "id string, token string, userId string, expiresAt timestamp_ntz, createdAt timestamp_ntz",
    )
    turns = spark.createDataFrame(
        [("t1", "late", T0 + dt.timedelta(hours=2)), ("t1", "early", T0 + dt.timedelta(hours=1))],
        "token string, newToken string, rotatedAt timestamp_ntz",
    )
    rows = {r.id: (r.token, r.userId, r.expiresAt, r.createdAt) for r in sessions.rotate_sessions(store, turns).collect()}
    assert rows == {
        "s1": ("early", "u", T0 + dt.timedelta(days=7, hours=1), T0),
        "s2": ("t2", "v", T0, T0),
    }


def test_scalar_functions(spark):
    assert one(spark, object_key(F.col("u"), F.col("d")), u="u1", d="d1") == "documents/u1/d1"
    assert one(spark, object_key(F.lit(None).cast("string"), F.col("d")), d="d1") is None
    assert one(spark, row_id(F.lit("a"), F.lit(None).cast("string"))) != one(spark, row_id(F.lit(None).cast("string"), F.lit("a")))
    assert one(spark, error_text(F.lit(None).cast("string"))) == "Upload initialization failed"
    assert one(spark, error_text(F.lit("x"))) == "x"
    assert one(spark, current_status(F.lit("PROCESSING_VECTORS"))) == "PROCESSING"
    labels = [one(spark, status_label(F.lit(s))) for s in UPLOAD_STATUSES]
    assert labels == ["Processing"] * 5 + ["Ready", "Failed"]
    start = F.lit(T0).cast("timestamp_ntz")
    assert one(spark, session_expires_at(start)) == T0 + dt.timedelta(days=7)
    assert one(spark, access_expires_at(start)) == T0 + dt.timedelta(minutes=15)


@pytest.mark.parametrize(
    ("ago", "text"),
    [
        (dt.timedelta(days=2), "2 days ago"),
        (dt.timedelta(days=1), "1 day ago"),
        (dt.timedelta(hours=23, minutes=59), "23 hours ago"),
        (dt.timedelta(hours=1), "1 hour ago"),
        (dt.timedelta(minutes=15), "15 minutes ago"),
        (dt.timedelta(seconds=59), "just now"),
    ],
)
def test_relative_age(spark, ago, text):
    assert one(spark, relative_age(F.lit(T0 - ago).cast("timestamp_ntz"), T0)) == text


@pytest.mark.parametrize("size", [0, -1, float("nan"), float("inf"), 1.5])
def test_part_size_is_checked_before_a_job(size):
    with pytest.raises(ValueError):
        checked_part_size(size)


def test_parts_sum_to_the_file(spark):
    files = spark.createDataFrame(
        [("a", 1), ("b", 10), ("c", 11), ("d", 100_000), ("e", 100_001), ("f", 0), ("g", None)], "id string, fileSize bigint"
    )
    plan = parts.plan_parts(files, 10)
    found = plan.groupBy("id").agg(F.count("*").alias("n"), F.sum("byteLength").alias("bytes"), F.max("partNumber").alias("last"))
    assert {r.id: (r.n, r.bytes, r.last) for r in found.collect()} == {
        "a": (1, 1, 1),
        "b": (1, 10, 1),
        "c": (2, 11, 2),
        "d": (10_000, 100_000, 10_000),
        "e": (1, None, None),
        "f": (1, None, None),
        "g": (1, None, None),
    }
    assert {r.id: (r.error, r.totalParts) for r in plan.where("error is not null").collect()} == {
        "e": ("too_many_parts", 10_001), "f": ("empty", 0), "g": ("no_size", None),
    }
    assert ids(parts.oversized_uploads(files, 10)) == ["e"]


def test_part_manifest(spark):
    received = spark.createDataFrame(
        [("a", 2, "y"), ("a", 1, "x"), ("a", 2, "z"), ("b", 2, "q"), ("c", 0, "q"), ("c", 1, "r"), ("d", 10_001, "q"), ("e", None, "q")],
        "documentId string, partNumber int, etag string",
    )
    rows = {r.documentId: ([tuple(p) for p in r.parts], r.receivedParts, r.invalidParts, r.complete) for r in parts.part_manifest(received).collect()}
    assert rows["a"] == ([(1, "x"), (2, "z")], 2, 0, True)
    assert rows["b"] == ([(2, "q")], 1, 0, False)
    assert rows["c"] == ([(0, "q"), (1, "r")], 1, 1, False)
    assert rows["d"] == ([(10_001, "q")], 0, 1, False)
    assert rows["e"] == ([(None, "q")], 0, 1, False)


def test_a_part_sent_very_often_stays_one(spark):
    received = spark.range(60_000, numPartitions=4).select(
        F.lit("a").alias("documentId"), F.lit(1).alias("partNumber"), F.col("id").cast("string").alias("etag")
    )
    row = parts.part_manifest(received).head()
    assert (len(row.parts), row.complete) == (1, True)


def _requests(spark):
    return spark.createDataFrame(
        [("r1", "u", "a.pdf", 25.0, "application/pdf"), ("r2", "u", "", 25.0, "application/pdf"), ("r3", "v", "b", 1e6, "application/pdf")],
        "requestId string, userId string, fileName string, fileSize double, mimeType string",
    )


def test_intake_run_twice_adds_nothing(spark):
    path = f"{shared_path(spark, 'catalog')}/documents"
    append_documents(spark.createDataFrame([], DOCUMENTS), path)
    counts = []
    for _ in range(2):
        stored = spark.read.schema(DOCUMENTS).parquet(path)
        fresh, planned, rejected = initialize_uploads(_requests(spark), stored, T0, part_size=10)
        counts.append((fresh.count(), planned.count(), rejected.count()))
        append_documents(fresh, path)
    assert counts == [(1, 3, 2), (0, 0, 2)]
    row = spark.read.schema(DOCUMENTS).parquet(path).collect()
    assert len(row) == 1 and row[0].r2Key == f"documents/u/{row[0].id}" and row[0].status == "PENDING_UPLOAD"


def test_status_filter_prunes_folders(spark, sf):
    from docquarry.plans import standins

    path = f"{shared_path(spark, 'catalog')}/documents"
    append_documents(standins.documents(spark, sf), path)
    stored = spark.read.schema(DOCUMENTS).parquet(path)
    plan = catalog.documents_in_status(stored, ["COMPLETED"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(status" in plan or "PartitionFilters: [(status" in plan
    plan = catalog.documents_of_account(stored, "7")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(userId), EqualTo(userId,7)]" in plan
    with pytest.raises(ValueError):
        catalog.documents_in_status(stored, ["NO_SUCH"])


def test_scan_of_stored_files(spark, tmp_path):
    """The empty file is no upload and is not listed."""
    for user, document, body in [("u1", "d1", b"hello"), ("u1", "d2", b""), ("u2", "d3", b"\xff")]:
        folder = tmp_path / "documents" / user
        folder.mkdir(parents=True, exist_ok=True)
        (folder / document).write_bytes(body)
    rows = scan_document_files(spark, str(tmp_path)).collect()
    assert sorted((r.userId, r.documentId, r.fileSize, bytes(r.content)) for r in rows) == [
        ("u1", "d1", 5, b"hello"),
        ("u2", "d3", 1, b"\xff"),
    ]
    assert "content" not in scan_document_files(spark, str(tmp_path), content=False).columns


def test_the_store_is_written_by_several_tasks(spark, tmp_path):
    """Even if all texts lie in one row group; rows of one id are one file, as before."""
    rows = [(i, f"text {i}") for i in range(40)] + [(7, "again"), (None, "none"), (3, None)]
    given = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    given.write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["scan_document_files"](spark, str(tmp_path))
    sizes = {r.userId: r.fileSize for r in found.collect()}
    assert len(sizes) == 41 and sizes["doc_id=0"] == 7 and sizes["doc_id=7"] == 13 and sizes["doc_id=3"] == 8
    tasks = {path.rsplit("/", 1)[1].split("-")[1] for path in found.inputFiles()}
    assert len(tasks) > 1


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    """Not by one for each folder; the session's own setting stays."""
    for n in range(60):
        (tmp_path / "documents" / f"u{n}").mkdir(parents=True)
        (tmp_path / "documents" / f"u{n}" / "d").write_bytes(b"x" * (n + 1))
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, status = spark.conf.get(setting), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        rows = scan_document_files(spark, str(tmp_path), content=False)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [s for job in status.getJobIdsForGroup("listing") for s in status.getJobInfo(job).stageIds]
    assert [status.getStageInfo(s).numTasks for s in stages] == [int(spark.conf.get("spark.sql.shuffle.partitions"))]
    assert spark.conf.get(setting) == before
    assert sorted((r.userId, r.fileSize) for r in rows.collect()) == sorted((f"u{n}", n + 1) for n in range(60))


def _stored(root):
    """Folder and bytes of every file that is no mark or check sum of the writer."""
    files = [f for f in root.rglob("*") if f.is_file()]
    return sorted((f.parent.name, f.read_bytes()) for f in files if f.name[0] not in "._")


def test_the_store_is_made_by_the_workers(spark, tmp_path):
    """Hadoop's local file system starts a process for each folder and file; its check sum files tell that it was used."""
    rows = [(i, f"text {i}") for i in range(20)] + [(7, "text 7"), (None, None), (21, ""), (22, "a\n\u00fc\U0001f600\n")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/in/documents.parquet")
    found = QUERIES["scan_document_files"](spark, f"{tmp_path}/in")
    paths = [unquote(urlparse(p).path) for p in found.inputFiles()]
    store = Path(paths[0]).parent.parent
    assert {f.name[0] for f in store.rglob("*") if f.is_file()} == {"p"}
    by_folder = dict(_stored(store))
    assert len(by_folder) == len(paths) == 23
    assert by_folder["doc_id=7"] == b"text 7\ntext 7\n" and by_folder["doc_id=__HIVE_DEFAULT_PARTITION__"] == b"\n"
    assert by_folder["doc_id=21"] == b"\n" and by_folder["doc_id=22"] == "a\n\u00fc\U0001f600\n\n".encode()
    assert sorted(r.userId for r in found.collect()) == sorted(by_folder)


def test_text_files_are_those_of_sparks_writer(spark, tmp_path):
    """A store that only Spark opens is left to Spark's writer; the same folders and bytes come out."""
    rows = [(i % 9, f"text {i % 9}") for i in range(30)] + [(None, "x"), (None, "x"), (-3, None), (40, "\r\n ")]
    given = spark.createDataFrame(rows, "doc_id long, value string").repartition(3, "doc_id")
    (tmp_path / "remote").mkdir()
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.files.link./in", f"file://{tmp_path}/remote")
    write_text_files(given, "doc_id", f"{tmp_path}/mounted")
    write_text_files(given, "doc_id", "viewfs://files/in/store")
    given.write.partitionBy("doc_id").text(f"{tmp_path}/plain")
    mounted, remote, plain = (_stored(tmp_path / at) for at in ("mounted", "remote/store", "plain"))
    assert mounted == remote == plain and len(plain) == 12
    none = given.where("doc_id > 100")
    write_text_files(none, "doc_id", f"{tmp_path}/none/documents")
    assert scan_document_files(spark, f"{tmp_path}/none").collect() == []
