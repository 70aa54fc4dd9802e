"""The given tables in the roles of the collection's tables (see FIXTURES.md), always whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.uploads import object_key, session_expires_at
from docquarry.operators.passages import chunk_documents
from docquarry.session import shared_path
from docquarry.schemas import ACCOUNTS, ALLOWED_MIME_TYPES, DOCUMENTS, SESSIONS

NOW = "2024-01-20 00:00:00"
PDF, DOCX, TEXT = ALLOWED_MIME_TYPES


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str, *kinds: str) -> DataFrame:
    rows = table(spark, sf, "events")
    return rows.where(F.col("event_type").isin(*kinds)) if kinds else rows


def late(rows: DataFrame) -> DataFrame:
    """Every tenth event once more, as the first of a kind of its own, two months behind."""
    tenth = rows.where(F.col("event_id") % 10 == 0)
    return tenth.withColumns({
        "event_type": F.concat(F.lit("late-"), _text("event_id")), "ts": F.expr("ts - INTERVAL 60 DAYS"),
    })


def event_stream(spark: SparkSession, sf: str, batches: int = 4, with_late: bool = False) -> DataFrame:
    """The events as a stream of files, in order of time, in micro-batches; late ones at the end.

    Purchases of a value below ten have no user, and clicks below five no time: those come first.
    """
    rows = keyless_events(spark, sf)
    path = shared_path(spark, "events")
    moment = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = rows.select(F.percentile_approx(moment, [i / batches for i in range(1, batches)]).alias("c")).first()["c"] or []
    part = F.lit(0)
    for cut in cuts:
        part = part + F.coalesce(moment > cut, F.lit(False)).cast("int")
    files = 0
    for i in range(batches):
        rows.where(part == i).repartition(2, "event_id").write.mode("append").parquet(path)
        files += 2
    if with_late:
        late(rows).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)


def keyless_events(spark: SparkSession, sf: str) -> DataFrame:
    """The events, some without a user and some without a time."""
    kind, value = F.col("event_type"), F.col("value")
    return table(spark, sf, "events").withColumns({
        "user_id": F.when(~((kind == "purchase") & (value < 10)), F.col("user_id")),
        "ts": F.when(~((kind == "click") & (value < 5)), F.col("ts")),
    })


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def account_email(name: Column, segment: Column) -> Column:
    return F.concat(F.lower(F.replace(name, F.lit("#"), F.lit("."))), F.lit("@"), F.lower(segment), F.lit(".example"))


def accounts(spark: SparkSession, sf: str) -> DataFrame:
    """Customers; created one minute apart."""
    created = F.expr("TIMESTAMP_NTZ '2023-01-01 00:00:00' + make_dt_interval(0, 0, cast(c_custkey AS INT))")
    return table(spark, sf, "customer").select(
        _text("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        account_email(F.col("c_name"), F.col("c_mktsegment")).alias("email"),
        (F.col("c_acctbal") > 0).alias("emailVerified"),
        created.alias("createdAt"),
        created.alias("updatedAt"),
    ).select(*ACCOUNTS.names)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as the document catalog."""
    status = (
        F.when(F.col("o_orderstatus") == "F", "COMPLETED")
        .when(F.col("o_orderstatus") == "P", "PROCESSING")
        .otherwise("PENDING_UPLOAD")
    )
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    mime = F.when(urgent, PDF).when(F.col("o_orderpriority") == "3-MEDIUM", DOCX).otherwise(TEXT)
    none = F.lit(None).cast("string")
    return table(spark, sf, "orders").withColumn("status", status).select(
        _text("o_orderkey").alias("id"),
        F.concat(F.lit("Order "), _text("o_orderkey")).alias("fileName"),
        F.floor("o_totalprice").alias("fileSize"),
        mime.alias("mimeType"),
        object_key(F.col("o_custkey"), F.col("o_orderkey")).alias("r2Key"),
        F.when(F.col("status") != "PENDING_UPLOAD", F.concat(F.lit("up-"), _text("o_orderkey"))).alias("uploadId"),
        "status",
        none.alias("failureReason"),
        none.alias("errorMessage"),
        _text("o_custkey").alias("userId"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("createdAt"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("updatedAt"),
    ).select(*DOCUMENTS.names)


def log_columns(rows: DataFrame) -> DataFrame:
    """Events as changes of the document numbered like the event's user."""
    kind, value = F.col("event_type"), F.col("value")
    status = (
        F.when(kind == "signup", "PENDING_UPLOAD")
        .when(kind == "view", "UPLOAD_COMPLETED")
        .when(kind == "click", "QUEUED")
        .when(kind == "purchase", "COMPLETED")
        .otherwise("FAILED")
    )
    code = F.concat(F.lit("code "), F.get_json_object("props", "$.k"))
    return rows.select(
        _text("user_id").alias("id"),
        F.col("event_id").alias("seq"),
        F.col("ts").alias("updatedAt"),
        status.alias("status"),
        object_key(F.col("user_id"), F.col("user_id")).alias("r2Key"),
        F.when(value >= 10, F.concat(F.lit("up-"), _text("event_id"))).alias("uploadId"),
        F.when((kind == "error") & (value < 25), code).alias("errorMessage"),
    )


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf, "signup").select(
        F.concat(F.lit("s"), _text("event_id")).alias("id"),
        _text("event_id").alias("token"),
        _text("user_id").alias("userId"),
        session_expires_at(F.col("ts")).alias("expiresAt"),
        F.col("ts").alias("createdAt"),
    ).select(*SESSIONS.names)


def refresh_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks asking for the session of an event before, up to three for the same one; cheap ones have no token."""
    return events(spark, sf, "click").select(
        _text("event_id").alias("requestId"),
        F.when(F.col("value") >= 2, (F.col("event_id") - 1 - F.col("event_id") % 3).cast("string")).alias("token"),
        F.concat(F.lit("new-"), _text("event_id")).alias("newToken"),
        F.col("ts").alias("requestedAt"),
    )


def _with_customer(rows: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    return rows.join(table(spark, sf, "customer"), F.col("user_id") == F.col("c_custkey"))


def signup_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Sign-ups with the email of a customer, a new one that comes again and again, or a broken one."""
    known = account_email(F.col("c_name"), F.col("c_mktsegment"))
    fresh = F.concat(F.lit("new."), _text("user_id"), F.lit("@example.com"))
    email = F.when(F.col("value") < 20, known).when(F.col("value") < 90, fresh).otherwise(F.concat(fresh, F.lit("@")))
    return _with_customer(events(spark, sf, "signup"), spark, sf).select(
        F.col("event_id").alias("requestId"),
        F.col("c_name").alias("name"),
        email.alias("email"),
        F.concat(F.lit("t"), _text("event_id")).alias("token"),
        F.col("ts").alias("requestedAt"),
    )


def login_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks as login attempts: known emails, a wrong one that many use, or none."""
    known, value = account_email(F.col("c_name"), F.col("c_mktsegment")), F.col("value")
    email = F.when(value < 5, "").when(value < 40, known).when(value < 80, "nobody@example.com")
    return _with_customer(events(spark, sf, "click"), spark, sf).select(
        F.col("event_id").alias("attemptId"),
        email.alias("email"),
        F.concat(F.lit("t"), _text("event_id")).alias("token"),
        F.col("ts").alias("attemptedAt"),
    )


def uploads(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as upload requests with names, sizes and types of every kind, good and bad."""
    size = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(F.floor("o_totalprice").cast("double"))
    signed = F.when(F.col("o_orderpriority") == "5-LOW", -size).otherwise(size)
    mime = (
        F.when(F.col("o_orderpriority") == "1-URGENT", PDF)
        .when(F.col("o_orderpriority") == "2-HIGH", DOCX)
        .when(F.col("o_orderpriority") == "3-MEDIUM", "text/csv")
        .otherwise(TEXT)
    )
    return table(spark, sf, "orders").select(
        _text("o_orderkey").alias("requestId"),
        _text("o_custkey").alias("userId"),
        F.expr("repeat(o_orderpriority, cast(o_totalprice / 10000 AS INT))").alias("fileName"),
        signed.alias("fileSize"),
        mime.alias("mimeType"),
    )


def manifest_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as lines of an upload manifest; each language breaks it in its own way, English ones repeat a field."""
    number, size = _text("doc_id"), _text("n_chars")
    name = F.concat(F.lit('"doc-'), number, F.lit('.txt"'))
    lang = F.col("lang")
    return table(spark, sf, "documents").select(
        F.concat(
            F.lit('{"fileName":'),
            F.when(lang == "es", number).when(lang == "en", F.lit("0")).otherwise(name),
            F.lit(',"fileSize":'),
            F.when(lang == "fr", F.concat(F.lit('"'), size, F.lit('"')))
            .when(lang == "de", F.concat(size, F.lit(".5")))
            .otherwise(size),
            F.when(lang == "en", F.concat(F.lit(',"fileName":'), name)).otherwise(""),
            F.lit(',"mimeType":"text/plain"'),
            F.when(F.col("source") == "src0", "").otherwise("}"),
        ).alias("value")
    )


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Dealt out by id over all shuffle partitions, since the work on a text is heavy and a small table is one file."""
    return table(spark, sf, "documents").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def csv_files(spark: SparkSession, sf: str) -> DataFrame:
    """Each text as a field of a CSV file of two records, its quotes doubled and its line breaks as they are."""
    quoted = F.replace("text", F.lit('"'), F.lit('""'))
    return texts(spark, sf).select("doc_id", F.concat(
        F.lit('id,"the ""note""",lang\r\n'), _text("doc_id"), F.lit(',"'), quoted, F.lit('",'), "lang", F.lit('\r\n\r\n"",plain, x\r\n')
    ).alias("text"))


def markdown_files(spark: SparkSession, sf: str) -> DataFrame:
    """Each text, without marks of its own, as a section of a Markdown file and as a fenced block of another."""
    body = F.translate("text", "#`~", "")
    return texts(spark, sf).select("doc_id", F.concat(
        F.lit("# "), "source", F.lit("\n\n"), body, F.lit("\n\n## "), "lang", F.lit(" ##\n```\n# not a heading\n"), body,
        F.lit("\n```\n### Deep\nend "), _text("doc_id"), F.lit("\n# Last\n\n"),
    ).alias("text"))


def received_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as uploaded parts; many are sent more than once, some with a number that cannot be or none."""
    number, quantity = F.col("l_linenumber"), F.col("l_quantity")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("documentId"),
        F.when(quantity == 1, number + 10_000).when(quantity == 2, -number).when(quantity != 3, number).alias("partNumber"),
        F.md5(_text("l_partkey")).alias("etag"),
    )


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_documents(texts(spark, sf).select("doc_id", "source", "text"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").withColumnRenamed("embedding", "vector")


def gappy_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The texts, every eleventh null."""
    return texts(spark, sf).withColumn("text", F.when(F.col("doc_id") % 11 != 5, F.col("text")))


def all_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark text as a question."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), "text")


def benchmark_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark texts as questions, every ninth without a word and every seventh null."""
    number = F.col("question_id")
    return all_questions(spark, sf).withColumn("text", F.when(number % 9 == 4, "???").when(number % 7 != 3, F.col("text")))


def conversation_questions(spark: SparkSession, sf: str) -> DataFrame:
    """What users said, as questions."""
    turns = table(spark, sf, "conversations").where(F.col("role") == "user")
    return turns.select("conv_id", F.concat_ws(":", "conv_id", "turn").alias("question_id"), "text")
