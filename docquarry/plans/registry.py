"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.uploads import object_key, row_id
from docquarry.operators import answers, catalog, cells, parts, passages, postings, retrieval, sessions, structured, substrings, terms, threads, usage, validation
from docquarry.operators.vectors import embed_chunks as embed
from docquarry.plans import standins as given
from docquarry.plans.accounts import log_in, sign_up
from docquarry.plans.ask import answer_from_texts, build_passage_table, find_passages
from docquarry.plans.ask import answer_questions as answer
from docquarry.plans.intake import initialize_uploads as initialize
from docquarry.plans.refresh import refresh_sessions as refresh
from docquarry.plans.standins import NOW
from docquarry.session import shared_path
from docquarry.sources import changes
from docquarry.sources.files import key_part
from docquarry.sources.files import scan_document_files as scan
from docquarry.sources.files import write_text_files
from docquarry.sources.manifests import read_upload_manifest as read_manifest
from docquarry.sources.tables import append_documents as append
from docquarry.sources.tables import find_by_key
from docquarry.sources.tables import read_tables as read_stored
from docquarry.sources.tables import write_new_version
from docquarry.streaming import late, months, quota, state
from docquarry.streaming import uploads as upload_streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PART_SIZE = 1_000
MAX_BYTES = 300_000
LIMIT = 50
WORDS = ["the", "estion", "queaux"]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# -- sources and sinks ----------------------------------------------------------------------------

@query
def read_tables(spark, sf):
    """Writes the three tables, reads them back with their declared schemas, and gives every row."""
    path = shared_path(spark, "tables")
    write_new_version(given.accounts(spark, sf), f"{path}/accounts")
    write_new_version(given.sessions(spark, sf), f"{path}/sessions")
    append(given.documents(spark, sf), f"{path}/documents")
    stored = read_stored(spark, path)
    shown = {
        "accounts": ["name", "email", "emailVerified"],
        "sessions": ["token", "userId", "expiresAt"],
        "documents": ["fileName", "fileSize", "mimeType", "r2Key", "uploadId", "status", "userId"],
    }

    def spelt(c):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss") if c == "expiresAt" else F.coalesce(F.col(c).cast("string"), F.lit("-"))

    rows = [
        table.select(F.lit(name).alias("stored"), "id", F.concat_ws("|", *map(spelt, shown[name])).alias("content"), "createdAt")
        for name, table in stored.items()
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query
def read_upload_manifest(spark, sf):
    path = shared_path(spark, "manifest")
    given.manifest_lines(spark, sf).write.text(path)
    return read_manifest(spark, path)


@query
def scan_document_files(spark, sf):
    """Texts stored as files, a folder for each; every file with its size and the hash of its content.

    Making the files is the work, so the texts are dealt out over the tasks.
    """
    path = shared_path(spark, "store")
    write_text_files(given.texts(spark, sf).select("doc_id", F.col("text").alias("value")), "doc_id", f"{path}/documents")
    return scan(spark, path).where(F.col("userId").startswith("doc_id=")).select(
        "userId", "fileSize", F.sha2("content", 256).alias("hash")
    )


@query
def append_documents(spark, sf):
    """Appends the catalog twice; the second time only what is new, which is nothing."""
    path = f"{shared_path(spark, 'catalog')}/documents"
    rows = given.documents(spark, sf)
    append(rows, path)
    stored = spark.read.schema(rows.schema).parquet(path)
    append(catalog.new_rows(rows, stored, "id", "createdAt"), path)
    again = spark.read.schema(rows.schema).parquet(path)
    return again.select("id", "fileName", "fileSize", "mimeType", "r2Key", "uploadId", "status", "userId", "createdAt")


# -- validation --------------------------------------------------------------------------------------

def _checked(spark, sf):
    return validation.validate_uploads(given.uploads(spark, sf), max_bytes=MAX_BYTES)


@query
def validate_uploads(spark, sf):
    return validation.error_rows(_checked(spark, sf), "requestId")


@query
def split_accepted(spark, sf):
    return validation.split_accepted_rejected(_checked(spark, sf), shared_path(spark, "checked"))[0]


@query
def split_rejected(spark, sf):
    rejected = validation.split_accepted_rejected(_checked(spark, sf), shared_path(spark, "checked"))[1]
    return rejected.select("requestId", "userId", "fileName", "fileSize", "mimeType", F.size("errors").alias("failed"))


@query
def validate_accounts(spark, sf):
    """Customers as sign-ups; names shrink and emails break with the nation."""
    nation, email = F.col("c_nationkey"), given.account_email(F.col("c_name"), F.col("c_mktsegment"))
    requests = given.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.substring("c_name", F.lit(1), nation).alias("name"),
        F.when(nation == 1, F.concat(F.lit("."), email))
        .when(nation == 2, F.replace(email, F.lit("."), F.lit("..")))
        .when(nation == 3, F.replace(email, F.lit("@"), F.lit(" ")))
        .when(nation == 4, F.replace(email, F.lit(".example"), F.lit(".e")))
        .when(nation == 5, F.concat(email, F.lit("\n")))
        .when(nation != 6, email)
        .alias("email"),
    )
    return validation.error_rows(validation.validate_accounts(requests), "id")


def _intake(spark, sf):
    """Orders as requests, some of them stored before."""
    known = catalog.documents_in_status(given.documents(spark, sf), ["COMPLETED", "PROCESSING"])
    existing = known.select(row_id(F.col("userId"), F.col("id")).alias("id"))
    return initialize(given.uploads(spark, sf), existing, NOW, part_size=65_536)


@query
def initialize_uploads(spark, sf):
    """Catalog rows of the new uploads."""
    return _intake(spark, sf)[0].drop("uploadId", "failureReason", "errorMessage", "updatedAt")


@query
def initialize_upload_parts(spark, sf):
    """The parts to send for them."""
    return _intake(spark, sf)[1]


# -- catalog -----------------------------------------------------------------------------------------

@query
def search_documents_by_name(spark, sf):
    named = given.table(spark, sf, "part").select("p_partkey", "p_name")
    return catalog.search_documents_by_name(named, "MALL R", column="p_name")


@query
def search_indexed_names(spark, sf):
    """The same through the stored grams of the names."""
    named = given.table(spark, sf, "part").select("p_partkey", "p_name")
    return substrings.search_substring(substrings.build_grams(named, shared_path(spark, "grams"), "p_name", 16), "MALL R")


@query
def public_accounts(spark, sf):
    return catalog.public_accounts(given.accounts(spark, sf))


@query
def document_cards(spark, sf):
    return catalog.document_cards(given.documents(spark, sf), NOW)


@query
def recent_cards(spark, sf):
    """Cards of the change log's newest states: ages of minutes, hours and days, one and many."""
    newest = catalog.latest_document_state(given.log_columns(given.events(spark, sf)))
    named = newest.select("id", F.col("r2Key").alias("fileName"), "status", F.col("updatedAt").alias("createdAt"))
    return catalog.document_cards(named, "2024-01-31 00:00:00")


@query
def documents_of_account(spark, sf):
    return catalog.documents_of_account(given.documents(spark, sf), "7").select("id", "r2Key", "status", "createdAt")


@query
def documents_in_status(spark, sf):
    waiting = catalog.documents_in_status(given.documents(spark, sf), ["PENDING_UPLOAD", "PROCESSING"])
    return waiting.select("id", "status", "uploadId", "createdAt")


@query
def lookup_by_key(spark, sf):
    """Accounts named by the events."""
    asked = given.events(spark, sf).select(F.col("user_id").cast("string").alias("id"))
    return catalog.lookup_by_key(asked, given.accounts(spark, sf), "id").select("id", "email")


@query
def lookup_stored_keys(spark, sf):
    """The same from accounts stored with Bloom filters on their keys, and one of them by a literal email."""
    path = f"{shared_path(spark, 'keyed')}/accounts"
    rows = given.accounts(spark, sf)
    write_new_version(rows.repartition(8, "id"), path, keys={"id": 100_000, "email": 100_000})
    stored = spark.read.schema(rows.schema).parquet(path)
    asked = given.events(spark, sf).select(F.col("user_id").cast("string").alias("id"))
    last = rows.agg(F.max_by("email", "createdAt")).first()[0]
    found = catalog.lookup_by_key(asked, stored, "id").select("id", "email", F.lit("batch").alias("way"))
    return found.unionByName(find_by_key(stored, "email", last).select("id", "email", F.lit("literal").alias("way")))


@query
def new_accounts(spark, sf):
    requests = given.signup_requests(spark, sf)
    return catalog.new_accounts(requests, given.accounts(spark, sf), "requestedAt", "requestId")


@query
def sign_up_outcomes(spark, sf):
    return sign_up(given.signup_requests(spark, sf), given.accounts(spark, sf))[2]


@query
def sign_up_rows(spark, sf):
    """The new accounts, each with its first session."""
    accounts, first, _ = sign_up(given.signup_requests(spark, sf), given.accounts(spark, sf))
    owners = accounts.select(F.col("id").alias("userId"), "name", "email", "emailVerified")
    return owners.join(first.drop("id"), "userId")


@query
def account_documents(spark, sf):
    owned = catalog.account_documents(given.accounts(spark, sf), given.documents(spark, sf))
    return owned.select("id", "fileName", "status", "userId", "userName", "userEmail")


@query
def account_sessions(spark, sf):
    owned = catalog.account_sessions(given.accounts(spark, sf), given.sessions(spark, sf))
    return owned.select("id", "expiresAt", "userId", "userName")


@query
def inactive_accounts(spark, sf):
    active = given.events(spark, sf).select(F.col("user_id").cast("string").alias("user"))
    return catalog.orphan_rows(given.accounts(spark, sf), active, "id", "user").select("id", "name")


@query
def cascade_delete(spark, sf):
    """Documents left once every account that signed up is deleted."""
    deleted = given.sessions(spark, sf).select(F.col("userId").alias("id"))
    return catalog.cascade_delete(deleted, given.documents(spark, sf)).select("id", "userId", "status")


@query
def upsert_accounts(spark, sf):
    """Accounts with the time of their last event as ``updatedAt``."""
    base = given.accounts(spark, sf)
    owner = base.select("id", "name", "email", "emailVerified", "createdAt")
    seen = given.events(spark, sf).select(F.col("user_id").cast("string").alias("id"), F.col("ts").alias("updatedAt"), "event_id")
    return catalog.upsert_rows(base, seen.join(owner, "id"), "id", "updatedAt", "event_id").select("id", "name", "emailVerified", "updatedAt")


BUCKETS = 16


@query
def upsert_stored_accounts(spark, sf):
    """The same on a stored table, of which only the buckets that changes fall into are written."""
    base, path = given.accounts(spark, sf), f"{shared_path(spark, 'bucketed')}/accounts"
    changes.write_bucketed(base, path, "id", BUCKETS)
    owner = base.select("id", "name", "email", "emailVerified", "createdAt")
    seen = given.events(spark, sf).select(F.col("user_id").cast("string").alias("id"), F.col("ts").alias("updatedAt"), "event_id")
    changes.upsert_in_place(spark, path, base.schema, seen.join(owner, "id"), "id", "updatedAt", "event_id", buckets=BUCKETS)
    return changes.read_bucketed(spark, path, base.schema).select("id", "name", "emailVerified", "updatedAt")


@query
def delete_stored_accounts(spark, sf):
    """The accounts that no event names, left when all that one names are deleted in place."""
    base, path = given.accounts(spark, sf), f"{shared_path(spark, 'bucketed')}/accounts"
    changes.write_bucketed(base, path, "id", BUCKETS)
    named = given.events(spark, sf).select(F.col("user_id").cast("string").alias("id"))
    changes.delete_in_place(spark, path, base.schema, named, "id", BUCKETS)
    return changes.read_bucketed(spark, path, base.schema).select("id", "name")


@query
def latest_document_state(spark, sf):
    return catalog.latest_document_state(given.log_columns(given.events(spark, sf)))


@query
def abort_candidates(spark, sf):
    return catalog.abort_candidates(catalog.latest_document_state(given.log_columns(given.events(spark, sf))))


@query
def document_status_counts(spark, sf):
    return catalog.document_status_counts(given.documents(spark, sf))


@query
def document_status_table(spark, sf):
    return catalog.document_status_table(given.documents(spark, sf))


# -- sessions ----------------------------------------------------------------------------------------

@query
def expired_sessions(spark, sf):
    return sessions.expired_sessions(given.sessions(spark, sf), NOW)


@query
def live_sessions(spark, sf):
    return sessions.live_sessions(given.sessions(spark, sf), NOW)


@query
def refresh_outcomes(spark, sf):
    outcomes = sessions.refresh_outcomes(given.refresh_requests(spark, sf), given.sessions(spark, sf), NOW)
    return outcomes.select("requestId", "outcome", "sessionId", "userId")


@query
def rotate_sessions(spark, sf):
    asked = given.refresh_requests(spark, sf).select("token", "newToken", F.col("requestedAt").alias("rotatedAt"))
    return sessions.rotate_sessions(given.sessions(spark, sf), asked)


@query
def refresh_sessions(spark, sf):
    return refresh(given.refresh_requests(spark, sf), given.sessions(spark, sf), NOW)[0]


@query
def refresh_sessions_outcomes(spark, sf):
    """What the requests that made those sessions came to."""
    outcomes = refresh(given.refresh_requests(spark, sf), given.sessions(spark, sf), NOW)[1]
    return outcomes.select("requestId", "newToken", "outcome", "sessionId", "userId")


@query
def delete_sessions(spark, sf):
    """Log-outs by token, then the sweep of the expired."""
    left = catalog.delete_rows(given.sessions(spark, sf), given.refresh_requests(spark, sf), "token")
    return catalog.delete_where(left, F.col("expiresAt") < F.to_timestamp_ntz(F.lit(NOW)))


@query
def login_lookup(spark, sf):
    attempts = given.login_attempts(spark, sf).select("attemptId", "email")
    return sessions.login_lookup(attempts, given.accounts(spark, sf))


@query
def log_in_sessions(spark, sf):
    return log_in(given.login_attempts(spark, sf), given.accounts(spark, sf), given.sessions(spark, sf)).drop("id")


# -- parts -------------------------------------------------------------------------------------------

@query
def plan_parts(spark, sf):
    """Texts as files, every tenth without a size, empty, or far too long for its parts."""
    number, size = F.col("doc_id"), F.col("n_chars")
    files = given.table(spark, sf, "documents").select(
        number.alias("id"),
        F.when(number % 30 == 0, size * 0).when(number % 30 == 10, size * 10_000_000).when(number % 30 != 20, size).alias("fileSize"),
    )
    return parts.plan_parts(files, PART_SIZE)


@query
def oversized_uploads(spark, sf):
    files = given.documents(spark, sf).select("id", "fileSize")
    return parts.oversized_uploads(files, 40)


@query
def part_manifest(spark, sf):
    listed = F.transform("parts", lambda p: F.concat_ws(":", F.coalesce(p["partNumber"].cast("string"), F.lit("-")), p["etag"]))
    manifest = parts.part_manifest(given.received_parts(spark, sf))
    return manifest.withColumn("parts", F.array_join(listed, ","))


# -- texts -------------------------------------------------------------------------------------------

@query
def extract_text(spark, sf):
    """Texts as stored files: languages as file types, one of them not text, one not UTF-8."""
    lang = F.col("lang")
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    files = given.table(spark, sf, "documents").select(
        F.concat(F.lit("store/"), object_key(F.col("source"), F.col("doc_id"))).alias("path"),
        F.when(lang == "en", F.concat(name, F.lit(".txt")))
        .when(lang == "fr", F.concat(name, F.lit(".MD")))
        .when(lang == "de", F.concat(name, F.lit(".csv")))
        .otherwise(F.concat(name, F.lit(".pdf")))
        .alias("fileName"),
        F.when(lang == "de", F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF"))))
        .otherwise(F.encode("text", "UTF-8"))
        .alias("content"),
    )
    return passages.extract_text(files).select(
        key_part(F.col("path"), 1).alias("userId"),
        key_part(F.col("path"), 2).alias("documentId"),
        "fileName",
        "decodable",
        "text",
    )


@query
def classify_failures(spark, sf):
    """All texts, some spoiled, in the states of the change log, whose documents they take turns at."""
    newest = catalog.latest_document_state(given.log_columns(given.events(spark, sf)))
    lang = F.col("lang")
    spoiled = F.when(lang == "fr", " \n").when(lang == "de", "?!").when(lang == "en", F.col("text"))
    read = given.table(spark, sf, "documents").select(
        F.col("doc_id"),
        (F.col("doc_id") % 150).cast("string").alias("id"),
        spoiled.alias("text"),
        F.when(F.col("source") != "src0", lang != "es").alias("decodable"),
    ).withColumn("text", F.when(F.col("decodable"), F.col("text")))
    documents = read.join(newest, "id", "left").withColumn("failureReason", F.lit(None).cast("string"))
    return passages.classify_failures(documents).select("doc_id", "status", "failureReason")


@query
def chunk_documents(spark, sf):
    return given.chunks(spark, sf)


@query
def chunk_lines(spark, sf):
    return passages.chunk_lines(given.table(spark, sf, "documents").select("doc_id", "text"))


@query
def csv_passages(spark, sf):
    return structured.csv_passages(given.csv_files(spark, sf))


@query
def markdown_sections(spark, sf):
    return structured.markdown_sections(given.markdown_files(spark, sf))


@query
def file_passages(spark, sf):
    """Texts as files of three kinds: how many passages of each place, and their length in all."""
    named = lambda rows, ending: rows.withColumn("fileName", F.concat(F.col("doc_id").cast("string"), F.lit(ending)))
    files = named(given.csv_files(spark, sf), ".CSV").unionByName(named(given.markdown_files(spark, sf), ".md"))
    plain = named(given.gappy_texts(spark, sf).select("doc_id", "text"), ".txt")
    found = structured.file_passages(files.unionByName(plain)).where(~F.col("place").startswith("src"))
    return found.groupBy("fileName", "place").agg(F.count("*").alias("passages"), F.sum(F.length("passage")).alias("characters"))


@query
def term_search(spark, sf):
    return terms.term_search(given.texts(spark, sf), WORDS, k=50)


@query
def search_postings(spark, sf):
    """The ten best documents for the words of each benchmark text, from a stored index of all texts."""
    index = postings.build_postings(given.gappy_texts(spark, sf), shared_path(spark, "postings"), block=256)
    return postings.search_postings(given.benchmark_questions(spark, sf), index, 10, query_key="question_id", first=2)


@query
def extractive_summaries(spark, sf):
    """Of all texts, some of which are null."""
    found = terms.extractive_summaries(given.gappy_texts(spark, sf), n=3)
    return found.select(
        "doc_id",
        F.array_join("summary", " ").alias("summary"),
        F.concat_ws(",", F.col("positions").cast("array<string>")).alias("positions"),
    )


# -- vectors and answers -----------------------------------------------------------------------------

@query
def embed_chunks(spark, sf):
    """Vectors of all passages, one row per weight that is not 0."""
    vectors = embed(given.chunks(spark, sf)).select("doc_id", "chunk_no", F.posexplode("vector").alias("bucket", "weight"))
    return vectors.where(F.col("weight") != 0).withColumn("weight", F.round(F.col("weight").cast("double"), 4))


def _neighbours(spark, sf, **options):
    vectors = given.vectors(spark, sf)
    asked = vectors.withColumnRenamed("vec_id", "question_id")
    return retrieval.semantic_top_k(asked, vectors, 5, keys=["vec_id"], **options)


@query
def semantic_top_k(spark, sf):
    """For every vector, its five nearest."""
    return _neighbours(spark, sf)


@query
def semantic_top_k_blocks(spark, sf):
    """The same in several passes over the vectors."""
    return _neighbours(spark, sf, block_questions=200)


#: The given vectors lie nearly at random, so that their neighbours lie in many cells.
CELLS, PROBES = 32, 20


def _cell_index(spark, sf):
    return cells.build_cells(given.vectors(spark, sf), shared_path(spark, "cells"), CELLS, ["vec_id"])


def _cell_hits(spark, sf, probes, **options):
    index = _cell_index(spark, sf)
    asked = given.vectors(spark, sf).withColumnRenamed("vec_id", "question_id")
    return cells.search_cells(asked, index, 5, probes, keys=["vec_id"], **options)


@query
def cell_search(spark, sf):
    """For every vector, the nearest that its cells hold: itself, or an equal one."""
    return _cell_hits(spark, sf, PROBES).where(F.col("rank") == 1)


@query
def cell_search_recall(spark, sf):
    """How many of every vector's five nearest its cells hold, against the search of all."""
    found = cells.recall(_cell_hits(spark, sf, PROBES), _neighbours(spark, sf), "question_id", ["vec_id"])
    return found.select("wanted", (F.col("recall") >= 0.9).alias("enough"))


@query
def cell_search_all(spark, sf):
    """With all cells asked the search is exact."""
    return _cell_hits(spark, sf, CELLS)


def _neighbours_in_scope(spark, sf, **options):
    vectors = given.vectors(spark, sf).withColumnRenamed("label", "workspace")
    place = F.when(F.col("workspace") != 0, F.col("workspace")).alias("workspace")
    asked = vectors.select(F.col("vec_id").alias("question_id"), "vector", place)
    return retrieval.scoped_search(asked, vectors, 5, "workspace", keys=["vec_id"], **options)


@query
def scoped_search(spark, sf):
    """For every vector, its five nearest with its own label; label 0 searches all."""
    return _neighbours_in_scope(spark, sf)


@query
def scoped_search_blocks(spark, sf):
    """The same in several passes over the vectors."""
    return _neighbours_in_scope(spark, sf, block_questions=200)


def passage_table(spark, sf):
    """All documents, cut, embedded and stored."""
    return build_passage_table(given.texts(spark, sf).select("doc_id", "source", "text"), shared_path(spark, "passages"))


def _answers(spark, sf, questions):
    passages, weights = passage_table(spark, sf)
    return answer(questions, passages, weights, given.table(spark, sf, "documents"), k=5, title="source")


@query
def answer_questions(spark, sf):
    """Every benchmark text as a question to all documents: best passages, numbered sources."""
    return _answers(spark, sf, given.all_questions(spark, sf))


@query
def answer_from_unstored_texts(spark, sf):
    """The same without a stored table; passages are cut out of the texts again."""
    return answer_from_texts(given.benchmark_questions(spark, sf), given.texts(spark, sf), k=5, title="source")


@query
def cite_sources(spark, sf):
    """The two best stored passages of each benchmark text, the hits sent to the tasks as they are few."""
    passages, weights = passage_table(spark, sf)
    hits = find_passages(given.benchmark_questions(spark, sf), passages, 2, weights)
    bound = 2 * given.benchmark_questions(spark, sf).count()
    return answers.cite_sources(hits, passages, given.table(spark, sf, "documents"), "source", max_hits=bound)


@query
def question_context(spark, sf):
    """With a budget that some best passages exceed; questions without a word, or null, have an empty context."""
    asked = given.benchmark_questions(spark, sf)
    return answers.question_context(_answers(spark, sf, asked), budget=700, questions=asked)


# -- conversations and usage -------------------------------------------------------------------------

@query
def conversation_threads(spark, sf):
    pages = threads.conversation_threads(given.table(spark, sf, "conversations"), page_turns=4)
    return pages.select("conv_id", "page", F.explode("turns").alias("t"), "n_turns").select("conv_id", "page", "n_turns", "t.*")


@query
def search_conversations(spark, sf):
    return threads.search_conversations(given.table(spark, sf, "conversations"), "Estion")


@query
def search_indexed_conversations(spark, sf):
    """The same through the stored grams of the turns."""
    turns = given.table(spark, sf, "conversations")
    index = substrings.build_grams(turns, shared_path(spark, "grams"), "text", 16)
    found = substrings.search_substring(index, "Estion")
    return threads.search_conversations(found, "Estion")


@query
def recent_conversations(spark, sf):
    started = given.events(spark, sf, "click").select("event_id", "user_id", "ts")
    return threads.recent_conversations(started, 5, account="user_id", moment="ts", key="event_id")


@query
def sources_per_conversation(spark, sf):
    """Documents among the three best passages of everything users asked in a conversation."""
    asked = given.conversation_questions(spark, sf)
    passages, weights = passage_table(spark, sf)
    hits = find_passages(asked, passages, 3, weights)
    conversation = F.split_part("question_id", F.lit(":"), F.lit(1)).cast("bigint")
    return threads.sources_per_conversation(hits.withColumn("conv_id", conversation))


@query
def monthly_quota(spark, sf):
    asked = given.keyless_events(spark, sf).select("event_id", "user_id", "ts")
    return usage.monthly_quota(asked, LIMIT, "user_id", "ts", "event_id")


@query
def product_totals(spark, sf):
    processed = catalog.documents_in_status(given.documents(spark, sf), ["COMPLETED"])
    asked = given.table(spark, sf, "conversations").where(F.col("role") == "user")
    return usage.product_totals(given.events(spark, sf), processed, asked, account="user_id")


@query
def sketched_totals(spark, sf):
    """Events and active accounts of each day and of all, from stored sketches; the last day's written again by itself."""
    path = f"{shared_path(spark, 'sketches')}/days"
    rows = given.keyless_events(spark, sf)
    usage.store_day_sketches(rows, path, "user_id", "ts")
    last = rows.agg(F.max("ts").cast("date").alias("d")).first()["d"]
    usage.store_day_sketches(rows.where(F.col("ts").cast("date") == F.lit(last)), path, "user_id", "ts")
    return usage.sketched_totals(usage.read_day_sketches(spark, path))


# -- streams -----------------------------------------------------------------------------------------

def _places(spark, name):
    return shared_path(spark, name), shared_path(spark, f"{name}-checkpoint")


@query
def stream_validate_uploads(spark, sf):
    """The manifest as a stream of files, some lines in it twice, some of their files known before."""
    incoming = shared_path(spark, "incoming")
    lines = given.manifest_lines(spark, sf)
    number = F.regexp_extract("value", r"doc-(\d+)", 1).try_cast("bigint")
    lines.unionByName(lines.where(number % 3 == 0)).repartition(4).write.text(incoming)
    known = given.table(spark, sf, "documents").where(F.col("doc_id") % 5 == 0)
    known = known.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("fileName"))
    requests = upload_streams.stream_upload_manifests(spark, incoming, files_per_batch=1)
    checked = upload_streams.stream_validate_uploads(requests, *_places(spark, "checked-stream"), key="fileName", existing=known)
    return checked.select("line", "outcome", F.concat_ws(",", "errors.field").alias("fields"))


@query
def stream_latest_state(spark, sf):
    """Changes without an id are one document of their own, the newest of them its state."""
    log = given.log_columns(given.event_stream(spark, sf))
    return state.stream_latest_state(log, *_places(spark, "states"), "id", "updatedAt", "seq")


@query
def stream_dedup_uploads(spark, sf):
    """Object keys of a stream in which each comes many times, but for late ones that come once."""
    uploads = given.event_stream(spark, sf, with_late=True).select(
        object_key(F.col("user_id"), F.col("event_type")).alias("r2Key"), F.col("ts").alias("createdAt")
    )
    return upload_streams.stream_dedup_uploads(uploads, *_places(spark, "dedup")).select("r2Key")


@query
def stream_dedup_within(spark, sf):
    """The same keys with a watermark 40 days behind: how many of each key's rows were kept, repeated, late or without a time."""
    uploads = given.event_stream(spark, sf, with_late=True).select(
        object_key(F.col("user_id"), F.col("event_type")).alias("r2Key"), F.col("ts").alias("createdAt")
    )
    found = late.stream_dedup_within(uploads, *_places(spark, "dedup-within"), delay="40 days")
    return found.groupBy("r2Key", "outcome").agg(F.count("*").alias("uploads"))


@query
def stream_quota(spark, sf):
    return quota.stream_quota(given.event_stream(spark, sf), LIMIT, *_places(spark, "quota"), account="user_id", moment="ts")


@query
def stream_quota_events(spark, sf):
    asked = given.event_stream(spark, sf).select("event_id", "user_id", "ts")
    return quota.stream_quota_events(asked, LIMIT, *_places(spark, "quota-events"), account="user_id", moment="ts", key="event_id")


@query
def stream_quota_crossings(spark, sf):
    """Over four months: which event crosses the limit of a user's month, and each month's use when it is over."""
    apart = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + (ts - TIMESTAMP_NTZ '2024-01-01 00:00:00') * 4")
    asked = given.event_stream(spark, sf).select("event_id", "user_id", apart.alias("ts"))
    return months.stream_quota_crossings(asked, 10, *_places(spark, "crossings"), account="user_id", moment="ts", key="event_id")
