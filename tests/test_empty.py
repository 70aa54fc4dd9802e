"""Operators on tables without rows."""

import datetime as dt

from docquarry.operators import answers, catalog, parts, passages, sessions, terms, threads, usage
from docquarry.operators.vectors import embed_chunks, fit_bucket_weights
from docquarry.plans.accounts import log_in, sign_up
from docquarry.plans.ask import answer_from_texts
from docquarry.schemas import ACCOUNTS, DOCUMENTS, SESSIONS

NOW = dt.datetime(2024, 1, 1)


def test_catalog_and_sessions(spark):
    accounts, documents, held = (spark.createDataFrame([], s) for s in (ACCOUNTS, DOCUMENTS, SESSIONS))
    results = [
        catalog.document_cards(documents, NOW),
        catalog.account_documents(accounts, documents),
        catalog.upsert_rows(documents, documents, "id", "updatedAt"),
        catalog.latest_document_state(documents, "id", "updatedAt"),
        catalog.document_status_counts(documents),
        catalog.document_status_table(documents),
        catalog.abort_candidates(documents),
        catalog.orphan_rows(documents, accounts, "userId"),
        sessions.live_sessions(held, NOW),
        parts.plan_parts(documents, 10),
        usage.monthly_quota(documents, 50),
    ]
    assert [df.count() for df in results] == [0] * len(results)
    assert usage.product_totals(documents, documents, documents).where("value = 0").count() == 3


def test_batches(spark):
    accounts, held = spark.createDataFrame([], ACCOUNTS), spark.createDataFrame([], SESSIONS)
    requests = spark.createDataFrame(
        [], "requestId int, name string, email string, token string, requestedAt timestamp_ntz"
    )
    assert [df.count() for df in sign_up(requests, accounts)] == [0, 0, 0]
    attempts = spark.createDataFrame([], "attemptId int, email string, token string, attemptedAt timestamp_ntz")
    assert log_in(attempts, accounts, held).count() == 0


def test_texts(spark):
    documents = spark.createDataFrame([], "doc_id int, text string, source string")
    chunks = passages.chunk_documents(documents)
    assert chunks.count() == 0 and passages.chunk_lines(documents).count() == 0
    assert fit_bucket_weights(chunks, "passage") == [0.0] * 256
    assert embed_chunks(chunks).count() == 0
    assert terms.term_search(documents, ["a"], 3).count() == 0
    assert terms.extractive_summaries(documents, 3).count() == 0
    questions = spark.createDataFrame([(1, "what")], "question_id int, text string")
    found = answer_from_texts(questions, documents, 3, "source")
    assert found.count() == 0 and answers.question_context(found, 10).count() == 0
    assert answer_from_texts(questions.limit(0), documents, 3, "source").count() == 0


def test_threads(spark):
    turns = spark.createDataFrame([], "conv_id int, turn int, role string, text string")
    assert threads.conversation_threads(turns).count() == 0
    assert threads.search_conversations(turns, "a").count() == 0
