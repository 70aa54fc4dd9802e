import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docquarry.operators.answers import cite_sources, number_sources, question_context
from docquarry.operators.passages import chunk_documents, chunk_lines, classify_failures, extract_text
from docquarry.operators.terms import extractive_summaries, term_search
from docquarry.operators.vectors import embed_chunks, fit_bucket_weights
from docquarry.plans.ask import answer_from_texts, answer_questions, build_passage_table, find_passages
from docquarry.plans.registry import QUERIES
from docquarry.session import shared_path


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def expected_chunks(text, size, overlap):
    step, n = size - overlap, len(text)
    return [(i, i * step, text[i * step : i * step + size]) for i in range(max(1, math.ceil((n - overlap) / step)))] if n else []


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    texts=st.lists(st.text(alphabet="ab \n😀é.\r ", max_size=60), min_size=1, max_size=8),
    size=st.integers(1, 12),
    cut=st.integers(1, 12),
)
def test_passages_are_exact(spark, texts, size, cut):
    overlap = max(0, size - cut)
    rows = chunk_documents(docs(spark, *texts), size, overlap).collect()
    for number, text in enumerate(texts):
        mine = sorted((r.chunk_no, r.start, r.passage) for r in rows if r.doc_id == number)
        assert mine == expected_chunks(text, size, overlap)


def test_a_long_text_is_cut_whole(spark):
    text = "0123456789" * 300_000
    found = chunk_documents(docs(spark, text)).agg(F.count("*"), F.max("start"), F.sum(F.length("passage"))).head()
    chunks = expected_chunks(text, 800, 100)
    assert tuple(found) == (len(chunks), chunks[-1][1], sum(len(c[2]) for c in chunks))


def test_bad_overlap(spark):
    with pytest.raises(ValueError):
        chunk_documents(docs(spark, "a"), 10, 10)


def test_lines(spark):
    rows = chunk_lines(docs(spark, "a\n\n b \n\t\nc")).collect()
    assert [(r.line_no, r.passage) for r in rows] == [(1, "a"), (3, " b "), (5, "c")]


def test_text_extraction_and_failures(spark):
    files = spark.createDataFrame(
        [
            (1, "a.txt", bytearray("é".encode())),
            (2, "b.MD", bytearray(b" \n\t")),
            (3, "c.csv", bytearray(b"\xff\xfe")),
            (4, "d.pdf", bytearray(b"%PDF")),
            (5, "e.txt", bytearray(b"?!")),
            (6, "f.txt", bytearray(b"fine")),
        ],
        "id int, fileName string, content binary",
    )
    read = extract_text(files)
    assert [(r.decodable, r.text) for r in read.orderBy("id").collect()] == [
        (True, "é"), (True, " \n\t"), (False, None), (None, None), (True, "?!"), (True, "fine"),
    ]
    failed = read.withColumn("status", F.when(F.col("id") == 1, "COMPLETED").otherwise("FAILED"))
    failed = failed.withColumn("failureReason", F.when(F.col("id") == 6, "OCR_REQUIRED"))
    assert [r.failureReason for r in classify_failures(failed).orderBy("id").collect()] == [
        None, "EMPTY_DOCUMENT", "CORRUPTED_FILE", None, "EMBEDDING_FAILED", "OCR_REQUIRED",
    ]


def test_weights_and_vectors(spark):
    rows = docs(spark, "apple pear", "apple", "", "?!").withColumnRenamed("text", "passage")
    weights = fit_bucket_weights(rows, "passage")
    assert len(weights) == 256 and max(weights) == pytest.approx(math.log(5))
    vectors = {r.doc_id: r.vector for r in embed_chunks(rows, weights).collect()}
    assert vectors[2] is None and vectors[3] is None
    assert np.linalg.norm(vectors[0]) == pytest.approx(1, abs=1e-6)
    assert np.count_nonzero(vectors[1]) == 1


def test_a_model_can_be_plugged_in(spark):
    def lengths(texts: pa.Array) -> pa.Array:
        return pa.array([[float(len(t.as_py())), 1.0] for t in texts], pa.list_(pa.float32()))

    rows = docs(spark, "abc", "a").withColumnRenamed("text", "passage")
    assert sorted(r.vector for r in embed_chunks(rows, embed_fn=lengths).collect()) == [[1.0, 1.0], [3.0, 1.0]]


def test_term_search_counts_words_not_parts(spark):
    rows = docs(spark, "the cat. The CAT", "cathedral", "a cat", "nothing", "")
    found = term_search(rows, ["Cat", "the"], k=10).collect()
    assert [r.doc_id for r in found] == [0, 2]
    assert [r.doc_id for r in term_search(rows, ["cat"], k=1).collect()] == [0]
    assert term_search(rows, ["zebra"], k=3).count() == 0


def test_summaries_keep_text_order(spark):
    rows = docs(spark, "Same same. Zebra quagga okapi! Same.\nSame again", "", "...", "One")
    found = {r.doc_id: (r.summary, r.positions) for r in extractive_summaries(rows, 2).collect()}
    assert found[0][0][0] == "Zebra quagga okapi!" or found[0][0][1] == "Zebra quagga okapi!"
    assert found[0][1] == sorted(found[0][1]) and len(found[0][0]) == 2
    assert found[1] == ([], []) and found[2] == ([], [])
    assert found[3] == (["One"], [1])


def test_citations_and_context(spark):
    hits = spark.createDataFrame(
        [(1, 1, 7, 0, 0.9), (1, 2, 5, 1, 0.8), (1, 3, 7, 2, 0.7), (2, 1, 5, 1, 0.4)],
        "question_id int, rank int, doc_id int, chunk_no int, score double",
    )
    chunks = spark.createDataFrame(
        [(7, 0, 0, "aaa"), (5, 1, 10, "bbbb"), (7, 2, 20, "cc")], "doc_id int, chunk_no int, start int, passage string"
    )
    titles = spark.createDataFrame([(7, "seven"), (5, "five")], "doc_id int, name string")
    assert [(r.rank, r.citation) for r in number_sources(hits).where("question_id = 1").orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 1)]
    for bound in (None, 4):
        cited = cite_sources(hits, chunks, titles, "name", max_hits=bound)
        rows = {r.question_id: (r.passages, r.characters, r.context) for r in question_context(cited, 7).collect()}
        assert rows == {1: (2, 7, "[1] aaa\n[2] bbbb"), 2: (1, 4, "[1] bbbb")}
    none = question_context(cited, 3).where("question_id = 2").collect()
    assert [(r.passages, r.characters, r.context) for r in none] == [(0, 0, "")]
    assert question_context(cited, 0).count() == 2


def test_a_stored_passage_table_answers_like_the_text(spark, sf):
    texts = spark.read.parquet(f"{sf}/documents.parquet")
    questions = spark.read.parquet(f"{sf}/benchmark.parquet").withColumnRenamed("item_id", "question_id")
    stored, weights = build_passage_table(texts, shared_path(spark, "passages"))
    again = find_passages(questions, stored, 3, weights).toPandas().sort_values(["question_id", "rank"])
    direct = answer_from_texts(questions, texts, 3, "source").toPandas().sort_values(["question_id", "rank"])
    columns = ["question_id", "rank", "doc_id", "chunk_no", "score"]
    pd.testing.assert_frame_equal(again[columns].reset_index(drop=True), direct[columns].reset_index(drop=True))
    answers = answer_questions(questions, stored, weights, texts, 3, "source").toPandas().sort_values(["question_id", "rank"])
    pd.testing.assert_frame_equal(answers.reset_index(drop=True)[direct.columns], direct.reset_index(drop=True))


def test_every_benchmark_text_is_asked(spark, tmp_path):
    """None is blanked on the way, in the query or in its SQL."""
    texts = [(i, f"word{i} word{i} other{i}", f"src{i}", 20) for i in range(12)]
    spark.createDataFrame(texts, "doc_id long, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    asked = [(i, f"word{i}") for i in range(12)]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r.question_id: r.doc_id for r in QUERIES["answer_questions"](spark, str(tmp_path)).where("rank = 1").collect()}
    assert found == {i: i for i in range(12)}
