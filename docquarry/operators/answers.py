"""From hits to answers: numbered sources and the passages an answer may draw on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BROADCAST_ROWS = 50_000
SNIPPET = 160


def _small(hits: DataFrame, max_hits: int | None) -> DataFrame:
    """Marks hits for broadcast only if their number is proven small; else the join is left to Catalyst."""
    return F.broadcast(hits) if max_hits is not None and max_hits <= BROADCAST_ROWS else hits


def number_sources(hits: DataFrame, question_key: str = "question_id", doc_key: str = "doc_id") -> DataFrame:
    """Adds ``citation``: documents of a question numbered from 1 by their best hit."""
    best = F.min("rank").over(W.partitionBy(question_key, doc_key))
    numbered = F.dense_rank().over(W.partitionBy(question_key).orderBy("best_rank"))
    return hits.withColumn("best_rank", best).withColumn("citation", numbered).drop("best_rank")


def _cited(rows: DataFrame, question_key: str, keys: Sequence[str]) -> DataFrame:
    return rows.select(
        question_key,
        "rank",
        "citation",
        *keys,
        "title",
        "start",
        "score",
        F.substring("passage", 1, SNIPPET).alias("snippet"),
        "passage",
    )


def cite_sources(
    hits: DataFrame,
    chunks: DataFrame,
    documents: DataFrame,
    title: str,
    keys: Sequence[str] = ("doc_id", "chunk_no"),
    question_key: str = "question_id",
    max_hits: int | None = None,
) -> DataFrame:
    """Hits with citation number, document title, character offset, passage and snippet.

    For stored passages. ``max_hits`` is a proven bound on the rows of ``hits`` (questions times k):
    below the broadcast limit the hits travel and the passages stay where they are.
    """
    doc_key = keys[0]
    numbered = number_sources(hits, question_key, doc_key)
    cited = chunks.select(*keys, "start", "passage").join(_small(numbered, max_hits), list(keys))
    titles = documents.select(doc_key, F.col(title).alias("title"))
    return _cited(titles.join(_small(cited, max_hits), doc_key), question_key, keys)


def cite_texts(
    hits: DataFrame,
    documents: DataFrame,
    title: str,
    size: int,
    overlap: int,
    keys: Sequence[str] = ("doc_id", "chunk_no"),
    question_key: str = "question_id",
    max_hits: int | None = None,
    text: str = "text",
) -> DataFrame:
    """``cite_sources`` where passages are not stored: each is cut out of its document's text again.

    One join, and only cited documents are cut. ``size`` and ``overlap`` are those of the passages.
    """
    doc_key, chunk_key = keys
    start = F.col(chunk_key) * (size - overlap)
    numbered = number_sources(hits, question_key, doc_key)
    texts = documents.select(doc_key, F.col(title).alias("title"), F.col(text).alias("_text"))
    found = texts.join(_small(numbered, max_hits), doc_key).withColumn("start", start)
    return _cited(found.withColumn("passage", F.substring("_text", start + 1, F.lit(size))), question_key, keys)


def question_context(
    cited: DataFrame, budget: int, question_key: str = "question_id", questions: DataFrame | None = None,
) -> DataFrame:
    """The best passages of each question, in rank order, up to ``budget`` characters in all.

    A question whose best passage is longer than the budget stays, with no passages and an empty
    context; so does, where ``questions`` are given, one that has no hit: each of their rows has one
    here. A passage that fits has a character at least, so only the first ``budget`` ranks can fit:
    filtering on them first changes nothing and bounds what is gathered for a question.
    """
    size = F.coalesce(F.length("passage"), F.lit(0))
    so_far = F.sum(size).over(W.partitionBy(question_key).orderBy("rank"))
    ranked = cited.where(F.col("rank") <= max(budget, 1)).withColumn("so_far", so_far)
    kept = (size > 0) & (F.col("so_far") <= budget)
    entries = F.array_sort(F.collect_list(F.when(kept, F.struct("rank", "citation", "passage"))))
    text = F.transform("entries", lambda e: F.concat(F.lit("["), e["citation"].cast("string"), F.lit("] "), e["passage"]))
    found = (
        ranked.groupBy(question_key)
        .agg(entries.alias("entries"), F.coalesce(F.max(F.when(kept, F.col("so_far"))), F.lit(0)).alias("characters"))
        .select(question_key, F.size("entries").alias("passages"), "characters", F.array_join(text, "\n").alias("context"))
    )
    if questions is None:
        return found
    empty = {"passages": F.lit(0), "characters": F.lit(0).cast("long"), "context": F.lit("")}
    every = questions.select(question_key).join(found, question_key, "left")
    return every.select(question_key, *[F.coalesce(c, none).alias(c) for c, none in empty.items()])
