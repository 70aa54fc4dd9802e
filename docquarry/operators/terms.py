"""Keyword ranking and extractive summaries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions.text import occurrences, sentences, term_buckets, terms
from docquarry.operators.vectors import fit_bucket_weights

SUMMARY_DIMS = 65_536


def term_search(
    documents: DataFrame,
    words: Sequence[str],
    k: int,
    key: str = "doc_id",
    text: str = "text",
    k1: float = 1.2,
    b: float = 0.75,
) -> DataFrame:
    """The ``k`` best documents for a few words, by BM25.

    Only the given words are counted, inside each row, so no term is ever shuffled. What BM25 needs of
    the whole collection is one row of sums, put in as a scalar subquery.
    """
    words = list(dict.fromkeys(w.lower() for w in words))
    found = terms(F.col(text))
    counted = documents.select(key, found.alias("found")).select(
        key,
        F.size("found").alias("length"),
        *[occurrences("found", word).alias(f"tf{i}") for i, word in enumerate(words)],
    )
    totals = counted.agg(
        F.struct(
            F.count("*").alias("documents"),
            F.avg("length").alias("length"),
            *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))],
        ).alias("totals")
    ).scalar()
    counted = counted.withColumn("totals", totals)
    norm = F.lit(1 - b) + F.lit(b) * F.col("length") / F.col("totals.length")
    score = F.lit(0.0)
    for i in range(len(words)):
        tf, df = F.col(f"tf{i}"), F.col(f"totals.df{i}")
        idf = F.log(1 + (F.col("totals.documents") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * norm)
    hit = F.greatest(F.lit(0), *[F.col(f"tf{i}") for i in range(len(words))]) > 0
    ranked = counted.select(key, F.round(score, 6).alias("score"), hit.alias("hit"))
    # Filtering after the top k, not before: a filter would move down and split each text once more.
    return ranked.orderBy(F.desc("hit"), F.desc("score"), key).limit(k).where("hit").select(key, "score")


def extractive_summaries(
    documents: DataFrame,
    n: int,
    weights: Sequence[float] | None = None,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The ``n`` most informative sentences of each document, in text order, as ``summary``.

    A document without sentences, its text null or empty, has an empty summary. A sentence scores the sum of its term weights
    over the square root of its number of terms; the earlier one wins a tie. Weights are hashed, and
    fitted on ``documents`` unless given: an array of fixed size, with which scoring and picking stay
    inside the row.
    """
    weights = weights if weights is not None else fit_bucket_weights(documents, text, SUMMARY_DIMS)
    idf = np.asarray(weights, dtype=np.float64)
    shared = documents.sparkSession.sparkContext.broadcast(idf)

    @F.arrow_udf("array<double>")
    def score(buckets: pa.Array) -> pa.Array:
        inner = buckets.flatten()
        bounds = inner.offsets.to_numpy()
        gained = np.concatenate([[0.0], np.cumsum(shared.value[inner.flatten().to_numpy()])])
        # Sums per sentence from running totals lose digits; rounding below is far coarser.
        sums = gained[bounds[1:] - bounds[0]] - gained[bounds[:-1] - bounds[0]]
        sizes = np.maximum(np.diff(bounds), 1)
        scores = np.round(sums / np.sqrt(sizes), 6)
        offsets = buckets.offsets.to_numpy()
        starts = pa.array((offsets - offsets[0]).astype(np.int32))
        return pa.ListArray.from_arrays(starts, pa.array(scores))

    cut = documents.select(key, sentences(F.coalesce(F.col(text), F.lit(""))).alias("cut"))
    buckets = F.transform("cut", lambda s: term_buckets(s, len(idf)))
    scored = cut.withColumn("scores", score(buckets))
    ranked = F.array_sort(
        F.transform("scores", lambda score, at: F.struct((-score).alias("rank"), at.alias("at")))
    )
    best = F.array_sort(F.transform(F.slice(ranked, 1, n), lambda s: s["at"]))
    return scored.withColumn("best", best).select(
        key,
        F.transform("best", lambda at: F.col("cut")[at]).alias("summary"),
        F.transform("best", lambda at: at + 1).alias("positions"),
    )
